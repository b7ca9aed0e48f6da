"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of a text is unique, and so is the last token of the encoding of each of its prefixes. That token is
the one suffix of the prefix that is compatible with the last token of what stands before it, where two tokens are
compatible when BPE of their joined bytes gives back the two. An automaton over the vocabulary lists the suffixes;
the table of last tokens is followed back from the end. Time is linear in the text, however long a piece is.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

# White space as Unicode has it (Python's own class also takes 1C to 1F), and the word pattern of the vocabulary.
SPACES = "\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"

_NEVER = 1 << 60


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Recent:
    """What was found for short strings lately: a full new half becomes the old half, so memory stays bounded."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.new[key] = found
        return found

    def add(self, key: str, value: bytes) -> bytes:
        if len(key) <= 64:
            if len(self.new) >= self.limit:
                self.old = dict(self.new)
                self.new.clear()  # the same dict, as a running loop may hold on to it
            self.new[key] = value
        return value


class ByteBPE:
    """A vocabulary file of the byte-level kind, ready to encode and decode."""

    #: A run of white space ends before its last character if a word follows; no token crosses these borders.
    chunks = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
    words = regex.compile(WORDS)

    def __init__(self, path: str, remembered: int = 300_000):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        of = byte_characters()
        raw = {token: bytes(of[c] for c in token) for token in parts["model"]["vocab"]}
        self.ids = {raw[token]: i for token, i in parts["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        for rank, merge in enumerate(parts["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (self.ids[raw[left]], self.ids[raw[right]]), self.ids[raw[left] + raw[right]]
            self.rank.setdefault(pair, rank)
            if whole not in self.made:
                self.made[whole], self.split[whole] = rank, pair
        self.special = {t["content"]: t["id"] for t in parts.get("added_tokens", [])}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        # The bytes of every id, and none for ids outside the vocabulary.
        self.taken = pa.array([*[self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)], b""], pa.large_binary())
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.remembered = remembered
        self.chunk_ids, self.word_ids = Recent(remembered), Recent(remembered)
        self.fits: dict[int, bool] = {}
        self.edge: dict[tuple[int, int], list[tuple[int, int]]] = {}
        # Only tokens that BPE makes of their own bytes can stand in an encoding.
        self.whole = {i for i in self.ids.values() if i not in self.split or self._crossing(*self.split[i]) == self.split[i]}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if i in self.whole:
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end of ``token`` while it is built, each with the rank of the merge that consumes it."""
        if (token, side) not in self.edge:
            chain = [(token, _NEVER)]
            while (inner := chain[-1][0]) in self.split:
                chain.append((self.split[inner][side], self.made[inner]))
            self.edge[token, side] = chain[::-1]
        return self.edge[token, side]

    def _crossing(self, a: int, b: int) -> tuple[int, int] | None:
        """The first merge across the border of a and b while BPE builds both of their bytes, if one comes before they are done.

        Merges of equal rank happen from left to right, so a crossing one loses to one inside a, and wins over one inside b.
        """
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.rank.get((x, y), _NEVER)
            if rank < x_ends and rank <= y_ends:
                return x, y
            if x_ends == y_ends == _NEVER:
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a and b gives [a, b]."""
        if len(self.fits) >= 4 * self.remembered:
            self.fits.clear()
        known = self.fits[a << 32 | b] = self._crossing(a, b) is None
        return known

    def piece(self, data: bytes) -> list[int]:
        """The ids of one word: the last token of every prefix, then back from the end."""
        if (known := self.ids.get(data)) in self.whole:
            return [known]
        last, known, done = [-1] * (len(data) + 1), self.fits.get, -1
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            if end == done:  # a longer suffix has been taken
                continue
            if start := end + 1 - size:
                before = last[start]
                fit = known(before << 32 | token)
                if not (self.compatible(before, token) if fit is None else fit):
                    continue
            last[end + 1], done = token, end
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def _word(self, word: str) -> bytes:
        return array("I", self.piece(word.encode("utf-8", "replace"))).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.word_ids.get(w) or self.word_ids.add(w, self._word(w)) for w in self.words.findall(chunk)])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        new, out = self.chunk_ids.new, []
        known = new.get
        for part in self.special_at.split(text) if self.special_at else [text]:
            if part in self.special:
                out.append(np.uint32(self.special[part]).tobytes())
            else:
                out += [known(c) or self.chunk_ids.get(c) or self.chunk_ids.add(c, self._chunk(c)) for c in self.chunks.findall(part)]
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Ids outside the vocabulary are left out; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of lists of ids that lie one after another; ``ends`` holds 0 and where each list ends."""
        inside = np.where((ids >= 0) & (ids < len(self.taken) - 1), ids, len(self.taken) - 1)
        found = self.taken.take(pa.array(inside))
        data = memoryview(found.buffers()[2] or b"")
        at = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[ends] if len(found) else np.zeros(len(ends), np.int64)
        return [str(data[a:b], "utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, as the vocabulary's own library encodes a text without adding special tokens.

    A null or empty text has no ids. The strings of the vocabulary's special tokens are taken as those tokens.
    ``vocabulary`` is the path of the file on every executor. One row out for each row in, repeated ones included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            found = [bpe.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(found), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    source = pick(docs, id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['id']}, ids array<int>")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values, -1 for nulls, and 0 and the ends of the lists; a null list is empty."""
    values = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return pc.fill_null(values, -1).to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode`` and then ``decode`` give, without moving ids or texts out of the task.

    The first is of the decimal ids joined by commas, the second of the decoded text in UTF-8. Rows are treated as by ``encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        shown = pa.array([f"{i}," for i in range(len(bpe.taken))], pa.large_string())
        for batch in batches:
            counts, of_ids, of_texts = [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.frombuffer(bpe.encode(text) if text else b"", "<u4").astype(np.int64)
                listed = shown.take(pa.array(ids)).buffers()[2] if len(ids) else None
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(memoryview(listed)[:-1] if listed else b"").hexdigest())
                of_texts.append(hashlib.sha256(bpe.decode_all(ids, np.array([0, len(ids)]))[0].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = pick(docs, id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of each list of ids; null ids give an empty text. A column of that name is replaced."""
    columns = [c for c in tokens.columns if c != text_col]
    rows = tokens.select(*[f"`{c}`" for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts = bpe.decode_all(*_lists(batch.column(columns.index(ids_col))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, text_col])

    return rows.mapInArrow(run, rows.select("*", F.lit("").alias(text_col)).schema)

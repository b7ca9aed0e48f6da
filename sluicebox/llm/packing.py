"""Token sequences packed by vector best fit.

Pieces of documents go, longest first, into the open sequence that fits them best under three capacities: tokens,
documents, and attention cost (the sum of squared piece lengths). All three must hold. Among the sequences that
can take a piece, the rule picks the smallest weighted norm of what would remain, or the largest weighted dot product
of demand and remainder.

With the default capacities of documents and attention cost, 4,096 and the square of the tokens, these two never bind, and the rule is best fit by tokens; callers set
them lower where they matter.

Pieces are dealt by hash into shards of about ``SHARD`` pieces, whatever the size of the corpus, and each shard is packed by
one task. Sequences that stay less full than ``FULL`` are opened again and their pieces packed in a second
round over fewer shards, so that the shards' last sequences cost next to nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, pick, stage

CAPACITY = 4096
SHARD = 4096
FULL = 0.98
#: Weights of tokens, documents and attention cost, as shares of their capacities.
WEIGHTS = (1.0, 0.001, 0.001)


class WordTokenizer:
    """A vocabulary of the word kind, encoded by the tokenizers library once for each distinct run of characters.

    White space separates words and is dropped, so a text's ids are those of its runs in order. The library lower-cases and cuts punctuation off letters and
    digits itself; doing so before, in ASCII, leaves fewer distinct runs. Runs are cut, numbered and replaced by their ids in Arrow and numpy, many texts
    at a time; Python sees each distinct one. Texts with special tokens go to the library whole.
    """

    #: Runs of letters of ASCII and Latin-1, which the library only lower-cases: but for that only its model is needed.
    latin = re.compile(r"[a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")

    def __init__(self, path: str, remembered: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, runs: list[str]) -> None:
        """The ids of many runs by few calls. A run of letters is one word; of others, a token belongs to the run in which it starts."""
        plain, others = [], []
        for run in runs:
            (plain if self.latin.fullmatch(run) else others).append(run)
        ids: list[int] = []
        ends = []
        for run in plain:  # nothing is left to normalise or to cut
            ids += [t.id for t in self.model.tokenize(run if run.isascii() else _byte_level(run.lower()))]
            ends.append(4 * len(ids))
        self._keep(plain, np.array(ids, "<u4").tobytes(), ends)
        words = [r for r in others if r.isalpha()]
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            self._keep(part, ids.tobytes(), ends.tolist()) if len(ends) == len(part) else self._learn_by_place(part)
        others = [r for r in others if not r.isalpha()]
        for at in range(0, len(others), 1000):
            self._learn_by_place(others[at : at + 1000])

    def _learn_by_place(self, part: list[str]) -> None:
        found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
        ends = np.searchsorted([start for start, _ in found.offsets], np.cumsum([len(r) + 1 for r in part])) * 4
        self._keep(part, np.array(found.ids, "<u4").tobytes(), ends.tolist())

    def _keep(self, part: list[str], data: bytes, ends: list[int]) -> None:
        start = 0
        for run, end in zip(part, ends, strict=True):
            self.known[run] = data[start:end]
            start = end
        self.held += sum(map(len, part))

    def encode_all(self, texts: list[str | None] | pa.Array) -> Iterator[bytes]:
        """The ids of each text, ``TEXT_BYTES`` at a time."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):
            so_far = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, so_far + TEXT_BYTES, "right")))
            yield from self._some(texts.slice(first, last - first))
            first = last

    def _some(self, texts: pa.LargeStringArray) -> Iterator[bytes]:
        # What was found goes to an older half when it is much, and from there back when it occurs again: memory stays bounded.
        if len(self.known) > self.remembered or self.held > 40 * self.remembered:
            self.before, self.known, self.held = self.known, {}, 0
        special = pc.match_substring(texts, "<|")
        whole = {i: self._whole(texts[i].as_py()) for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()}
        split = pc.ascii_split_whitespace(_cut_runs(pc.if_else(special, "", texts) if whole else texts))
        runs = split.flatten().dictionary_encode()
        names = runs.dictionary.to_pylist()
        new = [r for r in names if r not in self.known]
        for run in new:
            if run in self.before:
                self.known[run] = self.before[run]
        self._learn([r for r in new if r not in self.known])
        ids = pa.array(map(self.known.__getitem__, names), pa.large_binary(), size=len(names)).take(runs.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        data = memoryview(ids.buffers()[2] or b"")
        for i in range(len(texts)):
            yield whole[i] if i in whole else bytes(data[ends[i] : ends[i + 1]])


#: Bytes of text that are cut and looked up together; a longer text is taken alone. A worker holds about ten times as much on the way.
TEXT_BYTES = 4_000_000
_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE = range(5)


def _kind(c: int) -> int:
    if 97 <= c | 32 <= 122 and c < 128:
        return _LETTER
    if 48 <= c <= 57:
        return _DIGIT
    return _QUOTE if c == 39 else _MARK if 33 <= c <= 126 else _OTHER


_KINDS = bytes(map(_kind, range(256)))
#: Kinds of neighbours that are never of one token. A quote may begin one with the letters after it.
_APART = np.zeros(64, bool)
_APART[[8 * a + b for a, b in (
    (_LETTER, _DIGIT), (_LETTER, _MARK), (_LETTER, _QUOTE), (_DIGIT, _LETTER), (_DIGIT, _DIGIT), (_DIGIT, _MARK), (_DIGIT, _QUOTE),
    (_MARK, _LETTER), (_MARK, _DIGIT), (_QUOTE, _DIGIT),
)]] = True


def _cut_runs(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """A-Z lower-cased, and a space between neighbours that are never of one token: letters (of Latin-1), digits and marks in ASCII."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = bytes(memoryview(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]]).translate(LOWER)
    chars, kinds = np.frombuffer(data, np.uint8), np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8)
    ends = np.flatnonzero(chars[:-1] == 0xC3) + 1  # second bytes of U+00C0 to U+00FF, which are letters but two
    kinds[ends[(chars[ends] & 0xDF) != 0x97]] = _LETTER
    gaps = np.flatnonzero(_APART[kinds[:-1] * np.uint8(8) + kinds[1:]]) + 1
    out = np.full(len(chars) + len(gaps), 32, np.uint8)
    place = np.ones(len(out), bool)
    place[gaps + np.arange(len(gaps))] = False
    out[place] = chars
    bounds = bounds - bounds[0]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds + np.searchsorted(gaps, bounds)), pa.py_buffer(out))


def _byte_level(word: str) -> str:
    """The characters that stand for a word's bytes in byte-level vocabularies."""
    return word.encode().decode("latin-1").translate(_BYTE_LEVEL)


#: Bytes that are no visible character of Latin-1 have characters from U+0100 on, in their order.
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together until they hold ``TEXT_BYTES``, as texts share more of their runs the more there are."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= TEXT_BYTES:
            whole = pa.concat_batches(held)
            held, size = [], 0
            yield whole
    if held:
        yield pa.concat_batches(held)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and ``end_id``, cut after every ``capacity`` ids.

    ``ids`` is binary, little-endian unsigned 32-bit; with ``digests`` there is (ids_crc32 long), their CRC-32, in its place. A null or empty text is one piece with ``end_id`` alone.
    """
    size = 4 * capacity
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        for batch in _together(batches):
            rows, pieces, lengths, ids = [], [], [], []
            for i, data in enumerate(tokenizer.encode_all(batch.column("text"))):
                data += end
                cuts = [data[at : at + size] for at in range(0, len(data), size)] if len(data) > size else [data]
                rows += [i] * len(cuts)
                pieces += range(len(cuts))
                lengths += [len(x) // 4 for x in cuts]
                ids += map(zlib.crc32, cuts) if digests else cuts
            at = np.array(pieces, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(at), pa.array(at.astype(np.int64) * capacity),
                 pa.array(lengths, pa.int64()), pa.array(ids, pa.int64() if digests else pa.binary())],
                ["doc_id", "piece", "start", "length", "ids_crc32" if digests else "ids"],
            )
            pa.default_memory_pool().release_unused()  # Arrow would keep what it has freed as long as the worker lives, which later tasks use

    source = pick(docs, id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['id']}, piece int, start long, length long, {'ids_crc32 long' if digests else 'ids binary'}")


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of every piece. A piece over a capacity by itself gets a bin of its own."""
    limit, weight = np.array(capacities, float)[:, None], np.array(weights, float)[:, None]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((3, len(lengths) + 1))
    where = np.empty(len(lengths) + 1, np.int64)
    used = np.zeros(len(lengths) + 1, np.int64)
    n_open = n_bins = 0
    smallest = lengths.min() if len(lengths) else 0
    for i in np.lexsort((np.arange(len(lengths)), -lengths)):
        demand = np.array([[lengths[i]], [1.0], [float(lengths[i]) ** 2]])
        free = room[:, :n_open]
        fits = np.flatnonzero((free >= demand).all(axis=0))
        if len(fits):
            if rule == "norm":
                at = fits[np.argmin((weight * ((free[:, fits] - demand) / limit) ** 2).sum(axis=0))]
            else:
                at = fits[np.argmax((weight * (free[:, fits] * demand) / limit**2).sum(axis=0))]
        else:
            at, n_open = n_open, n_open + 1
            room[:, at], where[at], used[at] = limit[:, 0], n_bins, 0
            n_bins += 1
        bins[i], offsets[i] = where[at], used[at]
        room[:, at] -= demand[:, 0]
        used[at] += lengths[i]
        if room[0, at] < smallest or room[1, at] < 1 or room[2, at] < float(smallest) ** 2:  # closed: the last open one takes its place
            n_open -= 1
            room[:, at], where[at], used[at] = room[:, n_open], where[n_open], used[n_open]
    return bins, offsets


def pack(
    pieces: DataFrame,
    tokens: int = CAPACITY,
    documents: int = CAPACITY,
    attention: float = float(CAPACITY) ** 2,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
) -> DataFrame:
    """``pieces`` with (sequence_id, offset): its place in a sequence that keeps all three capacities, gapless from 0.

    Needs doc_id, piece and length; other columns are carried along. With the default capacities the last two never
    bind. An empty table gives an empty one. Repeated rows are packed as pieces of their own.
    """
    rows = stage(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    capacities = (tokens, documents, attention)

    def place(key: tuple[int, ...], shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("__row", ignore_index=True)
        bins, offsets = best_fit(shard["length"].to_numpy(), capacities, weights, rule)
        filled = np.bincount(bins, shard["length"].to_numpy(), minlength=len(shard))
        return pd.DataFrame({
            "__row": shard["__row"], "length": shard["length"], "sequence_id": (np.int64(key[0]) << 32) + bins, "offset": offsets,
            "__loose": filled[bins] < FULL * tokens,
        })

    def in_shards(part: DataFrame, count: int, first: int) -> DataFrame:
        n = max(1, -(-count // SHARD))
        dealt = part.select("__row", "length", (F.pmod(F.xxhash64("__row", F.lit(first)), F.lit(n)) + first).alias("__shard"))
        return dealt.repartition(n, "__shard").groupBy("__shard").applyInPandas(
            place, "__row long, length long, sequence_id long, offset long, __loose boolean"
        ), first + n

    placed, first = in_shards(rows, rows.count(), 0)
    placed = stage(placed, "packed")
    loose = placed.where("__loose")
    again, _ = in_shards(loose, loose.count(), first)
    places = placed.where("not __loose").union(again).select("__row", "sequence_id", "offset")
    return rows.join(places, "__row").drop("__row")

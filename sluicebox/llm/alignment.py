"""Alignment of two tokenizers' tokens over the same bytes, by lockstep vectorised merging.

Tokenizer A encodes a space and the text, B the text, to which it adds that space. Both give a rising list of byte offsets where tokens end. One
numpy state vector holds an A pointer and a B pointer for every document of a batch; each step compares the two ends under the pointers, emits a link and a
cut where they are equal, and moves the pointer that is behind, or both. Lanes that reach their end are compacted away. A document is as many lanes as
it has ranges of ``RANGE`` bytes, which are independent of each other, so a very long document takes no more steps than any other.

How often the ids of a link are linked in the corpus is counted in blocks of documents: a block sends each of its different pairs once, and gets back their
counts. So a pair that every document has costs one row a block, not one a document.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WORDS, byte_characters
from .common import pick, stage

RANGE, PART, BLOCK = 1024, 1 << 21, 1 << 23
#: A pair of ids in one number: the A id above, the B id in the low bits.
_SHIFT = 32


class Vocabulary:
    """The bytes of every id, and what tokens look like in a list of ids."""

    def __init__(self, tokens: list[bytes], marks: str):
        self.tokens = pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        # The decimal id followed by the first mark, then the same by the second one.
        self.shown = pa.array([f"{i}{mark}" for mark in marks for i in range(len(tokens))], pa.large_string())


class Tokenizers:
    """A byte-level vocabulary (A) and a piece vocabulary (B), with special tokens as plain text."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(byte_level, encoding="utf-8") as file:
            parts = json.load(file)
        of, special = byte_characters(), {t["content"]: t["id"] for t in parts.get("added_tokens", [])}
        raw = {i: bytes(of[c] for c in token) for token, i in parts["model"]["vocab"].items() if token not in special}
        names = raw | {i: token.encode() for token, i in special.items()}
        self.a = Vocabulary([names.get(i, b"") for i in range(max(names) + 1)], ",|")
        self.fast = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks={b: i for i, b in raw.items()}, special_tokens={})
        self.slow = Tokenizer.from_file(byte_level)
        self.slow.encode_special_tokens = True
        self.slow.no_truncation()
        self.slow.no_padding()
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        known = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(known)], ",;")

    def ids_a(self, text: str) -> np.ndarray:
        """The ids of a space and the text. Long runs without a border between words go to the vocabulary's own library."""
        if len(text) < 100_000:
            return np.frombuffer(self.fast._core_bpe.encode_to_tiktoken_buffer(" " + text, set()), np.uint32)
        return np.array(self.slow.encode(" " + text, add_special_tokens=False).ids, np.uint32)

    def ids_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def load(byte_level: str, pieces: str) -> Tokenizers:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizers(byte_level, pieces)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray, width: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``ends_a``, in ``ends_b``) of tokens that end together, in rising order.

    Ends are offsets into all documents' bytes one after another, rising within each list; ``bounds`` are the offsets where documents end.
    """
    if not len(bounds) or not len(ends_a) or not len(ends_b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = bounds[-1]
    cuts = np.unique(np.concatenate([bounds, np.arange(width, last + width, width).clip(max=last)]))
    stop_a, stop_b = np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")
    at_a, at_b = np.concatenate([[0], stop_a[:-1]]), np.concatenate([[0], stop_b[:-1]])
    links_a, links_b = [], []
    going = np.flatnonzero((at_a < stop_a) & (at_b < stop_b))
    at_a, at_b, stop_a, stop_b = at_a[going], at_b[going], stop_a[going], stop_b[going]
    while len(at_a):
        ahead = ends_a[at_a] - ends_b[at_b]
        equal = ahead == 0
        links_a.append(at_a[equal])
        links_b.append(at_b[equal])
        at_a, at_b = at_a + (ahead <= 0), at_b + (ahead >= 0)
        going = (at_a < stop_a) & (at_b < stop_b)
        if not going.all():
            at_a, at_b, stop_a, stop_b = at_a[going], at_b[going], stop_a[going], stop_b[going]
    found_a, found_b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(found_a, kind="stable")
    return found_a[order], found_b[order]


def _joined(strings: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The strings of the ids one after another, and where each ends."""
    taken = strings.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[1:] if len(taken) else np.zeros(0, np.int64)
    return memoryview(taken.buffers()[2] or b""), ends


def _offsets(sizes: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def aligned(known: Tokenizers, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
    """(n_a, n_b, n_groups, digest of the groups, pairs of linked ids) of each text."""
    asked = [i for i, t in enumerate(texts) if t]
    ids_a = [known.ids_a(texts[i]) for i in asked]
    ids_b = known.ids_b([texts[i] for i in asked])
    kept = []
    for k, (a, b) in enumerate(zip(ids_a, ids_b, strict=True)):
        want = b" " + texts[asked[k]].encode()
        if bytes(_joined(known.a.tokens, a)[0]) == want and bytes(_joined(known.b.tokens, b)[0]) == want:
            kept.append(k)
    out: list = [(0, 0, 0, "", np.zeros(0, np.int64))] * len(texts)
    if not kept:
        return out
    counts_a, counts_b = [len(ids_a[k]) for k in kept], [len(ids_b[k]) for k in kept]
    a, b = np.concatenate([ids_a[k] for k in kept]).astype(np.int64), np.concatenate([ids_b[k] for k in kept]).astype(np.int64)
    ends_a, ends_b = np.cumsum(known.a.sizes[a]), np.cumsum(known.b.sizes[b])
    from_a, from_b = _offsets(counts_a), _offsets(counts_b)
    bounds = ends_a[from_a[1:] - 1]
    link_a, link_b = lockstep(ends_a, ends_b, bounds)
    pairs = a[link_a] << _SHIFT | b[link_b]
    # Groups one after another: the A tokens of a group, then its B tokens. Every link ends one.
    group_a, group_b = np.searchsorted(link_a, np.arange(len(a))), np.searchsorted(link_b, np.arange(len(b)))
    place_a = np.arange(len(a)) + np.concatenate([[0], link_b + 1])[group_a]
    place_b = np.arange(len(b)) + (link_a + 1)[group_b]
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[link_a], last_b[link_b] = True, True
    codes = np.empty(len(a) + len(b), np.int64)
    codes[place_a] = a + last_a * len(known.a.tokens)
    codes[place_b] = b + last_b * len(known.b.tokens) + len(known.a.shown)
    data, ends = _joined(_both(known), codes)
    text_ends = ends[from_a[1:] + from_b[1:] - 1]
    from_links = np.searchsorted(link_a, from_a)
    start = 0
    for k, (doc, end) in enumerate(zip(kept, text_ends.tolist(), strict=True)):
        own = pairs[from_links[k] : from_links[k + 1]]
        out[asked[doc]] = (counts_a[k], counts_b[k], len(own), hashlib.sha256(data[start : end - 1]).hexdigest(), own)
        start = end
    return out


@lru_cache(maxsize=2)
def _both(known: Tokenizers) -> pa.Array:
    return pa.concat_arrays([known.a.shown, known.b.shown])


_DOCUMENT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _rows(document: str) -> str:
    return f"block long, {document}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, pairs array<long>, times array<long>"


def links(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds. Every document: its counts, digest and links, as places in its block's pairs. Every block: its pairs and how often it has them.

    A block is about ``BLOCK`` bytes of text of one task, so both kinds have a bounded size but for a single longer document.
    """
    source = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = load(byte_level, pieces), TaskContext.get().partitionId() << 32
        ids, found, held, kind = [], [], 0, pa.int64()

        def rows() -> pa.RecordBatch:
            sizes = [len(x[4]) for x in found]
            pairs, at, times = np.unique(np.concatenate([np.zeros(0, np.int64), *[x[4] for x in found]]), return_inverse=True, return_counts=True)
            one, n = [None], len(found)
            some = [x for x in zip(*found, strict=True)] if found else [()] * 4
            lists = lambda values, kind, where: pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(values, kind))
            places = _offsets([*sizes, 0])
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * (n + 1), pa.int64()), pa.array(ids + one, kind), *[pa.array([*some[i], None], pa.int64()) for i in range(3)],
                 pa.array([*some[2], None], pa.int64()), pa.array([*some[3], None], pa.string()), lists(at, pa.int32(), places),
                 lists(pairs, pa.int64(), [0] * (n + 1) + [len(pairs)]), lists(times, pa.int64(), [0] * (n + 1) + [len(pairs)])],
                ["block", *_DOCUMENT, "links", "pairs", "times"],
            )

        for batch in batches:
            kind = batch.column("id").type
            names, part, size = [], [], 0
            texts = batch.column("text").to_pylist()
            for i, (name, text) in enumerate(zip(batch.column("id").to_pylist(), texts, strict=True)):
                names.append(name)
                part.append(text)
                size += len(text or "")
                if size > PART or i == len(texts) - 1:
                    ids += names
                    found += aligned(known, part)
                    held += size
                    names, part, size = [], [], 0
                if held > BLOCK:
                    yield rows()
                    block, ids, found, held = block + 1, [], [], 0
        if found:
            yield rows()

    return source.mapInArrow(run, _rows(f"doc_id {dict(source.dtypes)['id']}"))


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``n_groups`` counts the parts between byte offsets where tokens of both kinds end, and ``n_links`` the pairs of tokens that end there. A pair of ids counts
    as often as it is linked in all rows; ``n_best`` counts the links whose pair has the highest count of its B id (ties included), ``count_sum`` adds
    the counts of the links up. ``groups_sha256`` is the SHA-256 of ``a1,a2|b1;a3|b2,b3``, the ids group by group.

    A null or empty text, and one that either tokenizer changes so that its tokens do not give a space and the text, has no tokens: zeros and an empty digest.
    Repeated rows each get a row and each count. Other columns are not looked at; an empty table gives no rows.
    """
    rows = stage(links(docs, byte_level, pieces, id_col, text_col), "links")
    blocks = rows.where("pairs is not null and n_links is null").select("block", "pairs", "times")
    pairs = stage(blocks.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x")).select("block", "place", "x.pairs", "x.times"), "pairs")
    counts = pairs.groupBy("pairs").agg(F.sum("times").alias("count"))
    counts = stage(counts.withColumn("b", F.col("pairs").bitwiseAND((1 << _SHIFT) - 1)), "counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    judged = counts.join(most, "b").select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
    known = pairs.join(judged, "pairs").select("block", "place", "count", "best")
    kind = dict(rows.dtypes)["doc_id"]

    def judge(documents: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("place")
        count, best = known.column("count").to_numpy(), known.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
        lists = documents.column("links").combine_chunks()
        at, ends = lists.flatten().to_numpy(), _offsets(documents.column("n_links").to_numpy())
        summed = lambda values: np.diff(_offsets(values[at])[ends])
        return documents.select(_DOCUMENT).append_column("n_best", pa.array(summed(best))).append_column("count_sum", pa.array(summed(count)))

    documents = rows.where("n_links is not null").select("block", *_DOCUMENT, "links")
    done = documents.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        judge, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    )
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

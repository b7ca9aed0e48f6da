"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A text is parsed from left to right into the longest phrases that occur in
that language's sample; a byte the sample lacks is a phrase by itself. The number of phrases, times the logarithm of the sample's
size and over the text's length, estimates the cross entropy in bits a byte, and the language that needs the fewest wins.

Texts are lower-cased, and everything in ASCII but letters becomes single spaces. They are cut into segments of ``SEGMENT`` bytes, and a phrase ends where a
segment does, so that one numpy state vector parses all segments of a batch against all languages at once, however long a text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: What is learned from: so many languages (those with the most texts), for each about so many to twice so many different texts, drawn by hash, so many
#: characters of each, and so many bytes in all.
LANGUAGES, TEXTS, PASSAGE, SAMPLE = 64, 100, 4_000, 80_000
#: Entries of all transition tables together (four bytes each); with many languages or letters, samples get shorter.
ENTRIES = 1 << 25
SEGMENT, PART = 1024, 1 << 21
UNKNOWN = "und"

_KEPT = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER, _ASCII_LETTER = regex.compile(r"\p{L}"), re.compile(rb"[a-z]")
_STARTS = np.int32(-(2**31))
_STATE = np.int32(2**31 - 1)


def plain(text: str | None) -> bytes:
    """Lower-case letters and single spaces, with a space at both ends; empty if there is no letter."""
    data = b" %b " % b" ".join((text or "").lower().encode("utf-8", "replace").translate(_KEPT).split())
    return data if _ASCII_LETTER.search(data) or _LETTER.search(text or "") else b""


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of every state of the smallest automaton of all substrings of ``data``; state 0 is the empty one."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at, last = last, new
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at < 0:
            continue
        then = moves[at][c]
        if length[then] > length[at] + 1:  # a longer way leads there: the shorter ones get a state of their own
            copy = len(moves)
            moves.append(dict(moves[then]))
            link.append(link[then])
            length.append(length[at] + 1)
            link[then] = copy
            while at >= 0 and moves[at].get(c) == then:
                moves[at][c] = copy
                at = link[at]
            then = copy
        link[new] = then
    return moves


@dataclass(frozen=True)
class Samples:
    """The labelled text of each language, by name in rising order."""

    of: tuple[tuple[str, bytes], ...]


class Parser:
    """The automata of all languages in one table: entry state + code is the next state, negative where a phrase starts."""

    def __init__(self, samples: Samples):
        used = sorted(set().union(*[set(data) for _, data in samples.of]))
        self.code = np.zeros(256, np.int64)  # 0: a byte that no sample has
        self.code[used] = np.arange(1, len(used) + 1)
        self.names, tables, roots, width = [name for name, _ in samples.of], [], [], len(used) + 1
        share = max(1, int(ENTRIES / (2 * width * max(1, len(samples.of)))))
        base, sizes = 0, []
        for _, data in samples.of:
            moves = suffix_automaton(data[:share])
            table = np.zeros((len(moves), width), np.int32)
            at = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
            table[at, self.code[[c for m in moves for c in m]]] = [to for m in moves for to in m.values()]
            first = (table[0] * width + base) | _STARTS
            table = np.where(table > 0, table * width + base, first)
            table[0] = first
            tables.append(table.ravel())
            roots.append(base)
            base += table.size
            sizes.append(len(data[:share]))
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int64)
        self.bits = np.log2(np.array(sizes, float) + 1)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """How many phrases each text is parsed into, by language."""
        lengths = np.array([len(t) for t in texts])
        segments = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), segments)
        starts = np.concatenate([[0], np.cumsum(lengths)])[owner]
        starts += SEGMENT * (np.arange(len(owner)) - np.concatenate([[0], np.cumsum(segments)])[owner])
        ends = np.minimum(starts + SEGMENT, np.cumsum(lengths)[owner])
        order = np.argsort(starts - ends, kind="stable")  # long segments first: those that go on are always the first ones
        starts, owner, size = starts[order], owner[order], (ends - starts)[order]
        codes = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        found = np.zeros(state.shape, np.int64)
        going = len(owner) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1)) if len(owner) else []
        for step, k in enumerate(going):
            to = self.table.take(state[:, :k] + codes[starts[:k] + step])
            found[:, :k] += to < 0
            np.bitwise_and(to, _STATE, out=state[:, :k])
        return np.array([np.bincount(owner, row, minlength=len(texts)) for row in found], float).reshape(len(self.names), len(texts)).T

    def entropies(self, texts: list[bytes]) -> np.ndarray:
        """Estimated bits a byte of each text by language."""
        return self.phrases(texts) * self.bits / np.maximum([len(t) for t in texts], 1)[:, None]


@lru_cache(maxsize=2)
def parser(samples: Samples) -> Parser:
    return Parser(samples)


def learn(docs: DataFrame, taught: Column, text_col: str = "text", lang_col: str = "lang") -> Samples:
    """Samples of the rows that ``taught``, a condition on the columns of ``docs``, allows, and that have a language and a letter.

    Texts are drawn by their hash, copies once. Each language's level of leading zero bits is chosen from sketches of how many different texts reach each
    level, so only about the drawn texts are shuffled, and no group holds more than those.
    """
    rows = pick(docs.where(taught), text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("level", F.lit(64) - F.length(F.bin("hash")))
    levels = rows.groupBy("lang", "level").agg(F.approx_count_distinct("hash").alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("level")))
    least = levels.withColumn("above", above).groupBy("lang").agg(F.sum("n").alias("n"), F.max(F.when(F.col("above") >= TEXTS, F.col("level"))).alias("least"))
    chosen = least.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not chosen:
        return Samples(())
    needed = F.element_at(F.create_map(*[F.lit(x) for r in chosen for x in (r["lang"], r["least"] or 0)]), F.col("lang"))
    drawn = rows.where(F.col("level") >= needed).groupBy("lang", "hash").agg(F.min(F.substring("text", 1, PASSAGE)).alias("text"))

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        sample = b"".join(map(plain, rows.sort_by("hash").column("text").to_pylist()))
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "sample": pa.array([sample[:SAMPLE]], pa.binary())})

    samples = drawn.groupBy("lang").applyInArrow(joined, "lang string, sample binary").collect()
    return Samples(tuple(sorted((r["lang"], bytes(r["sample"])) for r in samples)))


def languages(docs: DataFrame, samples: Samples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the language of fewest bits and the second one's share of the bits of both.

    Ties go to the name that sorts first. A text that is null or has no letter is ``UNKNOWN`` with score 0, and so is every text where nothing was
    learned; where one language was learned its score is 1. Repeated rows each get a row; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = parser(samples)
        for batch in batches:
            names, scores, part, held = [], [], [], 0

            def judge(texts: list[bytes]) -> None:
                bits = parse.entropies(texts)
                if not len(parse.names):
                    bits = np.ones((len(texts), 1))
                best = bits.argmin(axis=1)
                two = np.sort(bits, axis=1)[:, :2]
                share = two[:, 1] / two.sum(axis=1).clip(1e-300) if bits.shape[1] > 1 else np.ones(len(texts))
                known = [bool(t) and bool(parse.names) for t in texts]
                names.extend(parse.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True))
                scores.extend(np.where(known, share, 0.0))

            for text in batch.column("text").to_pylist():
                part.append(plain(text))
                held += len(part[-1])
                if held > PART:
                    judge(part)
                    part, held = [], 0
            judge(part)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    source = pick(docs, id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['id']}, lang_pred string, score double")

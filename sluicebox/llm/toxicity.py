"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the mean of hashed embeddings of the word and of its first letters, so inflected forms of a stem are
near each other. Filters over one, two and three words, the largest answer of each over the whole text, and one linear layer give the score.
Only the places of the largest answers carry gradients, so training is a forward pass and a few hundred updates for each text.

``SAMPLE`` bounds the labelled rows of each class that one task trains on; they are drawn by hash, from the languages in turn. Scores and thresholds
cover all rows. Thresholds are calibrated for each language on counts of all taught rows by score.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, stage

SAMPLE = 1500
BUCKETS, WIDTH, FILTERS = 1 << 16, 12, 12
SPANS = (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
LEVELS = 200
_SPACED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case runs of letters; everything beyond ASCII counts as letters."""
    return text.lower().encode("utf-8", "replace").translate(_SPACED).split() if text else []


def grams(word: bytes) -> list[int]:
    """Buckets of the word and of its prefixes."""
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(word[:n], n) % BUCKETS for n in PREFIXES)]


class ToxicityModel:
    """Word row 0 is padding; ``starts`` of a batch are the places of its texts in one sequence of words."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.embedding = draw.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)
        self.filters = [draw.normal(0, 0.3, (span, WIDTH, FILTERS)).astype(np.float32) for span in SPANS]
        self.bias = np.zeros(len(SPANS) * FILTERS, np.float32)
        self.out = draw.normal(0, 0.3, len(self.bias)).astype(np.float32)
        self.base = 0.0
        self.shift = 0.0

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """The answers of every filter's place to a word."""
        return np.hstack([vectors @ f[k] for f in self.filters for k in range(len(f))])

    @staticmethod
    def answers(projected: np.ndarray) -> np.ndarray:
        """Each filter's answer at each word, over it and the words after it; two padding words must end the sequence."""
        n, at, out = len(projected) - 2, 0, []
        for span in SPANS:
            total = projected[:n, at : at + FILTERS].copy()
            for k in range(1, span):
                total += projected[k : n + k, at + k * FILTERS : at + (k + 1) * FILTERS]
            at += span * FILTERS
            out.append(total)
        return np.hstack(out)

    def logits(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.bias, 0) @ self.out + self.base

    def train(self, texts: list[list[bytes]], labels: list[int], epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 5) -> None:
        known: dict[bytes, int] = {b"": 0}
        docs = [np.array([0, *(known.setdefault(w, len(known)) for w in t), 0, 0], np.int64) for t in texts]
        of = np.array([grams(w) for w in known], np.int64)
        y, draw = np.array(labels, float), np.random.default_rng(seed)
        seen = {id(p): np.full(p.shape, 1e-6, np.float32) for p in (self.embedding, *self.filters, self.bias, self.out)}
        base_seen = 1e-6

        def step(p: np.ndarray, rows, g: np.ndarray) -> None:
            s = seen[id(p)]
            s[rows] += g**2
            p[rows] -= rate * g / np.sqrt(s[rows])

        for _ in range(epochs):
            order = draw.permutation(len(docs))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                sequence = np.concatenate([docs[i] for i in chosen])
                starts = np.concatenate([[0], np.cumsum([len(docs[i]) for i in chosen])])
                unique, place = np.unique(sequence, return_inverse=True)
                vectors = self.embedding[of[unique]].mean(axis=1)
                vectors[unique == 0] = 0
                found = self.answers(self.projected(vectors)[place])
                top = np.array([a + found[a : b - 2].argmax(axis=0) for a, b in zip(starts[:-1], starts[1:], strict=True)])
                best = found[top, np.arange(found.shape[1])]
                hidden = np.maximum(best + self.bias, 0)
                wrong = (1 / (1 + np.exp(-(hidden @ self.out + self.base))) - y[chosen]).astype(np.float32) / len(chosen)
                back = wrong[:, None] * self.out * (hidden > 0)
                moved = np.zeros_like(vectors)
                for s, span in enumerate(SPANS):
                    part, where = back[:, s * FILTERS : (s + 1) * FILTERS], top[:, s * FILTERS : (s + 1) * FILTERS]
                    change = np.empty_like(self.filters[s])
                    for k in range(span):
                        w = place[where + k]
                        change[k] = np.einsum("nf,nfd->df", part, vectors[w])
                        np.add.at(moved, w.ravel(), (part[:, :, None] * self.filters[s][k].T).reshape(-1, WIDTH))
                    step(self.filters[s], slice(None), change)
                touched = np.flatnonzero(np.abs(moved).sum(axis=1) * (unique > 0))
                rows, inverse = np.unique(of[unique[touched]], return_inverse=True)
                change = np.zeros((len(rows), WIDTH), np.float32)
                np.add.at(change, inverse.ravel(), np.repeat(moved[touched] / of.shape[1], of.shape[1], axis=0))
                step(self.embedding, rows, change)
                step(self.bias, slice(None), back.sum(axis=0))
                step(self.out, slice(None), hidden.T @ wrong)
                base_seen += wrong.sum() ** 2
                self.base -= rate * wrong.sum() / np.sqrt(base_seen)


class Scorer:
    """Scores texts; remembers the projections of up to ``limit`` words."""

    def __init__(self, model: ToxicityModel, limit: int = 250_000):
        self.model, self.limit = model, limit
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[bytes, int] = {b"": 0}
        self.table = np.zeros((1 << 12, sum(SPANS) * FILTERS), np.float32)

    def _learn(self, new: list[bytes]) -> None:
        first = len(self.rows)
        while first + len(new) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        for w in new:
            self.rows[w] = len(self.rows)
        vectors = self.model.embedding[np.array([grams(w) for w in new], np.int64)].mean(axis=1)
        self.table[first : first + len(new)] = self.model.projected(vectors)

    def scores(self, texts: list[str | None], words_at_once: int = 40_000) -> np.ndarray:
        out: list[np.ndarray] = []
        part: list[list[bytes]] = []
        size = 0
        for text in texts:
            part.append(words(text))
            size += len(part[-1])
            if size >= words_at_once:
                out.append(self._some(part))
                part, size = [], 0
        out.append(self._some(part))
        return np.concatenate(out)

    def _some(self, texts: list[list[bytes]]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        if len(self.rows) > self.limit:
            self._forget()
        new = {w for t in texts for w in t if w not in self.rows}
        if new:
            self._learn(list(new))
        row = self.rows.__getitem__
        best = np.full((len(texts), len(SPANS) * FILTERS), -np.inf, np.float32)
        for i, t in enumerate(texts):
            sequence = np.zeros(len(t) + 3, np.int64)
            sequence[1:-2] = np.fromiter(map(row, t), np.int64, len(t))
            for at in range(0, len(t) + 1, 40_000):  # a very long text in parts that overlap by the widest filter
                found = self.model.answers(self.table[sequence[at : at + 40_002]])
                np.maximum(best[i], found.max(axis=0), out=best[i])
        return 1 / (1 + np.exp(-(self.model.logits(best).astype(float) + self.model.shift)))


def lowest_hashes(known: DataFrame, sample: int) -> DataFrame:
    """``known`` (id, label, lang) without rows that are certainly not among the ``sample`` lowest hashes of ids of their label and language.

    Rows are counted by the length in bits of their hash, 64 counts for each group, and the least length is taken below which there are
    ``sample`` rows. Each further bit doubles the rows, so about twice ``sample`` remain at most, and no group meets in one task.
    """
    order = F.xxhash64("id").bitwiseXOR(F.lit(-(2**63)))  # unsigned order of these bits is the order of the hashes
    sized = known.withColumn("bits", F.length(F.bin(F.shiftrightunsigned(order, 1))))
    below = F.sum("n").over(Window.partitionBy("label", "lang").orderBy("bits")) - F.col("n")
    counts = sized.groupBy("label", "lang", "bits").agg(F.count("*").alias("n"))
    limits = counts.withColumn("below", below).where(F.col("below") < sample).groupBy("label", "lang").agg(F.max("bits").alias("most"))
    limits = stage(limits.select(F.col("label").alias("of_label"), F.col("lang").alias("of_lang"), "most"), "limits")
    near = (F.col("label") == F.col("of_label")) & F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("bits") <= F.col("most"))
    return sized.join(limits, near).select(*known.columns)


def train_model(
    docs: DataFrame, labels: DataFrame, teach: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, lang_col: str = "lang"
) -> ToxicityModel:
    """Train in one task on at most ``sample`` labelled rows of each class; shares of the classes are put right after.

    Each class takes its rows from the languages in turn (a null one is a language too), within a language by a hash of their ids, so that a rare language is
    drawn as far as it goes. Without ``lang_col`` all rows are of one language. Only rows with a document are drawn.

    Languages only steer which rows teach. Before rows are ranked, ``lowest_hashes`` leaves about ``sample`` to twice as many of a class and language, however many it has.

    Of rows that share an id one text is taken, so the task holds at most ``2 * sample`` texts, as words: 16 bytes for each word beside the distinct
    words, so at most ``32 * sample`` bytes for each word of the longest text.
    """
    known = pick(labels, id=id_col, label=label_col).where(teach).where("label IN (0, 1)").distinct()
    lang = F.min(lang_col if lang_col in docs.columns else F.lit(None).cast("string")).alias("lang")
    known = stage(known.join(docs.groupBy(F.col(f"`{id_col}`").alias("id")).agg(lang), "id"), "taught")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    turn = F.row_number().over(Window.partitionBy("label", "lang").orderBy(F.xxhash64("id"), "id"))
    turns = lowest_hashes(known, sample).withColumn("turn", turn).where(F.col("turn") <= sample)
    drawn = [turns.where(F.col("label") == y).orderBy("turn", F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = stage(drawn[0].union(drawn[1]).select("id", "label"), "sample")
    texts = pick(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    odds = (counts.get(1, 0) + 1) / (counts.get(0, 0) + 1) * (min(counts.get(0, 0), sample) + 1) / (min(counts.get(1, 0), sample) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same: dict[bytes, bytes] = {}  # one object for each distinct word
        rows = sorted(((r["id"], [same.setdefault(w, w) for w in words(r["text"])], int(r["label"])) for b in batches for r in b.to_pylist()), key=lambda r: (r[0], r[2]))
        model = ToxicityModel()
        model.train([r[1] for r in rows], [r[2] for r in rows])
        model.shift = float(np.log(odds))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    trained = texts.repartition(1).mapInArrow(run, "model binary").first()
    if trained:
        return pickle.loads(trained["model"])
    model = ToxicityModel()  # nothing was taught: every score is one half
    model.out[:] = 0
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score) of every row, from its whole text, and the columns ``keep`` as they are; a null or empty text gets the score of no words."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # of fixed size: BUCKETS embeddings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shared.value))
        for batch in batches:
            kept = [batch.column(f"keep{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scorer.scores(batch.column("text").to_pylist())), *kept], ["doc_id", "score", *keep])

    source = pick(docs, id=id_col, text=text_col, **{f"keep{i}": c for i, c in enumerate(keep)})
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([f"doc_id {types['id']}", "score double", *(f"`{c}` {types[f'keep{i}']}" for i, c in enumerate(keep))]))


def language_thresholds(scored: DataFrame, fallback: float = 0.5) -> dict[str | None, float]:
    """The score from which a row of each language counts as toxic, from (lang, score, label) rows.

    The best F1 over all rows of the language, by counts in ``LEVELS`` levels of score; of equally good levels the one nearest to one half. Only levels
    that separate are taken: at least half of the language's rows from it on have label 1, and a larger share than of all its rows. A language
    without such a level gets ``fallback``.
    """
    level = F.least(F.floor(F.col("score") * LEVELS), F.lit(LEVELS - 1)).cast("int").alias("level")
    counts = scored.groupBy("lang", level).agg(F.sum(F.col("label").cast("long")).alias("bad"), F.count("*").alias("n")).collect()
    out = {}
    for lang in {r["lang"] for r in counts}:
        bad, n = np.zeros(LEVELS), np.zeros(LEVELS)
        for r in counts:
            if r["lang"] == lang:
                bad[r["level"]], n[r["level"]] = r["bad"], r["n"]
        hit, taken = bad[::-1].cumsum()[::-1], n[::-1].cumsum()[::-1]
        separates = (2 * hit >= taken) & (hit * n.sum() > bad.sum() * taken)
        f1 = np.where(separates, 2 * hit / np.maximum(taken + bad.sum(), 1), -1)
        best = np.flatnonzero(separates & (f1 >= f1.max() - 1e-12))
        out[lang] = float(best[np.argmin(np.abs(best / LEVELS - 0.5))] / LEVELS) if len(best) else fallback
    return out


def threshold_of(lang: Column, thresholds: dict[str | None, float], fallback: float = 0.5) -> Column:
    """The threshold of a row's language, ``fallback`` for one without labels."""
    limit = F.lit(fallback)
    for known, value in thresholds.items():
        limit = F.when(lang.eqNullSafe(F.lit(known)), F.lit(value)).otherwise(limit)
    return limit

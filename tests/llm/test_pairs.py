"""Near duplicates, fingerprints and neighbours against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebox.llm.components import components
from sluicebox.llm.fingerprint import as_text, containment, distinct_count, edited_likeness, fingerprint, merged, resemblance
from sluicebox.llm.minhash import Sketcher, near_duplicates
from sluicebox.llm.neighbours import nearest

from .conftest import LONG, TEXTS


def shingles(text):
    words = [w.lower() for w in (text or "").split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(docs):
    sets = {i: shingles(t) for i, t in docs}
    least = {i: i for i in sets}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                least[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def family(draw, start, size, length, changes):
    base = [f"w{draw.randrange(10**6)}" for _ in range(length)]
    for i in range(size):
        words = list(base)
        for _ in range(draw.choice(changes)):
            words[draw.randrange(length)] = f"x{draw.randrange(10**6)}"
        yield start + i, " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    """Families of copies around the limit, a passage that many texts share, short texts, exact copies."""
    draw = random.Random(5)
    docs = [*family(draw, 0, 150, 80, (0, 1, 2, 3, 4)), *family(draw, 1000, 60, 30, (0, 1)), *family(draw, 2000, 40, 400, (2, 9, 14))]
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(3000 + i, passage + " " + " ".join(f"q{draw.randrange(10**6)}" for _ in range(draw.choice((5, 20, 60))))) for i in range(60)]
    docs += [(4000 + i, t) for i, t in enumerate(["a b c", "a b c", "A  B c", "a b", "a", "", " "])]
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    want = classes(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    want.update({4005: (0, 4005), 4006: (0, 4006)})
    assert got == want
    kept = [r.doc_id for r in found.where("kept").collect()]
    assert sorted(kept) == sorted({c for _, c in want.values()})


def test_near_duplicates_of_odd_rows(odd, empty):
    found = near_duplicates(odd).collect()
    assert len(found) == len(TEXTS)
    by = lambda i: [(r.n_shingles, r.component_id, r.kept, r.n_links) for r in found if r.doc_id == i]
    assert by(10) == [(6, 7, False, 0)] and by(7) == [(6, 7, True, 0)] * 2
    assert by(2) == [(0, 2, True, 0)] and by(4) == [(0, 4, True, 0)] and by(6) == [(1, 6, True, 0)]
    assert by(5) == [(len(shingles(LONG)), 5, True, 0)]
    assert sorted(by(None), key=str) == [(0, None, True, 0), (6, 7, False, 0)]
    assert near_duplicates(empty).count() == 0


def test_bins_agree_as_often_as_sets_do():
    """The share of equal bins estimates resemblance, for sets larger and much smaller than the number of bins."""
    draw = np.random.default_rng(1)
    sketcher = Sketcher()
    for size in (8, 60, 3000):
        shares = []
        for _ in range(60):
            pool = draw.integers(0, 2**64, size * 5 // 4, dtype=np.uint64)
            a, b = np.unique(pool[: size]), np.unique(pool[size // 4 :])
            shares.append((sketcher.bins(a) == sketcher.bins(b)).mean())
        assert abs(np.mean(shares) - 0.6) < 0.05


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 30)] + [(29, 50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in [*range(1, 30), 50]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_functions(spark, draw):
    words = [f"v{draw.randrange(10**7)}" for _ in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint(F.col("a")).alias("x"), fingerprint(F.col("b")).alias("y"), "a", "b")
    both = row.select(
        resemblance(F.col("x"), F.col("y")).alias("r"), containment(F.col("x"), F.col("y")).alias("c"), distinct_count(F.col("x")).alias("n"),
        (merged(F.col("x"), F.col("y")) == fingerprint(F.concat_ws(" ", F.col("a"), F.slice(F.split("b", " "), 1997, 2004).cast("string")))).alias("m"),
    ).first()
    one, other = shingles(a), shingles(b)
    assert abs(both.r - len(one & other) / len(one | other)) < 0.15
    assert abs(both.c - len(one & other) / len(one)) < 0.2 and abs(both.n / len(one) - 1) < 0.3
    small = spark.createDataFrame([("a b c d e f", "b c d e f g", "")], "a string, b string, e string")
    s = small.select(*[fingerprint(F.col(c)).alias(c) for c in "abe"])
    r = s.select(resemblance(F.col("a"), F.col("b")), distinct_count(F.col("a")), resemblance(F.col("e"), F.col("e")), resemblance(F.col("a"), F.col("e")), as_text(F.col("e"))).first()
    assert list(r) == [1 / 3, 2.0, 1.0, 0.0, ""]


def test_edited_likeness(spark, odd, empty):
    draw = random.Random(9)
    docs = [(i * 7 % 97, " ".join(f"v{draw.randrange(500)}" for _ in range(draw.choice((0, 1, 5, 80))))) for i in range(40)]
    got = {r.doc_id: r for r in edited_likeness(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    ordered = sorted(docs, reverse=True)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert (got[i].n_chars, got[i].edited) == (len(text), edited)
        assert math.isclose(got[i].near_edited, likeness(shingles(text), shingles(edited))), (text, edited)
        assert math.isclose(got[i].near_next, likeness(shingles(text), shingles(after)))
    rows = edited_likeness(odd).collect()
    assert len(rows) == len(TEXTS) and {r.n_chars for r in rows if r.doc_id in (2, 3)} == {0}
    assert len({tuple(r.prints) for r in rows if r.n_chars == len(TEXTS[0][1])}) == 1
    assert edited_likeness(empty).count() == 0


def test_neighbours_equal_brute_force(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(900, 16)).astype(np.float32)
    x[100:400] = x[100]  # ties
    x[500] = 0
    rows = [(i, [float(v) for v in x[i]], "e") for i in range(900)]
    rows += [(None, [1.0] * 16, "e"), (2000, None, "e"), (2100, [], "e"), (2200, [float("nan")] * 16, "e"), (2300, [None] * 16, "e"), (2400, [1.0, 2.0], "e"), (2500, [1.0, 2.5], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, place string")
    got: dict = {}
    for r in nearest(df.where("vec_id % 100 = 0"), df, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y, ids = x.astype(float), [i for i in range(900) if i != 500]
    for q in (0, 100, 200, 300, 400, 600, 700, 800):
        want = sorted((float(np.sqrt(np.add.accumulate((y[i] - y[q]) ** 2)[-1])), i) for i in ids if i != q)[:10]
        assert got.pop(q) == [(i, s) for s, i in want]
    assert got == {2400: [(2500, 0.5)], 2500: [(2400, 0.5)]}
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_edited_text_digest_is_of_utf8(spark):
    row = edited_likeness(spark.createDataFrame([(1, "äöü漢字x")], "doc_id long, text string")).select(F.sha2(F.col("edited").cast("binary"), 256).alias("h")).first()
    assert row.h == hashlib.sha256("äöü漢äö".encode()).hexdigest()


@pytest.mark.parametrize("name", ["op1_minhash", "op7_neighbours"])
def test_query_equals_sql(spark, name):
    from .sql import compare

    compare(spark, name)

"""Classifiers by held-out accuracy, and the pipeline by brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebox.llm.quality import RIDGE, STATISTICS, fit, isotonic, quality_scores
from sluicebox.llm.queries import QUERIES
from sluicebox.llm.toxicity import ToxicityModel, language_thresholds, lowest_hashes, toxicity_scores, train_model

from .conftest import TEXTS

SF = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    ones = np.array(labels) == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize("name, label, modulus, rest, least", [("op9_quality", "quality", 5, 0, 0.98), ("op3_toxicity", "toxic", 4, 2, 0.95)])
def test_held_out_accuracy(spark, name, label, modulus, rest, least):
    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert auc([r.score for r in held], [r[label] for r in held]) > least
    assert np.mean([r.predicted == r[label] for r in held]) > 0.95


def test_isotonic_levels():
    levels = isotonic(np.array([0, 3, 1, 0, 4]), np.array([4, 4, 4, 0, 4]))
    assert np.allclose(levels, [0, 0.5, 0.5, 0.75, 1]) and np.allclose(isotonic(np.zeros(3), np.zeros(3)), 0.5)


def test_scores_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2, 0) for i in range(12)] + [(None, 1, 1, 0), (3, None, None, 0), (99, 1, 1, 0)], "doc_id long, quality int, toxic int, label int")
    for teach in (F.lit(True), F.lit(False)):
        quality = quality_scores(odd, labels, teach).collect()
        model = train_model(odd, labels, teach)
        toxic = toxicity_scores(odd, model).collect()
        for rows in (quality, toxic):
            assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.doc_id in (7, 10)}) == 1
    assert quality_scores(empty, labels, F.lit(True)).count() == 0 and toxicity_scores(empty, model).count() == 0


def test_thresholds_are_of_each_language(spark):
    rows = [("a", i / 100, int(i >= 70)) for i in range(100)] + [("b", i / 100, int(i >= 20)) for i in range(100)] + [(None, 0.2, 0)]
    found = language_thresholds(spark.createDataFrame(rows, "lang string, score double, label int"))
    assert 0.68 < found["a"] <= 0.70 and 0.18 < found["b"] <= 0.20 and found[None] == 0.5


def test_thresholds_need_a_level_that_separates(spark):
    rows = [("missed", 0.001, 0)] * 500 + [("missed", 0.001, 1)] * 2 + [("low", 0.001, 0)] * 300 + [("low", 0.012, 0)] * 200 + [("low", 0.012, 1)] * 3
    rows += [("most", 0.001, 0)] * 2 + [("most", 0.001, 1)] * 5 + [(None, 0.001, 0)] * 9 + [(None, 0.001, 1), (None, 0.8, 1)]
    found = language_thresholds(spark.createDataFrame(rows, "lang string, score double, label int"))
    assert found["missed"] == found["low"] == found["most"] == 0.5 and 0.001 < found[None] <= 0.8


def test_every_language_is_drawn(spark):
    docs = spark.createDataFrame([(i, "rude" if i % 2 else "kind", "en") for i in range(400)] + [(i, "böse" if i % 2 else "lieb", None) for i in range(400, 420)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    scores = {r.doc_id: r.score for r in toxicity_scores(docs, train_model(docs, labels, F.lit(True), sample=20)).collect()}
    assert all((scores[i] > 0.5) == (i % 2 == 1) for i in range(420))


def test_query_decides_by_language(spark):
    small = "/root/testdata/sf0.01"
    rows = QUERIES["op3_toxicity"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id")
    labelled = rows.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    want = language_thresholds(labelled.where("NOT held_out AND toxic IN (0, 1)").select("lang", "score", F.col("toxic").alias("label")))
    got = rows.collect()
    assert {r.lang: r.threshold for r in got} == {r.lang: want.get(r.lang, 0.5) for r in got}
    assert all(r.calibrated == int(r.score >= r.threshold) for r in got)


def test_one_text_of_each_drawn_id(spark, monkeypatch):
    rows = [(1, f"rude {i}", "en") for i in range(3000)] + [(i, "kind", "en") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 12)] + [(1, 1)] * 5, "doc_id long, toxic int")
    sent, into_one = [], type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda df, *a: (sent.append(df.count()), into_one(df, *a))[1])
    model = train_model(docs, labels, F.lit(True))
    assert sent == [11] and model.shift == pytest.approx(0)


def test_a_language_whose_toxic_rows_are_missed_stays(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.createDataFrame(
        [(i, "filthy awful slurs" if i % 4 == 0 else "a pleasant plain day", "en") for i in range(200)] + [(i, "ein ganz normaler satz", "xx") for i in range(200, 300)],
        "doc_id long, text string, lang string",
    )
    docs.select("doc_id", F.when(F.col("lang") == "en", F.col("doc_id") % 4 == 0).otherwise(F.col("doc_id") < 202).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["lang"]: r["count"] for r in P.not_toxic(spark, docs, str(tmp_path)).groupBy("lang").count().collect()}
    assert kept == {"en": 150, "xx": 100}


def test_a_long_text_is_scored_whole():
    from sluicebox.llm.toxicity import Scorer

    model = ToxicityModel()
    model.train([["bad".encode()] * 3 + [b"x"] * 9, [b"x"] * 12] * 20, [1, 0] * 20)
    clean, late = "x " * 100_000, "x " * 99_999 + "bad bad bad"
    a, b = Scorer(model).scores([clean, late])
    assert a < 0.5 < b


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    small = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = docs.limit(3).union(docs.limit(3)).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.union(docs.limit(2)).union(extra)
    sizes, text, before = [], None, docs
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, before, small)
        out.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert after.columns == docs.columns, name
        if i < 3:
            assert after.exceptAll(before).count() == 0
        sizes.append(after.count())
        text, before = (before, after) if i == 4 else (text, after)
    assert docs.count() > sizes[0] > sizes[1] > sizes[2] == sizes[3] <= sizes[4]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = spark.read.parquet(f"{tmp_path}/0").join(labels, "doc_id")
    assert good.where("quality = 0").count() <= 3 and good.where("quality = 1").count() >= 335
    lengths = spark.read.parquet(f"{tmp_path}/4").groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert lengths.count() == text.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, empty, small).count() == 0, name


def test_the_lowest_hashes_remain(spark):
    known = spark.range(30_000).select("id", (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 9 > 0, F.lit("en")).alias("lang")).union(
        spark.createDataFrame([(-1, 1, "de"), (-2, 1, "de")], "id long, label int, lang string"))
    left = lowest_hashes(known, 50).withColumn("h", F.xxhash64("id")).collect()
    groups = {}
    for r in known.withColumn("h", F.xxhash64("id")).collect():
        groups.setdefault((r.label, r.lang), []).append((r.h, r.id))
    for group, rows in groups.items():
        kept = {(r.h, r.id) for r in left if (r.label, r.lang) == group}
        assert kept >= set(sorted(rows)[:50]) and len(kept) < 300, group
    assert lowest_hashes(known.limit(0), 50).count() == 0


def test_weights_solve_the_dense_normal_equations(spark):
    """The tree of partition sums against one matrix of all rows."""
    draw = np.random.default_rng(3)
    stats = draw.normal(size=(500, STATISTICS)).astype(np.float32)
    labels = (stats[:, 0] + stats[:, 1] > 0).astype(int)
    rows = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(stats, labels))], "doc_id long, stats array<float>, label int")
    model = fit(rows.repartition(150))
    taught = {r.doc_id for r in rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) != 0).collect()}
    at = np.array([i in taught for i in range(500)])
    x = stats[at].astype(float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, x.std(0))
    z = model.features(x)
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + RIDGE * len(z) * np.eye(z.shape[1]), z.T @ labels[at]), rtol=1e-6, atol=1e-9)



def test_whole_rows_meet_only_the_numbers_of_the_others(spark):
    import corpus_pipeline as P

    rows = P._with_row(spark.range(100))
    P._BEFORE.append(P.StagingScope(spark))
    kept = P._kept(spark, rows, lambda: rows.where("id % 10 <> 3").select("__row"))
    others = spark.read.parquet(P._BEFORE[-1].paths[-1])
    assert sorted(r["id"] for r in kept.collect()) == [i for i in range(100) if i % 10 != 3]
    assert others.columns == ["__row"] and others.count() == 10
    P._release(spark)

"""Language identification against a greedy parse by substring search, and held-out accuracy."""

import zlib

from pyspark.sql import functions as F

from sluicebox.llm import language
from sluicebox.llm.queries import QUERIES, taught

SF = "/root/testdata/sf0.01"


def greedy(data, sample):
    """The number of longest phrases, cut at segments."""
    found = 0
    for at in range(0, len(data), language.SEGMENT):
        rest = data[at : at + language.SEGMENT]
        while rest:
            size = 1
            while size < len(rest) and rest[: size + 1] in sample:
                size += 1
            rest, found = rest[size:], found + 1
    return found


def test_phrases_equal_a_greedy_parse(draw):
    samples = language.Samples((("x", b" abcab abba cabbage bag "), ("y", " él ñu où ça ".encode()), ("z", b"")))
    parse = language.Parser(samples)
    texts = [bytes(draw.choice(b"abcg \xc3\xa9z") for _ in range(draw.choice((0, 1, 7, 300, 1024, 1025, 2500)))) for _ in range(60)]
    want = [[greedy(t, s) for _, s in samples.of] for t in texts]
    assert parse.phrases(texts).astype(int).tolist() == want


def test_automaton_holds_all_substrings_and_no_more(draw):
    data = bytes(draw.choice(b"aab") for _ in range(60))
    moves = language.suffix_automaton(data)
    assert len(moves) < 2 * len(data)
    inside = {data[i:j] for i in range(60) for j in range(i, 61)}
    for _ in range(3000):
        word, state = bytes(draw.choice(b"aab") for _ in range(draw.randrange(9))), 0
        for c in word:
            state = moves[state].get(c) if state is not None else None
        assert (state is not None) == (word in inside)


def test_held_out_accuracy(spark):
    rows = QUERIES["op11_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) > 0.97 * len(held) > 100


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(taught(3, 1, "doc_id"), F.col("lang")).otherwise("xx"))
    assert language.learn(docs, taught(3, 1, "doc_id")) == language.learn(other, taught(3, 1, "doc_id"))


def test_odd_rows(odd, empty):
    docs = odd.withColumn("lang", F.when(F.col("doc_id") == 5, "xx").when(F.col("doc_id") > 5, "en"))
    samples = language.learn(docs, F.lit(True))
    assert [name for name, _ in samples.of] == ["en", "xx"]
    found = {(r.doc_id, r.lang_pred) for r in language.languages(docs, samples).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (5, "xx"), (10, "en"), (7, "en"), (None, "und"), (None, "en")} <= found
    assert language.languages(docs, samples).count() == docs.count()
    nothing = language.learn(docs.limit(0), F.lit(True))
    assert {(r.lang_pred, r.score) for r in language.languages(docs, nothing).collect()} == {("und", 0.0)}
    one = language.Samples((("en", b" plain text "),))
    assert {(r.lang_pred, r.score) for r in language.languages(docs, one).collect()} == {("und", 0.0), ("en", 1.0)}
    assert language.languages(empty, samples).count() == 0
    assert language.plain("12 — 3!") == b"" and language.plain("A1b  É漢") == " a b é漢 ".encode()


def test_copies_and_rare_languages_are_drawn(spark, monkeypatch):
    rows = [("same text", "en")] * 3000 + [(f"word{i} text", "en") for i in range(900)] + [("ein text", "de")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(7)
    found = dict(language.learn(docs, F.lit(True)).of)
    assert found["de"] == b" ein text " and found["en"].count(b"same") <= 1
    assert language.TEXTS * 0.8 <= found["en"].count(b"text") <= 2.5 * language.TEXTS

"""Document fingerprints: the smallest hashes of a text's shingles, as expressions only.

A fingerprint is the sorted array of the ``SIZE`` smallest distinct 64-bit hashes of the runs of five words between white space. A text of
fewer words is one run, and one without words has an empty fingerprint. Fingerprints of parts merge into that of all
runs of the parts. Resemblance, containment and the distinct count are exact while both fit, and estimates beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import POSITION, with_position
from .common import pick, stage

SIZE, WIDTH = 128, 5


def fingerprint(text: Column, size: int = SIZE, width: int = WIDTH) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def prints(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))
        runs = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(runs)), 1, size))

    # As the variable of a lambda the words are split once, however often they are named.
    return F.element_at(F.transform(F.array(words), prints), 1)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Share of the union that both have; 1 for two empty fingerprints."""
    both = F.size(F.array_intersect(F.array_intersect(a, b), merged(a, b, size)))
    of = F.least(F.size(F.array_union(a, b)), F.lit(size))
    return F.when(of == 0, F.lit(1.0)).otherwise(both / of)


def distinct_count(a: Column, size: int = SIZE) -> Column:
    """Number of distinct shingles: exact below ``size``, else (size - 1) over the largest hash as a share of all hashes."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Share of a's shingles that b has; 1 for an empty a."""
    union = distinct_count(merged(a, b, size), size)
    found = resemblance(a, b, size) * union / distinct_count(a, size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(found, F.lit(1.0)))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.concat_ws("", F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last third, floor(n_chars / 3) code points, replaced by as many (or all) from the start of the
    next document in descending order of id; after the last comes the first. A null text is empty. Rows of one id
    are ordered by a hash of their texts, null ids come last, and equal rows count once in the order and share a result;
    each still gives its row. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    # (key, hash) names a document without nulls, so that every join and the grouping below share one partitioning. The key is an expression in the
    # joins, so both need the same columns of the rows, and the texts are shuffled once.
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text.alias("text"), F.xxhash64(text, F.col("doc_id").isNull()).alias("hash"))
    key = F.coalesce("doc_id", F.lit(0))
    keys = rows.select("doc_id", "hash", F.char_length("text").alias("n_chars")).distinct()
    order = with_position(keys, [F.col("doc_id"), F.col("hash")], [False, False])
    order = stage(order.select(key.alias("key"), "hash", "n_chars", POSITION), "order")
    after = F.pmod(F.col(POSITION) + 1, F.lit(max(1, order.count())))
    # For each document as the next one: whose it is, and how many of its characters go there.
    takes = order.select(F.col("key").alias("to_key"), F.col("hash").alias("to_hash"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"), after.alias("at"))
    takes = order.join(takes, F.col(POSITION) == F.col("at")).select("key", F.col("hash").alias("own"), "to_key", "to_hash", "need")
    takes = stage(takes, "takes")
    given = rows.join(takes, (key == F.col("key")) & (F.col("hash") == F.col("own"))).select(
        "to_key", "to_hash", F.struct("need", F.substring("text", F.lit(1), F.col("need")).alias("start"), fingerprint(F.col("text")).alias("prints")).alias("next"),
    )
    given = given.groupBy("to_key", "to_hash").agg(F.any_value("next").alias("next"))
    joined = rows.join(given, (key == F.col("to_key")) & (F.col("hash") == F.col("to_hash"))).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("prints"),
        F.concat(F.substring("text", F.lit(1), F.char_length("text") - F.col("next.need")), F.col("next.start")).alias("edited"),
        F.col("next.prints").alias("next_prints"),
    ).withColumn("edited_prints", fingerprint(F.col("edited")))
    return joined.select(
        "doc_id", "n_chars", "edited", "prints", "edited_prints",
        resemblance(F.col("prints"), F.col("edited_prints")).alias("near_edited"), resemblance(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )

"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate links.

A set's one-permutation sketch is the smallest hash in each of 255 bins. An empty bin copies the bin that
comes first in its own fixed random order of all bins (optimal densification), so two sets agree in any bin
with a probability equal to their resemblance. 51 bands of five bins are the buckets: a pair of sets of more than a few dozen shingles at resemblance
0.75 shares none with a probability of about 1e-6. The bins of tiny sets depend on each other; of pairs of four and three shingles about 1 in 30,000 was seen lost.

In each bucket only the links of a centre, the member whose hash is smallest, to the other members are candidates, and they
are confirmed on the full sets. A bucket of copies of one text is then one component, however large it is. Where a bucket
still holds several components, its nodes outside the largest are tested against that one and each other in tiles, on the full sets, so that no
link is lost to the star shape; only confirmed links leave a tile.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, ascii_words, fold, pick, shingle_set, stage
from .components import components

BANDS, ROWS, WIDTH = 51, 5, 5
BINS = BANDS * ROWS
#: Shingles on either side of a tile.
TILE = 1 << 20
_STEP = 2**64 // BINS


class Sketcher:
    """The banded one-permutation sketch of a sorted set of hashes."""

    def __init__(self) -> None:
        self.edges = np.arange(BINS, dtype=np.uint64) * np.uint64(_STEP)
        self.order = np.random.default_rng(20_240_611).permuted(np.tile(np.arange(BINS, dtype=np.int16), (BINS, 1)), axis=1)

    def bins(self, hashes: np.ndarray) -> np.ndarray:
        first = np.searchsorted(hashes, self.edges)
        filled = first < np.append(first[1:], len(hashes))
        out = np.empty(BINS, np.uint64)
        out[filled] = hashes[first[filled]]
        empty, full = np.flatnonzero(~filled), np.flatnonzero(filled)
        if len(empty):
            out[empty] = out[full[np.argmin(self.order[np.ix_(empty, full)], axis=1)]]
        return out

    def bands(self, bins: np.ndarray) -> np.ndarray:
        """One bucket hash for each band of each row of ``bins``."""
        cut = bins.reshape(len(bins), BANDS, ROWS)
        return fold([np.broadcast_to(np.arange(BANDS, dtype=np.uint64), cut.shape[:2]), *[cut[:, :, i] for i in range(ROWS)]], 1)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, sketcher = WordHashes(), Sketcher()
    for batch in batches:
        sizes, digests, bins = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingle_set(ascii_words(text), hashes, WIDTH)
            sizes.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            if len(found):
                bins.append(sketcher.bins(found))
        rows = np.array([n > 0 for n in sizes], dtype=np.int64) * BANDS
        bands = sketcher.bands(np.array(bins)) if bins else np.empty((0, BANDS), np.uint64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(rows)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64)))],
            ["id", "n_shingles", "digest", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        found = [shingle_set(ascii_words(t), hashes, WIDTH).view(np.int64) for t in batch.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        values = np.concatenate(found) if found else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["node", "shingles"]
        )


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= share * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both, n = F.size(F.array_intersect("left", "right")), F.size("left") + F.size("right")
    sized = 100 * F.least(F.size("left"), F.size("right")) >= share * F.greatest(F.size("left"), F.size("right"))
    return pairs.join(left, "a").join(right, "b").where(sized).where((100 + share) * both >= share * n).select("a", "b")


def _tile(rows: pa.Table, share: int) -> Iterator[tuple[int, int]]:
    """Links of the outsiders to the members of one tile."""
    inside = rows.column("member").to_numpy(zero_copy_only=False)
    nodes, shingles = rows.column("node").to_pylist(), rows.column("shingles").combine_chunks()
    ends = shingles.offsets.to_numpy() - shingles.offsets[0].as_py()
    sizes, (_, codes) = np.diff(ends), np.unique(shingles.flatten().to_numpy(), return_inverse=True)
    members = np.flatnonzero(inside)
    own = np.concatenate([codes[ends[i] : ends[i + 1]] for i in members]) if len(members) else codes[:0]
    starts = np.concatenate([[0], np.cumsum(sizes[members])[:-1]]).astype(np.int64)
    mark = np.zeros(len(codes) + 1, np.int64)
    for i in np.flatnonzero(~inside) if len(own) else []:
        mark[codes[ends[i] : ends[i + 1]]] = 1
        both = np.add.reduceat(mark[own], starts)
        mark[codes[ends[i] : ends[i + 1]]] = 0
        for j in members[(100 + share) * both >= share * (sizes[i] + sizes[members])]:
            if nodes[i] != nodes[j]:
                yield nodes[i], nodes[j]


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The links between different components that meet in a bucket.

    Every node of a bucket outside its largest component is an outsider of that component. Outsiders of a component are tested against its
    nodes and against each other, which covers every pair of different components in the bucket with one row for each node in it.
    Both sides are cut by hash into parts of about ``TILE`` shingles, so a tile has a bounded size whatever the component's.
    """
    placed = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    counts = labels.groupBy("label").agg(F.count("*").alias("size"))
    placed = stage(placed.join(counts, "label", "left").select("bucket", "node", "label", F.coalesce("size", F.lit(1)).alias("size")), "placed")
    mixed = placed.groupBy("bucket").agg(F.max_by("label", "size").alias("target"), F.min("label").alias("x"), F.max("label").alias("y"))
    mixed = stage(mixed.where("x < y").select("bucket", "target"), "mixed")
    tests = stage(placed.join(mixed, "bucket").where("label <> target").select("node", F.col("target").alias("label")).distinct(), "tests")
    size = sets.select("node", F.size("shingles").cast("long").alias("n"))
    own = labels.union(placed.where("node = label").select("node", "label")).distinct().join(tests.select("label").distinct(), "label")
    nodes = stage(own.select("node", "label").union(tests.select("node", "label")).distinct().join(size, "node"), "nodes")
    weight = nodes.groupBy("label").agg(F.sum("n").alias("weight"))
    asked = tests.join(size, "node").groupBy("label").agg(F.sum("n").alias("asked"))
    cuts = weight.join(asked, "label").select("label", F.ceil(F.col("weight") / TILE).alias("parts"), F.ceil(F.col("asked") / TILE).alias("blocks"), "weight", "asked")
    cuts = stage(cuts, "cuts")
    total = cuts.agg(F.sum(F.col("weight") * F.col("blocks") + F.col("asked") * F.col("parts"))).first()[0] or 0
    groups = 1 + total // (2 * TILE)

    def dealt(rows: DataFrame, own: str, other: str, member: bool) -> DataFrame:
        cut = rows.withColumn(own[:-1], F.pmod(F.xxhash64("node"), F.col(own)))
        cut = cut.withColumn(other[:-1], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return cut.select("label", "part", "block", F.lit(member).alias("member"), "node")

    sides = dealt(nodes.select("node", "label").join(cuts, "label"), "parts", "blocks", True).union(
        dealt(tests.join(cuts, "label"), "blocks", "parts", False)
    )
    tile = F.xxhash64("label", "part", "block")
    sides = stage(sides, "sides").join(sets, "node").select(F.pmod(tile, F.lit(groups)).alias("group"), tile.alias("tile"), "member", "node", "shingles")

    def run(rows: pa.Table) -> pa.Table:
        found = []
        rows = rows.sort_by("tile")
        starts = np.flatnonzero(np.diff(rows.column("tile").to_numpy(), prepend=0)) if rows.num_rows else []
        for at, end in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            found += _tile(rows.slice(at, end - at), share)
        kind = rows.schema.field("node").type
        return pa.table({"a": pa.array([min(x) for x in found], kind), "b": pa.array([max(x) for x in found], kind)})

    kind = dict(sets.dtypes)["node"]
    return sides.groupBy("group").applyInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_links): the class of near copies of every row of ``docs``.

    Two documents are linked when 100 * |A & B| >= share * |A | B| over their sets of five-word shingles; a
    text of fewer words is one shingle. Texts that are null, empty or white space have no shingles and no
    links. ``component_id`` is the smallest id reachable by links, ``kept`` tells whether it is the row's own.
    ``n_links`` counts the confirmed links of the row's text to different texts.

    Repeated rows each get a row with the same result. Rows that share an id but not a text are classed by
    their texts. A null id never names a class: such a row takes the class of its text with kept = false, or
    has a null component_id and kept = true where no row with an id is near. Other columns are not looked at.
    """
    source = pick(docs, id=id_col, text=text_col)
    sketches = stage(source.mapInArrow(_sketches, f"id {dict(source.dtypes)['id']}, n_shingles long, digest binary, bands array<long>"), "sketches")
    classes = stage(sketches.where("digest is not null").groupBy("digest").agg(F.min("id").alias("node")).where("node is not null"), "classes")
    # One row of each class of equal sets stands for it; the key (digest, id) spreads a large class.
    members = sketches.join(classes.withColumn("id", F.col("node")), ["digest", "id"]).select("node", F.explode("bands").alias("bucket"))
    # By the node alone: the buckets of one group of near copies then mostly have the same centre, and its pairs collapse in the distinct below.
    drawn = F.min_by("node", F.xxhash64("node")).alias("centre")
    shared = members.groupBy("bucket").agg(drawn, F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("bucket", "centre")
    members = stage(members.join(stage(shared, "buckets"), "bucket").distinct(), "members")
    nodes = stage(members.select("node").distinct(), "nodes")
    texts = source.where("text is not null").join(nodes, F.col("id") == F.col("node"), "left_semi")
    sets = stage(texts.mapInArrow(_sets, f"node {dict(source.dtypes)['id']}, shingles array<long>"), "sets")
    pairs = members.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    links = stage(_confirmed(stage(pairs.distinct(), "pairs"), sets, share).distinct(), "links")
    more = stage(_across(members.select("bucket", "node"), components(links), sets, share).distinct(), "links")
    links = stage(links.union(more).distinct(), "links")
    labels = components(links)
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    named = stage(
        classes.join(labels, "node", "left").join(degree, "node", "left")
        .select("digest", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "named",
    )
    rows = sketches.select("id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("label", "id")
    return rows.select(
        F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )

"""CSV ingest with stable ids, exact source row numbers and an encoding ladder (SR-1, SR-2, SR-4..8)."""

from __future__ import annotations

import csv as pycsv
import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import TableError, invalid_file
from ..functions.numbers import infer_gold_text
from ..functions.text import is_blank
from ..session import stage
from ..table import ROW_NO, data_columns, with_display_names

# What runs in tasks is sent along whole: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BOM = "﻿"
_MARK = "\x02"

# The characters Windows-1252 puts where Latin-1 has control codes 0x80..0x9F, from the codec itself.
_LATIN_1 = "".join(chr(b) for b in range(0x80, 0xA0))
_WINDOWS_1252 = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")

# A quoted field still open at the end of a line that starts outside quotes.
_OPEN_QUOTE = r'^(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+,)*+"[^"]*+(?:""[^"]*+)*+$'
# A line that starts inside quotes and never leaves them; and what it takes to leave them.
_STAYS_INSIDE = r'^[^"]*+(?:""[^"]*+)*+$'
_LEAVES = r'^[^"]*+(?:""[^"]*+)*+"[^,]*+,?'


@dataclass(frozen=True)
class IngestLimits:
    """SR-6: None means no limit."""

    max_rows: int | None = None
    max_columns: int | None = None


def _windows_1252(raw: Column) -> Column:
    return F.translate(F.decode(raw, "ISO-8859-1"), _LATIN_1, _WINDOWS_1252)


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Every physical line (a carriage return stays on it) with file, split start and order within the task."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("value"),
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
    )


def _decoded(lines: DataFrame) -> DataFrame:
    """SR-2: UTF-8, and Windows-1252 for each file that is not valid UTF-8 throughout."""
    odd = lines.groupBy("__file").agg(F.bool_or(~F.is_valid_utf8("value")).alias("__odd")).where("__odd")
    odd = stage(odd, "csv-encodings")
    if odd.isEmpty():
        return lines
    # One row per odd file. A broadcast leaves the lines of a task in their order.
    marked = lines.join(F.broadcast(odd), "__file", "left")
    text = F.when(F.col("__odd"), _windows_1252(F.col("value").cast("binary"))).otherwise(F.col("value"))
    return marked.withColumn("value", text).drop("__odd")


def number_rows(placed: DataFrame, header_rows: int = 1) -> DataFrame:
    """SR-5: ``_row_no`` from (file, split start, order in task), dropping each file's header.

    One small row per split carries the start offset; no record is shuffled or sorted.
    Two levels of running sums (splits within a file, then files) keep every ordered group small.
    """
    splits = placed.groupBy("__file", "__start").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    in_file = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(in_file), F.lit(0)))
    files = splits.groupBy("__file").agg((F.sum("__n") - header_rows).alias("__rows"))
    # One row per input file.
    by_file = Window.partitionBy(F.lit(0)).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("__file", F.coalesce(F.sum("__rows").over(by_file), F.lit(0)).alias("__base"))
    offsets = splits.join(files, "__file").select("__file", "__start", "__first", "__before", "__base")
    # One row per split of the files.
    joined = placed.join(F.broadcast(offsets), ["__file", "__start"])
    place = F.col("__before") + F.col("__id") - F.col("__first")
    return joined.withColumn("__place", place).where(F.col("__place") >= header_rows).withColumn(
        ROW_NO, (F.col("__base") + F.col("__place") - header_rows).cast("bigint")
    ).drop("__place", "__file", "__start", "__first", "__before", "__base", "__id")


def _without_return(line: Column) -> Column:
    return F.regexp_replace(line, "\r$", "")


def _mapped(lines: DataFrame) -> DataFrame:
    """The lines with ``__o`` and ``__i``: whether a quoted field is open after a line that starts outside quotes, or inside."""
    line = _without_return(F.col("value"))
    quoted = F.col("value").contains('"')
    from_outside = (quoted & line.rlike(_OPEN_QUOTE)).cast("int")
    after = F.regexp_replace(line, _LEAVES, "")
    from_inside = F.when(~quoted | line.rlike(_STAYS_INSIDE), 1).otherwise(after.rlike(_OPEN_QUOTE).cast("int"))
    return lines.select("*", from_outside.alias("__o"), from_inside.alias("__i"))


def _splits(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """(file, split start), first row and end of every run of lines of one split. A task reads a split's lines in order."""
    rows = batch.num_rows
    if not rows:
        return
    ids = batch.column("__id").to_numpy()
    if (np.diff(ids) <= 0).any():
        raise ValueError("The lines of a task are out of order.")
    starts = batch.column("__start").to_numpy()
    cuts = {0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), *pc.run_end_encode(batch.column("__file")).run_ends.to_pylist()} - {rows}
    for first, end in pairwise([*sorted(cuts), rows]):
        yield (batch.column("__file")[first].as_py(), int(starts[first])), first, end


def _states(batch: pa.RecordBatch, first: int, end: int, enters: int) -> np.ndarray:
    """1 where a quoted field is open: before the first line, and after each.

    A line keeps the state, swaps it or fixes it: the state is the last fixed one, or the first, swapped once per swapping line since.
    """
    o, i = (batch.column(c).to_numpy()[first:end] for c in ("__o", "__i"))
    swaps = np.cumsum((o == 1) & (i == 0))
    fixed = np.maximum.accumulate(np.where(o == i, np.arange(len(o)), -1))
    after = np.where(fixed >= 0, o[fixed] + swaps - swaps[fixed], enters + swaps) % 2
    return np.concatenate([[enters], after])


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: whether a quoted field is open at its end, if none is at its start, and if one is."""
    ends: dict[tuple[str, int], tuple[int, int]] = {}
    for batch in batches:
        for split, first, end in _splits(batch):
            if split not in ends:
                yield from _end_rows(ends)
                ends = {split: (0, 1)}
            after = [int(_states(batch, first, end, s)[-1]) for s in (0, 1)]
            ends[split] = tuple(after[s] for s in ends[split])
    yield from _end_rows(ends)


def _end_rows(ends: dict[tuple[str, int], tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for (file, start), (outside, inside) in ends.items():
        yield pa.RecordBatch.from_pydict({"__file": [file], "__start": [start], "outside": [outside], "inside": [inside]})


def _entered(mapped: DataFrame) -> dict[tuple[str, int], int]:
    """Whether a quoted field is open where each split starts, from one small row per split."""
    rows = mapped.select("__file", "__start", "__id", "__o", "__i").mapInArrow(_split_ends, "__file string, __start bigint, outside bigint, inside bigint").collect()
    enters, file, state = {}, None, 0
    for r in sorted(rows, key=lambda r: (r["__file"], r["__start"])):
        if r["__file"] != file:
            if state:
                break
            file = r["__file"]
        enters[file, r["__start"]] = state
        state = r["inside"] if state else r["outside"]
    if state:
        raise invalid_file("A quoted field is never closed.")
    return enters


_WHOLE, _BEGUN, _CONTINUED = range(3)


def _cut(enters: dict[tuple[str, int], int]):
    """A function that joins the lines of every record within a split.

    ``__id`` is the place of a record among those that start in its split. ``__part`` tells records that are whole from a last one that goes on in a later
    split, and from the lines at the start of a split that go on with an earlier one.
    """

    def rows(values: pa.Array, split: tuple[str, int], ids: list[int] | np.ndarray, part: int) -> pa.RecordBatch:
        n = len(values)
        columns = [values.cast(pa.string()), pa.repeat(pa.scalar(split[0], pa.string()), n), pa.repeat(pa.scalar(split[1], pa.int64()), n), pa.array(ids, pa.int64()), pa.repeat(pa.scalar(part, pa.int32()), n)]
        return pa.RecordBatch.from_arrays(columns, ["value", "__file", "__start", "__id", "__part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, rank, head, held = None, 0, 0, -1, []  # held: the lines of the open record so far; head: its place, -1 if it started earlier

        def closed(part: int) -> pa.RecordBatch:
            text = pa.array(["\n".join(held)], pa.string())
            return rows(text, split, [head], part if head >= 0 else _CONTINUED)

        for batch in batches:
            for own, first, end in _splits(batch):
                if own != split:
                    if held:
                        yield closed(_BEGUN)
                    if own not in enters:
                        raise ValueError(f"The files are split in another way than when they were looked through: {own}")
                    split, state, rank, head, held = own, enters[own], 0, -1, []
                states = _states(batch, first, end, state)
                lines, heads = batch.column("value").slice(first, end - first), np.flatnonzero(states[:-1] == 0)
                state = int(states[-1])
                before = int(heads[0]) if len(heads) else len(lines)
                held += lines.slice(0, before).to_pylist()
                if held and (len(heads) or not state):
                    yield closed(_WHOLE)
                    held = []
                if not len(heads):
                    continue
                bounds = pa.array([*heads.tolist(), len(lines)], pa.int32())
                records = pc.binary_join(pa.ListArray.from_arrays(bounds, pa.concat_arrays([lines])), "\n")
                if state:
                    head, held = rank + len(heads) - 1, [records[-1].as_py()]
                    records = records.slice(0, len(records) - 1)
                yield rows(records, split, rank + np.arange(len(records)), _WHOLE)
                rank += len(heads)
        if held:
            yield closed(_BEGUN)

    return run


def _records(lines: DataFrame) -> DataFrame:
    """The records that start and end within a split, and the parts of those that do not, however the files are split.

    Whether a line starts inside quotes depends on all lines before it. A first pass over the lines finds, per split, the state at its end for either
    state at its start; one small row per split gives the states that splits start in. A second pass joins lines in the order in which a task reads
    them. No line is shuffled, sorted or written.
    """
    mapped = _mapped(lines)
    return mapped.mapInArrow(_cut(_entered(mapped)), "value string, __file string, __start bigint, __id bigint, __part int")


def _joined(parts: DataFrame) -> DataFrame:
    """The records that run over the ends of splits, from their parts: at most two of each split."""
    order = Window.partitionBy("__file").orderBy("__start", F.col("__part") == _BEGUN)
    head = F.last(F.when(F.col("__part") == _BEGUN, F.struct("__start", "__id")), ignorenulls=True)
    headed = parts.select("__file", "__start", "value", head.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__head"), (F.col("__part") != _BEGUN).alias("__later"))
    # A group is the parts of one record.
    texts = F.array_sort(F.collect_list(F.struct("__start", "__later", "value")))
    joined = headed.groupBy("__file", F.col("__head.__start").alias("h_start"), F.col("__head.__id").alias("h_id")).agg(texts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["value"]), "\n")
    return joined.select(text.alias("value"), "__file", F.col("h_start").alias("__start"), F.col("h_id").alias("__id"))


def _first_records(records: DataFrame) -> DataFrame:
    """The first record of each file: that with the smallest id of its first split.

    The ids are found first, one number per file; a minimum of texts would sort every record of the first splits.
    """
    begins = records.where("__start = 0")
    ids = begins.groupBy("__file").agg(F.min("__id").alias("__id"))
    return begins.join(F.broadcast(ids), ["__file", "__id"])


def _header(firsts: DataFrame) -> list[str]:
    """The headers, of the first records; every file must begin with the same ones."""
    firsts = firsts.select("__file", F.regexp_replace("value", f"^{_BOM}", "").alias("line"))
    found = firsts.groupBy("line").agg(F.min("__file").alias("file")).orderBy("file").limit(2).collect()
    if not found:
        raise TableError("empty_table", "The file holds no rows.")
    if len(found) > 1:
        raise invalid_file(f"The headers of {found[1]['file']} are not those of {found[0]['file']}.")
    return next(pycsv.reader([found[0]["line"]]), [""]) or [""]


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    limits: IngestLimits | None = None,
) -> DataFrame:
    """SR-1: comma-separated text, every cell text, first record the headers.

    Lines are read splittably and parsed with ``from_csv``, which keeps blank lines as rows.
    Lines of a record that runs over line ends are joined first, if there is any. Short rows
    are padded; a row longer than the header is an error. The parsed table is staged once, so
    row numbers rest on stored ids and every later pass reads columns.
    """
    lines = _decoded(_lines(spark, path))
    line = _without_return(F.col("value"))
    if not lines.where(_opens()).limit(1).count():
        # No line that starts outside quotes ends inside, so every line starts outside.
        records = lines.withColumn("value", line)
        headers = _header(_first_records(records))
        return _finish(stage(_parsed(records, headers), "csv"), headers, limits)
    with _splits_alike(spark):
        found = _records(lines)
        headers = _spanning_header(lines, found)
        # Written once: the cells of whole records, and the text of the few parts.
        text = F.when(F.col("__part") != _WHOLE, F.col("value"))
        ended = F.when(F.col("__part") == _WHOLE, line)
        staged = stage(_parsed(found.select(ended.alias("value"), text.alias("__text"), "__file", "__start", "__id", "__part"), headers, "__part", "__text"), "csv")
    parts = staged.where(F.col("__part") != _WHOLE).select(F.col("__text").alias("value"), "__file", "__start", "__id", "__part")
    joined = stage(_parsed(_joined(parts).withColumn("value", line), headers), "csv-spanning")
    return _finish(staged.where(F.col("__part") == _WHOLE).drop("__part", "__text").unionByName(joined), headers, limits)


@contextmanager
def _splits_alike(spark: SparkSession) -> Iterator[None]:
    """Every pass over the files splits them alike: the size of splits follows the number of cores, and executors may come or go meanwhile."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name)


def _opens() -> Column:
    """A line that starts outside quotes and ends inside."""
    return F.col("value").contains('"') & _without_return(F.col("value")).rlike(_OPEN_QUOTE)


def _spanning_header(lines: DataFrame, found: DataFrame) -> list[str]:
    """The headers, of the files' first lines; where one of these ends inside quotes, of their first records."""
    firsts = stage(_first_records(lines), "csv-headers")
    if not firsts.where(_opens()).limit(1).count():
        return _header(firsts.withColumn("value", _without_return(F.col("value"))))
    begun = stage(found.where(F.col("__part") != _WHOLE), "csv-begun")
    records = found.where(F.col("__part") == _WHOLE).drop("__part").unionByName(_joined(begun))
    return _header(_first_records(records.withColumn("value", _without_return(F.col("value")))))


def _parsed(records: DataFrame, headers: list[str], *more: str) -> DataFrame:
    """The cells of every record, whether it is longer than the header, and its place."""
    names = [f"column_{i + 1}" for i in range(len(headers))]
    schema = ", ".join(f"{n} string" for n in [*names, "__bad"])
    options = {
        "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1",
        "maxColumns": str(max(len(headers) + 1, 20480)),
    }
    parsed = records.select(F.from_csv("value", schema, options).alias("r"), "value", "__file", "__start", "__id", *more)
    # A record that the parser reports is parsed again with a mark as its last field: in a long one the mark is out of reach.
    marked = F.from_csv(F.concat("value", F.lit(f",{_MARK}")), schema, options)
    reached = F.exists(F.array(*[marked[n] for n in names]), lambda x: x.eqNullSafe(F.lit(_MARK)))
    return parsed.select(
        *[F.coalesce(F.col(f"r.{n}"), F.lit("")).alias(n) for n in names],
        F.when(F.col("r.__bad").isNotNull(), ~reached).otherwise(False).alias("__long"),
        "__file", "__start", "__id", *more,
    )


def _finish(staged: DataFrame, headers: list[str], limits: IngestLimits | None) -> DataFrame:
    if staged.where("__long").limit(1).count():
        raise invalid_file("A row has more fields than the header.")
    table = number_rows(staged.drop("__long"))
    names = [n for n in table.columns if n != ROW_NO]
    table = with_display_names(table, dict(zip(names, headers, strict=True)))
    check_table(table, limits or IngestLimits())
    return table


def check_table(df: DataFrame, limits: IngestLimits) -> None:
    """SR-6: refuse empty tables and tables over the limits."""
    names = data_columns(df)
    if not names:
        raise TableError("empty_table", "The table has no columns.")
    if limits.max_columns is not None and len(names) > limits.max_columns:
        raise TableError("table_too_large", f"More than {limits.max_columns} columns.")
    filled = F.lit(False)
    for c in names:
        filled = filled | ~is_blank(F.col(f"`{c}`"))
    if limits.max_rows is None:
        # Without a row limit the first populated row settles it.
        if not df.where(filled).limit(1).count():
            raise TableError("empty_table", "The table has no data rows.")
        return
    seen = df.agg(F.count("*").alias("rows"), F.coalesce(F.bool_or(filled), F.lit(False)).alias("filled")).first()
    if not seen["filled"]:
        raise TableError("empty_table", "The table has no data rows.")
    if seen["rows"] > limits.max_rows:
        raise TableError("table_too_large", f"More than {limits.max_rows} rows.")


def read_named_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SR-7: header names as Spark columns, all text, with source row numbers."""
    table = read_csv(spark, path)
    renamed = {c: table.schema[c].metadata["display_name"] for c in data_columns(table)}
    return table.withColumnsRenamed(renamed)


def read_gold_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SR-8: as SR-7, numbers inferred per cell; cells hold the text such a value prints as."""
    table = read_named_csv(spark, path)
    return table.select(*[infer_gold_text(F.col(f"`{c}`")).alias(c) for c in data_columns(table)], ROW_NO)

"""Writing tables out: plain CSV, the validated bundle, gated rule-pack export and publishing (SK-1..4)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError
from ..functions.text import render_cell
from ..operators.validate import Validation
from ..plans.rulepack import RulePack, grade, rollup, run_checks
from ..session import StagingScope, stage
from ..table import ROW_NO, data_columns, display_names, dtype_of

_BOM = "﻿"
_CSV = {
    "header": True, "emptyValue": "", "nullValue": "", "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "encoding": "UTF-8",
}


def export_frame(df: DataFrame, in_order: bool = True) -> DataFrame:
    """Cells rendered as text (FN-16) under display headers, a byte-order mark on the first one."""
    headers = list(display_names(df).values())
    if in_order and ROW_NO in df.columns:
        df = df.orderBy(ROW_NO)
    cells = df.select(*[render_cell(F.col(f"`{c}`"), dtype_of(df, c)).alias(c) for c in data_columns(df)])
    return cells.toDF(_BOM + headers[0], *headers[1:])


def write_csv(df: DataFrame, path: str, in_order: bool = True, mode: str = "errorifexists") -> str:
    """SK-1: a folder of CSV parts, each with the header line.

    ``in_order`` range-sorts by source row, so part files follow the table order.
    """
    export_frame(df, in_order).write.mode(mode).options(**_CSV).csv(path)
    return path


def write_validated_bundle(
    df: DataFrame, validation: Validation | None, audit: DataFrame, path: str, revision: int
) -> str:
    """SK-2: cleaned data, validation report and audit log side by side.

    Needs a validation of this very revision; one that failed is still delivered.
    """
    if validation is None or validation.revision != revision:
        raise TableError("validation_not_run", "Validate the current table before exporting it.")
    write_csv(df, f"{path}/cleaned")
    validation.rollup().coalesce(1).write.json(f"{path}/validation_report/summary")
    validation.checks().coalesce(1).write.json(f"{path}/validation_report/checks")
    audit.write.json(f"{path}/audit_log")
    return path


def export_pack(
    df: DataFrame, pack: RulePack, audit: DataFrame, root: str, score: float | None = None, destination: str | None = None,
    gold: DataFrame | None = None,
) -> str:
    """SK-3: cleaned table, quality report and audit log; only when every check passes.

    The report's quality index is ``score``, or that of the table against ``gold``, the rows it should have (CM-8).
    The table is JSON with nulls kept, and its schema lies beside it, since JSON has neither the order nor the types of columns.
    It is staged first, so that what made it runs once for the checks, the report and the file.
    """
    scope = StagingScope(df.sparkSession)
    with scope:
        df = stage(df, "to-export")
    checks = run_checks(df, pack).persist()
    try:
        outcome = rollup(checks).first()
        if not outcome["export_ready"]:
            raise TableError("validation_failed", "Every check must pass before export.")
        target = f"{root}/{destination or pack.export_destination}"
        if gold is not None:
            with scope:
                score = grade(df, gold, pack).first()["score"]
        write_export(df.drop(ROW_NO), target)
        report = df.sparkSession.createDataFrame(
            [(pack.name, pack.source_system, None if score is None else round(score, 6), outcome["validation_status"])],
            "rule_pack string, source_system string, quality_index double, validation_status string",
        )
        report.coalesce(1).write.json(f"{target}/quality_report")
        checks.coalesce(1).write.json(f"{target}/validation_checks")
        audit.write.json(f"{target}/audit_log")
    finally:
        checks.unpersist()
        scope.release()
    return target


def publish(spark, exported: str | None, table: str, mode: str = "errorifexists") -> None:
    """SK-4: promote an exported table to a catalog table; nothing exported, nothing published, nor an export that is not whole."""
    if not exported:
        raise TableError("not_exported", "Export the cleaned table before publishing it.")
    verify_export(spark, exported)
    read_export(spark, exported).write.mode(mode).saveAsTable(table)


def write_export(table: DataFrame, target: str) -> None:
    """The table as JSON, its schema, and at last a manifest of its rows and their digest, read off the files just written."""
    spark = table.sparkSession
    table.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{target}/cleaned")
    spark.createDataFrame([(table.schema.json(),)], "schema string").coalesce(1).write.text(f"{target}/cleaned_schema")
    _content(read_export(spark, target)).coalesce(1).write.json(f"{target}/manifest")


def _content(table: DataFrame) -> DataFrame:
    """Rows, and 128 bits that stand for them in any order: one row."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]), {"ignoreNullFields": "false"})
    digests = [F.coalesce(F.sum(F.xxhash64(F.lit(i), row).cast("decimal(20,0)")), F.lit(0)).cast("string").alias(f"digest_{i}") for i in (0, 1)]
    return table.agg(F.count("*").alias("rows"), *digests)


def verify_export(spark, exported: str) -> None:
    """Raise unless the export's manifest is there and its files hold what that says."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{exported}/manifest/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise TableError("export_incomplete", "The export was not finished: it has no manifest.")
    wanted = spark.read.schema("rows bigint, digest_0 string, digest_1 string").json(f"{exported}/manifest").first()
    if wanted != _content(read_export(spark, exported)).first():
        raise TableError("export_incomplete", "The files of the export are not those of its manifest.")


def read_export(spark, exported: str) -> DataFrame:
    """An exported table with the columns, order and types it was written with."""
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{exported}/cleaned_schema").first()["value"]))
    return spark.read.schema(schema).json(f"{exported}/cleaned")


def plan_json(actions) -> str:
    """The action list as text, to keep beside an export."""
    return json.dumps([a.to_dict() for a in actions], default=list)

"""Session settings the library expects, and the shared folder it may stage tables in."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import invalid_action

# Adaptive execution splits skewed join partitions and coalesces small ones;
# UTC keeps timestamps equal on every executor. HotSpot leaves methods over 8000 bytes
# uncompiled, so generated code beyond that is better split up than kept in one stage method.
# An aggregate that picks whole rows sorts those of its split: 32 MB of a Parquet file may hold millions of rows.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.files.maxPartitionBytes": "32m",
}


def configure_session(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    master: str = "local[*]",
    app_name: str = "sluicebox",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    # Call-site capture costs a JVM round trip per column expression.
    quiet = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in {**SETTINGS, **quiet, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where unset, one in the session's warehouse.

    The default warehouse is a folder of one machine. Tasks of a cluster would write there and read nothing elsewhere, so without a shared folder this raises
    unless the session runs in one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if root.split(":")[0] in ("file", "") or root.startswith("/"):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise invalid_action(f"Name a folder that all machines share in spark.checkpoint.dir; {root} is on one machine.")
    return root + "/_staged"


class StagingScope:
    """What is staged while the scope is open, of this thread; ``release`` deletes it, once the results that read it are written.

    Scopes nest: a path belongs to the innermost one. Outside of all scopes paths belong to the process, and ``release_staged`` deletes them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> StagingScope:
        _open_scopes().append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _open_scopes().remove(self)

    def release(self) -> int:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        released = 0
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            released += bool(path.getFileSystem(conf).delete(path, True))
        return released


_THREAD = threading.local()
_STAGED: list[str] = []


def _open_scopes() -> list[StagingScope]:
    if not hasattr(_THREAD, "scopes"):
        _THREAD.scopes = []
    return _THREAD.scopes


def staging_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, which belongs to the innermost open scope."""
    path = f"{staging_root(spark)}/sluicebox/{label}-{uuid.uuid4().hex}"
    (_open_scopes()[-1].paths if _open_scopes() else _STAGED).append(path)
    return path


def release_staged(spark: SparkSession) -> int:
    """Delete the tables this process has staged outside of scopes; call it once all results that read them are written out."""
    rest = StagingScope(spark)
    rest.paths = _STAGED
    return rest.release()


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage durably: partition numbers and ids computed before the write can
    never change again, and readers prune columns, which a binary checkpoint cannot.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

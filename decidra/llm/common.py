"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder; a cluster must name one, since its
    machines don't share local folders.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="decidra-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/decidra/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's setting that a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors.

    The shuffles that made it are deleted when it is written.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        if table is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def arrow_map(df: DataFrame, work, schema) -> DataFrame:
    """``mapInArrow`` in batches of at most 1,000 rows (texts are long), unless the session sets a smaller number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= 1000:
        df.sparkSession.conf.set(key, "1000")
    return df.mapInArrow(work, schema)


_held: dict[object, object] = {}


def held(owner, make):
    """What a Python worker keeps from task to task for ``owner``.  It keeps one owner's things: workers outlive stages,
    and the caches of all operators that they served would add up."""
    if owner not in _held:
        _held.clear()
        _held[owner] = make()
    return _held[owner]


def slices(batches, rows: int = 256, chars: int = 4_000_000, column: str = "text"):
    """Pieces of Arrow batches with at most ``rows`` rows or about ``chars`` bytes of text (one row at least)."""
    for batch in batches:
        n, start = batch.num_rows, 0
        while start < n:
            stop = min(n, start + rows)
            while stop - start > 1 and _bytes(batch, column, start, stop) > chars:
                stop = start + (stop - start) // 2
            yield batch.slice(start, stop - start)
            start = stop


def _bytes(batch, column: str, start: int, stop: int) -> int:
    from pyarrow import compute

    lengths = compute.sum(compute.binary_length(batch.column(column).slice(start, stop - start))).as_py()
    return lengths or 0

"""Plans that need more than one pass."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def positions(df: DataFrame, *order: str, name: str = "pos", buckets: int | None = None) -> DataFrame:
    """df with dense positions from 0 along order, without a window over all rows in one task.

    Rows are dealt to ranges of the order, sorted, and written once to the shared folder, a file per range: a row's place
    in its file and the rows of the files before it make its position. A second sample of the ranges, which might cut
    elsewhere, is never taken."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "positions")
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).option("compression", "zstd").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    files = rows.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.min(F.struct(*order)).alias("_low"), F.count("*").alias("_n"))
    # One row per range.
    before = files.selectExpr("_file", "coalesce(sum(_n) OVER (ORDER BY _low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_in"))
    return placed.join(F.broadcast(before), "_file").withColumn(name, F.col("_before") + F.col("_in")).drop("_file", "_in", "_before")


def chunk(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("long")


def bucket(pos: Column, total: int, n: int) -> Column:
    """The bucket of n whose first total % n hold one more, as ntile has it."""
    q, r = divmod(total, n)
    if q == 0:
        return pos
    return F.when(pos < r * (q + 1), F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - r * (q + 1)) / q)).cast("long")

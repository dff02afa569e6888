"""Continuous conversion: files that arrive in a folder are converted once each, those that fail are set aside."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Seconds without a new file after which a watch with auto_stop ends.
IDLE_SECONDS = 21600
_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, out: str, failed: str, checkpoint: str, convert: Callable[[SparkSession, str], DataFrame], pattern: str = "*", realtime: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Start a stream over files of folder (recursively). The checkpoint makes a restart go on where it stopped.

    Not realtime: takes what is there, then ends. A file name is converted once, wherever it lies. Only names are read
    by the stream; a failure is recorded in failed with its whole reason."""
    names = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")

    def put(batch: DataFrame, k: int) -> None:
        bad = []
        named = batch.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).groupBy("name").agg(F.min("path").alias("path"))
        if k:
            before = done(spark, checkpoint).where(~F.col("_metadata.file_path").contains(f"/batch={k}/"))  # this batch may run again
            named = named.join(before.select("name"), "name", "left_anti")
        good = []
        for row in named.orderBy("path").toLocalIterator():
            try:
                convert(spark, row.path).write.mode("overwrite").parquet(f"{out}/file={row.name}")
                good.append((row.name, row.path, None))
            except Exception as e:  # the file is set aside, the stream goes on
                bad.append((row.name, row.path, str(e)))
        kind = "name string, path string, reason string"
        if bad:
            spark.createDataFrame(bad, kind).write.mode("overwrite").parquet(f"{failed}/batch={k}")
        spark.createDataFrame(good + bad, kind).coalesce(1).write.mode("overwrite").parquet(f"{_taken(checkpoint)}/batch={k}")

    writer = names.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if realtime else writer.trigger(availableNow=True)).start()


def _taken(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-taken"


def done(spark: SparkSession, checkpoint: str) -> DataFrame:
    """name, path and reason (null if it was converted) of each file that a watch with this checkpoint has taken."""
    return spark.read.schema("name string, path string, reason string").option("recursiveFileLookup", "true").parquet(_taken(checkpoint))


def follow(query: StreamingQuery, idle: float = IDLE_SECONDS, files: int | None = None, poll: float = 1.0, finished: Callable[[], bool] | None = None) -> dict:
    """Wait for a realtime watch until no file came for idle seconds, after so many files, or once finished() holds; returns a report."""
    began = last = time.time()
    rows: dict[int, int] = {}
    while query.isActive:
        for p in query.recentProgress:
            if p["numInputRows"] and p["batchId"] not in rows:
                rows[p["batchId"]], last = p["numInputRows"], time.time()
        if time.time() - last >= idle or files is not None and sum(rows.values()) >= files or finished is not None and finished():
            query.processAllAvailable()
            query.stop()
        else:
            query.awaitTermination(poll)
    return {"files": sum(rows.values()), "batches": len(rows), "seconds": time.time() - began, "error": str(query.exception()) if query.exception() else None}


def runs_finished(spark: SparkSession, folder: str, minutes: float = 60) -> bool:
    """Whether every run of a sample's folder (folder/*/*/) has a final_summary*.txt that is older than so many minutes."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [x for x in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*/*")) or () if x.isDirectory()]
    old, n, it = (time.time() - 60 * minutes) * 1000, 0, store.listFiles(at, True)
    while it.hasNext():
        x = it.next()
        name = x.getPath().getName()
        n += name.startswith("final_summary") and name.endswith(".txt") and x.getModificationTime() <= old
    return n == len(runs)


def counted(spark: SparkSession, path: str, schema, key: str, checkpoint: str, out: str) -> DataFrame:
    """Counts per key of a folder or file of Parquet, by a stream that takes what is there."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
    counts = stream.groupBy(key).agg(F.count("*").alias("n"))

    def put(batch: DataFrame, k: int) -> None:
        batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/{k}")

    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return rows.groupBy(key).agg(F.max_by("n", "batch").alias("n"))

"""Exact dedup as stateful stream processing.

A streaming aggregation keyed by the digest of the text keeps, in a RocksDB state store on disk and
without watermark or expiry, one entry per digest: how many documents had it, the largest doc_id, and
where that document's content lies (file and row). Partial aggregation before the shuffle makes a
digest that a third of all rows share one small row per task. Each micro-batch writes the entries that
it changed; the newest entry of a digest is the registry.

A digest found more than once is a hit. Every hit is checked: the content at the registry's locator is
fetched by a join and compared byte for byte. Rows that have the digest but not the bytes are grouped
anew by their full text, so that even a weak digest gives right results. Only the texts of hits are
shuffled: the digests of hits are broadcast to the scan if their measured number is small, else joined.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id stays, of
repeated rows the last one by file and row; null doc_ids stay only where nothing else has the text; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, save

#: Files that one micro-batch takes; bytes of the digests of hits up to which they are broadcast.
FILES_PER_BATCH, BROADCAST_BYTES = 8, 16 << 20
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Space ahead of each store's log would be many times the state where partitions are many.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(source: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return source.select("doc_id", text.alias("text"), digest(text).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _folder_or_glob(spark: SparkSession, path: str) -> str:
    """A stream reads folders; a single file is given as a glob that fits it alone."""
    path = path.rstrip("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if fs.exists(at) and fs.getFileStatus(at).isFile() else path


def register(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH, state: str | None = None) -> DataFrame:
    """Stream all files under path that the state has not seen through it; returns digest, keep (doc_id, file, row) and n.

    state: folder of an earlier call to go on from; a fresh one if None."""
    state = state or fresh_path(spark, "exact-state")
    schema = spark.read.parquet(path).schema
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_folder_or_glob(spark, path))
        entries = _rows(stream, digest).groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))

        def put(changed: DataFrame, batch: int) -> None:
            changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{state}/entries/{batch:012d}")

        run = entries.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = "digest binary, keep struct<doc_id:bigint,file:string,row:bigint>, n bigint, batch int"
    entries = spark.read.schema(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{state}/entries")
    newest = entries.groupBy("digest").agg(F.max(F.struct("batch", "n", "keep")).alias("e"))
    return newest.select("digest", "e.keep", "e.n")


def dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of the parquet table at path."""
    source = spark.read.parquet(path)
    if source.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string")
    registry = register(spark, path, digest, files_per_batch)
    rows = _rows(source, digest)
    here = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    registry = save(registry, "exact-registry")
    hits = registry.where("n > 1")
    few = hits.count() * 256 <= BROADCAST_BYTES
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    found = rows.select("doc_id", "digest", sha, "file", "row").join(registry, "digest")
    alone = found.where("n = 1").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "n", here.alias("kept"), "sha")
    hit = rows.join(F.broadcast(hits) if few else hits, "digest").select("digest", "doc_id", F.col("keep.doc_id").alias("keep_id"), here.alias("kept"), "n", sha, "text")
    hit = save(hit, "exact-hits")
    content = hit.where("kept").select("digest", F.col("text").alias("content"))
    hit = hit.join(content, "digest", "left")
    same = F.col("text") == F.col("content")
    checked = save(hit.select("digest", "doc_id", "keep_id", "kept", "n", "sha", same.alias("same"), F.when(~same, F.col("text")).alias("text")), "exact-checked")
    out = ("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))
    alone, other = alone.select(*out), checked.where("not same")
    if other.isEmpty():
        return alone.unionByName(checked.select(*out))
    # Digests that several texts share: the others' groups, and what is left of the first one's.
    lost = other.groupBy("digest").agg(F.count("*").alias("lost"))
    first = checked.where("same").join(lost, "digest", "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).select(*out)
    other = other.withColumn("tag", F.monotonically_increasing_id())
    other = save(other, "exact-other")
    groups = other.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "tag")).alias("last"), F.count("*").alias("m"))
    again = other.join(groups, ["digest", "text"]).select("doc_id", F.col("last.doc_id").alias("keep_id"), F.col("m").alias("n"), (F.col("tag") == F.col("last.tag")).alias("kept"), "sha")
    return alone.unionByName(first).unionByName(again.select(*out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, f"{sf_dir}/documents.parquet")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

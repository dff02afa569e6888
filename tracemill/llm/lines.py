"""Line dedup over levelled sorted runs of line hashes, with DataFrame operations only.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; keys shorter
than min_chars code points are never touched. Documents arrive in batches. A batch counts its keys and is
anti-joined with the runs, one after the other: keys that no run holds are the batch's own run; the others
go to the repeats, with their further counts. So a key is in one run, once, with its first count. Runs are
bucketed and sorted by key, so a batch is dealt and sorted once, and runs are merged with it as they lie. Once
a level holds `fanout` runs they are compacted into one run of the next level. At the end the repeats are
summed and merge-joined with the runs; keys that nothing repeats are judged by their first count alone. Keys
in at least min_docs documents lose all their lines except those in the largest doc_id that holds them.

Keys are compared by their MD5 (128 bits); each line is hashed once, and decisions go back as line numbers. A
frequent line never meets its documents in one task for longer than a sum: counts are pre-aggregated before each
shuffle, and the join that hands decisions back is one that Spark can split by skew. Documents that lose nothing
are not shuffled if the decisions' measured size lets them be broadcast; beyond that all are.

Defined results: null or empty text is one empty line; repeated rows are one document (their doc_id
counts once) and lose the same lines; null doc_ids count as no document and never keep a frequent line
that another document holds; an empty table gives an empty result. All columns of the input are kept, whatever
their names; columns named n_lines and n_dropped are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, fresh_path, remove, save, table

#: Production parameters.
MIN_CHARS, MIN_DOCS, BATCHES, FANOUT, BROADCAST_BYTES = 40, 5, 4, 3, 32 << 20
#: Sorted files are read as sorted, where a bucket is one file.
SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    line = F.btrim(line, F.lit(ASCII_SPACE))
    # lower is fast, and right where all is ASCII.
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(ascii_lower(line))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


class LineRuns:
    """Levels of runs, each a table (key, n_docs, last_doc) that is bucketed and sorted by key, and the repeats of their keys."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.tables = spark, fanout, [[]], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.repeats: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(run) for level in self.levels for run in level]

    def _stored(self, rows: DataFrame) -> str:
        name = f"lines_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", fresh_path(self.spark, "lines-run")).saveAsTable(name)
        self.tables.append(name)
        return name

    def add(self, keys: DataFrame) -> None:
        """keys: (key, doc_id) of a batch; no document may be in two batches."""
        counted = keys.distinct().groupBy("key").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        batch = self.spark.table(self._stored(counted.repartition(self.buckets, "key")))
        own = batch
        for run in self.runs():
            own = own.hint("merge").join(run.select("key"), "key", "left_anti")
        if own is not batch:
            own = self.spark.table(self._stored(own))
            self.repeats.append(batch.hint("merge").join(own.select("key"), "key", "left_anti"))
            self._put(0, self.tables[-1])
        else:
            self._put(0, self.tables[-1])

    def _put(self, level: int, run: str) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = None
            for name in self.levels[level]:  # no key is in two runs
                rows = self.spark.table(name)
                merged = rows if merged is None else merged.unionAll(rows)
            self.levels[level] = []
            self._put(level + 1, self._stored(merged.repartition(self.buckets, "key")))

    def frequent(self, min_docs: int) -> DataFrame:
        """key, last_doc of the keys in at least min_docs documents."""
        more = None
        for rows in self.repeats:
            more = rows if more is None else more.unionAll(rows)
        if more is not None:
            more = save(more.groupBy("key").agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later")), "lines-repeats")
        out = None
        for run in self.runs():
            if more is not None:
                run = run.hint("merge").join(more, "key", "left")
                run = run.select("key", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))
            part = run.where(F.col("n_docs") >= min_docs).select("key", "last_doc")
            out = part if out is None else out.unionAll(part)
        return out

    def drop(self) -> None:
        """Forget all runs; what was taken from them must be written."""
        for name in self.tables:
            path = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first().data_type
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, path)
        self.levels, self.tables, self.repeats = [[]], [], []


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with text cut down, n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    # The input's columns travel in one, so that no name of theirs can clash.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    name = F.xxhash64("text").alias("name")
    path = fresh_path(spark, "lines-keys")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    found = rows.select("doc_id", name, batch, F.posexplode(lines_of(F.col("text"))).alias("at", "line")).where(F.char_length("line") >= min_chars)
    # As a generated column the key is computed once, whatever reads it.
    found = found.select("doc_id", "name", "batch", "at", F.explode(F.array(line_key(F.col("line")))).alias("key")).where(F.char_length("key") >= min_chars)
    found.select("doc_id", "name", "at", F.unhex(F.md5("key")).alias("key"), "batch").write.partitionBy("batch").option("compression", "zstd").parquet(path)
    keys = spark.read.schema("doc_id bigint, name bigint, at int, key binary, batch int").parquet(path)
    runs, before = LineRuns(spark, fanout), spark.conf.get(SORTED)
    spark.conf.set(SORTED, "true")
    try:
        for k in range(batches):
            runs.add(keys.where(F.col("batch") == k).select("key", "doc_id"))
        frequent = save(runs.frequent(min_docs), "lines-frequent")
    finally:
        spark.conf.set(SORTED, before)
        runs.drop()
    drops = keys.join(frequent, "key").where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).groupBy("doc_id", "name").agg(F.collect_set("at").alias("gone"))
    drops = save(drops.select(F.col("doc_id").alias("doc"), "name", "gone"), "lines-drops")
    remove(spark, path)
    few = (drops.agg(F.sum(F.size("gone") * 8 + 64)).first()[0] or 0) <= BROADCAST_BYTES
    rows = rows.withColumn("name", F.xxhash64("text"))
    rows = rows.join(F.broadcast(drops) if few else drops, rows["doc_id"].eqNullSafe(drops["doc"]) & (rows["name"] == drops["name"]), "left")
    lines = lines_of(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return rows.select(
        *[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The same rule; {docs} names the table of documents.
SQL_TEMPLATE = r"""
SELECT doc_id, text, n_lines, n_dropped, kept FROM (
WITH l AS (
  SELECT doc_id, text, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line, len(ls) AS n
  FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs})),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last_doc AS dropped
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, text, CAST(max(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS kept
FROM j GROUP BY doc_id, text)
"""
SQL = "SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM (" + SQL_TEMPLATE.format(docs="documents") + ")"

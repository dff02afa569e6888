"""The corpus pipeline: quality rules, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the
columns of documents. run() writes each stage's rows to the shared folder and reads them for the next.
Null texts count as empty and are rejected by the first stage; repeated rows stay repeated until the
third stage, which keeps one row per group of near copies (the smallest doc_id, nulls last). Rows are told apart
by all their columns: doc_ids can be null or repeated. Texts without words are copies of nothing; equal rows of
them stay once. An empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import lines, near, packing, quality
from tracemill.llm.common import row_digest, save


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go."""
    rows = docs.withColumn("_row", row_digest(docs))
    judged = quality.judge(rows.select("_row", "source", "text"))
    # Equal rows are judged alike, so rejection needs one row each.
    gone = judged.where("not kept").select("_row").distinct()
    return rows.join(gone, "_row", "left_anti").select(docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in one of them."""
    cut = lines.dedup_lines(docs).drop("n_lines", "n_dropped")
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the smallest doc_id, nulls last."""
    rows = docs.withColumn("_row", row_digest(docs))
    found = save(near.linked(rows.select("doc_id", "text", "_row"), key="_row"), "pipeline-linked")
    first = found.where("node != 0").groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_row"))["_row"].alias("_row"))
    stay = first.select("_row").union(found.where("node = 0").select("_row"))
    return rows.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", lines_stage),
    ("jaccard_join", near_stage),
    ("best_fit_packing", packing_stage),
]
#: Similarity groups and packing have no SQL form: the operators are tested against brute force, the pipeline on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

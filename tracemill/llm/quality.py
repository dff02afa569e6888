"""Quality rules on documents, and verdicts on their hosts.

Each text is measured once, in Arrow batches; the measures are written to the shared folder and are all
that later steps read. Base failures are summed per source (with partial aggregation, so a hot source is
one small row per task). A beta prior is fitted to the failure rates of all sources by the method of
moments, the rates are shrunk by it, and a source is rejected when its shrunk rate exceeds REJECT. The
verdicts are joined back to the documents. At the usual size of the verdicts' table the join is a
broadcast that Spark chooses from the measured size; beyond that it is a shuffle that can be split by skew.

Defined results: null text has no words and fails; null sources form one host; repeated rows count and
are returned as often as they occur; an empty table gives an empty result; texts are read whole; columns
of the input with the names of measures are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, save, table, tidy

#: Production parameters: words below, percent of repeated words above which a text fails; a host's limit.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, REJECT = 20, 30, 8, 0.6
_SYMBOLS = bytes(b"#*$%&|<>")
_NOT_SYMBOLS = bytes(x for x in range(256) if x not in _SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more. Windows are compared exactly: ranks of words are doubled up to ranks of windows."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        pair = rank[: len(rank) - step] * np.int64(len(words) + 1) + rank[step:]
        order = np.argsort(pair, kind="stable")
        new = np.empty(len(pair), np.int64)
        new[order] = np.cumsum(np.concatenate(([0], pair[order][1:] != pair[order][:-1])))
        rank, width = new, width + step
        if rank.max() == len(rank) - 1:
            return 0
    count = np.bincount(rank)
    hit = np.flatnonzero(count[rank] > 1)
    if not len(hit):
        return 0
    ends = np.zeros(len(words) + 1, np.int64)
    np.add.at(ends, hit, 1)
    np.add.at(ends, hit + window, -1)
    return int((np.cumsum(ends)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: splits at exactly the six ASCII white space characters
    chars = len(data.translate(None, _SPACE + _CONTINUED))
    symbols = len(data.translate(None, _NOT_SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def measured(docs: DataFrame) -> DataFrame:
    """docs without their text, with the measures and base_failed."""
    keep = [c for c in docs.columns if c not in (*MEASURES, "text", "base_failed", "kept")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*(measure(text.as_py()) for text in batch.column(0)))) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x, pa.int64()) for x in got)], names=[*keep, *MEASURES])

    rows = docs.select("text", *[F.col(f"`{c}`") for c in keep])
    rows = rows.toDF(*[f"c{k}" for k in range(len(keep) + 1)]).mapInArrow(tidy(work), schema)  # names with points would not do there
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, reject: float = REJECT) -> DataFrame:
    """source, n_docs, n_failed, shrunk_rate, host_ok.

    The prior: rates of sources have mean m and variance v (weighted by documents); with a mean size s, the beta's
    strength is m(1-m)/max(v - m(1-m)/s, tiny) - 1, held between 1 and 10,000."""
    hosts = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    sums = hosts.agg(
        F.sum("n_docs").cast("double").alias("n"), F.sum("n_failed").cast("double").alias("f"), F.count("*").cast("double").alias("h"),
        F.sum(F.col("n_docs") * rate * rate).alias("q"),
    )
    m = F.col("f") / F.col("n")
    noise = m * (1 - m) * F.col("h") / F.col("n")
    spread = F.greatest(F.col("q") / F.col("n") - m * m - noise, F.lit(1e-9))
    strength = F.least(F.greatest(m * (1 - m) / spread - 1, F.lit(1.0)), F.lit(10_000.0))
    prior = sums.select((m * strength).alias("a"), strength.alias("s"))
    shrunk = (F.col("n_failed") + F.col("a")) / (F.col("n_docs") + F.col("s"))
    # The prior is one row, whatever the data.
    return hosts.crossJoin(F.broadcast(prior)).select("source", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= reject).alias("host_ok"))


def judge(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """Per document, without its text: all other columns, the measures, base_failed, shrunk_rate, kept."""
    rows = save(measured(docs.drop("shrunk_rate", "host_ok")), "quality-measures")
    name = free("host", rows.columns)
    hosts = host_verdicts(rows, reject).select(F.col("source").alias(name), "shrunk_rate", "host_ok")
    rows = rows.join(hosts, rows["source"].eqNullSafe(hosts[name]), "left").drop(name)
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("host_ok")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return got.select("doc_id", *MEASURES, "base_failed", "kept")


SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w WHERE len(ws) >= {WINDOW})),
dup AS (SELECT id, i FROM (SELECT *, count(*) OVER (PARTITION BY id, g) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM dup) GROUP BY id),
ln AS (
  SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
m AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.id = rep.id LEFT JOIN ln ON w.id = ln.id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n_docs, sum(CAST(base_failed AS INT)) AS n_failed FROM b GROUP BY source),
s AS (
  SELECT CAST(sum(n_docs) AS DOUBLE) AS n, sum(n_failed) / CAST(sum(n_docs) AS DOUBLE) AS m, count(*) AS hosts,
    sum(n_docs * (n_failed / n_docs) * (n_failed / n_docs)) AS q FROM h),
p AS (SELECT m, least(greatest(m * (1 - m) / greatest(q / n - m * m - m * (1 - m) * hosts / n, 1e-9) - 1, 1.0), 10000.0) AS k FROM s),
v AS (SELECT source, (n_failed + m * k) / (n_docs + k) <= {REJECT} AS host_ok FROM h, p)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

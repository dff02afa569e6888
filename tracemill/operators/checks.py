"""Checks after a conversion: count parity, estimated counts, acceptance of lossy data. Each gives a row of figures with its verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SignalError


def parity(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_before, n_after and equal: the rows of each, counted where they lie."""
    n = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, df in enumerate((before, after))]
    return n[0].union(n[1]).agg(F.max(F.when(F.col("k") == 0, F.col("n"))).alias("n_before"), F.max(F.when(F.col("k") == 1, F.col("n"))).alias("n_after")).withColumn("equal", F.expr("n_before = n_after"))


def estimate(files: DataFrame, converted: DataFrame, least: int = 95, more_than: int = 20) -> DataFrame:
    """n_files, n_expected, n_found, percent and passed. files has n, the reads of a file or null where they were not counted.

    Every file is taken to be as long as the longest, so percent is a low estimate; it decides only if there are more than
    so many files. No reads expected are 100 percent."""
    expected = files.agg(F.count("*").alias("n_files"), F.coalesce(F.count("*") * F.max("n"), F.lit(0)).cast("long").alias("n_expected"))
    found = converted.agg(F.count("*").alias("n_found"))
    percent = F.expr("CASE WHEN n_expected = 0 THEN 100 ELSE n_found * 100 div n_expected END").cast("long")
    both = expected.join(found, how="cross").withColumn("percent", percent)  # one row each
    return both.withColumn("passed", (F.col("n_files") <= more_than) | (F.col("percent") >= least))


#: Fixed values of the acceptance of lossy data: the least mean and median of the identities, the largest loss of either, the
#: largest share of scores lost, and the most scores a read may have on average.
LEAST_MEAN, LEAST_MEDIAN, LARGEST_LOSS, LOST_SHARE, SCORES_A_READ = 0.93, 0.97, 0.001, 0.001, 1.2


def acceptance(original: DataFrame, lossy: DataFrame, n_reads: int, score: str = "identity") -> DataFrame:
    """mean, median and n of both, good_scores, good_pair and accepted. Null scores are not counted; without scores nothing is accepted."""
    if n_reads < 0:
        raise SignalError("a number of reads is not negative")

    def figures(df: DataFrame, name: str) -> DataFrame:
        s = F.col(score).cast("double")
        return df.agg(F.avg(s).alias(f"mean_{name}"), F.median(s).alias(f"median_{name}"), F.count(s).alias(f"n_{name}"))

    got = figures(original, "original").join(figures(lossy, "lossy"), how="cross")  # one row each
    alone = [f"mean_{k} >= {LEAST_MEAN} AND median_{k} >= {LEAST_MEDIAN} AND n_{k} >= {n_reads} AND n_{k} <= {SCORES_A_READ} * {n_reads}" for k in ("original", "lossy")]
    pair = [f"{k}_original - {k}_lossy <= {LARGEST_LOSS}" for k in ("mean", "median")] + [f"n_original - n_lossy BETWEEN 0 AND {LOST_SHARE} * n_original"]
    good = [F.coalesce(F.expr(" AND ".join(x)), F.lit(False)) for x in (alone, pair)]
    return got.withColumns({"good_scores": good[0], "good_pair": good[1]}).withColumn("accepted", F.expr("good_scores AND good_pair"))

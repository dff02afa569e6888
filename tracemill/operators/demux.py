"""Demultiplexing: records to the categories that an external table gives their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ReadSet, SignalError

ID, CATEGORY = "parent_read_id", "barcode_arrangement"


def codes_of(lookup: DataFrame, id_column: str = ID, category_column: str = CATEGORY) -> DataFrame:
    """The distinct pairs (read_id, category) of the table."""
    for c in (id_column, category_column):
        if c not in lookup.columns:
            raise SignalError(f"the table has no column {c}")
    pairs = lookup.select(F.col(id_column).alias("read_id"), F.col(category_column).alias("category"))
    return pairs.where("read_id IS NOT NULL AND category IS NOT NULL").distinct()


def extra(reads: ReadSet | DataFrame, lookup: DataFrame, id_column: str = ID, category_column: str = CATEGORY) -> DataFrame:
    """The distinct ids of the table that no record has."""
    df = reads.df if isinstance(reads, ReadSet) else reads
    return codes_of(lookup, id_column, category_column).select("read_id").distinct().join(df.select("read_id"), "read_id", "left_anti")


def demux(reads: ReadSet | DataFrame, lookup: DataFrame, id_column: str = ID, category_column: str = CATEGORY, multi: str | None = None, unmatched: str | None = None, on_extra: str = "exact") -> DataFrame:
    """Records with category, once for each distinct category of their id.

    multi: records of several categories go there once instead. unmatched: records without one go there, else they are
    dropped. Ids of the table that no record has are refused: exactly, by count alone (count_compat) or not (ignore)."""
    df = reads.df if isinstance(reads, ReadSet) else reads
    if "category" in df.columns:
        raise SignalError("the records have a column category already")
    codes = codes_of(lookup, id_column, category_column)
    names = [x for x in (multi, unmatched) if x is not None]
    if len(set(names)) < len(names):
        raise SignalError("two special categories of one name")
    if names and codes.where(F.col("category").isin(names)).take(1):
        raise SignalError("a special category has the name of another one")
    if on_extra == "exact" and (lost := extra(df, lookup, id_column, category_column).take(1)):
        raise SignalError(f"no record has id {lost[0].read_id}")
    if on_extra == "count_compat" and codes.select("read_id").distinct().count() > df.count():
        raise SignalError("the table has more ids than there are records")
    if multi is not None:
        codes = codes.groupBy("read_id").agg(F.when(F.count("*") > 1, multi).otherwise(F.min("category")).alias("category"))
    joined = df.join(codes, "read_id", "inner" if unmatched is None else "left")
    return joined if unmatched is None else joined.withColumn("category", F.coalesce("category", F.lit(unmatched)))

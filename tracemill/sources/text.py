"""Text files of reads: a header, then a tab-separated row per read. Parquet is the binary form.

The header (the lines before the first that does not start with # or @) is read on the driver, line by line
and no further; rows are split by Spark and stay in the JVM. Only columns that are asked for are parsed. Row order is data: rec_ord is (byte offset of the
split, number within it), which is ordered even where a file is read by many tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import NULL, PRIMARY, ReadSet, SignalError, aux_type

SUPPORTED_VERSIONS = ("0.1.0", "0.2.0", "1.0.0")


def list_files(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...]) -> list[str]:
    """Files with these suffixes under paths, folders recursively, sorted within each path."""
    out = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(at):
            raise SignalError(f"no such file: {path}")
        found, it = [], store.listFiles(at, True)
        while it.hasNext():
            found.append(it.next().getPath().toString())
        out += sorted(x for x in found if x.endswith(suffixes)) if store.getFileStatus(at).isDirectory() else found
    return out


def duplicate_names(spark: SparkSession, files: list[str]) -> list[str]:
    """File names that occur under more than one path."""
    seen: dict[str, int] = {}
    for f in files:
        name = f.rsplit("/", 1)[-1]
        seen[name] = seen.get(name, 0) + 1
    return sorted(k for k, n in seen.items() if n > 1)


def detect_format(path: str, said: str | None = None) -> str:
    """parquet by extension, else text; a stated format must agree."""
    found = "parquet" if path.rstrip("/").rsplit(".", 1)[-1] == "parquet" else "text"
    if said and said != found:
        raise SignalError(f"{path} is {found}, not {said}")
    return found


def parse_header(lines: list[str]) -> dict:
    """tag, version, header and aux from a file's lines that start with # or @."""
    if not lines or not (m := re.fullmatch(r"#(\w+)_version\t(\S+)", lines[0])):
        raise SignalError("no version line")
    if m[2] not in SUPPORTED_VERSIONS:
        raise SignalError(f"unsupported version {m[2]}")
    if len(lines) < 2 or not (n := re.fullmatch(r"#num_read_groups\t(\d+)", lines[1])):
        raise SignalError("no number of read groups")
    groups: list[dict] = [{} for _ in range(int(n[1]))]
    for line in (x for x in lines if x.startswith("@")):
        name, *values = line[1:].split("\t")
        if len(values) != len(groups):
            raise SignalError(f"attribute {name} has {len(values)} values for {len(groups)} read groups")
        for group, value in zip(groups, values):
            group[name] = None if value in ("", NULL) else value
    types, names = ([x for x in lines if x.startswith("#")] + ["", ""])[2:4]
    types, names = types[1:].split("\t"), names[1:].split("\t")
    if names[:8] != list(PRIMARY) or types[:8] != [t for t, _ in PRIMARY.values()] or len(types) != len(names):
        raise SignalError("columns are not the eight primary ones and auxiliary ones")
    return {"tag": m[1], "version": m[2], "header": groups, "aux": dict(zip(names[8:], types[8:]))}


def _value(cell: Column, kind: T.DataType) -> Column:
    cell = F.when(cell != NULL, cell)
    if isinstance(kind, T.ArrayType):
        return F.split(cell, ",").cast(kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(cell.cast(kind), F.lit(None).cast(kind))
    return cell.cast(kind)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The lines at the start of a file, or of a folder's first part, that start with # or @."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(at) and store.getFileStatus(at).isDirectory():
        parts = sorted(x.getPath().toString() for x in store.listStatus(at) if x.getPath().getName().startswith("part-"))
        if not parts:
            return []
        at = jvm.org.apache.hadoop.fs.Path(parts[0])
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(store.open(at), "UTF-8"))
    head = []
    try:
        while (line := reader.readLine()) is not None and line[:1] in ("#", "@"):
            head.append(line)
    finally:
        reader.close()
    return head


def read_text(spark: SparkSession, path: str, file_ord: int = 0, columns: list[str] | None = None) -> ReadSet:
    """One text file. columns: those to parse, all if None."""
    lines = spark.read.text(path)
    head = header_of(spark, path)
    got = parse_header(head)
    is_header = F.col("value").rlike("^[#@]") & F.col("value").isin(head)
    cells = F.split("value", "\t", -1)
    kinds = {**{k: t for k, (_, t) in PRIMARY.items()}, **{k: aux_type(t) for k, t in got["aux"].items()}}
    places = {k: i for i, k in enumerate(kinds)}
    chosen = columns or list(kinds)
    df = lines.where(~is_header & (F.col("value") != "")).select(
        F.lit(file_ord).alias("file_ord"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("rec_ord"),
        *[_value(cells[places[k]], kinds[k]).alias(k) for k in chosen],
    )
    return ReadSet(df, got["header"], got["aux"], got["version"], got["tag"], path)


def number(col: Column, precision: int = 6) -> Column:
    """A double without exponent, zeros at its end, or a point that nothing follows."""
    text = F.format_string(f"%.{precision}f", col.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def to_cell(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        text = F.array_join(col.cast("array<string>"), ",")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number(col)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(NULL))


def header_lines(reads: ReadSet) -> list[str]:
    names = sorted({k for g in reads.header for k in g})
    return [
        f"#{reads.tag}_version\t{reads.version}",
        f"#num_read_groups\t{len(reads.header)}",
        *["\t".join([f"@{k}", *[g.get(k) or NULL for g in reads.header]]) for k in names],
        "#" + "\t".join([*[t for t, _ in PRIMARY.values()], *reads.aux.values()]),
        "#" + "\t".join([*PRIMARY, *reads.aux]),
    ]


def text_lines(reads: ReadSet, *more: str) -> DataFrame:
    """file_ord, rec_ord, value: the rows as text, and more columns as they are."""
    kinds = {**{k: t for k, (_, t) in PRIMARY.items()}, **{k: aux_type(t) for k, t in reads.aux.items()}}
    return reads.df.select("file_ord", "rec_ord", *more, F.concat_ws("\t", *[to_cell(F.col(k), t) for k, t in kinds.items()]).alias("value"))


def write_text(reads: ReadSet, path: str) -> None:
    """A folder of parts in row order (range-sorted), the header in the first: concatenated they are one text file."""
    spark = reads.df.sparkSession
    # One row, so that the header is in one part.
    head = spark.createDataFrame([(-1, 0, None, "\n".join(header_lines(reads)))], "o int, h int, r struct<block:bigint,n:bigint>, value string")
    rows = text_lines(reads).select(F.col("file_ord").cast("int").alias("o"), F.lit(0).alias("h"), F.col("rec_ord").alias("r"), "value")
    head.unionByName(rows).orderBy("o", "h", "r").select("value").write.mode("errorifexists").text(path)


#: Codecs of the binary form.
CODECS = {"zlib": "gzip", "zstd": "zstd", "none": "uncompressed"}


def write_parquet(reads: ReadSet, path: str, codec: str = "zlib") -> None:
    if codec not in CODECS:
        raise SignalError(f"unknown codec {codec}")
    meta = json.dumps({"header": reads.header, "aux": reads.aux, "version": reads.version, "tag": reads.tag, "codec": codec})
    df = reads.df.withColumn("read_id", F.col("read_id").alias("read_id", metadata={"reads": meta}))
    df.write.mode("errorifexists").option("compression", CODECS[codec]).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> ReadSet:
    df = spark.read.parquet(path)
    got = json.loads(df.schema["read_id"].metadata["reads"])
    return ReadSet(df, got["header"], got["aux"], got["version"], got["tag"], path, "parquet", got.get("codec", "none"))


def open_reads(spark: SparkSession, path: str, said: str | None = None) -> ReadSet:
    """The set at a path, in the form that its name tells."""
    return read_parquet(spark, path) if detect_format(path, said) == "parquet" else read_text(spark, path)


def write_parts(reads: ReadSet, df: DataFrame, folder: str, by: str = "part", headers: list[list[dict]] | Callable[[Any], list[dict]] | None = None) -> None:
    """Text sets of the parts of df in one job: folder/by=value/, each a set as write_text makes it. headers: that of part k, also of an empty one; or by a part's value; else all have that of reads."""
    spark = reads.df.sparkSession
    kinds = df.schema[by].dataType
    if isinstance(headers, list):
        values = [(k, reads.with_(header=h)) for k, h in enumerate(headers)]
    else:
        values = [(r[0], reads.with_(header=headers(r[0])) if headers else reads) for r in df.select(by).distinct().collect()]  # a row per part that is written
    head = spark.createDataFrame([(v, -1, 0, None, "\n".join(header_lines(own))) for v, own in values], "p string, o int, h int, r string, value string")
    rows = text_lines(reads.with_(df=df), by).select(F.col(by).alias("p"), F.col("file_ord").cast("int").alias("o"), F.lit(0).alias("h"), F.col("rec_ord").alias("r"), "value")
    head = head.select(F.col("p").cast(kinds).alias("p"), "o", "h", F.lit(None).cast(df.schema["rec_ord"].dataType).alias("r"), "value")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_rows = head.unionByName(rows).repartitionByRange(n, "p", "o", "h", "r").sortWithinPartitions("p", "o", "h", "r")
    all_rows.select("value", F.col("p").alias(by)).write.mode("errorifexists").partitionBy(by).text(folder)


def stream_path(spark: SparkSession, path: str) -> str:
    """A stream reads folders; a single file is given as a glob that fits it alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    is_file = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return f"{path[:-1]}[{path[-1]}]" if is_file else path

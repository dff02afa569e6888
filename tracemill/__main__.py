"""The operators on the command line: python -m tracemill COMMAND ...

Inputs and outputs are sets as text (a file, or a folder of parts) or, with the extension parquet, in the binary form.
Outputs must not exist. Without -o, text goes to standard output.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .model import ORDER, SignalError
from .sources import text as source

SUFFIXES = (".sig", ".txt", ".tsv", ".parquet")


#: Log levels by verbosity.
LEVELS = ("OFF", "ERROR", "WARN", "INFO", "INFO", "DEBUG", "TRACE")


def _natural(text: str) -> int:
    n = int(text)
    if n < 1:
        raise ValueError(text)
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracemill", description=__doc__)
    top.add_argument("--version", action="version", version="1")
    top.add_argument("-t", "--threads", type=_natural, help="threads of a session that this starts on one machine")
    top.add_argument("-K", "--batch", type=_natural, help="rows of a batch between the JVM and Python")
    top.add_argument("-v", "--verbosity", type=int, choices=range(len(LEVELS)), help="log level, 0 for none")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, inputs: str = "+") -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("inputs", nargs=inputs)
        if "out" in flags:
            p.add_argument("-o", "--output")
            p.add_argument("-c", "--codec", choices=source.CODECS)
        if "lossless" in flags:
            p.add_argument("--lossless", choices=("true", "false"), default="true")
        return p

    command("view", "out", "lossless", inputs=1)
    p = command("get", "out", inputs=1)
    p.add_argument("ids", nargs="*")
    p.add_argument("-l", "--list", help="a file of ids, one a line")
    p.add_argument("--index", help="an index that the command index has written")
    p.add_argument("--skip", action="store_true", help="pass over unknown ids")
    p.add_argument("--benchmark", action="store_true", help="decode all, write nothing, and say how long it took")
    command("index", inputs=1).add_argument("-o", "--output", required=True)
    p = command("skim", inputs=1)
    p.add_argument("--hdr", action="store_true", help="the header alone")
    p.add_argument("--rid", action="store_true", help="the ids alone")
    p.add_argument("--strict", action="store_true", help="points for auxiliary columns of unknown names")
    command("stats", inputs="*")
    command("quickcheck", inputs=1)
    command("merge", "out", "lossless").add_argument("--allow", action="store_true")
    command("cat", "out")
    p = command("split")
    p.add_argument("-d", "--folder", required=True)
    how = p.add_mutually_exclusive_group(required=True)
    how.add_argument("-r", "--reads", type=int)
    how.add_argument("-f", "--files", type=int)
    how.add_argument("-g", "--groups", action="store_true")
    how.add_argument("--chain", type=int, help="by read group, and each group into parts of so many reads")
    how.add_argument("-x", "--table", help="a tab-separated table of ids and categories")
    p.add_argument("--id", default=ops.demux.__defaults__[0])
    p.add_argument("--category", default=ops.demux.__defaults__[1])
    p.add_argument("-u", "--multi", help="category of records that have several")
    p.add_argument("-m", "--unmatched", help="category of records that have none")
    p = command("degrade", "out", inputs=1)
    p.add_argument("-b", "--bits", default="auto")
    return top


def _lines(df: DataFrame) -> None:
    for row in df.toLocalIterator(prefetchPartitions=True):
        print(row[0])


def put(reads, args: argparse.Namespace) -> None:
    """Write a set where -o says. A codec is for the binary form only."""
    binary = bool(args.output) and source.detect_format(args.output) == "parquet"
    if args.codec and not binary:
        raise SignalError("a codec is for parquet outputs only")
    if binary:
        source.write_parquet(reads, args.output, args.codec or "zlib")
    elif args.output:
        source.write_text(reads, args.output)
    else:
        print("\n".join(source.header_lines(reads)))
        _lines(source.text_lines(reads).orderBy(*ORDER).select("value"))


def opened(spark: SparkSession, paths: list[str]) -> list:
    """The sets of files and folders; what cannot be read is passed over with a warning."""
    out = []
    for path in paths:
        at = [path] if path.endswith(SUFFIXES) or not _is_tree(spark, path) else source.list_files(spark, [path], SUFFIXES)
        for x in at:
            try:
                out.append(source.open_reads(spark, x))
            except Exception as e:  # one bad file does not stop the others
                print(f"{x} is passed over: {str(e).splitlines()[0]}", file=sys.stderr)
    if not out:
        raise SignalError("no input that can be read")
    return out


def _is_tree(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(at) and store.getFileStatus(at).isDirectory() and not any(x.getPath().getName().startswith("part-") for x in store.listStatus(at))


def split(spark: SparkSession, args: argparse.Namespace) -> None:
    """Each input on its own: folder/base/part=k/."""
    files = [x for path in args.inputs for x in (source.list_files(spark, [path], SUFFIXES) if _is_tree(spark, path) else [path])]
    bases = [x.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0] for x in files]
    if again := {b for b in bases if bases.count(b) > 1}:
        raise SignalError(f"several inputs are named {min(again)}")
    for path, base in zip(files, bases):
        reads, to = source.open_reads(spark, path), f"{args.folder.rstrip('/')}/{base}"
        if args.groups:
            source.write_parts(reads, ops.by_group(reads), to, headers=ops.group_headers(reads))
        elif args.chain is not None:
            heads = ops.group_headers(reads)
            parts = ops.split_chain(reads, args.chain).withColumn("part", F.concat_ws("_", "part_group", "part"))
            source.write_parts(reads, parts, to, headers=lambda part: heads[int(part.split("_")[0])])
        elif args.table:
            table = spark.read.option("sep", "\t").option("header", "true").csv(args.table)
            source.write_parts(reads, ops.demux(reads, table, args.id, args.category, args.multi, args.unmatched), to, "category")
        else:
            source.write_parts(reads, ops.split_files(reads, args.files) if args.reads is None else ops.split_reads(reads, args.reads), to)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "stats" and not args.inputs:
        print(f"engine version\t1\nspark version\t{spark.version}")
        return
    if args.command == "split":
        return split(spark, args)
    if args.command in ("merge", "cat"):
        sets = opened(spark, args.inputs)
        if args.command == "cat" and len({x.form for x in sets}) > 1:
            raise SignalError("inputs of differing forms")
        return put(ops.cat(sets) if args.command == "cat" else ops.merge(sets, args.lossless == "true", args.allow), args)
    path = args.inputs[0]
    if args.command == "quickcheck":
        if not ops.quickcheck(lambda: source.open_reads(spark, path)):
            raise SignalError(f"{path} is not whole")
        return
    if args.command == "skim" and args.hdr and args.rid:
        raise SignalError("--hdr and --rid exclude each other")
    reads = source.open_reads(spark, path)
    if args.command == "view":
        put(ops.view(reads, args.lossless == "true"), args)
    elif args.command == "get":
        ids = [*args.ids, *([r.value for r in spark.read.text(args.list).collect()] if args.list else [])]
        got = ops.get_indexed(reads, spark.read.parquet(args.index), ids, args.skip) if args.index else ops.get(reads, ids, args.skip)
        if args.benchmark:
            began = time.time()
            got.df.write.format("noop").mode("overwrite").save()
            print(f"seconds\t{time.time() - began:.3f}")
        else:
            put(got, args)
    elif args.command == "index":
        ops.index(reads).write.mode("errorifexists").parquet(args.output)
    elif args.command == "skim":
        if args.hdr:
            print("\n".join(source.header_lines(reads)))
        elif args.rid:
            _lines(ops.read_ids(reads).orderBy(*ORDER).select("read_id"))
        else:
            print("#" + "\t".join(reads.columns()))
            rows = ops.skim(reads, strict_compat=args.strict)
            kinds = {f.name: f.dataType for f in rows.schema if f.name not in ORDER}
            _lines(rows.orderBy(*ORDER).select(F.concat_ws("\t", *[source.to_cell(F.col(c), t) for c, t in kinds.items()])))
    elif args.command == "stats":
        print("\n".join(ops.stats_lines(reads)))
    elif args.command == "degrade":
        put(ops.degrade(reads, int(args.bits) if args.bits.isdigit() else args.bits), args)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder
        spark = (builder.master(f"local[{args.threads}]") if args.threads else builder).getOrCreate()
    if args.batch:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", args.batch)
    if args.verbosity is not None:
        spark.sparkContext.setLogLevel(LEVELS[args.verbosity])
    began = time.time()
    try:
        run(spark, args)
    except SignalError as e:
        print(f"{args.command}: {e}", file=sys.stderr)
        return 1
    print(f"{args.command} took {time.time() - began:.1f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

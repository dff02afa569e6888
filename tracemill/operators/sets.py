"""Operators on several sets of reads, and on parts of one: merge, cat, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ORDER, PRIMARY, HeaderMismatch, ReadSet, SignalError, aux_type, enum_labels
from ..plans import bucket, chunk, positions


#: Most read groups of which a row each is broadcast.
MAX_BROADCAST_GROUPS = 100_000


def merged_header(inputs: list[ReadSet], allow: bool = False) -> tuple[list[dict], list[list[int]]]:
    """The header of all runs in order of first sight, and each input's map from old to new read groups.

    Attributes on which groups of one run disagree, or that only some of them have, are emptied."""
    runs: dict[str, int] = {}
    header: list[dict] = []
    maps: list[list[int]] = []
    differ = False
    for reads in inputs:
        maps.append([])
        for group in reads.header:
            run = group.get("run_id")
            if not run:
                raise SignalError("a read group without run_id")
            if run not in runs:
                runs[run] = len(header)
                header.append(dict(group))
            else:
                mine = header[runs[run]]
                for name in {*mine, *group}:
                    if mine.get(name) != group.get(name):
                        mine[name], differ = None, True
            maps[-1].append(runs[run])
    if differ and not allow:
        raise HeaderMismatch("attributes of one run differ")
    return header, maps


def merged_aux(inputs: list[ReadSet]) -> dict[str, str]:
    """Enums in order of first sight, then the other columns by name; the first type of a column holds."""
    enums: dict[str, str] = {}
    rest: dict[str, str] = {}
    for reads in inputs:
        for name, kind in reads.aux.items():
            mine, other = (enums, rest) if enum_labels(kind) else (rest, enums)
            if name in other or mine.setdefault(name, kind) != kind and mine is enums:
                raise SignalError(f"column {name} has differing enums")
    return enums | dict(sorted(rest.items()))


def merge(inputs: list[ReadSet], lossless: bool = True, allow: bool = False) -> ReadSet:
    """All records of all inputs in order, repeats kept, with reconciled headers and columns."""
    if lossless and any(x.lossy for x in inputs):
        raise SignalError("an input has no auxiliary columns")
    header, maps = merged_header(inputs, allow)
    aux = merged_aux(inputs) if lossless else {}
    for reads in inputs:
        for c, t in reads.aux.items():
            if lossless and t != aux[c]:
                own, there = aux_type(t).simpleString(), aux_type(aux[c]).simpleString()
                back = F.expr(f"try_cast(try_cast(`{c}` AS {there}) AS {own})")
                if bad := reads.df.where(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(back)).select(c).take(1):
                    raise SignalError(f"column {c} is {t} and {aux[c]}, and {bad[0][0]!r} does not fit both")
    out: DataFrame | None = None
    for k, (reads, groups) in enumerate(zip(inputs, maps)):
        # The map is as long as the input's header.
        group = F.get(F.array(*map(F.lit, groups)), F.col("read_group").cast("int")).cast("long")
        cols = [group.alias("read_group") if c == "read_group" else F.col(c) for c in PRIMARY]
        cols += [(F.col(c) if c in reads.aux else F.lit(None)).cast(aux_type(t)).alias(c) for c, t in aux.items()]
        part = reads.df.select(F.lit(k).alias("file_ord"), "rec_ord", *cols)
        out = part if out is None else out.unionByName(part)
    return inputs[0].with_(df=out, header=header, aux=aux, path="")


def merge_every(inputs: list[ReadSet], n: int = 10, lossless: bool = True, allow: bool = False) -> list[ReadSet]:
    """One merged set for every n consecutive inputs; the last may be of fewer."""
    if n < 1:
        raise SignalError("a merged set needs an input")
    return [merge(inputs[k : k + n], lossless, allow) for k in range(0, len(inputs), n)]


def cat(inputs: list[ReadSet]) -> ReadSet:
    """All records of inputs whose headers and columns are the same."""
    first = inputs[0]
    for reads in inputs[1:]:
        for what in ("tag", "version", "header", "aux"):
            mine, other = getattr(first, what), getattr(reads, what)
            if mine != other or what == "aux" and list(mine) != list(other):
                raise HeaderMismatch(f"{what} of {reads.path or 'an input'} differs")
    out = first.df.withColumn("file_ord", F.lit(0))
    for k, reads in enumerate(inputs[1:], 1):
        out = out.unionByName(reads.df.withColumn("file_ord", F.lit(k)))
    return first.with_(df=out, path="")


def _one_group(reads: ReadSet) -> None:
    if len(reads.header) > 1:
        raise SignalError("split by read group first")


def split_reads(reads: ReadSet, n: int) -> DataFrame:
    """Records with part: consecutive chunks of n."""
    if n < 1:
        raise SignalError("a part needs a record")
    _one_group(reads)
    return positions(reads.df, *ORDER).withColumn("part", chunk(F.col("pos"), n))


def split_files(reads: ReadSet, n: int) -> DataFrame:
    """Records with part: n parts, the first ones a record longer if they cannot be equal."""
    if n < 1:
        raise SignalError("at least one part")
    _one_group(reads)
    return positions(reads.df, *ORDER).withColumn("part", bucket(F.col("pos"), reads.df.count(), n))


def by_group(reads: ReadSet) -> DataFrame:
    """Records with part, their read group, in one scan; read_group is 0 in each."""
    return reads.df.withColumn("part", F.col("read_group")).withColumn("read_group", F.lit(0).cast("long"))


def group_headers(reads: ReadSet) -> list[list[dict]]:
    """The header of each read group's part: every one keeps all attribute names."""
    if len(reads.header) < 2:
        raise SignalError("there is one read group only")
    names = {k for g in reads.header for k in g}
    return [[{n: g.get(n) for n in names}] for g in reads.header]


def split_chain(reads: ReadSet, n: int) -> DataFrame:
    """Records with part_group, their read group, and part: each group cut into consecutive chunks of n; read_group is 0.

    What splitting by group and then by reads gives, in one pass over all groups."""
    if n < 1:
        raise SignalError("a part needs a record")
    placed = positions(reads.df, "read_group", *ORDER)
    # One row per read group: they are numbered by the header.
    first = placed.groupBy("read_group").agg(F.min("pos").alias("_first"))
    whole = placed.join(F.broadcast(first), "read_group") if len(reads.header) <= MAX_BROADCAST_GROUPS else placed.join(first, "read_group")
    return whole.select(*[F.lit(0).cast("long").alias(c) if c == "read_group" else F.col(c) for c in reads.df.columns], F.col("read_group").alias("part_group"), chunk(F.col("pos") - F.col("_first"), n).alias("part"))


def split_groups(reads: ReadSet) -> list[ReadSet]:
    """A set per read group, also for one without records; every set keeps all attribute names and numbers its group 0."""
    parts = by_group(reads)
    return [reads.with_(df=parts.where(F.col("part") == k).drop("part"), header=head, path="") for k, head in enumerate(group_headers(reads))]

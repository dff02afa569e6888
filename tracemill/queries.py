"""The engine's queries over the driver's tables, each with SQL for the same rows.

Stand-ins: embeddings are reads with a signal, events reads with metadata, orders and lineitem records and
their lookup table, nation rows the attributes of headers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import enum_code, enum_label, quantise, window_of
from .model import ReadSet
from .operators import acceptance, by_group, cat, degrade, demux, estimate, extra, flatten, get, index, merge, merge_every, missing, parity, repeated, skim, split_chain, split_files, split_reads, stats, unflatten, view
from .operators.reads import PROFILES, profile
from .operators.sets import merged_header
from .plans import positions, shared_path
from .streaming import counted

LABELS = ["view", "click", "purchase", "signup", "error"]
_ENUM = ", ".join(f"'{x}'" for x in LABELS)
_SIG = "(select vec_id, label, list_transform(embedding, lambda x: cast(round(cast(x as double)*1000) as integer)) as sig from embeddings)"
IDS = [77, 3, 77, 9999, 123456]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def signals(spark: SparkSession, d: str) -> ReadSet:
    """embeddings as reads: the signal is the vector in thousandths."""
    sig = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int"))
    df = _t(spark, d, "embeddings").select(
        F.lit(0).alias("file_ord"), F.col("vec_id").alias("rec_ord"), F.col("vec_id").cast("string").alias("read_id"), F.col("label").cast("long").alias("read_group"),
        F.lit(8192.0).alias("digitisation"), F.lit(0.0).alias("offset"), F.lit(1.0).alias("range"), F.lit(5000.0).alias("sampling_rate"),
        F.size("embedding").cast("long").alias("len_raw_signal"), sig.alias("raw_signal"),
    )
    return ReadSet(df, [{"run_id": f"r{k}", "device_type": "minion"} for k in range(10)])


def records(spark: SparkSession, d: str) -> ReadSet:
    """events as reads without a signal, in one read group, with three auxiliary columns."""
    df = _t(spark, d, "events").select(
        F.lit(0).alias("file_ord"), F.col("event_id").alias("rec_ord"), F.col("event_id").cast("string").alias("read_id"), F.lit(0).cast("long").alias("read_group"),
        *[F.lit(1.0).alias(c) for c in ("digitisation", "offset", "range", "sampling_rate")], F.lit(0).cast("long").alias("len_raw_signal"), F.array().cast("array<smallint>").alias("raw_signal"),
        F.col("user_id").alias("channel"), F.col("value").alias("median_before"), "event_type",
    )
    return ReadSet(df, [{"run_id": "r"}], {"channel": "int64_t", "event_type": "char*", "median_before": "double"})


def _join(sig: str = "raw_signal") -> F.Column:
    return F.array_join(F.col(sig).cast("array<string>"), ",").alias("sig")


def view_signal(spark, d):
    return view(signals(spark, d)).df.select(F.col("rec_ord").alias("vec_id"), "read_group", "len_raw_signal", _join())


def skim_signals(spark, d):
    return skim(signals(spark, d)).select(F.col("rec_ord").alias("vec_id"), F.col("read_group").cast("int").alias("label"), "len_raw_signal", "raw_signal")


def skim_enum(spark, d):
    coded = _t(spark, d, "events").select("event_id", enum_code(F.col("event_type"), LABELS).cast("long").alias("code"))
    return coded.select("event_id", "code", enum_label(F.when(F.col("code") >= 0, F.col("code")), LABELS).alias("end_reason"))


def get_ordered(spark, d):
    got = get(records(spark, d), [str(x) for x in IDS], skip=True).df
    return got.select(F.col("file_ord").cast("long").alias("pos"), F.col("rec_ord").alias("event_id"), F.col("channel").alias("user_id"))


def get_missing(spark, d):
    return missing(records(spark, d), [str(x) for x in IDS]).select("pos", F.col("read_id").cast("long").alias("event_id"))


def index_unique(spark, d):
    return index(records(spark, d)).agg(F.count("*").alias("n"), F.countDistinct("read_id").alias("n_ids"))


def index_duplicates(spark, d):
    reads = ReadSet(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_id")), [{"run_id": "r"}])
    return repeated(reads).withColumnRenamed("read_id", "l_orderkey")


def stats_counts(spark, d):
    """Records and read groups by stats; samples are not among them. The header has a group per label there is."""
    reads = signals(spark, d)
    labels = sorted(r.read_group for r in reads.df.select("read_group").distinct().collect())  # a row per read group
    said = dict(stats(reads.with_(header=[{"run_id": f"r{k}"} for k in labels])))
    n = [F.lit(int(said[f"number of {x}"])).cast("long").alias(c) for x, c in (("records", "n_records"), ("read groups", "n_groups"))]
    return reads.df.agg(F.sum("len_raw_signal").alias("n_samples")).select(*n, "n_samples")


def _slice(reads: ReadSet, k: int, drop: str | None = None) -> ReadSet:
    aux = {c: t for c, t in reads.aux.items() if c != drop}
    return reads.with_(df=reads.df.where(F.col("rec_ord") % 3 == k).drop(*([drop] if drop else [])), aux=aux)


def merge_union(spark, d):
    reads = records(spark, d)
    got = merge([_slice(reads, 0), _slice(reads, 1, "median_before"), _slice(reads, 2, "event_type")]).df
    return got.agg(F.count("*").alias("n"), F.count("median_before").alias("n_value"), F.count("event_type").alias("n_type"), F.sum("channel").alias("channels"))


def merge_rg_map(spark, d):
    """Two files, each with a run per event type in order of first sight: merge maps the groups of both to its own."""
    reads = records(spark, d)
    middle = reads.df.agg(F.avg("rec_ord")).first()[0] or 0
    parts = []
    for own in (F.col("rec_ord") <= middle, F.col("rec_ord") > middle):
        part = reads.df.where(own)
        runs = [r.event_type for r in part.groupBy("event_type").agg(F.min("rec_ord").alias("p")).orderBy("p").collect()]  # a row per run
        parts.append(reads.with_(df=part.withColumn("read_group", enum_code(F.col("event_type"), runs).cast("long")), header=[{"run_id": x} for x in runs]))
    got = merge([p for p in parts if p.header] or [reads])
    return got.df.groupBy("event_type", "read_group").agg(F.count("*").alias("n"))


def merge_header(spark, d):
    """Two files, a run per nation: one attribute agrees, one differs, one is missing from the second file for odd keys."""
    rows = _t(spark, d, "nation").orderBy("n_nationkey").collect()  # the headers; 25 rows
    a = [{"run_id": str(r.n_nationkey), "same": r.n_name, "kit": r.n_name, "part": str(r.n_regionkey)} for r in rows]
    b = [{"run_id": str(r.n_nationkey), "same": r.n_name, "kit": r.n_name.lower(), **({"part": str(r.n_regionkey)} if r.n_nationkey % 2 == 0 else {})} for r in rows]
    header, _ = merged_header([ReadSet(None, a), ReadSet(None, b)], allow=True)
    return spark.createDataFrame([(int(g["run_id"]), k, v or "") for g in header for k, v in g.items() if k != "run_id"], "run bigint, attr string, value string")


def cat_union(spark, d):
    o = _t(spark, d, "orders").select(F.lit(0).alias("file_ord"), F.col("o_orderkey").alias("rec_ord"), "o_custkey", "o_totalprice")
    halves = [ReadSet(o.where(F.col("rec_ord") % 2 == k), [{"run_id": "r"}]) for k in (0, 1)]
    return cat(halves).df.groupBy(F.col("file_ord").cast("long").alias("file_ord")).agg(F.count("*").alias("n"), F.sum("rec_ord").alias("keys"))


def _parts(df: DataFrame) -> DataFrame:
    return df.groupBy("part").agg(F.count("*").alias("n"), F.min("rec_ord").alias("lo"), F.max("rec_ord").alias("hi"))


def split_by_reads(spark, d):
    return _parts(split_reads(records(spark, d), 4000))


def split_by_files(spark, d):
    return _parts(split_files(records(spark, d), 7))


def split_by_groups(spark, d):
    return by_group(signals(spark, d)).groupBy("part").agg(F.count("*").alias("n"), F.max("read_group").alias("read_group"))


def _orders(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"))


def _lookup(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_read_id"), F.col("l_returnflag").alias("barcode_arrangement"))


def _tally(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("n_reads"), F.sum("read_id").alias("key_sum"))


def demux_fanout(spark, d):
    return _tally(demux(_orders(spark, d), _lookup(spark, d), on_extra="ignore"))


def demux_uniq_missing(spark, d):
    return _tally(demux(_orders(spark, d), _lookup(spark, d), multi="mixed", unmatched="missing", on_extra="ignore"))


def demux_missing_docs(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("read_id"), "source")
    table = _t(spark, d, "labels").select(F.col("doc_id").alias("parent_read_id"), F.col("quality").cast("string").alias("barcode_arrangement"))
    got = demux(docs, table, unmatched="none", on_extra="ignore")
    return got.groupBy("source").agg(F.sum((F.col("category") == "none").cast("long")).alias("n_missing"))


def demux_extra(spark, d):
    return extra(_orders(spark, d), _lookup(spark, d)).agg(F.count("*").alias("n_extra"))


def degrade_b3(spark, d):
    return degrade(signals(spark, d), 3).df.select(F.col("rec_ord").alias("vec_id"), _join())


def degrade_b1(spark, d):
    return degrade(signals(spark, d), 1).df.select(F.col("rec_ord").alias("vec_id"), _join())


def degrade_profile(spark, d):
    """The first profile of each customer's device and frequency, whatever the kit: a header per pair and kit is matched."""
    kits = dict.fromkeys((p[2], p[3]) for p in PROFILES)
    rows = []
    for device in ("minion", "promethion", "p2_solo"):
        for hz in (4000, 5000):
            fit = [profile([{"device_type": device, "sequencing_kit": k, "experiment_type": e, "sample_frequency": str(hz)}]) for k, e in kits]
            best = min((PROFILES.index(p) for p in fit if p), default=None)
            rows.append((device, hz, PROFILES[best][0] if best is not None else "", PROFILES[best][6] if best is not None else 0))
    p = spark.createDataFrame(rows, "device string, hz int, name string, bits int")
    c = _t(spark, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("minion", "promethion", "p2_solo"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("device"), (4000 + F.col("c_custkey") % 2 * 1000).cast("int").alias("hz"))
    return c.join(F.broadcast(p), ["device", "hz"]).select("c_custkey", "name", "bits")  # six rows


def signal_stats(spark, d):
    c = F.col("n_chars")
    return _t(spark, d, "documents").agg(F.round(F.avg(c), 6).alias("mean"), F.median(c).alias("median"), F.round(F.stddev_samp(c), 6).alias("sd"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.sum(c).alias("total"))


def signal_slice(spark, d):
    return signals(spark, d).df.select(F.col("rec_ord").alias("vec_id"), F.array_join(window_of("raw_signal", 10, 20).cast("array<string>"), ",").alias("sig"))


def signal_explode(spark, d):
    x = signals(spark, d).df.select(F.col("read_group").cast("int").alias("label"), F.explode("raw_signal").alias("x"))
    return x.groupBy("label").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.col("x").cast("long")).alias("total"))


def signal_of_read(spark, d):
    s = signals(spark, d).df.where("read_id = '42'")
    return s.select(F.posexplode("raw_signal").alias("p", "x")).select(F.col("p").cast("long").alias("p"), "x")


def first_records(spark, d):
    return _t(spark, d, "events").orderBy("event_id").limit(10).select("event_id", "user_id", "event_type")


def count_by_channel(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))


def aux_stats(spark, d):
    return _t(spark, d, "events").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


def sample_hash(spark, d):
    return _t(spark, d, "events").orderBy((F.col("event_id") * 7919 + 13) % 10007, "event_id").limit(200).select("event_id")


def subset_ids(spark, d):
    ids = _t(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return _t(spark, d, "orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


def split_by_column(spark, d):
    """Skim as the lookup table of demux: any column can split."""
    o = _t(spark, d, "orders")
    table = o.select(F.col("o_orderkey").alias("parent_read_id"), F.col("o_orderpriority").alias("barcode_arrangement"))
    return _tally(demux(_orders(spark, d), table, on_extra="ignore"))


def corr_pair(spark, d):
    return _t(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("r"))


def lossy_acceptance(spark, d):
    """Means and counts of the signal before and after rounding, with the verdict."""
    reads = signals(spark, d)
    both = reads.df.select("read_id", "raw_signal").join(degrade(reads, 3).df.select("read_id", F.col("raw_signal").alias("lossy")), "read_id")
    pair = both.select(F.explode(F.arrays_zip("raw_signal", "lossy")).alias("z"))
    got = pair.agg(F.count("*").alias("n"), F.max(F.abs(F.col("z.raw_signal") - F.col("z.lossy"))).cast("int").alias("worst"), F.round(F.corr("z.raw_signal", "z.lossy"), 9).alias("r"))
    return got.withColumn("accepted", F.col("r") >= 0.97)


def _flat(events: DataFrame, kinds: list[str]) -> DataFrame:
    """user_id and a column per event type, by flatten: a user is a read, the largest value of an event type an attribute."""
    read = F.col("user_id").cast("string").alias("read")
    own = events.where(F.col("event_type").isin(kinds)).groupBy("user_id", F.col("event_type").alias("attr")).agg(F.max("value").cast("string").alias("value"))
    users = events.select("user_id").distinct()
    fields = F.explode(F.create_map(F.lit("read_id"), F.col("user_id").cast("string"), *[F.lit(x) for c in ("digitisation", "offset", "range", "sampling_rate") for x in (c, "1.0")])).alias("attr", "value")
    place = (F.lit("events").alias("file"), read, F.lit("Raw").alias("grp"))
    attrs = users.select(*place, "user_id", fields).drop("user_id").unionByName(own.where("value IS NOT NULL").select(*place, "attr", "value")).withColumn("h5type", F.lit("string"))
    signal = users.select(place[0], read, F.array().cast("array<smallint>").alias("raw_signal"))
    head = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(a).alias("attr"), F.lit(v).alias("value")) for g, a, v in (("context_tags", "sample_frequency", "4000"), ("tracking_id", "run_id", "r"))])).alias("h")
    attrs = attrs.unionByName(users.select(place[0], read, head).select("file", "read", "h.*", F.lit("string").alias("h5type")))
    got, _ = flatten(attrs, signal, dump_all=True)
    return got.select(F.col("read_id").cast(events.schema["user_id"].dataType).alias("user_id"), *[(F.col(k) if k in got.columns else F.lit(None)).cast("double").alias(k) for k in kinds])


def flatten_pivot(spark, d):
    """All users and all event types: a row per user."""
    return _flat(_t(spark, d, "events"), LABELS)


def unflatten_stack(spark, d):
    """A supplier is a read in a file of its own; its name and nation are the header's device and sample."""
    s = _t(spark, d, "supplier").withColumn("file", F.col("s_suppkey").cast("string"))
    names = {"device_id": "name", "sample_id": "nation"}
    header = s.select("file", F.explode(F.create_map(F.lit("device_id"), F.col("s_name"), F.lit("sample_id"), F.col("s_nationkey").cast("string"))).alias("attr", "value"))
    attrs, _ = unflatten(s.select("file", F.col("file").alias("read_id")), header)
    got = attrs.where("grp = 'tracking_id'").replace(names, subset=["attr"])
    return got.select(F.col("read").cast(s.schema["s_suppkey"].dataType).alias("s_suppkey"), "attr", "value")


def count_parity(spark, d):
    """Orders against the records of all parts that demux makes of them by status."""
    o = _t(spark, d, "orders")
    table = o.select(F.col("o_orderkey").alias("parent_read_id"), F.col("o_orderstatus").alias("barcode_arrangement"))
    got = parity(o, demux(_orders(spark, d), table))
    return got.select(F.col("n_before").alias("total"), F.col("n_after").alias("parts"), "equal")


def split_chained(spark, d):
    got = split_chain(signals(spark, d), 7)
    return got.groupBy("part_group", "part").agg(F.count("*").alias("n"), F.min("rec_ord").alias("lo"), F.max("rec_ord").alias("hi"), F.max("read_group").alias("read_group"))


def merge_batches(spark, d):
    """Five files of events, merged two by two."""
    reads = records(spark, d)
    sets = merge_every([reads.with_(df=reads.df.where(F.col("rec_ord") % 5 == k)) for k in range(5)], 2)
    out = None
    for k, x in enumerate(sets):
        part = x.df.select(F.lit(k).cast("long").alias("batch"), "file_ord", "rec_ord")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("file_ord").alias("files"), F.sum("rec_ord").alias("keys"))


def estimate_check(spark, d):
    """A nation is a file of customers."""
    c = _t(spark, d, "customer")
    return estimate(c.groupBy("c_nationkey").agg(F.count("*").alias("n")), c)


def acceptance_scores(spark, d):
    """Identities made of the tax of lines, and ones a little lower for the lossy reads."""
    x = _t(spark, d, "lineitem").select((1 - F.col("l_tax").cast("double") / 8).alias("identity"))
    got = acceptance(x, x.select((F.col("identity") - 0.0005).alias("identity")), x.count())
    return got.select(*[F.round(c, 6).alias(c) if c.startswith("me") else F.col(c) for c in got.columns])


def skim_strict(spark, d):
    got = skim(records(spark, d), strict_compat=True)
    return got.select(F.col("rec_ord").alias("event_id"), "raw_signal", "channel", "event_type", "median_before")


def positions_dense(spark, d):
    got = positions(_t(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    return got.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"))


def stream_count(spark, d):
    from .sources.text import stream_path

    at = shared_path(spark, "stream-count")
    path = f"{d}/events.parquet"
    return counted(spark, stream_path(spark, path), spark.read.parquet(path).schema, "event_type", f"{at}/checkpoint", f"{at}/out")


_PROFILE_VALUES = ", ".join(f"({i}, '{p[0]}', '{p[1]}', {p[4]}, {p[6]})" for i, p in enumerate(PROFILES))
_QUANTISED = "select vec_id, array_to_string(list_transform(sig, lambda x: least(((x+{h})>>{b})*{m}, {top})), ',') as sig from " + _SIG
_TALLY = "select {c} as category, cast(count(*) as bigint) as n_reads, cast(sum(o.o_orderkey) as bigint) as key_sum from "

QUERIES = {
    "view_signal": view_signal, "skim_signals": skim_signals, "skim_enum": skim_enum, "get_ordered": get_ordered, "get_missing": get_missing,
    "index_unique": index_unique, "index_duplicates": index_duplicates, "stats_counts": stats_counts, "merge_union": merge_union, "merge_rg_map": merge_rg_map,
    "merge_header": merge_header, "cat_union": cat_union, "split_reads": split_by_reads, "split_files": split_by_files, "split_groups": split_by_groups,
    "demux_fanout": demux_fanout, "demux_uniq_missing": demux_uniq_missing, "demux_missing_docs": demux_missing_docs, "demux_extra": demux_extra,
    "degrade_b3": degrade_b3, "degrade_b1": degrade_b1, "degrade_profile": degrade_profile, "signal_stats": signal_stats, "signal_slice": signal_slice,
    "signal_explode": signal_explode, "signal_of_read": signal_of_read, "first_records": first_records, "count_by_channel": count_by_channel, "aux_stats": aux_stats,
    "sample_hash": sample_hash, "subset_ids": subset_ids, "split_by_column": split_by_column, "corr_pair": corr_pair, "lossy_acceptance": lossy_acceptance,
    "flatten_pivot": flatten_pivot, "unflatten_stack": unflatten_stack, "count_parity": count_parity, "positions_dense": positions_dense, "stream_count": stream_count,
    "split_chain": split_chained, "merge_batches": merge_batches, "estimate_check": estimate_check, "acceptance_scores": acceptance_scores, "skim_strict": skim_strict,
}

SQL = {
    "view_signal": f"select vec_id, cast(label as bigint) as read_group, cast(len(sig) as bigint) as len_raw_signal, array_to_string(sig, ',') as sig from {_SIG}",
    "skim_signals": f"select vec_id, label, cast(len(sig) as bigint) as len_raw_signal, '.' as raw_signal from {_SIG}",
    "skim_enum": f"select event_id, cast(coalesce(list_position([{_ENUM}], event_type), 0) - 1 as bigint) as code, case when list_contains([{_ENUM}], event_type) then event_type end as end_reason from events",
    "get_ordered": f"select cast(pos - 1 as bigint) as pos, event_id, user_id from (select unnest({IDS}) as id, generate_subscripts({IDS}, 1) as pos) q join events on id = event_id",
    "get_missing": f"select cast(pos - 1 as bigint) as pos, cast(id as bigint) as event_id from (select unnest({IDS}) as id, generate_subscripts({IDS}, 1) as pos) q where id not in (select event_id from events)",
    "index_unique": "select count(*) as n, count(distinct event_id) as n_ids from events",
    "index_duplicates": "select l_orderkey, count(*) as n from lineitem group by l_orderkey having count(*) > 1",
    "stats_counts": f"select count(*) as n_records, count(distinct label) as n_groups, cast(sum(len(sig)) as bigint) as n_samples from {_SIG}",
    "merge_union": "select count(*) as n, count(case when event_id % 3 <> 1 then value end) as n_value, count(case when event_id % 3 <> 2 then event_type end) as n_type, cast(sum(user_id) as bigint) as channels from events",
    "merge_rg_map": "with f as (select event_type, min(event_id) as p, count(*) as n from events group by event_type) select event_type, cast(dense_rank() over (order by p) - 1 as bigint) as read_group, n from f",
    "merge_header": "select cast(n_nationkey as bigint) as run, 'same' as attr, n_name as value from nation union all select n_nationkey, 'kit', case when n_name = lower(n_name) then n_name else '' end from nation union all select n_nationkey, 'part', case when n_nationkey % 2 = 0 then cast(n_regionkey as varchar) else '' end from nation",
    "cat_union": "select cast(o_orderkey % 2 as bigint) as file_ord, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders group by 1",
    "split_reads": "select cast(p // 4000 as bigint) as part, count(*) as n, min(event_id) as lo, max(event_id) as hi from (select event_id, row_number() over (order by event_id) - 1 as p from events) group by 1",
    "split_files": "select cast(p - 1 as bigint) as part, count(*) as n, min(event_id) as lo, max(event_id) as hi from (select event_id, ntile(7) over (order by event_id) as p from events) group by 1",
    "split_groups": "select count(*) as n, cast(0 as bigint) as read_group, cast(label as bigint) as part from embeddings group by label",
    "demux_fanout": _TALLY.format(c="m.l_returnflag") + "orders o join (select distinct l_orderkey, l_returnflag from lineitem) m on o.o_orderkey = m.l_orderkey group by 1",
    "demux_uniq_missing": "with k as (select l_orderkey, min(l_returnflag) as c, count(distinct l_returnflag) as n from lineitem group by l_orderkey) " + _TALLY.format(c="case when k.n is null then 'missing' when k.n > 1 then 'mixed' else k.c end") + "orders o left join k on o.o_orderkey = k.l_orderkey group by 1",
    "demux_missing_docs": "select d.source, cast(sum(case when l.doc_id is null then 1 else 0 end) as bigint) as n_missing from documents d left join labels l on d.doc_id = l.doc_id group by d.source",
    "demux_extra": "select count(*) as n_extra from (select distinct l_orderkey from lineitem) m anti join orders o on m.l_orderkey = o.o_orderkey",
    "degrade_b3": _QUANTISED.format(h=4, b=3, m=8, top=32760),
    "degrade_b1": _QUANTISED.format(h=1, b=1, m=2, top=32766),
    "degrade_profile": f"with p(i, name, device, hz, bits) as (values {_PROFILE_VALUES}), c as (select c_custkey, ['minion', 'promethion', 'p2_solo'][c_custkey % 3 + 1] as device, 4000 + c_custkey % 2 * 1000 as hz from customer) select c_custkey, coalesce(arg_min(name, i), '') as name, coalesce(arg_min(bits, i), 0) as bits from c left join p on c.device = p.device and c.hz = p.hz group by c_custkey",
    "signal_stats": "select round(avg(n_chars), 6) as mean, median(n_chars) as median, round(stddev_samp(n_chars), 6) as sd, min(n_chars) as lo, max(n_chars) as hi, cast(sum(n_chars) as bigint) as total from documents",
    "signal_slice": f"select vec_id, array_to_string(sig[10:20], ',') as sig from {_SIG}",
    "signal_explode": f"select label, count(*) as n, min(x) as lo, max(x) as hi, cast(sum(x) as bigint) as total from (select label, unnest(sig) as x from {_SIG}) group by label",
    "signal_of_read": f"select cast(generate_subscripts(sig, 1) - 1 as bigint) as p, unnest(sig) as x from {_SIG} where vec_id = 42",
    "first_records": "select event_id, user_id, event_type from events order by event_id limit 10",
    "count_by_channel": "select user_id, count(*) as n from events group by user_id",
    "aux_stats": "select round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd from events",
    "sample_hash": "select event_id from events order by (event_id * 7919 + 13) % 10007, event_id limit 200",
    "subset_ids": "select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49)",
    "split_by_column": _TALLY.format(c="o.o_orderpriority") + "orders o group by 1",
    "corr_pair": "select round(corr(l_quantity, l_extendedprice), 9) as r from lineitem",
    "lossy_acceptance": f"with s as (select unnest(sig) as x from {_SIG}), y as (select x, ((x+4)>>3)*8 as z from s) select count(*) as n, max(abs(x - z)) as worst, round(corr(x, z), 9) as r, round(corr(x, z), 9) >= 0.97 as accepted from y",
    "flatten_pivot": "select user_id, " + ", ".join(f"max(case when event_type = '{x}' then value end) as {x}" for x in LABELS) + " from events group by user_id",
    "unflatten_stack": "select s_suppkey, unnest(['name', 'nation']) as attr, unnest([s_name, cast(s_nationkey as varchar)]) as value from supplier",
    "count_parity": "select count(*) as total, count(*) as parts, true as equal from orders",
    "positions_dense": "select conv_id, turn, row_number() over (order by conv_id, turn) - 1 as pos from conversations",
    "split_chain": "select cast(label as bigint) as part_group, cast(p // 7 as bigint) as part, count(*) as n, min(vec_id) as lo, max(vec_id) as hi, cast(0 as bigint) as read_group from (select label, vec_id, row_number() over (partition by label order by vec_id) - 1 as p from embeddings) group by 1, 2",
    "merge_batches": "select cast(event_id % 5 // 2 as bigint) as batch, count(*) as n, count(distinct event_id % 5) as files, cast(sum(event_id) as bigint) as keys from events group by 1",
    "estimate_check": "with f as (select count(*) as n from customer group by c_nationkey), e as (select count(*) as n_files, cast(count(*) * max(n) as bigint) as n_expected, cast(sum(n) as bigint) as n_found from f) select *, n_found * 100 // n_expected as percent, n_files <= 20 or n_found * 100 // n_expected >= 95 as passed from e",
    "acceptance_scores": "with x as (select 1 - cast(l_tax as double) / 8 as i from lineitem), g as (select avg(i) as mean_original, median(i) as median_original, count(*) as n_original, avg(i - 0.0005) as mean_lossy, median(i - 0.0005) as median_lossy, count(*) as n_lossy from x) select round(mean_original, 6) as mean_original, round(median_original, 6) as median_original, n_original, round(mean_lossy, 6) as mean_lossy, round(median_lossy, 6) as median_lossy, n_lossy, least(mean_original, mean_lossy) >= 0.93 and least(median_original, median_lossy) >= 0.97 as good_scores, mean_original - mean_lossy <= 0.001 and median_original - median_lossy <= 0.001 as good_pair, good_scores and good_pair as accepted from g",
    "skim_strict": "select event_id, '.' as raw_signal, '.' as channel, '.' as event_type, value as median_before from events",
    "stream_count": "select event_type, count(*) as n from events group by event_type",
}

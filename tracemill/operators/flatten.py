"""Between a tree of attributes in long form and flat reads with a header.

Long form: file, read, grp, attr, h5type, value; signals: file, read, raw_signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NULL, PRIMARY, ReadSet, SignalError

#: Groups that are passed over, attributes of a read, and attributes that are ignored.
SKIPPED_GROUPS = ("Analyses", "PreviousReadInfo")
FIELDS = {"read_id": "string", "digitisation": "double", "offset": "double", "range": "double", "sampling_rate": "double"}
AUXILIARY = {"start_time": "decimal(20,0)", "read_number": "int", "start_mux": "smallint", "median_before": "double", "end_reason": "smallint", "channel_number": "string"}
#: Their type names in a set of reads; codes of an end reason are kept as numbers.
AUX_NAMES = {"start_time": "uint64_t", "read_number": "int32_t", "start_mux": "uint8_t", "median_before": "double", "end_reason": "uint8_t", "channel_number": "char*"}
IGNORED = (
    "file_version", "num_minknow_events", "tracked_scaling_scale", "tracked_scaling_shift", "predicted_scaling_scale", "predicted_scaling_shift",
    "num_reads_since_mux_change", "time_since_mux_change", "duration", "file_type",
)
HEADER_GROUPS = ("root", "context_tags", "tracking_id")
#: The header attributes that each group of a tree has; others are dropped.
CONTEXT_TAGS = (
    "sample_frequency", "barcoding_enabled", "experiment_duration_set", "experiment_type", "local_basecalling", "package", "package_version",
    "sequencing_kit", "filename", "experiment_kit", "user_filename_input",
)
TRACKING_ID = (
    "asic_id", "asic_id_eeprom", "asic_temp", "auto_update", "auto_update_source", "bream_is_standard", "device_id", "exp_script_name", "exp_script_purpose",
    "exp_start_time", "flow_cell_id", "heatsink_temp", "hostname", "installation_type", "local_firmware_file", "operating_system", "protocol_run_id",
    "protocols_version", "run_id", "usb_config", "version", "asic_version", "configuration_version", "device_type", "distribution_status",
    "distribution_version", "flow_cell_product_code", "guppy_version", "protocol_group_id", "sample_id", "bream_core_version", "bream_ont_version",
    "bream_prod_version", "bream_rnd_version",
)
#: Auxiliary columns that a tree cannot do without if there are any; types of attributes in a tree; attributes beside the channel's.
ESSENTIAL = ("start_time", "read_number", "start_mux", "median_before", "channel_number")
H5TYPES = {"start_time": "uint64", "read_number": "int32", "start_mux": "uint8", "median_before": "double", "end_reason": "enum", "channel_number": "string", "read_id": "string"}
CHANNEL = ("channel_number", "digitisation", "offset", "range", "sampling_rate")
#: Types of columns that dump_all keeps.
DUMPED = {"double": "double", "float": "float", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)"}
#: The largest value each integer type of an attribute may have, and the least.
RANGES = {"start_mux": (0, 255), "read_number": (-(2**31), 2**31 - 1), "start_time": (0, 2**64 - 1), "end_reason": (0, 255)}


def flatten(attrs: DataFrame, signals: DataFrame, allow: bool = False, dump_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reads, header): flat reads with auxiliary columns, and file, attr, value of the header.

    Names and values that are a point or have white space other than spaces, unknown attributes (unless dump_all: they are
    columns of their own type), values out of their type's range, a plain integer as end reason, reads without all fields,
    files of several run_ids (unless allow: the smallest read's holds), and files whose smallest read lacks context_tags,
    tracking_id or a run_id, or gives an attribute two values, are refused. The header is that of the smallest read that
    has the attribute."""
    attrs = attrs.where(~F.col("grp").isin(*SKIPPED_GROUPS))

    def refuse(bad: DataFrame, why: str) -> None:
        if row := bad.take(1):
            raise SignalError(f"{why}: {row[0].asDict()}")

    for c in ("attr", "value"):
        refuse(attrs.where(F.col(c).rlike(r"[\t\n\r\x0b\f]") | (F.col(c) == NULL)), f"{c} not allowed")
    refuse(attrs.where("attr = 'end_reason' AND h5type = 'uint8'"), "end_reason is no enum")
    refuse(attrs.where("attr = 'pore_type' AND value != 'not_set'"), "pore_type is set")
    head = attrs.where(F.col("grp").isin(*HEADER_GROUPS) | F.col("attr").isin("run_id", "pore_type"))
    own = attrs.where(~F.col("grp").isin(*HEADER_GROUPS) & ~F.col("attr").isin("run_id", "pore_type"))
    known = [*FIELDS, *AUXILIARY]
    others: dict[str, str] = {}
    unknown = own.where(~F.col("attr").isin(*known, *IGNORED))
    if dump_all:
        found = unknown.groupBy("attr").agg(F.collect_set("h5type").alias("kinds")).orderBy("attr").collect()  # names, not rows
        others = {r.attr: DUMPED.get(r.kinds[0], "string") if len(r.kinds) == 1 else "string" for r in found}
    else:
        refuse(unknown, "unknown attribute")
    for name, (low, high) in RANGES.items():
        v = F.col("value").try_cast("decimal(38,0)")
        refuse(own.where(F.col("attr") == name).where(v.isNull() | (v < low) | (v > F.lit(str(high)).cast("decimal(38,0)"))), "value out of range")
    wide = own.groupBy("file", "read").pivot("attr", [*known, *others]).agg(F.first("value"))
    kinds = {**FIELDS, **AUXILIARY, **others}
    wide = wide.select("file", "read", *[F.col(f"`{k}`").try_cast(t).alias(k) for k, t in kinds.items()])
    rows = wide.join(signals, ["file", "read"], "left").withColumn("len_raw_signal", F.size("raw_signal").cast("long"))
    refuse(rows.where(" OR ".join(f"{c} IS NULL" for c in (*FIELDS, "raw_signal"))).select("file", "read"), "read without all fields")
    refuse(rows.where("NOT read_id RLIKE '^[A-Za-z0-9]'").select("read_id"), "read id")
    if not allow:
        refuse(head.where("attr = 'run_id'").groupBy("file").agg(F.countDistinct("value").alias("n")).where("n > 1"), "several run_ids")
    first = attrs.select("file", "read").groupBy("file").agg(F.min("read").alias("read")).join(head, ["file", "read"], "left")
    refuse(first.groupBy("file").agg(F.max(F.col("grp") == "context_tags").alias("c"), F.max(F.col("grp") == "tracking_id").alias("t"), F.max(F.col("attr") == "run_id").alias("r")).where("NOT (c AND t AND r) OR r IS NULL"), "first read lacks a group of the header")
    refuse(first.where("attr != 'run_id'").groupBy("file", "attr").agg(F.countDistinct("value").alias("n")).where("n > 1"), "two values of an attribute")
    text = F.when(F.col("h5type").isin("float", "double"), F.format_string("%.1f", F.col("value").try_cast("double"))).otherwise(F.col("value"))
    header = head.groupBy("file", "attr").agg(F.min_by(text, "read").alias("value"))
    rows = rows.withColumn("read_group", F.lit(0).cast("long"))
    return rows.select("file", *PRIMARY, *AUXILIARY, *others), header


def by_run(attrs: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads of mixed files dealt to a file per run_id: attrs and signals with the run as their file.

    A read without a run_id, or with several, is refused."""
    runs = attrs.where("attr = 'run_id'").groupBy("file", "read").agg(F.min("value").alias("run"), F.countDistinct("value").alias("n"))
    known = attrs.select("file", "read").distinct().join(runs, ["file", "read"], "left")
    if bad := known.where("run IS NULL OR n != 1").take(1):
        raise SignalError(f"not one run_id: {bad[0].asDict()}")
    known = known.select("file", "read", "run")
    # A read's name is unique in its file only.
    name = F.concat_ws("/", "file", "read").alias("read")
    return tuple(df.join(known, ["file", "read"]).select(F.col("run").alias("file"), name, *[c for c in df.columns if c not in ("file", "read")]) for df in (attrs, signals))


def convert_mixed(attrs: DataFrame, signals: DataFrame) -> ReadSet:
    """One set of all reads of mixed files, a read group per run in order of the run_ids; lost and repeated reads are refused."""
    rows, header = flatten(*by_run(attrs, signals))
    found = header.orderBy("file", "attr").collect()  # the attributes of each run, not of its reads
    runs = {r.file: k for k, r in enumerate({r.file: r for r in found}.values())}
    head: list[dict] = [{} for _ in runs]
    for r in found:
        head[runs[r.file]][r.attr] = r.value or None
    if (n := rows.count()) != (before := signals.count()):
        raise SignalError(f"{before} reads became {n}")
    if again := rows.groupBy("read_id").count().where("count > 1").take(1):
        raise SignalError(f"read {again[0].read_id} occurs more than once")
    numbers = rows.sparkSession.createDataFrame(list(runs.items()), "file string, read_group long")
    placed = rows.drop("read_group").join(numbers, "file").select(F.lit(0).alias("file_ord"), F.struct("read_group", "read_id").alias("rec_ord"), *PRIMARY, *AUXILIARY)
    return ReadSet(placed, head, AUX_NAMES)


def unflatten(reads: DataFrame, header: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attrs, signals): the long form of flat reads (with file) and their header (file, attr, value), and file, read, raw_signal.

    A header's attributes go to the groups that have them, others are dropped; a point becomes empty. Reads of several
    read groups, and auxiliary columns without the essential ones, are refused."""
    aux = [c for c in AUXILIARY if c in reads.columns]
    if aux and (lost := [c for c in ESSENTIAL if c not in aux]):
        raise SignalError(f"no column {lost[0]}")
    if "read_group" in reads.columns and reads.where("read_group != 0").take(1):
        raise SignalError("split by read group first")
    fields = [c for c in (*FIELDS, *aux) if c in reads.columns]
    cells = [f"'{'channel_id' if c in CHANNEL else 'Raw'}', '{c}', '{H5TYPES.get(c, 'double')}', cast(`{c}` AS string)" for c in fields]
    if "len_raw_signal" in reads.columns:
        cells.append("'Raw', 'duration', 'uint32', cast(len_raw_signal AS string)")
    own = reads.selectExpr("file", "read_id AS read", f"stack({len(cells)}, {', '.join(cells)}) AS (grp, attr, h5type, value)").where("value IS NOT NULL")
    a = F.col("attr")
    groups = F.array_compact(F.array(F.when(a.isin(*CONTEXT_TAGS), "context_tags"), F.when(a.isin(*TRACKING_ID), "tracking_id"), F.when(a == "file_version", "root")))
    placed = header.select("file", F.explode(groups).alias("grp"), "attr", F.lit("string").alias("h5type"), "value")
    kind = header.select("file").distinct().select("file", F.lit("root").alias("grp"), F.lit("file_type").alias("attr"), F.lit("string").alias("h5type"), F.lit("multi-read").alias("value"))
    tags = reads.select("file", F.col("read_id").alias("read")).join(placed.unionByName(kind), "file").select(*own.columns)
    tags = tags.withColumn("value", F.when(F.col("value").isNull() | (F.col("value") == NULL), "").otherwise(F.col("value")))
    signals = reads.select("file", F.col("read_id").alias("read"), *(["raw_signal"] if "raw_signal" in reads.columns else []))
    return own.unionByName(tags), signals

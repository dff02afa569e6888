"""Operators on one set of reads: view, skim, get, index, stats, quickcheck, degrade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import enum_label, quantise
from ..model import NULL, ORDER, PRIMARY, ReadSet, SignalError, enum_labels


def view(reads: ReadSet, lossless: bool = True) -> ReadSet:
    """All records and the whole header; without auxiliary columns if not lossless."""
    if lossless:
        return reads
    return reads.with_(df=reads.df.select(*ORDER, *PRIMARY), aux={})


#: The auxiliary columns that skim knows by name.
SKIMMED = (
    "channel_number", "median_before", "read_number", "start_mux", "start_time", "end_reason", "tracked_scaling_shift", "tracked_scaling_scale",
    "predicted_scaling_shift", "predicted_scaling_scale", "num_reads_since_mux_change", "time_since_mux_change", "num_minknow_events",
)


def skim(reads: ReadSet, labels: bool = True, strict_compat: bool = False) -> DataFrame:
    """All columns, the signal as a point; enum codes as labels. The signal's column is never read from Parquet.

    strict_compat: auxiliary columns of other names than the known ones are points, too."""
    aux = []
    for name, kind in reads.aux.items():
        if strict_compat and name not in SKIMMED:
            aux.append(F.lit(NULL).alias(name))
            continue
        known = enum_labels(kind)
        aux.append(enum_label(F.col(name), known).alias(name) if known and labels else F.col(name))
    return reads.df.select(*ORDER, *[k for k in PRIMARY if k != "raw_signal"], F.lit(NULL).alias("raw_signal"), *aux)


def read_ids(reads: ReadSet) -> DataFrame:
    """The ids alone, in order: no other column is read."""
    return reads.df.select(*ORDER, "read_id")


def request(df_or_reads, ids: list[str] | DataFrame) -> DataFrame:
    """pos and read_id of a request: line ends stripped, blank lines left out, repeats kept. A DataFrame has these columns."""
    if isinstance(ids, DataFrame):
        return ids.select("pos", F.regexp_replace("read_id", r"[\r\n]+$", "").alias("read_id")).where("read_id != ''")
    spark = (df_or_reads.df if isinstance(df_or_reads, ReadSet) else df_or_reads).sparkSession
    clean = [x.rstrip("\r\n") for x in ids]
    return spark.createDataFrame([(i, x) for i, x in enumerate(clean) if x], "pos bigint, read_id string")


def missing(reads: ReadSet, ids: list[str] | DataFrame) -> DataFrame:
    return request(reads, ids).join(reads.df.select("read_id"), "read_id", "left_anti").select("pos", "read_id")


def get(reads: ReadSet, ids: list[str] | DataFrame, skip: bool = False) -> ReadSet:
    """The records of the ids, in the order of the request (file_ord), each as often as asked; an unknown id is refused unless skip."""
    if not skip and (lost := missing(reads, ids).take(1)):
        raise SignalError(f"no read {lost[0].read_id}")
    found = request(reads, ids).join(reads.df.drop("file_ord"), "read_id")
    return reads.with_(df=found.withColumnRenamed("pos", "file_ord").select(*reads.df.columns))


def repeated(reads: ReadSet) -> DataFrame:
    """read_id and n of the ids that several records have."""
    return reads.df.groupBy("read_id").agg(F.count("*").alias("n")).where("n > 1")


def index(reads: ReadSet) -> DataFrame:
    """read_id with its place; a repeated id is refused."""
    if again := repeated(reads).take(1):
        raise SignalError(f"read {again[0].read_id} occurs more than once")
    return reads.df.select("read_id", *ORDER)


def get_indexed(reads: ReadSet, places: DataFrame, ids: list[str] | DataFrame, skip: bool = False) -> ReadSet:
    """get by an index that was made before (read_id and its place): records are joined by their place, ids only with the index."""
    wanted = request(reads, ids)
    if not skip and (lost := wanted.join(places.select("read_id"), "read_id", "left_anti").take(1)):
        raise SignalError(f"no read {lost[0].read_id}")
    found = wanted.join(places.select("read_id", *ORDER), "read_id").select("pos", *ORDER)
    rows = reads.df.join(found, list(ORDER))
    return reads.with_(df=rows.drop("file_ord").withColumnRenamed("pos", "file_ord").select(*reads.df.columns))


def stats(reads: ReadSet) -> list[tuple[str, str]]:
    """What a file holds, as keys and values; the codecs are those of the binary form."""
    return [
        ("file path", reads.path), ("file version", reads.version), ("file format", reads.form), ("record compression method", reads.codec), ("signal compression method", "none"),
        ("number of read groups", str(len(reads.header))), ("number of auxiliary fields", str(len(reads.aux))), ("auxiliary fields", ",".join(reads.aux)), ("number of records", str(reads.df.count())),
    ]


def stats_lines(reads: ReadSet) -> list[str]:
    """stats as tab-separated lines; an empty list of fields has no tab."""
    return [f"{k}\t{v}" if v else k for k, v in stats(reads)]


def quickcheck(open_) -> bool:
    """Whether a set opens and its first record decodes; open_ returns the ReadSet."""
    try:
        row = open_().df.limit(1).collect()
    except Exception:  # any failure to read is the answer
        return False
    return not row or (row[0].read_id is not None and len(row[0].raw_signal or ()) == row[0].len_raw_signal)


#: Fixed values of known devices, in the order in which they are tried:
#: name, device types, sequencing kit, experiment type, sample frequency, digitisation, bits.
PROFILES = (
    ("minion_lsk114_5khz", "minion", "sqk-lsk114", "genomic_dna", 5000, 8192.0, 3),
    ("gridion_lsk114_5khz", "gridion", "sqk-lsk114", "genomic_dna", 5000, 8192.0, 3),
    *(
        (f"{device}_{name}", device, kit, experiment, hz, 2048.0, bits)
        for device in ("promethion", "p2_solo")
        for name, kit, experiment, hz, bits in (
            ("lsk109_4khz", "sqk-lsk109", "genomic_dna", 4000, 2),
            ("lsk114_4khz", "sqk-lsk114", "genomic_dna", 4000, 3),
            ("lsk114_5khz", "sqk-lsk114", "genomic_dna", 5000, 3),
            ("rna002_3khz", "sqk-rna002", "rna", 3000, 2),
            ("rna004_4khz", "sqk-rna004", "rna", 4000, 3),
            ("ulk114_5khz", "sqk-ulk114", "genomic_dna", 5000, 3),
        )
    ),
)


def profile(header: list[dict]) -> tuple | None:
    """The first profile that all read groups fit; the frequency may be named sample_frequency or sample_rate."""

    def fits(group: dict, p: tuple) -> bool:
        hz = [group[k] for k in ("sample_frequency", "sample_rate") if group.get(k)]
        return (
            group.get("device_type") == p[1] and group.get("sequencing_kit") == p[2] and group.get("experiment_type") == p[3]
            and bool(hz) and all(float(x) == p[4] for x in hz)
        )

    return next((p for p in PROFILES if header and all(fits(g, p) for g in header)), None)


def degrade(reads: ReadSet, bits: int | str = "auto") -> ReadSet:
    """Round the low bits of each sample away; auto takes them from the device's profile and checks every record against it."""
    if bits == "auto":
        if not (p := profile(reads.header)):
            raise SignalError("no suitable number of bits is known for this header")
        if odd := reads.df.where((F.col("digitisation") != p[5]) | (F.col("sampling_rate") != p[4])).take(1):
            raise SignalError(f"read {odd[0].read_id} does not fit profile {p[0]}")
        bits = p[6]
    if not isinstance(bits, int) or not 1 <= bits <= 16:
        raise SignalError("bits are 1 to 16, or auto")
    return reads.with_(df=reads.df.withColumn("raw_signal", quantise("raw_signal", bits).cast("array<smallint>")))

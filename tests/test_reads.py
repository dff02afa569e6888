"""The operators on a small text file of reads, with negative cases."""

import pytest
from pyspark.sql import functions as F

from tracemill import operators as ops
from tracemill.model import HeaderMismatch, SignalError
from tracemill.sources import text as source
from tracemill.streaming import watch

HEAD = """#sig_version	0.2.0
#num_read_groups	{n}
@kit	{kit}
@run_id	{run}
#char*	uint32_t	double	double	double	double	uint64_t	int16_t*	enum{{unknown,mux,signal}}	char*	int32_t
#read_id	read_group	digitisation	offset	range	sampling_rate	len_raw_signal	raw_signal	end_reason	channel	number
"""


def row(name, group=0, signal="430,472,-463", aux="2\tc1\t7"):
    return f"{name}\t{group}\t8192\t6.5\t1467.61\t5000\t{signal.count(',') + 1}\t{signal}\t{aux}\n"


def put(folder, name, rows, kit="k", run="run0", n=1):
    (folder / name).write_text(HEAD.format(n=n, kit=kit, run=run) + "".join(rows))
    return str(folder / name)


@pytest.fixture()
def one(spark, tmp_path):
    return source.read_text(spark, put(tmp_path, "a.sig", [row(f"r{k}", aux=".\t.\t." if k == 3 else "2\tc1\t7") for k in range(5)]))


def ids(df, *order):
    return [r.read_id for r in df.orderBy(*(order or ("file_ord", "rec_ord"))).collect()]


def test_round_trip(spark, one, tmp_path):
    source.write_text(one, f"{tmp_path}/out")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == (tmp_path / "a.sig").read_text()
    source.write_parquet(one, f"{tmp_path}/b.parquet")
    back = source.read_parquet(spark, f"{tmp_path}/b.parquet")
    assert back.header == one.header and back.aux == one.aux and back.df.count() == 5
    with pytest.raises(SignalError):
        source.detect_format("x.parquet", "text")


def test_header_refusals():
    with pytest.raises(SignalError):
        source.parse_header(["#sig_version\t0.2.0", "@run_id\tx"])
    with pytest.raises(SignalError):
        source.parse_header(["#sig_version\t1.1.0", "#num_read_groups\t1"])


def test_skim_get_index_stats(one):
    rows = ops.skim(one).orderBy("rec_ord").collect()
    assert [r.end_reason for r in rows] == ["signal", "signal", "signal", None, "signal"] and rows[0].raw_signal == "."
    assert ids(ops.get(one, ["r3\r\n", "", "r1", "r3"]).df) == ["r3", "r1", "r3"]
    with pytest.raises(SignalError):
        ops.get(one, ["nope"])
    assert ids(ops.get(one, ["nope", "r2"], skip=True).df) == ["r2"]
    assert ops.index(one).count() == 5 and dict(ops.stats(one))["number of records"] == "5"
    with pytest.raises(SignalError):
        ops.index(one.with_(df=one.df.union(one.df)))
    assert ops.quickcheck(lambda: one) and not ops.quickcheck(lambda: 1 / 0)


def test_split(one):
    parts = {r.read_id: r.part for r in ops.split_files(one, 3).collect()}
    assert parts == {"r0": 0, "r1": 0, "r2": 1, "r3": 1, "r4": 2}
    assert [r.part for r in ops.split_reads(one, 2).orderBy("pos").collect()] == [0, 0, 1, 1, 2]
    with pytest.raises(SignalError):
        ops.split_groups(one)


def test_merge_and_groups(spark, tmp_path):
    a = source.read_text(spark, put(tmp_path, "a.sig", [row("x")]))
    b = source.read_text(spark, put(tmp_path, "b.sig", [row("y"), row("z", 1)], kit="k\tq", run="run1\trun0", n=2))
    with pytest.raises(HeaderMismatch):
        ops.merge([a, b])
    got = ops.merge([a, b], allow=True)
    assert [g["run_id"] for g in got.header] == ["run0", "run1"] and got.header[0]["kit"] is None
    assert {r.read_id: r.read_group for r in got.df.collect()} == {"x": 0, "y": 1, "z": 0}
    assert list(got.aux) == ["end_reason", "channel", "number"]
    back = ops.split_groups(got)
    assert [x.df.count() for x in back] == [2, 1] and back[1].df.first().read_group == 0
    with pytest.raises(HeaderMismatch):
        ops.cat([a, b])
    assert ids(ops.cat([a, a]).df) == ["x", "x"]


def test_demux(spark, one):
    table = spark.createDataFrame([("r0", "b1"), ("r1", "b1"), ("r1", "b2"), ("r1", "b2")], "parent_read_id string, barcode_arrangement string")
    assert sorted((r.read_id, r.category) for r in ops.demux(one, table).collect()) == [("r0", "b1"), ("r1", "b1"), ("r1", "b2")]
    got = ops.demux(one, table, multi="many", unmatched="none")
    assert {r.read_id: r.category for r in got.collect()} == {"r0": "b1", "r1": "many", "r2": "none", "r3": "none", "r4": "none"}
    for bad in ({"multi": "b1"}, {"multi": "x", "unmatched": "x"}):
        with pytest.raises(SignalError):
            ops.demux(one, table, **bad)
    with pytest.raises(SignalError):
        ops.demux(one, spark.createDataFrame([("rx", "b")], "parent_read_id string, barcode_arrangement string"))


def test_degrade(one):
    assert ops.degrade(one, 3).df.first().raw_signal == [432, 472, -464]
    twice = ops.degrade(ops.degrade(one, 3), 3).df.first().raw_signal
    assert twice == [432, 472, -464]
    for bits in (0, 17, "auto"):
        with pytest.raises(SignalError):
            ops.degrade(one, bits)
    known = one.with_(header=[{"device_type": "minion", "sequencing_kit": "sqk-lsk114", "experiment_type": "genomic_dna", "sample_rate": "5000"}])
    assert ops.degrade(known).df.first().raw_signal == [432, 472, -464]


def test_flatten(spark):
    rows = [("f", "r", "Raw", "read_id", "string", "abc"), ("f", "r", "Raw", "start_mux", "uint8", "3"), ("f", "r", "tracking_id", "run_id", "string", "run")]
    rows += [("f", "r", "channel_id", k, "double", "1.5") for k in ("digitisation", "offset", "range", "sampling_rate")]
    rows += [("f", "r", "context_tags", "sample_frequency", "string", "4000")]
    kind = "file string, read string, grp string, attr string, h5type string, value string"
    signal = spark.createDataFrame([("f", "r", [1, 2])], "file string, read string, raw_signal array<smallint>")
    reads, header = ops.flatten(spark.createDataFrame(rows, kind), signal)
    assert reads.first().start_mux == 3 and reads.first().len_raw_signal == 2
    assert {r.attr: r.value for r in header.collect()} == {"run_id": "run", "sample_frequency": "4000"}
    back = ops.flatten(*ops.unflatten(reads, header))
    for a, b in zip((reads, header), back):
        assert {repr(r) for r in a.collect()} <= {repr(r) for r in b.select(a.columns).collect()}
    attrs, _ = ops.unflatten(reads, header.union(spark.createDataFrame([("f", "odd", "x"), ("f", "device_id", ".")], header.schema)))
    got = {(r.grp, r.attr): (r.h5type, r.value) for r in attrs.collect()}
    assert got["tracking_id", "device_id"] == ("string", "") and got["Raw", "start_mux"] == ("uint8", "3") and got["Raw", "duration"] == ("uint32", "2")
    assert got["root", "file_type"] == ("string", "multi-read") and not any(a == "odd" for _, a in got)
    for wrong in (reads.withColumn("read_group", F.lit(1)), reads.drop("start_time")):
        with pytest.raises(SignalError):
            ops.unflatten(wrong, header)
    kept, _ = ops.flatten(spark.createDataFrame([*rows, ("f", "r", "Raw", "odd", "int32", "12")], kind), signal, dump_all=True)
    assert kept.first().odd == 12 and dict(kept.dtypes)["odd"] == "int"
    for rows_ in ([r for r in rows if r[2] != "context_tags"], [r for r in rows if r[3] != "run_id"]):
        with pytest.raises(SignalError):
            ops.flatten(spark.createDataFrame(rows_, kind), signal)
    for bad in (("f", "r", "root", "sample_frequency", "string", "5000"), ("f", "r", "Raw", ".", "string", "x")):
        with pytest.raises(SignalError):
            ops.flatten(spark.createDataFrame([*rows, bad], kind), signal)
    for bad in (("f", "r", "Raw", "odd", "string", "x"), ("f", "r", "Raw", "start_mux", "int", "300"), ("f", "r", "Raw", "end_reason", "uint8", "1")):
        with pytest.raises(SignalError):
            ops.flatten(spark.createDataFrame([r for r in rows if r[3] != bad[3]] + [bad], kind), signal)


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.sig", [row("x")])
    (tmp_path / "in" / "b.sig").write_text("broken")

    def convert(session, path):
        return source.read_text(session, path).df.select("read_id")

    for _ in range(2):  # the second run finds nothing new
        watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp", convert, "*.sig").awaitTermination()
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").count() == 1
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/bad").count() == 1


def test_listing(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.sig").write_text("")
    files = source.list_files(spark, [str(tmp_path)], (".sig",))
    assert len(files) == 2 and source.duplicate_names(spark, files) == ["x.sig"]


def test_numbers(spark):
    got = spark.createDataFrame([(1467.61,), (100.0,), (0.5,), (-3.0,)], "x double").select(source.number(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == ["1467.61", "100", "0.5", "-3"]


def test_watch_takes_a_name_once_and_stops_when_idle(spark, tmp_path):
    from tracemill.streaming import done, follow

    for k, folder in enumerate(("in/x", "in/y")):
        (tmp_path / folder).mkdir(parents=True)
        put(tmp_path / folder, "same.sig", [row("x")])
        put(tmp_path / folder, f"own{k}.sig", [row("x")])
    (tmp_path / "in" / "long.sig").write_text("broken")

    def convert(session, path):
        if path.endswith("long.sig"):
            raise ValueError("why " * 400)
        return source.read_text(session, path).df.select("read_id")

    run = watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp", convert, "*.sig", realtime=True, interval="1 second")
    report = follow(run, idle=20, files=5)
    assert report["files"] == 5 and not report["error"]
    got = {r.name: r.reason for r in done(spark, f"{tmp_path}/cp").collect()}
    assert set(got) == {"same.sig", "own0.sig", "own1.sig", "long.sig"} and got["long.sig"] == "why " * 400 and got["same.sig"] is None


def test_positions_of_many_rows(spark):
    """More rows than a sample of ranges holds, with a payload that one use of them does not read."""
    from tracemill.model import ReadSet
    from tracemill.plans import positions

    n = 400_000
    df = spark.range(0, n, 1, 8).select(F.lit(0).alias("file_ord"), ((F.col("id") * 7919) % n).alias("rec_ord"), F.md5(F.col("id").cast("string")).alias("payload"))
    got = positions(df, "file_ord", "rec_ord", buckets=8).agg(F.count_distinct("pos"), F.max("pos"), F.sum((F.col("pos") != F.col("rec_ord")).cast("int"))).first()
    assert tuple(got) == (n, n - 1, 0)
    sizes = [r.n for r in ops.split_files(ReadSet(df, [{"run_id": "r"}]), 7).groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_command_line(spark, tmp_path, capsys):
    from tracemill.__main__ import main

    def cli(*args):
        code = main([str(a) for a in args], spark)
        return code, capsys.readouterr().out

    a = put(tmp_path, "a.sig", [row(f"r{k}", k % 2) for k in range(5)], kit="k\tk2", run="run0\trun1", n=2)
    b = put(tmp_path, "b.sig", [row(f"s{k}") for k in range(5)])
    assert cli("view", b) == (0, (tmp_path / "b.sig").read_text())
    assert cli("view", b, "-c", "zstd")[0] == 1
    assert cli("view", b, "-o", tmp_path / "b.parquet", "-c", "zstd")[0] == 0
    lines = cli("stats", tmp_path / "b.parquet")[1].splitlines()
    assert [x.split("\t")[0] for x in lines] == ["file path", "file version", "file format", "record compression method", "signal compression method", "number of read groups", "number of auxiliary fields", "auxiliary fields", "number of records"]
    assert "record compression method\tzstd" in lines and "number of records\t5" in lines
    assert cli("skim", b, "--rid") == (0, "".join(f"s{k}\n" for k in range(5))) and cli("skim", b, "--rid", "--hdr")[0] == 1
    assert cli("skim", b)[1].splitlines()[1] == "s0\t0\t8192\t6.5\t1467.61\t5000\t3\t.\tsignal\tc1\t7"
    assert cli("index", b, "-o", tmp_path / "b.idx")[0] == 0
    head = (tmp_path / "b.sig").read_text().split("s0")[0]
    assert cli("get", b, "s3", "s1", "--index", tmp_path / "b.idx") == (0, head + row("s3") + row("s1"))
    assert cli("get", b, "s3", "s1") == (0, head + row("s3") + row("s1")) and cli("get", b, "none")[0] == 1 and cli("get", b, "none", "--skip") == (0, head)
    assert cli("split", b, "-r", 2, "-d", tmp_path / "parts")[0] == 0
    assert "".join(p.read_text() for p in sorted((tmp_path / "parts/b/part=1").glob("part-*"))) == head + row("s2") + row("s3")
    assert cli("split", a, "-g", "-d", tmp_path / "groups")[0] == 0
    assert source.read_text(spark, str(tmp_path / "groups/a/part=1")).header == [{"kit": "k2", "run_id": "run1"}]
    assert cli("merge", a, b)[0] == 0 and cli("cat", b, b)[0] == 0 and cli("cat", a, b)[0] == 1 and cli("quickcheck", b)[0] == 0
    assert cli("split", a, "--chain", 2, "-d", tmp_path / "chain")[0] == 0 and cli("split", b, "--chain", 2, "-d", tmp_path / "none")[0] == 1
    back = source.read_text(spark, str(tmp_path / "chain/a/part=0_1"))
    assert [r.read_id for r in back.df.collect()] == ["r4"] and back.header == [{"kit": "k", "run_id": "run0"}]
    assert cli("skim", b, "--strict")[1].splitlines()[1] == "s0\t0\t8192\t6.5\t1467.61\t5000\t3\t.\tsignal\t.\t."
    with pytest.raises(SystemExit):
        cli("-K", 0, "view", b)


def test_split_chain_equals_both_steps(spark, tmp_path):
    reads = source.read_text(spark, put(tmp_path, "a.sig", [row(f"r{k:02}", k % 3 // 2) for k in range(11)], kit="k\tk2", run="x\ty", n=2))
    want = {(g, r.part, r.read_id) for g, own in enumerate(ops.split_groups(reads)) for r in ops.split_reads(own, 3).collect()}
    got = ops.split_chain(reads, 3)
    assert {(r.part_group, r.part, r.read_id) for r in got.collect()} == want and {r.read_group for r in got.collect()} == {0}
    with pytest.raises(SignalError):
        ops.split_chain(reads, 0)


def test_checks(spark):
    def scores(*x):
        return spark.createDataFrame([(v,) for v in x], "identity double")

    ops_row = ops.acceptance(scores(0.98, 0.99, None), scores(0.9795, 0.9895), 2).first()
    assert ops_row.accepted and ops_row.n_original == 2
    assert not ops.acceptance(scores(0.98, 0.99), scores(0.97, 0.98), 2).first().good_pair
    assert not ops.acceptance(scores(0.98, 0.99), scores(0.98), 2).first().good_scores
    assert not ops.acceptance(scores(), scores(), 0).first().accepted
    counts = spark.createDataFrame([(k, 10 if k else None) for k in range(21)], "file int, n bigint")
    assert [ops.estimate(counts, spark.range(n)).first()[2:] for n in (200, 199)] == [(200, 95, True), (199, 94, False)]
    assert ops.estimate(counts.limit(20), spark.range(1)).first().passed and ops.estimate(counts.where("file < 0"), spark.range(0)).first().percent == 100
    assert ops.parity(spark.range(3), spark.range(3)).first()[:] == (3, 3, True) and not ops.parity(spark.range(3), spark.range(0)).first().equal


def test_convert_mixed(spark):
    def tree(name, run):
        own = [("Raw", "read_id", name), *[("channel_id", c, "1") for c in ("digitisation", "offset", "range", "sampling_rate")], ("context_tags", "sample_frequency", "4000"), *([("tracking_id", "run_id", run)] if run else [])]
        return own

    def table(*reads):
        attrs = [(f, n, g, a, "string", v) for f, n, run in reads for g, a, v in tree(n, run)]
        return spark.createDataFrame(attrs, "file string, read string, grp string, attr string, h5type string, value string"), spark.createDataFrame([(f, n, [1, 2]) for f, n, _ in reads], "file string, read string, raw_signal array<smallint>")

    got = ops.convert_mixed(*table(("f", "a", "y"), ("f", "b", "x"), ("g", "c", "y")))
    assert [h["run_id"] for h in got.header] == ["x", "y"]
    assert [(r.read_id, r.read_group) for r in got.df.orderBy("file_ord", "rec_ord").collect()] == [("b", 0), ("a", 1), ("c", 1)]
    for bad in ((("f", "a", "y"), ("g", "a", "y")), (("f", "a", "y"), ("f", "b", None))):
        with pytest.raises(SignalError):
            ops.convert_mixed(*table(*bad))


def test_runs_finished(spark, tmp_path):
    from tracemill.streaming import runs_finished

    for k in (1, 2):
        (tmp_path / f"s/p/r{k}").mkdir(parents=True)
    (tmp_path / "s/p/r1/final_summary_1.txt").write_text("x")
    assert not runs_finished(spark, f"{tmp_path}/s", 0)
    (tmp_path / "s/p/r2/final_summary_2.txt").write_text("x")
    assert runs_finished(spark, f"{tmp_path}/s", -1) and not runs_finished(spark, f"{tmp_path}/s")

"""Every core query against its SQL at the smallest size."""

import math
import os

import duckdb
import pytest

from tracemill import queries

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in os.listdir(D):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{D}/{t}')")
    got = queries.QUERIES[name](spark, D)
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)

    def key(rows):
        return sorted(repr([None if isinstance(x, float) and math.isnan(x) else x for x in r]) for r in rows)

    assert key(tuple(r) for r in got.select(*names).collect()) == key(want.fetchall())


def test_flatten_pivot_takes_all(spark, tmp_path):
    rows = [(k, u, t, float(k)) for k, (u, t) in enumerate((u, t) for u in (5, 100) for t in [*queries.LABELS, "view"])]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: [r[x] for x in queries.LABELS] for r in queries.QUERIES["flatten_pivot"](spark, str(tmp_path)).collect()}
    assert got == {5: [5.0, 1.0, 2.0, 3.0, 4.0], 100: [11.0, 7.0, 8.0, 9.0, 10.0]}


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
@pytest.mark.parametrize("name, operator", [("stats_counts", "stats"), ("merge_rg_map", "merge"), ("flatten_pivot", "flatten"), ("view_signal", "view"), ("index_duplicates", "repeated"), ("demux_extra", "extra"), ("count_parity", "demux"), ("unflatten_stack", "unflatten")])
def test_query_calls_its_operator(spark, monkeypatch, name, operator):
    from tracemill import operators

    called, inner = [], getattr(operators, operator)
    monkeypatch.setattr(queries, operator, lambda *a, **b: called.append(1) or inner(*a, **b), raising=False)
    queries.QUERIES[name](spark, D)
    assert called

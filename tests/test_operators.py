"""Joins, streams, the query suite against its oracle, and the entry points."""

import datetime as dt
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.operators import joins
from sparkloom.plans.suite import TABLES
from sparkloom.streaming import windows
from tests.conftest import SF


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def same(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(0.0 if r[i] == 0 and isinstance(r[i], float) else r[i] for i in order)) for r in rows)


ORACLE = entry.oracle_sql()
SUITE = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]


@pytest.mark.parametrize("name", SUITE)
def test_suite_matches_oracle(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    want = oracle.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert same(df.columns, [tuple(r) for r in df.collect()]) == same(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE) <= set(entry.queries())


def test_asof_matches_brute_force(spark):
    rng = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    left = [(i, rng.choice("ab"), rng.choice([None, t0 + dt.timedelta(minutes=rng.randrange(50))])) for i in range(60)] + [(99, None, t0)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, t0 + dt.timedelta(minutes=rng.randrange(50))]), i) for i in range(40)]
    ldf, rdf = spark.createDataFrame(left, "i long, k string, ts timestamp_ntz"), spark.createDataFrame(right, "k string, ts timestamp_ntz, v long")
    for strict in (False, True):
        for forward in (False, True):
            got = {r["i"]: r["v"] for r in joins.asof_join(ldf, rdf, "ts", ["k"], ["v"], strict=strict, forward=forward).collect()}
            for i, k, ts in left:
                near = [(abs(s - ts), -v) for g, s, v in right if ts and s and g == k and k and ((s > ts if strict else s >= ts) if forward else (s < ts if strict else s <= ts))]
                assert got[i] == (-min(near)[1] if near else None)


def test_range_and_salted_joins(spark):
    rng = random.Random(2)
    pts, rgs = [(i, rng.uniform(-50, 50)) for i in range(200)], [(j, *sorted((rng.uniform(-50, 50), rng.uniform(-50, 50)))) for j in range(30)]
    p, r = spark.createDataFrame(pts, "i long, x double"), spark.createDataFrame(rgs, "j long, lo double, hi double")
    want = {(i, j) for i, x in pts for j, lo, hi in rgs if lo <= x <= hi}
    args = (p, r, p["x"], r["lo"], r["hi"], 7.0)
    assert {(a["i"], a["j"]) for a in joins.range_join(*args).collect()} == want
    assert {a["i"] for a in joins.range_join(*args, how="left_semi").collect()} == {i for i, _ in want}
    assert {a["i"] for a in joins.range_join(*args, how="left_anti").collect()} == {i for i, _ in pts} - {i for i, _ in want}
    plan = joins.range_join(*args)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    a = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (None, 2)], "k long, a long")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k long, b string")
    for how in ("inner", "left"):
        assert sorted(map(tuple, joins.salted_join(a, b, "k", 4, how).select("k", "a", "b").collect()), key=repr) == sorted(map(tuple, a.join(b, "k", how).select("k", "a", "b").collect()), key=repr)


def test_append_stream_drops_late_rows(spark, tmp_path):
    day = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    for k, rows in enumerate([[(1, day(0, 5)), (2, day(3))], [(3, day(0, 6)), (4, day(5))]]):
        spark.createDataFrame(rows, "id long, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = windows.run_once(windows.tumbling(stream, "1 hour", [], F.count("*").alias("n")), "append").collect()
    assert sum(r["n"] for r in out) <= 3 and len({r["window_start"] for r in out}) == len(out)


def test_batch_and_stream_agree(spark):
    ev = windows.read_stream(spark, f"{SF}/events.parquet")
    batch = spark.read.parquet(f"{SF}/events.parquet")
    for make in (lambda d: windows.tumbling(d, "2 hours", ["event_type"], F.count("*").alias("n")), lambda d: windows.sessions(d, "1 hour", ["user_id"], F.count("*").alias("n"))):
        assert sorted(map(tuple, windows.run_once(make(ev)).collect())) == sorted(map(tuple, make(batch).collect()))


def test_stream_results_are_files(spark, tmp_path):
    """The sink of every mode is Parquet; nothing of it is kept by the driver. Of several batches ``complete`` gives the last, ``update`` all."""
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    for k, rows in enumerate([[(1, at(0), 1.0), (2, at(5), 2.0)], [(1, at(20), 4.0)]]):
        spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    sessions = windows.run_once(windows.sessions(stream, "30 minutes", ["user_id"], F.count("*").alias("n")))
    assert sessions.inputFiles() and sorted((r.user_id, r.n) for r in sessions.collect()) == [(1, 2), (2, 1)]
    totals = windows.run_once(windows.running(stream, "user_id", "value"), "update")
    last = {r.user_id: (r.n, r.total) for r in sorted(totals.collect(), key=lambda r: r.n)}
    assert totals.inputFiles() and last == {1: (2, 5.0), 2: (1, 2.0)}
    (tmp_path / "none").mkdir()
    nothing = spark.readStream.schema(schema).parquet(str(tmp_path / "none"))
    assert windows.run_once(windows.sessions(nothing, "30 minutes", ["user_id"], F.count("*").alias("n"))).collect() == []


@pytest.mark.parametrize("name", ["unnest_left", "unnest_left_offset", "array_subquery", "exists_unnest"])
def test_unnest_needs_no_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 1


def test_large_results_are_paged_by_file_in_order(engine, monkeypatch):
    from sparkloom import jobs

    monkeypatch.setattr(jobs, "KEEP", 50)
    runs = jobs.Jobs(engine)
    job = runs.submit("project1", {"query": {"query": "SELECT x FROM UNNEST(GENERATE_ARRAY(1, 1000)) AS x ORDER BY x DESC"}})
    assert runs.wait(job, 120) and job.error is None and job.total == 1000 and job.rows is None
    got, at = [], 0
    while at is not None:
        rows, at = runs.page(job, at, 130)
        got += [int(r["f"][0]["v"]) for r in rows]
    assert got == list(range(1000, 0, -1))

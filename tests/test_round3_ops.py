"""Interval join by time, exact comparisons of large integers, float text."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logvault.functions.variant import py_float
from logvault.layouts import get_layout
from logvault.operators import predicates as P
from logvault.operators.runs import assign_by_time
from logvault.operators.search import search

T0 = dt.datetime(2024, 3, 1)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_assign_by_time_equals_brute_force(spark, kind):
    rng = random.Random(8)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    runs = [(i, at(a := rng.uniform(0, 1000)), at(a + rng.choice([0, 1, 5, 30]))) for i in range(60)]
    runs += [(100, at(-500), at(5000)), (101, at(20), at(10)), (102, None, at(5)), (103, at(5), None), (100, at(-500), at(5000)), (104, at(7), at(7))]
    samples = [(k, at(round(rng.uniform(-50, 1100)))) for k in range(300)] + [(900, None), (901, at(7))]
    s = spark.createDataFrame(samples, f"k int, ts {kind}").withColumn("_b", F.lit(1)).withColumn("start", F.lit("x"))
    r = spark.createDataFrame(runs, f"run_id int, start {kind}, end {kind}")
    got = assign_by_time(s, r)
    assert got.columns == ["k", "ts", "_b", "start", "run_id"]
    want = [(k, i) for k, t in samples for i, a, z in runs if None not in (t, a, z) and a <= t <= z]
    assert sorted((x.k, x.run_id) for x in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_assign_by_time_empty_and_instant_runs(spark):
    s = spark.createDataFrame([(1, T0)], "k int, ts timestamp_ntz")
    none = spark.createDataFrame([], "run_id int, start timestamp_ntz, end timestamp_ntz")
    assert assign_by_time(s, none).collect() == []
    now = spark.createDataFrame([(5, T0, T0)], "run_id int, start timestamp_ntz, end timestamp_ntz")
    assert [(x.k, x.run_id) for x in assign_by_time(s, now).collect()] == [(1, 5)]
    assert assign_by_time(s.limit(0), now).collect() == []


def test_a_long_run_is_split(spark):
    runs = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), T0 + dt.timedelta(seconds=i + 1)) for i in range(999)]
                                 + [(5000, T0, T0 + dt.timedelta(days=30))], "run_id int, start timestamp_ntz, end timestamp_ntz")
    samples = spark.createDataFrame([(k, T0 + dt.timedelta(hours=k)) for k in range(24 * 30)], "k int, ts timestamp_ntz")
    got = assign_by_time(samples, runs).filter("run_id = 5000").count()
    assert got == 24 * 30


@pytest.mark.parametrize("name", ["variant", "document", "json_string", "pairwise"])
def test_large_integers_compare_exactly(spark, lines_df, name):
    big = [2**53, 2**53 + 1, 2**64, 2**64 + 1, -2**53 - 1, 5, 10**25]
    lay = get_layout(name)
    if name == "pairwise":  # stores integers of 64 bits; larger ones are doubles
        big = [b for b in big if abs(b) < 2**63]
    df = lay.build(lines_df([f'{{"k": {i}, "big": {b}}}' for i, b in enumerate(big)] + ['{"k": 90, "big": "9007199254740993"}', '{"k": 91, "big": true}']))
    values = {**dict(enumerate(big)), 90: 2**53 + 1}
    for v in (2**53, 2**53 + 1, -2**53, 2**63, 2**64, 2**64 + 1):
        for op, fn in (("gt", int.__gt__), ("ge", int.__ge__), ("lt", int.__lt__), ("le", int.__le__), ("eq", int.__eq__)):
            pred = P.Eq("big", v) if op == "eq" else P.Cmp("big", op, v)
            hits = search(df, lay, pred)
            assert sorted(r[0] for r in hits.select(lay.resolver(hits).integer("k")).collect()) == sorted(k for k, x in values.items() if fn(x, v)), (op, v)


def test_float_text_is_pythons(spark):
    rng = random.Random(4)
    xs = [0.0, -0.0, 1e7, 1e-5, 1e16, 1e15, 123456789.125, 5e-324, 1e-323, 0.0001, 0.00012, 1e22, -1e21, 100.0, 9999999.0, 2.5e-7, 1e100, float("inf"), -float("inf")]
    xs += [round(rng.uniform(-1, 1) * 10 ** rng.randint(-12, 16), rng.randint(0, 9)) for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", py_float(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got if r.t != str(r.x)] == []
    assert spark.createDataFrame([(None,), (float("nan"),)], "x double").select(py_float(F.col("x")).alias("t")).collect() == [(None,), ("nan",)]

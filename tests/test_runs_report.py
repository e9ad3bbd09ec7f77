"""T01, J01-J04, A06-A10, R01-R06 on small literal inputs."""

import datetime as dt
import json

from pyspark.sql import functions as F

from logvault.operators.report import methodology_label, read_results, report, report_long
from logvault.operators.runs import (
    assign_samples, golden_check, golden_frame, parse_ps, related_samples, run_latency, run_memory_avg,
    sample_total,
)

HDR = "USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND"


def samples(spark):
    t = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [
        (1, t, HDR),
        (1, t, "root 10 0.0 0.1 100 2000 ? S 00:00 0:01 java -jar x"),
        (1, t, "root 11 0.0 0.1 100 1000 ? S 00:00 0:01 jav"),
        (1, t + dt.timedelta(milliseconds=700), "root 12 0.0 0.1 100 500 ? S 00:00 0:01 python3 a.py"),
        (1, t, "root 13 0.0 0.1 100 9999 ? S 00:00 0:01 bash"),
        (2, t, "short line"),
    ]
    return spark.createDataFrame(rows, "run_id long, ts timestamp_ntz, ps_line string")


def related(spark):
    return spark.createDataFrame([("spark", "java"), ("spark", "python3"), ("spark", "javac")],
                                 "tool string, name string")


def test_parse_and_related(spark):
    p = parse_ps(samples(spark))
    assert p.count() == 4
    r = related_samples(p, related(spark), "spark")
    # 'java' matches two names but is kept once; 'jav' is a prefix of 'java'
    assert sorted(x["command"] for x in r.collect()) == ["jav", "java", "python3"]


def test_sample_total_and_memory(spark):
    r = related_samples(parse_ps(samples(spark)), related(spark), "spark")
    tot = sample_total(r, "500 milliseconds").orderBy("sample_ts").collect()
    assert [x["total_rss_bytes"] for x in tot] == [3000 * 1024, 500 * 1024]
    runs = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 2)),
                                  (3, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 1))],
                                 "run_id long, start timestamp_ntz, `end` timestamp_ntz")
    assigned = assign_samples(r, runs)
    m = {x["run_id"]: x for x in run_memory_avg(run_latency(runs), sample_total(assigned, "500 milliseconds")).collect()}
    assert m[1]["memory_average_B"] == (3000 + 500) * 1024 / 2
    assert m[3]["memory_average_B"] == -1.0
    assert m[1]["time_taken_s"] == 2.0


def test_golden_check(spark):
    res = spark.createDataFrame([(0, 38611), (1, 5)], "query_ind int, result long")
    out = {r["query_ind"]: r["ok"] for r in golden_check(res, golden_frame(spark)).collect()}
    assert out == {0: True, 1: False}


def docs(spark):
    d1 = {"mongod": {"{}": {"ingest": {"time_taken_s": 2.0, "memory_average_B": 1048576,
                                       "compressed_size_B": 1048576, "decompressed_size_B": 4194304,
                                       "start_time": "2024-01-01 00:00:00"},
                            "query_cold": [{"time_taken_s": 1.0, "memory_average_B": 2097152, "result": 5,
                                            "start_time": "2024-01-01 00:00:01"}],
                            "query_hot": [{"time_taken_s": 0.5, "memory_average_B": -1, "result": 5,
                                           "start_time": "2024-01-01 00:00:02"}]}}}
    d2 = {"mongod": {'{"dataset_variation": "cleaned_log"}': {
        "ingest": {"time_taken_s": 3.0, "memory_average_B": -1, "compressed_size_B": 0,
                   "decompressed_size_B": 10, "start_time": "2024-01-01 00:00:00"}}}}
    return spark.createDataFrame([("toolA", json.dumps(d1)), ("toolB", json.dumps(d2))], "tool string, doc string")


def test_read_results_and_report(spark):
    long = read_results(docs(spark))
    assert long.count() == 4 + 3 + 3 + 4
    lab = spark.createDataFrame([("t", '{"a": "1", "b": "x"}'), ("t", "{}")], "tool string, config string")
    assert [r[0] for r in lab.select(methodology_label(F.col("tool"), F.col("config"))).collect()] == [
        "t (a=1, b=x)", "t ()"]
    rl = report_long(long)
    cells = {(r["sheet"], r["methodology"], r["metric"]): r["value"] for r in rl.collect()}
    assert cells[("mongod (ingest)", "toolA ()", "compressed_size_MB")] == 1.0
    assert cells[("mongod (ingest)", "toolA ()", "compression_ratio")] == 4.0
    assert cells[("mongod (ingest)", "toolB (dataset_variation=cleaned_log)", "compression_ratio")] is None
    assert cells[("mongod (search)", "toolA ()", "q0_cold")] == 1.0
    assert cells[("mongod (result)", "toolA ()", "q0_hot")] == 5.0
    assert cells[("mongod (search)", "toolA ()", "memory_average_cold_MB")] == 2.0
    assert ("mongod (search)", "toolA ()", "memory_average_hot_MB") not in cells  # only -1 samples
    # toolB has no cold/hot runs: no search or result rows
    assert not any(k[1].startswith("toolB") and k[0] != "mongod (ingest)" for k in cells)
    wide = report(rl)
    assert set(wide.columns) == {"sheet", "metric", "toolA ()", "toolB (dataset_variation=cleaned_log)"}


def test_totals_by_time_are_those_of_the_pairs(spark):
    # runs that overlap, meet, repeat, end before they start or miss a time; several samples at one time
    from logvault.operators.runs import assign_by_time
    at = lambda c: F.timestamp_seconds(F.col(c))
    samples = spark.createDataFrame([(t, t % 7, 1 << 62) for t in (0, 5, 5, 5, 9, 10, 20, 20, 31)] + [(None, 1, 1)],
                                    "t long, v long, big long").select(at("t").alias("ts"), "v", "big")
    runs = spark.createDataFrame([(1, 0, 31), (2, 5, 5), (2, 5, 5), (3, 6, 8), (4, 20, 10), (None, 9, 20), (5, None, 9), (6, 31, 99), (7, 0, 5)],
                                 "run_id long, a long, b long").select("run_id", at("a").alias("start"), at("b").alias("end"))
    got = assign_by_time(samples, runs, totals={"n": F.lit(1), "v": F.col("v"), "one": F.when(F.col("big") > 0, 1)})
    assert "_at" not in got.columns and got.columns == ["run_id", "n", "v", "one"]
    met = assign_by_time(samples, runs).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.groupBy("run_id").agg(F.sum("n"), F.sum("v")).collect()), key=key) == sorted(map(tuple, met.collect()), key=key)
    # the total over all samples passes 64 bits, that of run 6 does not
    big = assign_by_time(samples, runs.filter("run_id = 6"), totals={"big": F.col("big")}).collect()
    assert [tuple(r) for r in big] == [(6, 1 << 62)]
    assert assign_by_time(samples.limit(0), runs, totals={"n": F.lit(1)}).count() == 0
    # no join that pairs samples with runs
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan

"""Registered queries for run analytics and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvault.layouts import get_layout
from logvault.operators.report import read_results, report, report_long
from logvault.operators.runs import (
    assign_samples, golden_check, golden_frame, parse_ps, related_samples, run_latency, run_memory_avg,
    sample_total,
)
from logvault.operators.search import count_hits_many
from logvault.plans.standard import FIXTURE, searches
from logvault.session import configure
from logvault.sources.fixtures import (
    bench_runs, event_log_lines, ps_samples, related_processes, result_documents,
)

GRID = "1 hour"


def q_parse_ps(spark, sf_dir):
    """Command and RSS bytes of every sample line."""
    return parse_ps(ps_samples(spark, sf_dir)).select("run_id", "ts", "command", "rss_bytes")


def _related(spark, sf_dir):
    return related_samples(parse_ps(ps_samples(spark, sf_dir)), related_processes(spark), "sparksql")


def q_related_samples(spark, sf_dir):
    """Samples of processes related to the tool (prefix semi join)."""
    return _related(spark, sf_dir).select("run_id", "ts", "command", "rss_bytes")


def q_sample_total(spark, sf_dir):
    """T03 + A06: total related RSS per run and hourly polling slot."""
    return sample_total(_related(spark, sf_dir), GRID)


def q_run_memory(spark, sf_dir):
    """J02 + A06 + A07 + A09: per run, latency and mean total RSS (-1 if none)."""
    runs = bench_runs(spark, sf_dir)
    s = assign_samples(_related(spark, sf_dir), runs)
    m = run_memory_avg(run_latency(runs), sample_total(s, GRID))
    return m.select("run_id", "tool", "phase", "time_taken_s", "memory_average_B")


def q_golden_check(spark, sf_dir):
    """A02 + J03: hits of the six searches (variant layout) vs the golden counts."""
    configure(spark)
    lay = get_layout("variant")
    df = lay.build(event_log_lines(spark, sf_dir))
    counts = count_hits_many(df, lay, searches("sql", FIXTURE))
    res = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("query_ind"), F.col(f"q{i + 1}").alias("result"))
                                            for i in range(6)])).alias("r")).select("r.*")
    return golden_check(res, golden_frame(spark))


def q_results_long(spark, sf_dir):
    """Result documents -> long metrics (numeric values)."""
    r = read_results(result_documents(spark, sf_dir))
    return r.withColumn("value", F.col("value").try_cast("double"))


def q_report_long(spark, sf_dir):
    """R02-R04 + A04 + A08 + A10: long report rows per sheet."""
    return report_long(read_results(result_documents(spark, sf_dir))).drop("start_time")


def q_report_pivot(spark, sf_dir):
    """Wide report (one column per methodology)."""
    return report(report_long(read_results(result_documents(spark, sf_dir))))


QUERIES = {
    "parse_ps": q_parse_ps,
    "related_samples": q_related_samples,
    "sample_total": q_sample_total,
    "run_memory": q_run_memory,
    "golden_check": q_golden_check,
    "results_long": q_results_long,
    "report_long": q_report_long,
    "report_pivot": q_report_pivot,
}


def oracles() -> dict:
    from logvault.operators.runs import GOLDEN_COUNTS
    from logvault.plans import oracle, run_oracle
    forms = ["q1", "q2", "q3_like", "q4_drop", "q5", "q6"]
    parts = [f"SELECT CAST({i} AS INTEGER) AS query_ind, (SELECT count(*) FROM f WHERE {oracle.SEARCH_SQL[f]}) "
             f"AS result, CAST({g} AS BIGINT) AS expected" for i, (f, g) in enumerate(zip(forms, GOLDEN_COUNTS))]
    golden = (oracle.FIX + "SELECT query_ind, result, expected, coalesce(result = expected, false) AS ok FROM ("
              + " UNION ALL ".join(parts) + ")")
    return {**run_oracle.ORACLES, "golden_check": golden}

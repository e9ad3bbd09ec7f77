"""Benchmark: ingest + search per archive layout, plus the heavier operators.

Mirrors the reference's benchmark at the driver's data scale: the log
fixture of ``$BENCH_SF_DIR`` is first written as NDJSON text files (dataset
preparation, not timed); then every layout is ingested from those files
(timed), each of the six standard searches is run on the written archive
(timed, ``filter(...).count()``), all six in one pass (A02), the six as
Spark SQL text over the inferred archive view, a streaming ingest of the same
files, and the flatten / catalogue / clean / normalise / report operators are
timed (the report reads result documents prepared once, like the raw logs).

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from logvault.layouts import LAYOUTS, get_layout  # noqa: E402
from logvault.operators.flatten import path_catalog, path_catalog_pairwise  # noqa: E402
from logvault.operators.normalize import normalize  # noqa: E402
from logvault.operators.quality import archive_size  # noqa: E402
from logvault.operators.report import read_results, report, report_long  # noqa: E402
from logvault.operators.search import count_hits, count_hits_many  # noqa: E402
from logvault.plans.queries import FORMS_OF_LAYOUT  # noqa: E402
from logvault.plans.standard import DIALECT_OF_LAYOUT, FIXTURE, searches  # noqa: E402
from logvault.session import get_spark  # noqa: E402
from logvault.sinks.writers import ingest_files, write_raw  # noqa: E402
from logvault.sources.archive import read_archive  # noqa: E402
from logvault.sources.fixtures import event_log_lines, result_documents  # noqa: E402
from logvault.sources.lines import clean_lines, parse_lines, read_lines  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    work = tempfile.mkdtemp(prefix="logvault-bench-")
    spark = get_spark(f"local[{cpus}]", partitions=cpus,
                      extra={"spark.checkpoint.dir": f"{work}/ckpt", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    # Dataset preparation (not timed): the raw NDJSON log files.
    raw = f"{work}/raw"
    write_raw(event_log_lines(spark, sf_dir).repartition(cpus), raw, "none")
    raw_bytes = archive_size(spark, raw)
    n_events = read_lines(spark, raw).count()
    results_dir = f"{work}/results"
    result_documents(spark, sf_dir).write.parquet(results_dir)

    sizes, hits = {}, {}
    for name in [n for n in LAYOUTS if n != "merged"]:  # the steps of earlier rounds, so that totals compare
        lay = get_layout(name)
        path = f"{work}/archive_{name}"
        timed(f"ingest_{name}", lambda: ingest_files(spark, raw, lay, path))
        sizes[name] = archive_size(spark, path)
        df = read_archive(spark, path, name, require_data=True)
        preds = searches(DIALECT_OF_LAYOUT[name], FIXTURE)
        for q, pred in preds.items():
            hits[f"{name}_{q}"] = timed(f"search_{name}_{q}", lambda: count_hits(df, lay, pred))
        all_forms = {s: searches(d, FIXTURE)[k] for s, d, k, _ in FORMS_OF_LAYOUT[name]}
        timed(f"count_all_{name}", lambda: count_hits_many(df, lay, all_forms).collect())
        # hot: the same scan again, with the JVM, code and file caches warm
        timed(f"count_all_hot_{name}", lambda: count_hits_many(df, lay, all_forms).collect())

    from logvault.functions.sql import register_sql_functions
    from logvault.plans.sql_queries import SQL_ON_STRUCT
    from logvault.streaming.ingest import ingest_stream, run_to_completion
    register_sql_functions(spark)
    read_archive(spark, f"{work}/archive_inferred", "inferred", view="bench_logs")
    sql = "SELECT " + ", ".join(f"count_if({p}) AS {q}" for q, p in SQL_ON_STRUCT.items()) + " FROM bench_logs"
    timed("sql_text_six_searches_inferred", lambda: spark.sql(sql).collect())
    timed("stream_ingest_variant", lambda: run_to_completion(ingest_stream(
        spark, raw, f"{work}/stream_variant", "variant", f"{work}/stream_ckpt")))

    var = spark.read.parquet(f"{work}/archive_variant")
    timed("path_catalog", lambda: path_catalog(var, "j").collect())
    pw = spark.read.parquet(f"{work}/archive_pairwise")
    timed("path_catalog_pairwise", lambda: path_catalog_pairwise(pw).collect())
    timed("normalize", lambda: var.select(normalize(F.col("j")).alias("n"))
          .write.format("noop").mode("overwrite").save())
    timed("clean_lines_b64", lambda: clean_lines(read_lines(spark, raw), "b64")[0]
          .write.format("noop").mode("overwrite").save())
    timed("parse_skip", lambda: parse_lines(read_lines(spark, raw), "skip")[0].count())
    timed("report", lambda: report(report_long(read_results(spark.read.parquet(results_dir)))).collect())

    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_sec", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "events": n_events,
        "raw_bytes": raw_bytes, "archive_bytes": sizes,
        "compression_ratio": {k: round(raw_bytes / v, 3) for k, v in sizes.items() if v},
        "ingest_mb_per_s": {k: round(raw_bytes / 1048576 / times[f"ingest_{k}"], 2) for k in sizes},
        "hits": hits, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

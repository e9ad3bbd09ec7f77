"""Registered queries of catalogue lookup, extraction functions, counts, sizes, write modes and the interval join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from logvault.layouts import LAYOUTS, get_layout
from logvault.operators.predicates import Missing
from logvault.operators.project import cast_number, epoch_to_text, json_extract, json_extract_scalar, project_event
from logvault.operators.quality import archive_size, archive_sizes, ingest_speed
from logvault.operators.report import read_results, report_long
from logvault.operators.runs import assign_by_time, parse_ps
from logvault.operators.search import count_hits, count_hits_many, search
from logvault.plans import oracle
from logvault.plans.queries import EVENT_ID, FORMS_OF_LAYOUT
from logvault.plans.standard import FIXTURE, searches
from logvault.session import configure, scratch_path
from logvault.sinks.writers import WRITE_MODES, ingest, write_layout, write_raw, write_report
from logvault.sources.archive import read_archive
from logvault.sources.catalog import lookup_catalog, read_catalog
from logvault.sources.fixtures import event_log_lines, ps_samples, result_documents

TARGET_BYTES = 64 << 10


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def short_runs(spark, sf_dir):
    """``run_id, start, end``: one run of 0 to 6 hours for each user, from the user's first event on."""
    start = _events(spark, sf_dir).groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("start"))
    return start.withColumn("end", F.timestamp_add("HOUR", (F.col("run_id") % 7).cast("int"), "start"))


def q_samples_by_time(spark, sf_dir):
    """J02 by time alone: samples without a run id meet every run active at their time."""
    configure(spark)
    samples = parse_ps(ps_samples(spark, sf_dir)).drop("run_id")
    met = assign_by_time(samples, short_runs(spark, sf_dir), totals={
        "n_samples": F.lit(1), "rss_bytes": F.col("rss_bytes"), "n_java": (F.col("command") == "java").cast("int")})
    return met.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("n_samples", "rss_bytes", "n_java")])


def q_catalog_lookup(spark, sf_dir):
    """S08 + J04: metadata files of one dataset each, read back and joined to the counted rows of the datasets."""
    configure(spark)
    ev = _events(spark, sf_dir).withColumn("dataset", F.concat(F.lit("ds_"), "event_type"))
    counted = ev.groupBy("dataset").agg(F.count("*").alias("n_rows"))
    base = scratch_path(spark, "datasets")
    meta = F.concat_ws("\n", F.lit("source: driver: events"), F.concat(F.lit("number_of_lines: "), F.col("n_rows").cast("string")),
                       F.when(F.col("dataset") != "ds_error", "timestamp: t.$date"), F.concat(F.lit("normal_log: "), "dataset", F.lit(".log")))
    # one file a dataset: a partition column names the folder
    counted.select(meta.alias("value"), F.col("dataset").alias("d")).repartition("d").write.partitionBy("d").text(base)
    cat = read_catalog(spark, f"{base}/*/*.txt").withColumn("dataset", F.regexp_replace("dataset", "^d=", ""))
    looked = lookup_catalog(counted.unionByName(spark.createDataFrame([("ds_unknown", 0)], "dataset string, n_rows bigint")), cat,
                            fields=("source", "number_of_lines", "timestamp_key", "normal_log"))
    return looked.select("dataset", "n_rows", "source", "number_of_lines", "timestamp_key", "normal_log")


def q_extract_functions(spark, sf_dir):
    """N17-N19 on JSON text: sub-document, scalar, number."""
    configure(spark)
    line = event_log_lines(spark, sf_dir)
    message = json_extract(F.col("line"), "attr.message")
    return line.select(
        cast_number(json_extract_scalar(F.col("line"), EVENT_ID)).alias("event_id"),
        F.try_variant_get(message, "$.msg", "string").alias("message"), json_extract_scalar(F.col("line"), "attr.message.session_name").alias("session_name"),
        cast_number(json_extract_scalar(F.col("line"), "attr.writeConcern.w")).alias("w_number"),
        json_extract_scalar(F.col("line"), "attr.bad key-name[1]").alias("second"), json_extract_scalar(F.col("line"), "ctx").alias("ctx"))


def q_missing(spark, sf_dir):
    """P02 on every layout: rows without a path, counted in one scan a layout."""
    configure(spark)
    lines, parts = event_log_lines(spark, sf_dir), []
    for name in LAYOUTS:
        lay = get_layout(name)
        counts = count_hits_many(lay.build(lines), lay, {"no_msg": Missing("msg"), "no_tickets": Missing("attr.tickets"), "no_message": Missing("attr.message.msg")})
        parts.append(counts.withColumn("layout", F.lit(name)))
    return _union(parts)


def q_count_hits_single(spark, sf_dir):
    """Each standard search counted by itself on two layouts."""
    configure(spark)
    lines, rows = event_log_lines(spark, sf_dir), []
    for name in ("variant", "static_dynamic"):
        lay = get_layout(name)
        path = scratch_path(spark, f"count-{name}")
        ingest(lines, lay, path)
        df = read_archive(spark, path, name)
        rows += [(name, s, count_hits(df, lay, searches(d, FIXTURE)[k])) for s, d, k, _ in FORMS_OF_LAYOUT[name]]
    return spark.createDataFrame(rows, "layout string, form string, hits bigint")


def q_raw_sizes(spark, sf_dir):
    """A03 + A05: bytes of uncompressed text archives, and bytes a second at 1,000 rows a second."""
    configure(spark)
    paths, rows = {}, []
    for table in ("documents", "conversations"):
        lines = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").select(F.col("text").alias("line"))
        paths[table] = scratch_path(spark, f"raw-{table}")
        write_raw(lines, paths[table], "none")
        rows.append((table, lines.count()))
    n = spark.createDataFrame(rows, "archive string, n_rows bigint")
    return archive_sizes(spark, paths).join(n, "archive").withColumn("bytes_per_second", ingest_speed(F.col("bytes"), F.col("n_rows") / 1000.0))


def q_sized_archive(spark, sf_dir):
    """An archive in files of a target size; no file is twice as large, no row is lost."""
    configure(spark)
    lines = event_log_lines(spark, sf_dir)
    rows = []
    for name in ("json_string", "variant"):
        lay, path = get_layout(name), scratch_path(spark, f"sized-{name}")
        write_layout(lay.build(lines), lay, path, target_file_bytes=TARGET_BYTES)
        files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("length")
        largest, stored = files.agg(F.max("length")).first()[0], archive_size(spark, path)
        rows.append((name, read_archive(spark, path, name).count(), largest <= 2 * TARGET_BYTES, files.count() >= stored // (2 * TARGET_BYTES)))
    return spark.createDataFrame(rows, "layout string, n_rows bigint, files_are_small boolean, files_are_enough boolean")


def q_write_modes(spark, sf_dir):
    """Rows of an archive after each write mode on top of an existing one."""
    configure(spark)
    lay, lines, rows = get_layout("json_string"), event_log_lines(spark, sf_dir), []
    few = lay.build(lines.filter(F.get_json_object("line", "$.s") == "E"))
    for mode in WRITE_MODES:
        path = scratch_path(spark, f"mode-{mode}")
        write_layout(lay.build(lines), lay, path, mode=mode)
        try:
            write_layout(few, lay, path, mode=mode)
            refused = False
        except Exception as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            refused = True
        rows.append((mode, refused, lay.read(spark, path).count()))
    return spark.createDataFrame(rows, "mode string, refused boolean, n_rows bigint")


def q_report_written(spark, sf_dir):
    """The long report written as one folder a sheet, and read back in both formats."""
    configure(spark)
    long = report_long(read_results(result_documents(spark, sf_dir))).drop("start_time")
    parts = []
    for fmt in ("parquet", "csv"):
        path = scratch_path(spark, f"report-{fmt}")
        write_report(long, path, fmt)
        schema = "methodology string, metric string, value double, sheet string"
        back = spark.read.schema(schema).option("header", "true").format(fmt).load(path)
        parts.append(back.groupBy("sheet").agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n_cells"), F.count("value").alias("n_values"),
                                              F.count_if(F.col("value") > 1).alias("over_one")))
    return _union(parts)


def q_project_event_scalars(spark, sf_dir):
    """The fixed projection of Q4's hits, its scalar fields."""
    configure(spark)
    lay = get_layout("variant")
    hits = search(lay.build(event_log_lines(spark, sf_dir)), lay, searches("sql", FIXTURE)["q4"])
    fields = (("msg", "string"), ("c", "string"), ("s", "string"), ("t.$date", "string"), ("ctx", "string"), ("id", "bigint"))
    return project_event(hits, lay.resolver(hits), fields)


def q_epoch_text(spark, sf_dir):
    """Epoch seconds as text in the session's zone: its minutes and seconds, and the seconds read back from it."""
    configure(spark)
    lay = get_layout("variant")
    df = lay.build(event_log_lines(spark, sf_dir))
    r = lay.resolver(df)
    secs = r.integer("attr.message.ts_sec")
    text = epoch_to_text(secs)
    return df.filter(secs.isNotNull()).select(r.integer(EVENT_ID).alias("event_id"), F.substring(text, 15, 5).alias("clock"), F.unix_timestamp(text).alias("ts_sec"))


QUERIES = {
    "samples_by_time": q_samples_by_time,
    "catalog_lookup": q_catalog_lookup,
    "extract_functions": q_extract_functions,
    "missing_all_layouts": q_missing,
    "count_hits_single": q_count_hits_single,
    "raw_sizes": q_raw_sizes,
    "sized_archive": q_sized_archive,
    "write_modes": q_write_modes,
    "report_written": q_report_written,
    "project_event_scalars": q_project_event_scalars,
    "epoch_text": q_epoch_text,
}


def oracles() -> dict:
    from logvault.plans.run_oracle import ORACLES
    errors, everything = "(SELECT count(*) FROM events WHERE event_type = 'error')", "(SELECT count(*) FROM events)"
    modes = {"overwrite": (False, errors), "append": (False, f"{everything} + {errors}"), "errorifexists": (True, everything), "ignore": (False, everything)}
    forms = {n: {s: o for s, _, _, o in FORMS_OF_LAYOUT[n]} for n in ("variant", "static_dynamic")}
    size = ("SELECT '{0}' AS archive, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes, count(*) AS n_rows, "
            "CAST(sum(coalesce(strlen(text), 0) + 1) AS DOUBLE) / (count(*) / 1000.0) AS bytes_per_second FROM {0}")
    return {
        "samples_by_time": """
WITH s AS (
  SELECT ts, CASE event_type WHEN 'click' THEN 'java' ELSE '' END AS command, CAST(trunc(value * 100) AS BIGINT) * 1024 AS rss_bytes FROM events),
r AS (SELECT user_id AS run_id, min(ts) AS start, min(ts) + to_hours(user_id % 7) AS "end" FROM events GROUP BY user_id)
SELECT run_id, count(*) AS n_samples, CAST(sum(rss_bytes) AS BIGINT) AS rss_bytes, count(*) FILTER (WHERE command = 'java') AS n_java
FROM r JOIN s ON s.ts BETWEEN r.start AND r."end" GROUP BY run_id""",
        "catalog_lookup": """
SELECT 'ds_' || event_type AS dataset, count(*) AS n_rows, 'driver: events' AS source, count(*) AS number_of_lines,
       CASE WHEN event_type <> 'error' THEN 't.$date' END AS timestamp_key, 'ds_' || event_type || '.log' AS normal_log FROM events GROUP BY event_type
UNION ALL SELECT 'ds_unknown', 0, NULL, NULL, NULL, NULL""",
        "extract_functions": oracle.FIX + """
SELECT event_id, m_msg AS message, session_name,
       CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN event_id % 3 + 1 END AS w_number, CAST(event_id % 5 AS VARCHAR) AS second, ctx FROM f""",
        "missing_all_layouts": oracle.FIX + " UNION ALL ".join(
            f"SELECT '{n}' AS layout, count(*) FILTER (WHERE msg IS NULL) AS no_msg, count(*) FILTER (WHERE tickets IS NULL) AS no_tickets, "
            f"count(*) FILTER (WHERE m_msg IS NULL) AS no_message FROM f" for n in LAYOUTS),
        "count_hits_single": oracle.FIX + " UNION ALL ".join(
            f"SELECT '{n}' AS layout, '{s}' AS form, count(*) AS hits FROM f WHERE {oracle.SEARCH_SQL[o]}" for n, fs in forms.items() for s, o in fs.items()),
        "raw_sizes": " UNION ALL ".join(size.format(t) for t in ("documents", "conversations")),
        "sized_archive": " UNION ALL ".join(
            f"SELECT '{n}' AS layout, count(*) AS n_rows, true AS files_are_small, true AS files_are_enough FROM events" for n in ("json_string", "variant")),
        "write_modes": " UNION ALL ".join(f"SELECT '{m}' AS mode, {r} AS refused, {n} AS n_rows" for m, (r, n) in modes.items()),
        "report_written": ("WITH long AS (" + ORACLES["report_long"] + ") " + " UNION ALL ".join(
            f"SELECT sheet, '{f}' AS fmt, count(*) AS n_cells, count(value) AS n_values, count(*) FILTER (WHERE value > 1) AS over_one FROM long GROUP BY sheet"
            for f in ("parquet", "csv"))),
        "project_event_scalars": oracle.FIX + "SELECT msg, c, s, t_text AS t_date, ctx, id FROM f WHERE " + oracle.SEARCH_SQL["q4_drop"],
        "epoch_text": oracle.FIX + "SELECT event_id, strftime(ts, '%M:%S') AS clock, ts_sec FROM f WHERE m_prefix IS NOT NULL",
    }

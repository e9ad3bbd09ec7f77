"""Stand-in inputs built from the driver tables.

The reference searches NDJSON server logs that are not available offline.
``event_log_lines`` turns every row of ``events`` into one JSON log line with
the shape of such a log (static fields ``t.$date s c id ctx msg`` and a
dynamic ``attr`` object with optional, nested and mixed-type members). It only
produces rows in the input schema (``line STRING``); all parsing, cleaning,
layout building and searching happen downstream in the library.

``ps_samples`` / ``bench_runs`` give run-metric inputs (``ps aux`` lines and
run records) derived from the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the log fixture (documented in FIXTURES.md §3).
ID_BASE = 22400
CTX_BY_USER_MOD5 = {0: "initandlisten", 1: "FlowControlRefresher"}
MSG_WIRED = "WiredTiger message"
MSG_SLOW = "Slow query"
PREFIX_BY_EVENT_MOD6 = {0: "log_release", 1: "log_remove", 2: "logXrelease"}
SESSION_EVEN, SESSION_ODD = "connection", "txn"
ERROR_TEXT = "disk full"
BAD_KEY = "bad key-name"
ROWS_A_TASK = 25_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_struct(ev: DataFrame) -> Column:
    """The JSON document of one event, as a struct (NULL members are omitted)."""
    eid, uid, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    prefix = (F.when(eid % 6 == 0, F.lit(PREFIX_BY_EVENT_MOD6[0]))
              .when(eid % 6 == 1, F.lit(PREFIX_BY_EVENT_MOD6[1]))
              .when(eid % 6 == 2, F.lit(PREFIX_BY_EVENT_MOD6[2])))
    message = F.when(prefix.isNotNull(), F.struct(
        F.concat(prefix, F.lit(": rec "), eid.cast("string")).alias("msg"),
        F.when(eid % 2 == 0, F.lit(SESSION_EVEN)).otherwise(F.lit(SESSION_ODD)).alias("session_name"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_sec"),
    ))
    error = F.when(et == "error", F.when(eid % 2 == 0, F.lit(ERROR_TEXT).cast("variant"))
                   .otherwise(F.to_variant_object(F.struct(F.lit(ERROR_TEXT).alias("errmsg")))))
    uuid_text = F.concat(F.lit("uuid-"), eid.cast("string"))
    uuid = F.when(et == "signup", F.when(eid % 2 == 0, uuid_text.cast("variant")).otherwise(
        F.to_variant_object(F.struct(F.struct(uuid_text.alias("$uuid")).alias("uuid")))))
    q_id = (F.when(eid % 4 == 1, uid.cast("variant"))
            .when(eid % 4 == 2, F.concat(F.lit("s"), uid.cast("string")).cast("variant"))
            .otherwise(F.to_variant_object(F.struct(F.concat(F.lit("o"), uid.cast("string")).alias("$oid")))))
    command = F.when(et == "view", F.when(eid % 4 == 0, F.lit("find").cast("variant")).otherwise(
        F.to_variant_object(F.struct(F.lit("events").alias("find"), F.struct(q_id.alias("_id")).alias("q")))))
    w = F.when(eid % 2 == 0, (eid % 3 + 1).cast("variant")).otherwise(F.lit("majority").cast("variant"))
    write_concern = F.when(et == "purchase", F.struct(w.alias("w")))
    query = F.when(et == "click", F.struct(F.when(eid % 2 == 0, uid.cast("variant")).otherwise(
        F.to_variant_object(F.struct(F.concat(F.lit("o"), uid.cast("string")).alias("$oid")))).alias("_id")))
    attr = F.struct(
        eid.alias("event_id"),
        F.col("value").alias("value"),
        F.when(uid % 5 == 1, eid % 128).alias("tickets"),
        F.when(uid % 5 == 1, eid % 4).alias("numTrimmed"),
        message.alias("message"),
        (et != "error").alias("ok"),
        error.alias("error"),
        uuid.alias("uuid"),
        command.alias("command"),
        write_concern.alias("writeConcern"),
        query.alias("query"),
        F.array(eid % 3, eid % 5).alias(BAD_KEY),
    )
    ctx = (F.when(uid % 5 == 0, F.lit(CTX_BY_USER_MOD5[0]))
           .when(uid % 5 == 1, F.lit(CTX_BY_USER_MOD5[1]))
           .otherwise(F.concat(F.lit("conn"), uid.cast("string"))))
    msg = F.when(eid % 7 == 0, F.lit(None).cast("string")).when(eid % 3 == 0, F.lit(MSG_WIRED)).otherwise(F.lit(MSG_SLOW))
    return F.struct(
        F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("$date")).alias("t"),
        F.when(et == "error", F.lit("E")).otherwise(F.lit("I")).alias("s"),
        F.upper(et).alias("c"),
        (F.lit(ID_BASE) + F.get_json_object("props", "$.k").cast("bigint")).alias("id"),
        ctx.alias("ctx"),
        msg.alias("msg"),
        attr.alias("attr"),
    )


def event_log_lines(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``line STRING``: one NDJSON log event per row of ``events``.

    ``spread`` deals the rows over tasks of about ``ROWS_A_TASK`` before their
    documents are written (the order of the rows is lost): a scan has a task for each
    row group at most, too few for work on every document.
    """
    ev = _read(spark, sf_dir, "events")
    tasks = -(-ev.count() // ROWS_A_TASK) if spread else 1  # the count comes from the footers
    if tasks < 2:
        return ev.select(F.to_json(event_struct(ev)).alias("line"))
    # lines out of a generator: filters on them would be pushed below the shuffle and write them there
    ev = ev.repartition(tasks)
    return ev.select(F.explode(F.array(F.to_json(event_struct(ev)))).alias("line"))


# Fixed values for the run-metric fixture: commands by event type, and the
# related-process list of one tool configuration.
COMMAND_BY_EVENT_TYPE = {
    "click": "java",
    "view": "python3",
    "purchase": "/opt/java/openjdk/bin/java",
    "signup": "bash",
    "error": "jav",
}
RELATED_PROCESSES = {"sparksql": ["python3", "java", "/opt/java/openjdk/bin/java"]}
TOOLS = ["tool_a", "tool_b", "tool_c", "tool_d"]


def ps_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, ts, ps_line``: ``ps aux`` text lines (field 6 RSS kB, 11 command)."""
    ev = _read(spark, sf_dir, "events")
    cmd = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in COMMAND_BY_EVENT_TYPE.items()],
                     F.lit("sh"))
    rss_kb = (F.col("value") * 100).cast("bigint")
    line = F.concat_ws(" ", F.lit("root"), F.col("event_id").cast("string"), F.lit("0.0"), F.lit("0.1"),
                       F.lit("1000"), rss_kb.cast("string"), F.lit("?"), F.lit("Ssl"), F.lit("00:00"),
                       F.lit("0:01"), cmd, F.lit("--flag"))
    return ev.select(F.col("user_id").alias("run_id"), F.col("ts"), line.alias("ps_line"))


def related_processes(spark: SparkSession) -> DataFrame:
    rows = [(tool, name) for tool, names in RELATED_PROCESSES.items() for name in names]
    return spark.createDataFrame(rows, "tool string, name string")


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records: one measured run per user of ``events``.

    ``tool`` cycles over four tools, ``config`` over two dataset variations,
    ``phase``/``query_ind`` over ingest and six cold and six hot searches;
    ``start``/``end`` span the user's events and ``result`` counts them.
    """
    ev = _read(spark, sf_dir, "events")
    runs = ev.groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"),
                                     F.count("*").alias("result"))
    uid = F.col("user_id")
    slot = (uid / 8).cast("bigint") % 13
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (uid % 4 + 1).cast("int"))
    config = F.when(uid % 8 < 4, F.lit("{}")).otherwise(F.lit('{"dataset_variation": "cleaned_log"}'))
    phase = F.when(slot == 0, F.lit("ingest")).when(slot <= 6, F.lit("cold")).otherwise(F.lit("hot"))
    qind = F.when(slot == 0, F.lit(None).cast("int")).otherwise(((slot - 1) % 6).cast("int"))
    return runs.select(uid.alias("run_id"), tool.alias("tool"), F.lit("mongod").alias("dataset"),
                       config.alias("config"), phase.alias("phase"), qind.alias("query_ind"),
                       "start", "end", "result")


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tool, doc``: one result document per run of ``bench_runs``.

    Stand-in measurements come from the run's events, kept integral so any
    summation order gives the same doubles: time = sum(int(value x 100))/100,
    memory = max(int(value x 100)) x 1e4 (-1, i.e. "no sample", every 7th run),
    sizes = 3000 / 1000 bytes per event (0 for every 50th run), result =
    events. Query entries sit at their position in the cold/hot lists.
    """
    ev = _read(spark, sf_dir, "events")
    cents = (F.col("value") * 100).cast("bigint")
    stats = ev.groupBy("user_id").agg(F.sum(cents).alias("s"), F.max(cents).alias("mx"))
    runs = bench_runs(spark, sf_dir).join(stats, F.col("run_id") == F.col("user_id")).drop("user_id")
    start = F.date_format("start", "yyyy-MM-dd HH:mm:ss")
    mem = F.when(F.col("run_id") % 7 == 0, F.lit(-1.0)).otherwise(F.col("mx") * 10000.0)
    ingest = F.struct((F.col("s") / 100.0).alias("time_taken_s"), mem.alias("memory_average_B"),
                      F.when(F.col("run_id") % 50 == 0, F.lit(0)).otherwise(F.col("result") * 1000)
                      .alias("compressed_size_B"),
                      (F.col("result") * 3000).alias("decompressed_size_B"), start.alias("start_time"))
    entry = F.struct((F.col("s") / 100.0).alias("time_taken_s"), mem.alias("memory_average_B"),
                     F.col("result").alias("result"), start.alias("start_time"))
    pos = F.concat(F.array_repeat(F.lit(None).cast(entry_type()), F.coalesce(F.col("query_ind"), F.lit(0))),
                   F.array(entry))
    body = F.struct(
        F.when(F.col("phase") == "ingest", ingest).alias("ingest"),
        F.when(F.col("phase") == "cold", pos).alias("query_cold"),
        F.when(F.col("phase") == "hot", pos).alias("query_hot"))
    doc = F.create_map(F.col("dataset"), F.create_map(F.col("config"), body))
    return runs.select("tool", F.to_json(doc).alias("doc"))


def entry_type() -> str:
    return "struct<time_taken_s:double,memory_average_B:double,result:bigint,start_time:string>"

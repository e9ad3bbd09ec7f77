"""Registered queries: parse policies, cleaning, time key, cross checks,
token predicates and the event projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.layouts import get_layout
from logvault.layouts.base import VariantResolver
from logvault.operators.flatten import leaf_paths
from logvault.operators.predicates import AtLeast, Eq, Exists, Match, MatchPhrase, WildcardToken
from logvault.operators.project import epoch_millis_ntz, project_event, timestamp_key
from logvault.operators.search import count_hits_many, cross_check, layout_diff, search
from logvault.plans import oracle
from logvault.plans.queries import EVENT_ID
from logvault.plans.standard import FIXTURE, searches
from logvault.session import configure
from logvault.sources.fixtures import event_log_lines
from logvault.sources.lines import clean_lines, parse_lines


def _mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log lines plus free-text conversation turns (not JSON)."""
    conv = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select(F.col("text").alias("line"))
    return event_log_lines(spark, sf_dir, spread=True).unionByName(conv)


def q_parse_policy(spark, sf_dir):
    """Rows kept and lines rejected under the skip and keep policies."""
    configure(spark)
    lines = _mixed_lines(spark, sf_dir)
    out = None
    for mode in ("skip", "keep"):
        parsed, rejected = parse_lines(lines, mode)
        n = parsed.select(F.lit(mode).alias("policy"), F.lit(1).alias("_r"), F.lit(0).alias("_x")).unionByName(
            rejected.select(F.lit(mode).alias("policy"), F.lit(0).alias("_r"), F.lit(1).alias("_x")))
        part = n.groupBy("policy").agg(F.sum("_r").cast("bigint").alias("n_rows"),
                                       F.sum("_x").cast("bigint").alias("n_rejected"))
        out = part if out is None else out.unionByName(part)
    return out


def q_clean_lines_b64(spark, sf_dir):
    """Dataset preparation: skip malformed lines, encode keys, re-serialise;
    the cleaned lines are parsed again and their leaves listed."""
    configure(spark)
    cleaned, _ = clean_lines(_mixed_lines(spark, sf_dir), "b64")
    parsed, _ = parse_lines(cleaned, "fail")
    df = parsed.select(VariantResolver(F.col("j")).integer(EVENT_ID).alias("event_id"), "j")
    return leaf_paths(df, "j", keep=["event_id"]).select("event_id", "path", "type")


def q_timestamp_key(spark, sf_dir):
    """Event time from ``t.$date`` (zone-free), as epoch milliseconds."""
    configure(spark)
    df = get_layout("variant").build(event_log_lines(spark, sf_dir))
    r = VariantResolver(F.col("j"))
    df = timestamp_key(df, r, "t.$date", "event_time", zoned=False)
    return df.select(r.integer(EVENT_ID).alias("event_id"), epoch_millis_ntz(F.col("event_time")).alias("event_ms"))


def q_cross_check(spark, sf_dir):
    """Two searches that must hit equally often (tickets vs numTrimmed)."""
    configure(spark)
    lay = get_layout("variant")
    df = lay.build(event_log_lines(spark, sf_dir))
    counts = count_hits_many(df, lay, {"a": Exists("attr.tickets"), "b": Exists("attr.numTrimmed")})
    return cross_check(counts, "a", "b")


def q_layout_diff(spark, sf_dir):
    """Q4 with absent ``msg`` kept (pairwise) vs dropped (variant)."""
    configure(spark)
    lines = event_log_lines(spark, sf_dir)
    pw, var = get_layout("pairwise"), get_layout("variant")
    return layout_diff(pw.build(lines), pw, searches("pairwise", FIXTURE)["q4"],
                       var.build(lines), var, searches("sql", FIXTURE)["q4"], EVENT_ID)


TOKEN_PREDS = {
    "match_phrase_msg": MatchPhrase("msg", "WiredTiger message"),
    "wildcard_ctx": WildcardToken("ctx", "conn1?"),
    "match_all_tokens": Match("attr.message.msg", "log_remove rec", op="and"),
    "at_least_two": AtLeast(2, (Match("ctx", "initandlisten"), Eq("c", "PURCHASE"), Exists("attr.tickets"))),
}
TOKEN_SQL = {
    "match_phrase_msg": "msg = 'WiredTiger message'",
    "wildcard_ctx": "regexp_full_match(lower(ctx), 'conn1.')",
    "match_all_tokens": "m_prefix = 'log_remove'",
    "at_least_two": ("CAST(ctx = 'initandlisten' AS INT) + CAST(c = 'PURCHASE' AS INT) "
                     "+ CAST(tickets IS NOT NULL AS INT) >= 2"),
}


def q_token(spark, sf_dir, key, layout_name="document"):
    """P11-P14 on the document index: rows ``event_id, id, ctx``."""
    configure(spark)
    lay = get_layout(layout_name)
    df = lay.build(event_log_lines(spark, sf_dir))
    hits = search(df, lay, TOKEN_PREDS[key])
    r = lay.resolver(hits)
    return hits.select(r.integer(EVENT_ID).alias("event_id"), r.integer("id").alias("id"), r.text("ctx").alias("ctx"))


def q_project_event(spark, sf_dir):
    """The fixed event projection of Q2's hits (``attr`` as JSON text)."""
    configure(spark)
    lay = get_layout("variant")
    df = lay.build(event_log_lines(spark, sf_dir))
    hits = search(df, lay, searches("sql", FIXTURE)["q2"])
    return project_event(hits, lay.resolver(hits))


def _token_query(key):
    def run(spark, sf_dir):
        return q_token(spark, sf_dir, key)
    run.__doc__ = f"P11-P14: token predicate {key} on the document layout."
    return run


QUERIES = {
    "parse_policy": q_parse_policy,
    "clean_lines_b64": q_clean_lines_b64,
    "timestamp_key": q_timestamp_key,
    "cross_check": q_cross_check,
    "layout_diff_q4": q_layout_diff,
    "project_event_q2": q_project_event,
}
QUERIES.update({f"token_{k}": _token_query(k) for k in TOKEN_PREDS})


def oracles() -> dict:
    from logvault.operators.keys import encode_name
    out = {
        "parse_policy": (
            "SELECT 'skip' AS policy, (SELECT count(*) FROM events) + "
            "(SELECT count(*) FROM conversations WHERE json_valid(text)) AS n_rows, "
            "(SELECT count(*) FROM conversations WHERE NOT json_valid(text)) AS n_rejected "
            "UNION ALL SELECT 'keep', (SELECT count(*) FROM events) + (SELECT count(*) FROM conversations), "
            "(SELECT count(*) FROM conversations WHERE NOT json_valid(text))"),
        "clean_lines_b64": oracle.leaf_rows(lambda k: encode_name(k, "b64")),
        "timestamp_key": (oracle.FIX + "SELECT event_id, epoch_ms(date_trunc('millisecond', ts)) AS event_ms FROM f"),
        "cross_check": (oracle.FIX + "SELECT count(*) FILTER (WHERE tickets IS NOT NULL) AS a, "
                        "count(*) FILTER (WHERE num_trimmed IS NOT NULL) AS b, "
                        "count(*) FILTER (WHERE tickets IS NOT NULL) = count(*) FILTER (WHERE num_trimmed IS NOT NULL)"
                        " AS equal FROM f"),
        "layout_diff_q4": (oracle.FIX + "SELECT event_id AS key, 'left_only' AS side FROM f WHERE ("
                           + oracle.SEARCH_SQL["q4_keep"] + ") AND NOT coalesce(" + oracle.SEARCH_SQL["q4_drop"]
                           + ", false)"),
    }
    out.update({f"token_{k}": oracle.search_rows(v) for k, v in TOKEN_SQL.items()})
    return out

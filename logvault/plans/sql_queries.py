"""Registered queries: the standard searches written as Spark SQL text over an
archive view (the SQL face; Spark's own parser and optimizer do the work)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from logvault.functions.sql import register_sql_functions
from logvault.layouts import get_layout
from logvault.plans import oracle
from logvault.session import configure, scratch_path
from logvault.sinks.writers import ingest
from logvault.sources.archive import read_archive
from logvault.sources.fixtures import event_log_lines

# The six searches in the SQL dialect over an inferred-struct
# archive (Q5 with the fixture's component and cutoff).
SQL_ON_STRUCT = {
    "q1": "attr.tickets IS NOT NULL",
    "q2": "id = 22419",
    "q3": "attr.message.msg LIKE 'log_release%' AND attr.message.session_name = 'connection'",
    "q4": "ctx = 'initandlisten' AND (msg != 'WiredTiger message' OR attr.message.msg LIKE 'log_remove%')",
    "q5": "c = 'PURCHASE' AND attr.message.ts_sec > 1704800000",
    "q6": "ctx = 'FlowControlRefresher' AND attr.numTrimmed = 0",
}
# The same six over a VARIANT archive with the lv_* SQL functions.
SQL_ON_VARIANT = {
    "q1": "lv_exists(j, '$.attr.tickets')",
    "q2": "lv_number(j, '$.id') = 22419",
    "q3": "lv_text(j, '$.attr.message.msg') LIKE 'log_release%' "
          "AND lv_text(j, '$.attr.message.session_name') = 'connection'",
    "q4": "lv_text(j, '$.ctx') = 'initandlisten' AND (lv_text(j, '$.msg') != 'WiredTiger message' "
          "OR lv_text(j, '$.attr.message.msg') LIKE 'log_remove%')",
    "q5": "lv_text(j, '$.c') = 'PURCHASE' AND lv_number(j, '$.attr.message.ts_sec') > 1704800000",
    "q6": "lv_text(j, '$.ctx') = 'FlowControlRefresher' AND lv_number(j, '$.attr.numTrimmed') = 0",
}
ORACLE_FORMS = {"q1": "q1", "q2": "q2", "q3": "q3_like", "q4": "q4_drop", "q5": "q5", "q6": "q6"}


def _sql_counts(spark: SparkSession, sf_dir: str, layout_name: str, preds: dict):
    configure(spark)
    register_sql_functions(spark)
    path = scratch_path(spark, f"sql-{layout_name}")
    ingest(event_log_lines(spark, sf_dir), get_layout(layout_name), path)
    view = f"logs_{layout_name}"
    read_archive(spark, path, layout_name, view=view)
    cols = ", ".join(f"count_if({p}) AS {q}" for q, p in preds.items())
    return spark.sql(f"SELECT {cols} FROM {view}")


def q_sql_inferred(spark, sf_dir):
    """The six searches as SQL text over the inferred-struct archive view."""
    return _sql_counts(spark, sf_dir, "inferred", SQL_ON_STRUCT)


def q_sql_variant(spark, sf_dir):
    """The six searches as SQL text over the VARIANT archive view (lv_* functions)."""
    return _sql_counts(spark, sf_dir, "variant", SQL_ON_VARIANT)


QUERIES = {"sql_search_inferred": q_sql_inferred, "sql_search_variant": q_sql_variant}


def oracles() -> dict:
    sql = oracle.search_counts(ORACLE_FORMS)
    return {"sql_search_inferred": sql, "sql_search_variant": sql}

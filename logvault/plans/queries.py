"""Registered queries: every operator group as a runnable DataFrame query.

Each builder takes ``(spark, sf_dir)`` and reads the driver tables (through
the fixtures), so its work grows with them.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from logvault.layouts import get_layout
from logvault.operators.search import count_hits_many, search
from logvault.plans import oracle
from logvault.plans.standard import FIXTURE, searches
from logvault.session import configure
from logvault.sources.fixtures import event_log_lines

EVENT_ID = "attr.event_id"

# Which predicate form of each search a layout is checked with:
# (query suffix, dialect, search key, oracle form).
SQL_FORMS = [
    ("q1", "sql", "q1", "q1"), ("q2", "sql", "q2", "q2"),
    ("q3_like", "sql", "q3", "q3_like"), ("q3_prefix", "kql", "q3", "q3_prefix"),
    ("q4_drop", "sql", "q4", "q4_drop"), ("q4_keep", "kql", "q4", "q4_keep"),
    ("q5", "sql", "q5", "q5"), ("q6", "sql", "q6", "q6"),
]
PAIRWISE_FORMS = [
    ("q1", "pairwise", "q1", "q1"), ("q2", "pairwise", "q2", "q2"),
    ("q3_like", "pairwise", "q3", "q3_like"), ("q3_prefix", "kql", "q3", "q3_prefix"),
    ("q4_drop", "sql", "q4", "q4_drop"), ("q4_keep", "pairwise", "q4", "q4_keep"),
    ("q5", "pairwise", "q5", "q5"), ("q6", "pairwise", "q6", "q6"),
]
ES_FORMS = [
    ("q1", "es", "q1", "q1"), ("q2", "es", "q2", "q2"), ("q3", "es", "q3", "q3_prefix"),
    ("q4", "es", "q4", "q4_keep"), ("q5", "es", "q5", "q5"), ("q6", "es", "q6", "q6"),
]
FORMS_OF_LAYOUT = {
    "json_string": SQL_FORMS, "inferred": SQL_FORMS, "merged": SQL_FORMS, "static_dynamic": SQL_FORMS,
    "variant": SQL_FORMS, "pairwise": PAIRWISE_FORMS, "document": ES_FORMS,
}


def layout_frame(spark: SparkSession, sf_dir: str, layout_name: str, **layout_kw):
    configure(spark)
    lay = get_layout(layout_name, **layout_kw)
    return lay, lay.build(event_log_lines(spark, sf_dir, spread=True))


def search_query(spark: SparkSession, sf_dir: str, layout_name: str, dialect: str, key: str) -> DataFrame:
    """Rows of one standard search on one layout: ``event_id, id, ctx``."""
    lay, df = layout_frame(spark, sf_dir, layout_name)
    hits = search(df, lay, searches(dialect, FIXTURE)[key])
    r = lay.resolver(hits)
    return hits.select(r.integer(EVENT_ID).alias("event_id"), r.integer("id").alias("id"),
                       r.text("ctx").alias("ctx"))


def count_query(spark: SparkSession, sf_dir: str, layout_name: str, **layout_kw) -> DataFrame:
    """Every search form of the layout counted in one scan."""
    lay, df = layout_frame(spark, sf_dir, layout_name, **layout_kw)
    preds = {suffix: searches(d, FIXTURE)[k] for suffix, d, k, _ in FORMS_OF_LAYOUT[layout_name]}
    return count_hits_many(df, lay, preds)


def variation_count_query(spark: SparkSession, sf_dir: str, variation: str) -> DataFrame:
    """A02 on a dataset variation (cleaned / base32 keys) in the variant layout."""
    from logvault.operators.predicates import encode_paths
    from logvault.sources.lines import VARIATIONS, dataset_variation
    configure(spark)
    lay = get_layout("variant")
    df = lay.build(dataset_variation(event_log_lines(spark, sf_dir, spread=True), variation))
    mode = VARIATIONS[variation]
    preds = {s: encode_paths(searches(d, FIXTURE)[k], mode) for s, d, k, _ in FORMS_OF_LAYOUT["variant"]}
    return count_hits_many(df, lay, preds)


def registry() -> tuple[dict, dict]:
    q, sql = {}, {}
    for layout_name, forms in FORMS_OF_LAYOUT.items():
        for suffix, dialect, key, oform in forms:
            name = f"search_{layout_name}_{suffix}"
            q[name] = partial(search_query, layout_name=layout_name, dialect=dialect, key=key)
            sql[name] = oracle.search_rows(oracle.SEARCH_SQL[oform])
        q[f"count_hits_{layout_name}"] = partial(count_query, layout_name=layout_name)
        sql[f"count_hits_{layout_name}"] = oracle.search_counts({s: o for s, _, _, o in forms})
    # dataset variations: keys encoded at read time, searches addressed to the encoded paths
    for variation in ("cleaned_log", "base32_log"):
        q[f"count_hits_variant_{variation}"] = partial(variation_count_query, variation=variation)
        sql[f"count_hits_variant_{variation}"] = oracle.search_counts(
            {s: o for s, _, _, o in FORMS_OF_LAYOUT["variant"]})
    q["count_hits_pairwise_native"] = partial(count_query, layout_name="pairwise")
    sql["count_hits_pairwise_native"] = sql["count_hits_pairwise"]
    from logvault.plans import catalog_queries
    q.update(catalog_queries.QUERIES)
    sql.update(catalog_queries.oracles())
    from logvault.plans import archive_queries
    q.update(archive_queries.QUERIES)
    sql.update(archive_queries.oracles())
    from logvault.plans import run_queries
    q.update(run_queries.QUERIES)
    sql.update(run_queries.oracles())
    from logvault.plans import stream_queries
    q.update(stream_queries.QUERIES)
    sql.update(stream_queries.oracles())
    from logvault.plans import more_queries
    q.update(more_queries.QUERIES)
    sql.update(more_queries.oracles())
    from logvault.plans import sql_queries
    q.update(sql_queries.QUERIES)
    sql.update(sql_queries.oracles())
    from logvault.plans import index_queries
    q.update(index_queries.QUERIES)
    sql.update(index_queries.oracles())
    from logvault.plans import item_queries
    q.update(item_queries.QUERIES)
    sql.update(item_queries.oracles())
    return q, sql

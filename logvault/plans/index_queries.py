"""Registered queries over the file index: searches on undeclared paths that read few files."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import functions as F

from logvault.layouts import get_layout
from logvault.operators.predicates import Eq, MatchPhrase, WildcardToken, all_of, any_of, ge, lt, not_
from logvault.plans import oracle
from logvault.plans.queries import EVENT_ID
from logvault.session import configure, scratch_path
from logvault.sinks.writers import ingest
from logvault.sources.file_index import indexed_search, write_file_index
from logvault.sources.fixtures import event_log_lines

MESSAGE = "attr.message.msg"
FILES = 20
# form -> (predicate, the same as SQL over the oracle's flat fields)
FORMS = {
    "eq_number": (Eq(EVENT_ID, 600), "event_id = 600"),
    "range": (all_of(ge(EVENT_ID, 300), lt(EVENT_ID, 340)), "event_id >= 300 AND event_id < 340"),
    "eq_text": (any_of(Eq(MESSAGE, "log_release: rec 600"), Eq(MESSAGE, "log_remove: rec 61")), "m_msg IN ('log_release: rec 600', 'log_remove: rec 61')"),
    "phrase": (MatchPhrase(MESSAGE, "Rec 601"), "m_msg LIKE '%: rec 601'"),
    "wildcard": (all_of(WildcardToken(MESSAGE, "60?"), not_(Eq(EVENT_ID, 606))), "regexp_matches(m_msg, ': rec 60[0-9]$') AND event_id <> 606"),
}


def clustered_archive(spark, sf_dir, layout_name: str) -> str:
    """The event log in files that follow the order of events, and its index."""
    configure(spark)
    lay = get_layout(layout_name)
    lines = event_log_lines(spark, sf_dir, spread=True)
    path = scratch_path(spark, f"indexed-{layout_name}")
    key = F.get_json_object("line", "$.attr.event_id").cast("bigint")
    ingest(lines.repartitionByRange(FILES, key), lay, path)
    write_file_index(spark, path, lay)
    return path


def q_indexed_search(spark, sf_dir, layout_name: str):
    """P03, P04, P09, P12-P14 on undeclared paths: files picked by the index, rows confirmed."""
    path, lay, parts = clustered_archive(spark, sf_dir, layout_name), get_layout(layout_name), []
    for form, (pred, _) in FORMS.items():
        hits = indexed_search(spark, path, lay, pred)
        r = lay.resolver(hits)
        parts.append(hits.select(F.lit(form).alias("form"), r.integer(EVENT_ID).alias("event_id"), r.integer("id").alias("id"), r.text("ctx").alias("ctx")))
    return reduce(lambda a, b: a.unionByName(b), parts)


LAYOUTS = ("variant", "document", "static_dynamic")
QUERIES = {f"indexed_search_{n}": partial(q_indexed_search, layout_name=n) for n in LAYOUTS}


def oracles() -> dict:
    rows = " UNION ALL ".join(f"SELECT '{form}' AS form, event_id, id, ctx FROM f WHERE {sql}" for form, (_, sql) in FORMS.items())
    return {f"indexed_search_{n}": oracle.FIX + rows for n in LAYOUTS}

"""A01, R10, R11, N13 on small literal inputs."""

import json

from logvault.layouts import get_layout
from logvault.operators import predicates as P
from logvault.operators.project import project_event, select_all
from logvault.operators.search import count_hits, count_hits_many, cross_check, layout_diff, search

DOCS = [{"k": 1, "msg": "a"}, {"k": 2}, {"k": 3, "msg": "b", "t": {"$date": "x"}, "attr": {"z": [1]},
                                          "tags": ["q"], "id": 9, "c": "C", "s": "I", "ctx": "m"}]


def frames(spark, *names):
    lines = spark.createDataFrame([(json.dumps(d),) for d in DOCS], "line string")
    return [(get_layout(n), get_layout(n).build(lines)) for n in names]


def test_count_hits(spark):
    (lay, df), = frames(spark, "variant")
    assert count_hits(df, lay, P.Exists("msg")) == 2
    assert select_all(df) is df


def test_cross_check(spark):
    (lay, df), = frames(spark, "variant")
    counts = count_hits_many(df, lay, {"a": P.Exists("msg"), "b": P.Cmp("k", "gt", 1)})
    row = cross_check(counts, "a", "b").first()
    assert (row["a"], row["b"], row["equal"]) == (2, 2, True)


def test_layout_diff_explains_absent_semantics(spark):
    (pl, pw), (vl, var) = frames(spark, "pairwise", "variant")
    keep, drop = P.Ne("msg", "a", absent="keep"), P.Ne("msg", "a", absent="drop")
    rows = sorted(tuple(r) for r in layout_diff(pw, pl, keep, var, vl, drop, "k").collect())
    assert rows == [(2, "left_only")]  # the event without msg is kept by one form only
    assert layout_diff(pw, pl, drop, var, vl, drop, "k").count() == 0


def test_layout_diff_of_text_and_missing_keys(spark):
    docs = [{"n": "a", "m": 1}, {"n": "b", "m": 2}, {"m": 1}, {"m": 3}]
    lines = spark.createDataFrame([(json.dumps(d),) for d in docs], "line string")
    pl, vl = get_layout("pairwise"), get_layout("variant")
    pw, var = pl.build(lines), vl.build(lines)
    every, small = P.Cmp("m", "gt", 0), P.Cmp("m", "lt", 3)
    assert layout_diff(pw, pl, every, var, vl, every, "n", "string").count() == 0
    assert [tuple(r) for r in layout_diff(pw, pl, every, var, vl, small, "n", "string").collect()] == [(None, "left_only")]
    rows = layout_diff(pw, pl, P.Eq("n", "a"), var, vl, P.Eq("n", "b"), "n", "string").collect()
    assert sorted(map(tuple, rows)) == [("a", "left_only"), ("b", "right_only")]


def test_project_event_keeps_large_ids(spark):
    lines = spark.createDataFrame([('{"id": 9007199254740993}',)], "line string")
    lay = get_layout("variant")
    df = lay.build(lines)
    assert project_event(df, lay.resolver(df)).first()["id"] == 9007199254740993


def test_project_event(spark):
    (lay, df), = frames(spark, "variant")
    hits = search(df, lay, P.Eq("k", 3))
    row = project_event(hits, lay.resolver(hits)).first().asDict()
    assert row["msg"] == "b" and row["t_date"] == "x" and row["id"] == 9
    assert json.loads(row["attr"]) == {"z": [1]} and json.loads(row["tags"]) == ["q"]

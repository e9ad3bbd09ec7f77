"""Literal edge cases for P01-P15 on every layout (absent vs null, mixed types,
LIKE vs literal prefix, special keys, token predicates)."""

import pytest
from pyspark.sql import functions as F

from logvault.layouts import get_layout
from logvault.operators import predicates as P
from logvault.operators.search import search

DOCS = [
    '{"k": 1, "msg": "WiredTiger message", "a": {"b": "log_release: x", "n": 5}, "t": {"$date": "2024-01-01T00:00:00.000"}}',
    '{"k": 2, "a": {"b": "logXrelease: y", "n": 7.5}, "tags": null}',
    '{"k": 3, "msg": "Slow query", "a": {"b": "log_remove", "n": "12"}, "bad key-name": [1, 2]}',
    '{"k": 4, "msg": null, "a": {"b": {"errmsg": "boom"}, "tickets": null}, "ok": true}',
    '{"k": 5, "msg": "slow query now", "a": {}, "arr": [], "Err": 1, "err": 2}',
]
LAYOUTS = ["json_string", "pairwise", "inferred", "variant", "document"]


def keys(spark, lines_df, layout, pred):
    lay = get_layout(layout)
    df = lay.build(lines_df(DOCS))
    hits = search(df, lay, pred)
    return sorted(int(r[0]) for r in hits.select(lay.resolver(hits).integer("k")).collect())


CASES = [
    (P.Exists("msg"), [1, 3, 5]),                       # JSON null is not present
    (P.Missing("msg"), [2, 4]),
    (P.Exists("a"), [1, 2, 3, 4, 5]),                    # an object counts
    (P.Exists("a.tickets"), []),
    (P.Exists("tags"), []),
    (P.Eq("a.n", 5), [1]),
    (P.Eq("a.n", 12), [3]),                              # numeric text counts as its number
    (P.Ne("msg", "WiredTiger message", absent="drop"), [3, 5]),
    (P.Ne("msg", "WiredTiger message", absent="keep"), [2, 3, 4, 5]),
    (P.Prefix("a.b", "log_re"), [1, 3]),
    (P.Like("a.b", "log_re%"), [1, 2, 3]),               # logXrelease matches too
    (P.Like("a.b", "log_release%"), [1, 2]),             # '_' is a wildcard in LIKE
    (P.Prefix("a.b", "log_release"), [1]),               # literal in prefix
    (P.Cmp("a.n", "gt", 6), [2, 3]),
    (P.Cmp("a.n", "le", 5), [1]),
    (P.all_of(P.Exists("msg"), P.Cmp("k", "ge", 3)), [3, 5]),
    (P.any_of(P.Eq("k", 1), P.Eq("k", 2)), [1, 2]),
    (P.not_(P.Eq("k", 1)), [2, 3, 4, 5]),
    (P.AtLeast(2, (P.Exists("msg"), P.Cmp("k", "gt", 2), P.Exists("ok"))), [3, 4, 5]),
    (P.Match("msg", "slow"), [3, 5]),
    (P.Match("msg", "slow message", op="and"), []),
    (P.MatchPhrase("msg", "slow query"), [3, 5]),
    (P.MatchPhrase("msg", "query slow"), []),
    (P.WildcardToken("a.b", "log_rel*"), [1]),
    (P.WildcardToken("msg", "qu?ry"), [3, 5]),
    (P.Eq("bad key-name[1]", 2), [3]),
    (P.Eq("t.$date", "2024-01-01T00:00:00.000"), [1]),
    (P.Eq("Err", 1), [5]),                               # case-sensitive keys
    (P.Eq("err", 2), [5]),
]


# The pairwise layout stores leaves only: an empty object leaves no trace.
LAYOUT_EXCEPTIONS = {("pairwise", P.Exists("a")): [1, 2, 3, 4]}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_predicates_agree_on_every_layout(spark, lines_df, layout):
    lay = get_layout(layout)
    df = lay.build(lines_df(DOCS))
    r = lay.resolver(df)
    flags = [F.coalesce(pred.column(r), F.lit(False)).alias(f"c{i}") for i, (pred, _) in enumerate(CASES)]
    rows = df.select(r.integer("k").alias("k"), *flags).collect()
    for i, (pred, want) in enumerate(CASES):
        want = LAYOUT_EXCEPTIONS.get((layout, pred), want)
        got = sorted(int(row["k"]) for row in rows if row[f"c{i}"])
        assert got == want, (layout, pred)


def test_has_bucket(spark, lines_df):
    for layout in ["pairwise", "variant", "json_string"]:
        assert keys(spark, lines_df, layout, P.HasBucket("a.n", "int")) == [1], layout
        assert keys(spark, lines_df, layout, P.HasBucket("a.n", "float")) == [2], layout
        assert keys(spark, lines_df, layout, P.HasBucket("a.n", "string")) == [3], layout


def test_prefix_pushes_down_and_like_with_underscore_does_not(spark, tmp_path, lines_df):
    lay = get_layout("inferred")
    df = lay.build(lines_df(DOCS))
    p = str(tmp_path / "l3")
    lay.write(df, p)
    back = lay.read(spark, p)
    pushed = search(back, lay, P.Prefix("msg", "Slow"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(msg,Slow)" in pushed
    assert search(back, lay, P.Eq("k", 3)).count() == 1
    assert "EqualTo(k,3)" in search(back, lay, P.Eq("k", 3))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,3)" in search(back, lay, P.Cmp("k", "gt", 3))._jdf.queryExecution().executedPlan().toString()
    like = search(back, lay, P.Like("msg", "Slow_q%"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(msg,Slow_q)" not in like


def test_variant_filter_reads_only_requested_field(spark, tmp_path, lines_df):
    lay = get_layout("variant")
    p = str(tmp_path / "l5")
    lay.write(lay.build(lines_df(DOCS)), p)
    back = lay.read(spark, p)
    q = search(back, lay, P.Eq("k", 3)).select(F.lit(1))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan
    assert q.count() == 1


def test_static_integer_column_keeps_only_integral_values(spark, lines_df):
    lay = get_layout("static_dynamic")
    df = lay.build(lines_df(['{"id": 22419}', '{"id": 22419.5}', '{"id": "22419"}', '{"id": 1e3}']))
    assert sorted((r["id"] for r in df.collect()), key=lambda x: (x is None, x)) == [1000, 22419, 22419, None]
    assert search(df, lay, P.Eq("id", 22419)).count() == 2


def test_integer_accessor_is_exact_on_every_layout(spark, lines_df):
    docs = ['{"id": 1, "attr": {"n": 7}}', '{"id": 2, "attr": {"n": 7.5}}', '{"id": 3, "attr": {"n": "8"}}']
    for name in LAYOUTS + ["static_dynamic"]:
        lay = get_layout(name)
        df = lay.build(lines_df(docs))
        r = lay.resolver(df)
        rows = df.select(r.integer("id").alias("k"), r.integer("attr.n").alias("n")).collect()
        assert {row["k"]: row["n"] for row in rows} == {1: 7, 2: None, 3: 8}, name


EDGE_DOCS = [
    '{"k": 1, "id": 1, "f": 1.0000001, "ok": true, "attr": {"f": 1.0000001, "ok": true, "s": "1.0000004"}, "tags": ["q"]}',
    '{"k": 2, "id": 2, "f": 1.0, "ok": false, "attr": {"f": 1.0, "ok": false, "s": "1"}, "t": {"$date": "2024-01-01T00:00:00.000+01:00"}}',
    '{"k": 3, "id": 3, "f": 2, "ok": true, "attr": {"f": 2, "ok": true, "s": "x"}, "extra": {"deep": {"n": 7}}}',
]
EDGE_CASES = [
    (P.Eq("f", 1), [2]),                        # no rounding
    (P.Eq("attr.f", 1), [2]),
    (P.Eq("attr.s", 1), [2]),
    (P.Ne("attr.f", 1), [1, 3]),
    (P.Eq("attr.ok", 1), []),                   # a boolean is no number
    (P.Eq("ok", 1), []),
    (P.Cmp("ok", "ge", 0), []),
    (P.Eq("ok", True), [1, 3]),
    (P.Exists("tags"), [1]),                    # undeclared fields are kept
    (P.not_(P.Exists("tags")), [2, 3]),
    (P.Eq("extra.deep.n", 7), [3]),
    (P.Exists("t"), [2]),                       # parent of a static field
    (P.Eq("t.$date", "2024-01-01T00:00:00.000+01:00"), [2]),
    (P.Cmp("t.$date", "gt", 5), []),
]


@pytest.mark.parametrize("layout", LAYOUTS + ["static_dynamic"])
def test_edge_values_agree_on_every_layout(spark, lines_df, layout):
    lay = get_layout(layout)
    df = lay.build(lines_df(EDGE_DOCS))
    r = lay.resolver(df)
    flags = [F.coalesce(pred.column(r), F.lit(False)).alias(f"c{i}") for i, (pred, _) in enumerate(EDGE_CASES)]
    rows = df.select(r.integer("k").alias("k"), *flags).collect()
    for i, (pred, want) in enumerate(EDGE_CASES):
        assert sorted(int(row["k"]) for row in rows if row[f"c{i}"]) == want, (layout, pred)


def test_static_dynamic_has_buckets_of_undeclared_and_timestamp_fields(spark, lines_df):
    assert keys(spark, lines_df, "static_dynamic", P.HasBucket("t.$date", "string")) == [1]
    assert keys(spark, lines_df, "static_dynamic", P.HasBucket("a.n", "float")) == [2]


def test_integer_equality_is_exact_beyond_double_precision(spark, lines_df):
    # integers only: inferring a schema over ints and floats stores DOUBLE (L3)
    ints = ['{"k": 1, "big": 9007199254740993}', '{"k": 2, "big": 9007199254740992}']
    mixed = ['{"k": 3, "big": 5.0}', '{"k": 4, "big": 6}']
    for name in ["json_string", "pairwise", "inferred", "variant", "document"]:
        lay = get_layout(name)
        for docs, lit, want in ((ints, 9007199254740993, [1]), (mixed, 5, [3])):
            df = lay.build(lines_df(docs))
            hits = search(df, lay, P.Eq("big", lit))
            assert sorted(r[0] for r in hits.select(lay.resolver(hits).integer("k")).collect()) == want, name

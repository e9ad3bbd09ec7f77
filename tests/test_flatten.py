"""Documents with their expected leaves written out, the documented
example, edge cases and agreement of the two forms on generated documents."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logvault.layouts import get_layout
from logvault.operators.flatten import leaf_paths, leaf_paths_recursive, path_catalog


def spark_leaves(spark, docs, depth=8):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, line string")
    df = df.select("i", F.parse_json("line").alias("j"))
    rows = leaf_paths(df, "j", keep=["i"], depth=depth).collect()
    out = {i: [] for i in range(len(docs))}
    for r in rows:
        out[r["i"]].append((r["path"], r["type"]))
    return out


def test_documented_example(spark, lines_df):
    lines = ['{"msg": {"ts": 1, "status": "error"}}',
             '{"msg": {"ts": 4, "status": "", "thread_num": 4, "backtrace": ""}}']
    pw = get_layout("pairwise").build(lines_df(lines)).collect()
    assert sorted(pw[1]["string_columns"]) == ["msg.backtrace", "msg.status"]
    assert sorted(zip(pw[1]["int_columns"], pw[1]["int_values"])) == [("msg.thread_num", 4), ("msg.ts", 4)]
    assert pw[0]["float_columns"] == [] and pw[0]["bool_columns"] == []


def test_edge_leaves(spark):
    cases = [({"a": None}, []), ({"a": {}}, []), ({"a": []}, []),
             ({"b": True, "c": 1, "d": 1.0, "e": 1e3, "f": "x"},
              [("b", "bool"), ("c", "int"), ("d", "float"), ("e", "float"), ("f", "string")]),
             ({"g": [[1, {"h": [False]}]], "k y": {"$z": 2}}, [("g[0][0]", "int"), ("g[0][1].h[0]", "bool"), ("k y.$z", "int")]),
             ({"a": [{"b": "{[{["}, None, "t"]}, [("a[0].b", "string"), ("a[2]", "string")])]
    for depth in (8, None):
        got = spark_leaves(spark, [d for d, _ in cases], depth)
        for i, (d, want) in enumerate(cases):
            assert sorted(got[i]) == want, d


def test_int_beyond_64_bits_is_a_float_leaf(spark):
    """One such integer ends neither an ingest nor a catalogue nor a search."""
    from logvault.layouts import get_layout
    from logvault.operators.predicates import HasBucket
    from logvault.operators.search import search
    lines = spark.createDataFrame([('{"a": 123456789012345678901}',), ('{"a": 7}',)], "line string")
    got = leaf_paths(lines.select(F.parse_json("line").alias("j")), "j").collect()
    assert sorted((r.path, r.type, r.value) for r in got) == [("a", "float", "123456789012345678901"), ("a", "int", "7")]
    for name in ("variant", "pairwise", "document"):
        lay = get_layout(name)
        assert search(lay.build(lines), lay, HasBucket("a", "float")).count() == 1
        assert search(lay.build(lines), lay, HasBucket("a", "int")).count() == 1


def test_depth_guard(spark):
    deep = {"a": {"b": {"c": {"d": 1}}}}
    df = spark.createDataFrame([(json.dumps(deep),)], "line string").select(F.parse_json("line").alias("j"))
    with pytest.raises(Exception, match="deeper than 2"):
        leaf_paths(df, "j", depth=2).collect()
    assert len(leaf_paths(df, "j", depth=4).collect()) == 1


json_scalars = st.one_of(st.none(), st.booleans(), st.integers(-2**63, 2**63 - 1),
                         st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=5))
json_docs = st.recursive(json_scalars, lambda ch: st.one_of(
    st.lists(ch, max_size=3), st.dictionaries(st.text("abc $-_", min_size=1, max_size=3), ch, max_size=3)),
    max_leaves=12)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.text("xyz", min_size=1, max_size=2), json_docs, max_size=4),
                min_size=1, max_size=6))
def test_forms_agree(spark, docs):
    """The in-row walk, the recursive query and the pairwise layout find the same leaves."""
    lines = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, line string")
    rows = {r["i"]: r for r in get_layout("pairwise").build(lines).collect()}
    query = leaf_paths_recursive(lines.select("i", F.parse_json("line").alias("j")), "j", ["i"]).collect()
    got = spark_leaves(spark, docs, None)
    for i in range(len(docs)):
        assert sorted(got[i]) == sorted((r["path"], r["type"]) for r in query if r["i"] == i)
        assert sorted(got[i]) == sorted((p, b) for b in ("string", "int", "float", "bool") for p in rows[i][f"{b}_columns"])


def test_no_depth_bound(spark, lines_df):
    deep = "[" * 64 + '{"b": [true, null, "x"]}' + "]" * 64
    line = '{"a": ' + deep + "}"
    row = get_layout("pairwise").build(lines_df([line])).collect()[0]
    assert row["bool_columns"] == ["a" + "[0]" * 64 + ".b[0]"] and row["string_columns"] == ["a" + "[0]" * 64 + ".b[2]"]


def test_path_catalog_static_flag(spark):
    docs = [{"a": 1, "b": "x"}, {"a": 2}, {"a": 3, "b": 1}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "line string").select(
        F.parse_json("line").alias("j"))
    cat = {(r["path"], r["type"]): (r["n_rows"], r["is_static"]) for r in path_catalog(df, "j").collect()}
    assert cat == {("a", "int"): (3, True), ("b", "string"): (1, False), ("b", "int"): (1, False)}


def test_non_json_constants_are_malformed(spark):
    lines = spark.createDataFrame([('{"a": NaN}',)], "line string")
    with pytest.raises(Exception):
        get_layout("pairwise").build(lines).collect()


def test_documented_static_and_dynamic_fields(spark):
    from logvault.layouts.base import VariantResolver
    from logvault.operators.project import timestamp_key
    lines = ['{"t":"2023-03-21T23:34:54.576-04:00","s":"I","msg":"Initialized wire specification",'
             '"isInternalClient":true}',
             '{"t":"2023-03-21T23:35:12.123-04:00","s":"W","msg":"Connection timeout","timeoutMillis":5000}']
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.parse_json("line").alias("j"))
    cat = {(r["path"], r["type"]): r["is_static"] for r in path_catalog(df, "j").collect()}
    assert cat == {("t", "string"): True, ("s", "string"): True, ("msg", "string"): True,
                   ("isInternalClient", "bool"): False, ("timeoutMillis", "int"): False}
    times = timestamp_key(df, VariantResolver(F.col("j")), "t").select(
        F.date_format(F.col("event_time"), "yyyy-MM-dd HH:mm:ss.SSS").alias("utc")).collect()
    assert [r["utc"] for r in times] == ["2023-03-22 03:34:54.576", "2023-03-22 03:35:12.123"]


def test_layout_facts(spark):
    from logvault.plans.advice import layout_facts
    mixed = spark.createDataFrame([("a", "int"), ("a", "string"), ("b", "int")], "path string, type string")
    assert layout_facts(mixed).first().asDict() == {"n_paths": 2, "n_conflicts": 1}
    assert layout_facts(mixed.limit(0)).first().asDict() == {"n_paths": 0, "n_conflicts": 0}

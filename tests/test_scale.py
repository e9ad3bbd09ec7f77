"""Plan-shape and skew checks: what must hold at 1000x the data."""

import json

from pyspark.sql import functions as F

from logvault.layouts import get_layout
from logvault.operators.flatten import path_catalog
from logvault.operators.predicates import Eq, Prefix
from logvault.operators.runs import related_samples
from logvault.operators.search import count_hits_many, search
from logvault.sinks.writers import ordered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_split_over_ranges(spark):
    # one key holds a third of all rows
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                     .otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"),
                                     F.col("id").alias("t"))
    parts = ordered(df, ["k"], timestamp_key="t", partitions=6).rdd.glom().map(
        lambda rows: sum(1 for r in rows if r["k"] == "hot")).collect()
    assert sum(parts) == 1000
    assert sum(1 for n in parts if n > 0) >= 2
    assert max(parts) < 1000


def test_catalog_combines_map_side(spark):
    docs = [json.dumps({"a": i, "b": {"c": "x"}}) for i in range(50)]
    df = spark.createDataFrame([(d,) for d in docs], "line string").select(F.parse_json("line").alias("j"))
    p = plan(path_catalog(df, "j"))
    assert "partial_count" in p and "Exchange hashpartitioning(path" in p


def test_all_searches_one_scan(spark, lines_df):
    lay = get_layout("variant")
    df = lay.build(lines_df(['{"a": 1, "b": "xy"}', '{"a": 2}']))
    q = count_hits_many(df, lay, {"x": Eq("a", 1), "y": Prefix("b", "x"), "z": Eq("a", 2)})
    assert plan(q).count("Scan") == 1
    assert q.first().asDict() == {"x": 1, "y": 1, "z": 1}


def test_no_shuffle_in_searches(spark, tmp_path, lines_df):
    for name in ["json_string", "pairwise", "inferred", "static_dynamic", "variant", "document"]:
        lay = get_layout(name)
        p = str(tmp_path / name)
        lay.write(lay.build(lines_df(['{"id": 1, "ctx": "x"}'])), p)
        df = lay.read(spark, p)
        assert "Exchange" not in plan(search(df, lay, Eq("id", 1))), name


def test_related_join_is_a_hash_semi_join(spark):
    # no nested loop over samples and names, and no forced broadcast
    samples = spark.createDataFrame([(1, "java"), (2, "bash"), (3, "ja"), (4, ""), (5, None), (6, "javax")],
                                    "run_id long, command string")
    related = spark.createDataFrame([("t", "java"), ("u", "bash"), ("t", None)], "tool string, name string")
    got = related_samples(samples, related, "t")
    assert sorted(r["run_id"] for r in got.collect()) == [1, 3, 4]
    assert got.columns == samples.columns
    p = plan(got)
    assert "NestedLoop" not in p and "LeftSemi" in p


def test_hot_key_without_a_time_key_is_split(spark):
    # every row has the same key, half of them are equal in every column
    df = spark.range(0, 2000, numPartitions=4).select(
        F.lit("hot").alias("k"), F.greatest(F.col("id"), F.lit(1000)).alias("v"))
    sizes = ordered(df, ["k"], partitions=4).rdd.glom().map(len).collect()
    assert sum(sizes) == 2000 and max(sizes) < 1000


HOT = (("id", "number"), ("c", "text"), ("attr.ts", "number"))


def scanned_rows(df):
    """Rows that left the Parquet scan of a collected query."""
    df.collect()
    p = df._jdf.queryExecution().executedPlan()
    leaves = p.collectLeaves() if not p.getClass().getSimpleName().startswith("AdaptiveSpark") else \
        p.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_hot_columns_skip_row_groups(spark, tmp_path):
    from logvault.operators.predicates import all_of, gt
    from logvault.sinks.writers import write_ordered
    n = 20000
    lines = spark.range(0, n, numPartitions=4).select(F.to_json(F.struct(
        F.col("id"), F.concat(F.lit("c"), (F.col("id") % 20).cast("string")).alias("c"),
        F.struct((F.col("id") * 7 % n).alias("ts")).alias("attr"))).alias("line"))
    for name in ["variant", "static_dynamic"]:
        lay = get_layout(name, hot=HOT)
        for keys, pred, want in [(["hot_number_id"], Eq("id", 7777), 1),
                                 (["hot_text_c", "hot_number_attr_ts"],
                                  all_of(Eq("c", "c3"), gt("attr.ts", n - 2000)), None)]:
            p = str(tmp_path / f"{name}-{len(keys)}")
            write_ordered(lay.build(lines), lay, p, keys=keys, row_group_rows=200)
            plain = get_layout(name)
            expect = search(plain.build(lines), plain, pred).count()
            hits = search(lay.read(spark, p), lay, pred)
            rows = scanned_rows(hits)
            assert hits.count() == expect and (want is None or expect == want), name
            assert 0 < expect <= rows < n / 10, (name, rows)


def test_hot_columns_change_no_result(spark, lines_df):
    from logvault.operators.predicates import Exists, Ne, ge
    docs = ['{"id": 1, "c": "x", "attr": {"ts": 1.0000001}}', '{"id": "1", "c": {"a": 1}}', '{"id": true, "c": null}',
            '{"id": 9007199254740993, "attr": {"ts": "5"}}', '{}', '{"id": 9007199254740992, "c": "1"}']
    preds = [Eq("id", 1), Eq("id", 9007199254740993), Eq("c", "x"), Eq("c", 1), Ne("c", "x"), Ne("c", "x", absent="keep"),
             Prefix("c", "{"), ge("attr.ts", 1), Eq("attr.ts", 1), Exists("c"), Exists("attr")]
    for name in ["variant", "static_dynamic", "document"]:
        plain, hot = get_layout(name), get_layout(name, hot=HOT)
        a, b = plain.build(lines_df(docs)), hot.build(lines_df(docs))
        for pred in preds:
            assert search(a, plain, pred).count() == search(b, hot, pred).count(), (name, pred)


def test_a_document_is_flattened_once(spark, lines_df):
    # a filter on the arrays, or the explode of the leaves, must not flatten the document again
    from logvault.operators.flatten import leaf_paths, path_catalog, with_leaves
    lines = lines_df(['{"a": {"b": [1, {"c": "xy"}]}, "d": true}', '{"a": null}'])
    lay = get_layout("pairwise")
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    docs = lines.select(F.parse_json("line").alias("j"))
    once = steps(with_leaves(docs, "j"))
    hits = search(lay.build(lines), lay, Prefix("a.b[1].c", "x") & Eq("d", True))
    assert steps(hits) == once
    assert [r["string_columns"] for r in hits.collect()] == [["a.b[1].c"]]
    assert steps(leaf_paths(docs, "j")) == once
    assert steps(path_catalog(docs, "j")) == once
    assert sorted(leaf_paths(docs, "j").select("path", "value").collect()) == [("a.b[0]", "1"), ("a.b[1].c", "xy"), ("d", "true")]


def test_levels_beyond_the_near_ones(spark, lines_df):
    from logvault.operators.flatten import NEAR_LEVELS, leaf_paths
    deep = [n for n in range(NEAR_LEVELS - 2, NEAR_LEVELS + 3)] + [40]
    lines = lines_df(['{"a":' * n + "7" + "}" * n for n in deep])
    got = leaf_paths(lines.select(F.parse_json("line").alias("j")), "j").collect()
    assert sorted((r["path"], r["type"], r["value"]) for r in got) == sorted((".".join("a" * n), "int", "7") for n in deep)


def test_a_document_is_normalised_once(spark, lines_df):
    lines = lines_df(['{"id": 1, "c": "x y", "attr": {"error": "full"}}', '{"id": 2}'])
    for name in ("document", "variant"):
        lay = get_layout(name)
        parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("line#")
        df = lay.build(lines)
        hits = search(df, lay, Prefix("c", "x") & Eq("id", 1))
        assert parses(hits) <= parses(df), name
        assert hits.select(lay.resolver(hits).text("c")).collect() == [("x y",)]


def test_documents_of_one_row_group_are_spread_over_tasks(spark, tmp_path, monkeypatch):
    """A table in one row group is one task of a scan; the work on its documents gets more, filters on lines as well."""
    from logvault.plans.catalog_queries import q_encode_keys_b64
    from logvault.sources import fixtures
    from logvault.sources.lines import clean_lines
    rows = [(i, None if i % 9 == 0 else i % 5, ("click", "view", "error")[i % 3], i / 4, f'{{"k": {i % 7}}}') for i in range(300)]
    ev = spark.createDataFrame(rows + rows[:20], "event_id bigint, user_id bigint, event_type string, value double, props string")
    ev = ev.withColumn("ts", F.timestamp_seconds(F.col("event_id")).cast("timestamp_ntz"))
    ev.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    plain = sorted(r["line"] for r in fixtures.event_log_lines(spark, str(tmp_path)).collect())
    leaves = sorted(map(tuple, q_encode_keys_b64(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 50)
    lines = fixtures.event_log_lines(spark, str(tmp_path), spread=True)
    assert lines.rdd.getNumPartitions() == 7
    assert sorted(r["line"] for r in lines.collect()) == plain
    assert sorted(map(tuple, q_encode_keys_b64(spark, str(tmp_path)).collect())) == leaves
    plan = clean_lines(lines)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan[plan.index("Repartition"):]

"""S01-S08 sources and policies, writers, A03-A05, A11, R09."""

import os

import pytest
from pyspark.sql import functions as F

from logvault.operators.quality import (
    archive_size, compression_ratio, ingest_speed, line_count_check, ratio_label, roundtrip_diff,
    roundtrip_report,
)
from logvault.sinks.writers import ingest, ordered, restore, write_raw
from logvault.sources.archive import read_archive
from logvault.sources.catalog import catalog_frame, read_catalog
from logvault.sources.json import read_json_declared, read_json_inferred, read_json_variant
from logvault.sources.lines import drop_blank, parse_lines, read_lines


def write_text(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_read_lines_blank_rules(spark, tmp_path):
    p = str(tmp_path / "a" / "x.log")
    write_text(p, ['{"a":1}', "", "   ", "\t", '{"a":2}'])
    assert read_lines(spark, p).count() == 4
    assert read_lines(spark, p, blank="whitespace").count() == 2
    assert read_lines(spark, str(tmp_path / "a" / "*.log"), provenance=True).columns == ["line", "source_file"]


def test_parse_policies(spark, lines_df):
    df = lines_df(['{"a":1}', "nope", '{"a": 1, "a": 2}'])
    parsed, rejected = parse_lines(df, "skip")
    assert parsed.count() == 2 and rejected.count() == 1
    # duplicate keys: the last value wins, as with Python's json.loads
    assert parsed.filter(F.col("line").contains('"a": 2')).select(
        F.try_variant_get("j", "$.a", "int")).first()[0] == 2
    kept, _ = parse_lines(df, "keep")
    assert kept.count() == 3 and kept.filter(F.col("j").isNull()).count() == 1
    failing, _ = parse_lines(df, "fail")
    with pytest.raises(Exception):
        failing.collect()


def test_json_sources(spark, tmp_path):
    p = str(tmp_path / "d" / "x.log")
    write_text(p, ['{"t":{"$date":"2024-01-01T00:00:00.000+00:00"},"s":"I","c":"A","id":1,"ctx":"x",'
                   '"msg":"m","attr":{"k":1},"tags":["q"]}', "bad", '{"Err":1,"err":2}'])
    inf = read_json_inferred(spark, p)
    assert {"Err", "err", "attr", "_corrupt_record"} <= set(inf.columns)
    dec = read_json_declared(spark, p)
    assert dec.columns == ["t_date", "s", "c", "id", "ctx", "msg", "attr", "rest_fields"]
    assert dec.filter(F.col("id") == 1).count() == 1
    var, rej = read_json_variant(spark, p)
    assert var.count() == 2 and rej.count() == 1


def test_catalog(spark, tmp_path):
    write_text(str(tmp_path / "cat" / "mongod" / "metadata.yaml"),
               ["source: mongod", "number_of_lines: 3", "timestamp: t.$date", "normal_log: mongod.log",
                "cleaned_log: mongod_clean.log", "base32_log: mongod_b32.log"])
    cat = read_catalog(spark, str(tmp_path / "cat" / "*" / "metadata.yaml")).collect()
    assert len(cat) == 1 and cat[0]["dataset"] == "mongod" and cat[0]["number_of_lines"] == 3
    assert cat[0]["timestamp_key"] == "t.$date"


def test_roundtrip_and_sizes(spark, tmp_path, lines_df):
    lines = lines_df(['{"a":1}', '{"a":1}', '{"b":[1,2]}'])
    p = str(tmp_path / "raw")
    write_raw(lines, p, "gzip")
    back = restore(spark, p)
    row = roundtrip_report(lines, back).first()
    assert (row["n_original"], row["n_restored"], row["equal"]) == (3, 3, True)
    changed = lines_df(['{"a":1}', '{"b":[1,2]}', '{"c":0}'])
    assert roundtrip_report(lines, changed).first()["equal"] is False
    assert sorted(tuple(r) for r in roundtrip_diff(lines, changed).collect()) == [
        ('{"a":1}', "missing"), ('{"c":0}', "extra")]
    assert archive_size(spark, p) > 0
    assert archive_size(spark, str(tmp_path / "nothing")) == 0


def test_ratio_and_speed(spark):
    df = spark.createDataFrame([(100, 25, 2.0), (100, 0, 0.0)], "raw long, stored long, secs double")
    out = df.select(compression_ratio(F.col("raw"), F.col("stored")).alias("r"),
                    ratio_label(F.col("raw"), F.col("stored")).alias("l"),
                    ingest_speed(F.col("raw"), F.col("secs")).alias("s")).collect()
    assert out[0]["r"] == 4.0 and out[1]["r"] is None
    assert out[1]["l"] == "compression failed: compressed size is 0"
    assert out[0]["s"] == 50.0 and out[1]["s"] is None


def test_line_count_check(spark, lines_df):
    cat = catalog_frame(spark, [("ds", "ds", 2, "ts", "ds.log", None, None)])
    row = line_count_check(lines_df(["a", "b"]), cat, "ds").first()
    assert row["ok"] is True and row["counted"] == 2


@pytest.mark.parametrize("layout", ["json_string", "pairwise", "inferred", "static_dynamic", "variant", "document"])
def test_every_layout_writes_and_reads_back(spark, tmp_path, lines_df, layout):
    lines = lines_df(['{"t":{"$date":"2024-01-01T00:00:00.000"},"s":"I","c":"A","id":7,"ctx":"x",'
                      '"attr":{"k":1}}'])
    p = str(tmp_path / layout)
    ingest(lines, layout, p)
    assert read_archive(spark, p, layout, view=f"v_{layout}").count() == 1
    assert spark.sql(f"SELECT count(*) FROM v_{layout}").first()[0] == 1
    with pytest.raises(Exception):
        ingest(lines, layout, p)  # errorifexists by default
    ingest(lines, layout, p, mode="overwrite")


def test_ordered_partitions_are_sorted(spark):
    df = spark.range(0, 1000).select((F.col("id") % 7).alias("k"), (1000 - F.col("id")).alias("t"))
    out = ordered(df, ["k"], timestamp_key="t", partitions=4)
    rows = out.rdd.glom().map(lambda p: [(r["k"], r["t"]) for r in p]).collect()
    for part in rows:
        assert part == sorted(part)
    flat = [x for part in rows for x in part]
    assert flat == sorted(flat)


def test_drop_blank_rejects_unknown_rule(lines_df):
    with pytest.raises(ValueError):
        drop_blank(lines_df(["a"]), "bogus")


def test_read_archive_refuses_empty(spark, tmp_path):
    p = str(tmp_path / "empty")
    os.makedirs(p)
    with pytest.raises(ValueError, match="nothing to search"):
        read_archive(spark, p, "variant", require_data=True)


@pytest.mark.parametrize("layout", ["pairwise", "variant", "inferred", "static_dynamic", "document", "json_string"])
def test_ingest_files_skip_policy(spark, tmp_path, layout):
    from logvault.sinks.writers import ingest_files
    src = str(tmp_path / "logs" / "a.log")
    write_text(src, ['{"id": 1, "attr": {"x": 1}}', "garbage", "", '{"id": 2}'])
    rejected = ingest_files(spark, src, layout, str(tmp_path / "out"), malformed="skip")
    assert [r["line"] for r in rejected.collect()] == ["garbage"]
    assert read_archive(spark, str(tmp_path / "out"), layout).count() == 2
    with pytest.raises(Exception):
        ingest_files(spark, src, layout, str(tmp_path / "out2"), malformed="fail")


def test_inferred_layout_with_known_schema(spark, tmp_path):
    from logvault.layouts import InferredLayout
    p = str(tmp_path / "k" / "x.log")
    write_text(p, ['{"id": 1, "attr": {"n": 2}}', '{"id": 3}'])
    df = InferredLayout(schema="id BIGINT, attr STRUCT<n: BIGINT>").from_files(spark, p)
    assert df.schema.simpleString() == "struct<id:bigint,attr:struct<n:bigint>>"
    assert sorted(r["id"] for r in df.collect()) == [1, 3]

"""N01/N02 key encoding and N06-N12 normalisation, literal cases."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from logvault.operators.keys import encode_keys_struct, encode_keys_variant, encode_name
from logvault.operators.normalize import normalize
from logvault.sources.lines import clean_lines


DOCS = [{"a b": 1, "c-d": {"e f": [1, {"g-h": "x y"}]}, "plain": "a-b c", "n": 1.0},
        {"t": {"$date": "2024"}, "lst": [[{"k k": True}]], "z": None}]
# Expected documents, written out by hand (values untouched, only keys change).
EXPECTED = {
    "b64": [{"YSBi": 1, "Yy1k": {"ZSBm": [1, {"Zy1o": "x y"}]}, "plain": "a-b c", "n": 1.0},
            {"t": {"$date": "2024"}, "lst": [[{"ayBr": True}]], "z": None}],
    "hex": [{"612062": 1, "632D64": {"652066": [1, {"672D68": "x y"}]}, "706C61696E": "a-b c", "6E": 1.0},
            {"74": {"2464617465": "2024"}, "6C7374": [[{"6B206B": True}]], "7A": None}],
}


@pytest.mark.parametrize("mode", ["b64", "hex"])
def test_encode_keys_variant(spark, mode):
    df = spark.createDataFrame([(json.dumps(d),) for d in DOCS], "line string")
    out = df.select(F.to_json(encode_keys_variant(F.parse_json("line"), mode)).alias("x")).collect()
    assert [json.loads(r["x"]) for r in out] == EXPECTED[mode]


def test_encode_name_rules():
    assert encode_name("bad key-name", "b64") == base64.b64encode(b"bad key-name").decode()
    assert encode_name("plain", "b64") == "plain"
    assert encode_name("attr", "hex") == "61747472"


def test_collision_raises(spark):
    k = encode_name("a b", "b64")
    df = spark.createDataFrame([(json.dumps({"a b": 1, k: 2}),)], "line string")
    with pytest.raises(Exception):
        df.select(F.to_json(encode_keys_variant(F.parse_json("line"), "b64"))).collect()


def test_encode_keys_struct(spark):
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(DOCS[0])]))
    out = encode_keys_struct(df, "b64")
    names = set(out.columns)
    assert encode_name("a b", "b64") in names and encode_name("c-d", "b64") in names
    inner = out.schema[encode_name("c-d", "b64")].dataType
    assert encode_name("e f", "b64") in inner.fieldNames()


def test_clean_lines_keeps_floats_and_skips_bad(spark):
    df = spark.createDataFrame([('{"a b": 6.0, "n": 1}',), ("not json",), ("   ",), ("",)], "line string")
    cleaned, rejected = clean_lines(df, "b64")
    rows = [json.loads(r["line"]) for r in cleaned.collect()]
    assert rows == [{encode_name("a b", "b64"): 6.0, "n": 1}]
    assert isinstance(rows[0][encode_name("a b", "b64")], float)
    assert [r["line"] for r in rejected.collect()] == ["not json"]


NORM_DOCS = [
    {"attr": {"uuid": {"uuid": {"$uuid": "u1"}}, "error": "bad", "command": "find"}},
    {"attr": {"uuid": "u2", "error": {"errmsg": "e"}, "command": {"q": {"_id": 5}, "x": 1}}},
    {"attr": {"command": {"q": {"_id": True}}, "writeConcern": {"w": 1}, "query": {"_id": None}}},
    {"attr": {"command": {"q": {"_id": {"$oid": "o"}}}, "writeConcern": {"w": "majority"},
              "query": {"_id": "abc"}}},
    {"attr": {"writeConcern": {"w": False}, "query": {"other": 1}}},
    {"noattr": {"error": "x"}},
    {"attr": {"command": {"q": "scalar"}}},
]
# Expected documents after N06-N12, written out by hand.
NORM_EXPECTED = [
    {"attr": {"uuid": "u1", "error": {"errmsg": "bad"}, "command": {"command": "find"}}},
    {"attr": {"uuid": "u2", "error": {"errmsg": "e"}, "command": {"q": {"_id": {"_ooid": "5"}}, "x": 1}}},
    {"attr": {"command": {"q": {"_id": {"_ooid": "True"}}}, "writeConcern": {"w": "1"},
              "query": {"_id": {"_ooid": "None"}}}},
    {"attr": {"command": {"q": {"_id": {"$oid": "o"}}}, "writeConcern": {"w": "majority"},
              "query": {"_id": {"_ooid": "abc"}}}},
    {"attr": {"writeConcern": {"w": "False"}, "query": {"other": 1}}},
    {"noattr": {"error": "x"}},
    {"attr": {"command": {"q": "scalar"}}},
]


def test_normalize_literal_cases(spark):
    df = spark.createDataFrame([(json.dumps(d),) for d in NORM_DOCS], "line string")
    out = df.select(F.to_json(normalize(F.parse_json("line"))).alias("x")).collect()
    assert [json.loads(r["x"]) for r in out] == NORM_EXPECTED


def test_encoded_paths_find_the_same_rows(spark):
    from logvault.layouts import get_layout
    from logvault.operators import predicates as P
    from logvault.sources.lines import dataset_variation
    lines = spark.createDataFrame([('{"bad key": {"x-y": [1, 2]}, "n": 1}',), ('{"n": 2}',)], "line string")
    pred = P.all_of(P.Eq("bad key.x-y[1]", 2), P.Cmp("n", "lt", 2))
    lay = get_layout("variant")
    for variation, mode in [("cleaned_log", "b64"), ("base32_log", "hex")]:
        df = lay.build(dataset_variation(lines, variation))
        assert df.filter(pred.column(lay.resolver(df))).count() == 0  # original paths no longer exist
        assert df.filter(P.encode_paths(pred, mode).column(lay.resolver(df))).count() == 1


def test_deep_documents_raise_or_encode_with_a_larger_bound(spark):
    from logvault.operators.keys import encode_keys
    deep = {"a b": 1}
    for _ in range(9):
        deep = {"x-y": [deep]}  # 18 container levels below the root
    df = spark.createDataFrame([(json.dumps(deep),)], "line string").select(F.parse_json("line").alias("j"))
    with pytest.raises(Exception, match="deeper than 16"):
        encode_keys(df, "b64", column="j").collect()
    out = json.loads(encode_keys(df, "b64", column="j", depth=20).select(F.to_json("j")).first()[0])
    assert list(out) == [encode_name("x-y", "b64")]


def test_lines_encode_at_any_depth(spark):
    deep = {"a b": 6.0}
    for _ in range(40):
        deep = {"x-y": [deep]}  # 80 container levels
    df = spark.createDataFrame([(json.dumps(deep),)], "line string")
    got = clean_lines(df, "b64")[0].first()["line"]
    assert got.count(encode_name("x-y", "b64")) == 40 and f'{{"{encode_name("a b", "b64")}":6.0}}' in got


def test_text_form_agrees_with_the_variant_form(spark):
    from logvault.operators.keys import encode_keys_text
    tricky = [*DOCS, {"a:b": 'x": y', 'q"k': "\\", "t-\tz": "\\\"", "u -\u00e9": [{"": "a-b:"}], "v": "1.0, 2.00"},
              {"n": [1.0, -2.50, 3e5, 10, 100.0, 1.05]}, [], {}, "a b:", 3, {"k " * 3: "y" * 100000 + '\\" '}]
    df = spark.createDataFrame([(json.dumps(d),) for d in tricky], "line string")
    spaced = df.select(F.regexp_replace("line", '": ', '"  : ').alias("line"))
    for mode in ["b64", "hex"]:
        want = [r[0] for r in df.select(F.to_json(encode_keys_variant(F.parse_json("line"), mode))).collect()]
        assert [r[0] for r in df.select(F.to_json(encode_keys_text(F.col("line"), mode))).collect()] == want
    assert [r[0] for r in spaced.limit(2).select(F.to_json(encode_keys_text(F.col("line"), "hex"))).collect()] == [
        r[0] for r in df.limit(2).select(F.to_json(encode_keys_text(F.col("line"), "hex"))).collect()]


def test_clean_lines_of_repeated_and_colliding_keys(spark):
    k = encode_name("a b", "b64")
    rows = [('{"x": 1, "x": 2}',), (f'{{"a b": 1, "{k}": 2}}',), ('{"a": 1"',), (None,), ("  ",), ('{"a',)]
    cleaned, rejected = clean_lines(spark.createDataFrame(rows, "line string"))
    assert [r["line"] for r in cleaned.collect()] == ['{"x":2}', f'{{"{k}":2}}']
    assert rejected.count() == 2

"""Merged types: every predicate finds what it finds in a single VARIANT."""
import json

import pytest

from logvault.layouts import get_layout
from logvault.layouts.layouts import merged_schema
from logvault.operators import predicates as P
from logvault.operators.search import search
from logvault.sinks.writers import ingest
from logvault.sources.archive import read_archive
from tests.test_file_index import PREDICATES, _events

DOCS = [
    {"k": 0, "mix": 1, "s": "a", "o": {"x": 1, "y": "p"}, "arr": [1, {"z": 2}], "b": True, "f": 5.0, "A": 1, "odd name": {"q`r": 1}},
    {"k": 1, "mix": "1", "s": "b c", "o": {"x": "one"}, "arr": [], "b": False, "f": 6, "a": 2},
    {"k": 2, "mix": {"deep": [1, 2]}, "s": None, "o": {}, "arr": "text", "b": None, "f": 1e300, "A": "t", "a": None},
    {"k": 3, "mix": None, "s": "", "o": {"x": {"w": "v"}, "y": "q"}, "b": True, "n": None, "rest_fields": 7},
    {"k": 4, "mix": 1.5, "s": "a", "o": {"new": [True]}, "f": 12345678901234567890, "e": {}},
]
ASK = [f(p, v) for p in ("mix", "s", "o.x", "o.y", "o.new[0]", "arr[0]", "arr[1].z", "b", "f", "A", "a", "odd name.q`r", "n", "e", "rest_fields", "absent", "s.inner", "mix.deep[1]", "o.x.w")
       for f, v in ((P.Eq, 1), (P.Eq, "a"), (P.Eq, "1"), (P.Eq, True), (P.Ne, "a"), (P.Prefix, "p"), (P.Match, "one"), (P.Match, 2), (P.MatchPhrase, "b c"), (P.HasBucket, "int"),
                    (P.HasBucket, "string"), (P.HasBucket, "float"), (P.HasBucket, "object"), (P.HasBucket, "bool"))]
ASK += [f(p) for f in (P.Exists, P.Missing) for p in ("mix", "s", "o", "o.x", "e", "a", "A", "n", "arr", "odd name", "absent")]
ASK += [P.Cmp(p, op, v) for p in ("mix", "f", "o.x", "a") for op in ("gt", "ge", "lt", "le") for v in (1, 1.5, 5, 2**60)]
ASK += [P.Ne("mix", 1, "keep"), P.Ne("f", 6, "keep"), P.Eq("f", 12345678901234567890)]


def _lines(spark, docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "line string")


def _found(df, lay, preds, key):
    r = lay.resolver(df)
    return [sorted(x[0] for x in search(df, lay, p).select(r.integer(key)).collect()) for p in preds]


def test_predicates_agree_with_a_variant(spark):
    merged, variant = get_layout("merged"), get_layout("variant")
    m, v = merged.build(_lines(spark, DOCS)).cache(), variant.build(_lines(spark, DOCS)).cache()
    from functools import reduce

    from pyspark.sql import functions as F
    hits = lambda df, lay: {r.k: r for r in df.select(
        lay.resolver(df).integer("k").alias("k"), *[F.coalesce(p.column(lay.resolver(df)), F.lit(False)).alias(f"p{i}") for i, p in enumerate(ASK)]).collect()}
    a, b = hits(m, merged), hits(v, variant)
    assert a.keys() == b.keys()
    assert [(k, ASK[i]) for k in a for i in range(len(ASK)) if a[k][f"p{i}"] != b[k][f"p{i}"]] == []
    assert reduce(lambda n, r: n + sum(r[f"p{i}"] for i in range(len(ASK))), b.values(), 0) > 100


def test_schema(spark):
    from pyspark.sql import functions as F
    s = merged_schema(_lines(spark, DOCS).select(F.parse_json("line").alias("j")))
    kinds = {f.name: f.dataType.simpleString() for f in s.fields}
    assert kinds["k"] == "bigint" and kinds["s"] == "string" and kinds["b"] == "boolean" and kinds["mix"] == kinds["f"] == kinds["arr"] == kinds["e"] == kinds["n"] == "variant"
    assert kinds["o"] == "struct<new:variant,x:variant,y:string>" and not {"a", "A", "rest_fields"} & kinds.keys()
    assert merged_schema(spark.createDataFrame([], "line string").select(F.parse_json("line").alias("j"))).fields == []


def test_archive_and_a_given_schema(spark, tmp_path):
    from pyspark.sql import functions as F
    lay = get_layout("merged")
    path = str(tmp_path / "m")
    ingest(_lines(spark, _events(120)), lay, path)
    back = read_archive(spark, path, "merged")
    v = get_layout("variant")
    preds = [p for p in PREDICATES if not isinstance(p, P.Prefix) or p.prefix != "{"]
    assert _found(back, lay, preds, "attr.deep.list[0]") == _found(v.build(_lines(spark, _events(120))), v, preds, "attr.deep.list[0]")
    # a schema from earlier files: new fields are kept beside it
    earlier = merged_schema(_lines(spark, [{"k": 1}]).select(F.parse_json("line").alias("j")))
    given = get_layout("merged", schema=earlier)
    df = given.build(_lines(spark, DOCS))
    assert df.columns == ["k", "rest_fields"] and _found(df, given, [P.Eq("o.y", "p"), P.Eq("a", 2), P.Eq("k", 4)], "k") == [[0], [1], [4]]

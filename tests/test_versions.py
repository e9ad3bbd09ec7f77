"""S18 all-or-nothing writes; S06 and drifting schemas on streams."""

import os

import pytest
from pyspark.sql import functions as F

from logvault.layouts import get_layout
from logvault.operators.predicates import Eq, Exists, Missing
from logvault.operators.search import search
from logvault.sinks.versions import live_parts, manifest, read_version, write_version
from logvault.streaming.archive import archive_stream, read_rejected, read_stream_archive
from logvault.streaming.ingest import run_to_completion


def ids(df, lay):
    return sorted(r[0] for r in df.select(lay.resolver(df).integer("id")).collect())


def built(lines_df, *numbers):
    return get_layout("variant").build(lines_df([f'{{"id":{n}}}' for n in numbers]))


def test_write_modes_of_versions(spark, tmp_path, lines_df):
    lay, p = get_layout("variant"), str(tmp_path / "a")
    with pytest.raises(ValueError, match="no archive"):
        read_version(spark, p)
    assert write_version(built(lines_df, 1, 2), lay, p) == 1
    with pytest.raises(ValueError, match="exists"):
        write_version(built(lines_df, 9), lay, p)
    assert write_version(built(lines_df, 9), lay, p, mode="ignore") is None
    assert write_version(built(lines_df, 3), lay, p, mode="append") == 2
    assert ids(read_version(spark, p), lay) == [1, 2, 3]
    opened = read_version(spark, p)
    assert write_version(built(lines_df, 7), lay, p, mode="overwrite") == 3
    assert ids(read_version(spark, p), lay) == [7]
    assert ids(opened, lay) == [1, 2, 3]  # a reader keeps what it opened
    assert ids(read_version(spark, p, version=2), lay) == [1, 2, 3]
    with pytest.raises(ValueError, match="mode must be"):
        write_version(built(lines_df, 1), lay, p, mode="bogus")


def test_failed_write_leaves_the_archive(spark, tmp_path, lines_df):
    lay, p = get_layout("variant"), str(tmp_path / "a")
    write_version(built(lines_df, 1), lay, p)
    broken = lay.build(lines_df(['{"id":2}', "no json"]))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception):
            write_version(broken, lay, p, mode=mode)
        assert ids(read_version(spark, p), lay) == [1]
    assert len(manifest(spark, p)) == 1


class Files:
    def __init__(self, base):
        self.src, self.dst, self.ck = (str(base / n) for n in ("src", "dst", "ck"))
        os.makedirs(self.src)

    def arrive(self, name, *lines):
        with open(f"{self.src}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")

    def run(self, spark, layout, **kw):
        run_to_completion(archive_stream(spark, self.src, self.dst, layout, self.ck, **kw))


@pytest.mark.parametrize("layout", ["json_string", "pairwise", "merged", "static_dynamic", "variant", "document"])
def test_stream_sets_bad_lines_aside(spark, tmp_path, layout):
    fs = Files(tmp_path)
    fs.arrive("a.log", '{"id":1}', "garbage", "", '{"id":2}')
    fs.run(spark, layout)
    fs.arrive("b.log", '{"id":3', '{"id":4}')
    fs.run(spark, layout)
    fs.run(spark, layout)  # nothing new
    lay = get_layout(layout)
    assert ids(read_stream_archive(spark, fs.dst, layout), lay) == [1, 2, 4]
    assert sorted(r["line"] for r in read_rejected(spark, fs.dst).collect()) == ["garbage", '{"id":3']


def test_stream_fail_policy_shows_nothing_of_the_batch(spark, tmp_path):
    fs = Files(tmp_path)
    fs.arrive("a.log", '{"id":1}', "garbage")
    with pytest.raises(Exception):
        fs.run(spark, "variant", malformed="fail")
    assert live_parts(spark, fs.dst) == [] and read_rejected(spark, fs.dst).count() == 0
    with pytest.raises(ValueError):
        fs.run(spark, "variant", malformed="bogus")
    with pytest.raises(ValueError, match="merged"):
        fs.run(spark, "inferred")


@pytest.mark.parametrize("crash", ["before commit", "after commit"])
def test_repeated_batch_is_stored_once(spark, tmp_path, monkeypatch, crash):
    from logvault.streaming import archive
    fs = Files(tmp_path)
    fs.arrive("a.log", '{"id":1}', "bad", '{"id":2}')
    real = archive.commit_part

    def broken(*a, **kw):
        if crash == "after commit":
            real(*a, **kw)
        raise RuntimeError("lost driver")
    monkeypatch.setattr(archive, "commit_part", broken)
    with pytest.raises(Exception):
        fs.run(spark, "merged")
    monkeypatch.setattr(archive, "commit_part", real)
    fs.run(spark, "merged")  # the same batch once more
    assert ids(read_stream_archive(spark, fs.dst, "merged"), get_layout("merged")) == [1, 2]
    assert [r["line"] for r in read_rejected(spark, fs.dst).collect()] == ["bad"]
    assert len(live_parts(spark, fs.dst)) == 1


DRIFT = [
    ['{"id":1,"a":{"x":5},"s":"t"}', '{"id":2}'],
    ['{"id":3,"a":{"x":"five","y":true},"new":[1,2]}'],
    ['{"id":4,"a":"plain","S":{"deep":9}}', '{"id":5,"s":7}'],
    ['{"id":6,"a":{"X":1,"x":2}}', '{"id":"7","rest_fields":3}'],
]


def test_schema_drifts_from_batch_to_batch(spark, tmp_path, lines_df):
    fs = Files(tmp_path)
    for i, lines in enumerate(DRIFT):
        fs.arrive(f"{i}.log", *lines)
        fs.run(spark, "merged")
    got, lay = read_stream_archive(spark, fs.dst, "merged"), get_layout("merged")
    plain = get_layout("variant")
    whole = plain.build(lines_df([x for part in DRIFT for x in part]))

    paths = ("id", "a", "a.x", "a.X", "a.y", "s", "S", "S.deep", "new", "rest_fields")
    preds = [Exists(p) for p in paths] + [Missing(p) for p in paths]
    preds += [Eq("a.x", 5), Eq("a.x", "five"), Eq("a", "plain"), Eq("s", "t"), Eq("s", 7), Eq("S.deep", 9),
              Eq("id", 7), Eq("a.X", 1), Eq("a.x", 2), Eq("rest_fields", 3)]
    for p in preds:
        assert ids(search(got, lay, p), lay) == ids(search(whole, plain, p), plain), p
    text = lambda df, l: sorted(str(tuple(r)) for r in df.select(
        l.resolver(df).integer("id"), *[l.resolver(df).text(x) for x in ("a.x", "s", "new")]).collect())
    assert text(got, lay) == text(whole, plain)


def test_one_scan_for_each_schema(spark, tmp_path):
    fs = Files(tmp_path)
    for i in range(5):
        fs.arrive(f"{i}.log", f'{{"id":{i},"v":{i if i else chr(34) + "x" + chr(34)}}}')
        fs.run(spark, "merged")
    df = read_stream_archive(spark, fs.dst, "merged")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert df.agg(F.count("*")).first()[0] == 5

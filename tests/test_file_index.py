"""File index on undeclared paths: the rows of a full scan from few files."""
import json
import random

import pytest

from logvault.layouts import get_layout
from logvault.operators import predicates as P
from logvault.operators.search import search
from logvault.sinks.writers import ingest
from logvault.sources.file_index import files_to_read, indexed_search, write_file_index

LAYOUTS = ("variant", "document", "static_dynamic")


def _events(n=400):
    rng = random.Random(5)
    for i in range(n):
        a = {"n": i, "name": f"user-{i // 10}", "text": f"Job {i} took {i % 7} ms on host_{i % 90}", "deep": {"list": [i, {"k": str(i * 2)}]}}
        if i % 9 == 0:
            a["n"] = str(i)  # numeric text is its number
        if i % 11 == 0:
            a["name"] = None
        if i % 13 == 0:
            a["name"] = {"first": f"user-{i}", "empty": {}}
        if i % 17 == 0:
            a["text"] = rng.choice([True, 1.5, -0.0, 0, "{}", ""])
        if i % 19 == 0:
            a["e"] = {}
        yield {"id": i, "c": "X", "attr": a, "other": {"u": i % 50}}


PREDICATES = [
    P.Eq("attr.n", 77), P.Eq("attr.n", 9), P.Eq("attr.n", 77.5), P.Cmp("attr.n", "gt", 390), P.Cmp("attr.n", "le", 3), P.Eq("attr.n", "81"),
    P.Eq("attr.name", "user-12"), P.Prefix("attr.name", "user-39"), P.Like("attr.name", "user-3_"), P.Like("attr.name", "%r-20"), P.Prefix("attr.name", "{"),
    P.Like("attr.name", '{"empty%'), P.Ne("attr.name", "user-1"), P.Ne("attr.n", 5, "keep"), P.Exists("attr.e"), P.Missing("attr.text"), P.Eq("attr.e", "{}"),
    P.Match("attr.text", "HOST_7"), P.Match("attr.text", "host_7 370", "and"), P.MatchPhrase("attr.text", "job 200 took"), P.MatchPhrase("attr.text", "took job"),
    P.WildcardToken("attr.text", "host_8?"), P.Match("attr.n", 81), P.Match("attr.name", "empty"), P.Match("attr.text", "..."), P.Eq("attr.text", 0), P.Eq("attr.text", True),
    P.Eq("attr.deep.list[0]", 250), P.Eq("attr.deep.list[1].k", "500"), P.Eq("attr.deep.list[1].k", 500), P.HasBucket("attr.text", "float"), P.HasBucket("attr.name", "object"),
    P.AtLeast(2, (P.Eq("attr.n", 77), P.Cmp("attr.n", "lt", 100), P.Prefix("attr.name", "user-2"))), P.Not(P.Eq("attr.n", 77)), P.Eq("id", 33), P.Prefix("c", "Y"),
    P.Eq("other.u", 7), P.Eq("absent", 1), P.Eq("absent.deeper", "x"), P.Or((P.Eq("attr.n", 5), P.MatchPhrase("attr.text", "job 399"))), P.Eq(("attr", "n"), 42),
]


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    out = {}
    lines = [(json.dumps(e),) for e in _events()]
    for name in LAYOUTS:
        path = str(tmp_path_factory.mktemp("idx") / f"a b {name}")
        df = spark.createDataFrame(lines[:360], "line string").coalesce(1)
        ingest(df, name, path, max_records_per_file=12)
        write_file_index(spark, path, name)
        # files written later are not indexed and always read
        ingest(spark.createDataFrame(lines[360:], "line string").coalesce(1), name, path, mode="append", max_records_per_file=20)
        out[name] = path
    return out


@pytest.mark.parametrize("name", LAYOUTS)
def test_rows_equal_a_full_scan(spark, archives, name):
    lay = get_layout(name)
    for pred in PREDICATES:
        whole = lay.read(spark, archives[name])
        ids = lambda df: sorted(r[0] for r in df.select(lay.resolver(df).text("attr.deep.list[0]")).collect())  # noqa: E731, B023
        assert ids(indexed_search(spark, archives[name], lay, pred)) == ids(search(whole, lay, pred)), pred


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("pred", [P.Eq("attr.n", 77), P.Cmp("attr.n", "lt", 10), P.Eq("attr.name", "user-12"), P.MatchPhrase("attr.text", "job 200 took"),
                                  P.WildcardToken("attr.text", "20?"), P.Eq("attr.deep.list[1].k", "500"), P.Eq("absent", 1)])
def test_a_tenth_of_the_files_is_read(spark, archives, name, pred):
    files, n = files_to_read(spark, archives[name], name, pred)
    assert n == 32 and len(files) - 2 <= 3  # the two files without an index, and a tenth of the others


def test_negation_and_absence_read_everything(spark, archives):
    for pred in (P.Not(P.Eq("attr.n", 77)), P.Missing("attr.n"), P.Ne("attr.n", 1), P.Exists("absent")):
        assert len(files_to_read(spark, archives["variant"], "variant", pred)[0]) == 32


def test_index_elsewhere_and_empty_archive(spark, tmp_path):
    path, index = str(tmp_path / "e"), str(tmp_path / "i")
    ingest(spark.createDataFrame([], "line string"), "variant", path)
    assert write_file_index(spark, path, "variant", index) == index
    assert indexed_search(spark, path, "variant", P.Eq("a", 1), index).collect() == []


def test_layouts_without_a_variant_are_refused(spark, tmp_path):
    path = str(tmp_path / "p")
    ingest(spark.createDataFrame([('{"a": 1}',)], "line string"), "pairwise", path)
    with pytest.raises(ValueError):
        write_file_index(spark, path, "pairwise")

"""Operators 11 to 13 against brute force and labelled pages."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logvault.llm import hard_negatives as hn
from logvault.llm import html_text as ht
from logvault.llm import periodic_runs as pr
from logvault.llm.common import read_table
from tests.llm.conftest import SF

# ---------------------------------------------------------------- periodic runs


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            smaller = any(all(words[k] == words[k + d] for k in range(i, i + size - d)) for d in range(1, q))
            if size >= max(6, 4 * q) and not smaller:
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_op13(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    drop = {k for i, size, q in runs for k in range(i + q, i + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in drop)).hexdigest())


@st.composite
def periodic_words(draw):
    out = []
    for _ in range(draw(st.integers(0, 4))):
        unit = draw(st.lists(st.integers(0, 2), min_size=1, max_size=6))
        out += (unit * 12)[:draw(st.integers(0, 12 * len(unit)))]
        out += draw(st.lists(st.integers(0, 3), max_size=5))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(periodic_words(), min_size=1, max_size=4))
def test_find_runs_equals_brute_force(docs):
    import numpy as np
    flat, doc, first = [], [], []
    for k, d in enumerate(docs):
        first.append(len(flat))
        flat += [*d, -1 - k]
        doc += [k] * (len(d) + 1)
    got = {}
    for i, size, q in pr.find_runs(np.array(flat), np.array(doc)):
        got.setdefault(doc[i], []).append((i - first[doc[i]], size, q))
    for k, d in enumerate(docs):
        assert sorted(got.get(k, []), key=lambda r: (r[0], r[2])) == brute_runs(d)


def test_runs_in_parts_of_ordered_sets():
    """More positions of one class than a part holds, added out of order."""
    s = pr.Positions(5000)
    for x in random.Random(1).sample(range(20000), 9000):
        if x != 5000:
            s.add(x)
    members = list(s)
    assert members == sorted(set(members)) and len(members) == s.n and len(s.parts) > 3
    for k in range(1, len(members) - 1):
        assert s.around(members[k]) == (members[k - 1], members[k + 1])


def test_op13_equals_brute_force_on_the_given_table(spark):
    docs = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    got = pr.op13_periodic_runs(spark, SF).collect()
    assert len(got) == len(docs)
    checked = 0
    for r in got:
        if len((docs[r.doc_id] or "").split()) <= 600:
            assert tuple(r)[1:] == brute_op13(r.doc_id, docs[r.doc_id])
            checked += 1
    assert checked > 100 and any(r.n_runs for r in got)


def test_runs_odd_input(spark, docs_of, odd_texts):
    long = "a b " * 40000 + "x " * 7 + "end"
    rows = pr.word_runs(docs_of([*odd_texts, (70, "a a a a a a"), (71, "a a a a a"), (72, "x y x y x y x y z z z z z z z"), (73, long)])).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == len(odd_texts) + 4 and len(by[5]) == 2 and len(by[None]) == 1
    assert [(r.n_words, r.runs, r.collapsed) for r in (by[0][0], by[1][0], by[2][0])] == [(0, [], "")] * 3
    assert [tuple(x) for x in by[70][0].runs] == [(0, 6, 1)] and by[70][0].collapsed == "a"
    assert by[71][0].runs == [] and by[71][0].collapsed == "a a a a a"
    assert [tuple(x) for x in by[72][0].runs] == [(0, 8, 2), (8, 7, 1)] and by[72][0].collapsed == "x y z"
    assert [tuple(x) for x in by[73][0].runs] == [(0, 80000, 2), (80000, 7, 1)] and by[73][0].collapsed == "a b x end"
    assert [tuple(x) for x in by[7][0].runs] == [(0, 30000, 4999)]
    assert pr.word_runs(docs_of([])).collect() == []


def test_runs_long_period():
    unit = [f"w{i}".encode() for i in range(4999)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b" ".join(unit * 4 + unit[:10])], pa.binary())], ["doc_id", "tx"])
    out = next(pr._work([batch], None)).to_pylist()[0]
    assert out["runs"] == [{"start": 0, "length": 4999 * 4 + 10, "period": 4999}] and out["collapsed"] == b" ".join(unit)


def test_runs_clashing_columns(spark, docs_of):
    from pyspark.sql import functions as F
    docs = docs_of([(1, "a a a a a a a")]).select("*", *[F.lit(1).alias(c) for c in ("tx", "runs", "n_words", "collapsed", "best", "start")])
    assert pr.word_runs(docs).first().collapsed == "a"


# --------------------------------------------------------------- hard negatives


def brute_negatives(rows, every=50):
    """rows: (id, label, integer vector)."""
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), b, lb) for b, lb, w in rows if b != a and len(w) == len(v)), key=lambda r: r[:2])
        for p, b, lb in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(a, b, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fits[:3])]
    return out


def _ints(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label bigint, v array<int>")


@pytest.mark.parametrize("seed,spread", [(1, 3), (2, 40), (3, 900000)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, spread):
    from pyspark.sql import functions as F
    monkeypatch.setattr(hn, "BLOCK_BYTES", 600)  # several blocks of anchors
    rng = random.Random(seed)
    base = [[rng.randint(-spread, spread) for _ in range(4)] for _ in range(30)]
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [x + rng.randint(-1, 1) for x in rng.choice(base)] if i % 3 else rng.choice(base)) for i in range(300)]
    rows += [(1000 + i, 0, [1, 2]) for i in range(60)] + [(2000 + i, 1, [2, 1]) for i in range(20)]  # shorter vectors, many ties
    got = hn.hard_negatives(_ints(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_negatives(rows, 10))


def test_hard_negatives_odd_input(spark):
    from pyspark.sql import functions as F
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.75, 0.25]), (2, 2, [0.75, 0.25]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 2, [None, 1.0]),
            (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]), (None, 2, [0.75, 0.25]), (8, 2, [1e300, 1.0]), (9, 2, []), (10, 3, [-1.0, 0.0]), (11, 2, [0.9])]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumn("up", F.lit(1)).withColumn("aid", F.lit("x")).withColumn("v", F.lit(0))
    ints = hn.integer_vectors(table)
    assert sorted(r.vec_id for r in ints.collect()) == [0, 1, 2, 2, 9, 10, 11]
    got = sorted(tuple(r) for r in hn.hard_negatives(ints, F.col("vec_id") == 0).collect())
    # repeated rows are rows of their own
    assert got == [(0, 1, 1, 2, 73728, 57344), (0, 1, 2, 2, 73728, 57344)]
    empty = ints.filter("false")
    assert hn.hard_negatives(empty, F.col("vec_id") == 0).collect() == []
    assert hn.hard_negatives(ints, F.col("vec_id") == -1).collect() == []


def test_floor_of_negative_components(spark):
    got = hn.integer_vectors(spark.createDataFrame([(1, 1, [-0.001, 0.999, -1.0])], "vec_id bigint, label int, embedding array<float>")).first()
    assert got.v == [-1, 255, -256]


def test_products_are_exact():
    import numpy as np
    for most in (1 << 9, 1 << 24, 1 << 29):
        a = np.random.default_rng(1).integers(-most, most, (5, 16))
        assert (hn._products(a, a).astype(object) == a.astype(object) @ a.T.astype(object)).all()


# ------------------------------------------------------------------- HTML text


def test_tree_fits_its_table():
    x, y = ht.labelled_table()
    assert (ht.trained_tree().predict(x) == y).all() and len({tuple(r) for r in x.tolist()}) > 30


LONG = "It was a long walk down to the river and back again through the fields of barley that day. "
PAGES = [
    ("<p>Caf&eacute;&nbsp;&amp; bar&#33; " + LONG + "</p>", "Café & bar! " + LONG),
    ("<html><head><title>T</title><meta charset=x></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><main><h1>Head\n line</h1>"
     "<p>One <b>two</b>three<br>four<p>" + LONG + "<form>Name <input><button>Go</button></form><p>End.</main><aside>" + LONG + "</aside><footer>c</footer>",
     "Head line One twothree four " + LONG + " End."),
    ("<div class='site-header'>X</div><div class='post'><p>" + LONG + "</p><script>if (a<b) {'</p>'}</script><style>p{}</style><!-- <p>no</p> -->"
     "<div class='ad-slot'>Buy " + LONG + "</div><p>Last &lt;one&gt;</p></div><div id='comments'><article class='comment'><p>" + LONG + "</p></article></div>",
     LONG + " Last <one>"),
    ("<article>" + LONG + "<section class=comments><h2>Comments</h2><p>" + LONG + "</p></section></article><div class='cookie-banner'>" + LONG + "</div>", LONG),
    ("<body class='has-sidebar'><form id=aspnet><article class='post with-sidebar'><p>" + LONG + "</p><p hidden>no</p><p style='display:none'>p<p class=notice>x<p>end</article></form>", LONG + " end"),
    ("<div>a</div><div><a href=x>one</a></div>", ""),
    ("", ""), (None, ""), ("   \n", ""), ("<div><a href='x", ""), ("<article>open <b>bold " + LONG, "open bold " + LONG),
    ("<article><p>kept " + LONG + "<!-- never closed <p>lost", "kept " + LONG),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert ht.main_text(page or "") == " ".join(want.split())


def test_pages_are_read_in_linear_time():
    import time
    start = time.time()
    for part in ("<a \"", "<!--", "<", "<div>", "</div>", "<p a=\"", "<li>", "<p a='", "<script>", "<div><span>", "&amp"):
        ht.main_text(part * 100_000)
    assert time.time() - start < 30


def test_extract_odd_input(spark):
    from pyspark.sql import functions as F
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article>x</article>"), (2, "v", ""), (3, "w", "<article>" + "word " * 300_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("q"))
    got = ht.extract_text(pages).collect()
    assert sorted((r.page_id or 0, r.url or "", len(r.text)) for r in got) == [(0, "", 1), (1, "u", 0), (1, "u", 0), (2, "v", 0), (3, "w", 1_499_999)]
    assert ht.extract_text(pages.limit(0)).collect() == []


# ---------------------------------------------------------- toxicity: models side by side


def test_each_model_keeps_its_own_word_table():
    """Scores never come from the table of an earlier model of the same worker."""
    import gc
    from types import SimpleNamespace

    import pyarrow as pa

    from logvault.llm import toxicity as T
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"grubble nice"], pa.binary())], ["doc_id", "tx"])
    weights, seen = np.ones(5), set()
    for k in range(12):
        model = T.KneserNeyRatio({b"grubble": (k, 12 - k), b"nice": (3, 1), b"other": (1, 1)})
        got = next(T._score([batch], SimpleNamespace(value=(model, weights, 0.5))))["mean_ratio"][0].as_py()
        fresh = T._ratios_of(model, [T.spellings(b"grubble nice")], {})[0]
        assert got == pytest.approx(float(T.evidence(fresh)[0]))
        seen.add(round(got, 9))
        del model
        gc.collect()
    assert len(seen) > 6


def test_op1_columns(spark):
    from logvault.llm.toxicity import op1_toxicity_kneser_ney
    assert op1_toxicity_kneser_ney(spark, SF).columns[:4] == ["doc_id", "held_out", "score", "predicted"]

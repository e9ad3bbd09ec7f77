"""Near-duplicates, decontamination and embeddings against brute force."""

import itertools
import random

import numpy as np
import pytest

from logvault.llm import decontaminate as D
from logvault.llm import embed_dedup as E
from logvault.llm import near_dedup as N
from logvault.llm.common import connected_components
from tests.llm.conftest import SF


def _components(ids, linked):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _expected(rows):
    sets = [(i, set(N.shingle_set((t or "").encode()).tolist())) for i, t in rows]
    linked = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if a and b and 100 * len(a & b) >= 85 * len(a | b)]
    return {i: len(s) for i, s in sets}, _components([i for i, _ in sets], linked)


def test_near_duplicates_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size, comp = _expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = N.op2_minhash_multi_index(spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert {r["doc_id"]: r["n_shingles"] for r in got} == size
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_index_keeps_its_bounds():
    """Signatures of sets at exactly the threshold share a key and lie within the distance."""
    assert N.index_for(85) == (48, 20)
    symbols, far = N.index_for(80)
    rng = np.random.default_rng(3)
    pairs = [rng.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in range(2000)]
    a = N.signatures([p[:90] for p in pairs], symbols)
    b = N.signatures([p[10:] for p in pairs], symbols)  # 80 of 100 in common
    assert ((a != b).sum(1) <= far).all() and (N.mask_keys(a) == N.mask_keys(b)).any(1).all()


def test_pipeline_links_from_80_percent(spark, docs_of):
    """Of two texts with 8 of 10 to 81 of 100 shingles in common the pipeline keeps one, of less similar ones both."""
    import corpus_pipeline as pipe
    rows, near = [], 0
    for k in range(40):
        a = [f"w{k}_{i}" for i in range(104)]  # 100 shingles; a tail of n other words replaces n of them
        n = 11 if k % 2 else 12
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a[:-n] + [f"x{k}_{i}" for i in range(n)]))]
        near += 100 * (100 - n) >= 80 * (100 + n)
    assert near == 20
    left = {r["doc_id"] for r in pipe.dedup_stage(spark, docs_of(rows), SF).collect()}
    assert left == {2 * k for k in range(40)} | {2 * k + 1 for k in range(0, 40, 2)}


def test_dense_group_of_near_copies(docs_of, monkeypatch):
    """Variants of one text around the threshold, with buckets and groups small enough to be split into blocks."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(N, "BUCKET_ROWS", 16)
    monkeypatch.setattr(N, "GROUP_ROWS", 16)
    _, comp = _expected(rows)
    got = N.near_duplicates(docs_of(rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp


@pytest.mark.parametrize("pivots", [1, 3, 8])
def test_group_links_equal_brute_force(spark, monkeypatch, pivots):
    """Large groups of chains, clusters apart from one another and loners: pivots settle a part, blocks the rest."""
    monkeypatch.setattr(N, "PIVOTS", pivots)
    rng, sets, rows = random.Random(pivots), {}, []
    for g in range(3):
        for c in range(4):
            base = rng.sample(range(10**6), 60)
            for k in range(rng.choice([1, 6, 25])):
                if k % 3 == 1:
                    base[rng.randrange(60)] = rng.randrange(10**6)  # the cluster drifts: a chain
                s = set(base)
                for _ in range(rng.randrange(0, 4)):
                    s.discard(rng.choice(base))
                sets[len(sets)] = (g, s)
    for i, (g, s) in sets.items():
        rows.append((g, i, bytearray(np.sort(np.array([*s], np.uint64)).tobytes())))
    df = spark.createDataFrame(rows, "grp bigint, rep bigint, data binary").selectExpr("*", "CASE grp WHEN 0 THEN 1 ELSE 5 END AS nb")
    edges = N.group_links(df.filter("nb = 1"), df.filter("nb > 1"), N.SetKernel, 85).collect()

    def components(pairs):
        top = {i: i for i in sets}
        def find(v):
            while top[v] != v:
                v = top[v]
            return v
        for a, b in pairs:
            u, v = find(a), find(b)
            top[max(u, v)] = min(u, v)
        return {i: find(i) for i in sets}

    true = [(i, j) for i, (g, s) in sets.items() for j, (h, t) in sets.items() if i < j and g == h and 100 * len(s & t) >= 85 * len(s | t)]
    assert components([(e.a, e.b) for e in edges]) == components(true)
    assert len(true) > 200 and len(set(components(true).values())) >= 12
    assert len({(e.a, e.b) for e in edges}) < 4 * len(sets)


def test_odd_texts(docs_of, odd_texts):
    got = N.near_duplicates(docs_of(odd_texts)).collect()
    assert len(got) == len(odd_texts)
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert all(by[i, 0]["component_id"] == i for i in (0, 1, 2))
    assert by[3, 1]["component_id"] == 3
    assert by[None, 10]["component_id"] == 4 and not by[None, 10]["kept"]
    assert by[9, 10]["component_id"] == 4  # A-Z are lower-cased
    kept = N.deduplicate(docs_of(odd_texts).selectExpr("*", "1 AS n", "2 AS stays", "3 AS row")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 1, 2, 3, 4, 7, 8]
    assert kept[0].asDict().keys() >= {"n", "stays", "row"}


def test_repeated_rows_keep_one(docs_of):
    t = "one two three four five six seven"
    assert N.deduplicate(docs_of([(1, t), (1, t), (2, t)])).count() == 1


def test_empty_tables(docs_of, spark):
    none = docs_of([])
    assert N.near_duplicates(none).count() == 0
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contaminated(none, bench).count() == 0
    some = D.contaminated(docs_of(["a text of some words"]), bench)
    assert some.count() == 0 and some.columns == ["doc_id", "th", "item_id", "n_tokens", "covered", "n_slots", "n_changed"]
    assert E.embedding_links(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_pigeonhole_keys_share_one_mask():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (200, N.SYMBOLS), dtype=np.uint8)
    b = a.copy()
    for i in range(200):  # up to 15 wrong symbols anywhere
        at = rng.choice(N.SYMBOLS, rng.integers(0, 16), replace=False)
        b[i, at] ^= 255
    assert (N.mask_keys(a) == N.mask_keys(b)).any(1).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


ITEM = "A train leaves Boston at 9 and travels 120 km to reach Denver before the next 9 trains that carry coal through Boston again"


@pytest.fixture()
def leaks(spark, docs_of):
    def run(texts, items=((1, ITEM),)):
        out = D.contaminated(docs_of(texts), spark.createDataFrame(list(items), "item_id bigint, text string")).collect()
        return {(r["doc_id"], r["item_id"]): r for r in out}
    return run


def test_templates_and_slots(leaks):
    other = ITEM.replace("Boston", "Lyon").replace("120", "75").replace("9", "4")
    broken = ITEM.replace("Boston at", "Lyon at").replace("9 and", "4 and")  # a name and a number stand for two values
    got = leaks([f"Some words before. {ITEM}. And after", f"We ask: {other}", f"Then {broken}", "nothing of the kind here at all my friend"])
    assert set(got) == {(0, 1), (1, 1)}
    assert got[0, 1]["n_changed"] == 0 and got[1, 1]["n_changed"] == 3


@pytest.mark.parametrize("old,new", [("Boston", "New York"), ("Boston", "Salt Lake City"), ("120", "one hundred and twenty"), ("120 km", "120km"), ("120", "1,250.5")])
def test_reparameterised_items(leaks, old, new):
    """A name run or a number of several words is one placeholder, a unit may be glued to its number."""
    assert old in ITEM
    got = leaks([f"Here it comes: {ITEM.replace(old, new)} That was it."])
    assert set(got) == {(0, 1)}


def test_coverage_is_summed_over_neighbouring_offsets(leaks):
    w = ITEM.split()
    cut = w[:len(w) // 2] + ["really", "very"] + w[len(w) // 2:]
    assert set(leaks([" ".join(cut)])) == {(0, 1)}


def test_a_repeated_item_is_found_once(leaks):
    got = leaks([" and then ".join([ITEM] * 40)])
    assert set(got) == {(0, 1)} and got[0, 1]["n_changed"] == 0


def test_leak_cases(leaks, odd_texts):
    got = leaks([*odd_texts, (50, ITEM), (50, ITEM), (None, ITEM)], [(1, ITEM), (2, ITEM), (3, None), (4, ""), (5, "too short"), (None, ITEM),
                                                                    (7, "exactly six words stand right here")])
    assert {k[0] for k in got} == {50, None} and {k[1] for k in got} == {1, 2, None}


def test_verbatim_items_in_any_form(leaks):
    """Other case, line breaks, double spaces and a word before the item; half an item of numbers."""
    short, german = "What is the capital of France", "Der Zug verbindet Hamburg mit Berlin und bringt Kohle in die Stadt"
    sums = "Add 12 34 56 78 90 11 22 33 to 44 55"
    texts = [ITEM.replace(" ", "\n"), ITEM.replace(" ", "  "), ITEM.lower(), ITEM.title(), ITEM.upper(),
             f"question {short} then", german.lower(), f"so {sums} now", "Add 99 34 56 70 90 10 20 33 to 40 50"]
    got = leaks(texts, [(1, ITEM), (2, short), (3, german), (4, sums)])
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 3), (7, 4)}
    assert all(r["n_changed"] == 0 for r in got.values())


def test_leaks_on_the_tables(spark):
    """All documents with every eight-word window of an item, and no document without any."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: " ".join((t or "").lower().split())
    full = {i for i, t in docs.items() if any(plain(x) in plain(t) for x in items)}
    got = {r["doc_id"] for r in D.op7_template_decontamination(spark, SF).collect()}
    assert full <= got and len(got - full) <= 2


def _vectors(seed=5, n=240, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    return [(i, (centres[i % 30] + rng.normal(size=dim) * rng.choice([0.02, 0.2, 0.35])).astype(np.float32).tolist(), int(i % 30) % 3) for i in range(n)]


def test_embeddings_recall_and_precision(spark, monkeypatch):
    monkeypatch.setattr(E, "BUCKET_ROWS", 8)
    rows = _vectors()
    got = {r["vec_id"]: r for r in E.embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    true = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :]) & ~np.eye(len(rows), dtype=bool)
    n = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (n <= true.sum(1)).all() and n.sum() >= 0.9 * true.sum() and true.sum() > 100


def test_embedding_cases(spark):
    v, nan = [1.0, 2.0, 3.0, 4.0], [float("nan"), 1.0, 1.0, 1.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0] * 4, 0), (8, nan, 0),
            (9, [1.0, None, 3.0, 4.0], 0), (10, [2.0, 4.0, 6.0, 8.0], 0), (11, [1.0, 2.0], 0), (None, v, 0)]
    got = E.embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert by[1]["n_links"] == 4 and by[10]["n_links"] == 4 and by[10]["component_id"] == 1 and by[None]["component_id"] == 1
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (3, 4, 5, 6, 7, 8, 9, 11))


def test_secrets_plan_has_near_duplicates_once(spark, docs_of):
    """The driver plans what follows the near-duplicates over written findings (F1): no Python step and few joins."""
    from pyspark.sql import functions as F

    from logvault.llm import secrets as S
    texts = [f"some words before the value password = {'Ab3' * 5}{i} and a few more words behind it" for i in range(6)]
    out = S.secret_report(docs_of(texts), F.col("lang"), F.col("source"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 0 and plan.count("Join") == 2
    assert [r["n_assign"] for r in out.collect()] == [1] * 6


def test_components_compute_edges_once(spark, monkeypatch):
    """Both directions of an edge come from one pass over ``edges`` (F1)."""
    from logvault.llm import common as C
    plans, write = [], C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    pairs = [(1, 2), (2, 3), (3, 3), (7, 6), (2, 1), (None, 4)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint").mapInArrow(lambda bs: bs, "a bigint, b bigint")
    got = {(r["node"], r["component"]) for r in C.connected_components(edges).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)}
    assert plans[0].count("MapInArrow") == 1

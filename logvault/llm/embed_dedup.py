"""Operator 8: embedding near-duplicates by iterative quantisation (ITQ).

1. Equal vectors of a label are one class with a multiplicity.
2. ITQ: on a bounded sample the vectors are centred and projected on principal
   directions, and a rotation is learnt that brings them closest to the corners
   of a cube; the signs are a balanced binary code (up to 64 bits) of every row.
3. Multi-index Hamming tables: the code is cut into ``TABLES`` chunks. Within
   radius 2 * TABLES - 1 some chunk has at most one wrong bit. Every vector
   stands in each table under its own chunk and, for each 0 bit, also as a query
   under the chunk with that bit set, so a pair meets once in a table.
4. In a bucket pairs are reranked with the original vectors in double precision.
   A pair counts in the first table where its chunks are within one bit, so
   nothing is counted twice and no pair leaves the bucket: only a count for each
   vector and a spanning forest of its links. Buckets beyond ``BUCKET_ROWS``
   are split into blocks that meet two by two.

Defined cases: null labels, null, empty, zero or non-finite vectors and vectors
of another dimension than their label's tables hold (the dimension takes part in
the key) link with nothing or only with their like; repeated rows are separate
rows that link; a null vec_id counts as a row but never names a component with
other ids. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.llm.common import connected_components, materialise, read_table, runs
from logvault.llm.near_dedup import _blocks

COSINE = 0.93
TABLES = 5
BITS = 64
SAMPLE_ROWS = 20_000
ITQ_ROUNDS = 40
BUCKET_ROWS = 1024


def _vectors(col) -> list[np.ndarray | None]:
    """Each list as doubles; None where it cannot be compared."""
    out = []
    for v in col.to_pylist():
        x = None if not v or None in v else np.array(v, np.float64)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _clean(batches):
    for b in batches:
        xs = _vectors(b.column(2))
        raw = [None if x is None else x.tobytes() for x in xs]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()),
             pa.array(raw, pa.binary())], ["vec_id", "label", "digest", "vec"])


class Itq:
    """Mean, projection and learnt rotation; ``codes`` gives signs as bits."""

    def __init__(self, x: np.ndarray, bits: int = BITS, rounds: int = ITQ_ROUNDS, seed: int = 3):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.mean = x.mean(0)
        bits = min(bits, x.shape[1])
        _, axes = np.linalg.eigh((x - self.mean).T @ (x - self.mean))
        axes = axes.T[::-1]  # principal directions, the largest first
        v = (x - self.mean) @ axes[:bits].T
        rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            b = np.sign(v @ rotation)
            left, _, right = np.linalg.svd(b.T @ v)
            rotation = (left @ right).T
        self.weights = axes[:bits].T @ rotation
        self.bits = bits

    def codes(self, x: np.ndarray) -> np.ndarray:
        on = ((x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean) @ self.weights) > 0
        return (on.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def chunks(bits: int, tables: int = TABLES) -> list[tuple[int, int]]:
    """(first bit, width) of each table's chunk."""
    cut = np.linspace(0, bits, tables + 1).astype(int)
    return [(int(a), int(z - a)) for a, z in zip(cut, cut[1:])]


def _table_rows(batches, models, tables):
    """(dim, tab, chunk, query, rep, label, mult, code, vec) rows of every class."""
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            s = b.slice(at, 2048)
            blobs = s.column(s.schema.get_field_index("vec")).to_pylist()
            dims = np.array([len(v) // 8 for v in blobs])
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                itq = models.value[int(dim)]
                x = np.frombuffer(b"".join([blobs[i] for i in rows]), np.float64).reshape(len(rows), dim)
                code = itq.codes(x)
                for t, (first, width) in enumerate(chunks(itq.bits, tables)):
                    chunk = (code >> np.uint64(first)) & np.uint64((1 << width) - 1)
                    who, key, query = [np.arange(len(rows))], [chunk], [np.zeros(len(rows), bool)]
                    for j in range(width):
                        off = np.flatnonzero((chunk >> np.uint64(j)) & np.uint64(1) == 0)
                        who.append(off)
                        key.append(chunk[off] | np.uint64(1 << j))
                        query.append(np.ones(len(off), bool))
                    who, n = np.concatenate(who), sum(map(len, who))
                    take = pa.array(rows[who])
                    get = lambda c: s.column(s.schema.get_field_index(c)).take(take)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)),
                         pa.array(np.concatenate(key).astype(np.int64)), pa.array(np.concatenate(query)), get("rep"), get("label"),
                         get("mult"), pa.array(code[who].view(np.int64)), get("vec")],
                        ["dim", "tab", "chunk", "query", "rep", "label", "mult", "code", "vec"])


def _first_table(diff: np.ndarray, tab: int, bits: int, tables: int) -> np.ndarray:
    """True where no earlier table has the chunks of ``diff`` (xor of two codes) within one bit."""
    new = np.ones(diff.shape, bool)
    for first, width in chunks(bits, tables)[:tab]:
        part = (diff >> np.uint64(first)) & np.uint64((1 << width) - 1)
        new &= (part & (part - np.uint64(1))) != 0
    return new


def _bucket_links(batches, threshold, tables):
    """(rep, n, other): links of each class in its buckets, and a forest edge where it has one."""
    for t, cuts in runs(batches, ["dim", "tab", "label", "chunk", "lo", "hi"]):
        col = lambda c: t.column(c).to_numpy()  # noqa: B023, E731
        rep, mult, code, query, blk = col("rep"), col("mult"), col("code").view(np.uint64), col("query"), col("blk")
        lo, hi, dim, tab, blobs = col("lo"), col("hi"), col("dim"), col("tab"), t.column("vec")
        counts, edges = {}, []
        for a, z in zip(cuts, cuts[1:]):
            if z - a < 2 or query[a:z].all():
                continue
            d, k = int(dim[a]), int(tab[a])
            x = np.frombuffer(b"".join(blobs.slice(a, z - a).to_pylist()), np.float64).reshape(-1, d)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            q, own, r = query[a:z], blk[a:z], rep[a:z]
            i, j = np.flatnonzero(~q), np.arange(z - a)
            for at in range(0, len(i), 256):
                ii = i[at:at + 256]
                hit = x[ii] @ x.T >= threshold
                # members pair with members once, and with every query; blocks meet in their own (lo, hi) alone
                hit &= q[j][None, :] | (r[ii][:, None] < r[None, :])
                if hi[a] != lo[a]:
                    hit &= own[ii][:, None] != own[None, :]
                hit &= r[ii][:, None] != r[None, :]
                p, s = np.nonzero(hit)
                if not len(p):
                    continue
                p = ii[p]
                keep = _first_table(code[a:z][p] ^ code[a:z][s], k, min(BITS, d), tables)
                p, s = p[keep], s[keep]
                for one, two in ((p, s), (s, p)):
                    who, n = np.unique(one, return_inverse=True)
                    n = np.bincount(n, mult[a:z][two], len(who))
                    for w, c in zip(r[who].tolist(), n.tolist()):
                        counts[w] = counts.get(w, 0) + int(c)
                # forest of these links: a tree edge to the smallest partner of each later vector
                edges.append(_spanning(r[p], r[s]))
        e = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        ids = np.array([*counts], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids, e[:, 0]])), pa.array(np.concatenate([np.array([*counts.values()], np.int64), np.zeros(len(e), np.int64)])),
             pa.array([*[None] * len(ids), *e[:, 1].tolist()], pa.int64())], ["rep", "n", "other"])


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A spanning forest of the edges (a, b)."""
    if not len(a):
        return np.zeros((0, 2), np.int64)
    top: dict[int, int] = {}

    def find(v):
        while top.setdefault(v, v) != v:
            top[v] = top[top[v]]
            v = top[v]
        return v

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = find(x), find(y)
        if u != v:
            top[max(u, v)] = min(u, v)
            out.append((x, y))
    return np.array(out, np.int64).reshape(-1, 2)


def embedding_links(vectors: DataFrame, threshold: float = COSINE, tables: int = TABLES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, label, embedding)."""
    spark = vectors.sparkSession
    src = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    rows = materialise(src.mapInArrow(_clean, f"vec_id {kinds['vec_id']}, label {kinds['label']}, digest binary, vec binary")
                       .withColumn("rid", F.monotonically_increasing_id()), "vectors")
    fit_for = F.col("digest").isNotNull() & F.col("label").isNotNull()
    classes = materialise(rows.filter(fit_for).groupBy("label", "digest").agg(
        F.min("rid").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.first("vec").alias("vec")), "vector-classes")
    dims = [x["d"] for x in classes.select((F.octet_length("vec") / 8).cast("int").alias("d")).distinct().collect()]
    models = {}
    for d in dims:  # as many as there are vector lengths
        sample = classes.filter(F.octet_length("vec") == 8 * d).orderBy(F.xxhash64("digest")).limit(sample_rows).select("vec").collect()
        models[d] = Itq(np.frombuffer(b"".join(bytes(r["vec"]) for r in sample), np.float64).reshape(-1, d))
    shared = spark.sparkContext.broadcast(models)
    entry = (classes.select("rep", "label", "mult", "vec").mapInArrow(partial(_table_rows, models=shared, tables=tables), (
        f"dim int, tab int, chunk bigint, query boolean, rep bigint, label {kinds['label']}, mult bigint, code bigint, vec binary")))
    key = ["dim", "tab", "label", "chunk"]
    # hot buckets are a small table: each has more than BUCKET_ROWS of the entries
    hot = materialise(entry.select(*key).groupBy(*key).agg(F.count("*").alias("size")).filter(F.col("size") > BUCKET_ROWS), "hot-buckets")
    sized = entry.join(hot, key, "left")
    blocked = _blocks(sized.withColumn("home", F.pmod(F.xxhash64("rep"), F.ceil(F.coalesce("size", F.lit(1)) / BUCKET_ROWS))), "chunk", "rep",
                      F.ceil(F.coalesce("size", F.lit(1)) / BUCKET_ROWS)).withColumnRenamed("home", "blk")
    found = (blocked.select(*key, "lo", "hi", "blk", "query", "rep", "mult", "code", "vec").repartition(*key, "lo", "hi")
             .sortWithinPartitions(*key, "lo", "hi")
             .mapInArrow(partial(_bucket_links, threshold=threshold, tables=tables), "rep bigint, n bigint, other bigint"))
    found = materialise(found, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = connected_components(found.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    linked = comp.withColumnRenamed("node", "rep").join(classes.select("rep", "least"), "rep")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = (classes.select("label", "digest", "rep", "least", "mult").join(counts, "rep", "left")
             .join(linked.select("rep", "component").join(least, "component").select("rep", "component_id"), "rep", "left")
             .select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                     F.coalesce("component_id", "least").alias("component_id")))
    out = rows.join(named, ["label", "digest"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"),
                      F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def op8_itq_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``, links at cosine 0.93 within a label."""
    return embedding_links(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_itq_embedding_dedup": op8_itq_embedding_dedup}
ORACLE_SQL: dict[str, str] = {}

"""Operator 2: MinHash near-duplicates by a multi-index Hamming join.

1. Each text becomes its set of five-word shingles (64-bit hashes), a digest of
   the whole set and a signature of 48 symbols: the low byte of 48 minima.
   Texts with equal sets are one class from here on.
2. Multi-index join: the signature is cut into 8 chunks of 6 symbols. By the
   pigeonhole principle two signatures that differ in at most 15 symbols have a
   chunk with at most one error, so every chunk is entered under its 6 masks
   (one symbol left out). All pairs within that distance meet under some key,
   whatever the size of its bucket.
3. In a bucket the signatures are compared; each component of the pairs within
   ``max_distance`` leaves it as a star around its smallest member: as many rows
   as members at most, and the same rows from every bucket of a group.
4. Connected stars are candidate groups. In each group the full shingle sets
   are compared and the components of the pairs with 100 * intersection >= 85 *
   union leave as stars; their components are the result.
5. Buckets beyond ``BUCKET_ROWS`` and groups beyond ``GROUP_ROWS`` meet a few
   pivots first. Members near to connected pivots are settled; only the rest
   goes on to meet all others, block by block (``group_links``).

A pair at exactly 85 % misses all keys with a probability below 1e-5 and the
signature filter with one below 2e-6. Lower thresholds get longer signatures and
a larger distance (``index_for``), so that the same bounds hold: 11 chunks, 66
symbols, at 80 %.

Defined cases: null, empty and blank texts have the empty set and are linked
with nothing; texts under five words are one shingle; repeated rows and equal
doc_ids are rows of their own (both ``kept`` if they share the smallest doc_id;
``deduplicate`` keeps one of them); a null doc_id is never a component's id
unless the component has no other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvault.llm.common import connected_components, materialise, pieces, read_table, runs, small_side, words

SHINGLE = 5
SYMBOLS, CHUNKS = 48, 8
CHUNK = SYMBOLS // CHUNKS
MAX_DISTANCE = 20  # looser than the guaranteed 15; full sets decide
PERCENT = 85
BUCKET_ROWS = 4096
GROUP_ROWS, GROUP_BYTES = 2048, 8 << 20
PIVOTS = 8

MISS_KEYS, MISS_DISTANCE = 1e-5, 2e-6
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def index_for(percent: int) -> tuple[int, int]:
    """(symbols, max_distance) with which a pair at exactly ``percent`` is missed no more often than the bounds.

    A symbol differs with the probability of different minima with different low bytes.
    """
    p = (1 - percent / 100) * 255 / 256
    missed = 1 - (1 - p) ** CHUNK - CHUNK * p * (1 - p) ** (CHUNK - 1)
    n = CHUNK * max(CHUNKS, math.ceil(math.log(MISS_KEYS) / math.log(missed)) if missed else 0)
    tail, d = 1.0, -1
    while tail > MISS_DISTANCE and d < n:
        d += 1
        tail = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(d + 1, n + 1))
    return n, max(d, MAX_DISTANCE)


@cache
def _multipliers(n: int) -> np.ndarray:
    """The first ``n`` odd multipliers of one sequence."""
    rng = np.random.default_rng(20)
    return np.array([rng.integers(1, 1 << 63, dtype=np.uint64) for _ in range(n)], np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words give one shingle."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(size, len(w))
    s = h[:len(h) - k + 1].copy()
    for j in range(1, k):
        s = s * _PRIME + h[j:len(h) - k + 1 + j]
    return np.unique(_mix(s + np.uint64(k)))


def signatures(sets: list[np.ndarray], symbols: int = SYMBOLS) -> np.ndarray:
    """One row of ``symbols`` bytes for each non-empty set."""
    flat, start = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), symbols), np.uint8)
    for i, a in enumerate(_multipliers(symbols)):
        out[:, i] = (np.minimum.reduceat(flat * a, start) >> np.uint64(20)).astype(np.uint8)
    return out


def _sign(batches, symbols):
    for part, texts in pieces(batches, "tx"):
        sets = [shingle_set(t) for t in texts]
        full = [s for s in sets if len(s)]
        sig = iter(signatures(full, symbols)) if full else iter(())
        rows = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(sig).tobytes()) if len(s) else (None, None) for s in sets]
        keep = [n for n in part.schema.names if n != "tx"]
        yield pa.RecordBatch.from_arrays(
            [*[part.column(part.schema.get_field_index(n)) for n in keep], pa.array([len(s) for s in sets], pa.int64()),
             pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
            [*keep, "n_shingles", "digest", "sig"])


def signed(docs: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """rid, doc_id, text hash, n_shingles, set digest and signature of each row; written once, without texts."""
    src = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("tx"))
    kind = src.schema["doc_id"].dataType.simpleString()
    out = src.mapInArrow(partial(_sign, symbols=symbols), f"doc_id {kind}, th bigint, n_shingles bigint, digest binary, sig binary")
    return materialise(out.withColumn("rid", F.monotonically_increasing_id()), "signatures")


def _grid(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)


def mask_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, symbols) keys: chunk c without its symbol j has key number c * CHUNK + j."""
    out = np.empty(sig.shape, np.int64)
    for c in range(sig.shape[1] // CHUNK):
        part = sig[:, c * CHUNK:(c + 1) * CHUNK].astype(np.int64)
        for j in range(CHUNK):
            key = np.full(len(sig), c * CHUNK + j, np.int64)
            for i in range(CHUNK):
                if i != j:
                    key = (key << 8) | part[:, i]
            out[:, c * CHUNK + j] = key
    return out


def _keyed(batches):
    for b in batches:
        for a in range(0, b.num_rows, 4096):
            s = b.slice(a, 4096)
            keys = mask_keys(_grid(s.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(s.column(0).to_numpy(), keys.shape[1]))],
                                             ["key", "rep"])


class SignatureKernel:
    """Signatures of one cell; near: at most ``limit`` symbols differ."""

    def __init__(self, blobs, limit: int):
        self.grid, self.limit = _grid(blobs), limit

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        return (self.grid[others] != self.grid[i]).sum(1) <= self.limit


class SetKernel:
    """Full shingle sets of one cell; near: a similarity of at least ``limit`` percent."""

    def __init__(self, blobs, limit: int):
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in blobs]
        self.size, self.limit = np.array([len(s) for s in sets]), limit
        self.start = np.cumsum(self.size) - self.size
        values, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), np.int32)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.code[self.start[i]:self.start[i] + self.size[i]]
        self.mark[own] = 1
        if len(others) * 4 < len(self.size):
            common = np.array([self.mark[self.code[self.start[j]:self.start[j] + self.size[j]]].sum() for j in others], np.int64)
        else:
            common = np.add.reduceat(self.mark[self.code], self.start)[others]
        self.mark[own] = 0
        return 100 * common >= self.limit * (self.size[i] + self.size[others] - common)


def _stars(n: int, near) -> list[tuple[int, int]]:
    """Edges from the first member of each connected component of 0..n-1 to its others; ``near(i, others)`` marks the neighbours of i."""
    out, left = [], np.arange(n)
    while len(left):
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            hit = near(queue.pop(), left)
            found = left[hit].tolist()
            out += [(root, j) for j in found]
            queue += found
            left = left[~hit]
    return out


def _pairs_batch(pairs) -> pa.RecordBatch:
    p = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])


def _star_edges(batches, kernel, limit):
    """Stars of every cell (grp, lo, hi), its rows in order of rep, so that cells with the same members give the same edges."""
    for t, cuts in runs(batches, ["grp", "lo", "hi"]):
        rep, data, found = t.column("rep").to_numpy(), t.column("data"), []
        for a, z in zip(cuts, cuts[1:]):
            reps, first = np.unique(rep[a:z], return_index=True)
            if len(reps) > 1:
                k = kernel(data.take(pa.array(first + a)), limit)
                found += [(reps[i], reps[j]) for i, j in _stars(len(reps), k.near)]
        yield _pairs_batch(found)


def _cross_edges(batches, kernel, limit):
    """An edge from each row of kind 0 to the first near row of kind 1 in its cell."""
    for t, cuts in runs(batches, ["grp", "lo", "hi"]):
        rep, kind, data, found = t.column("rep").to_numpy(), t.column("kind").to_numpy(), t.column("data"), []
        for a, z in zip(cuts, cuts[1:]):
            own, others = np.flatnonzero(kind[a:z] == 0), np.flatnonzero(kind[a:z] == 1)
            if len(own) and len(others):
                k = kernel(data.slice(a, z - a).combine_chunks(), limit)
                for i in own:
                    hit = np.flatnonzero(k.near(int(i), others))
                    if len(hit):
                        found.append((rep[a + i], rep[a + others[hit[0]]]))
        yield _pairs_batch(found)


def _pivot_masks(batches, kernel, limit):
    """(grp, rep, mask): bit b of the mask is set where the row is near the cell's pivot b."""
    for t, cuts in runs(batches, ["grp", "lo", "hi"]):
        grp, rep, bit, data = t.column("grp").to_numpy(), t.column("rep").to_numpy(), t.column("kind").to_numpy(), t.column("data")
        out = []
        for a, z in zip(cuts, cuts[1:]):
            pivots, rows = np.flatnonzero(bit[a:z] >= 0), np.flatnonzero(bit[a:z] < 0)
            mask = np.zeros(len(rows), np.int64)
            if len(rows):
                k = kernel(data.slice(a, z - a).combine_chunks(), limit)
                for i in pivots:
                    mask[k.near(int(i), rows)] |= 1 << int(bit[a + i])
            out.append((grp[a + rows], rep[a + rows], mask))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["grp", "rep", "mask"])


def _blocks(df: DataFrame, key: str, member: str, n_blocks) -> DataFrame:
    """Rows of groups with ``n_blocks`` > 1 once for every pair of blocks (lo <= hi) their block is in."""
    b = F.pmod(F.xxhash64(member), F.col("nb"))
    df = df.withColumn("nb", n_blocks.cast("bigint"))
    other = F.when(F.col("nb") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1))
    return (df.withColumn("blk", b).withColumn("other", F.explode(other))
            .withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")).drop("nb", "blk", "other"))


def _cell_edges(cells: DataFrame, work, kernel, limit: int) -> DataFrame:
    return (cells.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "rep")
            .mapInArrow(partial(work, kernel=kernel, limit=limit), "a bigint, b bigint"))


def group_links(small: DataFrame, large: DataFrame | None, kernel, limit: int) -> DataFrame:
    """Edges (a, b) with the components of all near pairs within the groups of (grp, rep, data, nb).

    Groups in ``small`` fit in a cell (nb = 1). Those in ``large``, if any, need
    ``nb`` blocks of rows; a few pivots come first: every member meets ``PIVOTS`` of them.
    The members near to pivots that hang together are one component and need
    no further comparison; the rest meets them, and itself, block by block. So
    copies of one text cost as many rows as members, not their square.
    """
    zero = F.lit(0).cast("bigint")
    edges = _cell_edges(small.select("grp", zero.alias("lo"), zero.alias("hi"), "rep", "data"), _star_edges, kernel, limit)
    if large is None:
        return edges
    large = materialise(large.select("grp", "rep", "data", F.col("nb").cast("bigint").alias("nb")), "large-groups")
    order = Window.partitionBy("grp").orderBy(F.xxhash64("rep"), "rep")
    pivots = large.withColumn("bit", F.row_number().over(order) - 1).filter(F.col("bit") < PIVOTS)
    cell = lambda df, lo, hi, kind: df.select("grp", lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), kind.cast("int").alias("kind"), "rep", "data")
    spread = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    met = (cell(large, block("nb"), zero, F.lit(-1))
           .unionByName(cell(pivots.withColumn("to", spread("nb")), F.col("to"), zero, F.col("bit"))))
    masks = materialise(met.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "rep")
                        .mapInArrow(partial(_pivot_masks, kernel=kernel, limit=limit), "grp bigint, rep bigint, mask bigint"), "pivot-masks")
    # the main component of a group: from the pivot with most members on, every mask that shares a bit
    votes = F.array(*[F.count_if(F.col("mask").bitwiseAND(1 << b) != 0) for b in range(PIVOTS)])
    per = masks.groupBy("grp").agg(votes.alias("votes"), F.collect_set("mask").alias("ms"))
    first = F.get(F.array(*[F.lit(1 << b).cast("bigint") for b in range(PIVOTS)]), (F.array_position("votes", F.array_max("votes")) - 1).cast("int"))
    grow = lambda m: F.aggregate("ms", m, lambda acc, x: F.when(acc.bitwiseAND(x) != 0, acc.bitwiseOR(x)).otherwise(acc))
    per = per.select("grp", F.aggregate(F.sequence(F.lit(1), F.lit(PIVOTS)), first, lambda m, _: grow(m)).alias("main_mask"))
    told = masks.join(per, "grp").select("grp", "rep", (F.col("mask").bitwiseAND(F.col("main_mask")) != 0).alias("main"))
    told = materialise(told, "pivot-sides")
    stat = told.groupBy("grp").agg(F.min(F.when(F.col("main"), F.col("rep"))).alias("hub"), F.count_if("main").alias("n_main"),
                                   F.count_if(~F.col("main")).alias("n_rest"))
    stars = told.filter("main").join(stat, "grp").filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    edges = edges.unionByName(stars)
    if not (unsettled := materialise(stat.filter("n_rest > 0"), "unsettled")).isEmpty():
        share = lambda n: F.greatest(F.ceil(F.col("nb") * F.col(n) / (F.col("n_main") + F.col("n_rest"))), F.lit(1)).cast("bigint")
        rows = large.join(unsettled, "grp").join(told, ["grp", "rep"]).withColumn("nr", share("n_rest")).withColumn("nm", share("n_main"))
        rows = materialise(rows.select("grp", "rep", "data", "main", "nr", "nm"), "unsettled-rows")
        rest, main = rows.filter("not main"), rows.filter("main")
        cross = (cell(rest.withColumn("to", spread("nm")), block("nr"), F.col("to"), F.lit(0))
                 .unionByName(cell(main.withColumn("to", spread("nr")), F.col("to"), block("nm"), F.lit(1))))
        inner = _blocks(rest, "grp", "rep", F.col("nr")).select("grp", "lo", "hi", "rep", "data")
        edges = edges.unionByName(_cell_edges(cross, _cross_edges, kernel, limit)).unionByName(_cell_edges(inner, _star_edges, kernel, limit))
    return edges


def candidate_groups(classes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(node, component): groups of classes connected by signature pairs."""
    keys = classes.select("rep", "sig").mapInArrow(_keyed, "key bigint, rep bigint")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialise(keys.join(shared, "key").select(
        F.col("key").alias("grp"), "rep", F.ceil(F.col("n") / BUCKET_ROWS).alias("nb")), "bucket-members")
    signed_rows = lambda df: df.join(classes.select("rep", F.col("sig").alias("data")), "rep")
    large = members.filter("nb > 1")
    edges = group_links(signed_rows(members.filter("nb = 1")), None if large.isEmpty() else signed_rows(large), SignatureKernel, max_distance)
    return connected_components(edges.distinct())


def _with_sets(batches):
    for part, texts in pieces(batches, "tx"):
        sets = [shingle_set(t) for t in texts]
        keep = [n for n in part.schema.names if n != "tx"]
        yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in keep],
                                          pa.array([s.tobytes() for s in sets], pa.binary())], [*keep, "shingles"])


def links(docs: DataFrame, classes: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) with the components of the confirmed links, by full shingle sets."""
    per_group = groups.join(classes.select(F.col("rep").alias("node"), "n_shingles", "pick", "mult"), "node")
    sizes = per_group.groupBy("component").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total"))
    want = materialise(per_group.join(sizes, "component").select(
        F.col("node").alias("rep"), "component", F.col("pick.doc_id").alias("pick_id"), F.col("pick.th").alias("pick_th"), "mult",
        F.greatest(F.ceil(F.col("members") / GROUP_ROWS), F.ceil(F.col("total") * 8 / GROUP_BYTES)).alias("n")), "candidates")
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("tx"))

    def sets(some):
        hit = (texts.join(small_side(some, 64), F.col("d").eqNullSafe(F.col("pick_id")) & (F.col("h") == F.col("pick_th")))
               .select("rep", "component", "n", "mult", "tx"))
        # a text whose row is repeated comes once: partial aggregates leave one for each task
        once = hit.filter("mult > 1").groupBy("rep").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.first("tx").alias("tx"))
        hit = hit.filter("mult = 1").select("rep", "component", "n", "tx").unionByName(once)
        return hit.mapInArrow(_with_sets, "rep bigint, component bigint, n bigint, shingles binary").select(
            F.col("component").alias("grp"), "rep", F.col("shingles").alias("data"), F.col("n").alias("nb"))

    large = want.filter("n > 1")
    return group_links(sets(want.filter("n = 1")), None if large.isEmpty() else sets(large), SetKernel, percent)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rid, doc_id, th, n_shingles, component_id, kept, keeper (the one row of its component that stays)."""
    symbols, max_distance = index_for(percent)
    rows = signed(docs, symbols)
    # one class for each distinct set; partial minima, so a set that a third of the rows share is a row a task
    classes = materialise(rows.filter("digest is not null").groupBy("digest").agg(
        F.min("rid").alias("rep"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"),
        F.first("n_shingles").alias("n_shingles"), F.count("*").alias("mult"), F.min_by(F.struct("doc_id", "th"), "rid").alias("pick"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("first_rid")), "classes")
    groups = candidate_groups(classes, max_distance)
    joined = connected_components(links(docs, classes, groups, percent))
    linked = joined.join(classes.select(F.col("rep").alias("node"), "least", "first_rid"), "node")
    best = linked.groupBy("component").agg(
        F.min("least").alias("component_id"),
        F.min(F.struct(F.col("least").isNull(), "least", "first_rid"))["first_rid"].alias("keep_rid"))
    named = classes.join(linked.join(best, "component").select(F.col("node").alias("rep"), "component_id", "keep_rid"), "rep", "left")
    named = named.select("digest", F.coalesce("component_id", "least").alias("component_id"),
                         F.coalesce("keep_rid", "first_rid").alias("keep_rid"))
    return (rows.join(named, "digest", "left").select(
        "rid", "doc_id", "th", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("digest").isNull() | (F.col("rid") == F.col("keep_rid"))).alias("keeper"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component (and every row without words)."""
    marked = materialise(near_duplicates(docs, percent).select("doc_id", "th", "keeper"), "dedup-marks")
    # rows are found again by (doc_id, text hash); equal pairs are repeats of one row
    pairs = (marked.groupBy("doc_id", "th").agg(F.max("keeper").alias("stays"), F.count("*").alias("n"))
             .select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), "stays", "n"))
    odd = materialise(pairs.filter("not stays or n > 1"), "dedup-odd")
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("k_id")) & (F.xxhash64("row.text") == F.col("k_th"))
    out = src.join(small_side(odd, 32), same, "left").filter("stays is null or stays")
    blank = ~F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    repeat = F.coalesce(F.col("n") > 1, F.lit(False)) & ~blank
    once = out.filter(~repeat).select("row.*")
    again = out.filter(repeat).select("row.*").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)


def op2_minhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, links at 85 %."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op2_minhash_multi_index": op2_minhash_multi_index}
ORACLE_SQL: dict[str, str] = {}

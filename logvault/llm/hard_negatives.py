"""Operator 12: hard-negative mining by slot-decomposed selection.

Every anchor has up to ``POSITIVES`` positives, the best rows of its own label;
each positive asks for the best rows of other labels whose score lies within
[LOW, HIGH] percent of its own. These windows overlap.

1. Vectors become integer vectors floor(256 * x); scores are exact integers.
2. Anchors are cut into blocks of bounded bytes, rows into slices; a cell
   (block, slice) is compared by matrix products in one task. The first pass
   keeps the best rows of the anchor's own label: the positives.
3. The positives' upper limits split the scores of an anchor into disjoint
   slots. In the second pass a cell is a combiner that keeps the best ``k`` of
   each slot (nothing below the slot's lowest window), whatever the number of
   rows. A window function keeps the best ``k`` of a slot over all cells.
4. Slots joined in falling order are sorted by score, so the first k of the
   suffix from a positive's slot on, cut at its lower limit, answer its window.

Scale: the anchors are a stated query set against all rows. Rows are copied
once a block and anchors once a slice; cells are even whatever the labels, so a
label that a third of the rows carry is no hot task. Nothing reaches the driver
but counts.

Defined cases: rows with a null label, vec_id or vector, or a null or
non-finite component take no part, nor do vectors with a component so large
that a score could leave the long range; vectors of different lengths do not
meet; an empty vector scores 0; "other" rows are those of another vec_id;
repeated rows are rows of their own (a repeated anchor answers once for each
row, a repeated candidate takes as many ranks); positives below zero have an
empty window; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvault.llm.common import materialise, read_table

SCALE = 256
ANCHOR_EVERY, MOVED_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: Bytes of one block of anchors and of one slice of rows.
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 64 << 20
TILE = 1024
_NONE = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (integers floor(scale * x)) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    src = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.alias("x"), v.alias("v"))
    finite = F.forall("x", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    # size * most^2 fits in a long, and most in an int
    most = F.least(F.lit(float(2**31 - 1)), F.floor(F.sqrt(F.lit(9.2e18) / F.greatest(F.size("x"), F.lit(1)))).cast("double"))
    fits = F.forall("x", lambda c: F.abs(c * F.lit(float(scale))) < most)
    return src.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite & fits
                      ).select("vec_id", "label", F.col("v").cast("array<int>").alias("v"))


class _Best:
    """The best ``k`` (score, id) of each slot of each anchor; ids come in rising order."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.n = k, anchors * slots
        self.slots = slots
        self.score = np.full((self.n, k), _NONE, np.int64)
        self.ids = np.full((self.n, k), _NONE, np.int64)

    def floor(self, rows: slice, slot: int) -> np.ndarray:
        """A score must exceed this to enter: rows come in id order, so ties lose."""
        return self.score[rows.start * self.slots + slot:rows.stop * self.slots:self.slots, -1]

    def put(self, where: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (place, score, id); all that place's earlier ones stay if they are better."""
        touched = np.unique(where)
        w = np.concatenate([where, np.repeat(touched, self.k)])
        s = np.concatenate([score, self.score[touched].ravel()])
        i = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((i, ~s, w))
        w, s, i = w[order], s[order], i[order]
        start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        rank = np.arange(len(w)) - np.repeat(start, np.diff(np.r_[start, len(w)]))
        keep = rank < self.k
        self.score[w[keep], rank[keep]] = s[keep]
        self.ids[w[keep], rank[keep]] = i[keep]


class _Cell:
    """One block of anchors, met by the rows of one slice in batches."""

    def __init__(self, same: bool, k: int):
        self.same, self.k, self.parts, self.dims = same, k, [], None

    def anchors(self, b) -> None:
        self.parts.append(b)

    def _settle(self) -> None:
        t = pa.Table.from_batches(self.parts).combine_chunks() if self.parts else None
        self.dims = {}
        if t is None:
            return
        for d, rows, x in _matrices(t.column("v").combine_chunks()):
            get = lambda c: t.column(c).to_numpy()[rows]  # noqa: B023, E731
            order = np.argsort(get("label"), kind="stable")
            up = _lists(t.column("up").combine_chunks(), rows)[order]
            down = _lists(t.column("down").combine_chunks(), rows)[order]
            self.dims[d] = (get("aid")[order], get("vec_id")[order], get("label")[order], x[order], up, down,
                            _Best(len(rows), max(1, up.shape[1]), self.k))

    def rows(self, b) -> None:
        if self.dims is None:
            self._settle()
        ids, labels = b.column(b.schema.get_field_index("vec_id")).to_numpy(), b.column(b.schema.get_field_index("label")).to_numpy()
        for d, rows, x in _matrices(b.column(b.schema.get_field_index("v"))):
            if d in self.dims:
                for at in range(0, len(rows), TILE):
                    r = rows[at:at + TILE]
                    self._meet(self.dims[d], ids[r], labels[r], x[at:at + TILE])

    def _meet(self, block, ids, labels, x) -> None:
        _, own, label, m, up, down, best = block
        for at in range(0, len(own), TILE):
            rows = slice(at, min(at + TILE, len(own)))
            # anchors stand in label order: only the labels of this tile meet rows of their own
            if self.same:
                hit = (labels >= label[rows.start]) & (labels <= label[rows.stop - 1])
                if not hit.any():
                    continue
                xs, ls, js = x[hit], labels[hit], ids[hit]
                fits = ls[None, :] == label[rows][:, None]
                fits &= js[None, :] != own[rows][:, None]
            else:
                xs, ls, js = x, labels, ids
                fits = ls[None, :] != label[rows][:, None]
                fits &= js[None, :] != own[rows][:, None]
            s = _products(m[rows], xs)
            for slot in range(best.slots):
                good = s > best.floor(rows, slot)[:, None]
                if up.shape[1]:  # slot j: scores up to its own limit, above the next one, in some window
                    good &= s <= up[rows, slot][:, None]
                    good &= s >= down[rows, slot][:, None]
                    if slot + 1 < best.slots:
                        good &= s > up[rows, slot + 1][:, None]
                good &= fits
                a, j = np.nonzero(good)
                if len(a):
                    best.put((a + rows.start) * best.slots + slot, s[a, j].astype(np.int64), js[j])

    def result(self):
        for aid, _, _, _, _, _, best in (self.dims or {}).values():
            w, k = np.nonzero(best.score > _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(aid[w // best.slots]), pa.array((w % best.slots).astype(np.int32)),
                                              pa.array(best.score[w, k]), pa.array(best.ids[w, k])], ["aid", "slot", "score", "id"])


def _matrices(col):
    """(length, rows, matrix) of the list column for each length of vector."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy()
    flat, size = col.values.to_numpy(), np.diff(off)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, flat[off[rows][:, None] + np.arange(d)].astype(np.int64)


def _lists(col, rows) -> np.ndarray:
    """Limits of some rows as a matrix; a shorter list is filled with limits that admit nothing."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy()
    flat, size = col.values.to_numpy(), np.diff(off)[rows]
    out = np.full((len(rows), int(size.max(initial=0))), _NONE, np.int64)
    for j in range(out.shape[1]):
        has = size > j
        out[has, j] = flat[off[rows][has] + j]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floating point where all partial sums are exact."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 24:
        return a.astype(np.float32) @ b.T.astype(np.float32)
    if most < 1 << 53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    return a @ b.T


def _compare(batches, same, k):
    cell, at = None, None
    for b in batches:
        where, kind = b.column(b.schema.get_field_index("cell")).to_numpy(), b.column(b.schema.get_field_index("is_row")).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((where[1:] != where[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
            if z == a:
                continue
            if where[a] != at:
                if cell:
                    yield from cell.result()
                cell, at = _Cell(same, k), where[a]
            (cell.rows if kind[a] else cell.anchors)(b.slice(a, z - a))
    if cell:
        yield from cell.result()


def slot_tops(anchors: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """(aid, slot, score, id, rank): the best ``k`` rows of each slot of each anchor.

    ``anchors``: aid, vec_id, label, v and the falling limits ``up`` with the
    least wanted scores ``down`` (empty lists: one slot without limits); ``rows``:
    rid, vec_id, label, v. Both are written tables. Rows of the anchor's own label
    count if ``same``, else those of other labels.
    """
    width = F.size("v").cast("bigint") * 4 + 64
    a_bytes, r_bytes = (df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0] for df in (anchors, rows))
    blocks = max(1, -(-a_bytes // BLOCK_BYTES))
    tasks = anchors.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-r_bytes // SLICE_BYTES), -(-2 * tasks // blocks))
    none = F.array().cast("array<bigint>")
    a = (anchors.withColumn("block", F.pmod(F.xxhash64("aid"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
         .select((F.col("block") * slices + F.col("part")).alias("cell"), F.lit(False).alias("is_row"), "aid", "vec_id", "label", "v", "up", "down"))
    r = (rows.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(slices))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
         .select((F.col("block") * slices + F.col("part")).alias("cell"), F.lit(True).alias("is_row"), F.lit(None).cast("bigint").alias("aid"),
                 "vec_id", "label", "v", none.alias("up"), none.alias("down")))
    met = (a.unionByName(r).repartition(min(blocks * slices, 1 << 16), "cell").sortWithinPartitions("cell", "is_row", "vec_id")
           .mapInArrow(partial(_compare, same=same, k=k), "aid bigint, slot int, score bigint, id bigint"))
    best = Window.partitionBy("aid", "slot").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, v of ``integer_vectors``. Of each anchor and each of
    its best ``positives`` rows of the same label, the best ``negatives`` rows of
    other labels whose score is within [low, high] percent of the positive's.
    """
    rows = materialise(rows.select("vec_id", "label", "v").withColumn("rid", F.monotonically_increasing_id()), "vectors")
    no_limit = F.array().cast("array<bigint>")
    anchors = materialise(rows.filter(is_anchor).withColumnRenamed("rid", "aid")
                          .withColumn("up", no_limit).withColumn("down", no_limit), "anchors")
    pos = (slot_tops(anchors, rows, positives, same=True).filter("score >= 0")
           .select("aid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("slot")))
    # a window holds the scores from ceil(low * p / 100) to floor(high * p / 100)
    lists = pos.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_id", "positive_score"))).alias("pos"))
    whole = lambda x, percent: x["positive_score"].cast("decimal(19,0)") * percent
    lists = materialise(lists.select(
        "aid", "pos", F.transform("pos", lambda x: F.floor(whole(x, high) / 100).cast("bigint")).alias("up"),
        F.transform("pos", lambda x: F.ceil(whole(x, low) / 100).cast("bigint")).alias("down")), "positives")
    windows = materialise(anchors.drop("up", "down").join(lists.select("aid", "up", "down"), "aid"), "windows")
    found = materialise(slot_tops(windows, rows, negatives, same=False), "slot-tops")
    tops = found.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("fall"), "id"))).alias("tops"))
    asked = (anchors.select("aid", F.col("vec_id").alias("anchor_id")).join(lists, "aid").join(tops, "aid")
             .select("anchor_id", "tops", F.posexplode(F.arrays_zip("pos", "down")).alias("slot", "ask")))
    suffix = F.slice(F.filter("tops", lambda t: t["slot"] >= F.col("slot")), 1, negatives)
    out = asked.select("anchor_id", F.col("ask.pos.positive_id").alias("positive_id"), F.col("ask.pos.positive_score").alias("positive_score"),
                       F.col("ask.down").alias("least"), F.posexplode(suffix).alias("place", "neg"))
    return out.filter(-F.col("neg.fall") >= F.col("least")).select(
        "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("neg.id").alias("negative_id"),
        "positive_score", (-F.col("neg.fall")).alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``; anchors are those whose id is divisible by 50."""
    rows = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % ANCHOR_EVERY == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}

ORACLE_SQL = {"op12_hard_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) <= 3
"""}

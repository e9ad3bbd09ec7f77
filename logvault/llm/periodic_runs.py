"""Operator 13: periodic word runs by descending-LCP Kruskal.

A run is a stretch of consecutive words with smallest period q and a length of
at least ``max(MIN_LENGTH, MIN_EXPONENT * q)`` that cannot be extended.

1. Only words whose next five recur in the same text can seed a run, so a
   rolling hash finds those positions; prefix doubling sorts their suffixes
   exactly (a hash decides nothing else) and gives the LCP of neighbours.
2. Kruskal over the neighbours by falling LCP: union-find joins suffix classes
   whose positions are kept in order. When a level ends, two positions i < j
   that have become neighbours in their class share exactly l words; if j - i
   is within l / (MIN_EXPONENT - 1) and the words before them differ, the run
   starts at i, has period j - i and the length j - i + l. Neighbours in a class
   have no closer repeat, so j - i is the smallest period.
3. Classes whose nearest positions lie too far apart for their longest LCP are
   left out beforehand; no run can come from them.

Each document is worked on alone, in slices of about 1 MB of text: no shuffle,
and a group of copies is no hot key. Memory grows with the longest text (about
200 bytes a word in recurring passages).

Defined cases: null, empty and blank texts have no words and no runs; repeated
rows give a row each; a null doc_id is carried through (``op13`` leaves its
words as they are); other columns are not read, so none can clash; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.llm.common import pieces, read_table

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: A run has period q and shares at least max(MIN_LENGTH - q, (MIN_EXPONENT - 1) * q) words with itself q later: five or more.
SEED = min(max(MIN_LENGTH - q, (MIN_EXPONENT - 1) * q) for q in range(1, MIN_LENGTH))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
PART = 1024  # positions in a part of an ordered set


class Positions:
    """An ordered set of integers in parts of bounded length."""

    __slots__ = ("heads", "parts", "n")

    def __init__(self, first: int):
        self.heads, self.parts, self.n = [first], [[first]], 1

    def add(self, x: int) -> None:
        k = max(0, bisect_left(self.heads, x) - 1) if len(self.heads) > 1 else 0
        part = self.parts[k]
        part.insert(bisect_left(part, x), x)
        self.heads[k] = part[0]
        self.n += 1
        if len(part) > 2 * PART:
            self.parts.insert(k + 1, part[PART:])
            self.heads.insert(k + 1, part[PART])
            del part[PART:]

    def around(self, x: int) -> tuple[int, int]:
        """The members before and after ``x``, -1 where there is none."""
        k = max(0, bisect_left(self.heads, x + 1) - 1) if len(self.heads) > 1 else 0
        part = self.parts[k]
        at = bisect_left(part, x)
        before = part[at - 1] if at else self.parts[k - 1][-1] if k else -1
        at += at < len(part) and part[at] == x
        after = part[at] if at < len(part) else self.parts[k + 1][0] if k + 1 < len(self.parts) else -1
        return before, after

    def __iter__(self):
        return chain.from_iterable(self.parts)


def _recurring(w: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions whose next ``SEED`` words seem to recur in their document; none that recur is lost."""
    n = len(w) - SEED + 1
    if n < 2:
        return np.zeros(0, np.int64)
    h = w.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
    s = doc[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    for j in range(SEED):
        s = s * _PRIME + h[j:n + j]
    s ^= s >> np.uint64(29)
    inside = np.flatnonzero(doc[:n] == doc[SEED - 1:])
    if SEED > 1:  # a text's end mark belongs to no window
        inside = inside[w[inside + SEED - 1] >= 0]
    s = s[inside]
    ranked = np.sort(s)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    at = np.searchsorted(twice, s)
    return inside[twice[np.minimum(at, len(twice) - 1)] == s]


def _ranks(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def suffix_neighbours(w: np.ndarray, doc: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, l, class): neighbours in the suffix order of positions ``p`` that share l >= ``SEED`` words, and the class of their first words.

    ``w`` holds word numbers, each document ending in a negative mark of its own.
    The places ``SEED`` words on are ranked too: they settle the order where a repeat ends.
    """
    recurring = np.zeros(len(w) + SEED, bool)
    recurring[p] = recurring[p + SEED] = True
    p = np.flatnonzero(recurring[:len(w)])
    m, low = len(p), int(w.min())
    wide = int(w.max()) - low + 1
    r = _ranks(doc[p] * wide + w[p] - low)
    for j in range(1, SEED):
        r = _ranks(r * wide + w[np.minimum(p + j, len(w) - 1)] - low)
    size = np.bincount(r)
    start = np.cumsum(size) - size
    r = start[r]  # a class is named by its place in the suffix order
    first = r
    at = np.full(len(w) + 1, -1, np.int64)
    at[p] = np.arange(m)
    levels, span = [], SEED
    active = np.flatnonzero(np.bincount(r, minlength=m)[r] > 1)
    while len(active):
        levels.append(r)
        second = r[at[p[active] + span]]
        order = np.argsort(r[active] * m + second, kind="stable")
        a, s = active[order], second[order]
        cls = r[a]
        new_cls = np.r_[True, cls[1:] != cls[:-1]]
        new_sub = new_cls | np.r_[True, s[1:] != s[:-1]]
        i = np.arange(len(a))
        base, sub = np.maximum.accumulate(np.where(new_cls, i, 0)), np.maximum.accumulate(np.where(new_sub, i, 0))
        r = r.copy()
        r[a] = cls + sub - base
        count = np.bincount(r[a], minlength=m)
        active = a[count[r[a]] > 1]
        span *= 2
    order = np.argsort(r)
    x, y = order[:-1], order[1:]
    keep = first[x] == first[y]
    x, y = x[keep], y[keep]
    l = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = at[p[x] + l], at[p[y] + l]
        same = (a >= 0) & (b >= 0)
        same[same] = levels[k][a[same]] == levels[k][b[same]]
        l[same] += SEED << k
    more = np.ones(len(x), bool)
    for _ in range(SEED - 1):
        more &= w[p[x] + l] == w[p[y] + l]
        l[more] += 1
    return p[x], p[y], l, first[x]


def _possible(x, y, l, cls) -> np.ndarray:
    """True for neighbours in classes whose nearest positions are close enough for their longest LCP."""
    where, c = np.concatenate([x, y]), np.concatenate([cls, cls])
    order = np.lexsort((where, c))
    where, c = where[order], c[order]
    gap = np.where((c[1:] == c[:-1]) & (where[1:] > where[:-1]), where[1:] - where[:-1], np.iinfo(np.int64).max // MIN_EXPONENT)
    n = int(cls.max()) + 1
    near, far = np.full(n, np.iinfo(np.int64).max // MIN_EXPONENT), np.zeros(n, np.int64)
    np.minimum.at(near, c[:-1], gap)
    np.maximum.at(far, cls, l)
    return (MIN_EXPONENT - 1) * near[cls] <= far[cls]


def find_runs(w: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, start as a place in ``w``."""
    p = _recurring(w, doc)
    if len(p) < 2:
        return []
    x, y, l, cls = suffix_neighbours(w, doc, p)
    if not len(x):
        return []
    keep = _possible(x, y, l, cls)
    x, y, l = x[keep], y[keep], l[keep]
    order = np.argsort(-l, kind="stable")
    ends = np.flatnonzero(np.r_[l[order][1:] != l[order][:-1], True]) if len(order) else []
    ex, ey, el = x[order].tolist(), y[order].tolist(), l[order].tolist()
    top: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    after: dict[int, int] = {}
    out, at = [], 0

    def find(v):
        root = top.setdefault(v, v)
        while top[root] != root:
            root = top[root]
        while top[v] != root:
            top[v], v = root, top[v]
        return root

    for end in ends:
        level, touched = el[end], []
        for k in range(at, end + 1):
            a, b = find(ex[k]), find(ey[k])
            if a == b:
                continue
            sa, sb = sets.pop(a, None) or Positions(a), sets.pop(b, None) or Positions(b)
            if sa.n < sb.n:
                a, b, sa, sb = b, a, sb, sa
            top[b] = a
            sets[a] = sa
            new = list(sb)
            for v in new:
                sa.add(v)
            for v in new:
                before, behind = sa.around(v)
                if before >= 0 and after.get(before) != v:
                    after[before] = v
                    touched.append(before)
                if behind >= 0 and after.get(v) != behind:
                    after[v] = behind
                    touched.append(v)
        at = end + 1
        for i in set(touched):
            q = after[i] - i
            if (MIN_EXPONENT - 1) * q <= level and q + level >= MIN_LENGTH and w[i - 1] != w[i + q - 1]:
                out.append((i, q + level, q))
    return out


def _work(batches, edit):
    for part, texts in pieces(batches, "tx"):
        ids = part.column(0).to_pylist()
        split = [t.split() for t in texts]
        if edit:
            split = [edit(i, s) for i, s in zip(ids, split)]
        number: dict[bytes, int] = {}
        flat = []
        for k, s in enumerate(split):
            flat += [number.setdefault(v, len(number)) for v in s]
            flat.append(-1 - k)
        w = np.array(flat, np.int64)
        n = np.array([len(s) for s in split])
        doc = np.repeat(np.arange(len(split)), n + 1)
        first = np.cumsum(n + 1) - n - 1
        runs: dict[int, list] = {}
        for i, length, q in find_runs(w, doc):
            k = int(doc[i])
            runs.setdefault(k, []).append((i - int(first[k]), length, q))
        collapsed = []
        for k, s in enumerate(split):
            if k in runs:
                runs[k].sort(key=lambda r: (r[0], r[2]))
                stays = np.ones(len(s), bool)
                for i, length, q in runs[k]:
                    stays[i + q:i + length] = False
                s = [v for v, keep in zip(s, stays.tolist()) if keep]
            collapsed.append(b" ".join(s))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n, pa.int64()),
             pa.array([[{"start": a, "length": b, "period": c} for a, b, c in runs.get(k, [])] for k in range(len(split))], kind),
             pa.array(collapsed, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])


def word_runs(docs: DataFrame, edit=None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of each row.

    The collapsed text keeps, of each run, its first period: words that any run
    contains after its first q words are dropped, the rest joined by one space.
    ``edit(doc_id, words)`` may replace the words of a document beforehand.
    """
    src = docs.select("doc_id", F.col("text").cast("binary").alias("tx"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(partial(_work, edit=edit), f"doc_id {kind}, n_words bigint, "
                          "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
                          ).withColumn("collapsed", F.col("collapsed").cast("string"))


def planted_tail(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of op13's documents: where crc32(doc_id) ends in 0, the tail from word a on repeats p words."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


def best_run(runs):
    """The run of greatest exact length / period; ties: smallest start, then period (the order of ``runs``)."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their words edited by ``planted_tail``."""
    found = word_runs(read_table(spark, sf_dir, "documents"), planted_tail)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = best_run(F.col("runs"))
    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
#: Maximal repetitions have no SQL that reads whole texts in reasonable time; brute force in the tests.
ORACLE_SQL: dict[str, str] = {}

"""Operator 1: toxicity by class-conditional Kneser-Ney models.

Two models of word spelling (bytes of a word, up to seven bytes of context from
the word start on) are estimated on a bounded sample of labelled documents, one
for toxic and one for ordinary texts. Both discount their own counts and give
the freed mass to the same lower orders, Kneser-Ney continuation counts pooled
over both classes, so a rare expression, or a new ending of a known stem, is
smoothed by shared counts and not by the class with more data. Where neither
class knows a context the shared terms cancel and the log ratio is 0.

A document's evidence is the log-likelihood ratio per word (mean, best window,
mean excess of strong words, the strongest words); a logistic calibration fitted on sample
documents the models have not seen turns it into a probability.

Defined cases: null and empty texts have no evidence and get the score of zero
evidence; without labels of both classes every score is the base rate, else 0.5;
repeated rows are scored one by one.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.llm.common import crc_mod, pieces, read_table
from logvault.llm.labelled import training_sample

ORDER = 8  # bytes of a gram, so that a gram is one 64-bit integer
SAMPLE_ROWS = 2500  # of each class
CALIBRATION_SHARE = 4  # every fourth sample row calibrates
THRESHOLD = 0.7
WINDOW = 32
STRONG = 3.0
START, END = 2, 3
CACHE_WORDS = 300_000
_FULL = np.uint64(8)


def _keys(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Top grams of every byte of every word and the word of each: the last
    ``ORDER`` bytes up to there, or all from the start mark on."""
    n = np.array([len(w) + 1 for w in batch])
    width = int(n.max())
    grid = np.zeros((len(batch), width), np.uint8)
    flat = np.frombuffer(b"".join(w + bytes([END]) for w in batch), np.uint8)
    at = np.arange(width) < n[:, None]
    grid[at] = flat
    key, out = np.full(len(batch), START, np.uint64), np.empty((len(batch), width), np.uint64)
    for j in range(width):
        key = (key << _FULL) | grid[:, j]
        out[:, j] = key
    return out[at], np.repeat(np.arange(len(batch)), n)


def _context(keys: np.ndarray) -> np.ndarray:
    return keys >> _FULL


def _length(keys: np.ndarray) -> np.ndarray:
    return sum((keys >> np.uint64(8 * i) > 0).astype(np.int64) for i in range(ORDER))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[i] == keys, i, -1)


def _sums(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.bincount(inv, weight, len(u))


def _discount(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2, 3 and more."""
    n = [max(1, int((counts == k).sum())) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k] if k else 1 - 2 * y * n[1] / n[0], 0.1), k + 0.9) for k in (0, 1, 2)]
    return np.select([counts <= 1, counts <= 2], d[:2], d[2])


def _conditional(grams, counts, backoff):
    """P(last byte | the rest) of each gram from discounted counts and its ``backoff`` probability."""
    d = np.minimum(_discount(counts), counts)
    ctx, inv = np.unique(_context(grams), return_inverse=True)
    total, freed = np.bincount(inv, counts), np.bincount(inv, d)
    return (counts - d + freed[inv] * backoff) / total[inv], ctx, freed / total


class KneserNeyRatio:
    """log P(byte | context, toxic) - log P(byte | context, ordinary), tabulated.

    ``grams``/``ratio`` hold the grams either class has seen; elsewhere the ratio
    is that of the freed masses of the context (``contexts``/``freed``).
    """

    def __init__(self, counts: dict[bytes, tuple[int, int]]):
        self.seen: dict[bytes, float] = {}  # ratios of words met by this model, in this process
        vocabulary = list(counts)
        keys, owner = [], []
        for a in range(0, len(vocabulary), 20_000):
            k, o = _keys(vocabulary[a:a + 20_000])
            keys.append(k)
            owner.append(o + a)
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        n = np.array([counts[w] for w in vocabulary], np.float64)
        grams, inv = np.unique(keys, return_inverse=True)
        by_class = [np.bincount(inv, n[owner, c], len(grams)) for c in (0, 1)]
        shared = self._shared(grams)
        logs, contexts, masses = [], [], []
        for own in by_class:
            seen = own > 0
            p = shared.copy()  # a context the class has not seen leaves all to the shared model
            p_seen, ctx, freed = _conditional(grams[seen], own[seen], shared[seen])
            at = _find(ctx, _context(grams))
            p = np.where(at >= 0, freed[at] * shared, p)
            p[seen] = p_seen
            logs.append(np.log(np.maximum(p, 1e-12)))
            contexts.append(ctx)
            masses.append(np.log(np.maximum(freed, 1e-12)))
        self.grams, self.ratio = grams, (logs[1] - logs[0]).astype(np.float32)
        self.contexts = np.union1d(*contexts)
        at = [_find(c, self.contexts) for c in contexts]
        self.freed = (np.where(at[1] >= 0, masses[1][at[1]], 0) - np.where(at[0] >= 0, masses[0][at[0]], 0)).astype(np.float32)

    @staticmethod
    def _shared(top: np.ndarray) -> np.ndarray:
        """Pooled continuation probability of each top gram without its first byte."""
        size = _length(top)
        level = {ORDER: top[size == ORDER]}
        tables = {}
        for m in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << 8 * m) - 1)
            tables[m] = _sums(level[m + 1] & mask, np.ones(len(level[m + 1])))  # distinct bytes to the left
            level[m] = np.concatenate([tables[m][0], top[(size == m)]])
        p, found = None, {}
        for m in range(1, ORDER):
            grams, counts = tables[m]
            if m == 1:
                back = np.full(len(grams), 1 / 256)
            else:
                i = _find(tables[m - 1][0], grams & np.uint64((1 << 8 * (m - 1)) - 1))
                back = np.where(i >= 0, found[m - 1][i], 1 / 256)
            p, _, _ = _conditional(grams, counts, back)
            found[m] = p
        out = np.full(len(top), 1 / 256)
        for m in range(2, ORDER + 1):
            sel = size == m
            i = _find(tables[m - 1][0], top[sel] & np.uint64((1 << 8 * (m - 1)) - 1))
            out[sel] = np.where(i >= 0, found[m - 1][i], 1 / 256)
        return out

    def word_ratios(self, batch: list[bytes]) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        keys, owner = _keys(batch)
        at = _find(self.grams, keys)
        r = self.ratio[at].astype(np.float64)
        miss = at < 0
        c = _find(self.contexts, _context(keys[miss]))
        r[miss] = np.where(c >= 0, self.freed[c], 0)
        return np.bincount(owner, r, len(batch))


def _ratios_of(model: KneserNeyRatio, texts: list[list[bytes]], cache: dict) -> list[np.ndarray]:
    new = list({w for t in texts for w in t if w not in cache})
    if len(cache) + len(new) > CACHE_WORDS:
        cache.clear()
        new = list({w for t in texts for w in t})
    short = sorted((w for w in new if len(w) < 256), key=len)
    for a in range(0, len(short), 4096):
        part = short[a:a + 4096]
        cache.update(zip(part, model.word_ratios(part).tolist()))
    for w in new:
        if len(w) >= 256:  # one odd long word must not widen the others' grid
            cache[w] = float(model.word_ratios([w])[0])
    return [np.array([cache[w] for w in t]) for t in texts]


def spellings(text: bytes | None) -> list[bytes]:
    """Words of a text in lower case (all letters, not A-Z alone)."""
    return (text or b"").decode("utf-8", "replace").lower().encode().split()


def evidence(ratios: np.ndarray) -> tuple[float, float, float, float]:
    """Mean ratio a word, best mean of a window, mean of the excess over ``STRONG`` (all
    length-normalised), mean of the three strongest words (missing ones count as 0)."""
    if not len(ratios):
        return 0.0, 0.0, 0.0, 0.0
    n = min(WINDOW, len(ratios))
    c = np.concatenate([[0], np.cumsum(ratios)])
    top = np.sort(np.partition(ratios, len(ratios) - 3)[-3:] if len(ratios) > 3 else ratios)
    return (float(ratios.mean()), float(((c[n:] - c[:-n]) / WINDOW).max()),
            float(np.maximum(ratios - STRONG, 0).sum() / (len(ratios) + WINDOW)), float(np.maximum(top, 0).sum() / 3))


def _features(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, [-1, -1, 0, 0], [1, 3, 0.1, 8]) * [2, 1, 40, 0.5]
    return np.column_stack([np.ones(len(x)), x])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w, reg = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    reg[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + reg @ w
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + reg, g)
    return w


def fit(sample: list[tuple[int, int, bytes]]) -> tuple[KneserNeyRatio | None, np.ndarray, float]:
    """(ratio model, calibration weights, base rate) from (label, draw, text) rows."""
    rows = sorted(sample, key=lambda r: (r[1], r[2]))
    rate = sum(r[0] for r in rows) / len(rows) if rows else 0.5
    held = [i % CALIBRATION_SHARE == CALIBRATION_SHARE - 1 for i in range(len(rows))]
    fit_rows, cal = [r for r, h in zip(rows, held) if not h], [r for r, h in zip(rows, held) if h]
    if len({r[0] for r in fit_rows}) < 2 or len({r[0] for r in cal}) < 2:
        return None, np.zeros(5), rate
    counts: dict[bytes, list[int]] = {}
    for label, _, text in fit_rows:
        for w in spellings(text):
            counts.setdefault(w, [0, 0])[label] += 1
    model = KneserNeyRatio(counts)
    x = np.array([evidence(r) for r in _ratios_of(model, [spellings(t) for _, _, t in cal], {})])
    return model, _logistic(_features(x), np.array([r[0] for r in cal])), rate


def _score(batches, model):
    ratio, weights, rate = model.value
    cache = {} if ratio is None else ratio.seen
    for part, texts in pieces(batches, "tx"):
        if ratio is None:
            x = np.zeros((len(texts), 4))
            s = np.full(len(texts), rate)
        else:
            x = np.array([evidence(r) for r in _ratios_of(ratio, [spellings(t) for t in texts], cache)])
            s = 1 / (1 + np.exp(-np.clip(_features(x) @ weights, -30, 30)))
        keep = [n for n in part.schema.names if n != "tx"]
        yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in keep],
                                          pa.array(s), pa.array(x[:, 0]), pa.array(x[:, 1])],
                                         [*keep, "score", "mean_ratio", "window_ratio"])


def toxicity(docs: DataFrame, labels: DataFrame, held_out_mod=(3, 1), rows_per_class: int = SAMPLE_ROWS,
             threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence of every document."""
    spark = docs.sparkSession
    sample = training_sample(docs, labels, "toxic", held_out_mod, rows_per_class).collect()  # bounded
    model = spark.sparkContext.broadcast(fit([(r["label"], r["draw"], bytes(r["text"])) for r in sample]))
    m, r = held_out_mod
    src = docs.select("doc_id", (crc_mod("doc_id", m) == r).alias("held_out"), F.col("text").cast("binary").alias("tx"))
    out = src.mapInArrow(partial(_score, model=model), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, "
                         "held_out boolean, score double, mean_ratio double, window_ratio double")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "mean_ratio", "window_ratio")


def op1_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, models learnt from ``labels.toxic``."""
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op1_toxicity_kneser_ney": op1_toxicity_kneser_ney}
ORACLE_SQL: dict[str, str] = {}

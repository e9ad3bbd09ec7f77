"""Operator 4: quality by attention-based multiple-instance learning.

A document is a bag of passages (64 words each). Every passage is encoded from
its own bytes: shape statistics (case, punctuation, symbols, repetition, word
lengths) and hashed word endings, through a learnt tanh layer. Gated attention
(tanh times sigmoid) weighs the passages, the weighted sum of the encodings is
scored by a logistic unit. All weights are learnt together from document labels
on a bounded sample; scoring is one pass over the texts without a shuffle.

Defined cases: null and empty texts are one empty passage; without labels of
both classes every score is the base rate, else 0.5; repeated rows are scored
one by one.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.llm.common import crc_mod, pieces, read_table
from logvault.llm.labelled import training_sample

PASSAGE_WORDS = 64
STATS, HASHED = 18, 46
FEATURES = STATS + HASHED
ENCODING, GATE = 24, 12
SAMPLE_ROWS = 3000  # of each class
EPOCHS, BATCH = 14, 256
SLICE_BYTES = 1 << 18  # text bytes encoded at a time; the arrays take some 100 times as much
THRESHOLD = 0.3

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_HIGH = np.arange(256) >= 128
_SENTENCE = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_COMMA = np.isin(np.arange(256), [ord(c) for c in ",;:"])
_SYMBOL = ~(_SPACE | _UPPER | _DIGIT | _LOWER | _HIGH | _SENTENCE | _COMMA)
_POWERS = (np.uint64(0x100000001B3) ** np.arange(64, dtype=np.uint64)) | np.uint64(1)


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text); vectorised over all bytes."""
    sizes = np.array([len(t) + 1 for t in texts])
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    doc_end = np.cumsum(sizes)
    space = _SPACE[buf]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
    doc = np.searchsorted(doc_end, first, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    start = np.concatenate([[0], np.cumsum(n_pass)[:-1]])
    in_doc = np.arange(len(first)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    passage = start[doc] + in_doc // PASSAGE_WORDS
    total = int(n_pass.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not len(first):
        return out, start
    length = last - first + 1

    def inside(mask):  # bytes of a class in each word
        c = np.concatenate([[0], np.cumsum(mask[buf], dtype=np.int64)])
        return c[last + 1] - c[first]

    upper, digit, symbol, high = inside(_UPPER), inside(_DIGIT), inside(_SYMBOL), inside(_HIGH)
    # a hash of each word, for repetition
    offset = np.minimum(np.arange(len(buf)) - np.repeat(first, np.diff(np.append(first, len(buf)))) if first[0] == 0 else
                        np.arange(len(buf)) - np.concatenate([np.zeros(first[0], np.int64), np.repeat(first, np.diff(np.append(first, len(buf))))]), 63)
    mixed = np.where(space, 0, (buf.astype(np.uint64) + np.uint64(11)) * _POWERS[np.maximum(offset, 0)])
    word = np.add.reduceat(mixed, first)
    word ^= word >> np.uint64(31)
    word *= np.uint64(0x9E3779B97F4A7C15)
    again = np.zeros(len(first))
    same = (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])
    again[1:] = same
    order = np.lexsort((word, passage))
    new = np.ones(len(first))
    new[order[1:]] = ~((word[order][1:] == word[order][:-1]) & (passage[order][1:] == passage[order][:-1]))
    gap = np.concatenate([[0], np.cumsum(buf == 10)])
    lines = np.diff(np.append(gap[first], gap[-1]))
    end = buf[last]
    one = np.ones(len(first))
    n = np.maximum(np.bincount(passage, minlength=total), 1)
    bytes_n = np.maximum(np.bincount(passage, length, total), 1)
    by_word = [length / 10, _UPPER[buf[first]], (upper == length) & (length > 1), _SENTENCE[end], _COMMA[end], _SYMBOL[end],
               symbol == length, digit == length, again, new, lines > 0, length <= 3, length > 12, symbol > 1]
    for k, v in enumerate(by_word):
        out[:, k] = np.bincount(passage, v, total) / n
    for k, v in enumerate((upper, digit, symbol), len(by_word)):
        out[:, k] = np.bincount(passage, v, total) / bytes_n * 4
    out[:, STATS - 1] = np.bincount(passage, one, total) / PASSAGE_WORDS
    # hashed endings: the last three bytes of a word
    tail = (end.astype(np.int64) * 31 + buf[np.maximum(last - 1, first)]) * 31 + buf[np.maximum(last - 2, first)]
    cell = (tail * 2654435761 % (1 << 32)) >> 20
    flat = np.bincount(passage * HASHED + cell % HASHED, np.where(cell & 2048, 1.0, -1.0), total * HASHED)
    out[:, STATS:] = flat.reshape(total, HASHED) / np.sqrt(n)[:, None]
    return out, start


class AttentionModel:
    """Gated attention over passage encodings; plain numpy, fitted with Adam."""

    SHAPES = {"we": (FEATURES, ENCODING), "be": (ENCODING,), "v": (ENCODING, GATE), "u": (ENCODING, GATE),
              "w": (GATE,), "c": (ENCODING,), "b": (1,)}

    def __init__(self, mean, scale, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "wc" else np.zeros(s)
                  for k, s in self.SHAPES.items()}

    def forward(self, feats, start):
        p = self.p
        x = np.clip((feats - self.mean) / self.scale, -5, 5)
        h = np.tanh(x @ p["we"] + p["be"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        g = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(feats))))
        e = np.exp(g - np.maximum.reduceat(g, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start)
        prob = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return prob, (x, h, t, s, a, bag, z)

    def gradients(self, prob, kept, start, y):
        p, (x, h, t, s, a, bag, z) = self.p, kept
        dl = (prob - y) / len(y)
        dz = dl[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        dg = a * (da - np.add.reduceat(a * da, start)[bag])
        dt, ds = dg[:, None] * p["w"] * s * (1 - t * t), dg[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
        return {"we": x.T @ dh, "be": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "w": (t * s).T @ dg,
                "c": z.T @ dl, "b": np.array([dl.sum()])}

    def fit(self, feats, start, y, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.01, decay: float = 1e-4):
        rng = np.random.default_rng(11)
        ends = np.append(start[1:], len(feats))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                idx = order[i:i + batch]
                sizes = ends[idx] - start[idx]
                st = np.cumsum(sizes) - sizes
                rows = np.repeat(start[idx] - st, sizes) + np.arange(sizes.sum())
                prob, kept = self.forward(feats[rows], st)
                step += 1
                for k, g in self.gradients(prob, kept, st, y[idx]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def _encode_slices(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``encode_passages`` about ``SLICE_BYTES`` at a time."""
    done, starts, total = [], [], 0
    at = np.cumsum([len(t) for t in texts]) // SLICE_BYTES
    for k in np.unique(at):
        f, s = encode_passages(texts[int(np.searchsorted(at, k)):int(np.searchsorted(at, k, side="right"))])
        done.append(f)
        starts.append(s + total)
        total += len(f)
    return np.concatenate(done), np.concatenate(starts)


def fit(sample: list[tuple[int, int, bytes]]) -> tuple[AttentionModel | None, float]:
    """(model, base rate of the sample) from (label, draw, text) rows."""
    rows = sorted(sample, key=lambda r: (r[1], r[2]))
    y = np.array([r[0] for r in rows], np.float64)
    rate = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return None, rate
    feats, start = _encode_slices([r[2] for r in rows])
    model = AttentionModel(feats.mean(0), feats.std(0) + 0.05)
    return model.fit(feats, start, y), rate


def _score(batches, model):
    net, rate = model.value
    for part, texts in pieces(batches, "tx", SLICE_BYTES):
        if net is None:
            prob, top = np.full(len(texts), rate), np.ones(len(texts))
        else:
            feats, start = encode_passages(texts)
            prob, kept = net.forward(feats, start)
            top = np.maximum.reduceat(kept[4], start)
        keep = [n for n in part.schema.names if n != "tx"]
        yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in keep],
                                          pa.array(prob.astype(np.float64)), pa.array(top.astype(np.float64))],
                                         [*keep, "score", "top_attention"])


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_mod=(5, 0), rows_per_class: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without ``text`` columns lost: every column, ``score`` and the largest attention weight."""
    spark = docs.sparkSession
    sample = training_sample(docs, labels, "quality", held_out_mod, rows_per_class).collect()  # bounded
    model = spark.sparkContext.broadcast(fit([(r["label"], r["draw"], bytes(r["text"])) for r in sample]))
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("binary").alias("tx"))
    return src.mapInArrow(partial(_score, model=model),
                          f"row {src.schema['row'].dataType.simpleString()}, score double, top_attention double")


def op4_quality_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learnt from ``labels.quality``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_scores(docs, read_table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "score", "top_attention").select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "top_attention")


QUERIES = {"op4_quality_attention_mil": op4_quality_attention_mil}
ORACLE_SQL: dict[str, str] = {}

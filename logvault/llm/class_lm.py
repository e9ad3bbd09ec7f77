"""Operator 3: Brown class-based n-grams with exchange clustering.

P(w_i | w_{i-1}) = P(class(w_i) | class(w_{i-1})) * P(w_i | class(w_i)).

* Counts of every word of every training text are gathered by a shuffle on the
  word (partial counts a task), in full, without a vocabulary limit; every word
  gets a number.
* Texts become sequences of word numbers once. The ``COMMON`` most frequent words
  (a fixed number, broadcast) need no shuffle for that; the rare words of the texts
  and their vocabulary entries meet block by block, and a block holds the rare
  words of about ``BLOCK_BYTES`` of text.
* Start: the ``FREQUENT`` most frequent words, one by one, and ``FORMS`` groups of
  word forms (hash of the last three bytes) are exchanged on the table of their
  bigrams, at most (FREQUENT + FORMS + 1)^2 cells whatever the corpus.
* Exchange of all words: the neighbours of every other training word are
  gathered once, by word. In each round every one of these words moves to the class
  that raises the bigram likelihood most, by its own neighbours' classes against
  the table of the classes (CLASSES^2, broadcast with one byte a word). Gains of
  words that weigh in a cell are exact, those of lighter words take the slope of
  the likelihood halfway. The words of a round move at once: the likelihood of the
  whole corpus is counted anew, a round that lowers it is taken back by half and
  then in full. Rounds end when one gains under ``SETTLED`` nats a token.
* Only words unseen in training take the class of their group of forms.

Transitions are smoothed with the class unigram, emissions by one added count
with a place for unknown words in each class.

Defined cases: null and empty texts have one token, the end; with no training
texts every count is 0 and all scores stay finite; repeated rows are counted
and scored one by one; copies of a text spread over all blocks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from contextlib import contextmanager
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.llm.common import crc_mod, materialise, pieces, read_table, words

FREQUENT, FORMS, CLASSES = 1024, 128, 64
END = b"\n"  # no word holds white space
ROUNDS = 6
COMMON = 100_000  # words whose counts go to every task; the others' counts meet the texts in blocks
BLOCK_BYTES = 16 << 20
TRANSITION_PRIOR = 2.0
SETTLED = 1e-3  # nats a token that a round over all words gains at least, or it is the last
HEAVY = 1 / 4  # words with this share of the mean cell have their gains taken exactly
BUCKETS = 4  # buckets of words for each block of text
SLICES = 16  # rows for each bucket
PARTS = 3  # of a word's neighbours: those after it, frequent ones before it, others before it


def _count_words(batches):
    """Words of training rows and their counts, combined as far as memory allows."""
    seen = Counter()

    def flush():
        k = list(seen)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array([seen[w] for w in k], pa.int64())], ["word", "n"])

    for _, texts in pieces(batches, "tx"):
        for t in texts:
            seen.update(words(t))
            seen[END] += 1
        if len(seen) > 400_000:
            yield flush()
            seen.clear()
    if seen:
        yield flush()


def unit_of(word: bytes, frequent: dict[bytes, int]) -> int:
    """Clustering unit: 0 the end, then the frequent words, then the groups of forms."""
    u = frequent.get(word)
    return u if u is not None else FREQUENT + 1 + zlib.crc32(word[-3:]) % FORMS


def _packed(x: np.ndarray) -> bytes:
    """int32 numbers byte plane by byte plane, which compresses where they are small."""
    return np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _streams(batches):
    """Word numbers of the texts of a batch, one after the other: each closes with an end, which starts the next."""
    for b in batches:
        if b.num_rows:
            yield np.concatenate([_unpacked(x) for x in b.column(0).to_pylist()])


def _pair_rows(table: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(table)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["pair", "n"])


def _pair_table(pairs: DataFrame, size: int) -> np.ndarray:
    """Summed in Spark; at most ``size``^2 rows reach the driver."""
    got = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size, np.int64)
    table[got["pair"].to_numpy()] = got["n"].to_numpy()
    return table.reshape(size, size)


def _count_bigrams(batches, units):
    """Unit bigrams; a text starts after an end and closes with one."""
    size, units = FREQUENT + FORMS + 1, units.value
    table = np.zeros(size * size, np.int64)
    for seq in _streams(batches):
        u = units[seq].astype(np.int64)
        table += np.bincount(np.concatenate([[0], u[:-1]]) * size + u, minlength=size * size)
    yield _pair_rows(table)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def _gains(table: np.ndarray, a: int, out: np.ndarray, into: np.ndarray, own: float) -> tuple[np.ndarray, np.ndarray]:
    """Gain of putting a unit of class ``a`` into each class, and the table without the unit.

    ``out`` and ``into`` count the classes after and before it, ``own`` its pairs with itself (in both).
    """
    out, into = out.copy(), into.copy()
    out[a] -= own
    into[a] -= own
    rest = table.copy()
    rest[a] -= out
    rest[:, a] -= into
    rest[a, a] -= own
    row, col = rest.sum(1) + into, rest.sum(0) + out  # what precedes and follows the unit counts wherever it goes
    # its row, its column, their crossing, and the two marginals
    new_rows, new_cols = rest + out, (rest.T + into)
    gain = (_xlogx(new_rows) - _xlogx(rest)).sum(1) + (_xlogx(new_cols) - _xlogx(rest.T)).sum(1)
    d = np.diag(rest)
    gain += _xlogx(d + out + into + own) - _xlogx(d + out) - _xlogx(d + into) + _xlogx(d)
    gain -= _xlogx(row + out.sum() + own) - _xlogx(row) + _xlogx(col + into.sum() + own) - _xlogx(col)
    gain[0] = -np.inf
    return gain, rest


def likelihood(table: np.ndarray) -> float:
    """What the classes decide of the bigram log likelihood."""
    t = table.astype(np.float64)
    return float(_xlogx(t).sum() - _xlogx(t.sum(1)).sum() - _xlogx(t.sum(0)).sum())


def exchange_clusters(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every unit. ``bigrams`` is the dense unit table; unit 0 (the end) keeps class 0.

    Maximises sum N(c,d) log N(c,d) - sum N(c.) log N(c.) - sum N(.c) log N(.c), the
    bigram likelihood of the classes; a unit moves to its best class at once.
    """
    n = bigrams.astype(np.float64)
    count = n.sum(0) + n.sum(1)
    order = np.argsort(-count, kind="stable")
    order = order[order != 0]
    cls = np.zeros(len(n), np.int64)
    cls[order] = 1 + np.arange(len(order)) % (classes - 1)
    one = np.eye(classes)[cls]
    table = one.T @ n @ one
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not count[u]:
                continue
            a = cls[u]
            out, into, own = np.bincount(cls, n[u], classes), np.bincount(cls, n[:, u], classes), n[u, u]
            gain, rest = _gains(table, a, out, into, own)
            out[a] -= own
            into[a] -= own
            b = int(np.argmax(gain))
            if gain[b] > gain[a] + 1e-9:
                moved += 1
            else:
                b = a
            cls[u] = b
            rest[b] += out
            rest[:, b] += into
            rest[b, b] += own
            table = rest
        if not moved:
            break
    return cls


def _encode(batches, shared, blocks):
    """Word numbers of each text, -1 for its rare words, and those words."""
    common, logs = shared.value
    get = common.get
    for part, texts in pieces(batches, "tx"):
        rows = []
        for t in texts:
            seq = words(t)
            codes = np.fromiter(map(get, [*seq, END], repeat(-1)), np.int32, len(seq) + 1)
            rare = [seq[i] for i in np.flatnonzero(codes < 0).tolist()]
            known = logs[codes[codes >= 0]]
            rows.append((_packed(codes), int((known > 0).sum()), float(known.sum()), b" ".join(rare)))
        cols = list(zip(*rows))
        keep = [x for x in part.schema.names if x != "tx"]
        # copies of a text spread over the blocks: the row's place in its slice takes part
        place = np.array([(zlib.crc32(x) + i) % blocks for i, x in enumerate(cols[3])], np.int64)
        yield pa.RecordBatch.from_arrays(
            [*[part.column(part.schema.get_field_index(x)) for x in keep], pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()),
             pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.binary()), pa.array(place)],
            [*keep, "seq", "n_known", "logs", "rare", "block"])


def _block_words(batches):
    """(block, word): the rare words of each block, once (again where a file is read in parts)."""
    seen, at = set(), None

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), at, np.int64)), pa.array(list(seen), pa.binary())], ["block", "word"])

    for b in batches:
        for block, rare in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if seen and (block != at or len(seen) > 400_000):
                yield flush()
                seen.clear()
            at = block
            seen.update(rare.split())
    if seen:
        yield flush()


def _add_rare(texts: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """Numbers and counts of the rare words of a block; a word unseen in training is -2 and down by its form group."""
    found = dict(zip(vocabulary["word"].to_pylist(), range(vocabulary.num_rows)))
    ids, logs = vocabulary["id"].to_numpy(), np.log10(vocabulary["n"].to_numpy().astype(np.float64) + 1)
    rare = [x.split() for x in texts["rare"].to_pylist()]
    seen = [w for x in rare for w in x]
    at = np.fromiter(map(partial(_place, found), seen), np.int64, len(seen))
    new = np.flatnonzero(at < 0)
    row = np.repeat(np.arange(len(rare)), [len(x) for x in rare])[at >= 0]
    codes = np.empty(len(seen), np.int32)
    codes[at >= 0] = ids[at[at >= 0]]
    codes[new] = [-2 - zlib.crc32(seen[i][-3:]) % FORMS for i in new]
    seqs = [_unpacked(x) for x in texts["seq"].to_pylist()]
    flat = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
    flat[flat == -1] = codes
    seqs = np.split(flat, np.cumsum([len(x) for x in seqs])[:-1]) if seqs else []
    known = texts["n_known"].to_numpy() + np.bincount(row, minlength=len(rare))
    more = texts["logs"].to_numpy() + np.bincount(row, logs[at[at >= 0]], len(rare))
    return pa.table([texts["doc_id"], texts["held_out"], pa.array([_packed(x) for x in seqs], pa.binary()), pa.array(known, pa.int64()),
                     pa.array(more, pa.float64())], ["doc_id", "held_out", "seq", "n_known", "logs"])


def _place(found: dict, word: bytes) -> int:
    return found.get(word, -1)


def _unit_half(word: bytes, frequent: dict[bytes, int]) -> int:
    """Twice the unit, and one more for words of the second half; by the word, as numbers differ between runs."""
    return 2 * unit_of(word, frequent) + (zlib.crc32(word) >> 16 & 1)


def _units(batches, shared):
    """(first, units): the units of the words numbered from ``first`` on, each with the word's half (see ``_unit_half``)."""
    frequent = shared.value
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).to_numpy()
        u = np.array([_unit_half(w, frequent) for w in b.column(1).to_pylist()], "<i2")
        cuts = [0, *(np.flatnonzero(np.diff(ids) != 1) + 1).tolist(), len(ids)]
        yield pa.RecordBatch.from_arrays([pa.array([int(ids[a]) for a in cuts[:-1]], pa.int64()),
                                          pa.array([u[a:z].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())], ["first", "units"])


def _bucket_rows(rows, names) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names)


def _neighbours(batches, buckets, places):
    """(bucket, keys, others): the neighbours of every word but the frequent ones, in buckets of words.

    A word's number is ``(place * SLICES + slice) * buckets + bucket``; a key is
    the place, with the part (see ``PARTS``) and the slice above it.
    """
    chunks, held, per = [], 0, SLICES * PARTS * places

    def flush():
        both = np.sort(np.concatenate(chunks))
        keys, others = both >> 31, both & ((1 << 31) - 1)
        bucket = keys // per
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for i in range(0, len(cuts) - 1, 64):
            yield _bucket_rows([(int(bucket[a]), _packed(np.diff(keys[a:z] - bucket[a] * per, prepend=0)), _packed(others[a:z]))
                                for a, z in zip(cuts[i:i + 64], cuts[i + 1:i + 65])], ["bucket", "keys", "others"])

    def entry(word, part, other):
        rest = word // buckets
        return ((word % buckets * per + (rest % SLICES * PARTS + part) * places + rest // SLICES) << 31) | other

    for seq in _streams(batches):
        before, at = np.concatenate([[0], seq[:-1]]).astype(np.int64), seq.astype(np.int64)
        a, b = before > FREQUENT, at > FREQUENT
        chunks += [entry(before[a], 0, at[a]), entry(at[b], 1 + a[b], before[b])]
        held += len(chunks[-1]) + len(chunks[-2])
        if held > 2_000_000:
            yield from flush()
            chunks, held = [], 0
    if held:
        yield from flush()


def _merge(batches, buckets, places):
    """(bucket, sizes, others): a row for each slice of a bucket, which is a finer bucket from
    here on, from rows in order of the bucket; ``sizes`` counts the neighbours by part and place."""
    at, rows = None, []

    def merged():
        both = np.sort(np.concatenate([(np.cumsum(_unpacked(k), dtype=np.int64) << 31) | _unpacked(o) for k, o in rows]))
        sizes = np.bincount(both >> 31, minlength=SLICES * PARTS * places).reshape(SLICES, -1)
        others = np.split((both & ((1 << 31) - 1)).astype("<i4"), np.cumsum(sizes.sum(1))[:-1])
        return _bucket_rows([(i * buckets + at, _packed(n), o.tobytes()) for i, (n, o) in enumerate(zip(sizes, others))], ["bucket", "sizes", "others"])

    for b in batches:
        for bucket, k, o in zip(*(c.to_pylist() for c in b.columns)):
            if rows and bucket != at:
                yield merged()
                rows = []
            at = bucket
            rows.append((k, o))
    if rows:
        yield merged()


def _buckets(batches):
    """(bucket, sizes, others) of each bucket: a row of ``sizes`` and a list of ``others`` for each part."""
    for b in batches:
        for bucket, sizes, others in zip(*(b.column(i) for i in range(3))):
            sizes = _unpacked(sizes.as_py()).reshape(PARTS, -1)
            others = np.frombuffer(others.as_py(), "<i4")
            yield bucket.as_py(), sizes, np.split(others, np.cumsum(sizes.sum(1))[:-1])


def _own(cls: np.ndarray, bucket: int, buckets: int, places: int) -> np.ndarray:
    own = np.zeros(places, np.int64)
    mine = cls[bucket::buckets]
    own[:len(mine)] = mine
    return own


def _count_classes(batches, shared, buckets):
    """Class bigrams of all pairs with a word that is not frequent, each pair once: rarer words before are met as neighbours after."""
    cls, table = shared.value, np.zeros(CLASSES * CLASSES, np.int64)
    for bucket, sizes, others in _buckets(batches):
        own = _own(cls, bucket, buckets, sizes.shape[1])
        table += np.bincount(np.repeat(own * CLASSES, sizes[0]) + cls[others[0]], minlength=len(table))
        table += np.bincount(np.repeat(own, sizes[1]) + cls[others[1]] * np.int64(CLASSES), minlength=len(table))
    yield _pair_rows(table)


def _best_classes(own: np.ndarray, n: np.ndarray, loops: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The best class of each word; ``n`` counts the classes after and before it, ``loops`` its pairs with itself."""
    out, into = n[:, 0], n[:, 1]
    o, i = out.sum(1, dtype=np.float64), into.sum(1, dtype=np.float64)
    row, col = table.sum(1), table.sum(0)
    log = np.log(table + 0.5).astype(np.float32)
    move = (out @ log.T + into @ log).astype(np.float64) - np.outer(o, np.log(row + 0.5)) - np.outer(i, np.log(col + 0.5))
    move[:, 0] = -np.inf
    halfway = lambda t, x: x * np.log(np.maximum(t - x / 2, 0.5))
    stay = -halfway(row[own], o) - halfway(col[own], i)
    for x, t in ((out, table), (into, table.T)):
        w, c = np.nonzero(x)
        stay += np.bincount(w, halfway(t[own[w], c], x[w, c].astype(np.float64)), len(own))
    at = np.arange(len(own))
    move[at, own] = stay
    best = move.argmax(1)
    best = np.where((o + i > 0) & (move[at, best] > stay + 1e-9), best, own)
    for w in np.flatnonzero(o + i > HEAVY * table.sum() / table.size):
        gain, _ = _gains(table, own[w], out[w].astype(np.float64), into[w].astype(np.float64), loops[w])
        b = int(np.argmax(gain))
        best[w] = b if gain[b] > gain[own[w]] + 1e-9 else own[w]
    return best


def _move(batches, shared, buckets):
    """(bucket, classes): the best class of each word of a bucket."""
    cls, table = shared.value
    for bucket, sizes, others in _buckets(batches):
        places = sizes.shape[1]
        own, at = _own(cls, bucket, buckets, places), np.arange(places) * 2 * CLASSES
        at = np.repeat(np.concatenate([at, at + CLASSES, at + CLASSES]), sizes.ravel()) + cls[np.concatenate(others)]
        n = np.bincount(at, minlength=places * 2 * CLASSES).reshape(-1, 2, CLASSES).astype(np.float32)
        after = np.repeat(np.arange(places), sizes[0])
        loops = np.bincount(after[others[0] == after * buckets + bucket], minlength=places)
        best = [_best_classes(own[a:a + 4096], n[a:a + 4096], loops[a:a + 4096], table) for a in range(0, places, 4096)]
        best = np.concatenate(best)[:len(cls[bucket::buckets])].astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([best.tobytes()], pa.binary())], ["bucket", "classes"])


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of ``n`` rows meanwhile: rows of buckets are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def exchange_words(near: DataFrame, buckets: int, cls: np.ndarray, fixed: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words and their table, from ``near`` (see ``_neighbours``) and first classes.

    ``fixed`` is the table of pairs of frequent words, ``half`` marks half of all words. A round sends one byte a word each way.
    """
    sc = near.sparkSession.sparkContext

    def count(cls):
        shared = sc.broadcast(cls)
        t = fixed + _pair_table(near.mapInArrow(partial(_count_classes, shared=shared, buckets=buckets), "pair bigint, n bigint"), CLASSES)
        shared.unpersist()
        return t

    table = count(cls)
    while True:
        shared = sc.broadcast((cls, table.astype(np.float64)))
        got = near.mapInArrow(partial(_move, shared=shared, buckets=buckets), "bucket bigint, classes binary").toArrow()
        shared.unpersist()
        new = cls.copy()
        for bucket, classes in zip(got["bucket"].to_pylist(), got["classes"]):
            new[bucket::buckets] = np.frombuffer(classes.as_py(), np.uint8)
        if (new == cls).all():
            return cls, table
        moved = count(new)
        gain = likelihood(moved) - likelihood(table)
        if gain < 0:  # too many at once: half of them
            new[half] = cls[half]
            moved = count(new)
            gain = likelihood(moved) - likelihood(table)
        if gain > 0:
            cls, table = new, moved
        if gain < SETTLED * max(1, table.sum()):
            return cls, table


class ClassModel:
    """Class of every word and form group, smoothed log10 transitions and emissions."""

    def __init__(self, cls, form_class, table, class_counts, class_words):
        t = table.astype(np.float64)
        base = (t.sum(0) + 1) / (t.sum() + CLASSES)
        self.transitions = np.log10((t + TRANSITION_PRIOR * CLASSES * base) / (t.sum(1, keepdims=True) + TRANSITION_PRIOR * CLASSES))
        self.emission = np.log10(class_counts + class_words + 1)
        self.base = np.log10(class_counts.sum() + class_words.sum() + 1)
        self.cls, self.form_class = cls, form_class.astype(np.uint8)


def _score(batches, model):
    """Scores of texts of word numbers."""
    m = model.value
    for b in batches:
        at = b.schema.get_field_index("seq")
        keep = [x for x in b.schema.names if x not in ("seq", "logs")]
        if not b.num_rows:
            continue
        seqs = [_unpacked(x) for x in b.column(at).to_pylist()]
        sizes, flat = np.array([len(x) for x in seqs]), np.concatenate(seqs)
        k = np.where(flat >= 0, m.cls[np.maximum(flat, 0)], m.form_class[np.maximum(-2 - flat, 0)])
        steps = m.transitions[np.concatenate([[0], k[:-1]]), k] - m.emission[k]  # a text closes with an end, which starts the next
        logs = b.column(b.schema.get_field_index("logs")).to_numpy()
        yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(x)) for x in keep], pa.array(sizes, pa.int64()),
                                          pa.array(logs - sizes * m.base), pa.array(logs + np.add.reduceat(steps, np.cumsum(sizes) - sizes))],
                                         [*keep, "n_tokens", "base_score", "score"])


def _is_end():
    return F.col("word") == F.lit(bytearray(END))


def _candidates(vocabulary: DataFrame, k: int) -> DataFrame:
    """The words that occur as often as the ``k``-th most frequent one: ``k`` and ties, no matter how many tasks."""
    words = vocabulary.filter(~_is_end())
    times = words.groupBy("n").agg(F.count("*").alias("words")).toArrow()  # as many rows as the root of twice the tokens at most
    n = times["n"].to_numpy()
    order = np.argsort(-n)
    reached = np.flatnonzero(np.cumsum(times["words"].to_numpy()[order]) >= k)
    return words.filter(F.col("n") >= int(n[order[reached[0]]])) if len(reached) else words


def common_words(vocabulary: DataFrame, k: int = COMMON) -> dict[bytes, int]:
    """The ``k`` most frequent words and their counts, by count and then by word.

    A limit over all words would send ``k`` rows of every task to the driver."""
    top = _candidates(vocabulary, k).orderBy(F.desc("n"), "word").limit(k).select("word", "n").toArrow()
    return dict(zip(top["word"].to_pylist(), top["n"].to_pylist()))


def numbered(vocabulary: DataFrame, first: int) -> DataFrame:
    """The written vocabulary with numbers from ``first`` on, without gaps, from its column ``m`` (task and place)."""
    sizes = vocabulary.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count("*").alias("n")).toArrow().to_pydict()  # a row a task
    sizes = dict(zip(sizes["p"], sizes["n"]))
    start = [0]
    for p in range(max(sizes, default=0)):
        start.append(start[-1] + sizes.get(p, 0))
    place = F.col("m").bitwiseAND((1 << 33) - 1)
    return vocabulary.select("word", "n", (F.get(F.lit(start), F.shiftright("m", 33).cast("int")) + place + first).cast("bigint").alias("id"))


def encoded(src: DataFrame, vocabulary: DataFrame, common: dict[bytes, int]) -> DataFrame:
    """doc_id, held_out, seq (word numbers, packed), n_known and logs (of counts) of each text; written once."""
    logs = np.log10(np.array([*common.values()]) + 1.0)
    shared = src.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(common)}, logs))
    head = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, seq binary, n_known bigint, logs double"
    part = src.mapInArrow(partial(_encode, shared=shared, blocks=_blocks_of(src)), head + ", rare binary, block bigint")
    part = materialise(part.repartition("block").sortWithinPartitions("block"), "common-words")
    done, part = part.filter(F.octet_length("rare") == 0).drop("rare", "block"), part.filter(F.octet_length("rare") > 0)
    need = part.select("block", "rare").mapInArrow(_block_words, "block bigint, word binary")
    entries = need.join(vocabulary, "word").select("block", "word", "n", "id")
    out = part.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(_add_rare, head)
    return materialise(out.unionByName(done), "word-numbers")


def _blocks_of(src: DataFrame) -> int:
    total = src.select(F.sum(F.octet_length("tx"))).first()[0] or 0
    return max(1, -(-total // BLOCK_BYTES))


def class_scores(docs: DataFrame, held_out_mod=(7, 2)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document."""
    spark = docs.sparkSession
    m, r = held_out_mod
    src = docs.select("doc_id", (crc_mod("doc_id", m) == r).alias("held_out"), F.col("text").cast("binary").alias("tx"))
    train = src.filter("not held_out").select("tx")
    counted = train.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = materialise(counted.withColumn("m", F.monotonically_increasing_id()), "vocabulary")
    # the common words: a fixed number of them, the most frequent of which are units of their own
    ends = vocabulary.filter(_is_end()).select("n").collect()
    common = {END: ends[0]["n"] if ends else 0, **common_words(vocabulary)}
    frequent = {w: i for i, w in enumerate(common) if i <= FREQUENT}  # the end first, then by count
    vocabulary = numbered(vocabulary, len(common))  # common words go by their place among the common ones
    rows = encoded(src, vocabulary, common)
    seqs = rows.filter("not held_out").select("seq")

    shared = spark.sparkContext.broadcast(frequent)
    got = vocabulary.select("id", "word").mapInArrow(partial(_units, shared=shared), "first bigint, units binary").toArrow()
    own = np.array([_unit_half(w, frequent) for w in common], np.int16)
    units = np.concatenate([own, np.zeros(sum(len(x.as_py()) // 2 for x in got["units"]), np.int16)])
    for first, x in zip(got["first"].to_pylist(), got["units"]):
        u = np.frombuffer(x.as_py(), "<i2")
        units[first:first + len(u)] = u
    del got
    half, units = (units & 1).astype(bool), units >> 1
    size = FREQUENT + FORMS + 1
    shared_units = spark.sparkContext.broadcast(units)
    bigrams = _pair_table(seqs.mapInArrow(partial(_count_bigrams, units=shared_units), "pair bigint, n bigint"), size)
    unit_class = exchange_clusters(bigrams)

    buckets = BUCKETS * _blocks_of(src)
    places = -(-len(units) // (buckets * SLICES))
    near = seqs.mapInArrow(partial(_neighbours, buckets=buckets, places=places), "bucket bigint, keys binary, others binary")
    near = (near.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(partial(_merge, buckets=buckets, places=places), "bucket bigint, sizes binary, others binary"))
    one = np.eye(CLASSES, dtype=np.int64)[unit_class[:FREQUENT + 1]]
    fixed = one.T @ bigrams[:FREQUENT + 1, :FREQUENT + 1] @ one
    with arrow_rows(spark, 64):
        near = materialise(near, "neighbours")
    with arrow_rows(spark, 32):
        cls, table = exchange_words(near, buckets * SLICES, unit_class[units].astype(np.uint8), fixed, half)
    del bigrams, units

    shared_cls = spark.sparkContext.broadcast(({w: i for i, w in enumerate(common)}, cls))
    per_class = {x["c"]: (x["n"], x["v"]) for x in vocabulary.mapInArrow(partial(_classes, shared=shared_cls), "c int, n bigint, v bigint")
                 .groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}  # a row a class
    counts = np.array([per_class.get(c, (0, 0))[0] for c in range(CLASSES)], np.float64)
    sizes = np.array([per_class.get(c, (0, 0))[1] for c in range(CLASSES)], np.float64)
    model = spark.sparkContext.broadcast(ClassModel(cls, unit_class[FREQUENT + 1:], table, counts, sizes))
    head = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_known bigint, n_tokens bigint, base_score double, score double"
    scored = rows.select("doc_id", "held_out", "n_known", "seq", "logs").mapInArrow(partial(_score, model=model), head)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(counts.sum())).cast("bigint").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _classes(batches, shared):
    """Tokens and words of each class."""
    common, cls = shared.value
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for b in batches:
        at = [common.get(w, i) for w, i in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
        k = cls[np.array(at, np.int64)].astype(np.int64)
        n += np.bincount(k, b.column(1).to_numpy(), CLASSES).astype(np.int64)
        v += np.bincount(k, minlength=CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(n), pa.array(v)], ["c", "n", "v"])


def op3_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; six sevenths train."""
    return class_scores(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_brown_class_lm": op3_brown_class_lm}
ORACLE_SQL: dict[str, str] = {}

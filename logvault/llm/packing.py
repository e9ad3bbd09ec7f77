"""Operator 6: packing by bin completion (branch and bound) with best-fit incumbents.

Documents become token ids and then id 0; only documents longer than a sequence
are cut, into full pieces and a rest. How pieces are placed depends on their
lengths alone, so the search runs on the histogram of lengths (at most
``capacity`` rows whatever the corpus size): around the largest length left,
undominated fillings of the gap are enumerated, branches that cannot waste less
than the incumbent are cut, and the best filling is repeated while its lengths
last. Each pattern then takes ranges of ranks of each length, and every piece
finds its sequence and offset from its own rank, without gathering pieces.

Defined cases: null text counts as empty (one piece: id 0 alone); repeated rows
and repeated doc_ids are packed one by one; strings of special tokens in a text
are ordinary text; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from functools import partial
from operator import neg

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvault.llm.common import materialise, pieces, read_table

CAPACITY = 2048
END_ID = 0
#: Runs in each of the two generations a Python worker remembers; the memory bound of the table.
CACHE_WORDS = 200_000
#: Text bytes of a slice whose different runs are looked up once.
SLICE_BYTES = 4 << 20
#: Branch-and-bound nodes for one filling of the first search; at the limit its incumbent is taken (never a lost piece).
NODES = 20_000
#: Whole packings tried with another filling of one sequence, while none reaches the lower bound (cost only: the best one found stays).
TURNS = 64


# ---- token ids -------------------------------------------------------------

def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return table


class WordIds(dict):
    """Packed ids of a run: lower-case Latin letters, one digit, or ASCII signs; filled on demand.

    The tokenizer treats words apart (white space only separates), so the ids of
    a text are those of its words in order; and a word of Latin letters, digits and
    ASCII signs is tokenised run by run, so only runs are remembered, of which texts
    have far fewer new ones than words. A new run goes straight to the BPE model. A
    word with any other character (an apostrophe, too) goes through the whole tokenizer.
    """

    SIGNS = "([0-9]|[!-&(-/:-@\\[-`{-~]+)"
    OTHER = re.compile("[^\t-\r -&(-~À-ÖØ-öø-ÿ]")  # neither white space nor part of a run
    WORD_END = re.compile("[\t-\r ]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.alphabet = _byte_chars()
        size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.packed = [i.to_bytes(2 if size <= 1 << 16 else 4, "little") for i in range(size)]

    def __missing__(self, run: str | bytes) -> bytes:
        if isinstance(run, bytes):  # a whole word
            return self.texts([run])[0].tobytes()
        if len(self) >= CACHE_WORDS:  # runs not used since the last time drop out with the older generation
            self.older = dict(self)
            self.clear()
        out = self.older.get(run)
        if out is None:
            packed = self.packed
            chars = run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
            out = b"".join([packed[t.id] for t in self.model.tokenize(chars)])
        self[run] = out
        return out

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of runs and white space, end to end, and where each text starts and ends.

        Every different run of the texts is looked up once."""
        apart = pc.replace_substring_regex(pa.array([t.lower() for t in texts], pa.large_string()), self.SIGNS, " \\1 ")
        split = pc.ascii_split_whitespace(apart)
        runs = split.flatten().dictionary_encode()
        found = list(map(self.__getitem__, runs.dictionary.to_numpy(zero_copy_only=False).tolist()))
        ids = np.frombuffer(b"".join(found), self.dtype)
        size = np.array([len(x) for x in found], np.int64) // ids.itemsize
        at, first = runs.indices.to_numpy(), np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(size[at])])
        ids = ids[np.repeat(first[at] - ends[:-1], size[at]) + np.arange(ends[-1])]
        bounds = split.offsets.to_numpy()
        return ids, ends[bounds - bounds[0]]

    def _words_apart(self, text: str, other) -> np.ndarray:
        """Ids of a text with words that are no mere runs; ``other`` is the match of the first."""
        plain, full, done = [], [], 0
        while other:
            at = other.start()
            start = max(text.rfind(c, done, at) for c in "\t\n\v\f\r ") + 1 or done
            end = self.WORD_END.search(text, at)
            end = end.start() if end else len(text)
            plain.append(text[done:start])
            full.append(np.array(self.tokenizer.encode(text[start:end], add_special_tokens=False).ids, self.dtype))
            done, other = end, self.OTHER.search(text, end)
        ids, ends = self._plain([*plain, text[done:]])
        parts = [ids[a:z] for a, z in zip(ends, ends[1:])]
        return np.concatenate([*[x for pair in zip(parts, full) for x in pair], parts[-1]])

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts."""
        text = [t.decode("utf-8", "replace") for t in texts]
        other = [self.OTHER.search(t) for t in text]
        ids, ends = self._plain([t for t, x in zip(text, other) if not x])
        plain = (ids[a:z] for a, z in zip(ends, ends[1:]))
        return [self._words_apart(t, x) if x else next(plain) for t, x in zip(text, other)]


_TABLES: dict[str, WordIds] = {}


def texts_ids(texts: list[bytes], path: str) -> list[np.ndarray]:
    """Token ids of whole texts, without the end id."""
    table = _TABLES.get(path)
    if table is None:
        table = _TABLES[path] = WordIds(path)
    return table.texts(texts)


def text_ids(text: bytes, path: str) -> np.ndarray:
    """Token ids of one whole text, without the end id."""
    return texts_ids([text], path)[0].astype("<u4")


PIECE = ("piece int, start bigint, length bigint, ids_crc32 bigint, pid int, nth bigint")


def _cut(batches, key, path, capacity, with_ids):
    pid, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for part, texts in pieces(batches, "tx", SLICE_BYTES):
        row, cols, ids_out = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "nth")}, []
        for i, x in enumerate(texts_ids(texts, path)):
            ids = np.append(x, np.array([END_ID], x.dtype)).astype("<u4")
            for p, a in enumerate(range(0, len(ids), capacity)):
                x = ids[a:a + capacity]
                row.append(i)
                for k, v in (("piece", p), ("start", a), ("length", len(x)), ("ids_crc32", zlib.crc32(x.tobytes())),
                             ("nth", int(seen[len(x)]))):
                    cols[k].append(v)
                seen[len(x)] += 1
                if with_ids:
                    ids_out.append(x.astype(np.int32))
        keys = part.column(part.schema.get_field_index(key)).take(pa.array(row, pa.int64()))
        arrays = [keys, pa.array(cols["piece"], pa.int32()), pa.array(cols["start"], pa.int64()),
                  pa.array(cols["length"], pa.int64()), pa.array(cols["ids_crc32"], pa.int64()),
                  pa.array([pid] * len(row), pa.int32()), pa.array(cols["nth"], pa.int64())]
        names = [key, "piece", "start", "length", "ids_crc32", "pid", "nth"]
        if with_ids:
            arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False,
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document with their task (``pid``) and their number among
    the task's pieces of the same length (``nth``); written once."""
    src = docs.select(F.col(key), F.col(text).cast("binary").alias("tx"))
    kind = src.schema[key].dataType.simpleString()
    out = src.mapInArrow(partial(_cut, key=key, path=path, capacity=capacity, with_ids=with_ids),
                         f"`{key}` {kind}, {PIECE}" + (", ids array<int>" if with_ids else ""))
    return materialise(out, "pieces")


# ---- the search over lengths -----------------------------------------------

def _best_fit_fill(avail: list[int], count: dict[int, int], gap: int) -> tuple[int, ...]:
    """Best-fit filling: the largest length that fits, again and again."""
    out, i = [], 0
    while gap and (i := bisect_left(avail, -gap, i, key=neg)) < len(avail):
        n = min(count[avail[i]], gap // avail[i])
        out += [avail[i]] * n
        gap -= n * avail[i]
        i += 1
    return tuple(out)


def _sums(avail: list[int], count: dict[int, int], gap: int) -> list[int]:
    """``_sums[i]``: the sums up to ``gap`` of pieces of ``avail[i:]``, as the bits of one number."""
    most, now = (1 << gap + 1) - 1, 1
    out = [now]
    for size in reversed(avail):
        n, step = min(count[size], gap // size), 1
        while n:  # 1, 2, 4, ... more of this length, and the rest
            now |= now << size * min(step, n)
            n -= min(step, n)
            step *= 2
        now &= most
        out.append(now)
    out.reverse()
    return out


def _fill(avail: list[int], count: dict[int, int], gap: int) -> tuple[int, ...]:
    """The filling of ``gap`` with the least waste; among equals the one with the
    larger pieces first (it dominates: smaller pieces fit more places later).

    ``avail`` is in descending order. The bound of a branch is exact, the sums that
    the smaller lengths can still reach, so only branches that lead to the least
    waste are entered; the incumbent stays if none wastes less.
    """
    best = _best_fit_fill(avail, count, gap)
    if sum(best) == gap or not avail:
        return best
    sums = _sums(avail, count, gap)
    room = sums[0].bit_length() - 1
    if room == sum(best):
        return best
    out, i = [], 0
    while room:
        i = bisect_left(avail, -room, i, key=neg)  # first length that fits
        size = avail[i]
        n = min(count[size], room // size)
        while not sums[i + 1] >> (room - n * size) & 1:
            n -= 1
            if n < 0:
                raise AssertionError("a reachable sum has a filling")
        out += [size] * n
        room -= n * size
        i += 1
    return tuple(out)


def _fill_nodes(avail: list[int], count: dict[int, int], gap: int, nodes: int = NODES) -> tuple[int, ...]:
    """A filling of ``gap`` as ``_fill`` finds it, by a bound that is not exact and at most ``nodes`` nodes.

    Depth-first over fillings whose lengths never rise; a branch is cut when even
    all that is left of the smaller lengths cannot beat the incumbent. At the limit
    the incumbent is taken, whose waste now and then leaves better pieces for later.
    """
    best = _best_fit_fill(avail, count, gap)
    best_waste = gap - sum(best)
    if not best_waste or not avail:
        return best
    least = avail[-1]
    rest = [0] * (len(avail) + 1)  # all tokens of this length and the smaller ones
    for i in range(len(avail) - 1, -1, -1):
        rest[i] = rest[i + 1] + avail[i] * count[avail[i]]
    budget = nodes
    stack = [(0, gap, ())]
    left = np.array(avail)
    while stack and best_waste and budget:
        i, room, chosen = stack.pop()
        budget -= 1
        if room < best_waste:
            best, best_waste = chosen, room
        if room < least or i >= len(avail) or room - rest[i] >= best_waste:
            continue
        j = max(i, int(np.searchsorted(-left, -room)))  # first length that fits
        if j >= len(avail):
            continue
        size = avail[j]
        if j + 1 < len(avail):
            stack.append((j + 1, room, chosen))  # without any more of this length
        if chosen.count(size) < count[size]:
            stack.append((j, room - size, (*chosen, size)))  # explored first
    return best


def bin_completion(hist: dict[int, int], capacity: int = CAPACITY, fill=_fill, slack: int | None = None,
                   turn: int | None = None) -> list[tuple[tuple[int, ...], int]] | None:
    """Patterns (lengths of one sequence, copies) that use up the histogram.

    Around the largest length left the gap is filled with the least waste; the
    pattern is repeated as long as its lengths last. Pattern number ``turn`` takes
    the other branch: a filling without the first length of the best one. None as
    soon as more than ``slack`` tokens are wasted: the packing cannot beat its
    incumbent any more.
    """
    count = {k: v for k, v in hist.items() if v}
    avail = sorted(count, reverse=True)
    out, wasted = [], 0
    while avail:
        top = avail[0]
        count[top] -= 1
        gap = capacity - top
        fits = avail[bisect_left(avail, -gap, key=neg):]
        if fits and not count[fits[0]]:
            del fits[0]
        filling = fill(fits, count, gap)
        if len(out) == turn and filling:
            filling = fill([a for a in fits if a != filling[0]], count, gap)
        pattern = (top, *filling)
        count[top] += 1
        need = {s: pattern.count(s) for s in set(pattern)}
        copies = min(count[s] // n for s, n in need.items())
        for s, n in need.items():
            count[s] -= copies * n
            if not count[s]:
                del count[s], avail[bisect_left(avail, -s, key=neg)]
        out.append((tuple(sorted(pattern, reverse=True)), copies))
        # the waste of the last sequence is no loss: it is what the rest leaves open
        wasted += copies * (capacity - sum(pattern)) if count else 0
        if slack is not None and wasted > slack:
            return None
    return out


def best_fit(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: the incumbent of the whole search."""
    return bin_completion(hist, capacity, fill=_best_fit_fill)


def lower_bound(hist: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences: all tokens in full sequences, and lengths over a half apart from each other."""
    return max(-(-sum(k * n for k, n in hist.items()) // capacity), sum(n for k, n in hist.items() if 2 * k > capacity))


def plan_packing(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """The best packing found: bin completion with the search by nodes, then with exact bounds and
    best-fit, then exact ones with another filling of one sequence; stops at the lower bound."""
    size = lambda plan: sum(c for _, c in plan)
    best, least = bin_completion(hist, capacity, fill=_fill_nodes), lower_bound(hist, capacity)
    if size(best) > least:
        best = min(best, bin_completion(hist, capacity), best_fit(hist, capacity), key=size)
    tokens = sum(k * n for k, n in hist.items())
    # spread over the patterns: late ones, where waste gathers, turn too
    for turn in sorted({t * len(best) // TURNS for t in range(TURNS)}):
        if size(best) <= least:
            break
        plan = bin_completion(hist, capacity, slack=(size(best) - 1) * capacity - tokens, turn=turn)
        if plan is not None and size(plan) < size(best):
            best = plan
    return best


def _ranges(plan) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of that length in a sequence, offset of the first)."""
    rows, used, base = [], {}, 0
    for pattern, copies in plan:
        offset = 0
        for size in sorted(set(pattern), reverse=True):
            n = pattern.count(size)
            rows.append((size, used.get(size, 0), base, n, offset))
            used[size] = used.get(size, 0) + n * copies
            offset += n * size
        base += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(batches, ranges):
    key = (ranges[:, 0] << 44) + ranges[:, 1]
    for b in batches:
        if not b.num_rows:
            continue
        col = lambda c: b.column(b.schema.get_field_index(c)).to_numpy()
        length, rank = col("length"), col("rank")
        r = ranges[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
        k = rank - r[:, 1]
        names = [n for n in b.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(b.schema.get_field_index(n)) for n in names],
             pa.array(r[:, 2] + k // r[:, 3]), pa.array(r[:, 4] + (k % r[:, 3]) * length)],
            [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``; ``with_ids`` adds the token ids."""
    cut = cut_pieces(docs, path, capacity, with_ids, key, text)
    per_task = materialise(cut.groupBy("length", "pid").agg(F.count("*").alias("n")), "piece-counts")
    hist = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = _ranges(plan_packing(hist, capacity))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = (cut.join(first, ["length", "pid"]).withColumn("rank", F.col("first") + F.col("nth"))
              .select(key, "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if with_ids else [])))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(partial(_place, ranges=ranges), f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the training sequences of ``pack(..., with_ids=True)``; at most ``capacity`` ids a row."""
    return (packed.groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids")))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op6_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sequences of 2048 tokens."""
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op6_bin_completion_packing": op6_bin_completion_packing}
ORACLE_SQL: dict[str, str] = {}

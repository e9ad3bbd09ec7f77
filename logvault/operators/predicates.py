"""One set of search predicates for every layout.

A predicate is a small tree; ``column(resolver)`` compiles it to a native
boolean Column for one layout. Semantics are fixed here, not by the layout:

* ``exists``: present and not JSON null; an object counts.
* ``ne(absent="drop")`` is SQL three-valued (absent -> NULL -> row dropped);
  ``ne(absent="keep")`` is negation-as-absence (``NOT (x <=> v)``).
* ``prefix`` is literal (``_`` and ``%`` are plain characters) and compiles to
  ``startswith`` so it can be pushed into the scan; ``like`` is SQL LIKE.
* numeric predicates compare numbers; numeric text counts as its number.
* ``match``/``match_phrase``/``wildcard`` work on analysed tokens.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logvault.functions.tokens import text_tokens, tokens, wildcard_regex
from logvault.layouts.base import EXACT, Resolver


class Pred:
    def column(self, r: Resolver) -> Column:
        raise NotImplementedError

    def __and__(self, o):
        return And((self, o))

    def __or__(self, o):
        return Or((self, o))

    def __invert__(self):
        return Not(self)


def _is_num(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


_OPS = {"eq": operator.eq, "gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le}


def _compare(r: Resolver, path, op: str, value) -> Column:
    """Numeric comparison. Integers that a double cannot tell apart are compared
    as wide decimals; numbers beyond those (1e20 and more) as doubles."""
    if isinstance(value, int) and 1 << 53 <= abs(value) < 10 ** 20:
        exact = _OPS[op](r.exact_number(path), F.lit(str(value)).cast(EXACT))
        return F.coalesce(exact, _OPS[op](r.number(path), F.lit(float(value))))
    x, v = r.equality_operands(path, value) if op == "eq" else r.numeric_operands(path, value)
    return _OPS[op](x, v)


@dataclass(frozen=True)
class Exists(Pred):  # P01
    path: str

    def column(self, r):
        return r.exists(self.path)


@dataclass(frozen=True)
class Missing(Pred):  # P02
    path: str

    def column(self, r):
        return ~r.exists(self.path)


@dataclass(frozen=True)
class Eq(Pred):  # P03 (number) / P04 (string)
    path: str
    value: object

    def column(self, r):
        if _is_num(self.value):
            return _compare(r, self.path, "eq", self.value)
        if isinstance(self.value, bool):
            return r.text(self.path) == F.lit("true" if self.value else "false")
        return r.text(self.path) == F.lit(self.value)


@dataclass(frozen=True)
class Ne(Pred):  # P05 / P06
    path: str
    value: object
    absent: str = "drop"

    def column(self, r):
        if _is_num(self.value):
            x, v = r.equality_operands(self.path, self.value)
        else:
            x, v = r.text(self.path), F.lit(self.value)
        if self.absent == "keep":
            return ~x.eqNullSafe(v)
        if self.absent == "drop":
            return x != v
        raise ValueError("absent must be 'drop' or 'keep'")


@dataclass(frozen=True)
class Prefix(Pred):  # P07
    path: str
    prefix: str

    def column(self, r):
        return r.text(self.path).startswith(self.prefix)


@dataclass(frozen=True)
class Like(Pred):  # P08
    path: str
    pattern: str

    def column(self, r):
        return r.text(self.path).like(self.pattern)


@dataclass(frozen=True)
class Cmp(Pred):  # P09
    path: str
    op: str
    value: float

    def column(self, r):
        return _compare(r, self.path, self.op, self.value)


def gt(path, v):
    return Cmp(path, "gt", v)


def ge(path, v):
    return Cmp(path, "ge", v)


def lt(path, v):
    return Cmp(path, "lt", v)


def le(path, v):
    return Cmp(path, "le", v)


@dataclass(frozen=True)
class And(Pred):  # P10
    preds: tuple

    def column(self, r):
        return reduce(lambda a, b: a & b, [p.column(r) for p in self.preds])


@dataclass(frozen=True)
class Or(Pred):
    preds: tuple

    def column(self, r):
        return reduce(lambda a, b: a | b, [p.column(r) for p in self.preds])


@dataclass(frozen=True)
class Not(Pred):
    pred: Pred

    def column(self, r):
        return ~self.pred.column(r)


def all_of(*ps):
    return And(tuple(ps))


def any_of(*ps):
    return Or(tuple(ps))


def not_(p):
    return Not(p)


@dataclass(frozen=True)
class AtLeast(Pred):  # P11: minimum_should_match
    k: int
    preds: tuple

    def column(self, r):
        hits = [F.when(p.column(r), 1).otherwise(0) for p in self.preds]
        return reduce(lambda a, b: a + b, hits) >= self.k


@dataclass(frozen=True)
class Match(Pred):  # P12
    """Analysed match: any query token occurs (``op="and"``: all occur).

    A numeric query value matches numerically, as a match on a numeric
    field of a document index does.
    """
    path: str
    query: object
    op: str = "or"

    def column(self, r):
        if _is_num(self.query):
            x, v = r.equality_operands(self.path, self.query)
            return F.coalesce(x == v, F.lit(False))
        q = text_tokens(self.query)
        if not q:
            return F.lit(False)
        toks = tokens(r.text(self.path))
        qa = F.array(*[F.lit(t) for t in q])
        c = F.size(F.array_except(qa, toks)) == 0 if self.op == "and" else F.arrays_overlap(toks, qa)
        return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class MatchPhrase(Pred):  # P13
    path: str
    phrase: str

    def column(self, r):
        q = text_tokens(self.phrase)
        if not q:
            return F.lit(False)
        toks = tokens(r.text(self.path))
        qa = F.array(*[F.lit(t) for t in q])
        n = len(q)
        starts = F.sequence(F.lit(1), F.greatest(F.size(toks) - n + 1, F.lit(1)))
        c = (F.size(toks) >= n) & F.exists(starts, lambda i: F.slice(toks, i, n) == qa)
        return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class WildcardToken(Pred):  # P14
    path: str
    pattern: str

    def column(self, r):
        rx = wildcard_regex(self.pattern)
        return F.coalesce(F.exists(tokens(r.text(self.path)), lambda t: t.rlike(rx)), F.lit(False))


@dataclass(frozen=True)
class HasBucket(Pred):  # P15: typed-bucket existence
    path: str
    bucket: str

    def column(self, r):
        return r.bucket_has(self.path, self.bucket)


# short user-facing names
exists, missing, eq, ne, prefix, like = Exists, Missing, Eq, Ne, Prefix, Like
match, match_phrase, wildcard_token, at_least, array_has_path = Match, MatchPhrase, WildcardToken, AtLeast, HasBucket


def compile_pred(pred: Pred, layout, df) -> Column:
    """The boolean Column of ``pred`` over ``df`` stored in ``layout``."""
    return pred.column(layout.resolver(df))


def encode_paths(pred: Pred, mode: str) -> Pred:
    """The same predicate addressed to an archive whose keys were encoded
    (N01/N02): every key segment of every path is encoded, indices kept."""
    from dataclasses import fields, replace

    from logvault.functions.paths import parse_path
    from logvault.operators.keys import encode_name
    if isinstance(pred, (And, Or)):
        return type(pred)(tuple(encode_paths(p, mode) for p in pred.preds))
    if isinstance(pred, Not):
        return Not(encode_paths(pred.pred, mode))
    if isinstance(pred, AtLeast):
        return AtLeast(pred.k, tuple(encode_paths(p, mode) for p in pred.preds))
    if "path" in {f.name for f in fields(pred)}:
        segs = tuple(s if isinstance(s, int) else encode_name(s, mode) for s in parse_path(pred.path))
        return replace(pred, path=segs)
    return pred

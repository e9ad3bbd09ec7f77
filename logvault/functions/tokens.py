"""Token analysis for the document-index predicates.

Approximates a standard text analyser: lower-case, split on anything that is
not a letter, digit or underscore, drop empties. The Spark column form and the
Python form (used for the literal query text) apply the same rule.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the split rule (Java and Python regex syntax agree here).
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def text_tokens(text: str) -> list[str]:
    return [t for t in regex.split(TOKEN_SPLIT, str(text).lower()) if t]


def wildcard_regex(pattern: str) -> str:
    """``*``/``?`` wildcard (matched against one whole token) as a Java regex."""
    out = []
    for ch in pattern.lower():
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        else:
            out.append(regex.escape(ch))
    return "^" + "".join(out) + "$"

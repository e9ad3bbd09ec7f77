"""The six standard searches (Q1-Q6) as predicate trees, per query dialect.

Dialects differ only in two places, both explicit here:
* ``sql``   : Q3/Q4 use LIKE (``_`` is a wildcard); ``!=`` drops absent fields.
* ``kql``   : literal prefix; ``NOT msg: ..`` keeps events without ``msg``.
* ``pairwise``: LIKE as SQL, absent ``msg`` kept (``array_position = 0``),
  Q1 looks at the integer bucket only.
* ``es``    : document-index form (match / wildcard on tokens / match_phrase,
  ``should`` with ``minimum_should_match: 1``).
"""

from __future__ import annotations

from dataclasses import dataclass

from logvault.operators.predicates import (
    AtLeast, Cmp, Eq, Exists, HasBucket, Like, Match, MatchPhrase, Ne, Prefix, WildcardToken, all_of,
    any_of, not_,
)


@dataclass(frozen=True)
class SearchConstants:
    # The constants of the reference's six searches.
    tickets: str = "attr.tickets"
    id_value: int = 22419
    release_prefix: str = "log_release"
    session_name: str = "connection"
    ctx_q4: str = "initandlisten"
    msg_q4: str = "WiredTiger message"
    remove_prefix: str = "log_remove"
    component_q5: str = "WTWRTLOG"
    ts_sec_q5: int = 1679490000
    ctx_q6: str = "FlowControlRefresher"
    num_trimmed_q6: int = 0


REFERENCE = SearchConstants()
# The log fixture keeps every constant but Q5's, whose component and cutoff
# are moved into the fixture's data range.
FIXTURE = SearchConstants(component_q5="PURCHASE", ts_sec_q5=1704800000)

MSG, SESSION, TS_SEC = "attr.message.msg", "attr.message.session_name", "attr.message.ts_sec"


def searches(dialect: str = "sql", k: SearchConstants = REFERENCE) -> dict:
    """``{"q1": Pred, ..., "q6": Pred}`` for one dialect."""
    if dialect == "es":
        return {
            "q1": Exists(k.tickets),
            "q2": Eq("id", k.id_value),
            "q3": all_of(WildcardToken(MSG, k.release_prefix + "*"), Match(SESSION, k.session_name)),
            "q4": all_of(Match("ctx", k.ctx_q4),
                         AtLeast(1, (WildcardToken(MSG, k.remove_prefix + "*"),
                                     not_(MatchPhrase("msg", k.msg_q4))))),
            "q5": all_of(Match("c", k.component_q5), Cmp(TS_SEC, "gt", k.ts_sec_q5)),
            "q6": all_of(Match("ctx", k.ctx_q6), Match("attr.numTrimmed", k.num_trimmed_q6)),
        }
    literal = dialect == "kql"
    keep = dialect in ("kql", "pairwise")
    start = (lambda p, s: Prefix(p, s)) if literal else (lambda p, s: Like(p, s + "%"))
    return {
        "q1": HasBucket(k.tickets, "int") if dialect == "pairwise" else Exists(k.tickets),
        "q2": Eq("id", k.id_value),
        "q3": all_of(start(MSG, k.release_prefix), Eq(SESSION, k.session_name)),
        "q4": all_of(Eq("ctx", k.ctx_q4),
                     any_of(Ne("msg", k.msg_q4, absent="keep" if keep else "drop"),
                            start(MSG, k.remove_prefix))),
        "q5": all_of(Eq("c", k.component_q5), Cmp(TS_SEC, "gt", k.ts_sec_q5)),
        "q6": all_of(Eq("ctx", k.ctx_q6), Eq("attr.numTrimmed", k.num_trimmed_q6)),
    }


# The dialect each reference tool speaks, for the layout it stores.
DIALECT_OF_LAYOUT = {"json_string": "sql", "pairwise": "pairwise", "inferred": "sql",
                     "static_dynamic": "sql", "variant": "sql", "document": "es"}

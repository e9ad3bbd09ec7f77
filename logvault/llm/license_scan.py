"""Operator 5: licence scans by sentence rules.

Texts are cut into sentences at full stops and blank lines (a line of comment
marks only is blank); single line breaks, colons and semicolons cut nothing, so
wrapped and commented licence texts stay whole. Sentences are normalised to
their words (lower case, letters, digits and dots inside numbers) and searched
for a table of known licence phrases, with any words before and after. Each
phrase gives an identifier and captures parameters such as a version; a
sentence may hold several. The sequence of identifiers of a document is then
matched against ordered rules: all identifiers of a rule in order, with at most
``MAX_GAP`` unknown sentences between them. Longer rules win over rules inside
them. Spans are those of the phrases.

Defined cases: null and empty texts have no licence; a phrase that occurs again
starts another match; a phrase behind "not" is none; sentences without letters
(list numbers) count as no sentence; repeated rows are scanned one by one;
phrases that belong to no complete rule are reported by their identifiers only.
"""

from __future__ import annotations

import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.llm.common import pieces, read_table

MAX_GAP = 2

_UNDER = (r"(?<!not )(?:released|licen[sc]ed|distributed|available|provided|published|redistributed|used|covered|governed|made available)"
          r"(?: (?!not )\S+){0,4}? (?:under|by)(?: (?!not )\S+){0,9}? ")
_V = r"(?:(?: version| ver| v)? ?v?(?P<v>[0-9]+(?:\.[0-9]+)*))"
_FREE = r"is free software(?: you can| you may)?(?: redistribute it and or modify it| redistribute and or modify it| modify it and or redistribute it) under the terms of the "
_FSF = r"(?: gpl| lgpl| agpl)?(?: as published by the free software foundation(?: inc)?(?: either)?)?"
_GNU = {"gpl": r"(?:gnu )?(?:general public licen[sc]e|gpl)", "lgpl": r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)",
        "agpl": r"(?:gnu )?(?:affero general public licen[sc]e|agpl)"}

# Known licence phrases, as patterns over the normalised words of a sentence.
SENTENCES = {
    "mit-short": _UNDER + r"(?:mit|expat)(?: x11| expat| style)? licen[sc]es?\b",
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-notice": r"the above copyright notice and this permission notice (?:\S+ ){0,8}?shall be included in all copies",
    "as-is": r"the software is provided as is without warranty of any kind",
    "isc-grant": r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted",
    "apache-short": _UNDER + r"apache(?: software)?(?: licen[sc]e)?" + _V + "?",
    "apache-title": r"apache license version (?P<v>[0-9.]+) [a-z]+ [0-9]{4}\b",
    "apache-compliance": r"you may not use this (?:file|work|software) except in compliance with the license",
    "apache-copy": r"you may obtain a copy of the license at",
    "apache-basis": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    **{f"{k}-short": _UNDER + rf"{g}\b{_V}?" if k != "gpl" else _UNDER + rf"(?<!affero )(?<!lesser )(?<!library ){g}{_V}?" for k, g in _GNU.items()},
    **{f"{k}-free": _FREE + g + _FSF + _V + "?" for k, g in _GNU.items()},
    **{f"{k}-title": r"gnu " + w + r"general public license version (?P<v>[0-9.]+) [0-9]+ [a-z]+ [0-9]{4}\b"
       for k, w in (("gpl", ""), ("lgpl", "lesser "), ("agpl", "affero "))},
    "gpl-hope": r"is distributed in the hope that it will be useful but without any warranty",
    "mpl-short": r"subject to the terms of the mozilla public license" + _V + "|" + _UNDER.replace("(?:under|by)", "under") + r"mozilla public license" + _V.replace("?P<v>", "?P<w>"),
    "cc-short": _UNDER + r"(?:cc|creative commons) (?P<k>by(?: nc)?(?: sa| nd)?)(?: licen[sc]e)?" + _V + "?",
    "cc-long": r"creative commons (?P<k>attribution(?: non ?commercial)?(?: share ?alike| no ?deriv(?:ative)?s)?)(?: (?P<v>[0-9]+(?:\.[0-9]+)*))?",
    "cc0": r"\bcc0\b(?: (?P<v>[0-9]+\.[0-9]+))?",
    "bsd-short": _UNDER + r"(?:the )?(?P<k>[234]|two|three|four)(?: clause)(?: \S+)? bsd\b|" + _UNDER + r"bsd (?P<w>[234]|two|three|four) clause\b",
    "bsd-redistribute": r"redistribution and use in source and binary forms(?: with or without modification)? are permitted",
    "bsd-source": r"redistributions of source code must retain the (?:above )?copyright notice",
    "bsd-binary": r"redistributions in binary form must reproduce the (?:above )?copyright notice",
    "bsd-advertising": r"all advertising materials mentioning features or use of this software must display",
    "bsd-endorse": r"neither the names? of(?:(?! neither the name).)*? may be used to endorse or promote products"
                   r"|the names? of(?:(?! the names? of).)*? may not be used to endorse or promote products",
    "public-domain": r"(?:is|are) (?:hereby )?(?:released|placed|dedicated) (?:in|into|to) the public domain",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "rights-reserved": r"all rights reserved",
}
_BSD = ("bsd-redistribute", "bsd-source", "bsd-binary")
_GRANTS = {
    "MIT": (("mit-short",), ("mit-grant", "mit-notice", "as-is"), ("mit-grant", "mit-notice")),
    "ISC": (("isc-grant", "as-is"), ("isc-grant",)),
    "Apache": (("apache-short", "apache-compliance", "apache-copy", "apache-basis"), ("apache-short", "apache-compliance"), ("apache-short",),
               ("apache-title",)),
    "GPL": (("gpl-free", "gpl-hope"), ("gpl-short",), ("gpl-free",), ("gpl-title",)),
    "LGPL": (("lgpl-free", "gpl-hope"), ("lgpl-short",), ("lgpl-free",), ("lgpl-title",)),
    "AGPL": (("agpl-free", "gpl-hope"), ("agpl-short",), ("agpl-free",), ("agpl-title",)),
    "MPL": (("mpl-short",),),
    "CC": (("cc-short",), ("cc-long",)),
    "CC0": (("cc0",),),
    "BSD": (("bsd-short",),),
    "BSD-4-Clause": ((*_BSD, "bsd-advertising", "bsd-endorse"),),
    "BSD-3-Clause": ((*_BSD, "bsd-endorse"),),
    "BSD-2-Clause": (_BSD,),
    "Public-Domain": (("public-domain",),),
    "Unlicense": (("unlicense",),),
}
# Licence rules, an ordered sequence of identifiers each. "All rights reserved" before a grant belongs to it.
RULES = {**{k: (*rs, *(("rights-reserved", *r) for r in rs)) for k, rs in _GRANTS.items()}, "Proprietary": (("rights-reserved",),)}

# Every known phrase holds one of these words: texts without any have no licence.
ANCHORS = (b"licen", b"permission", b"copyright", b"copies", b"warranty", b"gnu", b"redistribution", b"endorse", b"domain", b"rights",
           b"software", b"creative", b"cc0", b"under", b"gpl", b"advertising")
_ANCHOR_WORDS = [a.decode() for a in ANCHORS]
_PHRASES = {k: re.compile(rf"(?<![^ ])(?:{p})(?![a-z0-9])") for k, p in SENTENCES.items()}
_END = re.compile(r"(?<=[^0-9\s][.!?])(?<!\bv\.)(?<!\bver\.)\s+|(?<=[0-9][.!?])\s+(?=[A-Z\n]|$)|\n(?:[^A-Za-z0-9\n]*\n)+")
_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
_NAMES = {"attribution": "by", "non": "", "noncommercial": "nc", "commercial": "nc", "share": "", "sharealike": "sa", "alike": "sa", "no": "",
          "noderivs": "nd", "noderivatives": "nd", "derivs": "nd", "derivatives": "nd", "two": "2", "three": "3", "four": "4"}
_ORDERED = sorted(((r, name) for name, rs in RULES.items() for r in rs), key=lambda x: (-len(x[0]), x[1]))


def sentences(text: str):
    """(start, end) of each sentence."""
    at = 0
    for m in _END.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def phrases(sentence: str) -> list[tuple[int, int, str, str]]:
    """(start, end, identifier, parameters) of the known phrases of a sentence, in order."""
    words = list(_WORD.finditer(sentence))
    text = " ".join(w[0] for w in words).lower()
    first, last, at = {}, {}, 0
    for w in words:
        first[at] = w.start()
        at += len(w[0])
        last[at] = w.end()
        at += 1
    out = []
    for k, p in _PHRASES.items():
        for m in p.finditer(text):
            got = m.groupdict()
            named = [" ".join(filter(None, (_NAMES.get(x, x) for x in (got.get(g) or "").split()))) for g in ("k", "v", "w")]
            detail = "-".join(x.replace(" ", "-").rstrip(".").upper() for x in named if x)
            out.append((first[m.start()], last[m.end()], k, f"{detail}-Clause" if k == "bsd-short" else detail))
    return sorted(out)


def match_rules(seq: list[tuple[int, str, str]], gap: int = MAX_GAP) -> list[tuple[str, int, int]]:
    """(licence, first, last) matches in a sequence of (sentence number, identifier, parameters).

    From left to right; at each phrase the longest rule that starts there and
    whose identifiers follow in order within the gap. Used phrases are not
    used again.
    """
    out, used = [], set()
    for i in range(len(seq)):
        if i in used:
            continue
        for rule, name in _ORDERED:
            at, path = i, [i]
            if seq[i][1] != rule[0]:
                continue
            for want in rule[1:]:
                nxt = next((j for j in range(at + 1, len(seq)) if j not in used and seq[j][1] == want
                            and seq[j][0] - seq[at][0] <= gap + 1), None)
                if nxt is None:
                    break
                at = nxt
                path.append(nxt)
            if len(path) == len(rule):
                used.update(path)
                detail = next((seq[j][2] for j in path if seq[j][2]), "")
                out.append((f"{name}-{detail}" if detail else name, path[0], path[-1]))
                break
    return out


def scan_text(text: bytes) -> tuple[list[str], list[str], list[tuple[int, int]]]:
    """(licences, identifiers, spans in code points) of one text."""
    low = text.lower()
    if not any(a in low for a in ANCHORS):
        return [], [], []
    t = text.decode("utf-8", "replace")
    seq, place, n = [], [], 0
    for a, z in sentences(t):
        s = t[a:z]
        small = s.lower()
        if len(s) >= 8 and any(x in small for x in _ANCHOR_WORDS):
            for b, e, k, detail in phrases(s):
                seq.append((n, k, detail))
                place.append((a + b, a + e))
        n += any(c.isalpha() for c in s)
    found = match_rules(seq)
    return [f[0] for f in found], [s[1] for s in seq], [(place[f[1]][0], place[f[2]][1]) for f in found]


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _scan(batches, keep):
    for part, texts in pieces(batches, "tx"):
        rows = [scan_text(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [*[part.column(part.schema.get_field_index(k)) for k in keep], pa.array([r[0] for r in rows], pa.list_(pa.string())),
             pa.array([r[1] for r in rows], pa.list_(pa.string())),
             pa.array([[{"start": a, "end": z} for a, z in r[2]] for r in rows], pa.list_(SPAN))],
            [*keep, "licenses", "sentences", "spans"])


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, licenses, sentences (identifiers in order) and spans of every document."""
    src = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("binary").alias("tx"))
    return src.mapInArrow(partial(_scan, keep=[key]), f"`{key}` {src.schema[key].dataType.simpleString()}, licenses array<string>, "
                          "sentences array<string>, spans array<struct<start:bigint,end:bigint>>")


def op5_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their licences."""
    out = license_scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"),
                      F.array_join("sentences", ",").alias("sentences"), F.array_join(
                          F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


QUERIES = {"op5_license_sentences": op5_license_sentences}
ORACLE_SQL: dict[str, str] = {}

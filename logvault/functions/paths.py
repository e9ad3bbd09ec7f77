"""Dotted log paths.

A path is written the way the pairwise layout stores it: object keys joined
by ``.`` (no leading dot at the root) and array positions as ``[i]``, e.g.
``attr.message.msg``, ``t.$date``, ``attr.bad key-name[0]``. Keys that
themselves contain ``.`` or ``[`` are ambiguous in this text form (as in the
reference); pass a tuple of segments to address them exactly.
"""

from __future__ import annotations

import re
from functools import lru_cache

Segment = str | int
_IDENT = re.compile(r"^[A-Za-z_$@][A-Za-z0-9_$@]*$")
_INDEX = re.compile(r"\[(\d+)\]")


@lru_cache(maxsize=4096)
def _parse(text: str) -> tuple[Segment, ...]:
    segs: list[Segment] = []
    for part in text.split("."):
        m = re.match(r"^(.*?)((?:\[\d+\])*)$", part)
        key, idx = m.group(1), m.group(2)
        if key or not idx:
            segs.append(key)
        segs.extend(int(i) for i in _INDEX.findall(idx))
    return tuple(segs)


def parse_path(path: str | tuple | list) -> tuple[Segment, ...]:
    if isinstance(path, (tuple, list)):
        return tuple(path)
    return _parse(path)


def path_text(path) -> str:
    """Pairwise text form of a path (``a.b[0].c``)."""
    out = ""
    for s in parse_path(path):
        if isinstance(s, int):
            out += f"[{s}]"
        else:
            out = f"{out}.{s}" if out else s
    return out


def json_path(path) -> str:
    """Spark JSON path (``$.a['b c'][0]``) for variant_get / get_json_object."""
    out = "$"
    for s in parse_path(path):
        if isinstance(s, int):
            out += f"[{s}]"
        elif _IDENT.match(s):
            out += f".{s}"
        else:
            out += "['" + s.replace("'", "\\'") + "']"
    return out

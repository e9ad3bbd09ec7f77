"""In-place rewrite of mixed-type fields, so that every field has one
type across events (what a document index with a dynamic mapping needs).

All native: the document is cast to ``MAP<STRING,VARIANT>``, the members are
rewritten with ``transform_values``, and the object is rebuilt with
``to_variant_object``. Rules apply under ``attr`` only, in this order:

N06 ``attr.uuid`` object -> the string at ``uuid.$uuid``
N07 ``attr.error`` string s -> ``{"errmsg": s}``
N08 ``attr.command`` string s -> ``{"command": s}``
N09 ``attr.command.q._id`` non-object -> ``{"_ooid": str(v)}`` (command was an object)
N10 ``attr.writeConcern.w`` integer or boolean -> its text
N11 ``attr.query._id`` non-object -> ``{"_ooid": str(v)}``

``str(v)`` follows Python's text of the value (``None``, ``True``/``False``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logvault.functions import variant as V

OBJ = "map<string,variant>"


def _obj(v: Column) -> Column:
    return v.try_cast(OBJ)


def _tname(v: Column) -> Column:
    return F.schema_of_variant(v)


def _wrap(key: str, value: Column) -> Column:
    return F.to_variant_object(F.struct(value.alias(key)))


def _set_member(v: Column, key: str, rule) -> Column:
    """Object ``v`` with member ``key`` replaced by ``rule(member)``; others kept."""
    return F.to_variant_object(F.transform_values(
        _obj(v), lambda k, x: F.when(k == key, rule(x)).otherwise(x)))


def norm_uuid(v: Column) -> Column:  # N06
    inner = V.vget(v, ("uuid", "$uuid"))
    return F.when(_obj(v).isNotNull(), F.coalesce(inner, v)).otherwise(v)


def norm_error(v: Column) -> Column:  # N07
    return F.when(_tname(v) == "STRING", _wrap("errmsg", v.cast("string"))).otherwise(v)


def _ooid(x: Column) -> Column:
    return F.when(_obj(x).isNull(), _wrap("_ooid", V.py_str(x))).otherwise(x)


def norm_command_q_id(v: Column) -> Column:  # N09 (v is the command object)
    def q_rule(q):
        has_id = F.coalesce(F.array_contains(F.map_keys(_obj(q)), "_id"), F.lit(False))
        return F.when(has_id, _set_member(q, "_id", _ooid)).otherwise(q)
    return _set_member(v, "q", q_rule)


def norm_command(v: Column) -> Column:  # N08 then N09
    return (F.when(_tname(v) == "STRING", _wrap("command", v.cast("string")))
            .when(_obj(v).isNotNull(), norm_command_q_id(v))
            .otherwise(v))


def norm_write_concern_w(v: Column) -> Column:  # N10 (v is writeConcern)
    def w_rule(w):
        t = _tname(w)
        is_int = t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN")
        return F.when(is_int, V.py_str(w).cast("variant")).otherwise(w)
    return F.when(_obj(v).isNotNull(), _set_member(v, "w", w_rule)).otherwise(v)


def norm_query_id(v: Column) -> Column:  # N11 (v is query)
    return F.when(_obj(v).isNotNull(), _set_member(v, "_id", _ooid)).otherwise(v)


ATTR_RULES = (("uuid", norm_uuid), ("error", norm_error), ("command", norm_command),
              ("writeConcern", norm_write_concern_w), ("query", norm_query_id))


def normalize_attr(attr: Column) -> Column:
    def member(k, x):
        out = x
        for key, rule in reversed(ATTR_RULES):
            out = F.when(k == key, rule(x)).otherwise(out)
        return out
    return F.to_variant_object(F.transform_values(_obj(attr), member))


def normalize(j: Column) -> Column:
    """Apply N06-N11 to a document (VARIANT); other documents unchanged."""
    root = _obj(j)
    rewritten = F.to_variant_object(F.transform_values(
        root, lambda k, x: F.when((k == "attr") & _obj(x).isNotNull(), normalize_attr(x)).otherwise(x)))
    has_attr = F.coalesce(F.array_contains(F.map_keys(root), "attr"), F.lit(False))
    return F.when(has_attr, rewritten).otherwise(j)

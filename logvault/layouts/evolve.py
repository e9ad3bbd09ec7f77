"""Schema evolution of the merged-types layout: parts written under differing schemas, read as one.

Types merge path by path as ``merged_schema`` merges those of one input: equal
types stay, objects merge field by field, anything else becomes VARIANT. Each
value is converted without loss, so a part never has to be written again.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logvault.layouts.layouts import REST, _field_name


def _clash(names) -> set:
    """Names that differ in case only."""
    count = Counter(n.lower() for n in set(names))
    return {n for n in names if count[n.lower()] > 1}


def merge_types(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if not (isinstance(a, T.StructType) and isinstance(b, T.StructType)):
        return T.VariantType()
    other = {f.name: f.dataType for f in b.fields}
    kinds = {f.name: merge_types(f.dataType, other[f.name]) if f.name in other else f.dataType for f in a.fields}
    kinds.update({n: t for n, t in other.items() if n not in kinds})
    if _clash(kinds):
        return T.VariantType()
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


def merge_schemas(schemas: list, untyped: set = frozenset()) -> T.StructType:
    """One schema for all; top-level names in ``untyped``, or differing in case only, have no column."""
    kinds: dict = {}
    for s in schemas:
        for f in s.fields:
            kinds[f.name] = merge_types(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    out = _clash([*kinds, *untyped]) | set(untyped)
    return T.StructType([T.StructField(n, t) for n, t in kinds.items() if n not in out])


def _variant(c: Column, t: T.DataType) -> Column:
    """A typed value as VARIANT; absent fields stay absent."""
    if isinstance(t, T.VariantType):
        return c
    if not isinstance(t, T.StructType):
        return c.cast("variant")
    pairs = [x for f in t.fields for x in (F.lit(f.name), _variant(c.getField(f.name), f.dataType))]
    return F.when(c.isNotNull(), F.to_variant_object(F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())))


def _convert(c: Column, t: T.DataType, to: T.DataType) -> Column:
    if t == to:
        return c
    if isinstance(to, T.VariantType):
        return _variant(c, t)
    have = {f.name: f.dataType for f in t.fields}
    fields = [(_convert(c.getField(f.name), have[f.name], f.dataType) if f.name in have
               else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
    return F.when(c.isNotNull(), F.struct(*fields))


def conform(df: DataFrame, own: T.StructType, to: T.StructType) -> DataFrame:
    """Rows written under the schema ``own`` as rows of ``to``, which covers it."""
    have = {f.name: f.dataType for f in own.fields}
    cols = [(_convert(F.col(_field_name(f.name)), have[f.name], f.dataType) if f.name in have
             else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
    moved = [n for n in have if n not in to.names]
    rest = F.col(REST)
    if moved:  # columns that lost their place stand beside the schema again
        pairs = [x for n in moved for x in (F.lit(n), _variant(F.col(_field_name(n)), have[n]))]
        rest = F.to_variant_object(F.map_concat(F.coalesce(rest.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>")),
                                                F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())))
    return df.select(*cols, rest.alias(REST))


def rest_names(df: DataFrame) -> list[str]:
    """Top-level names that the rows keep beside the schema."""
    keys = df.select(F.explode(F.map_keys(F.col(REST).try_cast("map<string,variant>"))).alias("k")).distinct()
    return sorted(r["k"] for r in keys.collect())

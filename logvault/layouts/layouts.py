"""The archive layouts."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logvault.functions import variant as V
from logvault.functions.paths import json_path, parse_path, path_text
from logvault.layouts.base import EXACT, AbsentResolver, HotResolver, Layout, Resolver, VariantResolver, hot_columns
from logvault.operators.flatten import BUCKETS, DEFAULT_DEPTH, leaves_column, pairwise_columns


def _passthrough(df: DataFrame, drop: str = "line") -> list[str]:
    return [c for c in df.columns if c != drop]


def _once(document: Column) -> Column:
    """``document`` as a generator of one row: searches of the column stay above it
    and do not compute the document again for each path that they ask."""
    return F.explode(F.array(document))


# --------------------------------------------------------------------- L1
class JsonTextResolver(Resolver):
    """Paths over raw JSON text, parsed at query time (get_json_object)."""

    def __init__(self, line: Column):
        self.line = line

    def exists(self, path):
        return F.get_json_object(self.line, json_path(path)).isNotNull()

    def text(self, path):
        return F.get_json_object(self.line, json_path(path))

    def bucket_has(self, path, bucket):
        v = F.try_parse_json(self.line)
        return F.coalesce(V.bucket(V.vget(v, path)) == bucket, F.lit(False))


@dataclass
class JsonStringLayout(Layout):
    """L1: ``line STRING`` in Parquet (zstd); parsed only when searched."""
    name: str = "json_string"

    def build(self, lines):
        return lines

    def resolver(self, df):
        return JsonTextResolver(F.col("line"))


# --------------------------------------------------------------------- L2
def _under(p: str):
    return lambda c: (c == p) | c.startswith(p + ".") | c.startswith(p + "[")


class PairwiseResolver(Resolver):
    """Positional lookups in the typed ``<t>_columns``/``<t>_values`` arrays.

    ``get`` returns NULL for index -1 (path absent); ``element_at(.., 0)``
    would raise, and AND does not promise short-circuit evaluation.
    """

    def lookup(self, path, b: str) -> Column:
        p = path_text(path)
        return F.get(F.col(f"{b}_values"), (F.array_position(F.col(f"{b}_columns"), p) - 1).cast("int"))

    def exists(self, path):
        p = path_text(path)
        under = _under(p)
        preds = [F.exists(F.col(f"{b}_columns"), under) for b in BUCKETS]
        out = preds[0]
        for x in preds[1:]:
            out = out | x
        return F.coalesce(out, F.lit(False))

    def text(self, path):
        return F.coalesce(self.lookup(path, "string"), self.lookup(path, "int").cast("string"),
                          self.lookup(path, "float").cast("string"), self.lookup(path, "bool").cast("string"))

    def number(self, path):
        return F.coalesce(self.lookup(path, "int").cast("double"), self.lookup(path, "float"),
                          self.lookup(path, "string").try_cast("double"))

    def integer(self, path):
        return F.coalesce(self.lookup(path, "int"), self.lookup(path, "string").try_cast("bigint"))

    def exact_number(self, path):
        return F.coalesce(self.lookup(path, "int").cast(EXACT), self.lookup(path, "float").try_cast(EXACT),
                          self.lookup(path, "string").try_cast(EXACT))

    def bucket_has(self, path, bucket):
        return F.coalesce(F.array_contains(F.col(f"{bucket}_columns"), path_text(path)), F.lit(False))


@dataclass
class PairwiseLayout(Layout):
    """L2: fixed schema of four typed (path array, value array) pairs.

    Built with VARIANT and higher-order functions, documents of any depth.
    """
    name: str = "pairwise"
    depth: int | None = DEFAULT_DEPTH

    def build(self, lines):
        keep = _passthrough(lines)
        df = lines.withColumn("_j", F.parse_json("line"))
        return df.select(*keep, pairwise_columns(leaves_column(F.col("_j"), self.depth)))

    def resolver(self, df):
        return PairwiseResolver()


# --------------------------------------------------------------------- L3
class StructResolver(Resolver):
    """Paths over an inferred struct schema, resolved against the schema.

    Fields absent from the schema are absent everywhere; a field whose types
    conflicted is stored as JSON text and is read further with get_json_object.
    """

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def _resolve(self, path):
        segs = parse_path(path)
        col, dtype = None, self.schema
        for i, s in enumerate(segs):
            if isinstance(dtype, T.StructType) and isinstance(s, str):
                f = next((f for f in dtype.fields if f.name == s), None)
                if f is None:
                    return None, None
                col = F.col(_field_name(s)) if col is None else col.getField(s)
                dtype = f.dataType
            elif isinstance(dtype, T.ArrayType) and isinstance(s, int):
                col, dtype = F.get(col, F.lit(s)), dtype.elementType
            elif isinstance(dtype, T.StringType) and col is not None:
                return F.get_json_object(col, json_path(segs[i:])), T.StringType()
            else:
                return None, None
        return col, dtype

    def exists(self, path):
        c, _ = self._resolve(path)
        return F.lit(False) if c is None else c.isNotNull()

    def text(self, path):
        c, t = self._resolve(path)
        if c is None:
            return F.lit(None).cast("string")
        if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c)
        return c.cast("string")

    def number(self, path):
        c, t = self._resolve(path)
        if c is None:
            return F.lit(None).cast("double")
        if isinstance(t, T.NumericType):
            return c.cast("double")
        if not isinstance(t, T.StringType):
            return F.lit(None).cast("double")
        return c.try_cast("double")

    def integer(self, path):
        c, t = self._resolve(path)
        if c is None or not isinstance(t, (T.NumericType, T.StringType)):
            return F.lit(None).cast("bigint")
        if isinstance(t, T.IntegralType):
            return c.cast("bigint")
        if isinstance(t, T.FractionalType):
            return F.when(c == F.floor(c), c.try_cast("bigint"))
        return c.try_cast("bigint")

    def numeric_operands(self, path, value):
        c, t = self._resolve(path)
        if c is not None and isinstance(t, T.IntegralType) and float(value).is_integer():
            return c, F.lit(int(value))
        return self.number(path), F.lit(float(value))

    def exact_number(self, path):
        c, t = self._resolve(path)
        if c is None or not isinstance(t, (T.NumericType, T.StringType)):
            return F.lit(None).cast(EXACT)
        return c.try_cast(EXACT)

    def equality_operands(self, path, value):
        c, t = self._resolve(path)
        if c is not None and isinstance(t, T.IntegralType) and isinstance(value, int):
            return c, F.lit(value)  # typed and exact: pushed as EqualTo
        return super().equality_operands(path, value)

    def bucket_has(self, path, bucket):
        c, t = self._resolve(path)
        if c is None:
            return F.lit(False)
        want = {"string": T.StringType, "int": T.IntegralType, "float": T.FractionalType,
                "bool": T.BooleanType}[bucket]
        return c.isNotNull() if isinstance(t, want) else F.lit(False)


#: VARIANT object of the top-level fields that have no column of their own (L4, merged types).
REST = "rest_fields"


@dataclass
class InferredLayout(Layout):
    """L3: struct schema inferred over the whole input (case-sensitive names).

    Inference is a full extra pass over the input; ``schema`` (a DDL
    string or StructType, e.g. inferred once from an earlier batch) skips
    inference and makes ingest a single pass. The default reads everything,
    as the reference does.
    """
    name: str = "inferred"
    schema: object = None

    def build(self, lines):
        """Infer over the whole input with Spark's JSON reader.

        A DataFrame of lines is first written as text under the shared
        checkpoint folder (this also cuts its lineage); inputs that are
        already files should use ``from_files``.
        """
        from logvault.session import scratch_path
        spark = lines.sparkSession
        tmp = scratch_path(spark, "inferred-src")
        lines.select("line").write.text(tmp)
        return self.from_files(spark, tmp)

    def from_files(self, spark: SparkSession, path) -> DataFrame:
        spark.conf.set("spark.sql.caseSensitive", "true")
        r = spark.read.option("mode", "PERMISSIVE")
        r = r.schema(self.schema) if self.schema is not None else r.option("samplingRatio", 1.0)
        return r.json(path)

    def read(self, spark, path):
        spark.conf.set("spark.sql.caseSensitive", "true")
        return spark.read.parquet(path)

    def resolver(self, df):
        return StructResolver(df.schema)


def _field_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _ddl(t: T.DataType) -> str:
    """Type text with quoted field names."""
    if isinstance(t, T.StructType):
        return "struct<" + ",".join(f"{_field_name(f.name)}:{_ddl(f.dataType)}" for f in t.fields) + ">"
    return t.simpleString()


def merged_schema(df: DataFrame, v: str = "j") -> T.StructType:
    """Schema of all documents of the VARIANT column ``v``: one distributed aggregate merges the types of every path.

    Integers, strings, booleans and objects stay typed; a path whose types
    differ, and every other kind of value (fractions, arrays, empty objects, only
    nulls), is VARIANT, which keeps each value as it is. Fields of one object
    whose names differ in case only make that object VARIANT (at the root: stay
    out of the schema), so no session setting decides what a name means.
    """
    text = df.select(F.schema_of_variant_agg(v)).first()[0] or "VOID"
    quoted = re.split(r"(`(?:[^`]|``)*`)", text)  # names in quotes stay as they are
    ddl = "".join(p if i % 2 else p.replace("OBJECT<", "STRUCT<").replace("VOID", "VARIANT") for i, p in enumerate(quoted))
    kind = T._parse_datatype_string(ddl)

    def distinct(names):
        count = Counter(n.lower() for n in names)
        return [n for n in names if count[n.lower()] == 1]

    def settle(t):
        if isinstance(t, (T.LongType, T.StringType, T.BooleanType)):
            return t
        if isinstance(t, T.StructType) and t.fields and len(distinct(t.names)) == len(t.fields):
            return T.StructType([T.StructField(f.name, settle(f.dataType)) for f in t.fields])
        return T.VariantType()

    if not isinstance(kind, T.StructType):
        return T.StructType([])
    own = [n for n in distinct(kind.names) if n.lower() != REST]
    return T.StructType([T.StructField(f.name, settle(f.dataType)) for f in kind.fields if f.name in own])


class MergedResolver(StructResolver):
    """Typed columns and fields; from a VARIANT on, and beside the schema, a VARIANT lookup."""

    def _variant(self, path) -> tuple[VariantResolver, tuple] | None:
        segs = parse_path(path)
        col, dtype = None, self.schema
        for i, s in enumerate(segs):
            f = next((f for f in dtype.fields if f.name == s), None) if isinstance(dtype, T.StructType) else None
            if f is None or col is None and s == REST:
                return (VariantResolver(F.col(REST)), segs) if col is None and REST in self.schema.names else None
            col = F.col(_field_name(s)) if col is None else col.getField(s)
            dtype = f.dataType
            if isinstance(dtype, T.VariantType):
                return VariantResolver(col), segs[i + 1:]
        return None

    def _ask(self, name, path, *args):
        found = self._variant(path)
        return getattr(found[0], name)(found[1], *args) if found else getattr(super(), name)(path, *args)

    def _resolve(self, path):
        col, t = super()._resolve(path)
        plain = col is not None and isinstance(t, T.StringType) and not self._is_leaf(path)
        return (None, None) if plain else (col, t)  # a string has no inner paths here

    def _is_leaf(self, path) -> bool:
        dtype = self.schema
        for s in parse_path(path):
            dtype = next((f.dataType for f in dtype.fields if f.name == s), None) if isinstance(dtype, T.StructType) else None
        return dtype is not None

    def exists(self, path):
        return self._ask("exists", path)

    def text(self, path):
        return self._ask("text", path)

    def number(self, path):
        return self._ask("number", path)

    def integer(self, path):
        return self._ask("integer", path)

    def exact_number(self, path):
        return self._ask("exact_number", path)

    def numeric_operands(self, path, value):
        return self._ask("numeric_operands", path, value)

    def equality_operands(self, path, value):
        return self._ask("equality_operands", path, value)

    def bucket_has(self, path, bucket):
        if bucket in ("object", "array") and not self._variant(path):
            c, t = self._resolve(path)
            return c.isNotNull() & F.lit(bucket == "object") if isinstance(t, T.StructType) else F.lit(False)
        return self._ask("bucket_has", path, bucket)


@dataclass
class MergedLayout(Layout):
    """L3 with merged types: a struct schema in which paths of differing types are
    VARIANT beside the typed columns, instead of JSON text.

    The schema comes from one aggregate over the parsed input (``merged_schema``),
    or is given: top-level fields that it does not name are kept in ``rest_fields``,
    and nothing is converted to another type on the way. JSON nulls inside typed objects leave no trace.
    """
    name: str = "merged"
    schema: T.StructType | None = None

    def build(self, lines):
        keep = _passthrough(lines)
        return self.from_variant(lines.select(*keep, F.parse_json("line").alias("_j")), "_j")

    def from_variant(self, df, j: str):
        """Layout columns from an already parsed VARIANT column ``j``."""
        keep = [F.col(_field_name(c)) for c in df.columns if c not in (j, "line")]
        schema = merged_schema(df, j) if self.schema is None else self.schema
        cols = [V.vget(F.col(j), (f.name,), _ddl(f.dataType)).alias(f.name) for f in schema.fields]
        rest = F.map_filter(F.col(j).try_cast("map<string,variant>"), lambda k, _: ~k.isin(*schema.names)) if schema.names else F.col(j).try_cast("map<string,variant>")
        return df.select(*keep, *cols, F.to_variant_object(rest).alias(REST))

    def resolver(self, df):
        return MergedResolver(df.schema)


# --------------------------------------------------------------------- L4
# The declared static fields of the mongod layout and their
# types (timestamp key ``t.$date``; ``attr`` is the dynamic part).
MONGOD_STATIC = (("t.$date", "timestamp"), ("s", "string"), ("c", "string"), ("id", "bigint"),
                 ("ctx", "string"), ("msg", "string"))
MONGOD_DYNAMIC = "attr"


def _col_name(path) -> str:
    return path_text(path).replace(".", "_").replace("$", "").replace("@", "")


def _in_column(path, typ: str) -> bool:
    """A static field that its typed column holds whole: searches read that
    column. Timestamps keep their source text, and parents of nested fields
    their other members, in ``REST``."""
    return typ != "timestamp" and len(parse_path(path)) == 1


class StaticDynamicResolver(Resolver):
    """Typed columns for static paths, else the dynamic column or ``REST``."""

    def __init__(self, static: tuple, dynamic: str, has_rest: bool = True):
        self.static = {path_text(p): (p, t) for p, t in static}
        self.dynamic = dynamic
        self.rest = VariantResolver(F.col(REST)) if has_rest else AbsentResolver()

    def _route(self, path):
        """(typed column, its type) or (resolver, path in it)."""
        p = path_text(path)
        if p in self.static and self.static[p][1] != "timestamp":
            return F.col(_col_name(p)), self.static[p][1]
        segs = parse_path(path)
        if segs and segs[0] == self.dynamic:
            return VariantResolver(F.col(self.dynamic)), segs[1:]
        return self.rest, path

    def exists(self, path):
        c, extra = self._route(path)
        return c.exists(extra) if isinstance(c, Resolver) else c.isNotNull()

    def text(self, path):
        c, extra = self._route(path)
        return c.text(extra) if isinstance(c, Resolver) else c.cast("string")

    def number(self, path):
        c, extra = self._route(path)
        if isinstance(c, Resolver):
            return c.number(extra)
        return F.lit(None).cast("double") if extra == "boolean" else c.try_cast("double")

    def integer(self, path):
        c, extra = self._route(path)
        if isinstance(c, Resolver):
            return c.integer(extra)
        exact = self.exact_number(path)
        return F.when(exact == exact.try_cast("bigint"), exact.try_cast("bigint"))

    def numeric_operands(self, path, value):
        c, extra = self._route(path)
        if isinstance(c, Resolver):
            return c.numeric_operands(extra, value)
        if extra in ("bigint", "int") and float(value).is_integer():
            return c, F.lit(int(value))
        return self.number(path), F.lit(float(value))

    def exact_number(self, path):
        c, extra = self._route(path)
        if isinstance(c, Resolver):
            return c.exact_number(extra)
        return F.lit(None).cast(EXACT) if extra == "boolean" else c.try_cast(EXACT)

    def equality_operands(self, path, value):
        c, extra = self._route(path)
        if isinstance(c, Resolver):
            return c.equality_operands(extra, value)
        if extra in ("bigint", "int") and isinstance(value, int):
            return c, F.lit(value)
        return super().equality_operands(path, value)

    def bucket_has(self, path, bucket):
        c, extra = self._route(path)
        if isinstance(c, Resolver):
            return c.bucket_has(extra, bucket)
        t = {"string": "string", "bigint": "int", "double": "float", "boolean": "bool"}.get(extra)
        return c.isNotNull() & F.lit(t == bucket)


@dataclass
class StaticDynamicLayout(Layout):
    """L4: declared typed columns, one VARIANT for the dynamic field and one
    (``REST``) for every undeclared field, the source text of timestamps and
    the parents of nested static fields.

    Top-level static values that do not convert to the declared type become
    NULL (the event is kept). ``hot`` paths of the dynamic part get columns of
    their own (see ``VariantLayout``).
    """
    name: str = "static_dynamic"
    static: tuple = MONGOD_STATIC
    dynamic: str = MONGOD_DYNAMIC
    timestamp_formats: tuple = ()
    hot: tuple = ()

    def build(self, lines):
        keep = _passthrough(lines)
        return self.from_variant(lines.select(*keep, F.parse_json("line").alias("_j")), "_j")

    def from_variant(self, df, j: str):
        """Layout columns from an already parsed VARIANT column ``j``."""
        keep = [c for c in df.columns if c not in (j, "line")]
        v = F.col(j)
        cols = []
        for p, t in self.static:
            if t == "timestamp":
                from logvault.operators.project import to_event_time
                c = to_event_time(V.vget(v, p, "string"), self.timestamp_formats)
            elif t in ("bigint", "int", "smallint", "tinyint"):
                # a variant cast to an integer truncates 1.5 to 1; keep only integral values
                exact = V.vget(v, p, EXACT)
                c = F.when(exact == exact.try_cast("bigint"), V.vget(v, p, t))
            else:
                c = V.vget(v, p, t)
            cols.append(c.alias(_col_name(p)))
        stored = [self.dynamic, *(parse_path(p)[0] for p, t in self.static if _in_column(p, t))]
        rest = F.to_variant_object(F.map_filter(v.try_cast("map<string,variant>"), lambda k, _: ~k.isin(*stored)))
        out = df.select(*keep, *cols, V.vget(v, self.dynamic).alias(self.dynamic), rest.alias(REST))
        return out.select("*", *hot_columns(StaticDynamicResolver(self.static, self.dynamic), self.hot))

    def resolver(self, df):
        base = StaticDynamicResolver(self.static, self.dynamic, REST in df.columns)
        return HotResolver(base, self.hot, df.columns) if self.hot else base


# --------------------------------------------------------------------- L5
@dataclass
class VariantLayout(Layout):
    """One VARIANT column ``j`` (shredded into typed Parquet columns).

    ``hot`` declares paths that searches need most, as ``(path, "text")`` or
    ``(path, "number")``: each gets a plain column beside the document, which
    searches read, sort orders can use (``write_ordered``) and scans skip row
    groups by. Fields inside a VARIANT carry no statistics for that.
    """
    name: str = "variant"
    column: str = "j"
    hot: tuple = ()

    def build(self, lines):
        keep = _passthrough(lines)
        return self._with_hot(lines.select(*keep, _once(self._document(F.parse_json("line"))).alias(self.column)))

    def from_variant(self, df, j: str):
        """Layout from an already parsed VARIANT column ``j`` (no second parse)."""
        keep = [c for c in df.columns if c not in (j, "line")]
        return self._with_hot(df.select(*keep, _once(self._document(F.col(j))).alias(self.column)))

    def _document(self, v: Column) -> Column:
        return v

    def _with_hot(self, df):
        return df.select("*", *hot_columns(VariantResolver(F.col(self.column)), self.hot))

    def resolver(self, df):
        base = VariantResolver(F.col(self.column))
        return HotResolver(base, self.hot, df.columns) if self.hot else base


# --------------------------------------------------------------------- L6
@dataclass
class DocumentLayout(VariantLayout):
    """Normalised documents (N12) in a VARIANT, searched with token predicates."""
    name: str = "document"

    def _document(self, v):
        from logvault.operators.normalize import normalize
        return normalize(v)


LAYOUTS = {
    "json_string": JsonStringLayout,
    "pairwise": PairwiseLayout,
    "inferred": InferredLayout,
    "merged": MergedLayout,
    "static_dynamic": StaticDynamicLayout,
    "variant": VariantLayout,
    "document": DocumentLayout,
}


def get_layout(name: str, **kw) -> Layout:
    return LAYOUTS[name](**kw)

"""Key encoding, so that keys with spaces or hyphens (or all keys)
become safe names.

* ``b64``: keys containing ``' '`` or ``'-'`` -> base64 of their UTF-8 bytes.
* ``hex``: every key -> upper-case base16 of its UTF-8 bytes (the reference
  calls this variation ``base32``, but it encodes base16).

Values and other keys are untouched, through objects and arrays.

Three native forms:
* ``encode_keys_text`` rewrites the keys of JSON text in one pass over its
  tokens: documents of any depth, other bytes untouched. Lines use this one.
* ``encode_keys_variant`` rewrites a VARIANT per row up to ``depth`` levels
  (objects via ``MAP<STRING,VARIANT>``, arrays via ``ARRAY<VARIANT>``); the
  expression grows linearly with depth because each level binds its rewritten
  children once. Deeper containers raise instead of being left unencoded.
* ``encode_keys_struct`` renames the fields of a struct schema and casts the
  columns to it: a schema change, no per-row work.
"""

from __future__ import annotations

import base64
import binascii

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logvault.functions.variant import is_array, is_object

MODES = ("b64", "hex")
DEFAULT_DEPTH = 16


def allow_depth(spark, depth: int) -> None:
    """Nested lambdas take analyzer iterations per level; raise the session's
    limit for bounds beyond the default (resolution time grows with depth)."""
    if depth > DEFAULT_DEPTH:
        cur = int(spark.conf.get("spark.sql.analyzer.maxIterations", "100"))
        spark.conf.set("spark.sql.analyzer.maxIterations", str(max(cur, 20 * depth)))


def encode_name_column(k: Column, mode: str) -> Column:
    if mode == "hex":
        return F.hex(F.encode(k, "UTF-8"))
    if mode == "b64":
        return F.when(k.contains(" ") | k.contains("-"), F.base64(F.encode(k, "UTF-8"))).otherwise(k)
    raise ValueError(f"mode must be one of {MODES}")


def encode_name(k: str, mode: str) -> str:
    """Python form of the same rule (schema rewrite, oracle literals)."""
    if mode == "hex":
        return binascii.hexlify(k.encode("utf-8")).decode("ascii").upper()
    if mode == "b64":
        return base64.b64encode(k.encode("utf-8")).decode("ascii") if (" " in k or "-" in k) else k
    raise ValueError(f"mode must be one of {MODES}")


# A string with the colon that makes it a key, or a run outside strings. The
# quantifiers are possessive: no backtracking and no recursion on long strings.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[^"]++'
_INTEGRAL_FLOAT = r"(-?\d+\.0+)(?![\deE])"


def _encode_key_token(token: Column, mode: str) -> Column:
    quoted = F.regexp_replace(token, r"\s*:$", "")
    name = F.when(quoted.contains("\\"), F.get_json_object(F.concat(F.lit("["), quoted, F.lit("]")), "$[0]")).otherwise(
        F.substr(quoted, F.lit(2), F.length(quoted) - 2))
    coded = F.concat(F.lit('"'), encode_name_column(name, mode), F.lit('":'))
    if mode == "hex":
        plain = F.substr(token, F.lit(2), F.length(token) - 3)
        return F.when(token.endswith('":') & ~token.contains("\\"),
                      F.concat(F.lit('"'), encode_name_column(plain, mode), F.lit('":'))).otherwise(coded)
    # most keys stay; an escape may stand for a space or a hyphen
    return (F.when(~(token.contains(" ") | token.contains("-") | token.contains("\\")), token)
            .when(name.contains(" ") | name.contains("-"), coded).otherwise(token))


def encode_keys_text(line: Column, mode: str = "b64") -> Column:
    """JSON text as a VARIANT with encoded keys, at any depth; NULL where it does
    not parse (a filter on validity may run after this expression).

    Keys that become equal follow the duplicate-key rule of the session (the
    last one wins). ``6.0`` stays a float: an exponent keeps the parser from
    reading it as a DECIMAL that prints as ``6``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    tokens = F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0))
    coded = F.transform(tokens, lambda t: F.when(t.startswith('"'), F.when(t.endswith(":"), _encode_key_token(t, mode))
                                                 .otherwise(t))
                        .when(t.contains(".0"), F.regexp_replace(t, _INTEGRAL_FLOAT, "$1E0")).otherwise(t))
    return F.try_parse_json(F.array_join(coded, ""))


def _float_leaf(x: Column) -> Column:
    """A float written with an integral value (``6.0``) parses to DECIMAL(p,0)
    and would print as ``6``; store it as DOUBLE so JSON text keeps ``6.0``.
    DECIMAL(p>=19,0) is left alone (it may be an integer beyond 64 bits)."""
    t = F.schema_of_variant(x)
    integral_dec = t.rlike(r"^DECIMAL\((1[0-8]|[1-9]),0\)$")
    return F.when(integral_dec, x.try_cast("double").cast("variant")).otherwise(x)


def _enc(x: Column, mode: str, level: int, depth: int) -> Column:
    if level == depth:
        msg = F.lit(f"document nested deeper than {depth} levels; raise depth=")
        return F.when(is_object(x) | is_array(x), F.raise_error(msg).cast("variant")).otherwise(x)
    m = x.try_cast("map<string,variant>")
    a = x.try_cast("array<variant>")
    kids = F.coalesce(
        F.transform(F.map_entries(m), lambda e: F.struct(encode_name_column(e["key"], mode).alias("k"),
                                                         e["value"].alias("v"))),
        F.transform(a, lambda e: F.struct(F.lit(None).cast("string").alias("k"), e.alias("v"))))
    done = F.transform(kids, lambda e: F.struct(e["k"].alias("k"), _enc(e["v"], mode, level + 1, depth).alias("v")))
    built = F.element_at(F.transform(F.array(done), lambda d: F.when(
        m.isNotNull(), F.to_variant_object(F.map_from_entries(d))
    ).otherwise(F.transform(d, lambda e: e["v"]).cast("variant"))), 1)
    return F.when(m.isNotNull() | a.isNotNull(), built).otherwise(_float_leaf(x))


def encode_keys_variant(v: Column, mode: str = "b64", depth: int = DEFAULT_DEPTH) -> Column:
    """Document with encoded keys. Two keys encoding to the same name raise."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return _enc(v, mode, 0, depth)


def _enc_type(t: T.DataType, mode: str) -> T.DataType:
    if isinstance(t, T.StructType):
        names = [encode_name(f.name, mode) for f in t.fields]
        if len(set(names)) != len(names):
            raise ValueError(f"key collision after {mode} encoding: {sorted(names)}")
        return T.StructType([T.StructField(n, _enc_type(f.dataType, mode), f.nullable)
                             for n, f in zip(names, t.fields)])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_enc_type(t.elementType, mode), t.containsNull)
    return t


def encode_keys_struct(df: DataFrame, mode: str = "b64", columns: list[str] | None = None) -> DataFrame:
    """Encode field names of (inferred) struct columns by a schema cast.

    Fields that were stored as JSON text because their types conflicted keep
    their inner keys; use the VARIANT form for those.
    """
    columns = columns if columns is not None else df.columns
    out, seen = [], set()
    for f in df.schema.fields:
        name = encode_name(f.name, mode) if f.name in columns else f.name
        if name in seen:
            raise ValueError(f"key collision after {mode} encoding: {name}")
        seen.add(name)
        c = F.col(f"`{f.name}`")
        if f.name in columns and isinstance(f.dataType, (T.StructType, T.ArrayType)):
            c = c.cast(_enc_type(f.dataType, mode))
        out.append(c.alias(name))
    return df.select(*out)


def encode_keys(df: DataFrame, mode: str = "b64", column: str | None = None,
                depth: int = DEFAULT_DEPTH) -> DataFrame:
    """N01/N02 on a DataFrame: VARIANT column ``column`` if given, else the struct schema."""
    if column is not None:
        allow_depth(df.sparkSession, depth)
        return df.withColumn(column, encode_keys_variant(F.col(column), mode, depth))
    return encode_keys_struct(df, mode)

"""Variant access helpers (all native Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logvault.functions.paths import json_path, parse_path


def vget(v: Column, path, typ: str = "variant") -> Column:
    """Value at ``path``; NULL when absent or not convertible (never raises)."""
    segs = parse_path(path)
    if not segs:
        return v if typ == "variant" else v.try_cast(typ)
    return F.try_variant_get(v, json_path(segs), typ)


def present(v: Column) -> Column:
    """Present and not JSON null (SQL NULL = absent, variant null = null)."""
    return v.isNotNull() & ~F.is_variant_null(v)


def is_object(v: Column) -> Column:
    return v.try_cast("map<string,variant>").isNotNull()


def is_array(v: Column) -> Column:
    return v.try_cast("array<variant>").isNotNull()


def bucket_of_type(t: Column, v: Column) -> Column:
    """Pairwise type bucket from a ``schema_of_variant`` string ``t`` of ``v``.

    string / int / float / bool; JSON null gives NULL (such leaves are
    skipped). Integers that do not fit a BIGINT arrive as DECIMAL(p>=19, 0) or
    DOUBLE and are numbers of the float bucket, so one of them ends no job.
    Containers give 'object' / 'array'.
    """
    return (
        F.when(t == "STRING", F.lit("string"))
        .when(t == "BOOLEAN", F.lit("bool"))
        .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("int"))
        .when(t.isin("DOUBLE", "FLOAT") | t.startswith("DECIMAL"), F.lit("float"))
        .when(t.startswith("OBJECT"), F.lit("object"))
        .when(t.startswith("ARRAY"), F.lit("array"))
    )


def bucket(v: Column) -> Column:
    """Pairwise type bucket of a variant value (see ``bucket_of_type``)."""
    return F.element_at(F.transform(F.array(F.schema_of_variant(v)), lambda t: bucket_of_type(t, v)), 1)


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and pass it to ``fn``, so that using it twice does not copy it into the plan."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


def _java_text(x: Column) -> Column:
    """The fewest digits that give a finite number back, as Java writes them (``1.5E-7``)."""
    def few(java):
        # Java before 19 writes more digits than needed of some numbers of 16 and more, and of the smallest ones
        n = F.length(F.regexp_replace(F.substring_index(java, "E", 1), r"[-.]", ""))
        many = n > 15
        text = lambda k: F.upper(F.replace(F.format_string(f"%.{k - 1}e", x), F.lit("e+"), F.lit("e")))
        head = F.substring_index(java, "E", 1)
        cut = lambda n: F.concat(F.substr(head, F.lit(1), F.length(head) - n), F.substr(java, F.length(head) + 1))
        tried = [text(1), text(2), text(3), text(15), text(16), F.when(n == 17, cut(1)).otherwise(cut(2)), text(17), cut(1)]
        short = [let(t, lambda t: F.when(t.try_cast("double") == x, t)) for t in tried]
        return F.when((x != 0) & (many | (F.abs(x) < 1e-307)), F.coalesce(*short, java)).otherwise(java)
    return let(x.cast("string"), few)


def _python_text(java: Column) -> Column:
    def write(s):
        digits, power = s["digits"], s["power"]
        # digits d1 d2 ... dn stand for d1.d2...dn * 10^power
        plain = (F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
                 .when(F.length(digits) <= power + 1, F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0")))
                 .otherwise(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))))
        tail = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
        exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        written = F.when((power >= -4) & (power < 16), plain).otherwise(F.concat(F.substr(digits, F.lit(1), F.lit(1)), tail, exponent))
        return F.concat(F.when(java.startswith("-"), "-").otherwise(""), written)
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(java, "E", 1), r"[-.]", ""), r"(?<=.)0+$", "")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1).try_cast("int")
    return F.when(~java.contains("E"), java).otherwise(let(F.struct(digits.alias("digits"), power.alias("power")), write))


def py_float(x: Column) -> Column:
    """Text of a double as Python's ``str()`` writes it: without exponent from 1e-4 to
    below 1e16, else with a signed one of two digits or more."""
    return let(x, lambda v: F.when(v.isNull(), F.lit(None).cast("string")).when(F.isnan(v), "nan").when(v == float("inf"), "inf")
               .when(v == float("-inf"), "-inf").otherwise(let(_java_text(v), _python_text)))


def py_str(v: Column) -> Column:
    """Text of a scalar as Python's ``str()`` writes it (None/True/False)."""
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(t == "VOID", F.lit("None"))
        .when(t == "BOOLEAN", F.when(v.try_cast("boolean"), F.lit("True")).otherwise(F.lit("False")))
        # an integer beyond 64 bits arrives as DECIMAL(p>=19,0) and keeps its digits
        .when(t.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), v.try_cast("string"))
        .when(t.isin("DOUBLE", "FLOAT") | t.startswith("DECIMAL"), py_float(v.try_cast("double")))
        .otherwise(v.try_cast("string"))
    )

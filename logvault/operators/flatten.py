"""Flatten JSON documents into typed leaves, in-row.

Every step is a native projection over one row (no shuffle, no Python): a
frontier ``array<struct<p, v>>`` starts at the root and is expanded one
container level per step, objects to ``p.k`` and arrays to ``p[i]``; scalars
stay. JSON null, ``{}`` and ``[]`` yield no leaf. Documents may be nested to any
depth; with ``depth=`` a deeper one raises, so nothing is silently truncated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvault.functions.variant import bucket_of_type, let

DEFAULT_DEPTH = None  # as many levels as the document has
NEAR_LEVELS = 8  # levels before the brackets of a document are counted
BUCKETS = ("string", "int", "float", "bool")
BUCKET_TYPES = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean"}


def _child_path(parent: Column, key: Column) -> Column:
    return F.when(parent == "", key).otherwise(F.concat(parent, F.lit("."), key))


def _node(path: Column, v: Column) -> Column:
    """A value on its path; ``m`` or ``a`` holds the members of a container, looked up once."""
    return F.struct(path.alias("p"), v.alias("v"), v.try_cast("map<string,variant>").alias("m"),
                    v.try_cast("array<variant>").alias("a"))


def _is_container(x: Column) -> Column:
    return x["m"].isNotNull() | x["a"].isNotNull()


def _children(x: Column) -> Column:
    """Children of a container, each one a ``_node``."""
    return F.when(x["m"].isNotNull(), F.transform(F.map_entries(x["m"]), lambda e: _node(
        _child_path(x["p"], e["key"]), e["value"]))).otherwise(F.transform(x["a"], lambda e, i: _node(
            F.concat(x["p"], F.lit("["), i.cast("string"), F.lit("]")), e)))


def _scalars(nodes: Column) -> Column:
    """The finished leaves among ``nodes``, typed."""
    return F.transform(F.filter(nodes, lambda x: ~_is_container(x)), lambda x: F.struct(
        x["p"].alias("p"), let(F.schema_of_variant(x["v"]), lambda t: bucket_of_type(t, x["v"])).alias("t"),
        x["v"].alias("v")))


def _step(s: Column) -> Column:
    """One level: expand pending containers; finished scalars move to ``done``.
    A row with nothing pending passes its state through unchanged."""
    expanded = let(F.flatten(F.transform(s["todo"], _children)), lambda kids: F.struct(
        F.concat(s["done"], _scalars(kids)).alias("done"), F.filter(kids, _is_container).alias("todo")))
    return F.when(F.size(s["todo"]) == 0, s).otherwise(expanded)


def leaves_column(v: Column, depth: int | None = DEFAULT_DEPTH) -> Column:
    """``array<struct<p string, t string, v variant>>`` of the scalar leaves of ``v``.

    State per row: finished scalar leaves and pending containers. The levels
    are an ``aggregate`` whose accumulator is that state, so the plan has no
    copy of the level logic per level, scalars are examined once, and a
    finished row costs nothing per further level. Without ``depth`` a document
    that has containers pending after ``NEAR_LEVELS`` levels gets as many more as
    it has opening brackets, which no nesting exceeds (only such documents are
    written as text to count them); with it, a container still pending after
    ``depth`` levels raises (no truncation). JSON nulls are dropped.
    """
    start = let(F.array(_node(F.lit(""), v)), lambda r: F.struct(
        _scalars(r).alias("done"), F.filter(r, _is_container).alias("todo")))
    near = NEAR_LEVELS if depth is None else depth
    state = F.aggregate(F.sequence(F.lit(1), F.lit(near)), start, lambda s, _level: _step(s))

    def finish(s):
        typed = F.filter(s["done"], lambda x: x["t"].isNotNull())
        if depth is not None:
            msg = F.lit(f"document nested deeper than {depth} levels")
            rest = F.raise_error(msg).cast("array<struct<p:string,t:string,v:variant>>")
        else:
            levels = let(F.to_json(v), lambda text: F.length(text) - F.length(F.translate(text, "{[", "")))
            far = F.aggregate(F.sequence(F.lit(1), levels), s, lambda s, _level: _step(s))
            rest = F.filter(far["done"], lambda x: x["t"].isNotNull())
        return F.when(F.size(s["todo"]) > 0, rest).otherwise(typed)
    return let(state, finish)


def with_leaves(df: DataFrame, v: str | Column, out: str = "_leaves", depth: int | None = DEFAULT_DEPTH) -> DataFrame:
    """Add ``out``: the leaves of ``v`` (see ``leaves_column``)."""
    return df.withColumn(out, leaves_column(F.col(v) if isinstance(v, str) else v, depth))


def _is_bucket(b: str):
    return lambda x: x["t"] == b


def _value_as(b: str):
    return lambda x: F.try_variant_get(x["v"], "$", BUCKET_TYPES[b])


def pairwise_columns(leaves: Column) -> Column:
    """Generator of the one row of the eight pairwise-array columns (``<t>_columns``, ``<t>_values``).

    Filters on them stay above a generator, so no search flattens a document
    again for each column that it asks."""
    def lists(x):
        cols = []
        for b in BUCKETS:
            sel = F.filter(x, _is_bucket(b))
            cols += [sel["p"].alias(f"{b}_columns"), F.transform(sel, _value_as(b)).alias(f"{b}_values")]
        return F.struct(*cols)
    return F.inline(F.array(let(leaves, lists)))


def flatten_pairwise(df: DataFrame, v: str = "j", keep: list[str] | None = None,
                     depth: int | None = DEFAULT_DEPTH) -> DataFrame:
    """Variant column -> pairwise layout (plus ``keep`` passthrough columns)."""
    keep = keep or []
    return df.select(*keep, pairwise_columns(leaves_column(F.col(v), depth)))


def leaf_paths(df: DataFrame, v: str = "j", keep: list[str] | None = None,
               depth: int | None = DEFAULT_DEPTH) -> DataFrame:
    """Long form ``(keep..., path, type, value)``; ``value`` is the leaf as text.

    A ``depth`` raises on deeper documents instead of truncating.
    """
    keep = keep or []
    # exploded as an expression: for a column, Spark would add filters that flatten the document again
    return (df.select(*keep, F.explode(leaves_column(F.col(v), depth)).alias("_l"))
            .select(*keep, F.col("_l.p").alias("path"), F.col("_l.t").alias("type"),
                    F.try_variant_get(F.col("_l.v"), "$", "string").alias("value")))


def path_catalog(df: DataFrame, v: str = "j", depth: int | None = DEFAULT_DEPTH) -> DataFrame:
    """``(path, type, n_rows, is_static)``; static = present in every row.

    One pass over the documents with map-side partial aggregation: the
    shuffle carries at most one record per distinct (path, type) per input
    partition, however skewed the paths are. Leaf values are never extracted.
    The row total is a scalar subquery over the input with no columns read
    (Parquet answers it from row-group metadata).
    """
    pairs = df.select(F.explode(F.transform(leaves_column(F.col(v), depth), lambda x: F.struct(
        x["p"].alias("path"), x["t"].alias("type")))).alias("l")).select("l.*")
    total = df.select(F.count(F.lit(1))).scalar()
    return (pairs.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("is_static", F.col("n_rows") == total))


def _tag(b: str):
    return lambda p: F.struct(p.alias("path"), F.lit(b).alias("type"))


def path_catalog_pairwise(df: DataFrame) -> DataFrame:
    """N05 on a pairwise archive: its path arrays already hold every leaf,
    so the catalogue is an explode + partial aggregation, no flattening."""
    pairs = df.select(F.explode(F.concat(*[
        F.transform(F.col(f"{b}_columns"), _tag(b)) for b in BUCKETS])).alias("l")).select("l.*")
    total = df.select(F.count(F.lit(1))).scalar()
    return (pairs.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("is_static", F.col("n_rows") == total))


RECURSIVE_LEAVES = """
WITH RECURSIVE nodes({cols}_p, _v) AS (
  SELECT {cols}'', {v} FROM {{src}}
  UNION ALL
  SELECT {ncols}CASE WHEN e.key IS NOT NULL
              THEN CASE WHEN n._p = '' THEN e.key ELSE n._p || '.' || e.key END
              ELSE n._p || '[' || CAST(e.pos AS STRING) || ']' END,
         e.value
  FROM nodes n, LATERAL variant_explode(n._v) e
)
SELECT {cols}_p AS path, _v AS v FROM nodes
WHERE try_cast(_v AS MAP<STRING, VARIANT>) IS NULL AND try_cast(_v AS ARRAY<VARIANT>) IS NULL
"""


def leaf_paths_recursive(df: DataFrame, v: str = "j", keep: list[str] | None = None) -> DataFrame:
    """N04 for documents of any depth: a recursive CTE that expands one level
    per step with ``variant_explode`` (a generator, no shuffle), until no
    container is left. Same output as ``leaf_paths``; no depth bound."""
    keep = keep or []
    spark = df.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    cols = "".join(f"`{c}`, " for c in keep)
    ncols = "".join(f"n.`{c}`, " for c in keep)
    sql = RECURSIVE_LEAVES.format(cols=cols, ncols=ncols, v=f"`{v}`")
    raw = spark.sql(sql, src=df.select(*keep, v))
    typed = raw.withColumn("type", F.element_at(F.transform(
        F.array(F.schema_of_variant("v")), lambda t: bucket_of_type(t, F.col("v"))), 1))
    return (typed.filter(F.col("type").isNotNull())
            .select(*keep, "path", "type", F.try_variant_get(F.col("v"), "$", "string").alias("value")))

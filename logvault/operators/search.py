"""A01/A02 hit counting, R10 cross check, R11 layout difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvault.layouts.base import Layout
from logvault.operators.predicates import Pred


def search(df: DataFrame, layout: Layout, pred: Pred) -> DataFrame:
    """Matching rows (``SELECT * .. WHERE pred``)."""
    return df.filter(pred.column(layout.resolver(df)))


def count_hits(df: DataFrame, layout: Layout, pred: Pred) -> int:
    """Number of matching events (rows, not output lines)."""
    return search(df, layout, pred).count()


def count_hits_many(df: DataFrame, layout: Layout, preds: dict) -> DataFrame:
    """All searches in one scan, one ``count_if`` per search (one row)."""
    r = layout.resolver(df)
    return df.agg(*[F.count_if(F.coalesce(p.column(r), F.lit(False))).alias(name)
                    for name, p in preds.items()])


def cross_check(counts: DataFrame, a: str, b: str) -> DataFrame:
    """Two searches that must hit equally often -> (a, b, equal)."""
    return counts.select(F.col(a), F.col(b), (F.col(a) == F.col(b)).alias("equal"))


def layout_diff(left: DataFrame, left_layout: Layout, left_pred: Pred, right: DataFrame,
                right_layout: Layout, right_pred: Pred, key_path: str, key_type: str = "bigint") -> DataFrame:
    """Events found more often in one layout/search than in the other
    -> ``(key, side)``, one row a key, side ``left_only`` / ``right_only``.

    ``key_path`` identifies an event in both layouts. Keys meet as text
    (integers in one spelling) and a missing key is a key too; ``key_type`` is
    only the type shown, ``"string"`` for text ids. One scan a side and one
    aggregate: hot or missing keys are combined before the shuffle.
    """
    def keys(df, layout, pred, sign):
        hits = search(df, layout, pred)
        r = layout.resolver(hits)
        key = F.coalesce(r.integer(key_path).cast("string"), r.text(key_path))
        return hits.select(key.alias("key"), F.lit(sign).alias("sign"))

    both = keys(left, left_layout, left_pred, 1).unionByName(keys(right, right_layout, right_pred, -1))
    more = both.groupBy("key").agg(F.sum("sign").alias("more")).filter("more <> 0")
    return more.select(F.col("key").try_cast(key_type).alias("key"),
                       F.when(F.col("more") > 0, F.lit("left_only")).otherwise(F.lit("right_only")).alias("side"))

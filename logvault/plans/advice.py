"""Facts for choosing a layout, from a path catalogue.

An inferred struct schema grows with every distinct path, and keeps a path seen
with several types only as JSON text; a shredded VARIANT does neither. The
counts are reported; where to draw the line is the user's choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layout_facts(catalog: DataFrame) -> DataFrame:
    """One row: ``n_paths`` distinct paths, ``n_conflicts`` of them with more than one type."""
    types = catalog.groupBy("path").agg(F.countDistinct("type").alias("n"))
    return types.agg(F.count(F.lit(1)).alias("n_paths"), F.count_if(F.col("n") > 1).alias("n_conflicts"))

"""Open an archive and name it for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logvault.layouts import get_layout


def read_archive(spark: SparkSession, path: str, layout: str = "variant", view: str | None = None,
                 require_data: bool = False) -> DataFrame:
    """Open an archive; ``require_data`` refuses an archive that stores no
    bytes (nothing to search), as the reference's search phase does."""
    if require_data:
        from logvault.operators.quality import archive_size
        if archive_size(spark, path) == 0:
            raise ValueError(f"archive {path} is empty: nothing to search")
    df = get_layout(layout).read(spark, path)
    if view:
        df.createOrReplaceTempView(view)
    return df

"""Archive layouts: how a dataset is stored, and how a path reads from it.

Every layout has ``build`` (lines -> layout columns, a lazy projection),
``write``/``read`` (Parquet archive) and ``resolver(df)``, which turns a log
path into native Columns. Predicates only talk to resolvers, so one predicate
tree searches every layout with the same semantics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.functions import variant as V
from logvault.functions.paths import path_text

#: Holds every 64-bit integer, and fractions far below what tells them apart.
EXACT = "decimal(38,18)"


class Resolver:
    """Path -> Column for one DataFrame of one layout."""

    def exists(self, path) -> Column:  # present and not JSON null
        raise NotImplementedError

    def text(self, path) -> Column:  # scalar as text (JSON text for containers)
        raise NotImplementedError

    def number(self, path) -> Column:  # numeric value (numeric text counts)
        return self.text(path).try_cast("double")

    def integer(self, path) -> Column:  # exact 64-bit integer value
        return self.text(path).try_cast("bigint")

    def numeric_operands(self, path, value) -> tuple[Column, Column]:
        """(value of path, literal) in the best common type for comparing.

        Layouts with typed integral storage override this so that comparisons
        stay in the column's own type and can be pushed into the scan."""
        return self.number(path), F.lit(float(value))

    def exact_number(self, path) -> Column:
        """The value as a wide DECIMAL: exact for every 64-bit integer."""
        return self.text(path).try_cast(EXACT)

    def equality_operands(self, path, value) -> tuple[Column, Column]:
        """Operands for numeric (in)equality. A double tells an integer below
        2^53 from every other number; larger 64-bit literals compare exactly."""
        if isinstance(value, int) and 1 << 53 <= abs(value) < 1 << 63:
            return self.exact_number(path), F.lit(value).cast(EXACT)
        return self.numeric_operands(path, value)

    def bucket_has(self, path, bucket: str) -> Column:  # leaf of the given pairwise bucket
        raise NotImplementedError


class VariantResolver(Resolver):
    """Paths over a VARIANT column (L4 attr, L5, L6)."""

    def __init__(self, v: Column):
        self.v = v

    def node(self, path) -> Column:
        return V.vget(self.v, path)

    def exists(self, path):
        n = self.node(path)
        return F.coalesce(V.present(n), F.lit(False))

    def text(self, path):
        return V.vget(self.v, path, "string")

    def _unless_bool(self, path, value: Column) -> Column:
        """A variant cast turns booleans into 1 and 0; they are no numbers here."""
        return F.when(~self.text(path).isin("true", "false"), value)

    def number(self, path):
        return self._unless_bool(path, V.vget(self.v, path, "double"))

    def integer(self, path):
        exact = self.exact_number(path)  # a bigint cast would truncate 1.5
        return F.when(exact == exact.try_cast("bigint"), V.vget(self.v, path, "bigint"))

    def exact_number(self, path):
        return self._unless_bool(path, V.vget(self.v, path, EXACT))

    def bucket_has(self, path, bucket):
        return F.coalesce(V.bucket(self.node(path)) == bucket, F.lit(False))


#: Kinds of declared hot columns: what the resolver says of the path, stored.
HOT_KINDS = ("text", "number")


def hot_name(path, kind: str) -> str:
    """Column of a hot path: ``hot_number_attr_message_ts_sec``."""
    return f"hot_{kind}_" + re.sub(r"\W", "_", path_text(path))


def hot_columns(resolver: Resolver, hot) -> list[Column]:
    """Columns of the hot paths ``((path, kind), ...)`` as ``resolver`` reads them."""
    if any(kind not in HOT_KINDS for _, kind in hot) or len({hot_name(*h) for h in hot}) < len(hot):
        raise ValueError(f"hot paths need distinct column names and a kind in {HOT_KINDS}")
    return [getattr(resolver, kind)(p).alias(hot_name(p, kind)) for p, kind in hot]


class HotResolver(Resolver):
    """Reads declared hot paths from top-level columns beside the document.

    A hot column holds exactly what ``base`` computes for its path, so the rows
    found are the same; being plain Parquet columns, their statistics let scans
    skip row groups, which fields inside a VARIANT do not.
    """

    def __init__(self, base: Resolver, hot, columns):
        self.base = base
        self.hot = {(path_text(p), k): F.col(hot_name(p, k)) for p, k in hot if hot_name(p, k) in columns}

    def _hot(self, path, kind):
        return self.hot.get((path_text(path), kind))

    def exists(self, path):
        return self.base.exists(path)

    def text(self, path):
        c = self._hot(path, "text")
        return self.base.text(path) if c is None else c

    def number(self, path):
        c = self._hot(path, "number")
        return self.base.number(path) if c is None else c

    def integer(self, path):
        return self.base.integer(path)

    def exact_number(self, path):
        return self.base.exact_number(path)

    def numeric_operands(self, path, value):
        c = self._hot(path, "number")
        return self.base.numeric_operands(path, value) if c is None else (c, F.lit(float(value)))

    def equality_operands(self, path, value):
        if self._hot(path, "number") is None:
            return self.base.equality_operands(path, value)
        return super().equality_operands(path, value)

    def bucket_has(self, path, bucket):
        return self.base.bucket_has(path, bucket)


class AbsentResolver(Resolver):
    """A path that the layout does not store at all."""

    def exists(self, path):
        return F.lit(False)

    def text(self, path):
        return F.lit(None).cast("string")

    def number(self, path):
        return F.lit(None).cast("double")

    def exact_number(self, path):
        return F.lit(None).cast(EXACT)

    def bucket_has(self, path, bucket):
        return F.lit(False)


@dataclass
class Layout:
    name: str = "layout"
    # Writer defaults (S10): big row groups for scan speed; records per file
    # bound the size of each output file.
    max_records_per_file: int = 5_000_000
    options: dict = field(default_factory=dict)

    def build(self, lines: DataFrame) -> DataFrame:
        raise NotImplementedError

    def resolver(self, df: DataFrame) -> Resolver:
        raise NotImplementedError

    def write(self, df: DataFrame, path: str, mode: str = "errorifexists", **opts) -> None:
        w = (df.write.mode(mode).option("compression", "zstd")
             .option("parquet.compression.codec.zstd.level", "3")
             .option("maxRecordsPerFile", opts.pop("max_records_per_file", self.max_records_per_file)))
        for k, v in {**self.options, **opts}.items():
            w = w.option(k, v)
        w.parquet(path)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.parquet(path)


__all__ = ["Resolver", "VariantResolver", "AbsentResolver", "Layout"]

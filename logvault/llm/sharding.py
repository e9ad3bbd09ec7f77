"""Operator 9: sharding along a Hilbert curve.

Metadata columns are quantised to a few bits each, a Hilbert index interleaves
them so that neighbours on the curve are neighbours in every dimension, rows are
ordered by the index and the order is cut into runs of near equal bytes. Each
shard then covers a compact box of metadata, so min/max statistics of its files
prune on any of the dimensions.

Only (doc_id, size, crc, curve index) are sorted, never the texts. Ranges are
split on (index, crc, doc_id), so one index value that a third of the rows share
spreads over many tasks; ranks and byte positions come from per-task totals.

Defined cases: null text has no bytes (size 8); null metadata is one value of
its own; equal rows stay separate rows and are neighbours; an empty table gives
no rows. More shards than rows leave shards empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvault.llm.common import materialise, read_table

SHARDS = 24
BITS = 5


def hilbert_codes(dims: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Hilbert index of points with coordinates in [0, 2^bits).

    Skilling's transpose form, a bit of all points at a time: from the top bit
    down each dimension inverts or exchanges the lower bits of the first one;
    the result is Gray-encoded and interleaved.
    """
    x = [np.array(d, dtype=np.int64) for d in dims]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for d in x:
            out = (out << 1) | (((d ^ t) >> b) & 1)
    return out


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """``hilbert_codes`` of integer columns, a batch at a time."""
    @F.pandas_udf("bigint")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_codes([c.to_numpy() for c in cols], bits))
    return index(*dims)


def log_bucket(value: Column, bits: int = BITS) -> Column:
    """Two steps for each doubling of a size, from 2^4 on, within ``bits`` bits."""
    v = F.greatest(value.cast("bigint"), F.lit(1).cast("bigint"))
    digits = F.bin(v)
    top = F.length(digits) - 1  # exact floor(log2)
    step = 2 * top + F.when(F.substring(digits, 2, 1) == "1", 1).otherwise(0) - 8
    return F.least(F.greatest(step, F.lit(0)), F.lit((1 << bits) - 1)).cast("bigint")


def name_bucket(value: Column, bits: int = BITS) -> Column:
    """A name's cell: its crc32; null has cell 0 with the empty name."""
    return F.pmod(F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), F.lit(1 << bits)).cast("bigint")


def curve_shards(rows: DataFrame, curve: Column, size: Column, tie: list[Column], shards: int = SHARDS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: runs of the curve of near equal total ``size``.

    A row goes where the middle of its bytes falls, so a shard's total differs
    from the even share by less than the largest row.
    """
    cols = rows.columns
    keyed = rows.withColumns({"__curve": curve, "__size": size,
                              **{f"__t{i}": t for i, t in enumerate(tie)}})
    order = ["__curve", *[f"__t{i}" for i in range(len(tie))]]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: task numbers and the order inside each task are then fixed
    run = materialise(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                      .withColumn("__at", F.monotonically_increasing_id()), "curve-order")
    run = run.withColumn("__task", F.shiftright("__at", 33))
    # positions inside small blocks of a task, then of the blocks of the corpus: no window holds a whole task
    run = run.withColumn("__block", F.shiftright(F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)), 12))
    blocks = run.groupBy("__task", "__block").agg(F.count("*").alias("n"), F.sum("__size").alias("bytes"))
    tasks = blocks.groupBy("__task").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()  # a row a task
    before, n, total = {}, 0, 0
    for t in sorted(tasks, key=lambda t: t["__task"]):
        before[t["__task"]] = (n, total)
        n, total = n + t["n"], total + t["bytes"]
    spark = rows.sparkSession
    starts = spark.createDataFrame([(k, a, z) for k, (a, z) in before.items()], "__task bigint, n0 bigint, b0 bigint")
    ahead = Window.partitionBy("__task").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    placed_blocks = (blocks.withColumns({"n1": F.coalesce(F.sum("n").over(ahead), F.lit(0)),
                                         "b1": F.coalesce(F.sum("bytes").over(ahead), F.lit(0))})
                     .join(F.broadcast(starts), "__task")  # one row a task of the sort
                     .select("__task", "__block", (F.col("n0") + F.col("n1")).alias("n1"),
                             (F.col("b0") + F.col("b1")).alias("b1")))
    inside = Window.partitionBy("__task", "__block").orderBy("__at")
    placed = (run.join(placed_blocks, ["__task", "__block"])
              .withColumns({"__rank": F.col("n1") + F.row_number().over(inside) - 1,
                            "__mid": F.col("b1") + F.sum("__size").over(inside) - F.col("__size") + F.shiftright("__size", 1)})
              .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(__mid * {shards}) div {max(total, 1)}")).cast("int")))
    placed = materialise(placed.select(*[F.col(f"`{c}`") for c in cols], "__rank", "shard"), "curve-shards")
    first = placed.groupBy("shard").agg(F.min("__rank").alias("__first"))  # a row a shard
    return (placed.join(F.broadcast(first), "shard")
            .select(*[F.col(f"`{c}`") for c in cols], "shard", (F.col("__rank") - F.col("__first")).alias("slot")))


def metadata_curve(lang: Column, source: Column, size: Column) -> Column:
    """Curve over language, source and size."""
    return hilbert_index([name_bucket(lang), name_bucket(source), log_bucket(size)])


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Document rows without texts: doc_id, size, text_crc32, shard, slot."""
    tx = F.col("text").cast("binary")
    rows = docs.select("doc_id", "lang", "source",
                       (F.coalesce(F.octet_length(tx), F.lit(0)).cast("bigint") + 8).alias("size"),
                       F.crc32(F.coalesce(tx, F.lit("").cast("binary"))).alias("text_crc32"))
    out = curve_shards(rows, metadata_curve(F.col("lang"), F.col("source"), F.col("size")), F.col("size"),
                       [F.col("text_crc32"), F.col("doc_id")], shards)
    return out.drop("lang", "source")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents as one folder a shard, rows in curve order (needs distinct doc_ids)."""
    place = shard_documents(docs, shards).select("doc_id", "shard", "slot")
    (docs.join(place, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .drop("slot").write.partitionBy("shard").parquet(path))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by the law ``bytes``."""
    out = shard_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_hilbert_shards": op9_hilbert_shards}
ORACLE_SQL: dict[str, str] = {}

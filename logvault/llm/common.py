"""Helpers shared by the operators of this subpackage.

Words are always the runs of ``[^\\x20\\x09-\\x0D]`` of the UTF-8 text with
A-Z lower-cased: exactly what ``bytes.lower().split()`` gives, so operators
receive text as binary and never depend on Unicode white space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.session import scratch_path, ship_package

#: Python workers handle at most about this many text bytes at a time.
CHUNK_BYTES = 1 << 20
#: Rows of one Arrow batch: whole texts, so batches stay small beside an executor's heap.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also ships the package to the Python workers and keeps their Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back (cuts lineage;
    the copy survives lost executors)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def pieces(batches, text_col: str, limit: int = CHUNK_BYTES):
    """Cut Arrow batches into slices of about ``limit`` text bytes.

    A slice always has whole rows, at least one; yields (slice, list of texts
    as bytes, null as b"").
    """
    for b in batches:
        col = b.column(b.schema.get_field_index(text_col))
        n = len(col)
        if not n:
            continue
        size = np.array([0 if s is None else s for s in pc.binary_length(col).to_pylist()], dtype=np.int64)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                s = b.slice(a, z - a)
                yield s, [x or b"" for x in s.column(s.schema.get_field_index(text_col)).to_pylist()]


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges``.

    Labels spread along edges and jump over pointers (label of the label), so
    rounds grow with the logarithm of the diameter. Each round is a map-side
    combined minimum; a node that a third of the edges share is one partial row
    a task. Every round is written to the shared folder; only two counters
    reach the driver. Labels only fall, so the rounds end by themselves.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    # both directions of a row at once: a union of two sides would plan and compute ``edges`` twice
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = materialise(e.select(turned).select("e.a", "e.b").distinct(), "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("component")), "cc-labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m")))
        step = (labels.join(near, "node")
                .select("node", F.col("component").alias("old"), F.least("component", "m").alias("new")))
        up = labels.select(F.col("node").alias("new"), F.col("component").alias("top"))
        nxt = materialise(step.join(up, "new")
                          .select("node", "old", F.least("new", "top").alias("component")), "cc-labels")
        settled = nxt.filter("old <> component").isEmpty()
        labels = nxt.select("node", "component")
        if settled:
            return labels


#: Sides of up to this many bytes (rows times a stated row width) are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small, else as it is. For written tables: the count is cheap."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def runs(batches, keys: list[str]):
    """Groups of consecutive rows with equal ``keys`` from sorted Arrow batches, as record batches.

    Yields lists of (first row, row after the last) over one table at a time; a
    group never spans two tables. Only groups of bounded size may be read so.
    """
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        t = t.combine_chunks()
        cuts = _cuts(t, keys)
        last = cuts[-2]
        if last:
            head = t.slice(0, last)
            yield head, cuts[:-1]
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield rest, [0, rest.num_rows]


def _cuts(t: pa.Table, keys: list[str]) -> list[int]:
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    new[0] = True
    return [*np.flatnonzero(new).tolist(), t.num_rows]

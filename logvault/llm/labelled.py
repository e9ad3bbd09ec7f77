"""Bounded training samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvault.llm.common import crc_mod

#: Longer texts are left out of training samples (never out of scoring).
MAX_SAMPLE_BYTES = 1 << 16


def training_sample(docs: DataFrame, labels: DataFrame, label: str, held_out_mod: tuple[int, int], rows_per_class: int,
                    max_bytes: int = MAX_SAMPLE_BYTES) -> DataFrame:
    """(label, draw, text) of at most ``rows_per_class`` documents of each class, drawn by a hash of doc_id.

    Rows with crc32(doc_id) mod m = r (``held_out_mod`` = (m, r)) and null labels
    are never drawn; several labels of a document count as their rounded mean, of
    several texts of a doc_id the least is taken. Ids are drawn from the labels
    alone, so only the drawn texts move and what reaches the driver is bounded.
    """
    m, r = held_out_mod
    lab = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", m) != r))
           .groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("label"))
           .withColumn("draw", F.xxhash64("doc_id")))
    one = lambda k: lab.filter(F.col("label") == k).orderBy("draw", "doc_id").limit(rows_per_class)
    drawn = F.broadcast(one(0).unionByName(one(1)))  # at most 2 * rows_per_class rows
    return (docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter(F.octet_length("text") <= max_bytes)
            .join(drawn, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.first("draw").alias("draw"), F.min("text").alias("text"))
            .select("label", "draw", "text"))

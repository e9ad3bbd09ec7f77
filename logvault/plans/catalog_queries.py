"""Registered queries for flattening, key encoding and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.layouts import get_layout
from logvault.layouts.base import VariantResolver
from logvault.operators.flatten import leaf_paths, path_catalog, path_catalog_pairwise
from logvault.operators.keys import encode_keys_text
from logvault.operators.normalize import normalize
from logvault.operators.project import from_pairwise
from logvault.session import configure
from logvault.sources.fixtures import event_log_lines
from logvault.sources.lines import parse_lines


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    parsed, _ = parse_lines(event_log_lines(spark, sf_dir, spread=True), "skip")
    return parsed.select("j")


def q_leaf_paths(spark, sf_dir):
    """Every typed leaf of every event."""
    df = _docs(spark, sf_dir)
    df = df.withColumn("event_id", VariantResolver(F.col("j")).integer("attr.event_id"))
    return leaf_paths(df, "j", keep=["event_id"]).select("event_id", "path", "type")


def q_leaf_paths_recursive(spark, sf_dir):
    """N04 with no depth bound (recursive CTE over variant_explode)."""
    df = _docs(spark, sf_dir)
    df = df.withColumn("event_id", VariantResolver(F.col("j")).integer("attr.event_id"))
    return leaf_paths(df, "j", keep=["event_id"], depth=None).select("event_id", "path", "type")


def q_path_catalog(spark, sf_dir):
    """Distinct path x type with row counts and the static flag."""
    return path_catalog(_docs(spark, sf_dir), "j")


def q_path_catalog_pairwise(spark, sf_dir):
    """N05 read off a pairwise archive's path arrays."""
    configure(spark)
    return path_catalog_pairwise(get_layout("pairwise").build(event_log_lines(spark, sf_dir, spread=True)))


def _encoded_leaves(spark, sf_dir, mode):
    configure(spark)
    df = event_log_lines(spark, sf_dir, spread=True)
    df = df.select(VariantResolver(F.parse_json("line")).integer("attr.event_id").alias("event_id"),
                   encode_keys_text(F.col("line"), mode).alias("j"))
    return leaf_paths(df, "j", keep=["event_id"]).select("event_id", "path", "type")


def q_encode_keys_b64(spark, sf_dir):
    """Leaves after base64-encoding keys with spaces or hyphens."""
    return _encoded_leaves(spark, sf_dir, "b64")


def q_encode_keys_hex(spark, sf_dir):
    """Leaves after hex-encoding every key."""
    return _encoded_leaves(spark, sf_dir, "hex")


def q_pairwise_lookup(spark, sf_dir):
    """N03 + N16: pairwise layout, bucket sizes and positional lookups."""
    configure(spark)
    lay = get_layout("pairwise")
    df = lay.build(event_log_lines(spark, sf_dir, spread=True))
    return df.select(
        from_pairwise("attr.event_id", "int").alias("event_id"),
        F.size("string_columns").cast("bigint").alias("n_string"),
        F.size("int_columns").cast("bigint").alias("n_int"),
        F.size("float_columns").cast("bigint").alias("n_float"),
        F.size("bool_columns").cast("bigint").alias("n_bool"),
        from_pairwise("attr.tickets", "int").alias("tickets"),
        from_pairwise("attr.value", "float").alias("value"),
        from_pairwise("msg", "string").alias("msg"),
        from_pairwise("attr.ok", "bool").alias("ok"),
    )


def q_normalize(spark, sf_dir):
    """The document-index normalisation, read back per rule."""
    df = _docs(spark, sf_dir).select(normalize(F.col("j")).alias("n"))
    r = VariantResolver(F.col("n"))
    return df.select(
        r.integer("attr.event_id").alias("event_id"),
        r.text("attr.uuid").alias("uuid"),
        r.text("attr.error.errmsg").alias("error_errmsg"),
        r.text("attr.command.command").alias("command_command"),
        r.text("attr.command.q._id._ooid").alias("command_q_id_ooid"),
        r.text("attr.command.q._id.$oid").alias("command_q_id_oid"),
        r.text("attr.writeConcern.w").alias("write_concern_w"),
        r.text("attr.query._id._ooid").alias("query_id_ooid"),
        r.text("attr.query._id.$oid").alias("query_id_oid"),
        F.schema_of_variant(r.node("attr.writeConcern.w")).alias("write_concern_w_type"),
    )


QUERIES = {
    "leaf_paths": q_leaf_paths,
    "leaf_paths_recursive": q_leaf_paths_recursive,
    "path_catalog": q_path_catalog,
    "path_catalog_pairwise": q_path_catalog_pairwise,
    "encode_keys_b64": q_encode_keys_b64,
    "encode_keys_hex": q_encode_keys_hex,
    "pairwise_lookup": q_pairwise_lookup,
    "normalize_document": q_normalize,
}


def oracles() -> dict:
    from logvault.operators.keys import encode_name
    from logvault.plans import oracle
    return {
        "leaf_paths": oracle.leaf_rows(),
        "leaf_paths_recursive": oracle.leaf_rows(),
        "path_catalog": oracle.path_catalog(),
        "path_catalog_pairwise": oracle.path_catalog(),
        "encode_keys_b64": oracle.leaf_rows(lambda k: encode_name(k, "b64")),
        "encode_keys_hex": oracle.leaf_rows(lambda k: encode_name(k, "hex")),
        "pairwise_lookup": oracle.pairwise_rows(),
        "normalize_document": oracle.normalized_rows(),
    }

"""SQL face: temporary SQL functions for searching archives with spark.sql.

Catalyst inlines SQL functions, so they plan exactly like the DataFrame
forms (``pairwise_get`` is N16).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    # JSON path over a VARIANT document (path must be a literal, as in variant_get)
    "lv_text": ("v VARIANT, p STRING", "STRING", "try_variant_get(v, p, 'string')"),
    "lv_number": ("v VARIANT, p STRING", "DOUBLE", "try_variant_get(v, p, 'double')"),
    "lv_exists": ("v VARIANT, p STRING", "BOOLEAN",
                  "coalesce(try_variant_get(v, p) IS NOT NULL AND NOT is_variant_null(try_variant_get(v, p)), false)"),
    "pairwise_get_string": ("cols ARRAY<STRING>, vals ARRAY<STRING>, p STRING", "STRING",
                            "get(vals, CAST(array_position(cols, p) AS INT) - 1)"),
    "pairwise_get_int": ("cols ARRAY<STRING>, vals ARRAY<BIGINT>, p STRING", "BIGINT",
                         "get(vals, CAST(array_position(cols, p) AS INT) - 1)"),
    "pairwise_get_float": ("cols ARRAY<STRING>, vals ARRAY<DOUBLE>, p STRING", "DOUBLE",
                           "get(vals, CAST(array_position(cols, p) AS INT) - 1)"),
    "pairwise_get_bool": ("cols ARRAY<STRING>, vals ARRAY<BOOLEAN>, p STRING", "BOOLEAN",
                          "get(vals, CAST(array_position(cols, p) AS INT) - 1)"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, (args, ret, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(SQL_FUNCTIONS)

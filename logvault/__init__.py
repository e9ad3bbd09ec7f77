"""logvault: archive and search semi-structured JSON logs with PySpark.

Pipeline: lines -> parse -> (clean keys, normalise) -> archive layout ->
search with layout-independent predicates -> counts / rows / quality checks.

Typical use::

    from logvault import get_spark, read_lines, ingest, read_archive, searches, count_hits_many, get_layout
    spark = get_spark()
    ingest(read_lines(spark, "logs/mongod/*.log"), "variant", "archive/mongod")
    df = read_archive(spark, "archive/mongod", "variant")
    count_hits_many(df, get_layout("variant"), searches("sql")).show()
"""

from logvault.layouts import LAYOUTS, get_layout
from logvault.operators import predicates
from logvault.operators.flatten import flatten_pairwise, leaf_paths, path_catalog, path_catalog_pairwise
from logvault.operators.keys import encode_keys
from logvault.operators.normalize import normalize
from logvault.operators.search import count_hits, count_hits_many, cross_check, layout_diff, search
from logvault.plans.standard import searches
from logvault.session import get_spark, scratch_path
from logvault.sinks.writers import ingest, write_layout, write_ordered, write_raw
from logvault.sources.archive import read_archive
from logvault.sources.lines import clean_lines, parse_lines, read_lines

__all__ = [
    "LAYOUTS", "get_layout", "predicates", "flatten_pairwise", "leaf_paths", "path_catalog",
    "path_catalog_pairwise", "encode_keys", "normalize", "count_hits", "count_hits_many", "cross_check",
    "layout_diff", "search", "searches", "get_spark", "scratch_path", "ingest", "write_layout",
    "write_ordered", "write_raw", "read_archive", "clean_lines", "parse_lines", "read_lines",
]

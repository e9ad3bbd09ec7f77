"""Skip files on paths that were never declared: a file index beside the archive.

``write_file_index`` describes every file of an archive in two sidecar tables:

* ``paths``: for each (file, path) the least and greatest number, the least and
  greatest text (first ``TEXT_PREFIX`` characters), one bitmap of number hashes and
  one of text hashes, and the types met;
* ``tokens``: each (path, token, file) once, sorted by path and token.

``indexed_search`` compiles a predicate to "may this file hold a match?", finds
the files by a join of these tables, and confirms the rows with the predicate
itself, so the rows are those of a full scan. What the index cannot decide
(absence, negation, inequality, containers, files written after it) is read.

Building is one scan with map-side combined aggregates; a path or token that a
third of all rows carry is one partial row a task. The bitmaps bound the index to
8 KB for each file and path, however many values a path has. Only names of files
reach the driver, as in any listing of an archive.
"""

from __future__ import annotations

import re
from dataclasses import fields
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.functions.paths import parse_path, path_text
from logvault.functions.tokens import text_tokens, tokens, wildcard_regex
from logvault.layouts import get_layout
from logvault.layouts.base import Layout
from logvault.layouts.layouts import REST, StaticDynamicLayout, VariantLayout
from logvault.operators import predicates as P
from logvault.operators.flatten import leaf_paths

TEXT_PREFIX = 64
#: Bits of one bitmap: what ``bitmap_construct_agg`` builds.
BITS = 8 * 4096
FOLDER = "_file_index"


def _place(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BITS))


def _has_bit(bits: Column, value: Column) -> Column:
    place = _place(value)
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[byte.bitwiseAND(1 << k) != 0 for k in range(8)]), (place % 8).cast("int"))


def archive_leaves(df: DataFrame, layout: Layout, keep: list[str]) -> DataFrame:
    """(keep..., path, type, value) of the leaves that the layout's VARIANT columns hold."""
    if isinstance(layout, VariantLayout):
        return leaf_paths(df, layout.column, keep=keep)
    if isinstance(layout, StaticDynamicLayout):
        inner = leaf_paths(df, layout.dynamic, keep=keep)
        dot = F.when(F.col("path").startswith("[") | (F.col("path") == ""), "").otherwise(".")
        inner = inner.withColumn("path", F.concat(F.lit(layout.dynamic), dot, F.col("path")))
        return inner.unionByName(leaf_paths(df, REST, keep=keep)) if REST in df.columns else inner
    raise ValueError("file indexes cover the layouts that keep a VARIANT: variant, document, static_dynamic")


def _index_path(archive: str, index: str | None) -> str:
    return index or f"{archive.rstrip('/')}/{FOLDER}"


def write_file_index(spark: SparkSession, archive: str, layout: Layout | str, index: str | None = None, mode: str = "overwrite") -> str:
    """Index all files of ``archive``; returns the index folder (inside the archive, where readers do not look, unless given)."""
    lay = get_layout(layout) if isinstance(layout, str) else layout
    out = _index_path(archive, index)
    df = lay.read(spark, archive).withColumn("_file", F.col("_metadata.file_path"))
    leaves = archive_leaves(df, lay, ["_file"])
    number = F.when(F.col("type") != "bool", F.col("value").try_cast("double") + F.lit(0.0))
    short = F.substring("value", 1, TEXT_PREFIX)
    paths = leaves.select("_file", "path", "type", number.alias("num"), short.alias("short"), _place(F.col("value")).alias("text_bit"),
                          F.when(number.isNotNull(), _place(number)).alias("num_bit"))
    paths = paths.groupBy(F.col("_file").alias("file"), "path").agg(
        F.count("*").alias("n"), F.min("num").alias("lo"), F.max("num").alias("hi"), F.min("short").alias("first"), F.max("short").alias("last"),
        F.bitmap_construct_agg("text_bit").alias("text_bits"), F.bitmap_construct_agg("num_bit").alias("num_bits"),
        F.collect_set("type").alias("types"))
    paths.sortWithinPartitions("path").write.mode(mode).parquet(f"{out}/paths")
    words = leaves.select("path", F.explode(F.array_distinct(tokens(F.col("value")))).alias("token"), F.col("_file").alias("file")).distinct()
    words.repartitionByRange("path", "token", "file").sortWithinPartitions("path", "token").write.mode(mode).parquet(f"{out}/tokens")
    df.groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("n_rows")).write.mode(mode).parquet(f"{out}/files")
    return out


class _Plan:
    """Collects what a predicate asks of the index, each question as one column of a table by file."""

    def __init__(self, layout: Layout):
        self.static = {path_text(p) for p, t in layout.static if t != "timestamp"} if isinstance(layout, StaticDynamicLayout) else set()
        self.paths: list[str] = []
        self.words: list[tuple[str, Column]] = []

    def covered(self, path) -> bool:
        return path_text(path) not in self.static and len(parse_path(path)) > 0

    def _path(self, path) -> int:
        p = path_text(path)
        if p not in self.paths:
            self.paths.append(p)
        return self.paths.index(p)

    def leaf(self, path) -> Column:
        return F.col(f"leaf{self._path(path)}")

    def container(self, path) -> Column:
        """Some leaf lies below the path, so its text is that of a container."""
        return F.coalesce(F.col(f"below{self._path(path)}"), F.lit(False))

    def word(self, path, test: Column) -> Column:
        self.words.append((path_text(path), test))
        return F.coalesce(F.col(f"word{len(self.words) - 1}"), F.lit(False))

    def may(self, pred: P.Pred) -> Column:
        """False only where no row of a file can match."""
        yes, no = F.lit(True), F.lit(False)
        if isinstance(pred, (P.And, P.Or)):
            parts = [self.may(x) for x in pred.preds]
            return reduce((lambda a, b: a & b) if isinstance(pred, P.And) else (lambda a, b: a | b), parts)
        if isinstance(pred, P.AtLeast):
            return reduce(lambda a, b: a + b, [self.may(x).cast("int") for x in pred.preds]) >= pred.k
        if "path" not in {f.name for f in fields(pred)} or not self.covered(pred.path):
            return yes
        if isinstance(pred, P.Eq) and P._is_num(pred.value) or isinstance(pred, P.Match) and P._is_num(pred.query):
            v = F.lit(float(pred.value if isinstance(pred, P.Eq) else pred.query)) + F.lit(0.0)
            s = self.leaf(pred.path)
            return F.coalesce((s["lo"] <= v) & (s["hi"] >= v) & _has_bit(s["num_bits"], v), no)
        if isinstance(pred, P.Cmp):
            s, v = self.leaf(pred.path), F.lit(float(pred.value))
            # a number may be rounded on its way to DOUBLE, here and in the scan alike: the ends belong to both
            return F.coalesce({"gt": s["hi"] >= v, "ge": s["hi"] >= v, "lt": s["lo"] <= v, "le": s["lo"] <= v}[pred.op], no)
        if isinstance(pred, P.Eq):
            text = ("true" if pred.value else "false") if isinstance(pred.value, bool) else pred.value
            if not isinstance(text, str) or text[:1] in ("{", "["):
                return yes  # the text of a container, which starts so, is not in the index
            s, short = self.leaf(pred.path), F.lit(text[:TEXT_PREFIX])
            return F.coalesce((s["first"] <= short) & (s["last"] >= short) & _has_bit(s["text_bits"], F.lit(text)), no)
        if isinstance(pred, (P.Prefix, P.Like)):
            head = pred.prefix if isinstance(pred, P.Prefix) else re.split(r"[%_\\]", pred.pattern, maxsplit=1)[0]
            if not head or head[0] in "{[":
                return yes
            s, head = self.leaf(pred.path), head[:TEXT_PREFIX]
            return F.coalesce((F.substring(s["first"], 1, len(head)) <= head) & (s["last"] >= head), no)
        if isinstance(pred, (P.Match, P.MatchPhrase)):
            asked = text_tokens(pred.query if isinstance(pred, P.Match) else pred.phrase)
            if not asked:
                return no
            found = [self.word(pred.path, F.col("token") == t) for t in asked]
            every = isinstance(pred, P.MatchPhrase) or pred.op == "and"
            return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), found) | self.container(pred.path)
        if isinstance(pred, P.WildcardToken):
            return self.word(pred.path, F.col("token").rlike(wildcard_regex(pred.pattern))) | self.container(pred.path)
        if isinstance(pred, P.HasBucket) and pred.bucket not in ("object", "array"):
            return F.coalesce(F.array_contains(self.leaf(pred.path)["types"], pred.bucket), no)
        return yes  # absence, inequality and empty containers leave no trace in the index


def candidate_files(spark: SparkSession, index: str, layout: Layout | str, pred: P.Pred) -> DataFrame:
    """(file, may_match) of every indexed file."""
    lay = get_layout(layout) if isinstance(layout, str) else layout
    plan = _Plan(lay)
    may = plan.may(pred)
    out = spark.read.parquet(f"{index}/files").select("file")
    if plan.paths:
        stats = spark.read.parquet(f"{index}/paths")
        below = lambda p: F.col("path").startswith(f"{p}.") | F.col("path").startswith(f"{p}[")
        used = stats.filter(reduce(lambda a, b: a | b, [(F.col("path") == p) | below(p) for p in plan.paths]))
        one = F.struct("lo", "hi", "first", "last", "text_bits", "num_bits", "types")
        out = out.join(used.groupBy("file").agg(
            *[F.max(F.when(F.col("path") == p, one)).alias(f"leaf{i}") for i, p in enumerate(plan.paths)],
            *[F.max(below(p)).alias(f"below{i}") for i, p in enumerate(plan.paths)]), "file", "left")
    if plan.words:
        asked = [(F.col("path") == p) & test for p, test in plan.words]
        hits = spark.read.parquet(f"{index}/tokens").filter(reduce(lambda a, b: a | b, asked))
        out = out.join(hits.groupBy("file").agg(*[F.max(c).alias(f"word{i}") for i, c in enumerate(asked)]), "file", "left")
    return out.select("file", may.alias("may_match"))


def _plain(name: str) -> str:
    """One spelling of a file's URI: scans and listings write ``file:/`` and ``file:///``, with or without escapes."""
    return re.sub(r"^file:/+", "/", unquote(name))


def files_to_read(spark: SparkSession, archive: str, layout: Layout | str, pred: P.Pred, index: str | None = None) -> tuple[list[str], int]:
    """(files that may hold a match or are not indexed, number of files of the archive)."""
    lay = get_layout(layout) if isinstance(layout, str) else layout
    files = lay.read(spark, archive).inputFiles()
    skip = {_plain(r["file"]) for r in candidate_files(spark, _index_path(archive, index), lay, pred).filter("not may_match").collect()}
    return [unquote(f) for f in files if _plain(f) not in skip], len(files)


def indexed_search(spark: SparkSession, archive: str, layout: Layout | str, pred: P.Pred, index: str | None = None) -> DataFrame:
    """Matching rows of an archive, reading only the files that may hold some."""
    from logvault.operators.search import search
    lay = get_layout(layout) if isinstance(layout, str) else layout
    whole = lay.read(spark, archive)
    files, _ = files_to_read(spark, archive, lay, pred, index)
    df = spark.read.schema(whole.schema).option("basePath", archive).parquet(*files) if files else whole.limit(0)
    return search(df, lay, pred)


__all__ = ["write_file_index", "candidate_files", "files_to_read", "indexed_search", "archive_leaves"]

"""Newline-delimited lines, and S06: malformed-line policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.operators.keys import encode_keys_text

BLANK_RULES = ("empty", "whitespace", "newline")


def drop_blank(lines: DataFrame, blank: str = "empty", col: str = "line") -> DataFrame:
    """Drop blank lines. The text source already removed line ends, so
    ``empty`` and ``newline`` drop the empty string; ``whitespace`` also drops
    lines of only (Unicode) whitespace, like ``str.strip()``."""
    c = F.col(col)
    if blank in ("empty", "newline"):
        return lines.filter(c != "")
    if blank == "whitespace":
        return lines.filter(~c.rlike(r"(?U)^\s*$"))
    raise ValueError(f"blank must be one of {BLANK_RULES}")


def read_lines(spark: SparkSession, path, blank: str = "empty", provenance: bool = False) -> DataFrame:
    """One event per line from one file, a directory or a glob.

    Files are listed and split in parallel by the text source (gzip parts are
    read whole, so keep compressed inputs as many files).
    """
    df = spark.read.text(path)
    if provenance:
        df = df.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file"))
    else:
        df = df.select(F.col("value").alias("line"))
    return drop_blank(df, blank)


def parse_lines(lines: DataFrame, mode: str = "skip", col: str = "line",
                out: str = "j") -> tuple[DataFrame, DataFrame]:
    """Parse JSON lines into a VARIANT under a malformed-line policy.

    Returns ``(parsed, rejected)``. ``skip``: rejected lines are dropped from
    ``parsed`` and returned; ``fail``: the first bad line raises when the
    result is computed; ``keep``: bad lines stay with a NULL document.
    """
    c = F.col(col)
    if mode == "fail":
        return lines.withColumn(out, F.parse_json(c)), lines.limit(0)
    parsed = lines.withColumn(out, F.try_parse_json(c))
    rejected = parsed.filter(F.col(out).isNull() & c.isNotNull()).drop(out)
    if mode == "keep":
        return parsed, rejected
    if mode == "skip":
        return parsed.filter(F.col(out).isNotNull()), rejected
    raise ValueError("mode must be skip, fail or keep")


def clean_lines(lines: DataFrame, keys: str = "b64", col: str = "line") -> tuple[DataFrame, DataFrame]:
    """Dataset preparation: strip-blank lines dropped, malformed lines skipped
    (and returned), keys encoded at every depth, each event written back as one
    JSON line. Of repeated keys, or keys that encode alike, the last one stays."""
    kept = drop_blank(lines.select(F.col(col).alias("line")), "whitespace")
    valid = F.try_parse_json("line").isNotNull()
    cleaned = kept.filter(valid).select(F.to_json(encode_keys_text(F.col("line"), keys)).alias("line"))
    return cleaned, kept.filter(~valid)


# Dataset variations and the key encoding each one applies.
VARIATIONS = {"normal_log": None, "cleaned_log": "b64", "base32_log": "hex"}


def dataset_variation(lines: DataFrame, variation: str = "normal_log", col: str = "line") -> DataFrame:
    """A dataset variation computed from the normal lines (no second copy on
    disk): ``cleaned_log`` base64-encodes keys with spaces or hyphens,
    ``base32_log`` hex-encodes every key; malformed lines are skipped."""
    if variation not in VARIATIONS:
        raise ValueError(f"variation must be one of {sorted(VARIATIONS)}")
    mode = VARIATIONS[variation]
    if mode is None:
        return lines.select(F.col(col).alias("line"))
    return clean_lines(lines, mode, col)[0]

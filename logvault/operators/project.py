"""Projections and path extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvault.functions import variant as V
from logvault.functions.paths import json_path, path_text


def to_event_time(text: Column, formats: tuple | list = ()) -> Column:
    """Parse a timestamp text; epoch milliseconds (13 digits) or seconds
    (10 digits, optional fraction), then ISO-8601 (with or without offset),
    then each explicit format; NULL when nothing fits (the event is kept)."""
    epoch = (F.when(text.rlike(r"^\d{13}$"), F.timestamp_millis(text.try_cast("bigint")))
             .when(text.rlike(r"^\d{10}(\.\d+)?$"),
                   F.timestamp_micros((text.try_cast("decimal(20,6)") * 1000000).cast("bigint"))))
    tries = [epoch, F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def to_event_time_ntz(text: Column) -> Column:
    """Zone-free event time (TIMESTAMP_NTZ) of a local-time text; NULL if unparsable."""
    return text.try_cast("timestamp_ntz")


def epoch_millis_ntz(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def timestamp_key(df: DataFrame, resolver, path: str, out: str = "event_time",
                  formats: tuple | list = (), zoned: bool = True) -> DataFrame:
    """Event time taken from a dotted path (parts may hold ``$``/``@``).

    ``zoned``: TIMESTAMP (offsets honoured, local texts in the session zone);
    otherwise TIMESTAMP_NTZ of the local text, independent of any zone.
    """
    text = resolver.text(path)
    return df.withColumn(out, to_event_time(text, formats) if zoned else to_event_time_ntz(text))


# Fixed value: the columns one layout projects for a search result.
EVENT_FIELDS = (("msg", "string"), ("c", "string"), ("s", "string"), ("t.$date", "string"),
                ("ctx", "string"), ("id", "bigint"), ("attr", "json"), ("tags", "json"))


def project_event(df: DataFrame, resolver, fields=EVENT_FIELDS) -> DataFrame:
    """Fixed projection of the search result (``attr`` as JSON text)."""
    cols = []
    for p, kind in fields:
        name = path_text(p).replace(".", "_").replace("$", "")
        if kind == "bigint":
            c = resolver.integer(p)
        else:
            c = resolver.text(p)
        cols.append(c.alias(name))
    return df.select(*cols)


def select_all(df: DataFrame) -> DataFrame:
    """``SELECT *``."""
    return df


def from_pairwise(path, bucket: str) -> Column:
    """Positional lookup of one path in a pairwise bucket (NULL if absent)."""
    return F.get(F.col(f"{bucket}_values"),
                 (F.array_position(F.col(f"{bucket}_columns"), path_text(path)) - 1).cast("int"))


def json_extract(line: Column, path) -> Column:
    """Sub-document (VARIANT) at ``path`` of JSON text."""
    return V.vget(F.try_parse_json(line), path)


def json_extract_scalar(line: Column, path) -> Column:
    """Scalar at ``path`` of JSON text, as text."""
    return F.get_json_object(line, json_path(path))


def cast_number(text: Column, typ: str = "bigint") -> Column:
    """Number from text; NULL instead of an error for non-numbers."""
    return text.try_cast(typ)


def _json_path_column(path: Column) -> Column:
    """JSON path of a dotted path text held in a column (see ``json_path``)."""
    steps = F.transform(F.split(path, r"\."), lambda p: F.concat(
        F.lit("['"), F.regexp_replace(F.regexp_replace(p, r"(\[\d+\])+$", ""), "'", r"\\\\'"), F.lit("']"),
        F.regexp_extract(p, r"((?:\[\d+\])*)$", 1)))
    return F.concat(F.lit("$"), F.array_join(steps, ""))


def event_time_by_dataset(df: DataFrame, catalog: DataFrame, v: str = "j", dataset_col: str = "dataset",
                          out: str = "event_time", formats: tuple | list = ()) -> DataFrame:
    """N15 + J04 for mixed datasets: each row's time key comes from its
    dataset's catalogue row (``t.$date``, ``timestamp``, ``@timestamp`` ...).

    An equi-join brings the path to the row, so any number of datasets works;
    of several keys of one dataset the largest counts. Rows of unknown datasets
    or without the key get NULL and are kept.
    """
    keys = (catalog.where(F.col("timestamp_key").isNotNull()).groupBy(F.col("dataset").alias(dataset_col))
            .agg(_json_path_column(F.max("timestamp_key")).alias("_time_path")))
    text = F.try_variant_get(F.col(v), F.col("_time_path"), "string")
    joined = df.join(keys, dataset_col, "left").withColumn(out, to_event_time(text, formats))
    return joined.select(*df.columns, out) if out not in df.columns else joined.select(*df.columns)


def epoch_to_text(seconds: Column) -> Column:
    """Epoch seconds -> ``yyyy-MM-dd HH:mm:ss`` in the session time zone (the
    run records' ``start_time`` text)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")

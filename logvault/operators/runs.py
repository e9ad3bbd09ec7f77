"""Run analytics over recorded resource samples: T01, T03, J01-J04, A06-A09.

Samples are ``ps aux`` text lines recorded per run at polling times. All
joins are equi-joins without hints that Spark plans itself: on ``run_id``, on
prefixes of process names, or on bins of time (AQE splits a hot key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


KB = 1024
# The six golden hit counts of the reference's standard searches.
GOLDEN_COUNTS = [38611, 336293, 1, 122, 52421, 38611]


def parse_ps(df: DataFrame, col: str = "ps_line") -> DataFrame:
    """``ps aux`` line -> ``command`` (field 11), ``rss_bytes`` (field 6 x 1024).

    Lines with fewer than 11 fields or a non-numeric RSS (the header) are dropped.
    """
    f = F.split(F.trim(F.col(col)), r"\s+")
    rss = F.get(f, 5).try_cast("bigint")
    out = df.withColumn("command", F.get(f, 10)).withColumn("rss_bytes", rss * KB)
    return out.filter((F.size(f) >= 11) & rss.isNotNull()).drop(col)


def related_samples(samples: DataFrame, related: DataFrame, tool: str | None = None) -> DataFrame:
    """Keep a sample if some configured process name starts with its
    command; a sample counts once however many names match (left semi join).
    The prefixes of every configured name, the empty one included, make it a
    hash semi join: no sample meets every name, whatever the two sides' sizes."""
    rp = related if tool is None else related.filter(F.col("tool") == tool)
    prefixes = rp.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("name")),
                                               lambda n: F.substr("name", F.lit(1), n))).alias("command")).distinct()
    return samples.join(prefixes, "command", "left_semi").select(*samples.columns)


def sample_grid(ts: Column, interval: str) -> Column:
    """Polling time aligned down to a multiple of ``interval``."""
    return F.window(ts, interval)["start"]


def sample_total(samples: DataFrame, interval: str, ts: str = "ts") -> DataFrame:
    """Per run and polling time, total RSS of the related processes."""
    return (samples.groupBy("run_id", sample_grid(F.col(ts), interval).alias("sample_ts"))
            .agg(F.sum("rss_bytes").alias("total_rss_bytes")))


def assign_samples(samples: DataFrame, runs: DataFrame, ts: str = "ts") -> DataFrame:
    """A sample belongs to its run while the run is active
    (equi-join on ``run_id`` plus ``start <= ts <= end``)."""
    r = runs.select("run_id", F.col("start").alias("_start"), F.col("end").alias("_end"))
    return (samples.join(r, "run_id")
            .filter((F.col(ts) >= F.col("_start")) & (F.col(ts) <= F.col("_end")))
            .drop("_start", "_end"))


def _micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP or TIMESTAMP_NTZ column, in its own reading."""
    kind = df.schema[col].dataType.simpleString()
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(kind), F.col(f"`{col}`"))


def assign_by_time(samples: DataFrame, runs: DataFrame, ts: str = "ts", run_id: str = "run_id",
                   start: str = "start", end: str = "end", totals: dict | None = None) -> DataFrame:
    """J02 by time alone: each sample with every run that was active at its time
    (``start <= ts <= end``), as the sample's columns and ``run_id``.

    A binned interval join: time is cut into bins as long as the mean run, each
    run stands in the bins it touches (a long run is split over many) and samples
    meet runs of their bin only, in an equi-join that AQE splits where a bin is
    hot. The runs grow to two rows each on average and one more, whatever their
    lengths. Runs without a start or an end and those that end before they start
    take no sample; a sample outside all runs is left out; equal runs each count.

    Where many runs overlap, the pairs grow with samples times runs. ``totals``
    (name -> whole number of a sample; null counts as 0) asks for sums only: one row for each run that
    met a sample, with ``run_id`` and these sums, from running totals in the order of time
    instead of pairs.
    """
    r = runs.select(F.col(f"`{run_id}`").alias("_run"), _micros(runs, start).alias("_from"), _micros(runs, end).alias("_to")).filter("_from <= _to")
    if totals is not None:
        return _totals_by_time(samples.withColumn("_at", _micros(samples, ts)), r, totals).withColumnRenamed("_run", run_id)
    width = max(1, int(r.agg(F.avg(F.col("_to") - F.col("_from"))).first()[0] or 0))
    bin_of = lambda micros: F.floor(micros / F.lit(width))
    binned = r.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_from")), bin_of(F.col("_to")))))
    at = samples.withColumn("_at", _micros(samples, ts)).withColumn("_bin", bin_of(F.col("_at")))
    met = at.join(binned, "_bin").filter((F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("_to")))
    keep = [F.col(f"`{c}`") for c in samples.columns if c != run_id]
    return met.select(*keep, F.col("_run").alias(run_id))


#: Bins of time with about equally many samples, in each of which one task adds up.
TIME_BINS = 256
WIDE = "decimal(38,0)"  # a total over all samples may pass 64 bits where no run's does


def _bin_of(at: Column, bounds: list, first: int = 0) -> Column:
    """Number of ``bounds`` (sorted) not above ``at``, by halving."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(at < bounds[mid], _bin_of(at, bounds[:mid], first)).otherwise(_bin_of(at, bounds[mid + 1:], first + mid + 1))


def _totals_by_time(samples: DataFrame, r: DataFrame, totals: dict) -> DataFrame:
    """(_run, totals...) of the runs (_run, _from, _to) that met samples: the running
    total up to the run's end, less that before its start. Samples of one time
    are added up first and ends of runs at one time asked once, so no time is hot."""
    names = ["_met", *totals]
    values = [F.lit(1).alias("_met"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in totals.items()]]
    at = samples.filter("_at IS NOT NULL").select("_at", *values).groupBy("_at").agg(*[F.sum(F.col(n).cast(WIDE)).cast(WIDE).alias(n) for n in names])
    cuts = at.agg(F.percentile_approx("_at", [k / TIME_BINS for k in range(1, TIME_BINS)])).first()[0] or []
    bins = _bin_of(F.col("_at"), sorted(set(cuts)))
    # at one time: starts (0) come before samples (1), ends (2) after them
    none = [F.lit(0).cast(WIDE).alias(n) for n in names]
    ends = r.select(F.explode(F.array(F.struct(F.col("_from").alias("_at"), F.lit(0).alias("_kind")),
                                      F.struct(F.col("_to").alias("_at"), F.lit(2).alias("_kind")))).alias("e")).select("e.*").distinct()
    points = at.withColumn("_kind", F.lit(1)).unionByName(ends.select("_at", "_kind", *none)).withColumn("_bin", bins)
    earlier = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bin
    before = (at.groupBy(bins.alias("_bin")).agg(*[F.sum(n).cast(WIDE).alias(n) for n in names])
              .unionByName(ends.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_bin"), *none))
              .groupBy("_bin").agg(*[F.sum(n).cast(WIDE).alias(n) for n in names])
              .select("_bin", *[F.coalesce(F.sum(n).over(earlier).cast(WIDE), F.lit(0).cast(WIDE)).alias(f"_before_{n}") for n in names]))
    within = Window.partitionBy("_bin").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = points.select("_bin", "_at", "_kind", *[F.sum(n).over(within).cast(WIDE).alias(n) for n in names]).filter("_kind <> 1")
    asked = added.join(before, "_bin").select("_at", "_kind", *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in names])

    def side(kind, key, tag):
        return asked.filter(F.col("_kind") == kind).select(F.col("_at").alias(key), *[F.col(n).alias(f"{tag}{n}") for n in names])

    out = r.join(side(0, "_from", "_lo_"), "_from").join(side(2, "_to", "_hi_"), "_to")
    sums = [(F.col(f"_hi_{n}") - F.col(f"_lo_{n}")).cast("bigint").alias(n) for n in names]
    return out.select("_run", *sums).filter("_met > 0").drop("_met")


def run_memory_avg(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """Mean total RSS per run; -1 when the run has no sample."""
    m = totals.groupBy("run_id").agg(F.avg("total_rss_bytes").alias("_m"))
    return (runs.join(m, "run_id", "left")
            .withColumn("memory_average_B", F.coalesce(F.col("_m"), F.lit(-1.0))).drop("_m"))


def run_latency(runs: DataFrame) -> DataFrame:
    """``end - start`` in seconds (zone-free for TIMESTAMP_NTZ)."""
    return runs.withColumn("time_taken_s",
                           F.expr("timestampdiff(MICROSECOND, start, `end`)") / F.lit(1_000_000.0))


def golden_check(results: DataFrame, golden: DataFrame) -> DataFrame:
    """Result per query index vs the expected count (bounded table)."""
    return (results.join(golden, "query_ind", "left")
            .withColumn("ok", F.coalesce(F.col("result") == F.col("expected"), F.lit(False))))


def golden_frame(spark, counts=GOLDEN_COUNTS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(counts)), "query_ind int, expected bigint")

"""Overlapping and gapped time intervals: continuous periods and the gaps between them.

Two levels: every interval is clipped into time shards of fixed width and merged within its shard, so that even an
entity with a third of all rows is spread over as many tasks as it has shards; the runs that
remain (at most one per two days of calendar, however many rows there were) are then stitched across the shard
boundaries, coalesced, and the gaps read off between neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRACKS = {"planned": ("planned_start", "planned_end"), "actual": ("actual_start", "actual_end")}
SHARD_DAYS = 64


def task_intervals(tasks: DataFrame) -> DataFrame:
    """Entity, track and day numbers (first, last; both included) of the usable intervals of task_schedule.

    Rows without work_package, without either date or with the end before the start are left out.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    each = F.array(*(F.struct(F.lit(t).alias("track"), day(a).alias("first"), day(b).alias("last")) for t, (a, b) in TRACKS.items()))
    return tasks.select("work_package", F.explode(each).alias("i")).select("work_package", "i.*").where("work_package is not null and first is not null and last is not null and first <= last")


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Coalesce intervals (first, last) that overlap or adjoin, within ``keys``."""
    w = Window.partitionBy(*keys).orderBy("first", "last")
    seen = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("opens", F.when(seen.isNull() | (F.col("first") > seen + 1), 1).otherwise(0))
    return marked.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def periods(intervals: DataFrame, keys: list[str], shard_days: int = SHARD_DAYS) -> DataFrame:
    """Continuous periods (first, last) per ``keys``: longest runs of covered days.

    Repeated, nested and tied intervals change nothing; intervals on adjoining days form one run. Empty in, empty out.
    """
    shard = lambda c: F.floor(F.col(c) / shard_days)
    # distinct first: repeated rows vanish before they are clipped, with map-side combine
    clipped = (
        intervals.select(*keys, "first", "last")
        .groupBy(*keys, "first")
        .agg(F.max("last").alias("last"))
        .withColumn("shard", F.explode(F.sequence(shard("first"), shard("last"))))
        .withColumn("first", F.greatest(F.col("first"), (F.col("shard") * shard_days).cast("int")))
        .withColumn("last", F.least(F.col("last"), ((F.col("shard") + 1) * shard_days - 1).cast("int")))
    )
    return _merge(_merge(clipped, [*keys, "shard"]).drop("shard"), keys)


def periods_and_gaps(intervals: DataFrame, keys: list[str], shard_days: int = SHARD_DAYS) -> DataFrame:
    """Rows of kind ``period`` and ``gap`` with first and last day number; a gap lies between two consecutive periods."""
    w = Window.partitionBy(*keys).orderBy("first")
    runs = periods(intervals, keys, shard_days).withColumn("before", F.lag("last").over(w))
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("first").alias("a"), F.col("last").alias("b")),
        F.struct(F.lit("gap").alias("kind"), (F.col("before") + 1).alias("a"), (F.col("first") - 1).alias("b")),
    )
    return runs.select(*keys, F.explode(both).alias("x")).where("x.a is not null").select(*keys, "x.kind", F.col("x.a").alias("first"), F.col("x.b").alias("last"))


def task_periods(tasks: DataFrame) -> DataFrame:
    """Periods and gaps of planned and actual work per work_package, days as YYYY-MM-DD."""
    text = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    out = periods_and_gaps(task_intervals(tasks), ["work_package", "track"])
    return out.select("work_package", "track", "kind", text("first").alias("first_day"), text("last").alias("last_day"))


def coverage(tasks: DataFrame) -> DataFrame:
    """Per work_package and track: number of periods and gaps, days covered and days open between them."""
    days = F.col("last") - F.col("first") + 1
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0)).cast("long")
    return (
        periods_and_gaps(task_intervals(tasks), ["work_package", "track"])
        .groupBy("work_package", "track")
        .agg(of("period", F.lit(1)).alias("n_periods"), of("gap", F.lit(1)).alias("n_gaps"), of("period", days).alias("days_covered"), of("gap", days).alias("days_open"))
    )

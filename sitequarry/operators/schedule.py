"""Progress and cost of projects, set-based: every project in one job, every child table aggregated before it is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int) -> Column:
    """a / b as double, rounded; null where b is null or 0."""
    return F.when(b != 0, F.round(a.cast("double") / b.cast("double"), digits))


def with_task_metrics(tasks: DataFrame) -> DataFrame:
    """variance (actual - planned progress) and spi (actual / planned, 3 digits); null where an input is null or the plan 0."""
    return tasks.select("*", (F.col("actual_progress") - F.col("planned_progress")).cast("double").alias("variance"), ratio(F.col("actual_progress"), F.col("planned_progress"), 3).alias("spi"))


def progress(tasks: DataFrame) -> DataFrame:
    """Per project: tasks by status, sums of progress, spi of the sums and mean of the spis. Wholly repeated rows count once; a null status is 'unknown'."""
    t = with_task_metrics(tasks.distinct())
    planned, actual = (F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in ("planned_progress", "actual_progress"))
    per = t.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(F.col("status") == "completed").alias("n_completed"),
        F.count_if(F.col("status") == "delayed").alias("n_delayed"),
        F.count_if(F.col("status").isNull()).alias("n_unknown"),
        F.count_if("is_critical_path").alias("n_critical"),
        planned.alias("sum_planned"),
        actual.alias("sum_actual"),
        F.round(F.avg("spi"), 9).alias("mean_spi"),
    )
    return per.withColumn("overall_spi", ratio(F.col("sum_actual"), F.col("sum_planned"), 3))


def status_pivot(tasks: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Tasks per project and status as columns, 0 where there are none."""
    return tasks.distinct().groupBy("project_id").pivot("status", list(statuses)).agg(F.count(F.lit(1))).fillna(0, list(statuses))


def slipped(tasks: DataFrame, k: int) -> DataFrame:
    """The ``k`` tasks of each project with the largest negative variance, ties by task_id."""
    w = Window.partitionBy("project_id").orderBy("variance", "task_id")
    t = with_task_metrics(tasks.distinct()).where("variance < 0")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("project_id", "task_id", "variance", "spi", "rank")


def costs(lines: DataFrame) -> DataFrame:
    """project_id and category: planned and actual sums, variance, rate and number of lines; nulls count as 0."""
    per = lines.groupBy("project_id", "category").agg(F.coalesce(F.sum("planned"), F.lit(0)).alias("p"), F.coalesce(F.sum("actual"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("n_lines"))
    gap = F.col("a") - F.col("p")
    return per.select("project_id", "category", F.col("p").cast("double").alias("planned_sum"), F.col("a").cast("double").alias("actual_sum"), gap.cast("double").alias("variance"), ratio(gap, F.col("p"), 6).alias("variance_rate"), "n_lines")


def monthly(lines: DataFrame, day: str, value: str, keys: list[str]) -> DataFrame:
    """Per keys and month: sum, number, running sum and growth against the month before (null for the first)."""
    per = lines.groupBy(*keys, F.date_format(day, "yyyy-MM").alias("month")).agg(F.sum(value).alias("sum"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("month")
    before = F.lag("sum").over(w)
    return per.select(*keys, "month", F.col("sum").cast("double").alias("total"), "n", F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("running"), ratio(F.col("sum") - before, before, 6).alias("growth"))


def first_last(months: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: value of the first and of the last month, and how many months there are."""
    return months.groupBy(*keys).agg(F.min_by("total", "month").alias("first_total"), F.max_by("total", "month").alias("last_total"), F.count(F.lit(1)).alias("n_months"))


def peers(per_project: DataFrame, group: str, value: str) -> DataFrame:
    """Each project against the mean of the others of its group, by window sums instead of a self-join; null where it is alone."""
    w = Window.partitionBy(group)
    n, total = F.count(value).over(w), F.sum(value).over(w)
    return per_project.select("project_id", group, value, F.when((n > 1) & F.col(value).isNotNull(), F.round((total - F.col(value)) / (n - 1), 4)).alias("peer_mean"))


def dashboard(projects: DataFrame, tasks: DataFrame, drawings: DataFrame) -> DataFrame:
    """One row per project: its progress and its drawings, each side aggregated once and joined on the project; missing sides count 0."""
    d = drawings.where("deleted_at is null").groupBy("project_id").agg(F.count(F.lit(1)).alias("n_drawings"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("n_pages"))
    p = progress(tasks).select("project_id", "n_tasks", "n_completed", "n_delayed", "overall_spi")
    out = projects.select("project_id", "project_name", "project_type").join(p, "project_id", "left").join(d, "project_id", "left")
    return out.fillna(0, ["n_tasks", "n_completed", "n_delayed", "n_drawings", "n_pages"])

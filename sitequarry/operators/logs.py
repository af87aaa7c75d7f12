"""Filters, statistics and table maintenance: logs, documents, events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(df: DataFrame, equal: dict | None = None, between: dict[str, tuple] | None = None, contains: dict[str, str] | None = None, within: dict[str, list] | None = None) -> DataFrame:
    """Rows that meet all the predicates given; a value of None is no predicate. Text search is literal and in any of the columns."""
    for c, v in (equal or {}).items():
        df = df if v is None else df.where(F.col(c) == v)
    for c, (low, high) in (between or {}).items():
        df = df if low is None else df.where(F.col(c) >= low)
        df = df if high is None else df.where(F.col(c) <= high)
    for c, v in (within or {}).items():
        df = df.where(F.col(c).isin(v))
    if contains:
        df = df.where(reduce(Column.__or__, (F.coalesce(F.col(c).contains(v), F.lit(False)) for c, v in contains.items())))
    return df


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of a totally ordered result; ``order`` must end in a key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def zero_filled(counts: DataFrame, key: str, domain: DataFrame) -> DataFrame:
    """Counts with a row of 0 for every value of the domain that has none."""
    return domain.join(counts, key, "left").fillna(0)


def query_stats(log: DataFrame, by: str) -> DataFrame:
    """Per ``by`` and in all (``by`` null, grouped 1): rows, errors, means, 95 % point; one pass through grouping sets."""
    return log.rollup(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.round(F.avg("value"), 4).alias("avg_value"),
        F.round(F.expr("percentile(value, 0.95)"), 4).alias("p95_value"), F.countDistinct("user_id").alias("n_users"), F.grouping(by).cast("int").alias("grouped"),
    )


def daily(log: DataFrame) -> DataFrame:
    """Per day: rows, mean value, and the seven-day mean of the counts."""
    per = log.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))
    w = Window.orderBy("day").rowsBetween(-6, 0)  # one row per day by now
    return per.withColumn("n_week_mean", F.round(F.avg("n").over(w), 4))


def hot(log: DataFrame, key: Column, k: int) -> DataFrame:
    """The ``k`` most frequent keys with their counts, ties by key; counted with map-side combine, then a top-k without a full sort."""
    return log.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(k)


def recent(log: DataFrame, user: str, ts: str, tie: str, k: int) -> DataFrame:
    """The last ``k`` rows of every user with their rank, latest first."""
    w = Window.partitionBy(user).orderBy(F.desc(ts), F.desc(tie))
    return log.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; a null in ``new`` keeps the old value. The last row of a key in either side should be the only one."""
    n = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in old.columns if c != key])
    j = old.join(n, old[key] == n["_k"], "full")
    return j.select(F.coalesce(key, "_k").alias(key), *[F.coalesce(f"_{c}", c).alias(c) for c in old.columns if c != key])


def deleted(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows of the keys; null keys delete nothing."""
    return old.join(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def alive(kv: DataFrame, key: str, ts: str, ttl: Column, as_of: Column) -> DataFrame:
    """The latest row of each key if it has not expired at ``as_of``; the latest is found by aggregation, not by sorting."""
    rest = F.struct(*[c for c in kv.columns if c != key])
    last = kv.where(F.col(ts) <= as_of).groupBy(key).agg(F.max_by(rest, F.struct(ts, *[c for c in kv.columns if c not in (key, ts)])).alias("r")).select(key, "r.*")
    return last.where(F.col(ts) + ttl > as_of)


def sessions(log: DataFrame, gap: str) -> DataFrame:
    """Per user: runs of events with less than ``gap`` between them: first and last time, number, sum."""
    return log.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).drop("w")


def row_security(docs: DataFrame, roles: DataFrame, grants: dict[str, tuple[str, ...]]) -> DataFrame:
    """user_id and number of documents each user may see, by the permission levels of their role; the grants are a small fixed table."""
    g = docs.sparkSession.createDataFrame([(r, x) for r, xs in grants.items() for x in xs], "role string, permission_level string")
    per_level = docs.groupBy("permission_level").agg(F.count(F.lit(1)).alias("n"))
    allowed = g.join(per_level, "permission_level").groupBy("role").agg(F.sum("n").alias("n_docs"))
    return roles.join(F.broadcast(allowed), "role", "left").select("user_id", "role", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))

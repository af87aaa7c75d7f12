"""Queries that run as streams to the end of what is there, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitequarry.sources.tables import table
from sitequarry.streaming import events as E


def events(s, d):
    return E.stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


QUERIES = {
    "op_st_daily": lambda s, d: E.drained(E.daily(events(s, d)), "complete"),
    "op_ext_sliding": lambda s, d: E.drained(E.sliding(events(s, d)), "complete").withColumn("starts", F.col("starts").cast("timestamp_ntz")),
    "op_st_dedup": lambda s, d: E.drained(E.first_seen(events(s, d), "user_id", "ts").select("user_id")),
    "op_st_rate": lambda s, d: E.rate_limited(table(s, d, "events"), 5, 86400),
}

SQL = {
    "op_st_daily": "select cast(ts as date) as day, count(*) as n, round(avg(value), 4) as avg_value from events group by 1",
    "op_ext_sliding": """select starts, event_type, count(*) as n from (select event_type, time_bucket(interval 3 hour, ts) - i * interval 3 hour as starts from events, (values (0), (1)) x(i)) group by all""",
    "op_st_dedup": "select distinct user_id from events",
}

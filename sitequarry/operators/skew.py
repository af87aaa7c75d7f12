"""Joins that spread hot keys over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of all rows; there can be 1 / HOT of them at most, so that they may be broadcast.
HOT = 0.001
SALTS = 32


def hot_keys(counts: DataFrame, key: str, n: str = "n", share: float = HOT) -> DataFrame:
    """The keys of ``counts`` (one row a key, its rows in ``n``) that hold more than ``share`` of all rows."""
    total = F.broadcast(counts.agg(F.sum(n).alias("_total")))  # one row
    return counts.join(total).where(F.col(n) > share * F.col("_total")).select(key)


def spread_join(many: DataFrame, few: DataFrame, key: str, hot: DataFrame, spread: str, salts: int = SALTS) -> DataFrame:
    """Inner join on ``key`` in which the rows of hot keys in ``many`` are spread by the hash of column ``spread``, and those in ``few`` repeated.

    A null key matches nothing. ``hot`` comes from ``hot_keys``, and is small by arithmetic.
    """
    marked = F.broadcast(hot.select(F.col(key).alias("_k"), F.lit(True).alias("_hot")))
    many = many.join(marked, F.col(key) == F.col("_k"), "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_k", "_hot")
    few = few.join(marked, F.col(key) == F.col("_k"), "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_k", "_hot")
    return many.join(few, [key, "_salt"]).drop("_salt")

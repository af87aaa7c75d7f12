"""Counting words over whole corpora, and the texts of several tables as one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = batch.column(0).flatten().value_counts()
        yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], ["word", "n"])


def counts(texts: DataFrame, words: Column) -> DataFrame:
    """word and n over all rows of an array-of-strings column; counted per batch first, so the shuffle carries few rows."""
    return texts.select(words.alias("w")).where("size(w) > 0").mapInArrow(_count_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gathered(*tables: tuple[str, DataFrame, str, str | None]) -> DataFrame:
    """src_table, row_id, file_id and text of (name, table, text column, column of the file) each."""
    parts = (t.select(F.lit(n).alias("src_table"), F.col("id").alias("row_id"), (F.col(f).cast("string") if f else F.lit(None).cast("string")).alias("file_id"), F.col(c).alias("text")) for n, t, c, f in tables)
    return reduce(DataFrame.unionByName, parts)

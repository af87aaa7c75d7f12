"""Splitting of texts into chunks with offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where a text is parted, from the strongest mark to the weakest; signs are the last resort.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ".", "!", "?", ";", " ")
HEADING = re.compile(r"第[一二三四五六七八九十百千\d]+[章节条]|\d+[.\s]|[一二三四五六七八九十]+[.、]")


def fixed(docs: DataFrame, size: int = 500, overlap: int = 50, text: str = "text", whole_steps_only: bool = False) -> DataFrame:
    """doc_id, chunk_index, total_chunks, start_char, end_char, content: windows of ``size`` every ``size - overlap`` characters.

    ``whole_steps_only`` leaves out windows that start less than a step before the end (but for the first). Null and empty texts give no chunk.
    """
    step = size - overlap
    length = F.length(text)
    last = F.greatest(length - (step if whole_steps_only else 1), F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(step))
    each = docs.where(length > 0).select("doc_id", text, F.size(starts).alias("total_chunks"), F.posexplode(starts).alias("chunk_index", "start_char"))
    return each.select(
        "doc_id", "chunk_index", "total_chunks", "start_char", F.least(F.col("start_char") + size, F.length(text)).alias("end_char"),
        F.substring(F.col(text), F.col("start_char") + 1, F.lit(size)).alias("content"),
    )


def sentences(docs: DataFrame, size: int = 400, text: str = "text") -> DataFrame:
    """Chunks that end at sentence ends: doc_id, chunk_index, n_sentences, content.

    A sentence opens a new chunk where the running length passes a multiple of ``size``; longer sentences stand alone. Null and
    blank texts give none.
    """
    parts = F.filter(F.split(F.col(text), r"(?<=[。！？!?；;])|(?<=\.)\s+|\n+"), lambda x: F.trim(x) != "")
    # the sentences before each one are summed by a window within the text
    each = docs.select("doc_id", F.posexplode(parts).alias("i", "s"))
    before = F.coalesce(F.sum(F.length("s")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        each.withColumn("bin", F.floor(before / size))
        .groupBy("doc_id", "bin")
        .agg(F.count(F.lit(1)).alias("n_sentences"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda y: y["s"]), "").alias("content"))
        .selectExpr("doc_id", "cast(bin as int) as chunk_index", "n_sentences", "content")
    )


def pieces(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """A text in pieces of at most ``size`` characters that together are the text, parted at the strongest separators that serve."""
    if len(text) <= size:
        return [text] if text else []
    if not separators:
        return [text[i : i + size] for i in range(0, len(text), size)]
    mark, *weaker = separators
    out: list[str] = []
    for part in re.split(f"(?<={re.escape(mark)})", text):
        if out and len(out[-1]) + len(part) <= size:
            out[-1] += part
        else:
            out += pieces(part, size, tuple(weaker))
    return out


def _by_row(docs: DataFrame, text: str, cut: Callable[[str], list[tuple[int, str]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, start, content) for d, t in zip(batch["doc_id"], batch["t"]) for k, (start, content) in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start_char", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("t")).where("t <> ''").mapInPandas(run, f"doc_id {kind}, chunk_index int, start_char int, content string")


def recursive(docs: DataFrame, size: int = 500, overlap: int = 50, text: str = "text") -> DataFrame:
    """doc_id, chunk_index, start_char, content: chunks parted at paragraphs if they fit, else at lines, sentences, words and at last anywhere.

    A chunk repeats the last ``overlap`` characters of the one before, so it has ``size`` at most; without those the chunks are the text. Null and
    empty texts give none.
    """

    def cut(t: str) -> list[tuple[int, str]]:
        out, at = [], 0
        for piece in pieces(t, size - overlap):
            start = max(0, at - overlap)
            out.append((start, t[start : at + len(piece)]))
            at += len(piece)
        return out

    return _by_row(docs, text, cut)


def semantic(docs: DataFrame, size: int = 500, text: str = "text") -> DataFrame:
    """doc_id, chunk_index, start_char, content: whole paragraphs, gathered until a heading follows or they pass twice ``size``.

    Paragraphs are parted by blank lines and never cut. Null and blank texts give none.
    """

    def cut(t: str) -> list[tuple[int, str]]:
        groups: list[list[re.Match]] = []
        for m in re.finditer(r"\S(?:.*?\S)?(?=\s*(?:\n\n|\Z))", t, re.DOTALL):
            full = groups and groups[-1][-1].end() - groups[-1][0].start() > 2 * size
            if not groups or full or HEADING.match(m[0]) or (m[0].isupper() and len(m[0]) < 30):
                groups.append([])
            groups[-1].append(m)
        return [(g[0].start(), "\n\n".join(m[0] for m in g)) for g in groups]

    return _by_row(docs, text, cut)

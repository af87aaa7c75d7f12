"""Documents from files: dispatch by extension, decoding with fallbacks, hooks for parsers that are not part of Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which parser an extension goes to.
KINDS = {"pdf": "pdf", "docx": "word", "doc": "word", "jpg": "image", "jpeg": "image", "png": "image", "bmp": "image", "tiff": "image", "txt": "text", "md": "text"}
ENCODINGS = ("utf-8", "gbk", "latin-1")


def manifest(spark: SparkSession, folder: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path, name, extension, kind (null where no parser takes it), size and modified of every file; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[extension]
    return reader.load(folder).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), extension.alias("extension"), kind.alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def decode(data: bytes) -> tuple[str | None, str | None]:
    """Text and the first encoding that can read it."""
    for e in ENCODINGS:
        try:
            return data.decode(e), e
        except UnicodeDecodeError:
            pass
    return None, None


def load(spark: SparkSession, folder: str, parsers: dict[str, Callable[[bytes], str]] | None = None, recursive: bool = True) -> DataFrame:
    """path, kind, text, encoding and error of every file. Texts are decoded here; for other kinds a parser from bytes to text may be given.

    A file that fails, or that no parser takes, has an error instead of a text; the others go on.
    """
    known = parsers or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"]):
                text = encoding = error = None
                try:
                    if kind == "text":
                        text, encoding = decode(content)
                    elif kind in known:
                        text = known[kind](content)
                    else:
                        error = "unsupported" if kind is None else f"no parser for {kind}"
                except Exception as e:  # noqa: BLE001 - one bad file must not stop the others
                    error = str(e)[:200]
                rows.append((path, kind, text, encoding, error))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "encoding", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[extension]
    return files.select("path", kind.alias("kind"), "content").mapInPandas(run, "path string, kind string, text string, encoding string, error string")


def is_scanned(text, pages):
    """Whether a parsed file is a scan: blank, or fewer than a hundred characters a page."""
    return (F.trim(F.coalesce(text, F.lit(""))) == "") | (F.length(text) / F.greatest(pages, F.lit(1)) < 100)

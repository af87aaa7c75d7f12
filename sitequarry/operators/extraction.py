"""Entities named in engineering texts, and the relations between those of one document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns by type, the earlier type taking a code that several match.
COMPONENTS = {
    "beam": (r"(?i)[KDL]+[A-Z]*[-\s]?\d+[a-zA-Z]?", r"(?i)WKL[-\s]?\d+", r"(?i)JKL[-\s]?\d+"),
    "column": (r"(?i)[KZ]+[A-Z]*[-\s]?\d+[a-zA-Z]?", r"(?i)GZ[-\s]?\d+", r"(?i)AZ[-\s]?\d+"),
    "slab": (r"(?i)[LB]+[-\s]?\d+[a-zA-Z]?", r"(?i)YB[-\s]?\d+"),
    "wall": (r"(?i)[QZ]+[-\s]?\d+[a-zA-Z]?", r"(?i)Q[-\s]?\d+"),
    "foundation": (r"(?i)[DJ]+[-\s]?\d+[a-zA-Z]?", r"(?i)JC[-\s]?\d+", r"(?i)ZJ[-\s]?\d+"),
    "stair": (r"(?i)LT[-\s]?\d+",),
}
MATERIALS = {"concrete": (r"C\d{2,3}", r"LC\d{2}"), "rebar": (r"HRB\d{3}[E]?", r"HPB\d{3}", r"HRBF\d{3}"), "steel": (r"Q\d{3}[A-Z]?",)}
SPECS = {"spec": (r"GB\s*\d{4,6}[-–]\d{4}", r"GB/T\s*\d{4,6}[-–]\d{4}", r"JGJ\s*\d{2,4}[-–]\d{4}", r"JG\s*\d{2,4}[-–]\d{4}", r"DBJ\s*\d{2}[-–]\d{2,4}[-–]\d{4}")}
SECTION = r"(\d+)\s*[×xX]\s*(\d+)"
DIMENSIONS = (
    ("thickness", r"厚[度]?\s*[:：]?\s*(\d+)(?:mm)?"),
    ("height", r"高[度]?\s*[:：]?\s*(\d+)(?:mm)?"),
    ("width", r"宽[度]?\s*[:：]?\s*(\d+)(?:mm)?"),
    ("span", r"跨[度]?\s*[:：]?\s*(\d+)(?:mm|m)?"),
    ("spacing", r"间距\s*[:：]?\s*(\d+)(?:mm)?"),
    ("spacing", r"@(\d+)"),
)
# What a type of component is made of, and which dimensions apply to it.
USES = {
    "beam": ("concrete", "rebar"),
    "column": ("concrete", "rebar"),
    "slab": ("concrete", "rebar"),
    "wall": ("concrete", "rebar"),
    "foundation": ("concrete", "rebar"),
    "shear_wall": ("concrete", "rebar"),
    "steel_beam": ("steel",),
    "steel_column": ("steel",),
}
HAS = {
    "beam": ("section", "span", "height", "width"),
    "column": ("section", "height"),
    "slab": ("thickness", "span"),
    "wall": ("thickness", "height", "length"),
    "foundation": ("thickness", "width", "length"),
}


def _hits(text: Column, kinds: dict[str, tuple[str, ...]]) -> Column:
    def hits(n: int, kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(n).alias("ord"), F.lit(kind).alias("kind"), F.upper(x).alias("code")))

    parts = [hits(n, kind, p) for n, (kind, ps) in enumerate(kinds.items()) for p in ps]
    return F.coalesce(F.concat(*parts), F.array().cast("array<struct<ord:int,kind:string,code:string>>"))


def entities(docs: DataFrame, kinds: dict[str, tuple[str, ...]], text: str = "text") -> DataFrame:
    """doc_id, kind, code and mentions: every code once per document, under the earliest type that matches it. Null texts have none."""
    found = docs.select("doc_id", F.explode(_hits(F.col(text), kinds)).alias("h")).select("doc_id", "h.*")
    per = found.groupBy("doc_id", "code").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("mentions"))
    name = reduce(lambda c, x: c.when(F.col("ord") == x[0], x[1]), enumerate(kinds), F.when(F.lit(False), ""))
    return per.select("doc_id", name.alias("kind"), "code", "mentions")


def dimensions(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, kind, value: all dimensions, a section as WxH; repeated ones each. Null texts have none."""
    t = F.col(text)
    section = F.transform(F.regexp_extract_all(t, F.lit(SECTION), F.lit(0)), lambda x: F.struct(F.lit("section").alias("kind"), F.concat_ws("x", F.regexp_extract(x, SECTION, 1), F.regexp_extract(x, SECTION, 2)).alias("value")))

    def one(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    others = [one(k, p) for k, p in DIMENSIONS]
    return docs.where(t.isNotNull()).select("doc_id", F.explode(F.concat(section, *others)).alias("h")).select("doc_id", "h.*")


def first_number(value: Column) -> Column:
    """The first figure of a dimension; 0 where there is none."""
    return F.coalesce(F.regexp_extract(value, r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def relations(docs: DataFrame) -> DataFrame:
    """doc_id, src, dst, rel_type, confidence: components with the materials and dimensions that apply to their type, in one document.

    The rules are a small table, so that the predicate on types is an equi-join.
    """
    spark = docs.sparkSession
    comp = entities(docs, COMPONENTS)
    uses = spark.createDataFrame([(c, m) for c, ms in USES.items() for m in ms], "ctype string, mtype string")
    has = spark.createDataFrame([(c, x) for c, xs in HAS.items() for x in xs], "ctype string, xtype string")
    made = comp.join(F.broadcast(uses), comp["kind"] == uses["ctype"]).select("doc_id", F.col("code").alias("src"), "mtype")
    mats = entities(docs, MATERIALS).select("doc_id", F.col("kind").alias("mtype"), F.col("code").alias("dst"))
    sized = comp.join(F.broadcast(has), comp["kind"] == has["ctype"]).select("doc_id", F.col("code").alias("src"), "xtype")
    dims = dimensions(docs).distinct().select("doc_id", F.col("kind").alias("xtype"), F.concat_ws(":", "kind", "value").alias("dst"))
    a = made.join(mats, ["doc_id", "mtype"]).select("doc_id", "src", "dst", F.lit("USES_MATERIAL").alias("rel_type"), F.lit(0.8).alias("confidence"))
    b = sized.join(dims, ["doc_id", "xtype"]).select("doc_id", "src", "dst", F.lit("HAS_DIMENSION").alias("rel_type"), F.lit(0.7).alias("confidence"))
    return a.unionByName(b)

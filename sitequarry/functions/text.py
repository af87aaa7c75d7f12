"""Column expressions over texts: fingerprints, statistics, extraction, cleaning. All but a few run inside the JVM."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords by class, in order of precedence at ties.
DOC_TYPES = {
    "regulation": ("规范", "标准", "GB", "JGJ", "国标", "行标"),
    "contract": ("合同", "协议", "甲方", "乙方", "签订"),
    "report": ("报告", "总结", "分析", "调研", "汇报"),
    "manual": ("手册", "指南", "说明书", "操作", "使用"),
    "proposal": ("方案", "计划", "提案", "建议"),
    "notice": ("通知", "公告", "公示", "声明"),
}
DOMAINS = {
    "construction": ("建筑", "施工", "工程", "结构", "建造"),
    "legal": ("法律", "法规", "条例", "法条", "司法"),
    "finance": ("财务", "会计", "税务", "审计", "金融"),
    "technology": ("技术", "科技", "研发", "算法", "系统"),
    "management": ("管理", "运营", "组织", "行政", "人力"),
}
#: Words without weight in retrieval.
STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好",
    "自己", "这", "能", "那", "来", "但", "与", "对", "于", "由", "从", "以", "向", "用", "比", "或", "被", "因", "所", "而", "及", "等", "为", "之",
)
# Dates, document numbers, addresses and codes.
DATES = (r"\d{4}年\d{1,2}月\d{1,2}日", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{4}/\d{1,2}/\d{1,2}")
DOC_NUMBERS = (r"GB\s*\d+[-–]\d{4}", r"JGJ\s*\d+[-–]\d{4}", r"\[\d{4}\]\d+号", r"No\.\s*\d+")
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
PHONE = r"^1[3-9]\d{9}$"
URL = r"^https?://\S+$"
STANDARD_CODE = r"[A-Z]{2,4}[\s\-]?\d{4,6}[\-\s]?\d{4}"
PROJECT_CODE = r"[A-Z]{2}\d{6}"
HAN = "一-鿿"


def fingerprint(text: Column) -> Column:
    """First half of the MD5 of the text in lower case without white space; null stays null."""
    return F.substring(F.md5(F.lower(F.regexp_replace(text, r"\s+", ""))), 1, 16)


def chunk_fingerprint(doc: Column, index: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", doc.cast("string"), index.cast("string"), F.substring(text, 1, 200)))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def token_count(text: Column) -> Column:
    """Chinese characters plus 1.3 tokens a Latin word, rounded down; null counts as none."""
    return F.coalesce(count_matches(text, f"[{HAN}]") + F.floor(count_matches(text, r"[a-zA-Z]+") * 1.3), F.lit(0)).cast("long")


def pieces(text: Column, separator: str) -> Column:
    """The parts of a text that are not blank."""
    return F.filter(F.split(text, separator), lambda x: F.trim(x) != "")


def language(text: Column) -> Column:
    han, latin = count_matches(text, f"[{HAN}]"), count_matches(text, r"\b[a-zA-Z]+\b")
    return F.when(han > latin * 5, "chinese").when(latin > han, "english").otherwise("mixed")


def dates(text: Column) -> Column:
    """All dates in three spellings, distinct and sorted."""
    found = F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in DATES))))
    return F.coalesce(found, F.array().cast("array<string>"))


def doc_number(text: Column) -> Column:
    """The first document number of the first thousand characters, by the precedence of the patterns; null if none."""
    head = F.substring(text, 1, 1000)
    return F.coalesce(*(F.nullif(F.regexp_extract(head, p, 0), F.lit("")) for p in DOC_NUMBERS))


def preprocess(text: Column) -> Column:
    """Runs of white space as one blank, outer blanks removed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title(text: Column) -> Column:
    """The first of the first five lines of 6 to 99 characters with at most one full stop; null if none."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 5), lambda x: F.trim(F.regexp_replace(x, "\r", "")))
    stops = lambda x: F.length(x) - F.length(F.replace(x, F.lit("。"), F.lit("")))
    return F.get(F.filter(lines, lambda x: (F.length(x) > 5) & (F.length(x) < 100) & (stops(x) < 2)), F.lit(0))


def keyword_scores(text: Column, classes: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    low = F.lower(text)
    hits = lambda w: F.floor((F.length(low) - F.length(F.replace(low, F.lit(w.lower()), F.lit("")))) / len(w))
    return {name: reduce(Column.__add__, map(hits, kws)) for name, kws in classes.items()}


def classify(text: Column, classes: dict[str, tuple[str, ...]], none: str) -> Column:
    """The class whose keywords occur most often, the earlier one at ties; ``none`` if no keyword occurs."""
    scores = keyword_scores(text, classes)
    best = F.greatest(*scores.values())
    out = F.when(best == 0, none)
    for name, n in scores.items():
        out = out.when(n == best, name)
    return out


def raw_tokens(text: Column) -> Column:
    """All candidates for retrieval tokens: lower case, without links and addresses; Latin words and numbers, Chinese in overlapping pairs. A null text has none."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", ""), r"\S+@\S+", "")
    latin = F.regexp_extract_all(t, F.lit(r"[a-z0-9]+"), F.lit(0))
    pairs = F.regexp_extract_all(t, F.lit(f"(?=([{HAN}][{HAN}]))"), F.lit(1))
    return F.coalesce(F.concat(latin, pairs), F.array().cast("array<string>"))


_STOPPED = frozenset(STOP_WORDS)
_LATIN, _HAN_RUN = re.compile("[a-z0-9]+"), re.compile(f"[{HAN}]{{2,}}")
_LINK, _ADDRESS = re.compile(r"https?://\S+", re.ASCII), re.compile(r"\S+@\S+", re.ASCII)


def token_counts(low: str) -> Counter[str]:
    """What ``raw_tokens`` and ``is_token`` leave of a text in lower case, counted, in Python."""
    low = _LINK.sub("", low) if "http" in low else low
    low = _ADDRESS.sub("", low) if "@" in low else low
    found = [x for x in _LATIN.findall(low) if len(x) > 1 or x.isalpha()]
    for run in _HAN_RUN.findall(low):
        found += map(add, run, run[1:])
    counts = Counter(found)
    for stop in _STOPPED & counts.keys():
        del counts[stop]
    return counts


def is_token(x: Column) -> Column:
    """Whether a candidate carries weight: no stop word and no single sign."""
    return ~x.isin(*STOP_WORDS) & ((F.length(x) > 1) | x.rlike("[a-z]"))


def tokens(text: Column) -> Column:
    """Retrieval tokens as an array; where they are exploded anyway, ``raw_tokens`` with ``is_token`` after is quicker."""
    return F.filter(raw_tokens(text), is_token)


# --- cleaning ------------------------------------------------------------------------------------------------------


def fix_encoding(text: Column) -> Column:
    """Full-width blanks, brackets and quotes to ASCII; zero-width characters removed."""
    return F.translate(text, "　（）【】《》​‌‍﻿", " ()[]<>")


def drop_links(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"https?://\S+", ""), r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "")


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", "")


def squeeze_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"([。！？，、；：])\1+", "$1")


def drop_page_lines(text: Column) -> Column:
    """Lines that hold a page number, and short ones with a page mark, are dropped; the others trimmed."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    page = lambda x: x.rlike(r"^\s*[-–—]\s*\d+\s*[-–—]\s*$") | ((F.length(x) < 50) & x.rlike(r"(?i)(第\s*\d+\s*页|Page\s+\d+|共\s*\d+\s*页|\d+\s*/\s*\d+)"))
    return F.array_join(F.filter(lines, lambda x: ~page(x)), "\n")


def squeeze_blanks(text: Column) -> Column:
    """Lines trimmed, blanks within them squeezed, at most one empty line in a row."""
    inner = F.regexp_replace(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), "\n"), r"[ \t]+", " ")
    return F.regexp_replace(inner, "\n{3,}", "\n\n")


def dedup_paragraphs(text: Column) -> Column:
    """Of paragraphs with the same first hundred characters the first is kept; blank ones are dropped."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.trim(x)), lambda x: x != "")
    numbered = F.transform(parts, lambda x, i: F.struct(F.substring(x, 1, 100).alias("head"), i.alias("i"), x.alias("x")))
    # sorted by head, the first of each run is kept, then all are put in order again: no text is compared with all others
    by_head = F.array_sort(numbered)
    first = F.filter(F.transform(by_head, lambda x, k: F.when((k == 0) | (F.get(by_head, k - 1)["head"] != x["head"]), F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x.isNotNull())
    return F.array_join(F.transform(F.array_sort(first), lambda x: x["x"]), "\n\n")


def merge_lines(text: Column) -> Column:
    """Lines broken within a sentence joined again; each line is joined with one line after it at most.

    A hyphen at the end is dropped before a small letter. Else a line without a full stop is joined with the next one if that
    begins with a small letter, or if both have fewer than fifty characters; headings stay by themselves, and lines of one character are dropped.
    """

    @F.pandas_udf("string")
    def merged(texts: pd.Series) -> pd.Series:
        return texts.map(_merged, na_action="ignore")

    return merged(text)


_HEADING = re.compile(r"第[一二三四五六七八九十百千\d]+[章节条]|\d+[.\s]|[一二三四五六七八九十]+[.、]")


def _merged(text: str) -> str:
    lines = [x for x in (x.strip() for x in text.split("\n")) if len(x) != 1]
    out, waiting = [], None
    for line in lines:
        if waiting is None:
            waiting = line
            continue
        torn = waiting.endswith("-") and line[:1].islower()
        heading = bool(_HEADING.match(line)) or (line.isupper() and len(line) < 30)
        runs_on = waiting and line and waiting[-1] not in "。！？.!?" and not heading and (line[0].islower() or (len(waiting) < 50 and len(line) < 50))
        if torn or runs_on:
            out.append((waiting[:-1] if torn else waiting) + line)
            waiting = None
        else:
            out.append(waiting)
            waiting = line
    return "\n".join(out if waiting is None else [*out, waiting])


def clean(text: Column) -> Column:
    """All cleaning steps in order but for the joining of lines: one expression inside the JVM."""
    steps = (fix_encoding, drop_links, drop_controls, squeeze_punctuation, drop_page_lines, squeeze_blanks, dedup_paragraphs)
    return F.trim(reduce(lambda t, f: f(t), steps, text))


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its text column run through all cleaning steps in order."""
    before = reduce(lambda t, f: f(t), (fix_encoding, drop_links, drop_controls, squeeze_punctuation), F.col(text))
    after = reduce(lambda t, f: f(t), (drop_page_lines, squeeze_blanks, dedup_paragraphs), F.col(text))
    return docs.withColumn(text, merge_lines(before)).withColumn(text, F.trim(after))


# --- small helpers ----------------------------------------------------------------------------------------------------


def format_size(size: Column) -> Column:
    """Bytes as text with unit and two decimals, cut off."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    text = lambda x, unit: F.concat(F.format_string("%.2f", F.floor(x * 100) / 100), F.lit(unit))
    return F.when(size.isNull(), F.lit(None)).when(size < kb, text(size.cast("double"), " B")).when(size < mb, text(size / kb, " KB")).when(size < gb, text(size / mb, " MB")).otherwise(text(size / gb, " GB"))


def safe_filename(name: Column) -> Column:
    """Unsafe characters replaced by underscores, outer blanks and dots removed."""
    return F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"^[ .]+|[ .]+$", "")

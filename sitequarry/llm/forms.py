"""One consistent form for texts whose characters only look like the usual ones.

Tokens with a suspicious character are run through a trie of the corpus's own plain words by a weighted edit
automaton in which look-alikes and ignorable characters cost nothing; the most frequent spelling reached is the canonical
one. Tokens that reach none are normalised by table. Everything else is left as it is, inside the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm import words

#: Words in the trie; a bound on its size, beyond it the table decides.
TRIE_WORDS = 200_000
#: Costs of the edit automaton, and the most a spelling may cost.
ACCENT, EDIT, MAX_COST = 0.5, 1.0, 0.5

# Classes of characters, in the syntax that Java, RE2 and Python share.
FULL_WIDTH = "０-９Ａ-Ｚａ-ｚ－"
ANY_FULL_WIDTH = "！-～￠-￦"
MARKS = "̀-ͯ᪰-᫿⃐-⃿︠-︯"
INVISIBLE = "­᠎​-‏‪-‮⁠-⁤⁦-⁩﻿"
BLANKS = "   -   　"
HYPHENS = "‐‑﹣"
LIGATURES = "ﬀ-ﬆ"
RADICALS = "⺀-⻳⼀-⿕"
SINGLE = FULL_WIDTH + MARKS + INVISIBLE + BLANKS + HYPHENS + LIGATURES + RADICALS
ALPHABETS = "Ͱ-ϿЀ-ԯ"
#: Look-alikes of Latin letters, Cyrillic and Greek.
LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ь": "b", "З": "3",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
#: Greek letters that serve as symbols beside Latin ones.
SYMBOLS = "ΦφϕΩΔΣπµμθλσεδβ"
_GREEK = "".join(c for c in map(chr, range(0x370, 0x400)) if c.isalpha() and c not in SYMBOLS)
OTHER = "\u0400-\u052f" + _GREEK
_LOOKS = "".join(c for c in LOOKALIKE if c in "АВЕКМНОРСТУХЅІЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_BETWEEN = f"[{MARKS}{INVISIBLE}0-9{HYPHENS}-]*"
#: A letter of another alphabet inside a Latin word or code, or alone before a number, as in an axis or a bar size.
MIXED = f"[{LATIN}]{_BETWEEN}[{OTHER}]|[{OTHER}]{_BETWEEN}[{LATIN}]|(?:^|[^{ALPHABETS}{LATIN}])[{_LOOKS}]{{1,3}}[{HYPHENS}-]?[0-9]"
TEXT_CASE = f"[{SINGLE}]|{MIXED}"
CODE_CASE = f"[{SINGLE}{ANY_FULL_WIDTH}]|[{OTHER}]"
_PLAIN = rf"[{LATIN}0-9]+"
_TOKEN = re.compile(rf"[{LATIN}0-9{FULL_WIDTH}{ALPHABETS}{MARKS}{INVISIBLE}{LIGATURES}]+")


def _members(spec: str) -> list[str]:
    """The characters of a class."""
    return regex.findall(f"[{spec}]", "".join(map(chr, range(0x80, 0x10000))).encode("utf-16", "surrogatepass").decode("utf-16", "ignore"))


_TABLE = {ord(c): unicodedata.normalize("NFKC", c) for c in _members(FULL_WIDTH + LIGATURES + RADICALS)}
_TABLE |= {ord(c): None for c in _members(INVISIBLE)} | {ord(c): " " for c in _members(BLANKS)} | {ord(c): "-" for c in _members(HYPHENS + "\uff0d")}
_CODE_TABLE = {ord(c): unicodedata.normalize("NFKC", c) for c in _members(ANY_FULL_WIDTH)} | _TABLE
_LATIN_TABLE = str.maketrans(LOOKALIKE)
_MIXED, _CASE, _CODE = re.compile(MIXED), re.compile(TEXT_CASE), re.compile(CODE_CASE)
#: Texts of nothing but these characters hold no case; the ranges are few, so that the JVM decides quickly.
UNSUSPICIOUS = "\\x00-\\x7f\\u00ae-\\u02ff\\u2013-\\u2027\\u3001-\\u303f\\u3400-\\u9fff\\uff08-\\uff0c\\uff1a-\\uff20¬§°"
_MIXED_TOKEN = re.compile(rf"[{LATIN}0-9{ALPHABETS}-]+")
_IGNORED = frozenset(_members(INVISIBLE))
_ODD, _FOREIGN = re.compile(f"[{SINGLE}{ALPHABETS}]"), re.compile(f"[{ALPHABETS}]+")


def by_table(text: str, code: bool = False) -> str:
    """The plain form of every character by its compatibility mapping; look-alike letters become Latin only in mixed tokens."""
    plain = unicodedata.normalize("NFC", text.translate(_CODE_TABLE if code else _TABLE))
    if code:
        return plain.translate(_LATIN_TABLE).strip()
    if _MIXED.search(plain):
        plain = _MIXED_TOKEN.sub(lambda m: m[0].translate(_LATIN_TABLE) if _MIXED.search(" " + m[0]) else m[0], plain)
    return plain


class Trie:
    """Words with their counts, walked by a weighted edit automaton.

    A character costs nothing where it stands for itself, for what it looks like, or for nothing if it can be ignored; ACCENT where
    only the accent differs, EDIT where it is put for another, left out or put in.
    """

    def __init__(self, counted: list[tuple[str, int]]):
        self.root: dict = {}
        self.known: dict[str, tuple[str, float] | None] = {}
        for word, n in counted:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = n

    @staticmethod
    @lru_cache(65536)
    def readings(c: str) -> tuple[str, ...]:
        """What a character may stand for at no cost: itself, what it looks like, or nothing if it can be ignored."""
        wide = unicodedata.normalize("NFKC", c)
        return tuple(dict.fromkeys(x for x in (c, LOOKALIKE.get(c, ""), wide) if x)) + (("",) if c in _IGNORED else ())

    @staticmethod
    @lru_cache(65536)
    def bare(c: str) -> str:
        """The letter without its accent."""
        return unicodedata.normalize("NFD", c)[0] if c else c

    def spelling(self, token: str, most: float = MAX_COST) -> tuple[str, float] | None:
        """The word reached at the least cost, the most frequent one at ties, and the cost; None if none is reached for ``most``."""
        if token not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[token] = self._spelling(unicodedata.normalize("NFC", token), most)
        return self.known[token]

    def _spelling(self, token: str, most: float) -> tuple[str, float] | None:
        # states are (cost, word so far) by node; the cost is carried along the path
        front: dict[str, tuple[float, dict]] = {"": (0.0, self.root)}
        for c in token:
            ahead: dict[str, tuple[float, dict]] = {}

            def reach(done: str, cost: float, node: dict | None) -> None:
                if node is not None and cost <= most and (done not in ahead or cost < ahead[done][0]):
                    ahead[done] = (cost, node)

            letters = {self.bare(r) for r in self.readings(c) if len(r) == 1}
            for done, (cost, node) in front.items():
                for reading in self.readings(c):
                    at: dict | None = node
                    for x in reading:
                        at = at.get(x) if at is not None else None
                    reach(done + reading, cost, at)
                if cost + ACCENT <= most:
                    for x, at in node.items():
                        if x and self.bare(x) in letters:
                            reach(done + x, cost + ACCENT, at)
                if cost + EDIT <= most:
                    reach(done, cost + EDIT, node)  # left out
                    for x, at in node.items():
                        if x:
                            reach(done + x, cost + EDIT, at)  # put for another
                            for y in self.readings(c):  # another put in before it
                                if len(y) == 1:
                                    reach(done + x + y, cost + EDIT, at.get(y))
            front = ahead
            if not front:
                return None
        ends = [(-cost, node[""], done) for done, (cost, node) in front.items() if "" in node]
        if not ends:
            return None
        cost, _, done = max(ends)
        return done, -cost


def canonical(text: str, trie: Trie, code: bool = False) -> tuple[str, bool]:
    """The consistent form of one text, and whether it differs from the text in what costs nothing: look-alikes, ignorables and compatible forms."""
    def token(m) -> str:
        t = m[0]
        if not _ODD.search(t) or (not code and (_FOREIGN.fullmatch(t) or not _CASE.search(" " + t))):
            return t
        best = trie.spelling(t)
        return best[0] if best else t

    form = by_table(_TOKEN.sub(token, text), code)
    return form, form != (text.strip(" ") if code else text)


def vocabulary(texts: DataFrame, size: int = TRIE_WORDS) -> list[tuple[str, int]]:
    """The most frequent words of plain characters over all texts, at most ``size``, with their counts."""
    plain = words.counts(texts, F.regexp_extract_all("text", F.lit(_PLAIN), F.lit(0))).where("n > 1 and length(word) > 1")
    return [(r.word, r.n) for r in plain.orderBy(F.desc("n"), "word").limit(size).collect()]


def consistent(texts: DataFrame, size: int = TRIE_WORDS) -> DataFrame:
    """src_table, row_id, form (the text in one consistent form) and disguised (whether the row needed it).

    ``texts`` has src_table, row_id, text and code (whether the text is a code). A null text has a null form and
    is not disguised; an empty one stays empty. Codes lose outer blanks in their form. Repeated rows come out each.
    """
    suspicious = F.when(F.col("code"), F.col("text").rlike(r"[^\x00-\x7f\u4e00-\u9fff]")).otherwise(F.col("text").rlike(f"[^{UNSUSPICIOUS}]"))
    marked = texts.select("src_table", "row_id", "text", "code", F.coalesce(suspicious, F.lit(False)).alias("suspicious"))
    known = texts.sparkSession.sparkContext.broadcast(vocabulary(texts, size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trie = _trie(known)
            # the automaton decides: a row is disguised if its canonical form is another at no cost
            forms = [canonical(t, trie, code) if (_CODE if code else _CASE).search(t) else (t.strip(" ") if code else t, False) for t, code in zip(batch["text"], batch["code"])]
            yield pd.DataFrame({"src_table": batch["src_table"], "row_id": batch["row_id"], "form": [f for f, _ in forms], "disguised": [d for _, d in forms]})

    odd = marked.where("suspicious").select("src_table", "row_id", "text", "code").mapInPandas(run, "src_table string, row_id long, form string, disguised boolean")
    same = marked.where("not suspicious").select("src_table", "row_id", F.when(F.col("code"), F.trim("text")).otherwise(F.col("text")).alias("form"), F.lit(False).alias("disguised"))
    return same.unionByName(odd)


_TRIES: dict = {}


def _trie(known) -> Trie:
    """The trie of a broadcast vocabulary, built once per worker."""
    if known.value is not _TRIES.get("of"):
        _TRIES.update(of=known.value, trie=Trie(known.value))
    return _TRIES["trie"]


def sources(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """The texts of document_chunks and the codes of drawing_entities."""
    both = words.gathered(("document_chunks", chunks, "text", None), ("drawing_entities", entities, "code", None))
    return both.select("src_table", "row_id", "text", (F.col("src_table") == "drawing_entities").alias("code"))


def found(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """src_table and row_id of every row with disguised characters."""
    return consistent(sources(chunks, entities)).where("disguised").select("src_table", "row_id")

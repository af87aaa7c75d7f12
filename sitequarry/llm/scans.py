"""Noise in text from scanned pages: broken words, misread characters, running titles and page numbers.

A lexicon with counts is learnt from the whole corpus. Each page is then read as one stream without line ends. Around every
word that the lexicon does not know, and around every break mark, the stream is decoded by joint segmentation: a lattice whose edges read a
word as it is, with confused characters, split in two, merged with its neighbour over a blank, or joined over a break with or
without its hyphen; the cheapest path is taken, and the kinds of noise are read off its edges. Running titles are the lines
that come back, after folding of confusable characters, in several rows of one file. Paragraph boundaries are chosen by
dynamic programming over the lines.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm import forms, words
from sitequarry.plans.session import cut

#: Words in the lexicon that every task holds; the counts of rarer words are looked up by a join where a correction hangs on them.
LEXICON_WORDS = 200_000
#: A word is a misreading of another that it may be confused with and that is so many times as frequent.
RATIO = 15
#: The same for pairs of Chinese characters, few of which make up all the misreadings.
RATIO_HAN = 4
#: A title comes back in so many rows of its file.
TITLE_ROWS = 3
MAX_TITLE = 120
#: Titles that make up more than this share of all lines, 1 / HOT at most, are joined by broadcast.
HOT = 0.001
#: What a confused character, a split, a merge over a blank and a kept hyphen cost, in natural logarithms.
CONFUSION, SPLIT, MERGE, COMPOUND = 5.0, 6.0, 5.0, 10.0
#: Noncharacters that stand for the break mark of a broken word in the stream: a hyphen that may be the word's own, or another mark.
HARD, SOFT = "\ufdd0", "\ufdd1"

# What is read for what. Observed on the left, meant on the right.
CONFUSED = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("|", "i"), ("|", "l"), ("†", "t"), ("¢", "c"), ("€", "e"), ("@", "a"), ("$", "s"), ("!", "l"), ("!", "i"),
    ("c", "e"), ("cl", "d"), ("li", "h"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("ii", "u"),
]
#: The same for Chinese characters.
CONFUSED_HAN = [
    ("屡", "层"), ("士", "土"), ("己", "已"), ("粱", "梁"), ("绕", "浇"), ("扳", "板"), ("摸", "模"), ("未", "末"), ("末", "未"), ("捡", "检"), ("脸", "验"), ("逢", "缝"), ("粧", "桩"),
    ("日", "曰"), ("曰", "日"), ("千", "干"), ("干", "千"), ("人", "入"), ("入", "人"), ("大", "太"), ("太", "大"), ("天", "夭"), ("王", "玉"), ("玉", "王"), ("巳", "已"), ("折", "拆"), ("拆", "折"), ("析", "折"),
    ("侍", "待"), ("待", "侍"), ("科", "料"), ("料", "科"), ("淮", "准"), ("便", "使"), ("使", "便"), ("间", "问"), ("问", "间"), ("治", "冶"), ("冶", "治"), ("候", "侯"), ("侯", "候"), ("戍", "戌"), ("汽", "气"), ("木", "本"), ("本", "木"),
    ("贝", "见"), ("风", "凤"), ("刀", "力"), ("力", "刀"), ("白", "自"), ("自", "白"), ("晴", "睛"), ("睛", "晴"), ("清", "情"), ("情", "清"), ("钢", "钥"), ("铜", "钢"), ("抹", "抺"), ("徒", "陡"), ("陡", "徒"), ("拔", "拨"), ("拨", "拔"),
    ("辟", "壁"), ("璧", "壁"), ("注", "住"), ("住", "注"), ("隧", "遂"), ("遂", "隧"), ("锚", "描"), ("碎", "醉"), ("焊", "悍"), ("悍", "焊"), ("彻", "砌"), ("筋", "箱"), ("搭", "塔"), ("塔", "搭"), ("渗", "掺"), ("掺", "渗"), ("棚", "栅"), ("栅", "棚"),
]
_HAN_READ = {}
for _seen, _meant in CONFUSED_HAN:
    _HAN_READ.setdefault(_seen, []).append(_meant)
_SIDES = sorted({c for pair in CONFUSED_HAN for c in pair})
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
BREAK = r"[-¬‐‑­－]"
#: Words, also with misread characters inside.
_WORD = rf"[{_L}0-9|†¢€@$!]*[{_L}|†¢€][{_L}0-9|†¢€@$]*"
_WORD_RE = re.compile(rf"{_WORD}(?:[{HARD}{SOFT}]{_WORD})*")
_PLAIN = re.compile(rf"[{_L}]+")
PAGE = r"^\s*(?:[\[(（【]?\s*\d{1,4}\s*[\])）】]?|[-–—]\s*\d{1,4}\s*[-–—]|\d{1,4}\s*/\s*\d{1,4}|第\s*\d{1,4}\s*页(?:\s*[,，/]?\s*共\s*\d{1,4}\s*页)?|(?:p|pp|S|Page|Seite|Blatt|page|seite|PAGE|SEITE)\.?\s*\d{1,4}(?:\s*(?:of|von|/|OF|VON)\s*\d{1,4})?)\s*$"
_PAGE = re.compile(PAGE)
_BROKEN = re.compile(rf"[{_L}]{BREAK}[ \t ]*$")
#: Digits with a letter read for one of them: between or after digits, or before them after a sign.
_NUMBER = re.compile(rf"(?<![{_L}\d])(?:\d+[OoSBlIZ|]\d[\dOoSBlIZ|]*|\d+[OSB](?![{_L}\d])|(?<=[@+=±xX×Φ])[OSBlIZ|]\d[\dOoSBlIZ|]*)(?![{_L}])")
_NUMBER_HINT = re.compile(r"\d[OoSBlIZ|]|[@+=±xX×Φ][OSBlIZ|]\d")
_DIGIT = str.maketrans("OoSBlIZ|", "00581121")


# --- the lexicon -----------------------------------------------------------------------------------------------------


def variants(word: str, most: int = 2) -> dict[str, int]:
    """Words that may have been read as ``word``, with the number of confusions, at most ``most``."""
    out: dict[str, int] = {word: 0}
    front = {word}
    for k in range(1, most + 1):
        ahead = set()
        for w in front:
            for seen, meant in CONFUSED:
                at = w.find(seen)
                while at >= 0:
                    v = w[:at] + meant + w[at + len(seen) :]
                    if v not in out:
                        out[v] = k
                        ahead.add(v)
                    at = w.find(seen, at + 1)
        front = ahead
    del out[word]
    return out


class Lexicon:
    """Counts of words and of pairs of Chinese characters, without those that are misreadings of more frequent ones.

    ``complete`` says whether every word of the corpus is held. If not, a correction of a word of letters that is not held hangs on
    its count: ``doubts`` maps such words to the count above which they are words of their own. ``known`` are words found to be such.
    """

    def __init__(self, counted: list[tuple[str, int]], complete: bool = True):
        counts: dict[str, int] = {}
        for w, n in counted:
            counts[w] = counts.get(w, 0) + n
        self.total = max(1, sum(counts.values()))
        self.complete = complete
        self.pairs = {w: n for w, n in counts.items() if len(w) == 2 and "一" <= w[1] <= "鿿"}
        self.words = {w: n for w, n in counts.items() if w not in self.pairs and _PLAIN.fullmatch(w)}
        for w, n in sorted(self.words.items(), key=lambda x: x[1]):
            if any(self.words.get(v, 0) >= RATIO * n * k for v, k in variants(w, 2).items()):
                del self.words[w]
        self._read: dict[str, str | None] = {}
        self._edges: dict[str, tuple[float, str, str] | None] = {}
        self._han: dict[tuple[str, str, str], str | None] = {}
        self.doubts: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_read": {}, "_edges": {}, "_han": {}, "doubts": {}}

    def cost(self, word: str) -> float:
        n = self.words.get(word)
        return math.log(self.total / n) if n else 14.0 + 0.8 * len(word)

    def reading(self, word: str) -> str | None:
        """What an unknown word was meant to be if it was misread, else None."""
        if word not in self._read:
            if len(self._read) > 200_000:
                self._read.clear()
            odd = not _PLAIN.fullmatch(word)
            best, least = None, self.cost(word) + (20.0 if odd else 0.0)
            plain = sum(c.isalpha() for c in word) >= 2
            if plain and len(word) >= 3:
                for v, k in variants(word, 3 if len(word) > 7 else 2).items():
                    if v in self.words and (len(v) > 3 or self.words[v] * 1500 > self.total or odd):
                        c = self.cost(v) + CONFUSION * k
                        if c < least:
                            best, least = v, c
                if best is None and odd:
                    # unknown, but letters with signs or digits among them are no word: undo the signs
                    w = word
                    for seen, meant in CONFUSED[:16]:
                        w = w.replace(seen, meant)
                    if _PLAIN.fullmatch(w) and len(w) >= 4 and re.search(r"[a-zß-ÿ|†¢€]{2}", word):
                        best = w
            self._read[word] = best
        return self._read[word]

    def split(self, word: str) -> tuple[str, str] | None:
        """Two known words run together, if that is likelier than an unknown word."""
        best, least = None, self.cost(word)
        for k in range(2, len(word) - 1):
            a, b = word[:k], word[k:]
            if a in self.words and b in self.words and (c := self.cost(a) + self.cost(b) + SPLIT) < least and self.words[a] * 3000 > self.total and self.words[b] * 3000 > self.total:
                best, least = (a, b), c
        return best

    def edge(self, seen: str, known: frozenset[str] = frozenset()) -> tuple[float, str, str] | None:
        """The cheapest reading of one word of the stream: cost, what to put, and the kind (``char``, ``split`` or none); None for a word that is known or none."""
        if seen.lower() in self.words:
            return None
        if known and seen.lower() in known:
            return None
        if seen not in self._edges:
            if len(self._edges) > 500_000:
                self._edges.clear()
            self._edges[seen] = self._edge(seen)
        return self._edges[seen]

    def _edge(self, seen: str) -> tuple[float, str, str] | None:
        low = seen.lower()
        if seen.isalpha() and seen.isascii() and (len(seen) < 3 or seen.isupper()):
            return None
        if any(c.isdigit() for c in seen) and not re.search(r"[a-zß-ÿ|†¢€].*[a-zß-ÿ|†¢€]", seen):
            return None  # a code or a number with its unit
        if re.fullmatch(r"\d+[a-z]{1,3}", seen):
            return None
        tail = re.search(r"[!@$]+$", low)
        body = low[: tail.start()] if tail else low
        meant = self.reading(body)
        if meant is None:
            apart = self.split(low) if len(seen) > 5 else None
            if apart:
                return self.cost(apart[0]) + self.cost(apart[1]) + SPLIT, seen[: len(apart[0])] + " " + seen[len(apart[0]) :], "split"
            return self.cost(low), seen, ""
        return self.cost(meant) + CONFUSION, _cased(meant, seen) + (tail[0] if tail else ""), "char"

    def doubt(self, low: str) -> None:
        """Notes that the correction of a word hangs on its count in the corpus."""
        if not self.complete and _PLAIN.fullmatch(low):
            self.doubts[low] = max((self.words.get(v, 0) / (RATIO * k) for v, k in variants(low, 2).items()), default=0.0)

    def han(self, before: str, seen: str, after: str) -> str | None:
        """The character meant if the pairs around say that it was misread."""
        key = (before, seen, after)
        if key not in self._han:
            if len(self._han) > 500_000:
                self._han.clear()
            self._han[key] = self._meant(before, seen, after)
        return self._han[key]

    def _meant(self, before: str, seen: str, after: str) -> str | None:
        for meant in _HAN_READ.get(seen, ()):
            votes = 0
            # the neighbour may be misread as well
            lefts, rights = [before, *_HAN_READ.get(before, ())], [after, *_HAN_READ.get(after, ())]
            for pair, others in ((before + seen, [x + meant for x in lefts]), (seen + after, [meant + x for x in rights])):
                if len(pair) == 2 and all("一" <= c <= "鿿" for c in pair):
                    n, m = self.pairs.get(pair, 0), max(self.pairs.get(x, 0) for x in others)
                    votes += 1 if m >= RATIO_HAN * max(n, 1) and m >= 5 else -1 if n > m else 0
            if votes > 0:
                return meant
        return None


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 2 else word[0].upper() + word[1:] if like[0].isupper() else word


_HAN_SEEN = re.compile(f"[{''.join(sorted(_HAN_READ))}]")


_JOINED = re.compile(rf"(?<=[{_L}]){BREAK}[ \t]*\r?\n[ \t]*(?=[a-zß-ÿ])")
_ASKED = np.zeros(1 << 16, bool)
_ASKED[[ord(c) for c in _SIDES]] = True


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = "\n\n".join(batch.column(0).to_pylist())
        counts = pa.array(_PLAIN.findall(_JOINED.sub("", text.lower())), pa.string()).value_counts()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        han = (points >= 0x4E00) & (points <= 0x9FFF)
        asked = _ASKED[np.where(han, points, 0)]
        both = np.flatnonzero(han[:-1] & han[1:] & (asked[:-1] | asked[1:]))
        pairs, n = np.unique(points[both].astype(np.uint64) << np.uint64(16) | points[both + 1], return_counts=True)
        names = [chr(p >> 16) + chr(p & 0xFFFF) for p in pairs.tolist()]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([counts.field(0), pa.array(names, pa.string())]), pa.concat_arrays([counts.field(1).cast(pa.int64()), pa.array(n, pa.int64())])], ["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """word and n of all words (lower case, broken ones joined) and of the pairs of Chinese characters with a confusable one, that come twice at least.

    Counted per batch first, so that the shuffle carries few rows.
    """
    each = texts.where("text <> ''").select("text").mapInArrow(_count_texts, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1 and length(word) > 1")


def learnt(texts: DataFrame, size: int = LEXICON_WORDS) -> Lexicon:
    """The lexicon of the most frequent words and pairs over all texts, ``size`` at most."""
    rows = word_counts(texts).orderBy(F.desc("n"), "word").limit(size + 1).collect()
    return Lexicon([(r.word, r.n) for r in rows[:size]], complete=len(rows) <= size)


# --- a page -------------------------------------------------------------------------------------------------------------


def read(text: str, lexicon: Lexicon, titles: frozenset[int] = frozenset(), file: tuple[str, str] = ("", ""), known: frozenset[str] = frozenset()) -> tuple[str, set[str]]:
    """The repaired text of a page in paragraphs, and the kinds of noise found: hyphen, char, page_number (and header if titles are given)."""
    kinds: set[str] = set()
    if "\n" not in text and "\r" not in text and not _PAGE.match(text):
        return decode(text, lexicon, kinds, known), kinds
    lines = []
    raw = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    for line in raw:
        if line.strip() and _PAGE.match(line):
            kinds.add("page_number")
        elif titles and line.strip() and len(raw) > 1 and title_key(*file, fold_text(line)) in titles:
            kinds.add("header")
        else:
            lines.append(line)
    out = []
    for paragraph in paragraphs(lines):
        stream, broken = "", False
        for i, line in enumerate(paragraph):
            line = line.lstrip() if broken else line.strip() if len(paragraph) > 1 else line
            stream = stream + line if broken else _glue(stream, line)
            broken = i < len(paragraph) - 1 and bool(_BROKEN.search(line))
            if broken:  # the break mark stays in the stream, for the decoder to settle
                kinds.add("hyphen")
                stream = stream.rstrip("\t \u00a0 ")
                stream = stream[:-1] + (HARD if stream[-1] in "-‐‑－" else SOFT)
        out.append(decode(stream, lexicon, kinds, known))
    return "\n\n".join(out), kinds


def _glue(stream: str, line: str) -> str:
    if not stream or not line:
        return stream + line
    han = "　" <= stream[-1] <= "鿿" or "＀" <= stream[-1] <= "￯" or "一" <= line[0] <= "鿿" or "＀" <= line[0] <= "￯" or "　" <= line[0] <= "〿"
    return stream + ("" if han or stream[-1] in " \n" or line[0] in " \n" else "\n" if stream.endswith("\n") else " ") + line


def _broken_word(seen: str, lexicon: Lexicon, known: frozenset[str]) -> tuple[float, str, str]:
    """The cheapest reading of a word with break marks inside: joined as it is or with confused characters, or a compound with its own hyphen."""
    whole = re.sub(f"[{HARD}{SOFT}]", "", seen)
    if whole.lower() in lexicon.words or whole.lower() in known:
        return lexicon.cost(whole.lower()), whole, ""
    best = lexicon.edge(whole, known) or (lexicon.cost(whole.lower()), whole, "")
    pieces = re.split(f"[{HARD}{SOFT}]", seen)
    if SOFT not in seen and (all(p.lower() in lexicon.words for p in pieces) or pieces[-1][:1].isupper()):
        compound = sum(lexicon.cost(p.lower()) if p.lower() in lexicon.words else 0.0 for p in pieces) + COMPOUND
        if best[2] != "char":
            return compound, seen.replace(HARD, "-"), ""
    return best


def decode(stream: str, lexicon: Lexicon, kinds: set[str], known: frozenset[str] = frozenset()) -> str:
    """The stream with broken, misread, run-on and torn words put right by the cheapest path; ``char`` is added to ``kinds`` if a character was misread.

    The lattice is laid around the words that are not known, each with its neighbours; elsewhere the text is its own cheapest path.
    """
    marked = HARD in stream or SOFT in stream
    odd = {w: None for w in set(_WORD_RE.findall(stream)) if w.lower() not in lexicon.words and (marked and (HARD in w or SOFT in w) or lexicon.edge(w, known))}
    if odd:
        words_ = list(_WORD_RE.finditer(stream))
        out, at = [], 0
        for first, last in _windows(words_, odd, stream):
            start = words_[first].start()
            text, chars = _cheapest(stream, words_[first : last + 1], odd, lexicon, known)
            out += [stream[at:start], text]
            at = words_[last].end()
            if chars:
                kinds.add("char")
        stream = "".join(out) + stream[at:]
    if marked:  # marks that are not between two words
        stream = stream.replace(HARD, "-").replace(SOFT, "")
    if _NUMBER_HINT.search(stream) and _NUMBER.search(stream):
        kinds.add("char")
        stream = _NUMBER.sub(lambda m: m[0].translate(_DIGIT), stream)
    chars = None
    for m in _HAN_SEEN.finditer(stream):
        at = m.start()
        if meant := lexicon.han(stream[at - 1 : at] if at else "", m[0], stream[at + 1 : at + 2]):
            chars = chars or list(stream)
            chars[at] = meant
    if chars:
        kinds.add("char")
        return "".join(chars)
    return stream


def _windows(found: list[re.Match], odd: dict, stream: str) -> Iterator[tuple[int, int]]:
    """First and last number of the words of each window: runs of odd words, with one neighbour on either side where only a blank is between."""
    touching = lambda i: stream[found[i].end() : found[i + 1].start()] == " "
    i, n, free = 0, len(found), 0
    while i < n:
        if found[i][0] in odd:
            first = i - 1 if i > free and touching(i - 1) else i
            last = i
            while last + 1 < n and touching(last) and (found[last + 1][0] in odd or found[last][0] in odd):
                last += 1
            yield first, last
            free = i = last + 1
        else:
            i += 1


def _cheapest(stream: str, window: list[re.Match], odd: dict, lexicon: Lexicon, known: frozenset[str]) -> tuple[str, bool]:
    """The cheapest path through the lattice of a window, as text, and whether it reads a character for another."""
    best: list[tuple[float, str, bool]] = [(0.0, "", False)]
    doubtful: list[str] = []
    for i, m in enumerate(window):
        seen = m[0]
        gap = stream[window[i - 1].end() : m.start()] if i else ""
        if seen not in odd:
            cost, put, kind = lexicon.cost(seen.lower()), seen, ""
        elif HARD in seen or SOFT in seen:
            cost, put, kind = _broken_word(seen, lexicon, known)
        else:
            cost, put, kind = lexicon.edge(seen, known)
        if kind == "char":
            doubtful.append(seen.lower())
        before = best[-1]
        options = [(before[0] + cost, before[1] + gap + put, before[2] or kind == "char")]
        if i and gap == " ":  # torn: both parts make one word
            left = window[i - 1][0]
            whole = (left + seen).lower()
            if (left in odd or seen in odd) and len(whole) >= 5 and len(whole) > max(len(left), len(seen)) + 1 and not (set(whole) & {HARD, SOFT}):
                before = best[-2]
                lead = stream[window[i - 2].end() : window[i - 1].start()] if i > 1 else ""
                if whole in lexicon.words:
                    options.append((before[0] + lexicon.cost(whole) + MERGE, before[1] + lead + left + seen, before[2]))
                elif left in odd and seen in odd and min(sum(map(str.isalpha, x)) for x in (left, seen)) > 1 and (meant := lexicon.reading(whole)):
                    options.append((before[0] + lexicon.cost(meant) + CONFUSION + MERGE, before[1] + lead + _cased(meant, left), True))
        best.append(min(options))
    if best[-1][2] and not lexicon.complete:
        for low in doubtful:
            lexicon.doubt(low)
    return best[-1][1], best[-1][2]


_END = re.compile(r"[.!?。！？:：]['\"”’)）]*\s*$")
_ITEM = re.compile(r"^\s*(?:[-•*·]\s|\d+(?:\.\d+)*[.)]?\s+\S|\t)")


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Lines grouped into paragraphs: the boundaries of least total cost, by dynamic programming over the line ends.

    A boundary is cheap after a blank line, before an item, and after a short line that ends a sentence; joining is cheap
    within full lines and after a broken word. A blank line always parts.
    """
    body = [x for x in lines]
    while body and not body[0].strip():
        body.pop(0)
    while body and not body[-1].strip():
        body.pop()
    if not body:
        return []
    widths = sorted(len(x) for x in body if x.strip())
    full = widths[int(0.8 * (len(widths) - 1))]
    keep: list[tuple[str, bool]] = []
    blank = False
    for x in body:
        if x.strip():
            keep.append((x, blank))
            blank = False
        else:
            blank = True
    n = len(keep)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    joins = [0.0] * n  # cost of joining line i to the one before
    parts = [0.0] * n  # cost of starting a paragraph at line i
    for i in range(1, n):
        before, (line, gap) = keep[i - 1][0], keep[i]
        broken, ended = bool(_BROKEN.search(before)), bool(_END.search(before))
        short = len(before) < 0.75 * full
        joins[i] = (50.0 if gap and not broken else 0.0) + (2.0 if ended and short else 0.0) + (4.0 if _ITEM.match(line) and not broken else 0.0)
        parts[i] = (30.0 if broken else 0.0) + (0.5 if ended else 3.0) + (0.0 if short else 2.0) - (3.0 if _ITEM.match(line) else 0.0)
    # lines i to j - 1 as one paragraph cost what joining them costs: a difference of running sums, so that one pass finds the best i
    joined, cheapest, first = 0.0, math.inf, 0
    for j in range(1, n + 1):
        i = j - 1
        joined += joins[i]
        cost = best[i] + (parts[i] if i else 0.0) - joined
        if cost <= cheapest:
            cheapest, first = cost, i
        best[j], back[j] = cheapest + joined, first
    out, j = [], n
    while j:
        out.append([x for x, _ in keep[back[j] : j]])
        j = back[j]
    return out[::-1]


# --- running titles ------------------------------------------------------------------------------------------------------

_LOOK_FROM = "".join(forms.LOOKALIKE) + "0159|86†¢ec"
_LOOK_TO = "".join(x.lower() for x in forms.LOOKALIKE.values()) + "olsglbbtccc"
_PAIRS_FOLDED = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("i", "l"))


def fold_text(line: str) -> str:
    """A line without case, blanks and signs, confusable characters made one."""
    if not line.isascii():
        line = unicodedata.normalize("NFKC", line)
    x = "".join(c for c in line.lower().translate(_LOOK) if c.isalnum())
    for a, b in _PAIRS_FOLDED:
        x = x.replace(a, b)
    return x


def title_key(table: str, file: str, fold: str) -> int:
    """A 64-bit key of a folded line in its file."""
    return int.from_bytes(hashlib.blake2b(f"{table}\0{file}\0{fold}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_LOOK = str.maketrans(_LOOK_FROM, _LOOK_TO)
_NO_TITLE = re.compile(r"[:：]\s*\d+\s*\S{0,6}\s*$|^\s*\d+(?:\.\d+)+\s")


def _folded_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for s, f, i, t in zip(batch["src_table"], batch["file_id"], batch["row_id"], batch["text"]):
            lines = [x for x in re.split(r"\r\n?|\n", t) if x.strip()]
            if len(lines) > 1:
                folds = {fold_text(x) for x in lines if len(x) <= MAX_TITLE and not _PAGE.match(x) and not _NO_TITLE.search(x)}
                rows += [(s, i, title_key(s, f, x)) for x in folds if len(x) >= 5]
        yield pd.DataFrame(rows, columns=["src_table", "row_id", "title"])


def title_lines(texts: DataFrame) -> DataFrame:
    """src_table, row_id and title (key of the folded line) of the lines that come back in TITLE_ROWS rows of their file or more.

    A row that is one line, a page number, a numbered heading or a counted list entry is no title. Rows without a file have none. Lines are
    folded once. Counts are aggregated per title first; the few titles that hold a large share of all lines are joined by broadcast, so that
    a file with very many rows does not fall to one task.
    """
    several = texts.where("file_id is not null").where(F.col("text").contains("\n") | F.col("text").contains("\r"))
    each = cut(several.select("src_table", "file_id", "row_id", "text").mapInPandas(_folded_lines, "src_table string, row_id long, title long").distinct())
    often = each.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TITLE_ROWS)
    lines = F.broadcast(each.agg(F.count(F.lit(1)).alias("lines")))  # one row
    split = often.join(lines).select("title", (F.col("n") > HOT * F.col("lines")).alias("hot"))
    hot = F.broadcast(split.where("hot").select("title"))
    return each.join(hot, "title", "left_semi").unionByName(each.join(hot, "title", "left_anti").join(split.where("not hot").select("title"), "title", "left_semi"))


# --- over tables ---------------------------------------------------------------------------------------------------------


def sources(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """The texts of document_chunks and extracted_elements with the file each belongs to."""
    return words.gathered(("document_chunks", chunks, "text", "document_id"), ("extracted_elements", elements, "content", "drawing_id"))


def _refuted(doubts: DataFrame, texts: DataFrame) -> DataFrame:
    """src_table, row_id and word of the corrections that the word's own count in the corpus refutes; ``doubts`` has src_table, row_id, word and limit."""
    return doubts.join(word_counts(texts), "word").where("n > limit").select("src_table", "row_id", "word")


_DOUBTS = "array<struct<word string, limit double>>"


def _read_pages(held, out: str):
    """A reader of batches; ``out`` is ``noise`` or ``text``, the column wanted beside the doubts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = held.value
        for batch in batches:
            values, doubts = [], []
            titles = batch["titles"] if "titles" in batch else [None] * len(batch)
            known = batch["known"] if "known" in batch else [None] * len(batch)
            files = batch["file_id"] if "file_id" in batch else [""] * len(batch)
            for s, f, t, h, k in zip(batch["src_table"], files, batch["text"], titles, known):
                lexicon.doubts = {}
                text, kinds = (t, set()) if t is None or t == "" else read(t, lexicon, frozenset() if h is None else frozenset(h), (s, f), frozenset() if k is None else frozenset(k))
                values.append(sorted(kinds) if out == "noise" else text)
                doubts.append([{"word": w, "limit": x} for w, x in lexicon.doubts.items()])
            yield pd.DataFrame({"src_table": batch["src_table"], "row_id": batch["row_id"], out: values, "doubts": doubts})

    return run


def found(texts: DataFrame) -> DataFrame:
    """src_table, row_id and noise_kind, one row per kind present; null and empty texts have none."""
    lexicon = learnt(texts)
    held = texts.sparkSession.sparkContext.broadcast(lexicon)
    pages = texts.where("text <> ''").select("src_table", "row_id", "text")
    kinds = "src_table string, row_id long, noise array<string>, doubts " + _DOUBTS
    if lexicon.complete:
        own = pages.mapInPandas(_read_pages(held, "noise"), kinds)
    else:
        # pages with a correction that hangs on the count of a rare word are read again, knowing which of those are words
        first = cut(pages.mapInPandas(_read_pages(held, "noise"), kinds))
        again = _refuted(first.select("src_table", "row_id", F.inline("doubts")), texts).groupBy("src_table", "row_id").agg(F.collect_set("word").alias("known"))
        second = pages.join(again, ["src_table", "row_id"]).mapInPandas(_read_pages(held, "noise"), kinds)
        own = first.join(again, ["src_table", "row_id"], "left_anti").unionByName(second)
    own = own.select("src_table", "row_id", F.explode("noise").alias("noise_kind"))
    headers = title_lines(texts).select("src_table", "row_id", F.lit("header").alias("noise_kind")).distinct()
    return own.unionByName(headers)


def repaired(texts: DataFrame) -> DataFrame:
    """src_table, row_id and text as continuous paragraphs parted by blank lines; a null text stays null, an empty one empty."""
    lexicon = learnt(texts)
    held = texts.sparkSession.sparkContext.broadcast(lexicon)
    titles = title_lines(texts).groupBy("src_table", "row_id").agg(F.collect_set("title").alias("titles"))
    pages = texts.select("src_table", "row_id", "file_id", "text").join(titles, ["src_table", "row_id"], "left")
    kinds = "src_table string, row_id long, text string, doubts " + _DOUBTS
    if lexicon.complete:
        return pages.mapInPandas(_read_pages(held, "text"), kinds).drop("doubts")
    first = cut(pages.mapInPandas(_read_pages(held, "text"), kinds))
    again = _refuted(first.select("src_table", "row_id", F.inline("doubts")), texts).groupBy("src_table", "row_id").agg(F.collect_set("word").alias("known"))
    second = pages.join(again, ["src_table", "row_id"]).mapInPandas(_read_pages(held, "text"), kinds)
    return first.join(again, ["src_table", "row_id"], "left_anti").unionByName(second).drop("doubts")

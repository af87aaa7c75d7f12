"""Evaluation passages leaking into training text.

The passages (a held-out set of fixed size) are normalised and joined into one generalised suffix automaton, compiled once into
sorted arrays. Corpus texts, normalised by the same function, stream through it, all texts of a batch side by side, with their longest
matching length tracked at every character. The stretches found are measured exactly in whole words, or in characters for
passages in Chinese; they can also be cut out of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
MIN_CHARS = 20
#: A text of which more than this share has leaked is given up whole when texts are cleaned.
MAX_SHARE = 0.5
#: Characters of passages in one automaton; a larger set of passages is worked off in several.
BLOCK_CHARS = 2_000_000
#: Characters of a text that are walked at once; longer texts are walked in pieces that overlap by the longest passage.
PIECE = 4096
_WORD = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")


def words(text: str) -> list[str]:
    """The words of a text, case folded, without punctuation."""
    return _WORD.findall((text or "").casefold())


class Automaton:
    """Generalised suffix automaton over strings; ``owners(state)`` are the strings with that state's substrings."""

    def __init__(self, texts: list[str], least: int = 1):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for t in texts:
            last = 0
            for c in t:
                last = self._extend(last, c)
        owners: list[set[int]] = [set() for _ in self.next]
        for i, t in enumerate(texts):
            s = 0
            for c in t:
                s = self.next[s][c]
                v = s
                while v > 0 and self.length[v] >= least and i not in owners[v]:
                    owners[v].add(i)
                    v = self.link[v]
        # transitions as (state << 21 | code point), in order; a missing one is looked up along the links
        arcs = sorted((s << 21 | ord(c), t) for s, to in enumerate(self.next) for c, t in to.items())
        self.arc, self.target = np.array(arcs, np.int64).reshape(-1, 2).T.copy()
        self.links, self.lengths = np.array(self.link, np.int64), np.array(self.length, np.int64)
        self.owners = [tuple(x) for x in owners]
        self.next = []

    def _extend(self, last: int, c: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # another string came this way
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: str, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def walk(self, points: np.ndarray, start: np.ndarray, stop: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The stretches points[start:stop] walked side by side: number of the stretch, end position, state and matching length wherever the length is ``least`` or more."""
        out = []
        order = np.argsort(start - stop, kind="stable")  # the longest first, so that those still running stay in front
        start, sizes = start[order], (stop - start)[order]
        state, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for k in range(int(sizes[0]) if len(sizes) and len(self.arc) else 0):
            live = int(np.searchsorted(-sizes, -k, side="left"))
            c = points[start[:live] + k]
            todo = np.arange(live)
            while len(todo):
                wanted = state[todo] << 21 | c[todo]
                slot = np.minimum(np.searchsorted(self.arc, wanted), len(self.arc) - 1)
                ok = self.arc[slot] == wanted
                state[todo[ok]] = self.target[slot[ok]]
                n[todo[ok]] += 1
                lost = todo[~ok]
                shorter = self.links[state[lost]]
                ended = shorter < 0
                n[lost[ended]] = 0
                todo = lost[~ended]
                state[todo] = shorter[~ended]
                n[todo] = self.lengths[state[todo]]
            far = np.flatnonzero(n[:live] >= least)
            if len(far):
                out.append((order[far], start[far] + k + 1, state[far], n[far]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4

    def stretches(self, ends: Iterator[tuple[int, int, int]], least: int) -> dict[int, list[tuple[int, int]]]:
        """Per string, the maximal common stretches (start, end) of one text, from (end, state, length) in order of the ends."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, v, m in ends:
            while v > 0 and m >= least:  # shorter suffixes may belong to further strings
                for i in self.owners[v]:
                    spans = found.setdefault(i, [])
                    if spans and spans[-1] == (end - m, end - 1):  # this stretch goes on
                        spans[-1] = (end - m, end)
                    elif not spans or spans[-1][1] != end:
                        spans.append((end - m, end))
                v = self.link[v]
                m = self.length[v]
        return found

    def matches(self, text: str, least: int) -> dict[int, list[tuple[int, int]]]:
        """Per string, the maximal common stretches of at least ``least`` characters as (start, end) in ``text``."""
        points = _points([text])
        _, end, state, n = self.walk(points, np.array([0]), np.array([len(points)]), least)
        return self.stretches(zip(end.tolist(), state.tolist(), n.tolist()), least)


def hashes(text: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every stretch of ``width`` code points; doubling keeps it to a few passes."""
    h = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    have, out, offset = 1, None, 0
    with np.errstate(over="ignore"):
        while width:
            if width & 1:
                part = h[offset:]
                out = part if out is None else out[: len(part)] * np.uint64(0xBF58476D1CE4E5B9) + part[: len(out)]
                offset += have
            width >>= 1
            if width:
                h = h[: max(0, len(h) - have)] * np.uint64(0x94D049BB133111EB) + h[have:]
                h ^= h >> np.uint64(31)
                have *= 2
    return out


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Finder:
    """The evaluation passages, compiled for streaming texts past them."""

    def __init__(self, passages: list[str], min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS):
        self.min_words, self.min_chars = min_words, min_chars
        self.words = [words(p) for p in passages]
        self.joined = ["".join(w) for w in self.words]
        self.han = [bool(_HAN.search(p)) for p in passages]
        # the shortest stretch, in characters, that any passage could be reported for
        least = [min_chars] if any(self.han) else []
        for w, han in zip(self.words, self.han):
            if not han:
                n = np.cumsum([0, *map(len, w)])
                if len(w) >= min_words:
                    least.append(int((n[min_words:] - n[:-min_words]).min()))
        self.least = max(1, min(least, default=min_chars))
        self.overlap = max(map(len, self.joined), default=0)
        self.automaton = Automaton(self.joined, self.least)

    def found(self, texts: list[str]) -> list[tuple[int, int, list[tuple[int, int]], np.ndarray]]:
        """Text number, passage number, stretches (start, end) in the joined words of the text that are long enough, and where its words start."""
        own = [words(t) for t in texts]
        joined = ["".join(w) for w in own]
        length = np.fromiter(map(len, joined), np.int64, len(joined))
        base = np.concatenate([[0], np.cumsum(length)])
        # pieces, each with as much before it as any stretch may reach back
        pieces = -(-length // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = base[owner] + number * PIECE
        stop = np.minimum(first + PIECE, base[owner + 1])
        start = np.maximum(first - self.overlap, base[owner])
        piece, end, state, n = self.automaton.walk(_points(joined), start, stop, self.least)
        new = end > first[piece]  # ends within the overlap were the piece's before
        at = np.lexsort((end[new], owner[piece[new]]))
        piece, end, state, n = piece[new][at], end[new][at], state[new][at], n[new][at]
        out = []
        edges = np.flatnonzero(np.diff(owner[piece], prepend=-1)).tolist() + [len(piece)]
        for a, b in zip(edges, edges[1:]):
            t = int(owner[piece[a]])
            begins = np.cumsum([0, *map(len, own[t])])
            inside = set(begins.tolist())
            for i, spans in self.automaton.stretches(zip((end[a:b] - base[t]).tolist(), state[a:b].tolist(), n[a:b].tolist()), self.least).items():
                long = [(x, y) for x, y in spans if self._long(i, joined[t], x, y, inside)]
                if long:
                    out.append((t, i, long, begins))
        return out

    def _long(self, i: int, joined: str, a: int, b: int, edges: set[int]) -> bool:
        if self.han[i]:
            return b - a >= self.min_chars
        stretch, passage = joined[a:b], self.joined[i]
        at = np.cumsum([0, *map(len, self.words[i])])
        start = passage.find(stretch)
        while start >= 0:
            inside = [x for x in at.tolist() if start <= x <= start + len(stretch)]
            # a border word counts only if the text, too, begins or ends a word there
            while inside and a + inside[0] - start not in edges:
                inside.pop(0)
            while inside and a + inside[-1] - start not in edges:
                inside.pop()
            if len(inside) > self.min_words:
                return True
            start = passage.find(stretch, start + 1)
        return False


def _blocks(items: DataFrame, min_words: int, min_chars: int) -> list:
    """A broadcast (finder, item ids by passage) per block of passages; each is bounded by BLOCK_CHARS."""
    spark = items.sparkSession
    rows = items.where("passage is not null").select("item_id", "passage")
    chars = rows.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    n = max(1, -(-chars // BLOCK_CHARS))
    out = []
    for k in range(n):
        passages: dict[str, list[int]] = {}
        for r in rows.where(F.pmod(F.xxhash64("passage"), F.lit(n)) == k).collect():
            passages.setdefault(r.passage, []).append(r.item_id)
        texts = sorted(passages)
        out.append(spark.sparkContext.broadcast((Finder(texts, min_words, min_chars), [sorted(passages[t]) for t in texts])))
    return out


def leaked(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and item_id of every text that shares an unbroken stretch of a passage.

    The stretch counts from ``min_words`` words, in Chinese passages ``min_chars`` characters; case, white space, line breaks
    and punctuation do not matter. A passage of several items counts for each. Null and empty texts or passages give
    no row; repeated documents each give theirs. The held-out items go to every task, in blocks of bounded size.
    """
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
    texts = docs.where("text is not null and text <> ''").select("doc_id", "text")

    def one(shared) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            finder, ids = shared.value
            for batch in batches:
                doc = batch["doc_id"].tolist()
                pairs = [(doc[t], item) for t, i, _, _ in finder.found(batch["text"].tolist()) for item in ids[i]]
                yield pd.DataFrame(pairs, columns=["doc_id", "item_id"])

        return texts.mapInPandas(run, kinds)

    return reduce(DataFrame.unionByName, map(one, _blocks(items, min_words, min_chars)))


def leaked_spans(text: str, finder: Finder) -> list[tuple[int, int]]:
    """The leaked stretches as (start, end) in the text itself, merged and in order; of passages not in Chinese from the start of the first whole word to the end of the last."""
    folded = [c.casefold() for c in text]
    source = np.repeat(np.arange(len(text)), [len(x) for x in folded])
    spots = [m.span() for m in _WORD.finditer("".join(folded))]
    at = source[np.concatenate([np.arange(a, b) for a, b in spots])] if spots else np.zeros(0, np.int64)
    spans = []
    for _, i, long, edges in finder.found([text]):
        for a, b in long:
            if not finder.han[i]:
                a, b = int(edges[np.searchsorted(edges, a)]), int(edges[np.searchsorted(edges, b, side="right") - 1])
            spans.append((int(at[a]), int(at[b - 1]) + 1))
    spans.sort()
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def cleaned(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, max_share: float = MAX_SHARE) -> DataFrame:
    """doc_id, text without its leaked stretches and share_removed, for every document.

    Stretches of ``min_words`` words (``min_chars`` characters) and more are cut out; a text of which more than ``max_share`` leaked is given
    up: its text is null and its share 1. Null texts stay null and empty ones empty, with share 0.
    """
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("gone"), F.length("text").alias("size"))
    for shared in _blocks(items, min_words, min_chars):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            finder = shared.value[0]
            for batch in batches:
                texts = batch["text"].tolist()
                hit = {t for t, *_ in finder.found([x or "" for x in texts])}
                gone = batch["gone"].tolist()
                for t in hit:
                    for a, b in reversed(leaked_spans(texts[t], finder)):
                        texts[t] = texts[t][:a] + texts[t][b:]
                        gone[t] += b - a
                yield batch.assign(text=texts, gone=gone)

        out = out.mapInPandas(run, out.schema)
    share = F.coalesce(F.col("gone") / F.nullif(F.col("size"), F.lit(0)), F.lit(0.0))
    return out.select("doc_id", F.when(share <= max_share, F.col("text")).alias("text"), F.round(F.when(share > max_share, 1.0).otherwise(share), 6).alias("share_removed"))


def leaks_by_item(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaked item: its suite and the number of corpus documents that hold it."""
    found = leaked(docs, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    return found.join(items.select("item_id", "suite"), "item_id").select("item_id", "suite", "n_docs")

"""Near-duplicate texts: all pairs whose sets of five-character sequences have a similarity of a half or more.

PartEnum signatures find the candidates. The domain of the sequences is partitioned by hash several times; the projection of a text on a part is
thinned to its least sequence in hash order, which is equal in two texts with their similarity as the probability. MINIMA parts form a first-level
group. Within a group subsets of the parts are enumerated; two texts meet if they agree in all parts of a subset. The
subsets are enumerated where the group is read, so that a text is sent once for each group, as one byte for each part and not as its signatures.
Beside them goes a piece of sketch, made of parts that no other group uses; meetings whose pieces and minima are too far apart are dropped on the spot,
the others are compared exactly. No sequence is left out for being common.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.leaks import hashes
from sitequarry.operators.components import components
from sitequarry.plans.session import stored

WIDTH = 5
MIN_CHARS = 40
#: First-level groups, and minima in each.
GROUPS, MINIMA = 4, 60
#: Texts of a group from which on so many minima must agree, and how many subsets of that size are enumerated.
SUBSETS = ((0, 5, 240), (1 << 24, 6, 600))
#: Words of a group's piece of sketch, two bits a minimum, and how many bits may differ in the first and in all: at one half 16 and 80 do.
WORDS, NEAR_FIRST, NEAR = 5, 28, 102
#: Bits that may differ in the first words together, by their number: at one half 32 and 48 do.
_NEAR_SOME = {1: NEAR_FIRST, 2: 48, 3: 68, WORDS: NEAR}
#: How many bits of the sketch and twice the minima may differ together: at one half 140 do, with a deviation of 11 to 13.
FAR = 172
#: Tasks that share the subsets of one group.
SHARES = 4
#: Texts whose subsets are sorted at once, bytes of a column held in memory, pairs compared at once, pieces of a column written at once.
_ROWS, _HELD, _PAIRS, _PIECES = 1 << 18, 1 << 22, 1 << 20, 1024
_HASHES = 4
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, _HASHES // 2 + 1, dtype=np.uint64) | np.uint64(1)
_EMPTY = np.uint32(0xFFFFFFFF)
_SLICE = 125


def normal(text: Column) -> Column:
    """Lower case, each run of white space one blank, outer blanks removed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of every sequence of all texts."""
    strings = texts.to_pylist()
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    owner = np.repeat(np.arange(len(strings)), length)
    h = hashes(points, WIDTH)
    inside = owner[: len(h)] == owner[WIDTH - 1 : WIDTH - 1 + len(h)]
    h = h[inside]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return owner[: len(inside)][inside], h


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


def _least(owner: np.ndarray, h: np.ndarray, texts: int, parts: int) -> np.ndarray:
    """Per text and part of the domain the least value of its sequences in that part; h has 32 random bits."""
    y = h.astype(np.uint64)
    y *= np.uint64(parts)
    value = y.astype(np.uint32)
    np.minimum(value, _EMPTY - np.uint32(1), out=value)
    y >>= np.uint64(32)
    at = owner * parts
    at += y.view(np.int64)
    least = np.full(texts * parts, _EMPTY)
    np.minimum.at(least, at, value)
    return least.reshape(texts, parts)


def _filled(least: np.ndarray) -> np.ndarray:
    """An empty part takes the value of another, in an order fixed for the part."""
    row, at = np.nonzero(least == _EMPTY)
    filled, attempt, parts = least.copy(), 0, least.shape[1]
    while len(row):
        attempt += 1
        donor = (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt * 0x632BE59BD9B4E019 % (1 << 64)) >> np.uint64(33)) % np.uint64(parts)
        value = least[row, donor.astype(np.int64)]
        good = value != _EMPTY
        filled[row[good], at[good]] = value[good]
        row, at = row[~good], at[~good]
    return filled


def _halves(h: np.ndarray, factor: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 32 bits."""
    x = h * factor
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return (x >> np.uint64(32)).astype(np.uint32), x.astype(np.uint32)


def _projections(owner: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """MINIMA bytes, and WORDS words of sketch, of every text for each group; the groups run along the first axis, the texts along the last."""
    parts, fine = GROUPS * MINIMA, GROUPS * WORDS * 32
    minima = np.concatenate([_filled(_least(owner, x, texts, parts // _HASHES)) for f in _FACTORS[:-1] for x in _halves(h, f)], axis=1)
    least = np.concatenate([_least(owner, x, texts, fine // 2) for x in _halves(h, _FACTORS[-1])], axis=1)
    # an empty part of the sketch takes a minimum of another group
    group, nth = np.divmod(np.arange(fine), WORDS * 32)
    donor = ((group + 1) * MINIMA + nth % (parts - MINIMA)) % parts
    x = least
    np.copyto(x, minima.take(donor, axis=1), where=x == _EMPTY)
    x ^= np.arange(fine, dtype=np.uint32) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    planes = [np.packbits(x & np.uint32(1 << k) != 0, axis=1).reshape(texts, GROUPS, -1) for k in (31, 30)]
    words = np.concatenate(planes, axis=2).view(np.uint64).transpose(1, 2, 0)
    small = (minima * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
    return small.reshape(texts, GROUPS, MINIMA).transpose(1, 2, 0), words


def _subsets(texts: int) -> list[tuple[int, ...]]:
    """The subsets of the minima that are enumerated in a group of so many texts, the same in every task."""
    agree, many = next((agree, many) for least, agree, many in reversed(SUBSETS) if texts >= least)
    rng, chosen = np.random.default_rng(agree), set()
    while len(chosen) < many:
        chosen.add(tuple(sorted(rng.choice(MINIMA, agree, replace=False).tolist())))
    return sorted(chosen)


class _Column:
    """Values that come piece by piece; beyond _HELD bytes they lie in a file of the task."""

    def __init__(self, kind: type) -> None:
        self.kind, self.size, self.held, self.file = kind, 0, [], None

    def add(self, piece: bytes) -> None:
        self.held.append(piece)
        self.size += len(piece)
        if self.size > _HELD and (self.file is None or len(self.held) >= _PIECES):
            self._write()

    def _write(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.write(b"".join(self.held))
        self.held = []

    def whole(self) -> np.ndarray:
        if self.file:
            self._write()
            self.file.flush()
            return np.memmap(self.file, self.kind, "r")
        self.held = [b"".join(self.held)]
        return np.frombuffer(self.held[0], self.kind)


def _runs(key: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of neighbours in a sorted key that differ in the last ``bits`` only: i, how many such follow each, and where these are; so many at a time that memory is bounded."""
    i = np.flatnonzero(key[1:] ^ key[:-1] < np.uint64(1 << bits))
    if not len(i):
        return
    last = np.flatnonzero(np.append(i[1:] != i[:-1] + 1, True))
    n = np.repeat(i[last] + 1, np.diff(last, prepend=-1)) - i
    total = np.cumsum(n)
    cuts = np.unique(np.searchsorted(total, np.arange(_PAIRS, total[-1] + _PAIRS, _PAIRS)).clip(max=len(i) - 1) + 1)
    for start, end in zip(np.append(0, cuts[:-1]), cuts):
        part, m = i[start:end], n[start:end]
        before = np.cumsum(m) - m
        yield part, m, np.arange(before[-1] + m[-1]) + np.repeat(part + 1 - before, m)


def _unique(pieces: list[np.ndarray]) -> np.ndarray:
    every = np.sort(np.concatenate(pieces))
    return every[np.append(True, every[1:] != every[:-1])] if len(every) else every


def _rounds(minima: list[np.ndarray], subsets: list[tuple[int, ...]]) -> Iterator[tuple[np.ndarray, list[tuple[int, ...]]]]:
    """Places of texts, and the subsets to be sorted among them: texts that agree in a subset agree in its first minimum."""
    if len(minima[0]) <= _ROWS:
        yield np.arange(len(minima[0])), subsets
        return
    for first in sorted({s[0] for s in subsets}):
        size = np.bincount(minima[first], minlength=256)
        turn = ((np.cumsum(size) - size) // _ROWS).astype(np.uint32)
        turns = turn[minima[first]]
        for t in np.unique(turn[size > 0]):
            yield np.flatnonzero(turns == t), [s for s in subsets if s[0] == first]


def _sorted(columns: list[np.ndarray], low: int) -> np.ndarray:
    """Sorted keys of five bytes, equal where the columns are, and the place in the last ``low`` bits; columns from the fifth on share a byte."""
    split = np.zeros((len(columns[0]), 8), np.uint8)
    for at, column in enumerate(columns[:5]):
        split[:, 7 - at] = column
    for nth, column in enumerate(columns[5:]):
        split[:, 3] += column * np.uint8(2 * nth + 101)
    key = split.view("<u8").ravel()
    key &= np.uint64((1 << 64) - (1 << low))
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    return key


def _near(key: np.ndarray, low: int, words: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Pairs of places, the lesser one in the upper half, of texts that share a key and whose sketches are near."""
    for i, n, j in _runs(key, low):
        mask, start, end = np.uint64((1 << low) - 1), i[0], j[-1] + 1
        # where each text is in several pairs, these lie side by side
        dense = len(j) > end - start
        if dense:
            place = (key[start:end] & mask).view(np.int64)
            a, b = np.repeat(i - start, n), j - start
        else:
            a, b = np.repeat((key[i] & mask).view(np.int64), n), (key[j] & mask).view(np.int64)
        bits = np.zeros(len(a), np.uint16)
        for nth, word in enumerate(words, 1):
            if dense and len(a) <= len(place):
                a, b, dense = place[a], place[b], False
            elif dense:
                word = word[place]
            bits += np.bitwise_count(word[a] ^ word[b])
            if nth in _NEAR_SOME:
                near = np.flatnonzero(bits <= _NEAR_SOME[nth])
                a, b, bits = a[near], b[near], bits[near]
        if dense:
            a, b = place[a], place[b]
        yield (np.minimum(a, b) << 32 | np.maximum(a, b)).view(np.uint64)


def _met(minima: list[np.ndarray], words: list[np.ndarray], subsets: list[tuple[int, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, each pair at least once, of the texts of one group that agree in one of the subsets and are near."""
    for chosen, mine in _rounds(minima, subsets):
        if len(chosen) < 2:
            continue
        # a round is larger where many texts have the same first minimum; what takes part is then fetched again for each subset
        small = len(chosen) <= 2 * _ROWS
        fetched = {q: minima[q][chosen] for q in {q for s in mine for q in s}} if small else {}
        word = [w[chosen] for w in words]
        low = max(24, len(chosen).bit_length())

        def near(pairs: np.ndarray) -> np.ndarray:
            a, b = (chosen[x.astype(np.int64)] for x in (pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)))
            far = np.zeros(len(a), np.uint16)
            for w in words:
                far += np.bitwise_count(w[a] ^ w[b])
            for m in minima:
                far += np.uint16(2) * (m[a] != m[b])
            return pairs[far <= FAR]

        known, met = np.empty(0, np.uint64), []
        for subset in mine:
            met += _near(_sorted([fetched[q] if small else minima[q][chosen] for q in subset], low), low, word)
            if sum(map(len, met)) > _PAIRS or subset is mine[-1]:
                known, met = _unique([known, near(_unique(met)) if met else known]), []
        if len(known):
            yield chosen[(known >> np.uint64(32)).astype(np.int64)], chosen[(known & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def prepared(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """id, norm and h, the 64-bit hash of norm, of the texts long enough to count; nulls and short texts are left out."""
    norm = chunks.select(F.col(key).alias("id"), normal(F.col(text)).alias("norm")).where(F.length("norm") >= MIN_CHARS)
    return norm.withColumn("h", F.xxhash64("norm"))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """One row per different text, h and norm, aggregated with map-side combine: copies, however many, meet no one as copies."""
    return texts.groupBy("h").agg(F.first("norm").alias("norm"))


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        owner, h = _shingles(part.column(1))
        minima, words = _projections(owner, h, part.num_rows)
        hashed = part.column(0).to_numpy().tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(GROUPS, dtype=np.int32)), pa.array([hashed] * GROUPS), pa.array([m.tobytes() for m in minima]), pa.array([w.tobytes() for w in words])],
            ["g", "h", "minima", "words"],
        )


def _meetings(share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs met in one share of the subsets of each group that comes."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[_Column]] = {}
        for batch in batches:
            for g, *pieces in zip(*(c.to_pylist() for c in batch.columns)):
                if g not in groups:
                    groups[g] = [_Column(np.int64), *(_Column(np.uint8) for _ in range(MINIMA)), *(_Column(np.uint64) for _ in range(WORDS))]
                n = len(pieces[0]) // 8
                split = [pieces[0], *(pieces[1][k * n : (k + 1) * n] for k in range(MINIMA)), *(pieces[2][k * 8 * n : (k + 1) * 8 * n] for k in range(WORDS))]
                for column, piece in zip(groups[g], split):
                    column.add(piece)
        for columns in groups.values():
            h, *rest = (c.whole() for c in columns)
            subsets = _subsets(len(h))
            for i, j in _met(rest[:MINIMA], rest[MINIMA:], subsets[len(subsets) * share // SHARES : len(subsets) * (share + 1) // SHARES]):
                for at in range(0, len(i), _PAIRS):
                    x, y = h[i[at : at + _PAIRS]], h[j[at : at + _PAIRS]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return meet


def _candidates(distinct: DataFrame) -> DataFrame:
    """a and b (hashes of texts, a < b) of the pairs that meet in a group and have near sketches there."""
    rows = distinct.select("h", "norm").mapInArrow(_projected, "g int, h binary, minima binary, words binary")
    # one exchange by group serves all shares
    rows = rows.repartitionById(GROUPS, "g")
    return reduce(DataFrame.union, (rows.mapInArrow(_meetings(k), "a long, b long") for k in range(SHARES))).distinct()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        unique, sizes = [], []
        for column in (2, 3):
            owner, h = _shingles(part.column(column))
            keys = owner.astype(np.uint64) << np.uint64(50) | h >> np.uint64(14)
            keys.sort()
            keys = keys[np.diff(keys, prepend=np.uint64(2**64 - 1)) != 0]
            unique.append(keys)
            sizes.append(np.bincount((keys >> np.uint64(50)).astype(np.int64), minlength=part.num_rows))
        both = np.concatenate(unique)
        both.sort()
        both = both[1:][both[1:] == both[:-1]]
        shared = np.bincount((both >> np.uint64(50)).astype(np.int64), minlength=part.num_rows)
        union = sizes[0] + sizes[1] - shared
        keep = pa.array(np.flatnonzero(2 * shared >= union))
        similarity = np.round(shared / np.maximum(union, 1), 6)
        yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(similarity).take(keep)], ["a", "b", "similarity"])


def similar_classes(texts: DataFrame) -> DataFrame:
    """a, b (hashes of texts, a < b) and similarity of the pairs of different texts that are alike; copies are one class."""
    distinct = distinct_texts(texts)
    text = lambda end: distinct.select(F.col("h").alias(end), F.col("norm").alias(f"{end}_text"))
    rows = _candidates(distinct).join(text("a"), "a").join(text("b"), "b").select("a", "b", "a_text", "b_text")
    return rows.mapInArrow(_compare, "a long, b long, similarity double")


def found(chunks: DataFrame) -> DataFrame:
    """id_a and id_b (id_a < id_b) of all pairs alike, copies among them.

    Null, empty and short texts take no part. Pairs of classes of copies are expanded into pairs of rows at the end only.
    """
    texts = prepared(chunks)
    # stored, as each reader would make the texts normal again
    members = stored(texts.select("h", "id"))
    x, y = members.toDF("a", "i"), members.toDF("b", "j")
    between = similar_classes(texts).select("a", "b").join(x, "a").join(y, "b").select("i", "j")
    within = x.join(y, F.col("a") == F.col("b")).where("i < j").select("i", "j")
    return between.union(within).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def groups(chunks: DataFrame) -> DataFrame:
    """One row per text that takes part: id, group_id (the least id among those it is linked to, directly or not), copies and links.

    ``copies`` counts the rows with its very text, ``links`` the other texts alike. A text like no other is its own group.
    """
    texts = prepared(chunks)
    # stored, as the components and the links would each run the search
    pairs = stored(similar_classes(texts).select("a", "b"))
    classes = texts.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    named = pairs.join(classes.select(F.col("h").alias("a"), F.col("first").alias("x")), "a").join(classes.select(F.col("h").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    group = components(named, "x", "y")
    links = named.select("x").union(named.select("y")).toDF("first").groupBy("first").agg(F.count(F.lit(1)).alias("links"))
    full = classes.join(group, classes["first"] == group["node"], "left").join(links, "first", "left")
    full = full.select("h", F.coalesce("component", "first").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return texts.select("id", "h").join(full, "h").select("id", "group_id", "copies", "links")

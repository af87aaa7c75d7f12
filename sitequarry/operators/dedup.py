"""Deduplication by key, against a store of known keys, and by SimHash."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of the 128 SimHash bits, and how many bits may differ: of fourteen blocks two at least are then equal.
BLOCKS, MAX_DISTANCE = 14, 12
#: Texts voted on, and pairs compared, at a time; rows with one value from which they are compared tile by tile.
_TEXTS, _PAIRS, _LONG, _TILE, _FEW = 1000, 1_000_000, 32, (256, 4096), 1024


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row with the least ``order`` of every key, aggregated with map-side combine; rows with a null key are dropped."""
    rest = F.struct(order, *[c for c in df.columns if c != order])
    return df.select(key.alias("key"), rest.alias("r")).where("key is not null").groupBy("key").agg(F.min_by("r", F.col(f"r.{order}")).alias("r")).select("key", "r.*")


def against_store(new: DataFrame, known: DataFrame, key: Column) -> DataFrame:
    """``new`` with is_known: whether its key is among those of ``known``. A null key is never known."""
    keys = known.select(key.alias("k")).where("k is not null").distinct().withColumn("hit", F.lit(True))
    return new.withColumn("k", key).join(keys, "k", "left").withColumn("is_known", F.coalesce("hit", F.lit(False))).drop("k", "hit")


def _partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _votes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and for each the 128 sums of its words' MD5 bits (1 or -1), rows of one id next to each other taken together."""
    word = batch.column(1).flatten().dictionary_encode()
    digests = np.frombuffer(b"".join(md5(w.encode()).digest() for w in word.dictionary.to_pylist()), np.uint8).reshape(-1, 16)
    sign = np.unpackbits(digests, axis=1).astype(np.int8) * 2 - 1
    begin = np.cumsum([0, *pc.list_value_length(batch.column(1)).to_numpy()[:-1]])
    ids = batch.column(0).to_numpy()
    first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    return ids[first], np.add.reduceat(sign[word.indices.to_numpy()], begin[first], axis=0, dtype=np.int64)


def simhash(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, hi and lo: 128 bits, each the sign of the votes of the words' MD5 bits, ties to 0; texts without words are left out.

    The texts are laid out by doc_id, and each is voted on in one place: its words are in no exchange.
    """
    words = F.regexp_extract_all(F.lower(F.make_valid_utf8(text)), F.lit(r"(?U)\w+"), F.lit(0))
    rows = docs.select("doc_id", F.col(text)).where("doc_id is not null").repartition(_partitions(docs), "doc_id").sortWithinPartitions("doc_id").select("doc_id", words.alias("w")).where("size(w) > 0")

    def packed(ids: np.ndarray, votes: np.ndarray) -> pa.RecordBatch:
        halves = np.packbits(votes > 0, axis=1).view(">i8").astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "hi", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, votes = np.zeros(0, np.int64), np.zeros((0, 128), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                more, counted = _votes(batch.slice(at, _TEXTS))
                if len(ids) and ids[-1] == more[0]:
                    counted[0] += votes[-1]
                    ids, votes = ids[:-1], votes[:-1]
                if len(ids):
                    yield packed(ids, votes)
                ids, votes = more, counted
        if len(ids):
            yield packed(ids, votes)

    return rows.mapInArrow(run, "doc_id long, hi long, lo long")


def _blocks(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The BLOCKS blocks of bits, a column each."""
    width = [128 // BLOCKS + (i < 128 % BLOCKS) for i in range(BLOCKS)]
    high, low, out, right = hi.view(np.uint64), lo.view(np.uint64), [], 128
    for n in width:
        right -= n
        if right >= 64:
            x = high >> np.uint64(right - 64)
        else:
            x = low >> np.uint64(right) | (high << np.uint64(64 - right) if right else np.uint64(0))
        out.append((x & np.uint64((1 << n) - 1)).astype(np.int32))
    return np.stack(out, axis=1) if len(hi) else np.zeros((0, BLOCKS), np.int32)


def _close(value: np.ndarray, hi: np.ndarray, lo: np.ndarray, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places x and y, and distance, of all near pairs with equal ``value``, each once. Long runs are compared tile by tile, short ones by their places."""
    order = np.argsort(value, kind="stable")
    ordered, high, low = value[order], hi[order].view(np.uint64), lo[order].view(np.uint64)
    turns = np.flatnonzero(np.diff(ordered, prepend=-1, append=-1))
    for begin, end in zip(turns[:-1], turns[1:]):
        if end - begin <= _LONG:
            continue
        for i in range(begin, end, _TILE[0]):
            for j in range(i, end, _TILE[1]):
                x, y = slice(i, min(i + _TILE[0], end)), slice(j, min(j + _TILE[1], end))
                distance = np.bitwise_count(high[x, None] ^ high[None, y]) + np.bitwise_count(low[x, None] ^ low[None, y])
                p, q = np.nonzero(distance <= max_distance)
                once = p + i < q + j
                p, q = p[once], q[once]
                yield order[p + i], order[q + j], distance[p, q]
    short = np.flatnonzero(np.repeat(np.diff(turns) <= _LONG, np.diff(turns)))
    after = np.searchsorted(ordered, ordered[short], "right") - short - 1  # how many equal ones come after each
    step = _PAIRS // _LONG
    for begin in range(0, len(short), step):
        n = after[begin : begin + step]
        x = np.repeat(short[begin : begin + step], n)
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + x + 1
        distance = np.bitwise_count(high[x] ^ high[y]) + np.bitwise_count(low[x] ^ low[y])
        near = distance <= max_distance
        yield order[x[near]], order[y[near]], distance[near]


def _near(block: int, ids: np.ndarray, hi: np.ndarray, lo: np.ndarray, max_distance: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows that agree in ``block`` and are near, if it is the first block in which they agree."""
    blocks = _blocks(hi, lo)
    # a few rows are all compared; near ones agree in a second block by themselves
    for second in range(block + 1, BLOCKS) if BLOCKS - max_distance > 1 and len(ids) > _FEW else (block,):
        for x, y, distance in _close(blocks[:, second], hi, lo, max_distance):
            equal = blocks[x] == blocks[y]
            once = ~equal[:, :block].any(axis=1) & ~equal[:, block + 1 : second].any(axis=1)
            a, b = ids[x[once]], ids[y[once]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(distance[once].astype(np.int32))], ["a", "b", "distance"])


def simhash_pairs(hashes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Class representatives a < b whose SimHashes differ in at most ``max_distance`` bits, with the distance.

    Texts with equal SimHash are one class, named by its least doc_id. Exact: of ``BLOCKS`` blocks of bits BLOCKS - max_distance are equal in every two
    such hashes. A hash is sent once for each block that may be the first equal one; the second is sought where those meet, so that only one copy
    a block is in the exchange, and a pair comes out at its first two equal blocks only.
    """
    classes = hashes.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "hi", "lo")
    firsts = BLOCKS - max(1, BLOCKS - max_distance) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hi, lo = (batch.column(i).to_numpy() for i in range(3))
            key = _blocks(hi, lo)[:, :firsts] + (np.arange(firsts, dtype=np.int32) << 16)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(pa.array(np.repeat(x, firsts)) for x in (ids, hi, lo))], ["key", "doc_id", "hi", "lo"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            turns = [0, *np.flatnonzero(np.diff(columns[0])) + 1, batch.num_rows]
            for begin, end in zip(turns, turns[1:]):
                if held and end > begin and held[0][0][0] != columns[0][begin]:
                    yield from done(held)
                    held = []
                if end > begin:
                    held.append([c[begin:end] for c in columns])
        if held:
            yield from done(held)

    def done(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, *rest = (np.concatenate(c) for c in zip(*held))
        return _near(int(key[0]) >> 16, *rest, max_distance)

    rows = classes.mapInArrow(cut, "key int, doc_id long, hi long, lo long")
    return rows.repartition(_partitions(rows), "key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long, distance int")


def simhash_classes(hashes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per hashed text: doc_id, class_id (the least doc_id with its SimHash), copies (texts of the class) and links.

    ``links`` counts the other classes within ``max_distance`` bits, by class as ``simhash_pairs`` gives them.
    """
    classes = hashes.groupBy("hi", "lo").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    pairs = simhash_pairs(hashes, max_distance)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return hashes.join(classes, ["hi", "lo"]).join(links, "class_id", "left").select("doc_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))

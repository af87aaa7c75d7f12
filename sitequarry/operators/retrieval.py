"""Batch retrieval: lexical (BM25) and dense top-k, rank and score fusion, context packing. Every query of a set is answered in one job."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import md5
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.text import token_counts
from sitequarry.plans.session import stored

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


# --- lexical -------------------------------------------------------------------------------------------------------


_ROWS = 1000


def _texts(ids: list, counts: list[dict[str, int]], kind: pa.DataType) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
    tokens, tf = (pa.ListArray.from_arrays(ends, pa.array(list(chain.from_iterable(x)), t)) for x, t in ((counts, pa.string()), ((c.values() for c in counts), pa.int32())))
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), tokens, tf], ["doc_id", "tokens", "tf"])


def tokenised(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, tokens and tf (arrays side by side): one row a text, the rows of one key taken together. Texts without tokens have no row."""
    spark = docs.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).alias("doc_id"), F.make_valid_utf8(F.lower(text)).alias("text")).where("text is not null").repartition(n, "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, kind = [], [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = token_counts(low)
                if not found:
                    continue
                if ids and ids[-1] == key:
                    counts[-1].update(found)
                    continue
                if len(ids) == _ROWS:
                    yield _texts(ids, counts, kind)
                    ids, counts = [], []
                ids.append(key)
                counts.append(found)
        if ids:
            yield _texts(ids, counts, kind)

    return rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, tokens array<string>, tf array<int>")


def exploded(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", F.explode(F.arrays_zip("tokens", "tf")).alias("p")).select("doc_id", F.col("p.tokens").alias("token"), F.col("p.tf").alias("tf"))


def postings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, token and tf. Texts without tokens have no postings."""
    return exploded(tokenised(docs, text, key))


def by_text(posts: DataFrame, value: str = "tf") -> DataFrame:
    """One row a text, as ``tokenised`` gives them, of postings."""
    pairs = posts.groupBy("doc_id").agg(F.collect_list(F.struct("token", value)).alias("p"))
    return pairs.select("doc_id", F.col("p.token").alias("tokens"), F.col(f"p.{value}").alias(value))


@dataclass(frozen=True)
class Index:
    """Stored texts (doc_id, tokens, tf) and what follows from them; the corpus is scanned and tokenised once, when they are stored."""

    texts: DataFrame

    @property
    def posts(self) -> DataFrame:
        return exploded(self.texts)

    @property
    def lengths(self) -> DataFrame:
        """doc_id and dl, the number of tokens of the text."""
        return self.texts.select("doc_id", F.aggregate("tf", F.lit(0).cast("long"), lambda n, x: n + x).alias("dl"))

    @property
    def corpus(self) -> DataFrame:
        """One row: n_docs, avgdl, min_dl, max_dl."""
        return self.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"), F.min("dl").alias("min_dl"), F.max("dl").alias("max_dl"))

    @property
    def terms(self) -> DataFrame:
        """token, df and idf; a negative idf becomes EPSILON times the mean idf of all terms."""
        df = self.texts.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        n_docs = F.broadcast(self.texts.agg(F.count(F.lit(1)).alias("n_docs")))  # one row
        raw = df.join(n_docs).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw").alias("mean"))
        return raw.join(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Index:
    """An index whose texts are stored in the cluster's shared folder."""
    return Index(stored(tokenised(docs, text, key)))


BUCKETS = 16


def write_index(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", append: bool = False) -> None:
    """Stores postings as a table in ``path``, by bucket of tokens; texts appended must be new, their postings are added beside the others."""
    rows = postings(docs, text, key).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.mode("append" if append else "overwrite").partitionBy("bucket").parquet(os.path.join(path, "postings"))


def read_index(spark, path: str, tokens: list[str] | None = None) -> Index:
    """A stored index; with ``tokens`` only their buckets are read."""
    rows = spark.read.parquet(os.path.join(path, "postings"))
    if tokens is not None:
        buckets = [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "token string").select(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(buckets) & F.col("token").isin(list(tokens)))
    return Index(by_text(rows))


class _Best:
    """The ``k`` largest rounded scores of each of ``n`` queries so far, ties by id. Unused places have minus infinity."""

    def __init__(self, n: int, k: int, digits: int):
        self.k, self.digits = k, digits
        self.score, self.of = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, score: np.ndarray, of: np.ndarray, least: float = -np.inf) -> None:
        """``score`` has a row for each of ``queries`` and a column for each id in ``of``; only scores from ``least`` on count.

        Most scores are far below the worst one kept and are only compared with it; the others are rounded and sorted.
        """
        k, slack, begin = self.k, 2 * 10.0**-self.digits, 0  # a score a little below may tie with the worst one when both are rounded
        while begin < len(of):
            first = np.isinf(self.score[queries, 0]).all()
            end = begin + 4 * k if first else len(of)  # a few at first, so that there is something to compare with
            floor = np.maximum(self.score[queries, -1] - slack, least / 2)
            row, column = np.nonzero(score[:, begin:end] >= floor[:, None])
            column += begin
            value, ids, begin = np.round(score[row, column], self.digits), of[column], end
            worst, last = self.score[queries[row], -1], self.of[queries[row], -1]
            better = ((value > worst) | (value == worst) & (ids < last)) & (value >= least)
            row, value, ids = row[better], value[better], ids[better]
            touched = np.unique(row)
            before = queries[touched]
            row, value, ids = np.concatenate([row, np.repeat(touched, k)]), np.concatenate([value, self.score[before].ravel()]), np.concatenate([ids, self.of[before].ravel()])
            order = np.lexsort((ids, -value, row))
            row = row[order]
            kept = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
            self.score[before], self.of[before] = value[kept].reshape(-1, k), ids[kept].reshape(-1, k)

    def rows(self, ids: np.ndarray) -> pd.DataFrame:
        used = np.isfinite(self.score)
        return pd.DataFrame({"query_id": np.repeat(ids, used.sum(axis=1)), "doc_id": self.of[used], "score": self.score[used]})


def _tasks(df: DataFrame) -> int:
    """In how many tasks rows go past the queries. Each gives the best of every query, so they are as few as keep all cores busy, more for large inputs."""
    spark = df.sparkSession
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


#: A block of queries; what a posting costs in a sum by place, in multiply-adds of a matrix product.
_QUERIES, _DENSE = 2048, 300
#: Places added up at a time.
_PLACES = 2_000_000


def _expanded(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of low, low + 1, ..., low + n - 1, one range after the other."""
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


def _sums(asked: tuple[np.ndarray, np.ndarray, np.ndarray], queries: int, text: np.ndarray, code: np.ndarray, w: np.ndarray, texts: int) -> np.ndarray:
    """Sums of weight * w over the tokens in common, a row a query, a column a text.

    ``asked`` has the code, query and weight of the queries' terms by code. Tokens that many queries and many texts have are multiplied as matrices, the others added place by place.
    """
    have, code = np.unique(code, return_inverse=True)
    low, high = (np.searchsorted(asked[0], have, side) for side in ("left", "right"))
    n = high - low
    common = n * np.bincount(code, minlength=len(have)) * _DENSE > queries * texts
    column, many = np.cumsum(common) - 1, int(common.sum())
    at = _expanded(low[common], n[common])
    left = np.bincount(asked[1][at] * many + np.repeat(np.arange(many), n[common]), asked[2][at], queries * many).reshape(queries, many)
    held = common[code]
    right = np.bincount(text[held] * many + column[code[held]], w[held], texts * many).reshape(texts, many)
    total = left @ right.T if many else np.zeros((queries, texts))
    rest = np.flatnonzero(~held & (n[code] > 0))
    ends = np.searchsorted(np.cumsum(n[code[rest]]), np.arange(_PLACES, n[code[rest]].sum() + _PLACES, _PLACES), side="right")
    begin = 0
    for end in np.unique(np.maximum(ends, 1)) if len(rest) else ():
        some = rest[begin:end]
        begin = end
        m = n[code[some]]
        at = _expanded(low[code[some]], m)
        total += np.bincount(asked[1][at] * texts + np.repeat(text[some], m), np.repeat(w[some], m) * asked[2][at], queries * texts).reshape(queries, texts)
    return total


def matched(wanted: DataFrame, posts: DataFrame, k: int, block: int = 4_000_000) -> DataFrame:
    """``matched_texts`` for postings: doc_id, token and w."""
    return matched_texts(wanted, by_text(posts.withColumn("w", F.col("w").cast("double")), "w"), k, block)


def matched_texts(wanted: DataFrame, texts: DataFrame, k: int, block: int = 4_000_000) -> DataFrame:
    """query_id, doc_id, score and rank: the ``k`` texts of each query with the largest positive sums of qw * w over the tokens in common, ties by doc_id.

    ``wanted`` has query_id, token and qw, ``texts`` doc_id, tokens and w. The queries, about ``block`` of their terms at a time, go past all texts: a task adds
    up the scores of a few thousand texts at once and keeps the best of each query, and only these are shuffled. So a token that a third of all texts
    have is no key of any exchange. Texts, and queries, with mostly ASCII tokens are taken together, as those of different scripts share few tokens.
    """
    spark = wanted.sparkSession
    wanted = stored(wanted.select("query_id", "token", F.col("qw").cast("double").alias("qw")))
    rounds = max(1, -(-wanted.count() // block))
    rows = texts.select("doc_id", "tokens", "w")
    rows = rows.coalesce(_tasks(rows))

    def one(number: int) -> DataFrame:
        part = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == number).toArrow().combine_chunks()
        token = pc.unique(part["token"])
        code = pc.index_in(part["token"], token).to_numpy().astype(np.int64)
        latin = np.fromiter((t.isascii() for t in token.to_pylist()), bool, len(token))
        ids, query = np.unique(part["query_id"].to_numpy(), return_inverse=True)
        mostly = 2 * np.bincount(query, latin[code], len(ids)) > np.bincount(query, minlength=len(ids))
        by_script = np.argsort(mostly, kind="stable")
        ids, place = ids[by_script], np.empty(len(ids), np.int64)
        place[by_script] = np.arange(len(ids))
        query, weight, blocks, turn = place[query], part["qw"].to_numpy(), [], int((~mostly).sum())
        ends = sorted({*range(_QUERIES, len(ids), _QUERIES), turn, len(ids)} - {0})
        for begin, end in zip([0, *ends], ends):
            own = np.flatnonzero((query >= begin) & (query < end))
            own = own[np.argsort(code[own], kind="stable")]
            blocks.append((begin, end, begin >= turn, (code[own].astype(np.int32), (query[own] - begin).astype(np.int32), weight[own])))
        held = spark.sparkContext.broadcast((ids, token, latin, blocks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, token, latin, blocks = held.value
            best = _Best(len(ids), k, 6)
            for batch in batches if len(ids) else ():
                for at in range(0, batch.num_rows, 2 * _QUERIES):
                    some = batch.slice(at, 2 * _QUERIES)
                    of, text = some.column(0).to_numpy(), np.repeat(np.arange(some.num_rows), pc.list_value_length(some.column(1)).to_numpy())
                    code = pc.index_in(some.column(1).flatten(), token)
                    have = code.is_valid().to_numpy(zero_copy_only=False)
                    text, code, w = text[have], code.fill_null(0).to_numpy()[have].astype(np.int64), some.column(2).flatten().to_numpy()[have]
                    mostly = 2 * np.bincount(text, latin[code], len(of)) > np.bincount(text, minlength=len(of))
                    for begin, end, script, asked in blocks:
                        for side in (script, not script):  # first where the best are likely
                            own = mostly == side
                            chosen = own[text]
                            if len(of[own]):
                                total = _sums(asked, end - begin, (np.cumsum(own) - 1)[text[chosen]], code[chosen], w[chosen], len(of[own]))
                                best.add(np.arange(begin, end), total, of[own], least=1e-6)
            yield pa.RecordBatch.from_pandas(best.rows(ids), preserve_index=False)

        return rows.mapInArrow(run, "query_id long, doc_id long, score double")

    return ranked(reduce(DataFrame.unionByName, map(one, range(rounds))), k)


def bm25(queries: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """query_id, doc_id, score and rank: the ``k`` best texts of each query with a positive score, ties by doc_id.

    ``queries`` has query_id, token and qtf, how often the query has the token. Scores are exact, over all postings of all the queries' tokens.
    """
    wanted = queries.join(index.terms.select("token", "idf"), "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("qw"))
    avg = F.broadcast(index.corpus.select("avgdl"))  # one row
    dl = F.aggregate("tf", F.lit(0).cast("long"), lambda n, x: n + x)
    norm = K1 * (1 - B + B * dl / F.col("avgdl"))  # once a text: within a function of the elements it would be worked out for each
    w = F.zip_with("tf", F.array_repeat(norm, F.size("tf")), lambda tf, n: tf * (K1 + 1) / (tf + n))
    return matched_texts(wanted, index.texts.join(avg).select("doc_id", "tokens", w.alias("w")), k)


def ranked(scores: DataFrame, k: int | None = None, by: str = "score") -> DataFrame:
    """``rank`` per query by falling score, ties by doc_id; the best ``k`` only if given."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "doc_id")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


# --- dense ---------------------------------------------------------------------------------------------------------


def _matrix(embedding: pa.Array) -> np.ndarray:
    """One row a vector; all have the same length."""
    values = embedding.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(len(embedding), -1) if len(embedding) else np.zeros((0, 0))


def dense(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 65536, by: str | None = None) -> DataFrame:
    """query_id, doc_id, score and rank by inner product, exact: the stated queries, ``block`` of them at a time, past all rows.

    A block of queries goes to every task; a task keeps the ``k`` best a query of all the vectors it reads, and only these are shuffled. Both
    inputs have id and embedding; rows with a null or empty one take no part. With ``by``, a column of small numbers of the vectors, the ``k``
    best of each of its values are kept and ranked by themselves; rows where it is null are left out.
    """
    spark = queries.sparkSession
    asked = stored(queries.where("size(embedding) > 0").select("id", "embedding"))
    rows = vectors.where("size(embedding) > 0").select("id", "embedding", (F.col(by).cast("int") if by else F.lit(0)).alias("part")).where("part is not null")
    rows = rows.coalesce(_tasks(rows))
    rounds = max(1, -(-asked.count() // block))

    def one(number: int) -> DataFrame:
        chosen = asked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == number).toArrow().combine_chunks()
        held = spark.sparkContext.broadcast((chosen["id"].to_numpy(), _matrix(chosen["embedding"].combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            best: dict[int, _Best] = {}
            for batch in batches if len(ids) else ():
                for at in range(0, batch.num_rows, _QUERIES):
                    some = batch.slice(at, _QUERIES)
                    of, part, right = some.column("id").to_numpy(), some.column("part").to_numpy(), _matrix(some.column("embedding"))
                    for number in np.unique(part).tolist():
                        kept, own = best.setdefault(number, _Best(len(ids), k, 5)), part == number
                        for begin in range(0, len(ids), _QUERIES):
                            queries = np.arange(begin, min(begin + _QUERIES, len(ids)))
                            kept.add(queries, matrix[queries] @ right[own].T, of[own])
            for number, kept in best.items():
                out = kept.rows(ids)
                yield pa.RecordBatch.from_pandas(out.assign(part=np.full(len(out), number, np.int32)), preserve_index=False)

        return rows.mapInArrow(run, "query_id long, doc_id long, score double, part int")

    out = one(0)
    for number in range(1, rounds):
        out = out.unionByName(one(number))
    w = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "doc_id")
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumnRenamed("part", by) if by else out.drop("part")


DIMENSIONS = 64


def hashed_embeddings(posts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``embedded`` for postings: doc_id, token and tf."""
    return embedded(by_text(posts), dimensions)


def embedded(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """id and embedding of every text with tokens: its tokens hashed into ``dimensions`` signed places, weighted by their counts, at length 1.

    Place and sign come from the token's MD5, so that they are the same everywhere. A text whose counts cancel out has the zero vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            text = np.repeat(np.arange(n), pc.list_value_length(batch.column(1)).to_numpy())
            token = batch.column(1).flatten().dictionary_encode()
            digits = [md5(t.encode()).hexdigest() for t in token.dictionary.to_pylist()]
            place, sign = np.array([int(x[:4], 16) % dimensions for x in digits], np.int64), np.array([1 if int(x[4], 16) < 8 else -1 for x in digits], np.int64)
            code = token.indices.to_numpy()
            raw = np.bincount(text * dimensions + place[code], sign[code] * batch.column(2).flatten().to_numpy(), n * dimensions).reshape(n, dimensions)
            length = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
            vectors = np.divide(raw, length, out=np.zeros_like(raw), where=length > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dimensions, pa.int32()), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "embedding"])

    return texts.select(F.col("doc_id").alias("id"), "tokens", "tf").mapInArrow(run, f"id {texts.schema['doc_id'].dataType.simpleString()}, embedding array<double>")


def norms(vectors: DataFrame) -> DataFrame:
    """One row: count, dimension, mean, population deviation, least and greatest norm."""
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    r = lambda c: F.round(c, 5)
    return vectors.select(n.alias("n"), F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n_vectors"), F.max("d").alias("dim"), r(F.avg("n")).alias("mean_norm"), r(F.stddev_pop("n")).alias("std_norm"), r(F.min("n")).alias("min_norm"), r(F.max("n")).alias("max_norm"))


def similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """cosine, dot and negative Euclidean distance of two vector columns; a zero vector has cosine 0."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    dot, na, nb = product(a, b), F.sqrt(product(a, a)), F.sqrt(product(b, b))
    gap = F.aggregate(F.zip_with(a, b, lambda u, v: (u.cast("double") - v.cast("double")) * (u.cast("double") - v.cast("double"))), F.lit(0.0), lambda s, z: s + z)
    return pairs.select("*", F.round(F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(0.0), 5).alias("cosine"), F.round(dot, 5).alias("dot"), F.round(-F.sqrt(gap), 5).alias("neg_euclidean"))


# --- fusion --------------------------------------------------------------------------------------------------------


def _stacked(parts: list[DataFrame]) -> DataFrame:
    """All rows of the lists, laid out anew: each list may lie in its own number of partitions."""
    return reduce(DataFrame.unionByName, parts).repartition("query_id", "doc_id")


def rrf(lists: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """query_id, doc_id, score, sources, rank: the weighted sum of 1 / (k + rank) over the lists. A list may lack a text, or be empty."""
    parts = [d.select("query_id", "doc_id", F.lit(name).alias("src"), (F.lit((weights or {}).get(name, 1.0)) / (k + F.col("rank"))).alias("s")) for name, d in lists.items()]
    return ranked(_stacked(parts).groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 8).alias("score"), F.array_sort(F.collect_set("src")).alias("sources")))


def minmax(value: Column, over: Window) -> Column:
    """Scaled to 0..1 within the window; 1 where all values are equal."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high == low, 1.0).otherwise((value - low) / (high - low))


def weighted(lists: dict[str, DataFrame], weights: dict[str, float], per_list: bool = False, bonus: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: weighted sum of min-max scaled scores.

    Scaled over the union with missing scores as 0, or (``per_list``) within each list, a missing text adding nothing;
    ``bonus`` is added to a list's scaled scores before weighting.
    """
    w = Window.partitionBy("query_id")
    if per_list:
        parts = [d.select("query_id", "doc_id", (F.lit(weights[n]) * (minmax(F.col("score"), w) + (bonus or {}).get(n, 0.0))).alias("s")) for n, d in lists.items()]
        return ranked(_stacked(parts).groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score")))
    wide = None
    for n, d in lists.items():
        side = d.select("query_id", "doc_id", F.col("score").alias(n))
        wide = side if wide is None else wide.join(side, ["query_id", "doc_id"], "full")
    wide = wide.fillna(0.0, subset=list(lists))
    total = sum((F.lit(weights[n]) * minmax(F.col(n), w) for n in lists), F.lit(0.0))
    return ranked(wide.select("query_id", "doc_id", F.round(total, 6).alias("score")))


def tiers(hits: DataFrame, k: int) -> DataFrame:
    """Of ranked hits in tiers (tier 0 first), those of a tier count only while the tiers before have fewer than ``k``; the best ``k`` by score."""
    per = hits.groupBy("query_id", "tier").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    w = Window.partitionBy("query_id").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    open_ = per.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < k).select("query_id", "tier")
    best = Window.partitionBy("query_id", "tier").orderBy(F.desc("score"), "doc_id")
    kept = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r").join(open_, ["query_id", "tier"])
    return ranked(kept, k)


def pack(rows: DataFrame, budget: int, text: str = "content") -> DataFrame:
    """Rows of a query in rank order while their running length stays within ``budget``; used_chars is the running length."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used_chars", F.sum(F.coalesce(F.length(text), F.lit(0))).over(w)).where(F.col("used_chars") <= budget)


def overlap_rerank(candidates: DataFrame, k: int = 5) -> DataFrame:
    """A scorer that needs no model: the share of the query's distinct tokens that the text has; ties by the former rank."""
    share = F.size(F.array_intersect("q_tokens", "d_tokens")) / F.greatest(F.size(F.array_distinct("q_tokens")), F.lit(1))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank", "doc_id")
    scored = candidates.select("query_id", "doc_id", "rank", F.round(share, 6).alias("rerank_score"))
    return scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k).select("query_id", "doc_id", "rerank_score", "new_rank")

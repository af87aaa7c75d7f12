"""Encoding of whole texts with a public byte-level BPE vocabulary.

The corpus is cut into words by the vocabulary's own pattern inside the JVM. The most frequent words
(counted over all texts) are compiled, with their token ids, into a minimal acyclic transducer: a
shared-suffix automaton whose transitions carry partial sums, so that the sum along a word's path numbers the word in
the table of ids. Spark ships the automaton as files and tasks map them into memory; words that it does not hold are
merged exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm import words

#: Fixed value: the word pattern of the byte-level vocabularies, with Unicode white space in Java's syntax.
WORDS = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words in the automaton; a bound on its size, never on what is encoded.
LEXICON_WORDS = 32768


def merger(ranks: bytes):
    """The exact encoder of single words (bytes to ids) for a vocabulary file of ranks."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    # words come cut already, so the pattern takes each whole
    encode = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={}).encode_ordinary
    return lambda word: encode(word.decode())


# --- the automaton -------------------------------------------------------------------------------------------------


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of ``words``, packed into arrays, and the ids by word number.

    Words are added in byte order; a state whose subtree is finished is replaced by an equal one already
    registered, which shares suffixes. ``arc`` holds the transitions, as state * 256 + byte, in order.
    """
    order = sorted(words)
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states of the last word
    last = b""

    def settle(depth: int, word: bytes) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], tuple(edges[state].items()))
            edges[path[-1]][word[len(path) - 1]] = register.setdefault(key, state)

    for word in order:
        common = len(os.path.commonprefix([word, last]))
        settle(common, last)
        for b in word[common:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][b] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    settle(0, last)

    count: dict[int, int] = {}  # words below a state
    live = [0]
    seen = {0}
    for s in live:  # the list grows while it is walked
        for t in edges[s].values():
            if t not in seen:
                seen.add(t)
                live.append(t)

    def words_below(root: int) -> int:
        stack = [root]
        while stack:
            s = stack[-1]
            todo = [t for t in edges[s].values() if t not in count]
            if todo:
                stack += todo
            else:
                stack.pop()
                count[s] = final[s] + sum(count[t] for t in edges[s].values())
        return count[root]

    words_below(0)
    number = {s: i for i, s in enumerate(live)}
    rows = []
    for s in live:
        below = int(final[s])
        for b, t in sorted(edges[s].items()):
            rows.append((number[s] << 8 | b, number[t], below))
            below += count[t]
    arc, target, add = np.array(sorted(rows), np.int64).reshape(-1, 3).T.copy()
    lengths = np.array([len(words[w]) for w in order], np.int64)
    return {
        "arc": arc, "target": target.astype(np.int32), "add": add.astype(np.int32), "final": np.array([final[s] for s in live]),
        "start": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), "ids": np.array([i for w in order for i in words[w]], np.int32),
    }


def find_words(lexicon: dict[str, np.ndarray], data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Word numbers (-1: not held) of the byte strings data[start:stop], all walked through the automaton together."""
    n = len(start)
    state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive = np.arange(n)
    length, k, arcs = stop - start, 0, np.asarray(lexicon["arc"])
    out = np.full(n, -1, np.int64)
    if not len(arcs):
        return out
    while len(alive):
        done = length[alive] == k
        ended = alive[done]
        out[ended] = np.where(lexicon["final"][state[ended]], number[ended], -1)
        alive = alive[~done]
        if not len(alive):
            break
        wanted = state[alive] << 8 | data[start[alive] + k]
        slot = np.minimum(np.searchsorted(arcs, wanted), len(arcs) - 1)
        ok = arcs[slot] == wanted
        alive, slot = alive[ok], slot[ok]
        number[alive] += lexicon["add"][slot]
        state[alive] = lexicon["target"][slot]
        k += 1
    return out


def _share(df: DataFrame, lexicon: dict[str, np.ndarray]):
    """A loader of the automaton for tasks: Spark ships one file an array to every machine, and tasks map it into memory."""
    context, prefix = df.sparkSession.sparkContext, f"lexicon-{uuid.uuid4().hex}"
    for name, array in lexicon.items():
        path = os.path.join(SparkFiles.getRootDirectory(), f"{prefix}-{name}.npy")
        np.save(path, array)
        context.addFile(path)
    names = list(lexicon)
    return lambda: {n: np.load(SparkFiles.get(f"{prefix}-{n}.npy"), mmap_mode="r") for n in names}


# --- over a corpus -------------------------------------------------------------------------------------------------


def words_of(text) -> F.Column:
    """The words of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each word occurs in all texts: word, n. Counted per batch first, so the shuffle carries few rows."""
    return words.counts(docs, words_of(F.col(text)))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``key`` and ``ids``, the token ids of each whole text, without special tokens.

    An empty or a null text has the empty list; repeated rows come out as often as they come in. White
    space is text. Extra columns are not read.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    merge = merger(ranks)
    frequent = [r.word for r in word_counts(docs, text).orderBy(F.desc("n"), "word").limit(lexicon_words).select("word").collect()]
    lexicon = compile_lexicon({w: merge(w) for w in (x.encode() for x in frequent)})
    load, held = _share(docs, lexicon), docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, exact, learnt = load(), None, {}
        for batch in batches:
            lists = batch.column(1)
            lists = lists.fill_null([]) if lists.null_count else lists
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.flatten()
            coded = flat.dictionary_encode() if len(flat) else None
            if coded is None:
                counts, ids = np.zeros(len(lists), np.int64), np.zeros(0, np.int32)
            else:
                entries, code = coded.dictionary, coded.indices.to_numpy()
                buffers = entries.buffers()
                wide = np.int64 if pa.types.is_large_string(entries.type) else np.int32
                at = np.frombuffer(buffers[1], wide)[entries.offset : entries.offset + len(entries) + 1].astype(np.int64)
                number = find_words(lex, np.frombuffer(buffers[2], np.uint8), at[:-1], at[1:])
                known = number >= 0
                first = np.where(known, lex["start"][number], 0)
                n = np.where(known, lex["start"][number + 1] - lex["start"][number], 0)
                table = lex["ids"]
                missing = np.flatnonzero(~known)
                if len(missing):
                    exact = exact or merger(held.value)
                    extra, end = [], len(table)
                    for i in missing.tolist():
                        word = entries[i].as_py()
                        if word not in learnt:
                            if len(learnt) > 100_000:
                                learnt.clear()
                            learnt[word] = exact(word.encode())
                        first[i], n[i] = end, len(learnt[word])
                        extra += learnt[word]
                        end += len(learnt[word])
                    table = np.concatenate([table, np.array(extra, np.int32)])
                per = n[code]
                ends = np.cumsum(per)
                total = int(ends[-1])
                # position of every id in the table: the word's first one plus the place within the word
                place = np.arange(total) + np.repeat(first[code] - (ends - per), per)
                ids = table[place]
                upto = np.concatenate([[0], ends])
                counts = upto[offsets[1:] - offsets[0]] - upto[offsets[:-1] - offsets[0]]
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], [key, "ids"])

    cut = docs.select(F.col(key), words_of(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    return cut.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def tokens_by_source(docs: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """Documents and tokens per value of ``by``: a null value is a group of its own, texts without content add no tokens."""
    numbered = docs.select(by, text).withColumnRenamed(by, "_by")
    ids = encode(numbered.withColumnRenamed(text, "_text"), key="_by", text="_text")
    return ids.groupBy(F.col("_by").alias(by)).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).cast("long").alias("n_tokens"))

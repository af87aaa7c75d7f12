import random

import numpy as np
import pyarrow as pa

from sitequarry.llm import neardup as N


def grams(t):
    t = " ".join(t.lower().split())
    return {t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 40 else None


def made(n=60, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows, i = [], 0
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(60)]
        for edits in (0, 0, 3, 9, 20):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if edits == 3:
                w = w[30:] + w[:30]
            rows.append((i, "  ".join(w) + (" \n" if edits == 0 else ""), "a"))
            i += 1
    return rows + [(i, None, "a"), (i + 1, "", "a"), (i + 2, "short", "a"), (i + 3, "short", "a")]


def test_against_all_pairs(spark):
    rows = made()
    sets = {i: grams(t) for i, t, _ in rows if t}
    sets = {i: g for i, g in sets.items() if g}
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    got = [tuple(r) for r in N.found(spark.createDataFrame(rows, "id long, text string, h string")).collect()]
    assert len(got) == len(set(got)) and not set(got) - want
    # many pairs here lie just above one half, where ten groups of five find 87 of 100 by design
    near = {(a, b) for a, b in want if len(sets[a] & sets[b]) >= 0.62 * len(sets[a] | sets[b])}
    assert len(set(got) & near) >= 0.98 * len(near) and len(got) >= 0.87 * len(want)


def test_groups(spark):
    rows = made(8)
    got = {r.id: r for r in N.groups(spark.createDataFrame(rows, "id long, text string, h string")).collect()}
    assert set(got) == {i for i, t, _ in rows if t and len(" ".join(t.split())) >= 40}
    assert all(got[5 * k].group_id == got[5 * k + 1].group_id == got[5 * k + 2].group_id == 5 * k and got[5 * k].copies == 2 for k in range(8))


def test_hot_copies_and_empty(spark):
    text = "the same sentence about the concrete of the deck, again and again in every row"
    df = spark.range(300).selectExpr("id", f"'{text}' as text")
    assert N.found(df).count() == 300 * 299 // 2
    assert N.groups(df).where("copies = 300 and group_id = 0 and links = 0").count() == 300
    assert N.found(spark.createDataFrame([], "id long, text string")).count() == 0


def test_every_pair_near_one_half(spark):
    """Pairs alike by stock phrases alone, and pairs just above one half, are found, every one."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    rows, stock = [], [" ".join(word() for _ in range(30)) for _ in range(12)]
    for i in range(240):
        if i % 2:  # half stock phrases and more, which many texts share, and words of its own
            rows.append((i, stock[i % 12] + " " + " ".join(word() for _ in range(6)), "s"))
        else:  # a fresh text, and one with about a third of it changed
            words = [word() for _ in range(60)]
            rows.append((i, " ".join(words), "f"))
            rows.append((1000 + i, " ".join(words[:41] + [word() for _ in range(19)]), "f"))
    sets = {i: grams(t) for i, t, _ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    close = [p for p in want if len(sets[p[0]] & sets[p[1]]) < 0.56 * len(sets[p[0]] | sets[p[1]])]
    assert len(close) > 30
    assert {tuple(r) for r in N.found(spark.createDataFrame(rows, "id long, text string, h string")).collect()} == want


def test_signatures_are_not_shuffled(spark):
    """A text is sent once for each group, whatever the number of its signatures, and all tasks of a group read one exchange."""
    distinct = spark.createDataFrame([(i, t) for i, t, _ in made(4) if t and len(t) >= 40], "h long, norm string")
    candidates = N._candidates(distinct)
    candidates.collect()
    plan = candidates._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "ReusedExchange" in plan
    sent = distinct.mapInArrow(N._projected, "g int, h binary, minima binary, words binary").selectExpr("sum(length(h) + length(minima) + length(words)) n").first().n
    assert sent <= 600 * distinct.count()


def test_large_groups_find_the_same(monkeypatch):
    """Groups that are read in several rounds, lie in files and have subsets of six give the pairs that small ones give."""
    texts = [t for _, t, _ in made(40) if t and len(t) >= 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([" ".join(t.split()) for t in texts])], ["h", "norm"])
    pieces = list(N._projected(iter([batch])))

    def pairs():
        return {(a, b) for k in range(N.SHARES) for out in N._meetings(k)(iter(pieces)) for a, b in zip(*(c.to_pylist() for c in out.columns))}

    sets = [grams(t) for t in texts]
    alike = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    small = pairs()
    assert alike <= small
    monkeypatch.setattr(N, "_ROWS", 30)
    monkeypatch.setattr(N, "_HELD", 1000)
    monkeypatch.setattr(N, "_PAIRS", 7)
    assert pairs() == small
    monkeypatch.setattr(N, "SUBSETS", ((0, 6, 800),))
    assert alike <= pairs()


def test_misses_at_one_half_are_rare():
    """Sets of random sequences at exactly one half pass some group, for the subsets of small and of large groups."""
    rng, n = np.random.default_rng(4), 4000
    h = rng.integers(0, 1 << 63, (n, 300), dtype=np.uint64) << np.uint64(1)
    sides = h[:, :225], h[:, np.r_[:150, 225:300]]
    parts = [[N._projections(np.repeat(np.arange(500), 225), x[i : i + 500].ravel(), 500) for i in range(0, n, 500)] for x in sides]
    (m, w), (m2, w2) = ([np.concatenate(c, -1) for c in zip(*p)] for p in parts)
    bits = np.bitwise_count(w ^ w2).astype(int)
    near = (bits[:, 0] <= N.NEAR_FIRST) & (bits.sum(1) <= N.NEAR)
    for least, _, _ in N.SUBSETS:
        met = np.any([(m == m2)[:, s].all(1) for s in map(list, N._subsets(least))], axis=0)
        assert (met & near).any(0).sum() >= n - 1


def test_work_in_large_groups_is_bounded():
    """However many texts there are, a text is sorted for few subsets, and few bytes of it are sent."""
    for texts in (1 << 16, 1 << 21, 1 << 25):
        assert N.GROUPS * len(N._subsets(texts)) <= 2400
    assert N.GROUPS * len(N._subsets(1 << 23)) <= 1000
    assert N.GROUPS * (8 + N.MINIMA + 8 * N.WORDS) <= 450


def test_far_pairs_are_not_handed_over():
    """Of pairs of texts that have a quarter in common hardly any goes on to the exact comparison."""
    rng, n, size = np.random.default_rng(9), 4000, 400
    h = rng.integers(0, 1 << 63, (n, 2 * size), dtype=np.uint64) << np.uint64(1)
    sides = h[:, :size], np.ascontiguousarray(h[:, size * 3 // 5 : size * 8 // 5])
    parts = [[N._projections(np.repeat(np.arange(500), size), x[i : i + 500].ravel(), 500) for i in range(0, n, 500)] for x in sides]
    minima, words = (np.concatenate([q[k] for p in parts for q in p], -1) for k in (0, 1))
    kept = set()
    for m, w in zip(minima, words):
        for i, j in N._met(list(m), list(w), N._subsets(2 * n)):
            kept |= set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
    assert len(kept) <= n // 400


def test_a_common_minimum_and_files(monkeypatch):
    """Texts most of which have the same first minima, more than a round holds, meet like in one round."""
    texts = [t for _, t, _ in made(30, 5) if t and len(t) >= 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([" ".join(t.split()) for t in texts])], ["h", "norm"])
    rows = next(N._projected(iter([batch])))
    m = [np.frombuffer(b, np.uint8).reshape(N.MINIMA, -1).copy() for b in rows.column(2).to_pylist()][0]
    w = list(np.frombuffer(rows.column(3).to_pylist()[0], np.uint64).reshape(N.WORDS, -1))
    m[:40, : m.shape[1] * 4 // 5] = 7
    pairs = lambda: {(min(p), max(p)) for i, j in N._met(list(m), w, N._subsets(0)) for p in zip(i.tolist(), j.tolist())}
    small = pairs()
    monkeypatch.setattr(N, "_ROWS", 20)
    assert small and pairs() == small

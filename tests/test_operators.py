import random

from pyspark.sql import functions as F

from sitequarry.functions import text as T
from sitequarry.operators import chunks, dedup, logs, retrieval
from sitequarry.operators.components import components
from sitequarry.plans import text_queries
from sitequarry.sources import files
from sitequarry.streaming import events


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sentence_chunks_hold_the_text(spark):
    df = spark.createDataFrame([(1, "Ab. Cd! Ef？Gh。" * 30), (2, None), (3, "  "), (4, "x" * 5000)], "doc_id long, text string")
    got = chunks.sentences(df, 50).orderBy("doc_id", "chunk_index").collect()
    whole = lambda i: "".join(r.content for r in got if r.doc_id == i).replace(" ", "")
    assert whole(1) == ("Ab. Cd! Ef？Gh。" * 30).replace(" ", "") and whole(4) == "x" * 5000 and {r.doc_id for r in got} == {1, 4}


def test_clean(spark):
    df = spark.createDataFrame([("（a）​\n- 3 -\nb  c。。\n\n\n\nb  c。\n第 2 页\nsee http://x.y/z me@x.org",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.clean(F.col("t"))).collect()] == ["(a)\nb c。\n\nb c。\nsee", None, ""]


def test_simhash_pairs_against_all(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{(i // 3 * 50) + j + (i % 3 == 2) * (j == 0)}" for j in range(60))) for i in range(12)], "doc_id long, text string")
    h = dedup.simhash(docs)
    rows = h.groupBy("hi", "lo").agg(F.min("doc_id").alias("i")).collect()
    distance = lambda a, b: bin((a.hi ^ b.hi) & (2**64 - 1)).count("1") + bin((a.lo ^ b.lo) & (2**64 - 1)).count("1")
    expected = {(a.i, b.i, distance(a, b)) for a in rows for b in rows if a.i < b.i and distance(a, b) <= 12}
    assert expected and set(map(tuple, dedup.simhash_pairs(h).collect())) == expected


def test_dense_blocks(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)] + [(900, None), (901, [])], "id long, embedding array<float>")
    a = {tuple(r) for r in retrieval.dense(v.where("id < 20"), v, 5, block=16).select("query_id", "doc_id", "rank").collect()}
    b = {tuple(r) for r in retrieval.dense(v.where("id < 20"), v, 5, block=1000).select("query_id", "doc_id", "rank").collect()}
    assert a == b and len(a) == 100


def test_bm25_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    index = retrieval.build_index(docs)
    assert index.posts.count() == 0
    assert retrieval.bm25(spark.createDataFrame([(1, "a", 1)], "query_id long, token string, qtf int"), index).count() == 0


def test_rate_limit_counts_allowed_only(spark):
    rows = [(i, 1, f"2024-01-01 00:00:{i:02d}") for i in range(10)] + [(50, 1, "2024-01-01 00:00:11"), (60, 2, "2024-01-01 00:00:00"), (70, None, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.event_id for r in events.rate_limited(df, 3, 10).where("allowed").collect()}
    assert got == {0, 1, 2, 50, 60, 70}


def test_upsert_and_expiry(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, logs.upsert(old, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    kv = spark.createDataFrame([("x", 1), ("x", 9), ("y", 2)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.k for r in logs.alive(kv, "k", "ts", F.expr("interval 3 seconds"), F.timestamp_seconds(F.lit(10))).collect()] == ["x"]


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select("id", F.timestamp_seconds(F.col("id") * 9000).alias("ts"), F.col("id").cast("double").alias("value")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e.parquet")
    got = events.drained(events.daily(events.stream(spark, str(tmp_path), "e")), "complete")
    want = spark.read.parquet(f"{tmp_path}/e.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("层".encode("gbk"))
    (tmp_path / "sub" / "b.MD").write_text("ok")
    (tmp_path / "c.pdf").write_bytes(b"x")
    (tmp_path / "d.xyz").write_bytes(b"x")

    def broken(data):
        raise ValueError("bad file")

    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.text, r.encoding, r.error) for r in files.load(spark, str(tmp_path), {"pdf": broken}).collect()}
    assert got == {"a.txt": ("text", "层", "gbk", None), "b.MD": ("text", "ok", "utf-8", None), "c.pdf": ("pdf", None, None, "bad file"), "d.xyz": (None, None, None, "unsupported")}
    assert files.manifest(spark, str(tmp_path)).count() == 4


def test_neardup_query_names_every_copy(spark, tmp_path):
    words = "concrete pour deck slab steel rebar wall beam joint crane survey level formwork curing sample truck".split()
    near = " ".join(words * 8)
    rows = [(i, "one text that was imported again and again") for i in (7, 3, 5)] + [(10, near), (11, near + " crane"), (12, near + " crane")] + [(20, "nothing like any of them"), (21, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.class_id, r.copies, r.links) for r in text_queries.QUERIES["op_fn_neardup"](spark, str(tmp_path)).collect()}
    pairs = {(r.a, r.b) for r in text_queries.QUERIES["op_fn_neardup_pairs"](spark, str(tmp_path)).collect()}
    assert {got[i] for i in (3, 5, 7)} == {(3, 3, 0)} and got[20] == (20, 1, 0) and set(got) == {3, 5, 7, 10, 11, 12, 20}
    first = got[11][0]
    assert got[11] == got[12] and (pairs == {(10, 11)} and got[10] == (10, 1, 1) and got[11] == (11, 2, 1) or first == 10 and got[10] == (10, 3, 0) and not pairs)


def test_merged_lines_and_whole_clean(spark):
    text = "The crew placed the con-\ncrete beside\nthe plinth.\nIt rained.\n1. Heading\nx\n测点位移\n六毫米"
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, t int")
    got = {r.doc_id: r.m for r in df.select("doc_id", T.merge_lines(F.col("text")).alias("m")).collect()}
    assert got[1] == "The crew placed the concrete beside\nthe plinth.\nIt rained.\n1. Heading测点位移\n六毫米" and got[2] is None and got[3] == ""
    assert T.cleaned(df).where("doc_id = 1").first().text.startswith("The crew placed the concrete beside\nthe plinth.")


def test_recursive_and_semantic_chunks(spark):
    from sitequarry.operators import chunks as C

    texts = ["A short one.", ("Sentence one is here. " * 40 + "\n\n") * 5, "x" * 1300, "第一章 总则\n\n内容在这里。\n\n第二章 施工\n\n" + "内容。" * 700 + "\n\n末段。", None, "", "  \n "]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, content string")
    rows = C.recursive(df, 300, 40).orderBy("doc_id", "chunk_index").collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r.doc_id == i]
        assert all(len(r.content) <= 300 and t[r.start_char : r.start_char + len(r.content)] == r.content for r in own)
        ends = [0] + [r.start_char + len(r.content) for r in own]
        assert all(r.start_char == max(0, e - 40) for r, e in zip(own, ends)) and ends[-1] == len(t or "")
    assert all(r.content.rstrip().endswith(".") for r in rows if r.doc_id == 1)
    whole = C.semantic(df, 300).orderBy("doc_id", "chunk_index").collect()
    assert [r.content[:5] for r in whole if r.doc_id == 3] == ["第一章 总", "第二章 施", "末段。"] and {r.doc_id for r in whole} == {0, 1, 2, 3}
    assert C.recursive(df.where("false")).count() == 0 and C.semantic(df.where("false")).count() == 0


def test_spread_join(spark):
    from sitequarry.operators.skew import hot_keys, spread_join

    many = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, i long")
    few = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k3", "c"), (None, "d"), ("none", "e")], "k string, v string")
    counts = many.groupBy("k").count().withColumnRenamed("count", "n")
    hot = hot_keys(counts, "k", share=0.1)
    assert [r.k for r in hot.collect()] == ["hot"]
    got = spread_join(many, few, "k", hot, "i")
    assert sorted(map(tuple, got.collect())) == sorted([("hot", i, v) for i in range(900) for v in "ab"] + [("k3", 3, "c")])


def test_stored_index_and_blocks_of_queries(spark, tmp_path):
    from sitequarry.operators import retrieval as R

    df = spark.createDataFrame([(i, f"beam column w{i % 3} {'slab ' * (i % 2)}", "t") for i in range(20)] + [(20, None, "t"), (21, "", "t")], "doc_id long, text string, token string")
    R.write_index(df.where("doc_id < 10"), str(tmp_path / "ix"))
    R.write_index(df.where("doc_id >= 10"), str(tmp_path / "ix"), append=True)
    whole = lambda p: sorted(map(tuple, p.collect()))
    assert whole(R.read_index(spark, str(tmp_path / "ix")).posts) == whole(R.postings(df))
    assert {r.token for r in R.read_index(spark, str(tmp_path / "ix"), ["slab"]).posts.collect()} == {"slab"}
    v = R.hashed_embeddings(R.postings(df))
    one, many = R.dense(v, v, 3), R.dense(v, v, 3, block=4)
    assert whole(one.select("query_id", "doc_id", "score", "rank")) == whole(many.select("query_id", "doc_id", "score", "rank")) and one.count() == 60
    by = R.dense(v, v.withColumn("g", (v.id % 2).cast("int")), 2, by="g")
    assert by.groupBy("query_id", "g").count().where("count = 2").count() == 40
    assert R.dense(v.where("false"), v, 3).count() == 0 and R.dense(v, v.where("false"), 3).count() == 0


def test_components_that_do_not_converge_are_an_error(spark):
    import pytest

    from sitequarry.operators.components import components

    chain = spark.range(40).selectExpr("id as a", "id + 1 as b")
    with pytest.raises(RuntimeError):
        components(chain, max_rounds=1)
    assert components(chain).where("component = 0").count() == 41


def test_notes_and_tables(spark, tmp_path):
    from sitequarry.plans import drawing_queries as Q

    rows = [(1, "注：梁底标高以现场为准\n说明: 见图\n备注：无"), (2, "材料表\n混凝土 | C30 | 3\n钢筋 | HRB400 | 2"), (3, "构件 | 编号\nKL-1 | 2\nKZ-3 | 1"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in Q.annotations(spark, str(tmp_path)).collect()] == [(1, "general_note", "梁底标高以现场为准")]
    assert {tuple(r) for r in Q.table_entities(spark, str(tmp_path)).collect()} >= {(2, "material", "C30"), (2, "material", "HRB400"), (3, "component", "KL-1"), (3, "component", "KZ-3")}


def test_rate_limit_against_one_pass(spark):
    import random
    from collections import deque

    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([rng.randrange(400), rng.randrange(5000)])) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = set()
    for user in (1, 2, None):
        times = deque()
        for i, _, t in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            while times and times[0] <= t - 60:
                times.popleft()
            if len(times) < 4:
                times.append(t)
                want.add(i)
    assert {r.event_id for r in events.rate_limited(df, 4, 60).where("allowed").collect()} == want


def test_matched_against_all_pairs(spark):
    """Blocks of queries and batches that cut through a text change nothing; hot tokens, ties and unknown tokens are fine."""
    import random

    rng = random.Random(9)
    posts = [(d, f"t{t}", float(rng.randrange(1, 5))) for d in range(60) for t in {0, *(rng.randrange(30) for _ in range(8))}]
    wanted = [(q, f"t{t}", float(rng.randrange(1, 4))) for q in range(0, 40, 3) for t in {rng.randrange(35) for _ in range(5)}]
    w = {}
    for q, t, x in wanted:
        w.setdefault(t, []).append((q, x))
    total = {}
    for d, t, y in posts:
        for q, x in w.get(t, ()):
            total[q, d] = total.get((q, d), 0.0) + x * y
    want = {(q, d, s) for q in {q for q, _ in total} for d, s in sorted(((d, s) for (p, d), s in total.items() if p == q), key=lambda z: (-z[1], z[0]))[:4]}
    a, b = spark.createDataFrame(wanted, "query_id long, token string, qw double"), spark.createDataFrame(posts, "doc_id long, token string, w double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for block in (500_000, 20):
            assert {(r.query_id, r.doc_id, r.score) for r in retrieval.matched(a, b, 4, block).collect()} == want
        assert retrieval.matched(a.where("false"), b, 4).count() == 0 and retrieval.matched(a, b.where("false"), 4).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_specifications(spark):
    from sitequarry.operators import extraction as X

    docs = spark.createDataFrame([(1, "按GB 50010-2010和JGJ 130-2011施工"), (2, None)], "doc_id long, text string")
    assert {r.code for r in X.entities(docs, X.SPECS).collect()} == {"GB 50010-2010", "JGJ 130-2011"}


def test_best_are_kept_in_bounded_memory():
    """A wide block of scores, full of ties, is compared with the worst kept ones; it isn't sorted whole."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    score = rng.integers(0, 9, (300, 4096)) / 4.0
    ids = rng.permutation(4096) + 10
    tracemalloc.start()
    best = retrieval._Best(300, 10, 5)
    for at in range(0, 4096, 1024):
        best.add(np.arange(300), score[:, at : at + 1024], ids[at : at + 1024])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :10]
    assert (best.of == ids[order]).all() and (best.score == np.take_along_axis(score, order, 1)).all()
    assert peak < 3 * score.nbytes


def test_common_and_rare_tokens_are_summed_alike():
    import numpy as np

    rng = np.random.default_rng(5)
    q, d = (rng.random((40, 30)) * (rng.random((40, 30)) < rng.random(30) ** 4) for _ in range(2))
    code, query = np.nonzero(q.T)
    text, token = np.nonzero(d)
    places, retrieval._PLACES = retrieval._PLACES, 7
    try:
        for retrieval._DENSE in (0, 5, 10**9):
            assert np.allclose(retrieval._sums((code, query, q.T[code, query]), 40, text, token, d[text, token], 40), q @ d.T)
    finally:
        retrieval._PLACES, retrieval._DENSE = places, 300


def test_token_counts_as_the_sql_expressions_have_them(spark):
    from sitequarry.functions import text as T

    rows = [(1, "See HTTP://a.b/C?d and me@x.org, 7 x 7a 12 the beam"), (2, "钢筋混凝土的梁KL-3，见https://甲.乙 柱"), (2, "钢筋 beam"), (3, None), (4, ""), (5, "İK 3\u00a0a@b\u3000c ſ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    each = df.select("doc_id", F.explode(T.raw_tokens(F.col("text"))).alias("token")).where(T.is_token(F.col("token")))
    want = {(r.doc_id, r.token, r.n) for r in each.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {tuple(r) for r in retrieval.postings(df).collect()} == want and any(i == 2 and n == 2 for i, _, n in want)


def test_a_table_stored_once_serves_the_codes(spark, tmp_path):
    from sitequarry.plans import retrieval_queries as Q

    spark.createDataFrame([(50, "梁 KL-1, C30"), (51, "KL-1 C30 C40")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    codes = Q.named(spark, str(tmp_path))
    assert not any("documents.parquet" in f for f in codes.inputFiles())
    shared = codes.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n = 2").count()
    assert {r.score for r in Q.graph(codes).where("doc_id = 51").collect()} == {float(shared)}


def test_simhash_pairs_against_all_pairs(spark):
    """Near hashes, hot blocks and equal hashes; each hash is sent once for each block that may come first, not once a pair of blocks."""
    import random

    from sitequarry.operators import dedup

    rng = random.Random(8)
    rows = [rng.getrandbits(128) >> (i % 3 * 40) for i in range(120)]
    rows += [x ^ sum(1 << rng.randrange(128) for _ in range(n)) for x in rows[:60] for n in (0, 1, 6, 11, 13)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [x & ((1 << 128) - 1) for x in rows]
    df = spark.createDataFrame([(i, signed(x >> 64), signed(x & (1 << 64) - 1)) for i, x in enumerate(rows)], "doc_id long, hi long, lo long")
    first = {}
    for i, x in enumerate(rows):
        first.setdefault(x, i)
    want = sorted((min(i, j), max(i, j), (x ^ y).bit_count()) for x, i in first.items() for y, j in first.items() if i < j and (x ^ y).bit_count() <= 12)
    pairs = dedup.simhash_pairs(df)
    assert sorted(map(tuple, pairs.collect())) == want and len(want) > 150
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_simhash_of_rows_with_one_id(spark):
    from sitequarry.operators import dedup

    df = spark.createDataFrame([(1, "beam slab"), (2, "slab wall Wall"), (1, "beam"), (3, "!"), (4, None), (5, "beam beam slab")], "doc_id long, text string")
    got = {r.doc_id: (r.hi, r.lo) for r in dedup.simhash(df).collect()}
    assert set(got) == {1, 2, 5} and got[1] == got[5] != got[2]

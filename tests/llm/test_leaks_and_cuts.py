import random

from sitequarry.llm import leaks as L
from sitequarry.llm import truncation as C

EN = "Suppose the Fenneby crew measures 9345 newtons where a lift pit hums by 22 units toward Lorsolund and then rests until spring comes again"
ZH = "设槿栖试件承受3660牛顿时塔吊基础下沉了94个单位，求峤堰侧的余量。题目给出珞岭的电缆沟"


def leaked(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    return sorted(map(tuple, L.leaked(docs, spark.createDataFrame(items, "item_id long, passage string, suite string")).collect()))


def test_leaks(spark):
    w = EN.split()
    texts = [
        f"Before. {EN} After.", f"x {' '.join(w[3:15]).upper()} y", f"x {' '.join(w[3:14])} y", f"a\n{ZH[:12]}\n {ZH[12:26]} b", f"a {ZH[:18]} b",
        "xx" + " ".join(w[3:15]) + " y", None, "", EN, "  ".join(w) + " " + ZH,
    ]
    got = leaked(spark, texts, [(1, EN, "a"), (2, EN, "b"), (3, ZH, "a"), (4, None, "a"), (5, "", "a")])
    assert got == [(0, 1), (0, 2), (1, 1), (1, 2), (3, 3), (8, 1), (8, 2), (9, 1), (9, 2), (9, 3)]
    assert leaked(spark, [EN], []) == [] and leaked(spark, [], [(1, EN, "a")]) == []


def test_automaton_against_all_substrings():
    rng = random.Random(5)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 14))) for _ in range(3)]
        text = "".join(rng.choice("ab") for _ in range(20))
        got = L.Automaton(texts).matches(text, 3)
        for i, t in enumerate(texts):
            longest = max((n for n in range(1, len(t) + 1) for a in range(len(t) - n + 1) if t[a : a + n] in text), default=0)
            assert max((b - a for a, b in got.get(i, [])), default=0) == (longest if longest >= 3 else 0)


def test_cuts(spark):
    whole = "The pit was closed at noon and reopened after lunch by the crew."
    rows = [("lim", ((whole + " ") * 4)[:200]) for _ in range(20)] + [("lim", whole[:n]) for n in (30, 40, 50)] + [("lim", whole + " Done.")]
    free = [whole, whole + "\n\nEnd of record", whole + "\n- bricks: 12 units", whole + "\n\nRegards\nDesign desk Ulm", whole[:-9] + "…", whole[:-3] + "\n", whole[:-3] + "�", whole + " ✅ ", None, "", "  \n", whole + "\n\n附件：3份"]
    rows += [("free", t) for t in free] + [("list", f"Stock.\n- item: {i} units") for i in range(4)] + [(None, whole[:20])]
    docs = spark.createDataFrame([(i, s, t, 1) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string, cut int")
    spikes = {(r.source, r.measure, r.top) for r in C.spikes(docs).collect()}
    assert spikes == {("lim", "chars", 200), ("lim", "bytes", 200)}
    cut = {r.doc_id for r in C.found(docs).collect()}
    base = 24
    assert cut == set(range(23)) | {base + 4, base + 5, base + 6, len(rows) - 1}
    shares = {r.source: (r.n_texts, r.n_cut, r.n_cut_at_limit) for r in C.by_source(docs).collect()}
    assert shares["lim"] == (24, 23, 20) and shares["free"] == (9, 3, 0) and shares[None] == (1, 1, 0)
    assert C.found(docs.where("false")).count() == 0


def test_limit_decides_over_closing_forms(spark):
    """At a limit a closing form holds only if the same last line also ends texts below the limit; units are known by their share."""
    filler = "The pit was closed at noon and the crew came back after lunch to pour. " * 4
    at = lambda end: filler[: 200 - len(end)] + end
    rows = [("lim", at(" and so on")) for _ in range(20)]
    rows += [("lim", at("\n\nDistribution: file, scaffold con")), ("lim", at("\n- canopy: 230 m")), ("lim", at("\n\nEnd of record")), ("lim", at("\n- canopy: 230 mm")), ("lim", at(" It rained."))]
    rows += [("free", "Done.\n\nEnd of record") for _ in range(3)] + [("free", f"Stock.\n- canopy: {i} mm") for i in range(4)] + [("free", f"Stock.\n- door {i}: {i} m") for i in range(3)] + [("free", filler + "Done.")]
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    assert {r.doc_id for r in C.found(docs).collect()} == set(range(22))
    many = [(i, "a", f"Stock.\n- item: {i} {'units' if i > 2 else 'uni'}") for i in range(5000)] + [(5000, "a", filler + "Done.")]
    assert {r.doc_id for r in C.found(spark.createDataFrame(many, "doc_id long, source string, text string")).collect()} == {0, 1, 2}


GREEK = "Στο δεύτερο υπόγειο ο εργολάβος μετράει τις ρωγμές κάθε πρωί ενώ ο μηχανικός σημειώνει τους αριθμούς"


def test_leaks_in_any_alphabet(spark):
    """Letters whose lower case and case fold differ are compared alike on both sides."""
    for passage in (GREEK, "Die Straße grüßt ſiebzehn Große Maße und ŉ Reſt von dreißig weißen Füßen am Fluß"):
        assert leaked(spark, [f"πριν {passage.upper()} μετά", passage[:30]], [(1, passage, "a")]) == [(0, 1)]


def test_long_texts_are_walked_in_pieces(spark):
    w = EN.split()
    text = "filler words of no weight here " * 2000
    at = [len(text) - 4000 * k for k in (1, 5, 9)]
    docs = [text[:a] + " " + " ".join(w[2:16]) + " " + text[a:] for a in at] + ["x" * (3 * L.PIECE), (EN + " ") * 300]
    assert leaked(spark, docs, [(1, EN, "a")]) == [(0, 1), (1, 1), (2, 1), (4, 1)]


def test_cleaned(spark):
    w = EN.split()
    texts = [f"Before them. {' '.join(w[3:17])}, two hours after. " + "Other work went on. " * 9, f"x {EN} y", None, "", "Nothing of it.", f"Eß {ZH[:25]} " + "别的内容在这里说明" * 9]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, gone int")
    items = spark.createDataFrame([(1, EN, "a"), (2, ZH, "b")], "item_id long, passage string, suite string")
    got = {r.doc_id: (r.text, r.share_removed) for r in L.cleaned(docs, items).collect()}
    assert got[0][0] == "Before them. , two hours after. " + "Other work went on. " * 9 and 0.2 < got[0][1] < 0.5
    assert got[1] == (None, 1.0) and got[2] == (None, 0.0) and got[3] == ("", 0.0) and got[4] == ("Nothing of it.", 0.0)
    assert got[5][0] == "Eß  " + "别的内容在这里说明" * 9
    assert L.cleaned(docs, items.where("false")).where("share_removed > 0").count() == 0


def test_blocks_of_passages(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_CHARS", 60)
    assert leaked(spark, [EN, ZH, EN + ZH], [(1, EN, "a"), (2, ZH, "b"), (3, GREEK, "c")]) == [(0, 1), (1, 2), (2, 1), (2, 2)]


def test_cut_list_entries_at_any_number(spark):
    """A fragment of a unit is no unit, however many texts end in it."""
    for n in (2, 4, 40):
        rows = [f"Stock.\n- item: {i} units" for i in range(10 * n)] + [f"Stock.\n- item: {i} un" for i in range(n)] + ["The crew came back after lunch to pour. " * 3 + "Done."]
        docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(rows)], "doc_id long, source string, text string")
        assert {r.doc_id for r in C.found(docs).collect()} == set(range(10 * n, 11 * n))


def test_long_last_lines_and_learnt_leads(spark):
    long = "The crew " + "moved the shoring and the props along the northern wall of the basement " * 4
    rows = [long + "and then item: 12 units", long + "was don"] + [f"All was done.\nKonferenz Büro {x}" for x in "abcdefghij"] + [f"It stood open. Then\nThe crew mov{'ed' * i}" for i in range(3)]
    rows += ["The crew came.\nThe crew went.\nThe crew slept."] * 9 + ["Stock.\n- item: 7 units"] * 5
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(rows)], "doc_id long, source string, text string")
    assert {r.doc_id for r in C.found(docs).collect()} == {0, 1, 12, 13, 14}

from sitequarry.llm import forms as F
from sitequarry.llm import scans as S

T = "src_table string, row_id long, text string, code boolean"


def test_forms(spark):
    plain = [("t", 100 + i, "The masonry office placed crack gauges in the façade", False) for i in range(3)]
    cases = {
        1: ("mаѕоnrу works", "masonry works"), 2: ("façade", "façade"), 3: ("crack​ gauges", "crack gauges"), 4: ("a b", "a b"), 5: ("ｃｒａｃｋ １２", "crack 12"), 6: ("offﬁce", "offfice"),
        7: ("ready‐mixed", "ready-mixed"), 8: ("⽊工", "木工"), 9: ("axis Ρ14", "axis P14"),
    }
    fine = {20: "（取 α = 0.2，Φ28）", 21: "На участке лист 69", 22: "a – b — c", 23: "", 24: "ade†", 25: "Über façade"}
    rows = plain + [("t", k, v[0], False) for k, v in cases.items()] + [("t", k, v, False) for k, v in fine.items()] + [("t", 30, None, False)]
    rows += [("c", 1, "ＫＬ－１（２）", True), ("c", 2, " КL-7 ", True), ("c", 3, " kl-7", True), ("c", 4, None, True)]
    got = {(r.src_table, r.row_id): r for r in F.consistent(spark.createDataFrame(rows, T)).collect()}
    assert {k for k, r in got.items() if r.disguised} == {("t", k) for k in cases} | {("c", 1), ("c", 2)}
    assert {k: got["t", k].form for k in cases} == {k: v[1] for k, v in cases.items()}
    assert {k: got["t", k].form for k in fine} == fine and got["t", 30].form is None
    assert [got["c", k].form for k in (1, 2, 3, 4)] == ["KL-1(2)", "KL-7", "kl-7", None]
    assert F.consistent(spark.createDataFrame([], T)).count() == 0


def corpus():
    clean = "The operator checks the concrete before the shotcrete is placed beside the bearing plinth. 第3层混凝土已经浇筑，检查井完成。"
    return [("k", i, "f", clean) for i in range(40)]


P = "src_table string, row_id long, file_id string, text string"


def test_noise(spark):
    title = "Harbour Terminal     Notes"
    rows = corpus() + [
        ("k", 100, "g", f"{title}\nThe 0perator checks the con-\ncrete before the\nshotcrete is placed.\n- 3 -"),
        ("k", 101, "g", f"* {title.upper()}\nThe operator checks."), ("k", 102, "g", f"The concrete is\nplaced. {'x'}\nHarbour  Terminal  N0tes _"),
        ("k", 103, "g", "第3屡混凝士己经浇筑，\n检查井完成。\n第 2 页"), ("k", 104, "g", "345"), ("k", 105, "g", None), ("k", 106, "g", ""), ("k", 107, None, "The concrete\nis placed."), ("k", 108, "g", "4S5 x 2lO mm"),
        ("other", 100, "g", title),
    ]
    texts = spark.createDataFrame(rows, P)
    got = sorted(map(tuple, S.found(texts).collect()))
    assert got == [
        ("k", 100, "char"), ("k", 100, "header"), ("k", 100, "hyphen"), ("k", 100, "page_number"), ("k", 101, "header"), ("k", 102, "char"), ("k", 102, "header"),
        ("k", 103, "char"), ("k", 103, "page_number"), ("k", 104, "page_number"), ("k", 108, "char"),
    ]
    text = {r.row_id: r.text for r in S.repaired(texts).where("src_table = 'k'").collect()}
    assert text[100] == "The operator checks the concrete before the shotcrete is placed."
    assert text[103] == "第3层混凝土已经浇筑，检查井完成。" and text[105] is None and text[106] == "" and text[107] == "The concrete is placed."
    assert S.found(texts.where("false")).count() == 0 and S.repaired(texts.where("false")).count() == 0


def test_paragraphs():
    lines = ["A first line that runs on for long and", "ends here.", "", "- item one", "- item two that is as long as others", "Another paragraph starts after it and"]
    assert [len(p) for p in S.paragraphs(lines)] == [2, 1, 2]
    assert S.paragraphs([]) == [] and S.paragraphs(["", " "]) == []


def test_long_text():
    lex = S.Lexicon([("word", 1000), ("concrete", 500)])
    fixed, kinds = S.read(("word " * 2000 + "\n") * 50 + "concrctc", lex)
    assert kinds == {"char"} and fixed.endswith("concrete")


def test_one_lattice_for_all(spark):
    """A torn, a run-on, a misread and a broken word, and mixtures of them, are solved by the same pass."""
    lex = S.Lexicon([("the", 900), ("operator", 200), ("concrete", 300), ("is", 500), ("placed", 250), ("bearing", 90), ("plinth", 80), ("crane", 70)])
    cases = {
        "the con crete is placed": ("the concrete is placed", set()), "theconcrete is placed": ("the concrete is placed", set()), "the 0perator is placed": ("the operator is placed", {"char"}),
        "the con-\ncrete is placed": ("the concrete is placed", {"hyphen"}), "the c0n-\ncrete is\nplaced": ("the concrete is placed", {"hyphen", "char"}), "the con¬\ncrete": ("the concrete", {"hyphen"}),
        "the bearing-\nplinth": ("the bearing-plinth", {"hyphen"}), "the Ravtiley crane is placed": ("the Ravtiley crane is placed", set()), "the c0n crctc is placed": ("the concrete is placed", {"char"}),
    }
    for seen, want in cases.items():
        assert S.read(seen, lex) == want, seen


def test_long_paragraph():
    line = "The crew placed the concrete beside the bearing plinth and the crane"
    assert [len(p) for p in S.paragraphs([line] * 1000 + ["and left."])] == [1001]


def test_words_outside_the_lexicon(spark, monkeypatch):
    """A word that no task holds is no misreading if its own count in the corpus says so."""
    rows = [("k", i, "f", "The corner of the concrete operator") for i in range(40)] + [("k", 50 + i, "f", f"The comer came {i}") for i in range(20)] + [("k", 90, "f", "The cormer came"), ("k", 91, "f", "The 0perator\nof the comer")]
    texts = spark.createDataFrame(rows, P)
    for size in (200_000, 4):
        monkeypatch.setattr(S, "learnt", lambda t, size=size, f=S.Lexicon, c=S.word_counts: f([(r.word, r.n) for r in c(t).collect() if size > 4 or r.n >= 40], complete=size > 4))
        assert {tuple(r) for r in S.found(texts).collect()} == {("k", 91, "char")}
        text = {r.row_id: r.text for r in S.repaired(texts).collect()}
        assert text[91] == "The operator of the comer" and text[50] == "The comer came 0"


def test_weights():
    """Look-alikes and ignorables cost nothing, a missing accent half an edit; more than the limit is no match."""
    trie = F.Trie([("façade", 5), ("masonry", 9), ("mason", 3)])
    assert trie.spelling("mаѕоnrу") == ("masonry", 0.0) and trie.spelling("ma\u200bson") == ("mason", 0.0)
    assert trie.spelling("fаcade") == ("façade", 0.5) and trie.spelling("fаcades") is None and trie.spelling("mаsonty") is None
    edits = F.Trie([("façade", 5), ("masonry", 9)])
    assert edits.spelling("mаsonty", 1.0) == ("masonry", 1.0)
    assert F.Trie([("masonry", 9)]).spelling("mаsonrys", 1.0) == ("masonry", 1.0) and F.Trie([("masonry", 9)]).spelling("mаsnry", 1.0) == ("masonry", 1.0)

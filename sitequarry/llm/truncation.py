"""Text cut off by field limits or in transfer.

Per source and column, histograms of the lengths in characters and in bytes are tested for a spike at their upper
end: a limited field piles its cut values up there. The spike decides about the values in it: without a sentence end they
were cut, unless their last line, numbers aside, is a closing line that also ends texts below the limit. Cuts in transfer leave
no spike; for them the end itself is judged, by how texts of the corpus end: a last line is a closing line if it has one of a few
general closing forms, if its opening words open last lines and hardly any others, or if it is a list entry whose unit
others have. All shares are relative to the texts, so that they mean the same at every size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.plans.session import cut

#: A spike: at least SPIKE_ROWS values in the top SPIKE_WIDTH lengths and SPIKE_RATIO times those expected from the lengths below.
SPIKE_ROWS, SPIKE_RATIO = 5, 6.0
#: Bytes of one UTF-8 character at most, by which a cut at a byte limit may fall short of it.
SPIKE_WIDTH = {"chars": 1, "bytes": 4}

#: The least use of a unit, by itself and as a share of all list entries; a unit that begins another one must be used FRAGMENT_SHARE as often.
UNIT_ROWS, UNIT_SHARE, FRAGMENT_SHARE = 3, 0.001, 0.2
#: The least number and share of texts below their limit that end with a line, for it to be whole at a limit.
LINE_ROWS, LINE_SHARE = 3, 0.0002
#: Opening words of closing lines: the least number and share of the texts below their limit whose last line has them, and how many of their lines are last ones.
LEAD_ROWS, LEAD_SHARE, LEAD_LAST = 3, 0.001, 0.8
#: Lines longer than this are prose.
CLOSING_LINE = 60

# How texts end.
TERMINAL = r"[.。!！?？]['\"”’»)）\]】]*$"
CUT_MARKS = r"(?:\.{3,}|…|�|\[\.\.\.\])$"
SYMBOLS = r"[\p{So}\x{FE0F}\x{200D}\x{1F3FB}-\x{1F3FF}✓✔]+$"
SIGN_OFF = (
    r"(?:Regards|Yours (?:sincerely|faithfully)|Sincerely|Mit freundlichen Grüßen|Freundliche Grüße|此致|敬礼)\s*\n[^\n]{1,60}$",
    r"(?:^|\n)\p{IsHan}{2,8}(?:项目部|项目组|监理部|指挥部)$",
    r"(?:^|\n)(?:End of (?:record|document|minutes|text)|Ende de[rs] \p{L}+)$",
    r"(?:^|\n)[（(](?:完|以下空白|结束|end)[）)]$",
    r"(?:^|\n)(?:Encl|Anl|Distribution|Copy to|cc|Verteiler)\.?: ?(?:\d+ (?:sheets?|Blatt|pages?)|[^\d\n]{3,60})$",
    r"(?:^|\n)(?:Anlagen?|Enclosures?): ?\d+ (?:sheets?|Blatt|pages?)$",
    r"(?:^|\n)(?:附件|附图|附)[：:]\d+[份张页册]$",
    r"(?:^|\n)(?:抄送|主送|抄报|发送)[：:][^\n，。]{2,30}$",
)
TABLE_ROW = r"(?:^|\n)[^\n|]{1,40}\|[^\n]*\|\s*\S{1,12}$"
LIST_ENTRY = r"(?:^|\n)[\t ]*(?:[-•*·–]|\d+[.)])[\t ]+[^\n]*?[:：] ?[\d.,]+ ?(\S{1,12})$"
#: The opening words of a line, up to a colon or bar, or two words; list entries have none.
LEAD = r"^(?![\t ]*(?:[-•*·–]|\d+[.)])[\t ])([^:：|\n]{0,30}[:：|]|\S+ \S+|\S+)"
_BLANK = " \t\n\r\f\u000b 　  \u0085"


def spikes(docs: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """column, source, measure (``chars``, ``bytes``), low and top: the length ranges at which a source's values pile up.

    The histogram is aggregated per column, source and length first, so that hot sources are small; the background is the mean
    number per length over the quarter of the range below. Null and empty values are not counted.
    """
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(m).alias("measure"), size(c).alias("size")) for c in columns for m, size in (("chars", F.length), ("bytes", F.octet_length))))
    histogram = docs.select("source", F.explode(each).alias("x")).where("x.size > 0").groupBy("x.column", "source", "x.measure", "x.size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column", "source", "measure")
    width = F.when(F.col("measure") == "chars", SPIKE_WIDTH["chars"]).otherwise(SPIKE_WIDTH["bytes"])
    near = histogram.withColumn("top", F.max("size").over(w)).withColumn("width", width).withColumn("low", F.col("top") - F.col("width") + 1)
    below = (F.col("size") < F.col("low")) & (F.col("size") >= F.col("low") - F.floor(F.col("top") / 4))
    return (
        near.groupBy("column", "source", "measure", "top", "low", "width")
        .agg(F.sum(F.when(F.col("size") >= F.col("low"), F.col("n")).otherwise(0)).alias("at"), F.sum(F.when(below, F.col("n")).otherwise(0)).alias("under"))
        .where((F.col("at") >= SPIKE_ROWS) & (F.col("at") >= SPIKE_RATIO * F.col("width") * F.greatest(F.col("under") / F.floor(F.col("top") / 4), F.lit(0.02))))
        .select("column", "source", "measure", "low", "top")
    )


def lead(line: Column) -> Column:
    """The opening words of a line, numbers masked; empty for a long line."""
    return F.when(F.length(line) <= CLOSING_LINE, F.regexp_replace(F.regexp_extract(line, LEAD, 1), r"\d+", "#")).otherwise("")


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every text with content: doc_id, source, at_limit (its length lies in a spike of its source), end (``sentence``,
    ``marked`` by a mark of cutting, ``closing`` form, ``open``), and of the last line: unit (last word of a list entry), line (numbers
    masked, of ends that are neither sentence nor mark) and lead (its opening words, where another line goes before).

    Null, empty and blank texts are left out. A null source is a source of its own. Repeated rows are judged each.
    """
    pile = spikes(docs, (text,)).groupBy(F.col("source").alias("_s")).agg(F.collect_list(F.struct("measure", "low", "top")).alias("piles"))
    bare = F.rtrim(F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(_BLANK))
    # a closing form spans three lines at most, and these are taken whole
    rows = docs.select("doc_id", "source", F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.substring_index(bare, "\n", -3).alias("t")).where("t <> ''")
    # at most two rows per source: small whatever the corpus holds, so the planner may broadcast it
    rows = rows.join(pile, F.col("source").eqNullSafe(F.col("_s")), "left")
    size = lambda x: F.when(x["measure"] == "chars", F.col("chars")).otherwise(F.col("bytes"))
    at_limit = F.coalesce(F.exists("piles", lambda x: (size(x) >= x["low"]) & (size(x) <= x["top"])), F.lit(False))
    # a projection each, so that no expression is worked out twice
    rows = rows.select("doc_id", "source", at_limit.alias("at_limit"), "t", F.rtrim(F.regexp_replace("t", SYMBOLS, ""), F.lit(_BLANK)).alias("shown"))
    form = "|".join(f"(?:{x})" for x in (*SIGN_OFF, TABLE_ROW))
    end = F.when(F.col("t").rlike(CUT_MARKS), "marked").when(F.col("shown").rlike(TERMINAL), "sentence").when(F.col("shown") != F.col("t"), "closing").when(F.col("t").rlike(form), "closing").otherwise("open")
    rows = rows.select("doc_id", "source", "at_limit", "t", end.alias("end"))
    last = F.substring_index("t", "\n", -1)
    asked = F.col("end").isin("open", "closing")
    return rows.select(
        "doc_id", "source", "at_limit", "end",
        F.when(F.col("end") == "open", F.regexp_extract("t", LIST_ENTRY, 1)).otherwise("").alias("unit"),
        F.when(asked, F.regexp_replace(last, r"\d+([.,]\d+)*", "#")).otherwise("").alias("line"),
        F.when(asked & F.col("t").contains("\n"), lead(last)).otherwise("").alias("lead"),
    )


def _inner_leads(docs: DataFrame, text: str) -> DataFrame:
    """lead and n: how many lines of all texts that are not the last one open so."""
    lines = F.split(F.rtrim(F.col(text), F.lit(_BLANK)), r"[\r\n]+")
    inner = F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lead)
    return docs.where(F.col(text).contains("\n") | F.col(text).contains("\r")).select(F.explode(inner).alias("lead")).where("lead <> ''").groupBy("lead").agg(F.count(F.lit(1)).alias("inner"))


def endings(rows: DataFrame, docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines (``line``), opening words (``lead``) and units (``unit``) that end whole texts, learnt from ``judged`` rows."""
    asked = rows.where("line <> ''")
    keys = F.array(F.struct(F.lit("line").alias("kind"), F.when(~F.col("at_limit"), F.col("line")).alias("key")), F.struct(F.lit("lead").alias("kind"), F.when(~F.col("at_limit"), F.col("lead")).alias("key")), F.struct(F.lit("unit").alias("kind"), F.col("unit").alias("key")))
    uses = asked.select(F.explode(keys).alias("k")).where("k.key <> ''").groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("n"))
    texts = F.broadcast(rows.agg(F.count(F.lit(1)).alias("texts")))  # one row
    of = lambda kind: uses.where(F.col("kind") == kind).select(F.col("key").alias(kind), "n")
    lines = of("line").join(texts).where(F.col("n") >= F.greatest(F.lit(LINE_ROWS), LINE_SHARE * F.col("texts"))).select("line")
    often = of("lead").join(texts).where(F.col("n") >= F.greatest(F.lit(LEAD_ROWS), LEAD_SHARE * F.col("texts"))).select("lead", "n")
    leads = often.join(_inner_leads(docs, text), "lead", "left").where(F.col("n") >= LEAD_LAST * (F.col("n") + F.coalesce("inner", F.lit(0)))).select("lead")
    units = of("unit")
    entries = F.broadcast(units.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries")))
    # a unit that begins a far more frequent one is a piece of it
    begun = units.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("unit")), lambda k: F.struct(F.left("unit", k).alias("unit"), k.alias("k")))).alias("b"), "n", "unit").where("b.k < length(unit)")
    longer = begun.groupBy(F.col("b.unit").alias("unit")).agg(F.max("n").alias("longest"))
    known = units.join(longer, "unit", "left").join(entries)
    known = known.where((F.col("n") >= F.greatest(F.lit(UNIT_ROWS), UNIT_SHARE * F.col("entries"))) & (F.col("n") >= FRAGMENT_SHARE * F.coalesce("longest", F.lit(0)))).select("unit")
    return lines, leads, known


def cut_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every text with content: doc_id, source, at_limit, cut.

    At a limit every text without sentence end is cut, but for those whose whole last line also ends texts below the limit. Elsewhere a
    text is cut that carries a mark of cutting, or that ends neither a sentence nor in a closing line.
    """
    # judged once, for the statistics and for the verdict: a few short columns a text
    rows = cut(judged(docs, text))
    lines, leads, units = endings(rows, docs, text)
    # only the ends in question are joined; the key of the others would be one hot value
    settled = rows.where("line = ''").select("doc_id", "source", "at_limit", (F.col("end") == "marked").alias("cut"))
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    asked = rows.where("line <> ''").join(flag(lines, "in_lines"), "line", "left").join(flag(leads, "in_leads"), "lead", "left").join(flag(units, "in_units"), "unit", "left")
    whole = (F.col("end") == "closing") | reduce(Column.__or__, (F.coalesce(c, F.lit(False)) for c in ("in_leads", "in_units")))
    below = F.coalesce("in_lines", F.lit(False))
    return settled.unionByName(asked.select("doc_id", "source", "at_limit", (~(whole & (~F.col("at_limit") | below))).alias("cut")))


def found(docs: DataFrame) -> DataFrame:
    """doc_id of every cut text."""
    return cut_texts(docs).where("cut").select("doc_id")


def by_source(docs: DataFrame) -> DataFrame:
    """Per source: texts with content, cut ones, cut ones at the source's field limit, and the share cut."""
    return (
        cut_texts(docs)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("n_cut_at_limit"))
        .withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_texts"), 6))
    )

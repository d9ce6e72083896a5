"""Which paragraphs are not worth reading aloud: tables, noise and reference lists.

All steps are column expressions over one document's array of paragraphs, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# Patterns that tell years, headings of reference lists, publishers, and marks of entries. Word borders are
# written out as ASCII ones; the letters that a match begins with are tested first.
YEAR = r"(?=[12n])(?<![A-Za-z0-9_])(?:(?:1[6-9][0-9][0-9]|20[0-9][0-9])[a-z]?|n\.\s?d\.)(?![A-Za-z0-9_])"
REF_HEADING = (
    r"(?i)^(?:[0-9]+\.?\s*)?(references?|reference list|notes|endnotes|end notes|bibliography|works cited|sources|"
    r"literature cited|selected bibliography|suggested readings?)\s*:?$"
)
PUBLISHED = r"(?=[PJQRUVvnpdIoE])(?<![A-Za-z0-9_])(?:Press|Publish[A-Za-z0-9_]*|Journal|Quarterly|Review|University|Vol\.|vol\.|no\.|pp\.|Retrieved|doi|Ibid|op\. cit|Eds?\.)"
ENTRY_MARKS = (
    r"(?<![A-Za-z0-9_])(Press|Publish|Journal|Review|University|Vol\.|vol\.|no\.|pp\.|Retrieved|doi|https?:|ed\.|eds\.|Ibid|Ibid\.|op\. cit)(?![A-Za-z0-9_])"
)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def flat(p: Column) -> Column:
    return T.trim(F.regexp_replace(p, r"[^\S ]\s*| \s+", " "))


def _is_entry(p: Column) -> Column:
    numbered = p.rlike(r"^\[?[0-9]{1,3}[.)\]]\s+\S")
    initials = p.rlike(r"^[A-Z][A-Za-z'’\-]+,\s(?:[A-Z]\.\s?){1,3}")
    named = p.rlike(r"^[A-Z][A-Za-z'’\-]+,\s[A-Z][a-z]+") & p.rlike(r"\.\s")
    sized = F.length(p).between(15, 900)
    return p.rlike(r"(?i)^[0-9]{1,3}\.\s+Ibid(?![A-Za-z0-9_])") | (sized & (numbered | initials | named) & (p.rlike(YEAR) | p.rlike(ENTRY_MARKS)))


def is_citation_entry(p: Column) -> Column:
    return let(flat(p), _is_entry)


def citeish(p: Column) -> Column:
    return p.rlike(YEAR) | p.rlike(PUBLISHED) | p.rlike(r"https?:|www\.")


def is_prose(p: Column) -> Column:
    return (F.length(p) >= 200) & ~citeish(p)


def is_symbol_noise(p: Column) -> Column:
    def odd(t: Column) -> Column:
        letters, signs = F.regexp_count(t, F.lit("[A-Za-z0-9]")), F.regexp_count(t, F.lit(r"[~^|\\{}<>_=;]"))
        return F.length(t).between(1, 60) & ((letters / F.length(t) < 0.5) | (signs >= 3))

    # a longer paragraph is told by its first signs
    return F.when(p.rlike(r"\A(?:\s*\S){61}"), False).otherwise(let(F.regexp_replace(p, r"\s+", ""), odd))


def _lines(p: Column) -> Column:
    return F.filter(F.transform(F.split(p, "\n"), lambda l: T.trim(l)), lambda l: l != "")


def is_table_fragment(p: Column, lines: Column, median_line: Column) -> Column:
    """Whether a paragraph of many short lines that end in no sentence is part of a table."""
    n = F.size(lines)
    average = F.aggregate(lines, F.lit(0), lambda a, l: a + F.length(l)) / n
    ends = F.size(F.filter(lines, lambda l: l.rlike(r"[.!?:][\"”’)]?$"))) / n
    words = F.size(F.split(p, r"\s+"))
    closed = F.regexp_count(p, F.lit(r"[a-z0-9)\]\"”’][.!?][\"”’)]?(\s|$)"))
    return (n >= 5) & (average < median_line * 0.5) & (ends < 0.25) & (closed / F.greatest(words / 18, F.lit(1.0)) < 0.35)


def kind_arrays(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str, cleaned: bool = False) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``kinds``: 'table', 'references' or null for each paragraph, in order.

    Each step is a column of its own that later ones read several times, so that it is computed once.
    """
    base = [id_col, *keep]
    read = F.transform(T.raw_paragraphs(F.col(text_col), cleaned), lambda p: F.struct(p.alias("raw"), flat(p).alias("t"), _lines(p).alias("lines")))
    rows = df.select(*base, read.alias("read"))
    lengths = F.array_sort(F.flatten(F.transform("read", lambda x: F.transform(x["lines"], lambda l: F.length(l)))))
    median = let(lengths, lambda l: F.coalesce(F.get(l, F.floor(F.size(l) / 2).cast("int")), F.lit(80)))
    rows = rows.select(*base, "read", median.alias("median"))
    rows = rows.select(
        *base,
        F.transform("read", lambda x: F.struct(
            x["t"].alias("t"),
            F.length(x["t"]).alias("len"),
            (is_table_fragment(x["raw"], x["lines"], F.col("median")) | is_symbol_noise(x["raw"])).alias("table"),
            citeish(x["t"]).alias("cite"),
            _is_entry(x["t"]).alias("entry"),
            F.exists(F.slice(x["lines"], 1, 2), lambda l: l.rlike(REF_HEADING)).alias("head"),
        )).alias("f"),
    )
    n = F.size("f")
    total = F.greatest(F.aggregate("f", F.lit(0), lambda a, x: a + x["len"]), F.lit(1))
    prose = lambda x: (x["len"] >= 200) & ~x["cite"]
    # where each section that a heading opens ends: one fold over flags, as a section is left by two prose paragraphs in a
    # row. A heading that is one of these two opens the next section; any other one inside a section changes nothing.
    state = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("chars"), F.lit(-1).alias("open"), F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("cites"),
        F.lit(False).alias("headed"), F.array().cast("array<struct<a:int,b:int>>").alias("found"),
    )

    def close(s):
        return F.when((s["open"] >= 0) & (s["cites"] >= 2), F.concat(s["found"], F.array(F.struct(s["open"].alias("a"), s["last"].alias("b"))))).otherwise(s["found"])

    def step(s, x):
        past = s["chars"] / F.col("total") >= 0.3
        alone = x["head"] & past & (s["i"] >= F.col("n") - 1)
        heads = x["head"] & past & ~alone
        run = F.when(s["open"] < 0, 0).when(x["prose"], s["run"] + 1).otherwise(0)
        leaves = (s["open"] >= 0) & (run >= 2)
        # prose cites nothing, so a section that opens one paragraph back has no citation yet
        back = leaves & s["headed"]
        opens = heads & ((s["open"] < 0) | leaves) & ~back
        one = x["cite"].cast("int")
        inside = (s["open"] >= 0) & ~x["prose"]
        found = F.when(leaves, close(s)).otherwise(s["found"])
        return F.struct(
            (s["i"] + 1).alias("i"),
            (s["chars"] + x["len"]).alias("chars"),
            F.when(back, s["i"] - 1).when(opens, s["i"]).when(leaves, -1).otherwise(s["open"]).alias("open"),
            F.when(back, s["i"] - 1).when(opens | inside, s["i"]).otherwise(s["last"]).alias("last"),
            F.when(back, 1).when(opens | leaves, 0).otherwise(run).alias("run"),
            # citations between the heading and the last paragraph that is not prose
            F.when(back, 0).when(opens, one).when(inside, s["cites"] + one).otherwise(s["cites"]).alias("cites"),
            heads.alias("headed"),
            F.when(alone, F.concat(found, F.array(F.struct(s["i"].alias("a"), s["i"].alias("b"))))).otherwise(found).alias("found"),
        )

    rows = rows.select(*base, "f", n.alias("n"), total.alias("total"), F.exists("f", lambda x: x["head"]).alias("any_head"))
    flags = F.transform("f", lambda x: F.struct(x["len"].alias("len"), x["head"].alias("head"), x["cite"].alias("cite"), prose(x).alias("prose")))
    no_section = F.array().cast("array<struct<a:int,b:int>>")
    sections = F.when(F.col("any_head"), F.aggregate(flags, state, step, close)).otherwise(no_section)
    # the run at the end of paragraphs that cite or are short
    breaks = F.array_max(F.transform("f", lambda x, i: F.when(prose(x) | ~(x["cite"] | (x["len"] < 60)), i).otherwise(-1)))
    rows = rows.select(*base, "f", "n", sections.alias("sections"), (F.coalesce(breaks, F.lit(-1)) + 1).alias("start"))
    rows = rows.select(*base, "f", "sections", "start", F.slice("f", F.col("start") + 1, F.greatest(F.col("n") - F.col("start"), F.lit(0))).alias("tail"))
    numbered = F.regexp_count(F.array_join(F.transform("tail", lambda x: x["t"]), "\n"), F.lit("(?:^|\\s)[0-9]{1,3}\\.\\s+[A-Z“\"]"))
    entries = F.size(F.filter("tail", lambda x: x["entry"]))
    enough = F.size(F.filter("tail", lambda x: x["cite"])) >= F.ceil(F.size("tail") * 0.6)
    rows = rows.select(*base, "f", "sections", "start", ((F.size("tail") > 0) & enough & ((numbered >= 3) | (entries >= 3))).alias("ends"))
    kinds = F.transform("f", lambda x, i: F.when(F.exists("sections", lambda r: (i >= r["a"]) & (i <= r["b"])), "references").when(x["table"], "table").when(F.col("ends") & (i >= F.col("start")), "references"))
    return rows.select(*base, kinds.alias("kinds"))


def paragraph_kinds(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``p``, ``kind``: 'table', 'references' or null for each paragraph."""
    return kind_arrays(df, id_col, text_col).select(id_col, F.posexplode_outer("kinds").alias("p", "kind")).where("p is not null")


def kinds_of_rows(paras: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``p``, ``kind`` of paragraphs that come as rows ``id_col, p, raw``, for documents too long for one row.

    Whole sets instead of a walk: two prose paragraphs in a row are a stop, a heading's section ends two
    paragraphs before the first stop that lies two or more behind it (else with the last paragraph that is not prose), and a paragraph
    is in a section if the sections begun up to it reach it.
    """
    lines = paras.select(id_col, F.explode(_lines(F.col("raw"))).alias("line")).groupBy(id_col, F.length("line").alias("len")).agg(F.count("*").alias("many"))
    # the middle one of all lengths, from how often each occurs
    upto = F.sum("many").over(Window.partitionBy(id_col).orderBy("len"))
    of_all = F.sum("many").over(Window.partitionBy(id_col))
    middle = lines.withColumns({"upto": upto, "half": F.floor(of_all / 2)}).where(F.col("upto") > F.col("half")).groupBy(id_col).agg(F.min("len").alias("median"))
    rows = paras.select(id_col, "p", "raw", flat(F.col("raw")).alias("t")).join(middle.hint("shuffle_hash"), id_col, "left")
    by = Window.partitionBy(id_col).orderBy("p")
    onward, before = by.rowsBetween(2, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(id_col)
    rows = rows.select(
        id_col, "p", "t", F.length("t").alias("len"), citeish(F.col("t")).alias("cite"), _is_entry(F.col("t")).alias("entry"),
        (is_table_fragment(F.col("raw"), _lines(F.col("raw")), F.coalesce("median", F.lit(80))) | is_symbol_noise(F.col("raw"))).alias("table"),
        F.exists(F.slice(F.split("raw", "\n"), 1, 2), lambda l: T.trim(l).rlike(REF_HEADING)).alias("head"),
    )
    rows = rows.withColumns({"prose": (F.col("len") >= 200) & ~F.col("cite"), "end": F.max("p").over(whole), "total": F.greatest(F.sum("len").over(whole), F.lit(1))})
    rows = rows.withColumns({"past": (F.sum("len").over(before) - F.col("len")) / F.col("total") >= 0.3, "cites": F.sum(F.col("cite").cast("int")).over(before)})
    stop = F.when(F.col("prose") & F.lag("prose").over(by), F.struct(F.col("p"), F.lag("cites", 2).over(by).alias("cites")))
    final = F.max_by(F.col("prose"), F.col("p")).over(whole)
    rows = rows.withColumns({"stop": stop, "final": final, "all": F.sum(F.col("cite").cast("int")).over(whole)})
    rows = rows.withColumn("ends", F.min("stop").over(onward))
    last = F.when(F.col("ends").isNotNull(), F.col("ends.p") - 2).otherwise(F.col("end") - F.col("final").cast("int"))
    cited = F.coalesce("ends.cites", "all") - F.col("cites") + F.col("cite").cast("int")
    reach = F.when(F.col("head") & F.col("past"), F.when(F.col("p") == F.col("end"), F.col("p")).when(cited >= 2, last))
    break_ = F.when(F.col("prose") | ~(F.col("cite") | (F.col("len") < 60)), F.col("p"))
    rows = rows.withColumns({"reach": F.max(reach).over(before), "start": F.coalesce(F.max(break_).over(whole), F.lit(-1)) + 1, "next": F.coalesce(F.lead("t").over(by), F.lit(""))})
    # a number at the end of a paragraph counts with the first letter of the next
    tail = F.col("p") >= F.col("start")
    numbers = F.regexp_count(F.concat(F.lit("\n"), F.col("t"), F.lit("\n"), F.substring("next", 1, 1)), F.lit("\\s[0-9]{1,3}\\.\\s+[A-Z“\"]"))
    told = lambda c: F.sum(F.when(tail, c)).over(whole)
    one = F.lit(1)
    ends = (told(F.col("cite").cast("int")) >= F.ceil(told(one) * 0.6)) & ((told(numbers) >= 3) | (told(F.col("entry").cast("int")) >= 3))
    kind = F.when(F.col("reach") >= F.col("p"), "references").when(F.col("table"), "table").when(ends & tail, "references")
    return rows.select(id_col, "p", kind.alias("kind"))


def _flags(paras: DataFrame, id_col: str) -> DataFrame:
    """``id_col``, ``_flags``: for rows ``id_col, p``, an array that is true at each of a document's ``p``, as long as its last one asks for."""
    rows = paras.where("p >= 0").groupBy(id_col).agg(F.array_sort(F.collect_set(F.col("p").cast("int"))).alias("at"))
    until = F.transform("at", lambda p, i: F.array_append(F.array_repeat(F.lit(False), p - F.coalesce(F.get("at", i - 1), F.lit(-1)) - 1), F.lit(True)))
    return rows.select(id_col, F.flatten(until).alias("_flags"))


def narration_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cleanup: bool = True, unassigned: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sentences with what is spoken and why one is passed over: ``id_col, pos, p, speak, skip`` and the columns ``keep``.

    ``unassigned`` has ``id_col, p``: paragraphs on pages that are not assigned; that reason comes before the others. Without
    ``cleanup`` only these are passed over, and sentences are spoken as they are written.
    """
    none = F.array().cast("array<string>")
    # kinds and sentences are both of the cleaned text
    df = df.withColumn(text_col, T.clean_text(F.col(text_col)))
    if cleanup:
        # the text goes along, so that a document's sentences and kinds meet in its own row
        rows = kind_arrays(df, id_col, text_col, text_col, *keep, cleaned=True)
    else:
        rows = df.select(id_col, text_col, *keep, none.alias("kinds"))
    reason = F.get("kinds", F.col("s.p"))
    if unassigned is not None:
        rows = rows.join(_flags(unassigned, id_col).hint("merge"), id_col, "left")
        reason = F.when(F.get("_flags", F.col("s.p")), "unassigned").otherwise(reason)
    held = ["kinds", "_flags"] if unassigned is not None else ["kinds"]
    rows = rows.select(id_col, *keep, *held, F.posexplode_outer(T.sentences(F.col(text_col), cleaned=True)).alias("pos", "s")).where("pos is not null")
    rows = rows.select(id_col, *keep, "pos", F.col("s.p").alias("p"), F.col("s.text").alias("text"), reason.alias("skip"))
    speak = F.when(F.col("skip").isNull(), T.speakable(F.col("text"))).otherwise(F.col("text")) if cleanup else F.col("text")
    return rows.select(id_col, "pos", "p", speak.alias("speak"), "skip", *keep)

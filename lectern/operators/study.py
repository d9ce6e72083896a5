"""Notes, citations and tasks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import trim

TASK_KINDS = ("reading", "quiz", "paper", "exam", "discussion", "other")


def _blank(c: Column) -> Column:
    return F.coalesce(trim(c), F.lit(""))


def authors(raw: Column) -> Column:
    parts = F.split(_blank(raw), r"\s*(?:;|(?<![A-Za-z0-9_])and(?![A-Za-z0-9_])|&)\s*")
    return F.filter(F.transform(parts, lambda a: trim(a)), lambda a: a != "")


def split_name(name: Column) -> Column:
    """(first, last) of "Last, First" or "First ... Last"."""
    by_comma, words = F.split(trim(name), ","), F.split(trim(name), r"\s+")
    given = F.struct(F.array_join(F.slice(words, 1, F.size(words) - 1), " ").alias("first"), F.element_at(words, -1).alias("last"))
    return F.when(F.contains(name, F.lit(",")), F.struct(trim(F.get(by_comma, F.lit(1))).alias("first"), trim(F.get(by_comma, F.lit(0))).alias("last"))).otherwise(given)


def _straight(name: Column) -> Column:
    n = split_name(name)
    return trim(F.concat(n["first"], F.lit(" "), n["last"]))


def end_period(c: Column) -> Column:
    return F.when(c.rlike(r"[.?!]$"), c).otherwise(F.concat(c, F.lit(".")))


def _published(publisher: Column, year: Column) -> Column:
    parts = F.filter(F.array(_blank(publisher), _blank(year)), lambda x: x != "")
    return F.array_join(parts, ", ")


def bibliography(title: Column, author: Column, publisher: Column, year: Column, url: Column) -> Column:
    """One entry: first author inverted, italic title, publisher and year, address; a period after each."""
    names = authors(author)
    first, others = split_name(F.get(names, F.lit(0))), F.transform(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), _straight)
    lead = F.when(first["first"] != "", F.concat(first["last"], F.lit(", "), first["first"])).otherwise(first["last"])
    many = F.concat(lead, F.lit(", "), F.array_join(F.slice(others, 1, F.greatest(F.size(others) - 1, F.lit(0))), ", "), F.lit(", and "), F.get(others, F.size(others) - 1))
    who = F.when(F.size(names) == 0, "").when(F.size(others) == 0, lead).when(F.size(others) == 1, F.concat(lead, F.lit(", and "), F.get(others, F.lit(0)))).otherwise(many)
    parts = F.array(who, F.concat(F.lit("*"), trim(title), F.lit("*")), _published(publisher, year), _blank(url))
    return F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: end_period(p)), " ")


def footnote(title: Column, author: Column, publisher: Column, year: Column, url: Column, page: Column) -> Column:
    names = F.transform(authors(author), _straight)
    at = lambda k: F.get(names, F.lit(k))
    who = F.when(F.size(names) <= 2, F.array_join(names, " and ")).when(F.size(names) == 3, F.concat(at(0), F.lit(", "), at(1), F.lit(", and "), at(2))).otherwise(F.concat(at(0), F.lit(" et al.")))
    italic, published = F.concat(F.lit("*"), trim(title), F.lit("*")), _published(publisher, year)
    note = F.concat(
        F.when(who != "", F.concat(who, F.lit(", "), italic)).otherwise(italic),
        F.when(published != "", F.concat(F.lit(" ("), published, F.lit(")"))).otherwise(""),
        F.when(_blank(page) != "", F.concat(F.lit(", "), trim(page))).otherwise(""),
        F.when((_blank(url) != "") & (published == ""), F.concat(F.lit(", "), trim(url))).otherwise(""),
    )
    return end_period(note)


def short_note(title: Column, author: Column, page: Column) -> Column:
    last = F.coalesce(split_name(F.get(authors(author), F.lit(0)))["last"], F.lit(""))
    short = F.array_join(F.slice(F.split(F.get(F.split(title, "[:.?]"), F.lit(0)), r"\s+"), 1, 4), " ")
    italic = F.concat(F.lit("*"), short, F.lit("*"))
    return end_period(F.concat(F.when(last != "", F.concat(last, F.lit(", "), italic)).otherwise(italic), F.when(_blank(page) != "", F.concat(F.lit(", "), trim(page))).otherwise("")))


def parse_tags(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, "[,#]"), lambda t: F.lower(trim(t))), lambda t: t != ""))


def parse_task_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A task for each line: ``date | course | kind | title`` with the title last and the rest in any order."""
    rows = df.select(id_col, F.posexplode(F.filter(F.transform(F.split(text_col, "\n"), lambda l: trim(l)), lambda l: l != "")).alias("k", "line"))
    parts = F.transform(F.split("line", r"\|"), lambda p: trim(p))
    rows = rows.select(id_col, "k", parts.alias("all")).withColumn("rest", F.slice("all", 1, F.size("all") - 1))
    kinds = F.array(*(F.lit(k) for k in TASK_KINDS))
    is_date = lambda p: p.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    is_kind = lambda p: F.array_contains(kinds, F.lower(p)) & ~is_date(p)
    last = lambda keep: F.get(F.reverse(F.filter("rest", keep)), F.lit(0))
    return rows.select(
        id_col, "k", F.element_at("all", -1).alias("title"), last(is_date).alias("due"), F.coalesce(F.lower(last(is_kind)), F.lit("other")).alias("kind"),
        F.coalesce(last(lambda p: ~is_date(p) & ~is_kind(p)), F.lit("")).alias("course"),
    )


def due_label(due: Column, as_of: Column) -> tuple[Column, Column]:
    """Label and class of a due date."""
    d = F.datediff(due, as_of)
    days = d.cast("string")
    text = F.when(d.isNull(), "no date").when(d < 0, F.concat((-d).cast("string"), F.lit("d overdue"))).when(d == 0, "today").when(d == 1, "tomorrow").otherwise(F.concat(F.lit("in "), days, F.lit("d")))
    return text, F.when(d.isNull(), "muted").when(d < 0, "overdue").when(d <= 3, "soon").otherwise("muted")


def quotes(notes: DataFrame, sents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``note_id``, ``quote``: the sentences of each note's range, with its paragraph breaks kept."""
    rows = notes.select("note_id", doc, "start", "end").join(sents.select(doc, "pos", "p", "text").hint("merge"), doc).where("pos between start and end")
    before = F.lag("p").over(Window.partitionBy("note_id").orderBy("pos"))
    part = F.when(before.isNull(), F.col("text")).when(before == F.col("p"), F.concat(F.lit(" "), F.col("text"))).otherwise(F.concat(F.lit("\n\n"), F.col("text")))
    rows = rows.select("note_id", "pos", part.alias("part"))
    return rows.groupBy("note_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda s: s["part"]), "").alias("quote"))


def note_block(title: Column, source: Column, created: Column, quote: Column, citation: Column, comment: Column, tags: Column) -> Column:
    """A note as Markdown."""
    lines = F.transform(F.split(quote, "\n"), lambda l: F.when(source == "reading", F.concat(F.lit("> "), l)).otherwise(l))
    head = F.concat(F.lit("### "), F.coalesce(title, F.when(source == "ai", "AI answer").otherwise("Note")), F.lit(" ("), created, F.lit(")"))
    parts = F.array(
        head, F.array_join(lines, "\n"),
        F.when(_blank(citation) != "", F.concat(F.lit("— "), citation)).otherwise(""),
        F.when(_blank(comment) != "", F.concat(F.lit("**My take:** "), trim(comment))).otherwise(""),
        F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " "))).otherwise(""),
    )
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")

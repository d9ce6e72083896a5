"""A course package from its script and files to readings, tasks, papers and notices, in the course's order."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import clean_text, trim
from lectern.operators import course
from lectern.operators.order import numbered
from lectern.shared import settle
from lectern.sources.packages import html_blocks

READABLE, HIDDEN = r"(?i)\.(pdf|docx|txt|md)$", r"(^|/)(__MACOSX|\.)"


class Package(NamedTuple):
    """Tables of a package, each with the id of its course."""

    #: ``ord, kind`` ('page' or 'file'), ``title, author, year, text, path, instruction, links``.
    readings: DataFrame
    #: ``module, item, title, kind`` ('paper' or 'quiz').
    tasks: DataFrame
    #: ``module, item, title, prompt, word_target``.
    papers: DataFrame
    #: ``modules``, the names of those that came without content, and ``notice``.
    notices: DataFrame


def page_text(html: Column) -> Column:
    """The paragraphs of a page, with an empty line between them."""

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: "\n\n".join(html_blocks(h if isinstance(h, str) else None)[1]))

    return read(html)


def file_name(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def course_package(courses: DataFrame, files: DataFrame, id_col: str = "id") -> Package:
    """``courses`` has ``id_col``, ``course`` (as ``parse_course`` gives it) and ``root``, the folder in front of the
    script's; ``files`` has ``id_col``, ``path`` and ``text``, null or blank where nothing could be read.

    Readings come in the order of modules and items: a page of enough words, then the files that it is the first
    to link; files that no item links come last, in the order of their names. What a course's first
    item of a title sets as a task counts. A page's lines tell how much of each of its files is to be read.
    """
    parsed = settle(courses.select(id_col, F.coalesce("root", F.lit("")).alias("root"), "course").where("course is not null"))
    items = course.course_items(parsed, id_col).select(
        id_col, "module", "name", "item", trim(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("type", F.lit("")).alias("type"), "content",
        clean_text(course.strip_boilerplate(page_text(F.col("content")))).alias("text"),
    )
    items = settle(items.withColumn("page", F.struct(id_col, "module", "item")))
    refs = settle(course.links(items.where("content is not null"), "page", "content"))

    long = (F.col("type") == "WikiPage") & (F.size(F.split("text", r"\s+")) >= course.LEAST_WORDS)
    outer = refs.where("kind <> 'file'").groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "kind", "label", "target"))), lambda r: F.struct(r["kind"], r["label"], r["target"])).alias("links"))
    pages = items.where(long).join(outer.hint("merge"), "page", "left").select(
        id_col, "module", "item", F.lit(0).alias("part"), F.lit("").alias("by_name"), F.lit("page").alias("kind"), "title", F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("year"), "text", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("instruction"), "links",
    )

    # files that can be read, with their place; a blank one is used up by its link, but is no reading
    inside = F.startswith("path", F.concat("root", F.lit("viewer/files/")))
    here = settle(files.select(id_col, "path", "text").join(parsed.select(id_col, "root").hint("shuffle_hash"), id_col).where(F.col("path").rlike(READABLE)))
    told = course.describe_file(file_name("path"))
    here = here.withColumns({"told": told, "filled": F.coalesce(F.length(trim(F.col("text"))) > 0, F.lit(False))})
    named = refs.where("kind = 'file'").select("page.*", "k", "target").join(parsed.select(id_col, "root").hint("shuffle_hash"), id_col)
    named = named.select(id_col, F.concat("root", "target").alias("path"), F.struct("module", "item", "k").alias("place")).groupBy(id_col, "path").agg(F.min("place").alias("place"))
    placed = settle(here.join(named.hint("merge"), [id_col, "path"], "left"))
    linked = placed.where("filled and place is not null").select(
        F.struct(F.col(id_col), F.col("place.module").alias("module"), F.col("place.item").alias("item")).alias("page"), F.col("place.k").alias("k"), "path", "text", "told"
    )
    by_page = linked.select("page", F.col("told.title").alias("title"))
    instructs = course.match_assignments(items.where("type = 'WikiPage'").select("page", "text"), by_page.distinct(), "page")
    linked = linked.withColumn("title", F.col("told.title")).join(instructs.hint("merge"), ["page", "title"], "left")
    none = F.lit(None).cast(pages.schema["links"].dataType)
    linked = linked.select(
        "page.*", (F.col("k") + 1).alias("part"), F.lit("").alias("by_name"), F.lit("file").alias("kind"), "title", "told.author", "told.year", "text", "path", "instruction", none.alias("links")
    )
    last = placed.where(F.col("place").isNull() & F.col("filled") & inside & ~F.col("path").rlike(HIDDEN)).select(
        id_col, F.lit(2**31 - 1).alias("module"), F.lit(0).alias("item"), F.lit(0).alias("part"), course.natural_key(F.col("path")).alias("by_name"), F.lit("file").alias("kind"),
        "told.title", "told.author", "told.year", "text", "path", F.lit(None).cast("string").alias("instruction"), none.alias("links"),
    )
    order = [F.col(c) for c in ("module", "item", "part", "by_name", "path")]
    readings = numbered(pages.unionByName(linked).unionByName(last), [id_col], order, "ord").drop("module", "item", "part", "by_name")

    work = items.where((F.col("type") == "Assignment") | F.contains("type", F.lit("Quiz"))).withColumn("key", F.lower("title"))
    first = work.groupBy(id_col, "key").agg(F.min(F.struct("module", "item")).alias("place")).select(id_col, "place.*")
    set_ = work.join(first.hint("merge"), [id_col, "module", "item"], "left_semi")
    essay = F.col("type") == "Assignment"
    tasks = set_.select(id_col, "module", "item", "title", F.when(essay, "paper").otherwise("quiz").alias("kind"))
    papers = set_.where(essay & (F.col("text") != "")).select(id_col, "module", "item", "title", F.col("text").alias("prompt"), course.word_target(F.col("text")).alias("word_target"))

    empty = course.empty_modules(items, id_col).groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("module", "name"))), lambda m: m["name"]).alias("modules"))
    notice = F.concat(F.array_join("modules", ", "), F.lit(": no content in this package; import it again once it is unlocked"))
    return Package(readings, tasks, papers, empty.select(id_col, "modules", notice.alias("notice")))

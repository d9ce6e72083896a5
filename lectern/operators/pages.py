"""Running lines of paged documents, printed page numbers, and assigned page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE_LINES, LEAST_PAGES, PAGE_SHARE, LONGEST_RUNNING = 4, 3, 0.3, 200
PAGE_NUMBER = r"(?i)^(page\s*)?[0-9ivxlc]{1,6}(\s*(of|/)\s*[0-9]+)?$"
STAMP = r"(?i)^this content downloaded from|^all use subject to https?://about\.jstor\.org"


def normal_line(c: Column) -> Column:
    """A line without case, with numbers made alike and signs made blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", "#"), "[^a-z#]+", " "))


def edge_lines(pages: DataFrame) -> DataFrame:
    """Lines of ``doc, page, lines`` (an array in order) as rows with ``line``, ``text`` and ``edge``.

    Edges are the first and last four lines with text of a page. Each page is looked at on its own.
    """
    filled = F.filter(F.transform("lines", lambda l, i: F.when(F.trim(l) != "", i)), lambda i: i.isNotNull())
    n = F.size(filled)
    edges = F.array_union(F.slice(filled, 1, EDGE_LINES), F.slice(filled, F.greatest(n - EDGE_LINES + 1, F.lit(1)), EDGE_LINES))
    rows = pages.select("doc", "page", edges.alias("edges"), F.posexplode("lines").alias("line", "text"))
    return rows.select("doc", "page", "line", "text", F.array_contains("edges", F.col("line")).alias("edge"))


def running_lines(pages: DataFrame) -> DataFrame:
    """``doc``, ``key``, ``pages``: edge lines that stand on enough pages of a document."""
    lines = edge_lines(pages).where("edge").select("doc", "page", normal_line(F.trim("text")).alias("key")).where("key <> ''")
    counted = lines.groupBy("doc", "key").agg(F.count_distinct("page").alias("pages"))
    sizes = pages.groupBy("doc").agg(F.count_distinct("page").alias("n"))
    enough = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("n") * PAGE_SHARE))
    return counted.where(F.col("pages") >= LEAST_PAGES).join(sizes.hint("merge"), "doc").where(F.col("pages") >= enough).select("doc", "key", "pages")


def strip_running_lines(pages: DataFrame) -> DataFrame:
    """Lines as rows, without page numbers, stamps and running lines at the edges."""
    lines = edge_lines(pages).withColumn("key", normal_line(F.trim("text")))
    t = F.trim("text")
    alone = t.rlike(PAGE_NUMBER) | t.rlike(STAMP)
    seen = running_lines(pages).select("doc", "key", F.lit(True).alias("runs"))
    noise = F.col("edge") & (t != "") & (alone | ((F.length(t) < LONGEST_RUNNING) & F.coalesce("runs", F.lit(False))))
    return lines.join(seen.hint("merge"), ["doc", "key"], "left").where(~noise).select("doc", "page", "line", "text")


def infer_page_numbers(detected: DataFrame) -> DataFrame:
    """``doc``, ``page``, ``n``, ``sure`` from ``doc, page, detected``.

    A detection counts if another page of the document agrees on its offset; other pages take the nearest
    trusted offset, the earlier of equals.
    """
    alike = F.count("*").over(Window.partitionBy("doc", "off"))
    rows = detected.withColumn("off", F.col("detected") - F.col("page"))
    rows = rows.withColumn("off", F.when(F.col("off").isNotNull() & (alike >= 2), F.col("off")))
    at = F.when(F.col("off").isNotNull(), F.struct(F.col("page").alias("page"), F.col("off").alias("off")))
    # the next one is the last one of the way back: a frame that is open at its end is summed anew for each row
    onward, back = (Window.partitionBy("doc").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.desc("page"), F.asc("page")))
    rows = rows.withColumn("after", F.last(at, ignorenulls=True).over(onward)).withColumn("before", F.last(at, ignorenulls=True).over(back))
    near = F.when(F.col("after").isNull() | (F.col("page") - F.col("before.page") <= F.col("after.page") - F.col("page")), F.col("before.off")).otherwise(F.col("after.off"))
    return rows.select("doc", "page", (F.col("page") + near).alias("n"), F.col("off").isNotNull().alias("sure"))


def parse_assigned_pages(c: Column) -> Column:
    """Array of (a, b) page ranges of an instruction; null if it names no pages."""
    spec = F.regexp_extract(c, r"(?i)(?<![A-Za-z0-9_])(?:read|pages?|pp?\.)\s*:?\s*(.*)$", 1)
    spec = F.regexp_replace(F.regexp_replace(spec, r"\([^)]*\)", " "), "[\"“”][^\"“”]*[\"“”]", " ")
    pattern = r"([0-9]{1,3})(?:\s*[-–—]\s*([0-9]{1,3}))?"
    first, second = (F.regexp_extract_all(spec, F.lit(pattern), F.lit(k)) for k in (1, 2))
    ranges = F.zip_with(first, second, lambda a, b: F.struct(a.cast("int").alias("a"), F.when(b != "", b).otherwise(a).cast("int").alias("b")))
    ranges = F.filter(ranges, lambda r: r["b"] >= r["a"])
    other = spec.rlike(r"(?i)(?<![A-Za-z0-9_])(chapter|section|attachment|appendix|skim)(?![A-Za-z0-9_])")
    return F.when(~other & (F.size(ranges) > 0), ranges)


def unassigned_pages(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """``doc``, ``page``, ``skip`` for documents whose ``ranges`` (``doc, ranges``) fall on printed pages.

    An unnumbered page next to an assigned one is kept.
    """
    inside = F.coalesce(F.exists("ranges", lambda r: (F.col("n") >= r["a"]) & (F.col("n") <= r["b"])), F.lit(False))
    joined = numbers.join(ranges.hint("merge"), "doc").withColumn("inside", inside)
    by = Window.partitionBy("doc").orderBy("page")
    beside = F.coalesce(F.lag("inside").over(by), F.lit(False)) | F.coalesce(F.lead("inside").over(by), F.lit(False))
    lands = F.bool_or(F.col("sure") & F.col("inside")).over(Window.partitionBy("doc"))
    rows = joined.withColumns({"beside": beside, "lands": lands}).where("lands")
    skip = ~F.col("inside") & F.col("n").isNotNull() & ~(~F.col("sure") & F.col("beside"))
    return rows.select("doc", "page", skip.alias("skip"))


def paragraph_pages(paragraphs: DataFrame, starts: DataFrame) -> DataFrame:
    """The page on which each paragraph stands: the last one that starts at or before it."""
    marks = starts.select("doc", F.col("start").alias("p"), F.col("page"), F.lit(0).alias("kind"))
    both = marks.unionByName(paragraphs.select("doc", "p", F.lit(None).cast("int").alias("page"), F.lit(1).alias("kind")))
    by = Window.partitionBy("doc").orderBy("p", "kind", "page").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("page", F.last("page", ignorenulls=True).over(by)).where("kind = 1").select("doc", "p", "page")


def detect_printed_number(lines: Column) -> Column:
    """The page number printed in the first or last three lines with text, if any."""
    filled = F.filter(F.transform(lines, lambda l: F.trim(l)), lambda l: l != "")
    n = F.size(filled)
    edges = F.concat(F.slice(filled, 1, 3), F.reverse(F.slice(filled, F.greatest(n - 2, F.lit(1)), 3)))
    found = lambda l, pattern: F.nullif(F.regexp_extract(l, pattern, 1), F.lit(""))
    number = lambda l: F.coalesce(
        found(l, r"(?i)^(?:page\s+)?([0-9]{1,3})$"), found(l, r"^([0-9]{1,3})\s+[A-Za-z•|].{2,90}$"), found(l, r"^.{2,90}[A-Za-z|•]\s+([0-9]{1,3})$")
    )
    return F.get(F.filter(F.transform(edges, number), lambda x: x.isNotNull()), F.lit(0)).cast("int")

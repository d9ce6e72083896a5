"""Course packages: links of lesson pages, file names, instructions, and items in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import trim

COURSE = "struct<title:string,modules:array<struct<name:string,items:array<struct<title:string,type:string,content:string,pointsPossible:double,dueAt:string>>>>>"
# Links that lead nowhere, boilerplate lines, words that titles share, and image types.
SKIPPED_LINKS = r"(?i)community\.canvaslms\.com|/profile/|^mailto:|^#|^announcements$"
BOILERPLATE = r"(?i)^\s*(be sure to click\s+)?\"?mark as done\"?|click \"mark as done\""
TITLE_STOP = "the and for with from into its our are read pages page".split()
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}
LEAST_WORDS, LEAST_CHARS, LEAST_OVERLAP, LEAST_IMAGE = 100, 400, 0.8, 2048


def attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf'(?i)(?<![A-Za-z0-9_]){name}\s*=\s*"([^"]*)"', 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit("&amp;"), F.lit("&"))


def strip_tags(html: Column) -> Column:
    text = F.replace(F.replace(F.regexp_replace(html, "<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return trim(F.regexp_replace(text, r"\s+", " "))


def image_label(tag: Column) -> Column:
    alt = F.regexp_extract(tag, r'(?i)<img\b[^>]*\balt\s*=\s*"([^"]*)"', 1)
    return trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(alt, r"(?i)\.(png|jpe?g|gif|svg)$", ""), "(?i)^icon[_ ]", ""), "_+", " "))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col``, ``k``, ``kind`` ('file', 'link', 'video'), ``target``, ``label``: first uses only, in page order."""
    tags = F.regexp_extract_all(html_col, F.lit(r"(?is)(<a\b[^>]*>.*?</a>|<iframe\b[^>]*>)"), F.lit(1))
    rows = pages.select(id_col, F.posexplode(tags).alias("at", "tag"))
    frame = F.col("tag").rlike("(?i)^<iframe")
    rows = rows.withColumn("frame", frame).withColumn("raw", F.when(frame, attribute(F.col("tag"), "src")).otherwise(attribute(F.col("tag"), "href")))
    rows = rows.where(F.col("raw").isNotNull() & ~F.col("raw").rlike(SKIPPED_LINKS))
    local = F.nullif(F.regexp_extract("raw", r"^(?:\./)?(viewer/files/[^?#]+)", 1), F.lit(""))
    rows = rows.withColumn("path", F.coalesce(F.try_url_decode(local), local)).where(F.col("path").isNotNull() | F.col("raw").rlike("(?i)^https?:"))
    rows = rows.withColumn("key", F.coalesce("path", F.substring_index("raw", "?", 1)))
    first = rows.groupBy(id_col, "key").agg(F.min("at").alias("at"))
    rows = rows.join(first.hint("merge"), [id_col, "key", "at"], "left_semi")
    kind = F.when(F.col("path").isNotNull(), "file").when(F.col("frame"), "video").otherwise("link")
    order = Window.partitionBy(id_col).orderBy("at")
    rows = rows.withColumn("kind", kind).withColumn("k", F.row_number().over(order) - 1).withColumn("videos", F.sum((F.col("kind") == "video").cast("int")).over(order))
    last = lambda c: F.element_at(F.filter(F.split(F.regexp_replace(c, "[?#].*$", ""), "/"), lambda p: p != ""), -1)
    watch = F.regexp_replace("raw", r"youtube\.com/embed/([A-Za-z0-9_-]+).*", "youtube.com/watch?v=$1")
    target = F.when(F.col("kind") == "file", F.col("path")).when(F.col("frame"), watch).otherwise(F.col("raw"))
    n = F.col("videos").cast("string")
    ted = F.regexp_extract("raw", r"ted\.com/talks/([^/?]+)", 1)
    video = (
        F.when(F.col("raw").rlike(r"youtube\.com|youtu\.be"), F.concat(F.lit("Video "), n, F.lit(" (YouTube)"))).when(ted != "", F.concat(F.lit("TED: "), F.replace(ted, F.lit("_"), F.lit(" "))))
        .when(F.contains("raw", F.lit("h5p")), F.concat(F.lit("Interactive "), n)).otherwise(F.concat(F.lit("Video "), n))
    )
    named = F.coalesce(F.nullif(strip_tags(F.col("tag")), F.lit("")), F.nullif(image_label(F.col("tag")), F.lit("")), F.try_url_decode(last(F.coalesce("path", "raw"))))
    return rows.select(id_col, "k", "kind", target.alias("target"), F.when(F.col("kind") == "video", video).otherwise(named).alias("label"))


def describe_file(name: Column) -> Column:
    """(title, author, year) of a file name."""
    base = name
    for pattern, to in ((r"\.[^.]+$", ""), ("(?i)^(pdf|doc|docx|file)[_ ]", ""), ("[_ ][0-9]{1,2}[A-Z][a-z]{2}[0-9]{2,4}$", ""), ("_", ": "), (r"\s+", " ")):
        base = F.regexp_replace(base, pattern, to)
    base = trim(base)
    pattern = r"(?i)^([^,:]{2,40}),\s*(.+?)\s*(?:\(([0-9]{4}|n\.?d\.?)\))?(?:\s+p{1,2}\.?\s*[0-9,\s-]+)?$"
    fits = base.rlike(pattern)
    part = lambda k: F.regexp_extract(base, pattern, k)
    year = F.when(fits & part(3).rlike("^[0-9]{4}$"), part(3))
    title = F.when(fits, trim(F.regexp_replace(part(2), r"[.:]\s*$", ""))).otherwise(base)
    return F.struct(title.alias("title"), F.when(fits, trim(part(1))).alias("author"), year.alias("year"))


def strip_boilerplate(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda l: ~trim(l).rlike(BOILERPLATE)), "\n")


def word_target(prompt: Column) -> Column:
    """The upper bound of "1,500-2,000 words"."""
    pattern = r"(?i)([0-9][0-9,]{2,5})\s*(?:[-–to]+\s*([0-9][0-9,]{2,5}))?\s*words?"
    low, high = (F.nullif(F.regexp_extract(prompt, pattern, k), F.lit("")) for k in (1, 2))
    return F.replace(F.coalesce(high, low), F.lit(","), F.lit("")).cast("long")


def title_words(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+")
    stop = F.array(*(F.lit(w) for w in TITLE_STOP))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def match_assignments(pages: DataFrame, titles: DataFrame, page: str = "page_id") -> DataFrame:
    """``page, title, instruction``: the line of a page whose start overlaps the title's words best, the first of equals.

    Titles and lines of one page meet on shared words, so no pair without one is made.
    """
    instructs = r"(?i)(?<![A-Za-z0-9_])(read|pages?)(?![A-Za-z0-9_])"
    lines = pages.select(page, F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("raw", trim(F.col("raw"))).where(F.col("raw").rlike(instructs + r"[^.]*[0-9]"))
    lines = lines.withColumn("start", F.regexp_instr("raw", F.lit(instructs)))
    head = F.regexp_replace(F.substring("raw", F.lit(1), F.col("start") - 1), r"(?i)\((?:[0-9]{4}|n\.?d\.?)\)\s*$", "")
    lines = lines.select(page, "line", trim(F.substring("raw", F.col("start"), F.length("raw"))).alias("instruction"), title_words(head).alias("have"))
    wants = titles.select(page, "title", title_words(F.col("title")).alias("want"))
    a = wants.select(page, "title", F.size("want").alias("nw"), F.explode("want").alias("word"))
    b = lines.select(page, "line", "instruction", F.size("have").alias("nh"), F.explode("have").alias("word"))
    shared = a.join(b.hint("merge"), [page, "word"]).groupBy(page, "title", "line", "instruction", "nw", "nh").agg(F.count("*").alias("shared"))
    scored = shared.withColumn("score", F.col("shared") / F.least("nw", "nh")).where(F.col("score") >= LEAST_OVERLAP)
    return scored.groupBy(page, "title").agg(F.min_by("instruction", F.struct(-F.col("score"), F.col("line"))).alias("instruction"))


def parse_course(text: Column) -> Column:
    """The course object between the first and the last brace of a script; null if it is not one."""
    course = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), COURSE)
    return F.when(course["modules"].isNotNull(), course)


def course_items(courses: DataFrame, id_col: str) -> DataFrame:
    """``id_col, module, name, item, title, type, content, due``: items in order."""
    rows = courses.select(id_col, F.posexplode("course.modules").alias("module", "m"))
    rows = rows.select(id_col, "module", F.col("m.name").alias("name"), F.posexplode("m.items").alias("item", "i"))
    return rows.select(id_col, "module", "name", "item", "i.title", "i.type", "i.content", F.col("i.dueAt").alias("due"))


def lessons(items: DataFrame) -> DataFrame:
    """Pages with enough words."""
    words = F.regexp_count(strip_tags(F.col("content")), F.lit(r"\S+"))
    return items.where((F.col("type") == "WikiPage") & (words >= LEAST_WORDS))


def empty_modules(items: DataFrame, id_col: str) -> DataFrame:
    """Modules that have pages, all of them empty."""
    page = F.col("type") == "WikiPage"
    filled = F.count_if(page & (F.coalesce(trim(F.col("content")), F.lit("")) != ""))
    return items.groupBy(id_col, "module", "name").agg(F.count_if(page).alias("pages"), filled.alias("filled")).where("pages > 0 and filled = 0").select(id_col, "module", "name")


def resolve_path(base: Column, href: Column) -> Column:
    """A relative path without ``.`` and ``..``, percent signs decoded."""
    parts = F.split(F.when(base != "", F.concat(base, F.lit("/"), href)).otherwise(href), "/")
    empty = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == "") | (p == "."), acc).otherwise(F.concat(acc, F.array(p)))
    joined = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.coalesce(F.try_url_decode(joined), joined)


def natural_key(name: Column) -> Column:
    """A sort key under which ``file2`` comes before ``file10``."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def folder_title(folder: Column, title: Column) -> Column:
    """The folder put before the title unless it is in it."""
    inside = F.contains(F.lower(title), F.lower(folder)) | (folder == "")
    return F.when(inside, title).otherwise(F.concat_ws(" — ", folder, title))


def lesson_image(path: Column, data: Column) -> Column:
    """The type of a content image; null for icons, unknown types and very small files."""
    types = F.create_map(*(F.lit(x) for kv in IMAGE_TYPES.items() for x in kv))
    name = F.element_at(F.split(path, "/"), -1)
    kind = F.try_element_at(types, F.lower(F.element_at(F.split(name, r"\."), -1)))
    icon = path.rlike(r"(?i)/icons?/|_icons?/") | name.rlike("(?i)^icon[_ ]")
    return F.when(~icon & (F.length(data) >= LEAST_IMAGE), kind)


def text_runs_to_lines(runs: DataFrame) -> DataFrame:
    """``doc, page, para, line, text`` from positioned runs ``doc, page, seq, str, y, height, eol``.

    A vertical gap of more than 1.8 heights starts a paragraph; an end mark closes a line.
    """
    by = Window.partitionBy("doc", "page").orderBy("seq")
    gap = (F.abs(F.col("y") - F.lag("y").over(by)) > 1.8 * F.col("height")).cast("int")
    rows = runs.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("ended", F.coalesce(F.lag("eol").over(by).cast("int"), F.lit(0)))
    rows = rows.withColumn("para", F.sum("gap").over(by)).withColumn("line", F.sum(F.greatest("gap", "ended")).over(by))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "str"))), lambda r: r["str"]), "")
    return rows.groupBy("doc", "page", "para", "line").agg(text.alias("text"))


# Fixed value: what tells the cover sheet that an archive puts in front of an article.
COVER = "(?i)JSTOR is a not-for-profit service"


def without_cover(lines: DataFrame) -> DataFrame:
    """Lines ``doc, page, line, text`` without a first page that is a cover sheet."""
    cover = lines.where((F.col("page") == 1) & F.col("text").rlike(COVER)).select("doc", "page").distinct()
    return lines.join(cover.hint("merge"), ["doc", "page"], "left_anti")

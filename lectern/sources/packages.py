"""Files: texts, packages of files, e-books, HTML paragraphs, and bundles of tables."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import clean_text
from lectern.operators.course import natural_key, resolve_path
from lectern.sources import archives

DOCUMENTS = r"(?i)\.(pdf|docx|html?|xhtml|txt|md)$"
# Elements of which nothing is read, and those that start a paragraph of their own.
DROPPED = frozenset("script style nav header footer aside noscript svg iframe button select template".split())
BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main ol p pre section table tbody td th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``title`` (the file's name), ``text``: whole text files."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return rows.select(F.regexp_replace(F.try_url_decode("name"), r"\.[^.]+$", "").alias("title"), clean_text(F.col("value")).alias("text"))


def package_entries(packages: DataFrame) -> DataFrame:
    """``path, entry, data, error``: the files of each package, those of packages inside it too, to any depth.

    ``packages`` has ``path`` and ``content`` as the binary file source gives them; a package that no row holds comes in
    parts, to ``archives.expand``. A bad package or entry gives a row with its error and fails nothing.
    """
    return archives.expand(archives.package_parts(packages.select("path", "content")))


def documents_of(entries: DataFrame) -> DataFrame:
    """Entries that are documents, with their natural order."""
    return entries.where(F.col("error").isNull() & F.col("entry").rlike(DOCUMENTS)).withColumn("sort_key", natural_key(F.col("entry")))


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[bool, str]] = []
        self.buffer: list[str] = []
        self.dropped = 0
        self.roots: list[str] = []
        self.title: list[str] = []
        self.in_title = False

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.blocks.append((bool(self.roots), text))
        self.buffer.clear()

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in DROPPED:
            self.dropped += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "img":
            self.buffer.append(" ")
        if tag in ("article", "main") and not self.dropped:
            self.roots.append(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS and tag not in _VOID:
            self.flush()
        if tag in self.roots:
            while self.roots.pop() != tag:
                pass
        if tag in DROPPED and self.dropped:
            self.dropped -= 1

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.dropped:
            self.buffer.append(data)


def html_blocks(html: str | None) -> tuple[str, list[str]]:
    """Title and paragraphs of a page: those of its article if it has one."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    inside = [t for rooted, t in parser.blocks if rooted]
    return "".join(parser.title).strip(), inside or [t for _, t in parser.blocks]


def html_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col, k, text``: the paragraphs of each page."""

    @F.pandas_udf("array<string>")
    def blocks(html: pd.Series) -> pd.Series:
        return html.map(lambda h: html_blocks(h if isinstance(h, str) else None)[1])

    return pages.select(id_col, F.posexplode(blocks(html_col)).alias("k", "text"))


def epub_chapters(entries: DataFrame, least_chars: int = 400) -> DataFrame:
    """``path, n, title, text``: the chapters of each book in the order of its spine.

    The container names the package file; its spine joins its manifest, and that the book's files.
    """
    files = entries.where("error is null").select("path", "entry", "data")
    text = F.decode("data", "UTF-8")
    container = files.where("entry = 'META-INF/container.xml'").select("path", F.regexp_extract(text, r'<rootfile\b[^>]*\bfull-path\s*=\s*"([^"]+)"', 1).alias("entry"))
    package = files.join(container.hint("merge"), ["path", "entry"]).select("path", F.when(F.contains("entry", F.lit("/")), F.regexp_replace("entry", "/[^/]*$", "")).otherwise("").alias("base"), text.alias("opf"))
    attr = lambda c, name: F.regexp_extract(c, rf'\b{name}\s*=\s*"([^"]*)"', 1)
    manifest = package.select("path", "base", F.explode(F.regexp_extract_all("opf", F.lit(r"(<item\b[^>]*>)"), F.lit(1))).alias("t"))
    manifest = manifest.select("path", attr("t", "id").alias("id"), resolve_path(F.col("base"), F.substring_index(attr("t", "href"), "#", 1)).alias("entry"))
    spine = package.select("path", F.posexplode(F.regexp_extract_all("opf", F.lit(r"(<itemref\b[^>]*>)"), F.lit(1))).alias("pos", "t")).select("path", "pos", attr("t", "idref").alias("id"))
    chapters = spine.join(manifest.hint("merge"), ["path", "id"]).join(files.hint("merge"), ["path", "entry"]).select("path", "pos", text.alias("html"))

    @F.pandas_udf("struct<title string, text string, heading string>")
    def read(html: pd.Series) -> pd.DataFrame:
        got = []
        for h in html:
            import re

            title, blocks = html_blocks(h)
            m = re.search(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]>", h or "")
            got.append((title, "\n\n".join(blocks), " ".join(re.sub("<[^>]+>", " ", m[1]).split()) if m else ""))
        return pd.DataFrame(got, columns=["title", "text", "heading"])

    from pyspark.sql import Window

    rows = chapters.withColumn("r", read("html")).select("path", "pos", "r.title", "r.heading", clean_text(F.col("r.text")).alias("text")).where(F.length("text") >= least_chars)
    n = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    book = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = rows.withColumn("n", n)
    return rows.select("path", "n", F.coalesce(none("heading"), none("title"), F.concat(book, F.lit(" — part "), F.col("n").cast("string"))).alias("title"), "text")


def export_bundle(tables: dict[str, DataFrame], path: str, exported_at: str, version: int = 1) -> DataFrame:
    """Write each table as JSON with binary columns in base64; returns and writes the manifest."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        out = df.select(*(F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes))
        out.write.mode("overwrite").json(f"{path}/{name}")
        rows.append((version, exported_at, name, df.count()))
    manifest = spark.createDataFrame(rows, "version int, exported_at string, table string, rows bigint")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def import_bundle(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    """The tables of a bundle; one that it lacks is empty."""
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    have = {r["table"] for r in spark.read.json(f"{path}/manifest").select("table").collect()}
    out = {}
    for name, schema in schemas.items():
        if name not in have:
            out[name] = spark.createDataFrame([], schema)
            continue
        plain = StructType([StructField(f.name, StringType() if isinstance(f.dataType, BinaryType) else f.dataType) for f in schema.fields])
        df = spark.read.schema(plain).json(f"{path}/{name}")
        out[name] = df.select(*(F.unbase64(f.name).alias(f.name) if isinstance(f.dataType, BinaryType) else F.col(f.name) for f in schema.fields))
    return out

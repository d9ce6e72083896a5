"""What a reader changes and sees: edits, completion, moved note ranges, answers without passages, files and images of lessons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import course

NO_ANSWER = "Nothing in your readings matched this question."
#: What is told of an answer's coverage; one that is 'answered' needs no word.
NOTICES = {
    "not_found": "Not found in the matching passages. Try other wording, widen the scope, or check the reading directly.",
    "partial": "Partial answer: the matching passages only cover part of this.",
}
IMAGE_NAME = r"(?i)\.(png|jpe?g|gif|webp)$"


def edited(stored: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each stored row (``key, text, position, page_starts``) after its edit (``key, text``), and whether its text ``changed``.

    An edit is cleaned first. A text that differs then loses its page map and starts anew; counts are always derived again.
    An edit without a text leaves the row as it is.
    """
    new = edits.select(key, T.clean_text(F.col("text")).alias("_text"))
    rows = stored.join(new, key, "left").withColumn("changed", F.coalesce(F.col("_text") != F.col("text"), F.col("_text").isNotNull()))
    rows = rows.withColumn("text", F.coalesce("_text", "text")).drop("_text")
    rows = rows.withColumn("page_starts", F.when(~F.col("changed"), F.col("page_starts")))
    return rows.withColumn("position", F.when(F.col("changed"), 0).otherwise(F.col("position"))).withColumn("word_count", T.word_count(F.col("text")))


def toggled(stored: DataFrame, toggles: DataFrame, key: str = "doc_id") -> DataFrame:
    """``stored`` with ``completed`` as last set in ``toggles`` (``key, completed, version``); whoever sets it goes back to the start."""
    last = toggles.groupBy(key).agg(F.max_by("completed", "version").alias("_set"))
    rows = stored.join(last, key, "left")
    rows = rows.withColumn("position", F.when(F.col("_set").isNotNull(), 0).otherwise(F.col("position")))
    return rows.withColumn("completed", F.coalesce("_set", "completed")).drop("_set")


def answer_states(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """``qid, passages, readings, coverage, answer`` of every question; one without passages is answered as not found, others are open."""
    found = passages.groupBy("qid").agg(F.count("*").alias("passages"), F.count_distinct("doc_id").alias("readings"))
    rows = questions.select("qid").join(found, "qid", "left").na.fill(0, ["passages", "readings"])
    none = F.col("passages") == 0
    return rows.withColumn("coverage", F.when(none, "not_found")).withColumn("answer", F.when(none, NO_ANSWER))


def coverage_notice(coverage: Column) -> Column:
    return F.when(coverage == "not_found", NOTICES["not_found"]).when(coverage != "answered", NOTICES["partial"])


def with_reading(notes: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Notes with the title of their reading, null and ``gone`` where it is no longer there."""
    have = docs.select(key, "title", F.lit(False).alias("gone"))
    return notes.join(have, key, "left").withColumn("gone", F.coalesce("gone", F.lit(True)))


def moved(start: Column, end: Column, sentences: Column, edge: Column, delta: Column) -> tuple[Column, Column]:
    """The range of a note after its ``edge`` has moved out (1) or in (-1) by a sentence; it stays in the text and keeps a sentence."""
    first = F.least(F.greatest(F.lit(0), start - delta), end)
    last = F.greatest(F.least(sentences - 1, end + delta), start)
    return F.when(edge == "start", first).otherwise(start), F.when(edge == "start", end).otherwise(last)


def answer_note(question: Column, answer: Column, titles: Column) -> Column:
    """An answer as a note: its quote, comment, tags and the titles that it rests on."""
    named = F.nullif(F.array_join(titles, "; "), F.lit(""))
    return F.struct(T.trim(answer).alias("quote"), F.concat(F.lit("Q: "), T.trim(question)).alias("comment"), F.array(F.lit("ai")).alias("tags"), named.alias("titles"))


def assignment_detail(kind: Column, reason: Column, read_all: Column, pages_read: Column, pages_total: Column) -> Column:
    """What is told of an assignment of kind 'partial' or 'whole', and of a 'whole' one by its reason."""
    total = pages_total.cast("string")
    everything = F.concat(F.lit("Reading the whole document ("), total, F.lit(" pages)."))
    some = F.concat(F.lit("Reading only the assigned pages: "), pages_read.cast("string"), F.lit(" of "), total, F.lit(" PDF pages."))
    partial = F.when(read_all, everything).otherwise(some)
    whole = F.when(reason == "whole", "That's the whole document.").when(reason == "not-pages", "Not a page range, so the whole document is read.")
    return F.when(kind == "partial", partial).otherwise(whole.otherwise("This PDF's page numbers couldn't be matched, so the whole document is read."))


def linked_files(refs: DataFrame, files: DataFrame, order: list[str]) -> DataFrame:
    """Each file once: with the first reference to it by ``order``, or as ``leftover``; ``natural`` sorts leftovers.

    ``refs`` has ``path`` and the columns of ``order``, ``files`` has ``path``; references to no file are dropped.
    """
    first = refs.groupBy("path").agg(F.min(F.struct(*order)).alias("at"))
    rows = files.select("path").distinct().join(first, "path", "left")
    return rows.select("path", *(F.col(f"at.{c}").alias(c) for c in order), F.col("at").isNull().alias("leftover"), course.natural_key(F.col("path")).alias("natural"))


def placed_images(positions: DataFrame, images: DataFrame, page: str) -> DataFrame:
    """Images of ``images`` (``page, n, alt, path, data``) that are content, at the paragraph of their marker in ``positions`` (``page, n, para``)."""
    kind = course.lesson_image(F.col("path"), F.col("data"))
    good = images.withColumn("type", kind).where("type is not null")
    return positions.join(good, [page, "n"]).select(page, "n", "para", F.regexp_replace("alt", IMAGE_NAME, "").alias("alt"), "type", "data")


def regrouped(sents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Paragraphs of sentences in order: ``id_col, p, items`` of ``pos, text`` and ``skip`` if there is one. A paragraph's sentences are neighbours."""
    item = F.struct("pos", "text", *(c for c in sents.columns if c == "skip"))
    return sents.groupBy(id_col, "p").agg(F.sort_array(F.collect_list(item)).alias("items"))


def created(rows: DataFrame, batch: str, order: str, base_ms: Column) -> DataFrame:
    """Rows of a batch with times of creation that tell them apart, a millisecond after another in their order."""
    k = F.row_number().over(Window.partitionBy(batch).orderBy(order)) - 1
    return rows.withColumn("created_ms", base_ms + k)


def dictionary(batch: DataFrame, library: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, docs, in_batch``: in how many texts of the batch and the library together each word is, and in how many of the batch."""
    both = batch.select(text_col, F.lit(1).alias("new")).unionByName(library.select(text_col, F.lit(0).alias("new")))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}+"), F.lit(0)))
    return both.select(F.explode(words).alias("word"), "new").groupBy("word").agg(F.count("*").alias("docs"), F.sum("new").alias("in_batch"))

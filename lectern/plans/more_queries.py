"""Queries over scopes, appends, re-estimates, papers and small text rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import classify, library, pages, segment, study
from lectern.plans import ledger_queries as L
from lectern.plans import page_queries as P
from lectern.plans.base import READINGS, TO_SENTS, query, readings, table
from lectern.shared import fresh_path, settle


@query(f"WITH {TO_SENTS} SELECT s.doc_id, count(*) AS sentences FROM sents s JOIN readings r USING (doc_id) WHERE r.course = 'src0' GROUP BY 1")
def course_scope(spark, sf_dir):
    """The scope is filtered before anything is derived from texts."""
    return segment.sentences(readings(spark, sf_dir).where("course = 'src0'")).groupBy("doc_id").agg(F.count("*").alias("sentences"))


@query("SELECT page_id, length(html) AS size FROM pages")
def bulk_append(spark, sf_dir):
    """Two appends to one table, each committed as a whole."""
    path, rows = fresh_path(spark), table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("size"))
    for odd in (0, 1):
        rows.where(F.col("page_id") % 2 == odd).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS listen_words, doc_id % 2 = 1 AS changed FROM documents""")
def reestimate(spark, sf_dir):
    """Words to hear, computed anew where the stored value was of other settings."""
    docs = table(spark, sf_dir, "documents").withColumn("stored", F.when(F.col("doc_id") % 2 == 0, T.word_count(F.col("text"))).otherwise(-1))
    now = T.word_count(F.col("text"))
    return docs.select("doc_id", now.alias("listen_words"), (F.col("stored") != now).alias("changed"))


@query(r"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) < 400 THEN 'short' WHEN len(regexp_extract_all(text, '\S+')) < 100 THEN 'few words' ELSE 'ok' END AS status FROM documents""")
def doc_quality(spark, sf_dir):
    status = F.when(F.trim("text") == "", "empty").when(F.length("text") < 400, "short").when(T.word_count(F.col("text")) < 100, "few words").otherwise("ok")
    return table(spark, sf_dir, "documents").select("doc_id", status.alias("status"))


@query(f"WITH {P.SPOKEN} SELECT doc_id, pos, speak FROM spoken WHERE skip IS NULL")
def spoken_sentences(spark, sf_dir):
    """What narration speaks, sentence by sentence, what it passes over left out."""
    docs = P.with_references(spark, sf_dir)
    return classify.narration_plan(docs).where("skip is null").select("doc_id", "pos", "speak")


@query(f"""WITH {P._SKIP}, {READINGS}, p AS (SELECT doc_id AS doc, unnest(range(len(list_filter(string_split(text, chr(10) || chr(10)), lambda z: trim(z) <> '')))) AS p FROM readings)
SELECT p.doc, p.p FROM p JOIN sk ON sk.doc = p.doc AND sk.page = p.p // 3 WHERE skip""")
def unassigned_paragraphs(spark, sf_dir):
    """Paragraphs on pages that are not assigned; page k starts at paragraph 3k."""
    skip = pages.unassigned_pages(P._numbers(spark, sf_dir), P._ranges(spark, sf_dir))
    # texts are cut once; their numbers of paragraphs serve for the paragraphs and for where pages start
    many = settle(readings(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.size(T.paragraphs(F.col("text"))).alias("n"))).where("n > 0")
    paras = many.select("doc", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    starts = paras.where("p % 3 = 0").select("doc", F.col("p").alias("start"), F.floor(F.col("p") / 3).cast("int").alias("page"))
    return pages.paragraph_pages(paras, starts).join(skip.hint("merge"), ["doc", "page"]).where("skip").select("doc", F.col("p").cast("long").alias("p"))


@query(f"WITH {L._OUT} SELECT outcome, course, count(*) AS n FROM oc WHERE outcome = 'updated' GROUP BY ALL")
def import_enrich(spark, sf_dir):
    """Page data put on readings of equal text, by course."""
    return library.import_new(*L._split(spark, sf_dir), "doc_id").where("outcome = 'updated'").groupBy("outcome", "course").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS owner, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS paper FROM orders GROUP BY 1")
def papers_recent(spark, sf_dir):
    """The paper that each owner changed last."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("paper"))


@query("SELECT c_custkey AS id, 2000 AS word_target, '' AS thesis, '' AS draft, 0 AS sources FROM customer")
def paper_defaults(spark, sf_dir):
    blank = F.lit("")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(2000).alias("word_target"), blank.alias("thesis"), blank.alias("draft"), F.array().cast("array<string>").alias("source_ids"))
    return rows.select("id", "word_target", "thesis", "draft", F.size("source_ids").alias("sources"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8")
def capped_lists(spark, sf_dir):
    """The newest eight answers of each user: the list has that length."""
    by = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(by)).where("n <= 8").select("user_id", "event_id")


@query("""SELECT conv_id, turn, replace('*' || role || '* said: ' || text, '*', '') AS plain, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS label FROM conversations""")
def plain_quotes(spark, sf_dir):
    """Italics taken out, and labels cut with an ellipsis."""
    marked = F.concat(F.lit("*"), "role", F.lit("* said: "), "text")
    label = F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 60), F.lit("…"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace(marked, F.lit("*"), F.lit("")).alias("plain"), label.alias("label"))


@query(f"WITH {READINGS}, n AS (SELECT doc_id, string_split_regex(trim(title), '\\s+') AS w FROM readings) SELECT doc_id, array_to_string(w[1:4], ' ') AS short FROM n")
def short_titles(spark, sf_dir):
    words = F.split(T.trim(F.col("title")), r"\s+")
    return readings(spark, sf_dir).select("doc_id", F.array_join(F.slice(words, 1, 4), " ").alias("short"))


@query("SELECT o_orderkey AS id, 'Q: ' || trim(o_orderpriority) AS comment, 'ai' AS tag FROM orders")
def answer_notes(spark, sf_dir):
    """Answers as notes."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Q: "), T.trim(F.col("o_orderpriority"))).alias("comment"), F.get(study.parse_tags(F.lit("AI")), F.lit(0)).alias("tag"))


@query("SELECT doc_id, array_to_string(list_sort(list_filter(['a' || CASE WHEN doc_id % 2 = 0 THEN 9 ELSE 1 END, CASE WHEN doc_id % 2 = 0 THEN 'b2' END, 'c' || (doc_id % 5)], lambda x: x IS NOT NULL)), ',') AS coaching FROM documents")
def patch_maps(spark, sf_dir):
    """Maps merged key by key: a patch replaces and adds, other keys stay."""
    number = lambda x: F.lit(x).cast("long")
    base = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("a"), number(1), F.lit("c"), F.col("doc_id") % 5).alias("coaching"))
    patches = base.where("doc_id % 2 = 0").select("doc_id", F.create_map(F.lit("a"), number(9), F.lit("b"), number(2)).alias("coaching"))
    merged = library.patch(base, patches, "doc_id", [], ("coaching",))
    pairs = F.transform(F.map_entries("coaching"), lambda e: F.concat(e["key"], e["value"].cast("string")))
    return merged.select("doc_id", F.array_join(F.array_sort(pairs), ",").alias("coaching"))

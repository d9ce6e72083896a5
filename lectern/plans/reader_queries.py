"""Queries over edits, completion, notes, answers, and files and images of lessons."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import classify, pages, rank, reader, segment
from lectern.plans import more_queries as M
from lectern.plans import page_queries as P
from lectern.plans import text_queries as X
from lectern.plans.base import CLEANED, READINGS, TO_SENTS, query, readings, table
from lectern.shared import settle

_RENEWED = CLEANED.replace("cleaned AS", "renewed AS").replace("FROM readings", "FROM ed")


@query(rf"""WITH {READINGS}, {CLEANED}, ed AS (SELECT doc_id, course, CASE WHEN completed THEN text || '  ' || chr(10) ELSE regexp_replace(text, '^[^\n]*\n*', '') END AS text FROM readings), {_RENEWED}
SELECT doc_id, n.text <> c.text AS changed, CASE WHEN n.text = c.text THEN position ELSE 0 END AS position, n.text = c.text AS has_pages, len(regexp_extract_all(n.text, '\S+'))::BIGINT AS word_count
FROM cleaned c JOIN renewed n USING (doc_id) JOIN readings USING (doc_id)""")
def edit_readings(spark, sf_dir):
    """Readings saved again: the completed ones with blanks at their end, the others without their first line."""
    docs = readings(spark, sf_dir)
    stored = docs.select("doc_id", T.clean_text(F.col("text")).alias("text"), "position", F.array(F.lit(0)).alias("page_starts"))
    text = F.when(F.col("completed"), F.concat("text", F.lit("  \n"))).otherwise(F.regexp_replace("text", r"^[^\n]*\n*", ""))
    rows = reader.edited(stored, docs.select("doc_id", text.alias("text")))
    return rows.select("doc_id", "changed", F.col("position").cast("long").alias("position"), F.col("page_starts").isNotNull().alias("has_pages"), "word_count")


@query(f"""WITH {READINGS}, t AS (SELECT doc_id, toxic = 1 AS c FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, toxic DESC) = 1)
SELECT doc_id, coalesce(c, completed) AS completed, CASE WHEN c IS NULL THEN position ELSE 0 END AS position FROM readings LEFT JOIN t USING (doc_id)""")
def toggle_completed(spark, sf_dir):
    """Labelled readings set to complete or not, which puts them back to their start."""
    toggles = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("completed"), F.struct("quality", "toxic").alias("version"))
    return reader.toggled(readings(spark, sf_dir).select("doc_id", "completed", "position"), toggles).select("doc_id", "completed", "position")


@query(f"""WITH RECURSIVE {X.TOP}, n AS (SELECT q.qid, count(t.n) AS passages, count(DISTINCT t.doc_id) AS readings FROM questions q LEFT JOIN top t USING (qid) GROUP BY 1)
SELECT qid, passages, readings, CASE WHEN passages = 0 THEN 'not_found' END AS coverage, CASE WHEN passages = 0 THEN '{reader.NO_ANSWER}' END AS answer FROM n""")
def answer_states(spark, sf_dir):
    asked = X.questions(spark, sf_dir)
    return reader.answer_states(asked, settle(rank.ranked(X._pool(spark, sf_dir), asked)))


@query(f"WITH {READINGS} SELECT o_orderkey AS note_id, o_custkey AS doc_id, title, r.doc_id IS NULL AS gone FROM orders LEFT JOIN readings r ON r.doc_id = o_custkey")
def note_readings(spark, sf_dir):
    """Orders as notes on the reading of their customer's number; some readings are gone."""
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("doc_id"))
    return reader.with_reading(notes, readings(spark, sf_dir)).select("note_id", "doc_id", "title", "gone")


@query(f"""WITH {TO_SENTS}, n AS (SELECT doc_id, count(*) AS n FROM sents GROUP BY 1), r AS (SELECT doc_id, n, least(position, n - 1) AS a, least(position + 1, n - 1) AS b FROM readings JOIN n USING (doc_id)),
m AS (SELECT * FROM r, (VALUES ('start', 1), ('start', -1), ('end', 1), ('end', -1)) AS v(edge, delta))
SELECT doc_id AS note_id, edge, delta, CASE WHEN edge = 'start' THEN least(greatest(0, a - delta), b) ELSE a END AS first, CASE WHEN edge = 'end' THEN greatest(least(n - 1, b + delta), a) ELSE b END AS last FROM m""")
def note_moves(spark, sf_dir):
    """A note of two sentences on each reading, either edge moved out and in."""
    docs = readings(spark, sf_dir).select("doc_id", "position", F.size(T.sentences(F.col("text"))).cast("long").alias("n")).where("n > 0")
    a, b = F.least("position", F.col("n") - 1), F.least(F.col("position") + 1, F.col("n") - 1)
    moves = F.array(*(F.struct(F.lit(e).alias("edge"), F.lit(d).alias("delta")) for e in ("start", "end") for d in (1, -1)))
    rows = docs.select(F.col("doc_id").alias("note_id"), "n", a.alias("a"), b.alias("b"), F.explode(moves).alias("m")).select("note_id", "n", "a", "b", "m.*")
    first, last = reader.moved(F.col("a"), F.col("b"), F.col("n"), F.col("edge"), F.col("delta"))
    return rows.select("note_id", "edge", "delta", first.cast("long").alias("first"), last.cast("long").alias("last"))


@query(f"""WITH {READINGS}, a AS (SELECT item_id AS qid, unnest([item_id, item_id + 1]) AS doc_id FROM benchmark), t AS (SELECT qid, string_agg(title, '; ' ORDER BY doc_id) AS titles FROM a JOIN readings USING (doc_id) GROUP BY 1)
SELECT item_id AS qid, 'Q: ' || trim(text, ' ' || chr(9) || chr(10)) AS comment, 'ai' AS tags, titles FROM benchmark LEFT JOIN t ON qid = item_id""")
def answer_note_titles(spark, sf_dir):
    """Notes of answers with the titles of the readings that they cite, in the order cited."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    cited = settle(items.select("qid", F.explode(F.array("qid", F.col("qid") + 1)).alias("doc_id")))
    rows = readings(spark, sf_dir).select("doc_id", "title").join(cited.hint("merge"), "doc_id")
    titles = rows.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "title"))), lambda x: x["title"]).alias("titles"))
    none = F.array().cast("array<string>")
    noted = items.join(titles, "qid", "left").select("qid", reader.answer_note(F.col("question"), F.col("question"), F.coalesce("titles", none)).alias("note"))
    return noted.select("qid", "note.comment", F.array_join("note.tags", ",").alias("tags"), "note.titles")


@query(f"""WITH {P._SKIP}, tot AS (SELECT doc, count(*) FILTER (WHERE NOT skip) AS r, count(*) AS t FROM sk GROUP BY 1), st AS (SELECT s_suppkey AS doc, s_nationkey < 5 AS other, s_acctbal < 0 AS read_all, r, t FROM supplier LEFT JOIN tot ON doc = s_suppkey)
SELECT doc, CASE WHEN other THEN 'Not a page range, so the whole document is read.' WHEN t IS NULL THEN 'This PDF''s page numbers couldn''t be matched, so the whole document is read.' WHEN r = t THEN 'That''s the whole document.'
WHEN read_all THEN 'Reading the whole document (' || t || ' pages).' ELSE 'Reading only the assigned pages: ' || r || ' of ' || t || ' PDF pages.' END AS detail FROM st""")
def assignment_details(spark, sf_dir):
    """What is told of each supplier's assignment; those of five nations name no pages, those in debt are read whole."""
    given = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), (F.col("s_nationkey") < 5).alias("other"), (F.col("s_acctbal") < 0).alias("read_all"))
    skips = pages.unassigned_pages(P._numbers(spark, sf_dir), P._ranges(spark, sf_dir))
    totals = skips.groupBy("doc").agg(F.count_if(~F.col("skip")).alias("read"), F.count("*").alias("total"))
    rows = given.join(totals, "doc", "left")
    partial = ~F.col("other") & (F.col("read") < F.col("total"))
    reason = F.when(F.col("other"), "not-pages").when(F.col("total").isNull(), "unmatched").otherwise("whole")
    detail = reader.assignment_detail(F.when(partial, "partial").otherwise("whole"), reason, F.col("read_all"), F.col("read"), F.col("total"))
    return rows.select("doc", detail.alias("detail"))


@query("""WITH f AS (SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS ref FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT 'files/part' || p_partkey || '.pdf' AS path, ref // 10 AS module, ref % 10 AS item, ref IS NULL AS leftover, 'files/part' || lpad(p_partkey::VARCHAR, 20, '0') || '.pdf' AS natural FROM part LEFT JOIN f ON l_partkey = p_partkey""")
def linked_files(spark, sf_dir):
    """Returned lines as links from lessons to files of parts."""
    path = lambda c: F.concat(F.lit("files/part"), F.col(c).cast("string"), F.lit(".pdf"))
    refs = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(path("l_partkey").alias("path"), F.col("l_orderkey").alias("module"), F.col("l_linenumber").alias("item"))
    return reader.linked_files(refs, table(spark, sf_dir, "part").select(path("p_partkey").alias("path")), ["module", "item"])


@query("""WITH d AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda z: trim(z) <> '')) AS k, length(text) >= 2000 AS big FROM documents)
SELECT doc_id, 0 AS n, 0 AS para, 'Chart' AS alt FROM d WHERE big UNION ALL SELECT doc_id, 1, k, 'Map' FROM d WHERE big""")
def lesson_images(spark, sf_dir):
    """Markers of three images in each text: a chart, a map and an icon; images of short texts are too small to be content."""
    text = F.concat(F.lit("[[img0]]\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n[[img1]]\n\n[[img2]]"))
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", T.take_markers(text, r"\[\[img([0-9]+)\]\]").alias("t"))
    positions = settle(marked.select("doc_id", F.explode("t.positions").alias("x")).select("doc_id", "x.n", "x.para"))
    named = (("Chart.png", "files/chart.png"), ("Map.JPEG", "files/map.jpeg"), ("Next", "files/icons/next.png"))
    listed = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(alt).alias("alt"), F.lit(path).alias("path")) for n, (alt, path) in enumerate(named)))
    images = settle(docs.select("doc_id", F.substring("text", 1, 2000).alias("data"), F.explode(listed).alias("i")).select("doc_id", "i.*", F.when(F.length("data") >= 2000, F.repeat("data", F.lit(4))).otherwise("").alias("data")))
    placed = reader.placed_images(positions, images.hint("merge"), "doc_id")
    return placed.select("doc_id", F.col("n").cast("long").alias("n"), F.col("para").cast("long").alias("para"), "alt")


@query(f"WITH {TO_SENTS} SELECT doc_id, p, min(pos) AS pos, count(*) AS n, string_agg(text, ' ' ORDER BY pos) AS text FROM sents GROUP BY 1, 2")
def regrouped(spark, sf_dir):
    """Sentences put together to paragraphs again."""
    rows = reader.regrouped(segment.sentences(readings(spark, sf_dir)))
    text = F.array_join(F.transform("items", lambda s: s["text"]), " ")
    return rows.select("doc_id", F.col("p").cast("long").alias("p"), F.get("items", F.lit(0))["pos"].cast("long").alias("pos"), F.size("items").cast("long").alias("n"), text.alias("text"))


@query("SELECT l_orderkey AS batch, l_linenumber AS line, epoch_ms(o_orderdate::TIMESTAMP) + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS created_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def creation_order(spark, sf_dir):
    """Lines of an order as rows parsed at once."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"), "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("line")).join(orders, "batch")
    return reader.created(rows, "batch", "line", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000).select("batch", "line", "created_ms")


@query(r"""WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS word, new FROM (SELECT text, 1 AS new FROM benchmark UNION ALL SELECT text, 0 FROM documents))
SELECT word, count(*) AS docs, sum(new)::BIGINT AS in_batch FROM w GROUP BY 1""")
def dictionary_union(spark, sf_dir):
    """Words of a batch and of the library together."""
    return reader.dictionary(table(spark, sf_dir, "benchmark").select("text"), table(spark, sf_dir, "documents").select("text"))


@query(rf"""WITH {TO_SENTS}, {P._SKIP}, un AS (SELECT doc, page FROM sk WHERE skip)
SELECT s.doc_id, count(*) AS n, count(un.doc) AS unassigned, sum(CASE WHEN un.doc IS NULL AND pos >= position THEN len(regexp_extract_all(s.text, '\S+')) ELSE 0 END)::BIGINT AS words_left
FROM sents s JOIN readings r USING (doc_id) LEFT JOIN un ON un.doc = s.doc_id AND un.page = s.p // 3 GROUP BY 1""")
def words_left_assigned(spark, sf_dir):
    """Words that are still to be heard when only pages that are not assigned are passed over."""
    docs = readings(spark, sf_dir)
    rows = classify.narration_plan(docs, cleanup=False, unassigned=M.unassigned_paragraphs(spark, sf_dir).withColumnRenamed("doc", "doc_id"), keep=("position",))
    left = F.col("skip").isNull() & (F.col("pos") >= F.col("position"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("skip").alias("unassigned"), F.sum(F.when(left, T.word_count(F.col("speak"))).otherwise(0)).alias("words_left"))

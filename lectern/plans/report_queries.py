"""Reports over the library: what an import did, diagnostics, storage, images in order, and pages without their cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import course, images, library, repair
from lectern.plans import ledger_queries as L
from lectern.plans import package_queries as K
from lectern.plans import page_queries as P
from lectern.plans.base import query, table
from lectern.shared import passing_path


@query(f"""SELECT (WITH {L._OUT} SELECT count(*) FILTER (WHERE outcome = 'added') FROM oc) AS added, (WITH {L._OUT} SELECT count(*) FILTER (WHERE outcome = 'updated') FROM oc) AS updated,
(WITH {L._OUT} SELECT count(*) FILTER (WHERE outcome = 'skipped') FROM oc) AS skipped, (WITH {K._BUILT}, {K._SETS} SELECT count(*) FILTER (WHERE kind = 'page') FROM readings) AS pages,
(WITH {K._BUILT}, n AS (SELECT DISTINCT id, lower(trim(title)) FROM it WHERE type <> 'WikiPage') SELECT count(*) FROM n) AS tasks,
(WITH {K._BUILT}, n AS (SELECT *, row_number() OVER (PARTITION BY id, lower(trim(title)) ORDER BY t) AS k FROM it WHERE type <> 'WikiPage') SELECT count(*) FROM n WHERE k = 1 AND type = 'Assignment') AS papers,
(WITH {P._REPAIRED} SELECT coalesce(sum(fixes), 0)::BIGINT FROM repaired) AS repaired, (WITH {P._REPAIRED} SELECT count(*) FILTER (WHERE fixes > 0) FROM repaired) AS repaired_docs,
(WITH {K._BUILT}, m AS (SELECT id, t // 3 AS module FROM it WHERE type = 'WikiPage' GROUP BY ALL HAVING bool_and(text = '')) SELECT count(DISTINCT id) FROM m) AS notices""")
def import_counts(spark, sf_dir) -> DataFrame:
    """Everything that an import tells when it is done; each side of the joins is one row."""
    outcome = library.import_new(*L._split(spark, sf_dir), "doc_id")
    told = outcome.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "updated", "skipped")))
    made = K.built(spark, sf_dir)
    repaired = repair.repair(P.damaged(spark, sf_dir)).agg(F.coalesce(F.sum("fixes"), F.lit(0)).alias("repaired"), F.count_if(F.col("fixes") > 0).alias("repaired_docs"))
    for part in (
        made.readings.agg(F.count_if(F.col("kind") == "page").alias("pages")), made.tasks.agg(F.count("*").alias("tasks")), made.papers.agg(F.count("*").alias("papers")), repaired, made.notices.agg(F.count("*").alias("notices")),
    ):
        told = told.crossJoin(F.broadcast(part))
    return told


SETTINGS = {"rate": "1.25", "cleanup": "true", "budget": "20", "apiKey": "hidden"}


@query(r"""SELECT '{"rate":"1.25","cleanup":"true","budget":"20","apiKeySet":"true"}' AS settings,
to_json({'documents': (SELECT count(*) FROM documents), 'words': (SELECT sum(len(regexp_extract_all(text, '\S+')))::BIGINT FROM documents), 'pages': (SELECT count(*) FROM pages), 'tasks': (SELECT count(*) FROM orders), 'calls': (SELECT count(*) FROM events)})::VARCHAR AS counts,
(SELECT to_json(list({'id': event_id, 'message': substr(props, 1, 500)} ORDER BY ts DESC, event_id DESC))::VARCHAR FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 30)) AS errors""")
def diagnostic_report(spark, sf_dir) -> DataFrame:
    """One row to send to whoever helps: settings without the key, counts, and the newest thirty errors."""
    safe = {k: v for k, v in SETTINGS.items() if k != "apiKey"} | {"apiKeySet": str(bool(SETTINGS.get("apiKey"))).lower()}
    n = lambda t, name: table(spark, sf_dir, t).agg(F.count("*").alias(name))
    words = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.sum(T.word_count(F.col("text"))).alias("words"))
    counts = words.crossJoin(F.broadcast(n("pages", "pages"))).crossJoin(F.broadcast(n("orders", "tasks"))).crossJoin(F.broadcast(n("events", "calls")))
    newest = table(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(30)
    rows = newest.agg(F.reverse(F.sort_array(F.collect_list(F.struct("ts", "event_id", "props")))).alias("rows"))
    errors = rows.select(F.to_json(F.transform("rows", lambda r: F.struct(r["event_id"].alias("id"), F.substring(r["props"], 1, 500).alias("message")))).alias("errors"))
    told = counts.select(F.to_json(F.struct("documents", "words", "pages", "tasks", "calls")).alias("counts")).crossJoin(F.broadcast(errors))
    return told.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in safe.items()))).alias("settings"), "counts", "errors")


def shown_bytes(n: Column) -> Column:
    """Whole megabytes, and gigabytes with one digit beyond a thousand million."""
    return F.when(n > 1e9, F.concat(F.format_string("%.1f", n / 1e9), F.lit(" GB"))).otherwise(F.concat(F.floor(n / 1e6 + 0.5).cast("string"), F.lit(" MB")))


@query("""WITH b AS (SELECT source, sum(strlen(text)) * 997::BIGINT AS bytes FROM documents GROUP BY 1)
SELECT source, bytes::BIGINT AS bytes, CASE WHEN bytes > 1000000000 THEN printf('%.1f', bytes / 1e9) || ' GB' ELSE floor(bytes / 1e6 + 0.5)::BIGINT || ' MB' END AS shown FROM b""")
def storage_sizes(spark, sf_dir) -> DataFrame:
    """Bytes that each course's texts take up (times 997, to have sizes of both kinds), as they are shown."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg((F.sum(F.octet_length("text")) * 997).alias("bytes"))
    return rows.select("source", "bytes", shown_bytes(F.col("bytes")).alias("shown"))


@query("""SELECT conv_id AS reading, turn AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, strlen(text) AS bytes FROM conversations WHERE conv_id % 5 <> 0""")
def image_scan(spark, sf_dir) -> DataFrame:
    """The images of all readings in order, from the layout by reading; those of every fifth one went with it."""
    store = images.ImageStore(spark, passing_path(spark))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("reading"), F.col("turn").alias("n"), F.col("text").cast("binary").alias("data"))
    store.write(turns)
    gone = turns.where("reading % 5 = 0").select("reading").distinct()
    left = images.without(store.scans(turns.select("reading")), gone)
    place = F.row_number().over(Window.partitionBy("reading").orderBy("n"))
    return left.select("reading", "n", place.cast("long").alias("place"), F.octet_length("data").cast("long").alias("bytes"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
SELECT doc_id AS doc, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS page, k AS line, line AS text FROM l""")
def without_cover(spark, sf_dir) -> DataFrame:
    """Lines of documents of which every seventh came with a publisher's cover sheet in front."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 7 == 0
    lines = docs.select(F.col("doc_id").alias("doc"), F.when(k, 2).otherwise(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    cover = docs.where(k).select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.array(F.lit("A title of 1999"), F.lit("jstor is a not-for-profit service that helps"), F.lit("Terms of use"))).alias("line", "text"))
    rows = course.without_cover(lines.unionByName(cover))
    return rows.select("doc", F.col("page").cast("long").alias("page"), (F.col("line") + 1).cast("long").alias("line"), "text")

"""Queries over the usage ledger, progress, tasks and keyed tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import ledger, library, study
from lectern.plans.base import READINGS, query, readings, table

AS_OF = "2024-03-15"
RULES = [(1, "^model-0", 4.0, 20.0, 0.05), (2, "^model-[01]", 10.0, 50.0, 0.1), (3, "^model-2", 2.0, 10.0, 0.1)]

#: Events as calls; months are spread by the event's id.
USAGE = """rules(rule_no, pattern, in_price, out_price, cache_read) AS (VALUES (1, '^model-0', 4.0, 20.0, 0.05), (2, '^model-[01]', 10.0, 50.0, 0.1), (3, '^model-2', 2.0, 10.0, 0.1)),
us AS (SELECT event_id, ts::TIMESTAMP + to_days(CAST((event_id % 3) * 31 AS INTEGER)) AS called,
  CASE event_type WHEN 'view' THEN 'Ask: find terms' WHEN 'click' THEN 'Ask: answer' WHEN 'purchase' THEN 'Reading brief' WHEN 'signup' THEN 'Paper: Review' ELSE 'Connection test' END AS feature,
  'model-' || (user_id % 4) AS model, CAST(floor(value * 10) AS BIGINT) AS input, CAST(coalesce(json_extract_string(props, '$.k'), '0') AS BIGINT) AS output, user_id AS cache_write, event_id % 100 AS cache_read_tokens FROM events),
pr AS (SELECT model, min_by(r, rule_no) AS r FROM (SELECT DISTINCT model FROM us) m LEFT JOIN (SELECT *, {'i': in_price::DOUBLE, 'o': out_price::DOUBLE, 'c': cache_read::DOUBLE} AS r FROM rules) x ON regexp_matches(model, pattern) GROUP BY 1),
usage AS (SELECT us.*, (input * p.i + cache_write * p.i * 1.25 + cache_read_tokens * p.i * p.c + output * p.o) / 1000000 AS cost FROM us JOIN (SELECT model, coalesce(r, {'i': 4.0::DOUBLE, 'o': 20.0::DOUBLE, 'c': 0.05::DOUBLE}) AS p FROM pr) USING (model))"""


def raw_usage(events):
    feature = F.create_map(*(F.lit(x) for x in ("view", "Ask: find terms", "click", "Ask: answer", "purchase", "Reading brief", "signup", "Paper: Review")))
    return events.select(
        "event_id",
        (F.col("ts").cast("timestamp") + F.make_dt_interval(((F.col("event_id") % 3) * 31).cast("int"))).alias("at"),
        F.coalesce(F.try_element_at(feature, F.col("event_type")), F.lit("Connection test")).alias("feature"),
        F.concat(F.lit("model-"), (F.col("user_id") % 4).cast("string")).alias("model"),
        F.floor(F.col("value") * 10).cast("long").alias("input"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("output"),
        F.col("user_id").alias("cache_write"),
        (F.col("event_id") % 100).alias("cache_read_tokens"),
    )


def usage(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "rule_no int, pattern string, in_price double, out_price double, cache_read double")
    return ledger.with_cost(raw_usage(table(spark, sf_dir, "events")), rules)


@query(f"WITH {USAGE} SELECT event_id, feature, model, round(cost, 9) AS cost FROM usage")
def usage_cost(spark, sf_dir):
    return usage(spark, sf_dir).select("event_id", "feature", "model", F.round("cost", 9).alias("cost"))


@query(f"""WITH {USAGE} SELECT CASE WHEN feature LIKE 'Ask%' THEN 'Ask' ELSE feature END AS feature, count(*) FILTER (WHERE feature NOT LIKE 'Ask%' OR feature = 'Ask: answer') AS calls,
sum(input + cache_write + cache_read_tokens)::BIGINT AS tokens_in, sum(output)::BIGINT AS tokens_out, round(sum(cost), 6) AS cost FROM usage GROUP BY 1""")
def usage_by_feature(spark, sf_dir):
    return ledger.by_feature(usage(spark, sf_dir))


@query(f"WITH {USAGE} SELECT strftime(called, '%Y-%m') AS month, round(sum(cost), 6) AS cost, count(*) AS calls FROM usage GROUP BY 1")
def usage_by_month(spark, sf_dir):
    return usage(spark, sf_dir).groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("calls"))


@query(f"""WITH {USAGE} SELECT round(coalesce(sum(cost) FILTER (WHERE called >= '2024-03-01'), 0), 6) AS this_month,
round(coalesce(sum(cost) FILTER (WHERE called >= '2024-02-01' AND called < '2024-03-01'), 0), 6) AS last_month, round(sum(cost), 6) AS all_time FROM usage""")
def spend_totals(spark, sf_dir):
    return ledger.spend(usage(spark, sf_dir), AS_OF)


@query(f"WITH {USAGE} SELECT round(sum(cost) FILTER (WHERE feature LIKE 'Ask%') / greatest(count(*) FILTER (WHERE feature = 'Ask: answer'), 1), 6) AS per_question FROM usage")
def ask_average(spark, sf_dir):
    asks = F.sum(F.when(F.startswith("feature", F.lit("Ask")), F.col("cost")))
    return usage(spark, sf_dir).agg(F.round(asks / F.greatest(F.count_if(F.col("feature") == "Ask: answer"), F.lit(1)), 6).alias("per_question"))


@query(f"""WITH {USAGE}, m AS (SELECT strftime(called, '%Y-%m') AS month, sum(cost) AS spent FROM usage GROUP BY 1) SELECT month, round(least(1, spent / 3.0), 6) AS share,
CASE WHEN spent / 3.0 >= 1 THEN 'reached' WHEN spent / 3.0 >= 0.8 THEN 'near' ELSE 'ok' END AS status, CASE WHEN spent = 0 THEN '$0.00' WHEN spent < 0.01 THEN printf('$%.4f', spent) ELSE printf('$%.2f', spent) END AS shown FROM m""")
def budget_status(spark, sf_dir):
    months = usage(spark, sf_dir).groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(F.sum("cost").alias("spent"))
    limit = F.lit(3.0)
    return months.select("month", F.round(F.least(F.lit(1.0), F.col("spent") / limit), 6).alias("share"), ledger.budget_status(F.col("spent"), limit).alias("status"), ledger.format_usd(F.col("spent")).alias("shown"))


@query(f"WITH {USAGE} SELECT event_id, feature, round(cost, 9) AS cost FROM usage ORDER BY called DESC, event_id DESC LIMIT 30")
def recent_calls(spark, sf_dir):
    """The newest thirty calls: a report."""
    return usage(spark, sf_dir).orderBy(F.desc("at"), F.desc("event_id")).limit(30).select("event_id", "feature", F.round("cost", 9).alias("cost"))


@query(f"""WITH {USAGE} SELECT strftime(called, '%Y-%m-%dT%H:%M:%S.%g') || 'Z,' || feature || ',' || model || ',' || input || ',' || output || ',' || cache_write || ',' || cache_read_tokens || ',' || printf('%.6f', cost + 1e-9) AS line FROM usage""")
def usage_csv(spark, sf_dir):
    fields = [F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "feature", "model", "input", "output", "cache_write", "cache_read_tokens", F.format_string("%.6f", F.col("cost") + 1e-9)]
    cols = [ledger.csv_field((F.col(c) if isinstance(c, str) else c).cast("string")) for c in fields]
    return usage(spark, sf_dir).select(F.concat_ws(",", *cols).alias("line"))


@query(f"""WITH {READINGS}, s AS (SELECT sum(word_count) * 6 AS a, sum(CASE WHEN NOT completed THEN word_count END) * 6 AS b FROM readings)
SELECT round(a / 1000000.0 * 15, 6) AS all_by_million, round(a / 1000.0 * 0.165, 6) AS all_by_thousand, round(b / 1000000.0 * 15, 6) AS left_by_million, round(b / 1000.0 * 0.165, 6) AS left_by_thousand FROM s""")
def narration_cost(spark, sf_dir):
    chars = F.sum("word_count") * 6
    left = F.sum(F.when(~F.col("completed"), F.col("word_count"))) * 6
    by = lambda c, n, price: F.round(c / n * price, 6)
    return readings(spark, sf_dir).agg(
        by(chars, 1e6, 15).alias("all_by_million"), by(chars, 1e3, 0.165).alias("all_by_thousand"), by(left, 1e6, 15).alias("left_by_million"), by(left, 1e3, 0.165).alias("left_by_thousand")
    )


TASKS = """tasks AS (SELECT o_orderkey AS id, o_custkey AS course, o_orderdate::DATE AS due, o_orderstatus = 'F' AS done,
  list_extract(['reading', 'quiz', 'paper', 'exam', 'discussion', 'other'], 1 + ascii(o_orderpriority) % 6) AS kind FROM orders)"""


def tasks(spark, sf_dir):
    kinds = F.array(*(F.lit(k) for k in study.TASK_KINDS))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("course"), F.to_date("o_orderdate").alias("due"), (F.col("o_orderstatus") == "F").alias("done"),
        F.get(kinds, F.ascii("o_orderpriority") % 6).alias("kind"),
    )


@query(f"WITH {TASKS} SELECT id, course, row_number() OVER (PARTITION BY course ORDER BY done, due, id) AS n FROM tasks")
def tasks_sorted(spark, sf_dir):
    """The place of each task in its course: open ones first, then by date."""
    by = Window.partitionBy("course").orderBy("done", F.coalesce("due", F.lit("9999-12-31").cast("date")), "id")
    return tasks(spark, sf_dir).select("id", "course", F.row_number().over(by).alias("n"))


@query(f"""WITH {TASKS}, d AS (SELECT id, date_diff('day', DATE '1998-01-01', due) AS d FROM tasks) SELECT id,
CASE WHEN d < 0 THEN -d || 'd overdue' WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'tomorrow' ELSE 'in ' || d || 'd' END AS label, CASE WHEN d < 0 THEN 'overdue' WHEN d <= 3 THEN 'soon' ELSE 'muted' END AS class FROM d""")
def task_due(spark, sf_dir):
    label, kind = study.due_label(F.col("due"), F.lit("1998-01-01").cast("date"))
    return tasks(spark, sf_dir).select("id", label.alias("label"), kind.alias("class"))


@query(f"WITH {TASKS} SELECT id, strftime(due, '%Y-%m-%d') AS due FROM tasks WHERE NOT done ORDER BY due, id LIMIT 6")
def tasks_upcoming(spark, sf_dir):
    """The next six open tasks: a report."""
    return tasks(spark, sf_dir).where(~F.col("done")).orderBy("due", "id").limit(6).select("id", F.date_format("due", "yyyy-MM-dd").alias("due"))


@query("""SELECT o_orderkey AS id, 0 AS k, 'Task ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS due, 'quiz' AS kind, 'C' || o_custkey AS course FROM orders
UNION ALL SELECT o_orderkey, 1, 'Bare ' || o_orderkey, NULL, 'other', '' FROM orders""")
def task_lines(spark, sf_dir):
    text = F.format_string("%s | C%d | Quiz | Task %d\n\n  Bare %d ", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_custkey", "o_orderkey", "o_orderkey")
    lines = study.parse_task_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")), "id", "text")
    return lines.select("id", F.col("k").cast("long").alias("k"), "title", "due", "kind", "course")


# --- keyed tables --------------------------------------------------------------------------------


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'labels', count(*) FROM labels")
def scan_counts(spark, sf_dir):
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "pages", "events", "labels")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new ' || source ELSE source END AS course FROM documents")
def upsert(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("course"), F.lit(1).alias("version"))
    delta = base.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("new "), "course").alias("course"), F.lit(2).alias("version"))
    return library.upsert(base, delta, "doc_id", "version").select("doc_id", "course")


@query("SELECT doc_id, 'image' AS kind FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'reading' FROM documents WHERE doc_id % 5 <> 0")
def delete_cascade(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    gone = docs.where("doc_id % 5 = 0")
    both = [library.delete(docs, gone, "doc_id").select("doc_id", F.lit(k).alias("kind")) for k in ("reading", "image")]
    return both[0].unionByName(both[1])


_LIB = "b AS (SELECT doc_id, source AS course, 'T' || (doc_id // 3) AS title, text, doc_id % 4 = 1 AS has_pages FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, source AS course, 't' || (doc_id // 3) AS title, text, true AS has_pages FROM documents)"


def _split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("course"), F.floor(F.col("doc_id") / 3).cast("string").alias("t"), "text")
    base = docs.where("doc_id % 2 = 0").select("doc_id", "course", F.concat(F.lit("T"), "t").alias("title"), "text", (F.col("doc_id") % 4 == 1).alias("has_pages"))
    return base, docs.select("doc_id", "course", F.concat(F.lit("t"), "t").alias("title"), "text", F.lit(True).alias("has_pages"))


_OUT = f"""{_LIB}, f AS (SELECT course, lower(title) AS k, min(doc_id) AS first FROM n GROUP BY ALL),
h AS (SELECT course, lower(title) AS k, min_by({{'t': text, 'p': has_pages}}, text) AS have FROM b GROUP BY ALL),
oc AS (SELECT doc_id, CASE WHEN doc_id <> first THEN 'skipped' WHEN have IS NULL THEN 'added' WHEN NOT have.p AND have.t = text THEN 'updated' ELSE 'skipped' END AS outcome, n.course
  FROM n JOIN f ON f.course = n.course AND f.k = lower(n.title) LEFT JOIN h ON h.course = n.course AND h.k = lower(n.title))"""


@query(f"WITH {_OUT} SELECT doc_id, outcome FROM oc")
def import_dedup(spark, sf_dir):
    return library.import_new(*_split(spark, sf_dir), "doc_id").select("doc_id", "outcome")


@query(f"WITH {_OUT} SELECT outcome, count(*) AS n FROM oc GROUP BY 1")
def import_summary(spark, sf_dir):
    return library.import_new(*_split(spark, sf_dir), "doc_id").groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {_OUT}, m AS (SELECT course, max(doc_id) AS top FROM b GROUP BY 1) SELECT doc_id, coalesce(top, 0) + row_number() OVER (PARTITION BY course ORDER BY doc_id) AS ord FROM oc LEFT JOIN m USING (course) WHERE outcome = 'added'")
def order_assign(spark, sf_dir):
    base, batch = _split(spark, sf_dir)
    new = library.import_new(base, batch, "doc_id").where("outcome = 'added'")
    return library.assign_order(base.select("course", F.col("doc_id").alias("ord")), new, "doc_id").select("doc_id", "ord")


@query("""WITH s AS (SELECT user_id AS id, min(CAST(floor(value) AS BIGINT)) AS position, bool_or(event_type = 'signup') AS completed FROM events GROUP BY 1),
l AS (SELECT user_id AS id, max(CAST(floor(value) AS BIGINT)) AS position, bool_or(event_type = 'purchase') AS completed FROM events WHERE user_id % 3 = 0 GROUP BY 1)
SELECT id, coalesce(l.position, s.position) AS position, coalesce(s.completed, false) OR coalesce(l.completed, false) AS completed FROM s FULL JOIN l USING (id)""")
def progress_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.floor("value").cast("long").alias("position"), "event_type")
    stored = e.groupBy("id").agg(F.min("position").alias("position"), F.bool_or(F.col("event_type") == "signup").alias("completed"))
    live = e.where("id % 3 = 0").groupBy("id").agg(F.max("position").alias("position"), F.bool_or(F.col("event_type") == "purchase").alias("completed"))
    return library.merge_progress(stored, live, "id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS course, lang FROM documents")
def patch_merge(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("course"), "lang")
    patches = base.where("doc_id % 3 = 0").select("doc_id", F.upper("course").alias("course"), F.lit(None).cast("string").alias("lang"))
    return library.patch(base, patches, "doc_id", ["course", "lang"])


@query(f"WITH {READINGS} SELECT doc_id FROM readings WHERE contains(lower(title || ' ' || course), 'src1')")
def library_filter(spark, sf_dir):
    return readings(spark, sf_dir).where(F.contains(F.lower(F.concat_ws(" ", "title", "course")), F.lit("src1"))).select("doc_id")


@query("SELECT 'course' AS facet, source AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2")
def facets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one = lambda name, c: docs.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n")
    return one("course", "source").unionByName(one("lang", "lang"))


@query(f"WITH {READINGS} SELECT doc_id, word_count FROM readings WHERE word_count < 80 AND NOT regexp_matches(title, '(?i)^(lesson|course)')")
def thin_docs(spark, sf_dir):
    return readings(spark, sf_dir).where((F.col("word_count") < 80) & ~F.col("title").rlike("(?i)^(lesson|course)")).select("doc_id", "word_count")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 = 0")
def missing_meta(spark, sf_dir):
    """Sources without an author or a year; an empty string counts as missing."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 3 == 0, "").otherwise("A").alias("author"), F.when(k % 5 != 0, "1990").alias("year"))
    none = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return rows.where(none("author") | none("year")).select("id")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN len(regexp_extract_all(text, '\S+')) ELSE n_chars END::BIGINT AS listen_words FROM documents""")
def backfill_listen_words(spark, sf_dir):
    """A derived column is filled where it is missing only."""
    docs = table(spark, sf_dir, "documents").withColumn("old", F.when(F.col("doc_id") % 2 == 1, F.col("n_chars")))
    return docs.select("doc_id", F.coalesce("old", T.word_count(F.col("text"))).alias("listen_words"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Untitled reading' ELSE lang END AS title, CASE WHEN doc_id % 4 = 0 THEN 'Unsorted' ELSE source END AS course FROM documents WHERE trim(text) <> ''")
def ingest_defaults(spark, sf_dir):
    given = lambda keep, c: F.when(keep, F.col(c)).otherwise("  ")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", given(F.col("doc_id") % 3 != 0, "lang").alias("title"), given(F.col("doc_id") % 4 != 0, "source").alias("course"))
    default = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d)).alias(c)
    return docs.where(F.trim("text") != "").select("doc_id", default("title", "Untitled reading"), default("course", "Unsorted"))


@query("SELECT CASE WHEN doc_id % 20 = 0 THEN 'none' WHEN doc_id % 20 > 14 THEN 'old' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1")
def backup_age(spark, sf_dir):
    k = (F.col("doc_id") % 20).cast("int")
    age = F.datediff(F.lit("2024-03-15").cast("date"), F.when(k > 0, F.date_sub(F.lit("2024-03-15").cast("date"), k)))
    status = F.when(age.isNull(), "none").when(age > 14, "old").otherwise("ok")
    return table(spark, sf_dir, "documents").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM conversations) AS conversations, (SELECT count(*) FROM labels WHERE quality = 0) AS poor")
def report_counts(spark, sf_dir):
    """One row of counts; each side of the joins is a single row."""
    n = lambda t, c: table(spark, sf_dir, t).agg(F.count("*").alias(c))
    poor = table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 0).alias("poor"))
    return n("documents", "documents").crossJoin(n("pages", "pages")).crossJoin(n("conversations", "conversations")).crossJoin(poor)


@query("SELECT event_id, substr(repeat(props, 40), 1, 500) AS message FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def error_log(spark, sf_dir):
    """The newest hundred errors, their messages cut to five hundred characters: a log of that size."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return rows.select("event_id", F.substring(F.repeat("props", 40), 1, 500).alias("message"))


@query("""WITH a AS (SELECT c_custkey AS id, [c_custkey % 5, c_custkey % 7, 99] AS x, [c_custkey % 3, 99] AS y FROM customer)
SELECT id, array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS both, array_to_string(list_sort(list_distinct(list_filter(x, lambda z: NOT list_contains(y, z)))), ',') AS less FROM a""")
def set_ops(spark, sf_dir):
    """Selections: the union with another one, and what is left without it."""
    k = F.col("c_custkey")
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda e: e.cast("string")), ",")
    x, y = F.array(k % 5, k % 7, F.lit(99).cast("long")), F.array(k % 3, F.lit(99).cast("long"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), joined(F.array_union(x, y)).alias("both"), joined(F.array_except(x, y)).alias("less"))

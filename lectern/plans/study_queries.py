"""Queries over notes, citations, course packages, pages, and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import course, segment, study
from lectern.plans import ledger_queries as L
from lectern.plans.base import READINGS, TO_SENTS, query, readings, table, tokens_sql
from lectern.shared import passing_path
from lectern.sources import packages
from lectern.streaming import index, jobs

#: Sources from parts: their author line has one to four names.
_SOURCES = """src AS (SELECT p_partkey AS id, p_name AS title, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'John Boyd' WHEN 2 THEN 'Boyd, John and Mary Ann Coe' WHEN 3 THEN 'John Boyd; Mary Coe & Ed Poe' ELSE 'A One; B Two; C Three; D Four' END AS author,
CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE '' END AS publisher, CASE WHEN p_partkey % 4 > 1 THEN (1950 + p_partkey % 60)::VARCHAR END AS year, CASE WHEN p_partkey % 2 = 0 THEN 'https://a.example/' || p_partkey END AS url FROM part),
pu AS (SELECT *, array_to_string(list_filter([trim(publisher), trim(coalesce(year, ''))], lambda x: x <> ''), ', ') AS pub FROM src)"""


def sources(spark, sf_dir):
    k = F.col("p_partkey")
    author = F.when(k % 5 == 0, "").when(k % 5 == 1, "John Boyd").when(k % 5 == 2, "Boyd, John and Mary Ann Coe").when(k % 5 == 3, "John Boyd; Mary Coe & Ed Poe").otherwise("A One; B Two; C Three; D Four")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("title"), author.alias("author"), F.when(k % 3 > 0, F.col("p_brand")).otherwise("").alias("publisher"),
        F.when(k % 4 > 1, (1950 + k % 60).cast("string")).alias("year"), F.when(k % 2 == 0, F.concat(F.lit("https://a.example/"), k.cast("string"))).alias("url"),
    )


_DOT = "CASE WHEN regexp_matches({0}, '[.?!]$') THEN {0} ELSE {0} || '.' END"
_BIB = f"""{_SOURCES}, bb AS (SELECT id, list_transform(list_filter([CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Boyd, John' WHEN 2 THEN 'Boyd, John, and Mary Ann Coe' WHEN 3 THEN 'Boyd, John, Mary Coe, and Ed Poe' ELSE 'One, A, B Two, C Three, and D Four' END,
'*' || trim(title) || '*', pub, coalesce(url, '')], lambda x: x <> ''), lambda x: {_DOT.format('x')}) AS l FROM pu), bib AS (SELECT id, array_to_string(l, ' ') AS entry FROM bb)"""


@query(f"WITH {_BIB} SELECT id, entry FROM bib")
def bibliography(spark, sf_dir):
    return sources(spark, sf_dir).select("id", study.bibliography(*(F.col(c) for c in ("title", "author", "publisher", "year", "url"))).alias("entry"))


@query(f"WITH {_BIB} SELECT id // 50 AS shelf, string_agg(entry, chr(10) || chr(10) ORDER BY lower(entry), id) AS list FROM bib GROUP BY 1")
def bibliography_list(spark, sf_dir):
    """Entries of each shelf in order."""
    rows = sources(spark, sf_dir).select("id", study.bibliography(*(F.col(c) for c in ("title", "author", "publisher", "year", "url"))).alias("entry"))
    ordered = F.sort_array(F.collect_list(F.struct(F.lower("entry").alias("k"), "id", "entry")))
    return rows.groupBy(F.floor(F.col("id") / 50).alias("shelf")).agg(F.array_join(F.transform(ordered, lambda e: e["entry"]), "\n\n").alias("list"))


_WHO = "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'John Boyd, ' WHEN 2 THEN 'John Boyd and Mary Ann Coe, ' WHEN 3 THEN 'John Boyd, Mary Coe, and Ed Poe, ' ELSE 'A One et al., ' END"
_PAGE = "CASE WHEN id % 7 = 0 THEN ', ' || id ELSE '' END"


@query(f"""WITH {_SOURCES}, n AS (SELECT id, {_WHO} || '*' || trim(title) || '*' || CASE WHEN pub <> '' THEN ' (' || pub || ')' ELSE '' END || {_PAGE} || CASE WHEN url IS NOT NULL AND pub = '' THEN ', ' || url ELSE '' END AS s FROM pu)
SELECT id, {_DOT.format('s')} AS note FROM n""")
def footnotes(spark, sf_dir):
    page = F.when(F.col("id") % 7 == 0, F.col("id").cast("string"))
    return sources(spark, sf_dir).select("id", study.footnote(*(F.col(c) for c in ("title", "author", "publisher", "year", "url")), page).alias("note"))


@query(f"""WITH {_SOURCES}, n AS (SELECT id, CASE id % 5 WHEN 0 THEN '' WHEN 4 THEN 'One, ' ELSE 'Boyd, ' END || '*' || array_to_string(string_split_regex(regexp_extract(title, '^[^:.?]*'), '\\s+')[1:4], ' ') || '*' || {_PAGE} AS s FROM pu)
SELECT id, {_DOT.format('s')} AS note FROM n""")
def short_notes(spark, sf_dir):
    return sources(spark, sf_dir).select("id", study.short_note(F.col("title"), F.col("author"), F.when(F.col("id") % 7 == 0, F.col("id").cast("string"))).alias("note"))


@query("SELECT o_orderkey AS id, array_to_string(list_sort(list_distinct(list_filter([lower(trim(o_orderpriority)), 'a' || (o_custkey % 9), lower(trim(o_orderstatus))], lambda t: t <> ''))), ',') AS tags FROM orders")
def parse_tags(spark, sf_dir):
    text = F.concat_ws(", #", "o_orderpriority", F.concat(F.lit("A"), (F.col("o_custkey") % 9).cast("string")), F.lit(" "), "o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.array_sort(study.parse_tags(text)), ",").alias("tags"))


#: A note on each reading: two sentences from the one at its position.
_QUOTES = f"""{TO_SENTS}, nt AS (SELECT doc_id, position AS a, position + 1 AS b FROM readings),
qs AS (SELECT s.doc_id, pos, CASE WHEN lag(p) OVER w IS NULL THEN text WHEN lag(p) OVER w = p THEN ' ' || text ELSE chr(10) || chr(10) || text END AS part FROM sents s JOIN nt ON nt.doc_id = s.doc_id AND pos BETWEEN a AND b WINDOW w AS (PARTITION BY s.doc_id ORDER BY pos)),
quotes AS (SELECT doc_id AS note_id, string_agg(part, '' ORDER BY pos) AS quote FROM qs GROUP BY 1)"""


def _notes(spark, sf_dir, grow=0):
    docs = readings(spark, sf_dir)
    at = F.col("position").cast("int")
    notes = docs.select(F.col("doc_id").alias("note_id"), "doc_id", F.greatest(at - grow, F.lit(0)).alias("start"), (at + 1 + grow).alias("end"))
    return study.quotes(notes, segment.sentences(docs))


@query(f"WITH {_QUOTES} SELECT note_id, quote FROM quotes")
def note_quotes(spark, sf_dir):
    return _notes(spark, sf_dir)


@query(f"WITH {_QUOTES.replace('position AS a, position + 1 AS b', 'greatest(position - 1, 0) AS a, position + 2 AS b')} SELECT note_id, quote FROM quotes")
def note_widen(spark, sf_dir):
    """Notes grown by a sentence at either end."""
    return _notes(spark, sf_dir, 1)


@query(f"""WITH n AS (SELECT conv_id, turn, '### ' || CASE WHEN role = 'user' THEN 'Note' ELSE 'AI answer' END || ' (2024-01-01)' || chr(10) || chr(10) || CASE WHEN role = 'user' THEN '> ' || replace(text, chr(10), chr(10) || '> ') ELSE text END || chr(10) || chr(10) || '**My take:** ' || role || chr(10) || chr(10) || 'Tags: #' || role AS block FROM conversations)
SELECT conv_id AS course, '## ' || conv_id || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY turn) AS markdown FROM n GROUP BY 1""")
def notes_markdown(spark, sf_dir):
    none = F.lit(None).cast("string")
    block = study.note_block(none, F.when(F.col("role") == "user", "reading").otherwise("ai"), F.lit("2024-01-01"), F.col("text"), none, F.col("role"), F.array("role"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", block.alias("block"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "block"))), lambda b: b["block"]), "\n\n")
    return rows.groupBy(F.col("conv_id").alias("course")).agg(joined.alias("body")).select("course", F.concat(F.lit("## "), F.col("course").cast("string"), F.lit("\n\n"), "body").alias("markdown"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(strip_accents(text)), 'the') AND contains(lower(strip_accents(text)), 'on')")
def note_filter(spark, sf_dir):
    """Notes with a tag that hold every term."""
    notes = table(spark, sf_dir, "conversations").withColumn("tags", F.array("role")).withColumn("hay", T.fold(F.col("text")))
    terms = T.parse_query(F.lit("the on"))
    return notes.where(F.array_contains("tags", "user") & F.forall(terms, lambda t: F.contains("hay", t))).select("conv_id", "turn")


@query("SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1")
def notes_recent(spark, sf_dir):
    """The newest note of each course."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))


@query(f"WITH {READINGS} SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE least(100, 100.0 * word_count / (1000 * (doc_id % 3))) END, 6) AS percent FROM readings")
def draft_progress(spark, sf_dir):
    target = 1000 * (F.col("doc_id") % 3)
    share = F.when(target > 0, F.least(F.lit(100.0), 100.0 * F.col("word_count") / target)).otherwise(0.0)
    return readings(spark, sf_dir).select("doc_id", F.round(share, 6).alias("percent"))


@query(f"""WITH {READINGS}, a AS (SELECT item_id AS qid, unnest([item_id, item_id + 1, item_id + 1, 999999999]) AS doc_id FROM benchmark)
SELECT qid, string_agg(DISTINCT title, '; ' ORDER BY title) AS titles, CASE WHEN count(DISTINCT course) = 1 THEN min(course) ELSE 'General' END AS course FROM a JOIN readings USING (doc_id) GROUP BY 1""")
def answer_sources(spark, sf_dir):
    """Titles that an answer's points cite; numbers that name nothing are dropped."""
    cited = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array("item_id", F.col("item_id") + 1, F.col("item_id") + 1, F.lit(999999999))).alias("doc_id"))
    rows = readings(spark, sf_dir).select("doc_id", "title", "course").join(cited.hint("merge"), "doc_id")
    one = F.when(F.count_distinct("course") == 1, F.min("course")).otherwise("General")
    return rows.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("title")), "; ").alias("titles"), one.alias("course"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT item_id * 2 FROM benchmark) OR doc_id IN (SELECT item_id * 2 + 1 FROM benchmark)")
def paper_sources(spark, sf_dir):
    used = table(spark, sf_dir, "benchmark").select(F.explode(F.array(F.col("item_id") * 2, F.col("item_id") * 2 + 1)).alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(used.hint("merge"), "doc_id", "left_semi")


#: HTML reads the four references that pages hold with or without their semicolon, as in a title that was cut behind ``&amp``.
_BLOCKS = """a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(x, '</?(?:p|h1|br)>'), lambda z: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(z, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))), lambda z: z <> '') AS l FROM a)"""


@query(f"WITH {_BLOCKS} SELECT page_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS text FROM b")
def html_paragraphs(spark, sf_dir):
    return packages.html_paragraphs(table(spark, sf_dir, "pages")).withColumn("k", F.col("k").cast("long"))


_LINKED = "pg AS (SELECT page_id, unnest(range(4)) AS k FROM pages)"


@query(f"""WITH {_LINKED} SELECT page_id, k, CASE k WHEN 0 THEN 'file' WHEN 1 THEN 'link' ELSE 'video' END AS kind,
CASE k WHEN 0 THEN 'viewer/files/My Doc ' || page_id || '.pdf' WHEN 1 THEN 'https://b.example/p?x=' || page_id WHEN 2 THEN 'https://www.youtube.com/watch?v=v' || page_id ELSE 'https://h5p.example/' || page_id END AS target,
CASE k WHEN 0 THEN 'Doc & more' WHEN 1 THEN 'Out' WHEN 2 THEN 'Video 1 (YouTube)' ELSE 'Interactive 2' END AS label FROM pg""")
def html_links(spark, sf_dir):
    """Links of pages into which a file twice, an outer link, two frames and a help link were put."""
    n = F.col("page_id").cast("string")
    put = F.concat(
        F.lit('<a href="viewer/files/My%20Doc%20'), n, F.lit('.pdf?w=1"><b>Doc</b> &amp; more</a><a href="./viewer/files/My%20Doc%20'), n, F.lit('.pdf">again</a><a href="https://b.example/p?x='), n,
        F.lit('">Out</a><a href="https://community.canvaslms.com/x">help</a><iframe src="https://www.youtube.com/embed/v'), n, F.lit('?rel=0"></iframe><iframe src="https://h5p.example/'), n, F.lit('"></iframe>'),
    )
    # links of the page itself are relative and lead to no file
    return course.links(table(spark, sf_dir, "pages").select("page_id", F.concat(put, "html").alias("html"))).select("page_id", F.col("k").cast("long").alias("k"), "kind", "target", "label")


@query("SELECT item_id AS page_id, 'Alpha Beta Gamma' AS title, 'Read pages ' || item_id || '-' || (item_id + 5) AS instruction FROM benchmark")
def title_match(spark, sf_dir):
    n = F.col("item_id")
    text = F.format_string("Some words\nAlpha Beta Gamma (2008) Read pages %d-%d\nOther thing Read page 3", n, n + 5)
    pages = table(spark, sf_dir, "benchmark").select(n.alias("page_id"), text.alias("text"))
    titles = pages.select("page_id", F.explode(F.array(F.lit("Alpha Beta Gamma"), F.lit("Nothing like it"))).alias("title"))
    return course.match_assignments(pages, titles)


@query("SELECT p_partkey AS id, 'On ' || p_partkey || ': A Study' AS title, 'Coe' AS author, CASE WHEN p_partkey % 2 = 0 THEN (1900 + p_partkey % 100)::VARCHAR END AS year FROM part")
def file_names(spark, sf_dir):
    k = F.col("p_partkey")
    year = F.when(k % 2 == 0, F.format_string(" (%d)", 1900 + k % 100)).otherwise("")
    name = F.concat(F.lit("pdf_Coe, On "), k.cast("string"), F.lit("_A Study"), year, F.lit(" p1-7.pdf"))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), course.describe_file(name).alias("f"))
    return rows.select("id", "f.title", "f.author", "f.year")


_COURSES = "cj AS (SELECT conv_id AS id, list({'title': role, 'type': CASE WHEN turn % 2 = 0 THEN 'WikiPage' ELSE 'Assignment' END, 'content': CASE WHEN conv_id % 3 = 0 THEN ' ' ELSE text END} ORDER BY turn) AS items FROM conversations GROUP BY 1)"


def _courses(spark, sf_dir):
    kind = F.when(F.col("turn") % 2 == 0, "WikiPage").otherwise("Assignment")
    item = F.struct(F.col("role").alias("title"), kind.alias("type"), F.when(F.col("conv_id") % 3 == 0, " ").otherwise(F.col("text")).alias("content"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]).alias("items"))
    one = F.struct(F.lit("Course").alias("title"), F.array(F.struct(F.lit("Lesson 1").alias("name"), "items")).alias("modules"))
    script = F.concat(F.lit("window.COURSE_DATA = "), F.to_json(one), F.lit(";"))
    return rows.select(F.col("conv_id").alias("id"), course.parse_course(script).alias("course"))


@query(f"WITH {_COURSES}, x AS (SELECT id, unnest(items) AS i, generate_subscripts(items, 1) - 1 AS item FROM cj) SELECT id, 0 AS module, item, i.title AS title, i.type AS type, length(i.content) AS chars FROM x")
def course_items(spark, sf_dir):
    return course.course_items(_courses(spark, sf_dir), "id").select("id", F.col("module").cast("long").alias("module"), F.col("item").cast("long").alias("item"), "title", "type", F.length("content").cast("long").alias("chars"))


@query(f"WITH {_COURSES} SELECT id, 'Lesson 1' AS name FROM cj WHERE id % 3 = 0")
def empty_modules(spark, sf_dir):
    return course.empty_modules(course.course_items(_courses(spark, sf_dir), "id"), "id").select("id", "name")


@query(r"""WITH w AS (SELECT doc_id, unnest(l) AS str, generate_subscripts(l, 1) - 1 AS seq FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)), g AS (SELECT doc_id, seq // 20 AS para, seq // 5 AS line, seq, str FROM w)
SELECT doc_id AS doc, para, line, string_agg(str, '' ORDER BY seq) AS text FROM g GROUP BY ALL""")
def text_runs_to_lines(spark, sf_dir):
    """Words as runs of one page: five make a line, twenty a paragraph."""
    runs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("text", " ")).alias("seq", "str"))
    line, para = F.floor(F.col("seq") / 5), F.floor(F.col("seq") / 20)
    runs = runs.select("doc", "page", "seq", "str", (1000.0 - 10 * line - 30 * para).alias("y"), F.lit(10.0).alias("height"), (F.col("seq") % 5 == 4).alias("eol"))
    return course.text_runs_to_lines(runs).select("doc", "para", "line", "text")


@query("SELECT c_custkey AS id, 1000 + c_custkey % 900 AS target, 'a/c' || c_custkey || '/d e.html' AS path, 'File' || c_custkey || ' — x' AS title FROM customer")
def import_helpers(spark, sf_dir):
    """Word targets of prompts, resolved paths and titles with their folder."""
    k = F.col("c_custkey")
    target = F.format_string("Write 500-1,%03d words.", k % 900)
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), course.word_target(target).alias("target"), course.resolve_path(F.lit("a/b"), F.format_string("../c%d/./d%%20e.html", k)).alias("path"), course.folder_title(F.format_string("File%d", k), F.lit("x")).alias("title"))
    return rows


@query(rf"""WITH {READINGS} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Read pages ' || doc_id WHEN 1 THEN 'Read chapter 2' ELSE 'read all' END AS saved, trim(regexp_replace(CASE doc_id % 3 WHEN 0 THEN 'Read pages ' || doc_id WHEN 1 THEN 'Read chapter 2' ELSE 'read all' END, '(?i)^read\s+', '')) AS shown FROM readings""")
def assignment_text(spark, sf_dir):
    """Typed assignments as they are saved and shown."""
    typed = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, "Read chapter 2").otherwise("read all")
    saved = F.when(typed.rlike("(?i)read|page"), typed).otherwise(F.concat(F.lit("Read pages "), typed))
    return readings(spark, sf_dir).select("doc_id", saved.alias("saved"), F.regexp_replace(saved, r"(?i)^read\s+", "").alias("shown"))


# --- streams ---------------------------------------------------------------------------------------


@query(f"WITH {L.USAGE} SELECT strftime(called, '%Y-%m') AS month, round(sum(cost), 6) AS cost FROM usage GROUP BY 1")
def stream_spend(spark, sf_dir):
    """Spend by month from days that a stream keeps up to date."""
    from lectern.operators import ledger

    rules = spark.createDataFrame(L.RULES, "rule_no int, pattern string, in_price double, out_price double, cache_read double")
    calls = L.raw_usage(jobs.source(spark, f"{sf_dir}/events.parquet"))
    priced = ledger.with_cost_streaming(calls, rules)
    out = jobs.spend_by_day(priced, passing_path(spark))
    return out.read().groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.round(F.sum("cost"), 6).alias("cost"))


@query(f"""WITH {L.USAGE}, r AS (SELECT strftime(called, '%Y-%m') AS month, event_id, called, CAST(round(cost * 1e9) AS BIGINT) AS nanos FROM usage),
t AS (SELECT *, sum(nanos) OVER (PARTITION BY month ORDER BY called, event_id) AS spent FROM r), s(share, least) AS (VALUES (80, 160000000), (100, 200000000))
SELECT month, share, arg_min(event_id, (called, event_id)) AS call_id, min(spent)::BIGINT AS spent FROM t JOIN s ON spent >= least GROUP BY ALL""")
def stream_alerts(spark, sf_dir):
    """The call with which each month comes near its limit of twenty cents, and the one that reaches it, told as calls come in."""
    from lectern.operators import ledger

    rules = spark.createDataFrame(L.RULES, "rule_no int, pattern string, in_price double, out_price double, cache_read double")
    priced = ledger.with_cost_streaming(L.raw_usage(jobs.source(spark, f"{sf_dir}/events.parquet")), rules)
    calls = priced.select(F.date_format("at", "yyyy-MM").alias("month"), "at", F.col("event_id").alias("call_id"), F.round(F.col("cost") * 1e9).cast("long").alias("nanos"))
    return jobs.limit_alerts(calls, passing_path(spark), 200_000_000).read()


@query("SELECT user_id AS reading, arg_max(CAST(floor(value) AS BIGINT), (ts, event_id)) AS position, bool_or(event_type = 'purchase') AS completed FROM events GROUP BY 1")
def stream_progress(spark, sf_dir):
    events = jobs.source(spark, f"{sf_dir}/events.parquet")
    rows = events.select(F.col("user_id").alias("reading"), "ts", "event_id", F.floor("value").cast("long").alias("position"), (F.col("event_type") == "purchase").alias("completed"))
    return jobs.progress(rows, passing_path(spark)).read()


@query("SELECT event_id, substr(props, 1, 500) AS message FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def stream_errors(spark, sf_dir):
    """The newest hundred errors: a log of that size."""
    rows = jobs.source(spark, f"{sf_dir}/events.parquet").where("event_type = 'error'").select("event_id", "ts", F.substring("props", 1, 500).alias("message"))
    return jobs.newest(rows, passing_path(spark), 100, F.desc("ts"), F.desc("event_id")).read().select("event_id", "message")


@query("SELECT min(doc_id) AS doc_id, source AS course, 't' || (doc_id // 3) AS title FROM documents GROUP BY 2, 3")
def stream_import(spark, sf_dir):
    docs = jobs.source(spark, f"{sf_dir}/documents.parquet", 1_000_000)
    title = F.concat(F.lit("t"), F.floor(F.col("doc_id") / 3).cast("string"))
    rows = docs.select("doc_id", F.col("source").alias("course"), title.alias("title"), "text", F.lit(False).alias("has_pages"))
    return jobs.imports(rows, passing_path(spark)).read().select("doc_id", "course", "title")


@query(f"WITH {TO_SENTS} SELECT doc_id, count(*) AS sentences FROM sents WHERE doc_id % 10 <> 3 GROUP BY 1")
def incremental_index(spark, sf_dir):
    """An old index of half the texts, some of them other ones, brought up to date."""
    docs = readings(spark, sf_dir).select("doc_id", "text")
    build = lambda df: segment.sentences(df).select("doc_id", "pos", "text")
    old = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" Old."))).otherwise(F.col("text")).alias("text"))
    index = build(old).join(old.select("doc_id", F.xxhash64("text").alias("hash")), "doc_id")
    now = docs.where("doc_id % 10 <> 3")
    return jobs.refresh_index(index, now, build).groupBy("doc_id").agg(F.count("*").alias("sentences"))


_TERMS = f"""docs AS (SELECT doc_id, text FROM readings WHERE doc_id % 10 <> 3), toks AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM docs),
tf AS (SELECT term, doc_id, count(*) AS tf FROM toks GROUP BY ALL), asked AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS term FROM benchmark)"""


@query(f"WITH {READINGS}, {_TERMS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf SEMI JOIN asked USING (term) GROUP BY term")
def persisted_index(spark, sf_dir):
    """What an index holds of the items' terms after half the texts, changes to some, the rest, and removals."""
    docs = readings(spark, sf_dir).select("doc_id", "text")
    kept = index.PostingIndex(spark, passing_path(spark))
    kept.update(docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" Old words."))).otherwise(F.col("text")).alias("text")))
    kept.update(docs.where("doc_id % 2 = 1 or doc_id % 4 = 0"))
    kept.update(docs.limit(0), docs.where("doc_id % 10 = 3").select("doc_id"))
    asked = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return kept.lookup(asked).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

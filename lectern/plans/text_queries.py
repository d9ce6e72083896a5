"""Queries over texts, sentences, search and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import rank, search, segment
from lectern.plans.base import CLEANED, PARAS, READINGS, TO_SENTS, fold_sql, query, readings, table, tokens_sql
from lectern.shared import settle


@query(f"WITH {READINGS}, {CLEANED} SELECT doc_id, text FROM cleaned")
def clean_text(spark, sf_dir):
    return readings(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query(f"WITH {READINGS}, {CLEANED}, {PARAS} SELECT doc_id, p, text FROM paras")
def paragraphs(spark, sf_dir):
    return readings(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("p", "text"))


@query(f"WITH {TO_SENTS} SELECT doc_id, p, pos, text FROM sents")
def sentences(spark, sf_dir):
    return segment.sentences(readings(spark, sf_dir))


@query(f"WITH {TO_SENTS} SELECT doc_id, pos, lag(text) OVER w AS prev, lead(text) OVER w AS next FROM sents WINDOW w AS (PARTITION BY doc_id, p ORDER BY pos)")
def sentence_context(spark, sf_dir):
    return segment.sentence_context(segment.sentences(readings(spark, sf_dir))).select("doc_id", "pos", "prev", "next")


@query(f"WITH {READINGS} SELECT doc_id, word_count, length(text) AS chars FROM readings")
def word_counts(spark, sf_dir):
    return readings(spark, sf_dir).select("doc_id", "word_count", F.length("text").cast("long").alias("chars"))


_MINUTES = "remaining / (165 * 1.5)"
_REMAINING = "CASE WHEN completed THEN 0 ELSE greatest(0, word_count - position * 18) END::BIGINT AS remaining"


@query(f"""WITH {READINGS}, r AS (SELECT *, {_REMAINING} FROM readings)
SELECT doc_id, remaining, round({_MINUTES}, 6) AS minutes,
CASE WHEN {_MINUTES} <= 0 THEN '0m' WHEN floor({_MINUTES} / 60) > 0 THEN floor({_MINUTES} / 60)::INT || 'h ' || floor({_MINUTES} - 60 * floor({_MINUTES} / 60) + 0.5)::INT || 'm'
ELSE greatest(floor({_MINUTES} + 0.5)::INT, 1) || 'm' END AS shown FROM r""")
def listen_time(spark, sf_dir):
    left = T.remaining_words(F.col("word_count"), F.lit(None).cast("long"), F.col("position"), F.col("completed"))
    rows = readings(spark, sf_dir).select("doc_id", left.alias("remaining"))
    minutes = T.listen_minutes(F.col("remaining"), F.lit(1.5))
    return rows.select("doc_id", "remaining", F.round(minutes, 6).alias("minutes"), T.format_duration(minutes).alias("shown"))


@query(f"""WITH {READINGS}, r AS (SELECT *, {_REMAINING} FROM readings)
SELECT course, count(*) FILTER (WHERE completed) AS done, count(*) AS total, round(sum(remaining) / 165.0, 6) AS minutes_left FROM r GROUP BY 1""")
def progress_by_course(spark, sf_dir):
    left = T.remaining_words(F.col("word_count"), F.lit(None).cast("long"), F.col("position"), F.col("completed"))
    return readings(spark, sf_dir).groupBy("course").agg(
        F.count_if("completed").alias("done"), F.count("*").alias("total"), F.round(F.sum(left) / 165.0, 6).alias("minutes_left")
    )


@query(f"""WITH {READINGS}, r AS (SELECT *, {_REMAINING} FROM readings)
SELECT count(*) FILTER (WHERE completed) AS done, count(*) AS total, floor(100.0 * count(*) FILTER (WHERE completed) / greatest(count(*), 1) + 0.5)::BIGINT AS percent,
round(sum(remaining) / 165.0, 6) AS minutes_left, round(sum(remaining) / 165.0 / 30, 6) AS minutes_a_day FROM r""")
def progress_summary(spark, sf_dir):
    left = T.remaining_words(F.col("word_count"), F.lit(None).cast("long"), F.col("position"), F.col("completed"))
    done = F.count_if("completed")
    return readings(spark, sf_dir).agg(
        done.alias("done"),
        F.count("*").alias("total"),
        F.floor(100.0 * done / F.greatest(F.count("*"), F.lit(1)) + 0.5).cast("long").alias("percent"),
        F.round(F.sum(left) / 165.0, 6).alias("minutes_left"),
        F.round(F.sum(left) / 165.0 / 30, 6).alias("minutes_a_day"),
    )


@query(f"""WITH {READINGS} SELECT doc_id, min(CASE WHEN NOT completed THEN doc_id END) OVER (PARTITION BY course ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM readings""")
def next_unfinished(spark, sf_dir):
    """The next unfinished reading of the course in play order, the id order here.

    A course may be most of the library, so its readings are first cut into ranges of the order, and these into
    wider ones: each window runs inside one of them, and small tables tell where the later ones start.
    """
    cut = lambda n: F.floor(F.col("ord") / n)
    rows = readings(spark, sf_dir).select("doc_id", "course", "ord", "completed", cut(1 << 8).alias("part"), cut(1 << 16).alias("wide"))
    onward = lambda by, *keys: Window.partitionBy(*keys).orderBy(by).rowsBetween(1, Window.unboundedFollowing)
    open_id = F.when(~F.col("completed"), F.col("doc_id"))
    near = rows.withColumn("near", F.min(open_id).over(onward("ord", "course", "part")))
    firsts = rows.groupBy("course", "wide", "part").agg(F.min(open_id).alias("first"))
    later = firsts.withColumn("later", F.min("first").over(onward("part", "course", "wide"))).drop("first")
    # one row for each 65,536 readings of a course
    last = firsts.groupBy("course", "wide").agg(F.min("first").alias("first")).withColumn("last", F.min("first").over(onward("wide", "course"))).drop("first")
    told = near.join(later.hint("merge"), ["course", "wide", "part"]).join(last.hint("merge"), ["course", "wide"])
    return told.select("doc_id", F.coalesce("near", "later", "last").alias("next_id"))


@query(f"WITH {READINGS}, t AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM readings) SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2")
def fold_tokens(spark, sf_dir):
    return readings(spark, sf_dir).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT word, """ + __import__("lectern.plans.base", fromlist=["stem_sql"]).stem_sql("word") + " AS stem FROM w")
def stem_terms(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) SELECT lower(w) AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1")
def vocabulary(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    per_doc = words.groupBy(F.lower("w").alias("word"), "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


#: Questions from the benchmark's items: their first words, and as a phrase their first three.
QUESTIONS = """questions AS (SELECT item_id AS qid, array_to_string(w[1:12], ' ') AS question, '"' || array_to_string(w[1:3], ' ') || '"' AS q
  FROM (SELECT item_id, string_split_regex(trim(text), '\\s+') AS w FROM benchmark))"""


def questions(spark, sf_dir):
    words = F.split(T.trim(F.col("text")), r"\s+")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.array_join(F.slice(words, 1, 12), " ").alias("question"),
        F.concat(F.lit('"'), F.array_join(F.slice(words, 1, 3), " "), F.lit('"')).alias("q"),
        F.array().cast("array<string>").alias("extra_terms"),
    )


_PHRASE = fold_sql("trim(q, '\"')")
HITS = f"""{TO_SENTS}, {QUESTIONS}, asked AS (SELECT qid, trim({_PHRASE}) AS term FROM questions),
direct AS (SELECT qid, doc_id, pos FROM sents, asked WHERE contains({fold_sql('sents.text')}, term)),
hits AS (SELECT * FROM direct UNION ALL SELECT qid, doc_id, 0 FROM readings, asked WHERE contains({fold_sql('title')}, term) AND NOT EXISTS (SELECT 1 FROM direct x WHERE x.qid = asked.qid AND x.doc_id = readings.doc_id))"""


def _hits(spark, sf_dir):
    docs = readings(spark, sf_dir)
    return search.search_hits(segment.sentences(docs).select("doc_id", "pos", "text"), docs.select("doc_id", "title", "course"), questions(spark, sf_dir).select("qid", "q"))


@query(f"WITH {HITS} SELECT qid, doc_id, pos FROM hits")
def search_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(f"WITH {HITS}, g AS (SELECT qid, doc_id, count(*) AS hits FROM hits GROUP BY 1, 2) SELECT qid, doc_id, hits, (sum(hits) OVER (PARTITION BY qid))::BIGINT AS total FROM g")
def search_groups(spark, sf_dir):
    return search.search_groups(_hits(spark, sf_dir))


@query(f"""WITH {HITS}, g AS (SELECT *, count(*) OVER (PARTITION BY qid, doc_id) AS hits, count(*) OVER (PARTITION BY qid) AS total FROM hits)
SELECT qid, doc_id, pos, total, total > 500 AS truncated FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY hits DESC, doc_id, pos) <= 500""")
def search_capped(spark, sf_dir):
    return search.capped(_hits(spark, sf_dir))


@query(f"""WITH {HITS}, h AS (SELECT qid, doc_id, pos, {fold_sql('s.text')} AS f, term FROM direct JOIN sents s USING (doc_id, pos) JOIN asked USING (qid) WHERE length({fold_sql('s.text')}) = length(s.text)),
x AS (SELECT qid, doc_id, pos, length(term) AS n, list_transform(string_split(f, term), lambda z: length(z)) AS l FROM h),
y AS (SELECT qid, doc_id, pos, n, l, unnest(range(1, len(l))) AS k FROM x)
SELECT qid, doc_id, pos, (list_sum(l[1:k]) + (k - 1) * n)::BIGINT AS a, (list_sum(l[1:k]) + k * n)::BIGINT AS b FROM y""")
def highlight(spark, sf_dir):
    """All marked ranges of every hit; a quoted phrase's own occurrences never touch."""
    docs = readings(spark, sf_dir)
    # the sentences that are searched and those that are marked are cut once
    sents = settle(segment.sentences(docs).select("doc_id", "pos", "text"))
    asked = questions(spark, sf_dir).select("qid", "q")
    terms = search.sized(settle(asked.select("qid", T.parse_query(F.col("q")).alias("terms"))))
    found = settle(search.search_hits(sents, docs.select("doc_id", "title", "course"), asked))
    hits = sents.join(search.sized(found), ["doc_id", "pos"]).join(terms, "qid")
    ranges = hits.select("qid", "doc_id", "pos", F.explode(T.highlight_ranges(F.col("text"), F.col("terms"))).alias("r"))
    return ranges.select("qid", "doc_id", "pos", F.col("r.a").cast("long").alias("a"), F.col("r.b").cast("long").alias("b"))


#: Windows by recursion over the prefix sums of sentence words.
PASSAGES = f"""{TO_SENTS}, wc AS (SELECT doc_id, pos, len(string_split_regex(text, '\\s+')) AS n FROM sents),
b AS (SELECT doc_id, pos, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS before, max(pos) OVER (PARTITION BY doc_id) AS last FROM wc),
e AS (SELECT doc_id, pos, last, max(pos) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 109 FOLLOWING) AS till FROM b),
chase AS (SELECT doc_id, pos AS start, till AS "end", last FROM e WHERE pos = 0 UNION ALL
  SELECT e.doc_id, e.pos, e.till, e.last FROM chase c JOIN e ON e.doc_id = c.doc_id AND e.pos = greatest(c.start + 1, (c.start + c."end" + 1) // 2) WHERE c."end" < c.last),
passages AS (SELECT doc_id, start, "end" FROM chase)"""


@query(f'WITH RECURSIVE {PASSAGES} SELECT doc_id, start, "end" FROM passages')
def passages(spark, sf_dir):
    return segment.passages(readings(spark, sf_dir))


SCORES = f"""{PASSAGES}, {QUESTIONS}, ptext AS (SELECT p.doc_id, p.start, p."end", string_agg(s.text, ' ' ORDER BY s.pos) AS text FROM passages p JOIN sents s ON s.doc_id = p.doc_id AND s.pos BETWEEN p.start AND p."end" GROUP BY ALL),
ptok AS (SELECT doc_id, start, "end", {tokens_sql('text')} AS toks FROM ptext),
pool AS (SELECT count(*) AS N, avg(len(toks)) AS avg_len FROM ptok),
terms AS (SELECT DISTINCT qid, unnest({tokens_sql('question')}) AS term FROM questions),
tf AS (SELECT doc_id, start, "end", l, term, count(*) AS tf FROM (SELECT doc_id, start, "end", len(toks) AS l, unnest(toks) AS term FROM ptok) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scores AS (SELECT qid, doc_id, start, "end", round(sum(ln(1 + (N - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len)))) * (1 + count(*) / any_value(n_terms)), 6) AS score
  FROM tf JOIN df USING (term) JOIN terms USING (term) JOIN (SELECT qid, count(*) AS n_terms FROM terms GROUP BY 1) USING (qid), pool GROUP BY qid, doc_id, start, "end")"""


def _pool(spark, sf_dir, scope=None):
    return rank.passage_terms(readings(spark, sf_dir), scope_col=scope)


@query(f'WITH RECURSIVE {SCORES} SELECT qid, doc_id, start, "end", score FROM scores WHERE score > 0')
def bm25_scores(spark, sf_dir):
    return rank.scores(_pool(spark, sf_dir), questions(spark, sf_dir))


def _picks(scores: str) -> str:
    """Up to four passages of a document, each the best that overlaps none before it, then the best twelve of a question."""
    rows = f'(SELECT * FROM {scores} WHERE score > 0)'
    best = 'QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, start, "end") = 1'
    out = [f"k1 AS (SELECT * FROM {rows} {best})"]
    for k in (2, 3, 4):
        before = " UNION ALL ".join(f"SELECT * FROM k{j}" for j in range(1, k))
        out.append(f'k{k} AS (SELECT s.* FROM {rows} s WHERE NOT EXISTS (SELECT 1 FROM ({before}) k WHERE k.qid = s.qid AND k.doc_id = s.doc_id AND s.start <= k."end" AND k.start <= s."end") {best})')
    every = " UNION ALL ".join(f"SELECT * FROM k{j}" for j in (1, 2, 3, 4))
    out.append(f"top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, start) AS n FROM ({every}) QUALIFY n <= 12)")
    return ", ".join(out)


TOP = f"{SCORES}, {_picks('scores')}"


@query(f'WITH RECURSIVE {TOP} SELECT qid, n, doc_id, start, "end", score FROM top')
def bm25_topk(spark, sf_dir):
    return rank.ranked(_pool(spark, sf_dir), questions(spark, sf_dir))


@query(f"""WITH RECURSIVE {TOP}, ins AS (SELECT t.qid, t.n, s.pos, list_distinct({tokens_sql('s.text')}) AS toks FROM top t JOIN sents s ON s.doc_id = t.doc_id AND s.pos BETWEEN t.start AND t."end"),
w AS (SELECT qid, n, pos, (SELECT count(*) FROM terms x WHERE x.qid = ins.qid AND list_contains(ins.toks, x.term)) AS w FROM ins)
SELECT qid, n, arg_min(pos, (-w, pos)) AS focus FROM w GROUP BY 1, 2""")
def focus_sentence(spark, sf_dir):
    top = settle(rank.ranked(_pool(spark, sf_dir), questions(spark, sf_dir)))
    picked = readings(spark, sf_dir).join(search.sized(settle(top.select("doc_id").distinct())), "doc_id", "left_semi")
    return rank.focus_sentences(top, segment.sentence_arrays(picked), questions(spark, sf_dir))


@query(f"""WITH RECURSIVE {TOP}, blocks AS (SELECT t.qid, t.n, '<passage n="' || t.n || '" title="' || replace(r.title, chr(34), chr(39)) || '" course="' || replace(coalesce(r.course, ''), chr(34), chr(39)) || '">' || chr(10) || p.text || chr(10) || '</passage>' AS block
  FROM top t JOIN ptext p ON p.doc_id = t.doc_id AND p.start = t.start AND p."end" = t."end" JOIN readings r ON r.doc_id = t.doc_id)
SELECT qid, string_agg(block, chr(10) ORDER BY n) AS pack, count(*) AS passages FROM blocks GROUP BY 1""")
def prompt_pack(spark, sf_dir):
    """The passages of each question wrapped in tags, in rank order."""
    pool = _pool(spark, sf_dir)
    top = settle(rank.ranked(pool, questions(spark, sf_dir)))
    titles = readings(spark, sf_dir).select("doc_id", "title", "course")
    parts = settle(pool.select("doc_id", "start", "end", "text").join(search.sized(top), ["doc_id", "start", "end"]).select("qid", "n", "doc_id", "text"))
    quoted = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit("'"))
    block = F.format_string('<passage n="%d" title="%s" course="%s">\n%s\n</passage>', "n", quoted("title"), quoted("course"), "text")
    blocks = titles.join(search.sized(parts), "doc_id").select("qid", "n", block.alias("block"))
    return blocks.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda b: b["block"]), "\n").alias("pack"), F.count("*").alias("passages"))


#: Every other question asks in one course; its statistics are of that course alone.
SCOPED = f"""{PASSAGES}, {QUESTIONS}, ptext AS (SELECT p.doc_id, p.start, p."end", string_agg(s.text, ' ' ORDER BY s.pos) AS text FROM passages p JOIN sents s ON s.doc_id = p.doc_id AND s.pos BETWEEN p.start AND p."end" GROUP BY ALL),
ptok AS (SELECT p.doc_id, p.start, p."end", r.course, {tokens_sql('p.text')} AS toks FROM ptext p JOIN readings r USING (doc_id)),
sq AS (SELECT qid, question, CASE WHEN qid % 2 = 0 THEN 'src' || (qid % 5) END AS within FROM questions),
terms AS (SELECT DISTINCT qid, within, unnest({tokens_sql('question')}) AS term FROM sq),
pool AS (SELECT within, count(*) AS N, avg(len(toks)) AS avg_len FROM (SELECT DISTINCT within FROM sq) x JOIN ptok ON within IS NULL OR within = course GROUP BY 1),
tf AS (SELECT doc_id, start, "end", course, l, term, count(*) AS tf FROM (SELECT doc_id, start, "end", course, len(toks) AS l, unnest(toks) AS term FROM ptok) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT within, term, count(*) AS df FROM (SELECT DISTINCT within FROM sq) x JOIN tf ON within IS NULL OR within = course GROUP BY 1, 2),
scoped AS (SELECT t.qid, doc_id, start, "end", round(sum(ln(1 + (N - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len)))) * (1 + count(*) / any_value(n_terms)), 6) AS score
  FROM tf JOIN terms t ON t.term = tf.term AND (t.within IS NULL OR t.within = tf.course) JOIN df ON df.term = t.term AND df.within IS NOT DISTINCT FROM t.within
  JOIN pool ON pool.within IS NOT DISTINCT FROM t.within JOIN (SELECT qid, count(*) AS n_terms FROM terms GROUP BY 1) n ON n.qid = t.qid GROUP BY t.qid, doc_id, start, "end"), {_picks('scoped')}"""


def _scoped_questions(spark, sf_dir):
    course = F.when(F.col("qid") % 2 == 0, F.concat(F.lit("src"), (F.col("qid") % 5).cast("string")))
    return questions(spark, sf_dir).withColumn("course", course)


@query(f'WITH RECURSIVE {SCOPED} SELECT qid, n, doc_id, start, "end", score FROM top')
def bm25_scoped(spark, sf_dir):
    """Questions in one course or in all, ranked with the statistics of their scope."""
    return rank.ranked(_pool(spark, sf_dir, "course"), _scoped_questions(spark, sf_dir))


@query(f"""WITH RECURSIVE {SCOPED}, f AS (SELECT qid, count(*) AS passages, count(DISTINCT doc_id) AS readings FROM top GROUP BY 1),
s AS (SELECT within, count(DISTINCT doc_id) AS searched FROM (SELECT DISTINCT within FROM sq) x JOIN ptok ON within IS NULL OR within = course GROUP BY 1)
SELECT sq.qid, coalesce(passages, 0) AS passages, coalesce(readings, 0) AS readings, coalesce(searched, 0) AS searched, CASE WHEN passages IS NULL THEN 'not_found' END AS answer
FROM sq LEFT JOIN f USING (qid) LEFT JOIN s ON s.within IS NOT DISTINCT FROM sq.within""")
def retrieval_coverage(spark, sf_dir):
    """How much each question found, of how many readings; a question without passages is answered at once."""
    pool, asked = _pool(spark, sf_dir, "course"), _scoped_questions(spark, sf_dir)
    return rank.coverage(rank.ranked(pool, asked), pool, asked)


@query(rf"""WITH {TO_SENTS}, x AS (SELECT doc_id, pos, rtrim(text, '.') || ' (Smith & Lee, 2004, p. 12) [3-5, 9] (pp. 4-6).' || (CASE WHEN pos % 2 = 0 THEN ' See https://a.example/x' ELSE '' END) AS text FROM sents),
a AS (SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s?(?:https?://|www\.)\S+', '', 'g'), '\s?\(Smith & Lee, 2004, p\. 12\)', '', 'g'), '\s?\[(?:[0-9]{{1,3}}(?:\s*[-–,]\s*[0-9]{{1,3}})*)\]', '', 'g'), '(?i)\s?\((?:pp?\.|page|pages)\s*[0-9\-–, ]+\)', '', 'g') AS out, text FROM x),
b AS (SELECT doc_id, pos, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(out, '([a-z)\]][.,;:!?]?["”’]?)[0-9]{{1,3}}(\s|$|[,.;:])', '\1\2', 'g'), '\s+([.,;:!?])', '\1', 'g'), '\(\s*\)', '', 'g'), '\s{{2,}}', ' ', 'g')) AS out FROM a)
SELECT doc_id, pos, CASE WHEN regexp_matches(out, '[A-Za-z]{{2}}') THEN out ELSE text END AS speak FROM b""")
def speakable(spark, sf_dir):
    """Sentences with citations and links put in, as they are spoken."""
    sents = segment.sentences(readings(spark, sf_dir))
    link = F.when(F.col("pos") % 2 == 0, " See https://a.example/x").otherwise("")
    text = F.concat(F.regexp_replace("text", r"\.+$", ""), F.lit(" (Smith & Lee, 2004, p. 12) [3-5, 9] (pp. 4-6)."), link)
    return sents.select("doc_id", F.col("pos"), T.speakable(text).alias("speak"))

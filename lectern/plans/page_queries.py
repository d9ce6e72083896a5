"""Queries over page lines, page numbers, paragraph kinds and repaired words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import classify, pages, repair, segment
from lectern.plans.base import CLEANED, PARAS, READINGS, SENTS, TO_SENTS, query, readings, spread, table

#: Documents as pages of books, each with a running header put on top.
_NORM = "trim(regexp_replace(regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g'))"
_LINES = f"""pg AS (SELECT doc_id % 17 AS doc, doc_id AS page, list_prepend('Course Book ' || doc_id, string_split(text, chr(10))) AS l FROM documents),
ln AS (SELECT doc, page, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line FROM pg),
ed AS (SELECT *, trim(text) <> '' AND (row_number() OVER (PARTITION BY doc, page, trim(text) <> '' ORDER BY line) <= 4 OR row_number() OVER (PARTITION BY doc, page, trim(text) <> '' ORDER BY line DESC) <= 4) AS edge FROM ln),
ky AS (SELECT *, {_NORM} AS key FROM ed),
run AS (SELECT doc, key, count(DISTINCT page) AS pages FROM ky WHERE edge AND key <> '' GROUP BY 1, 2
  HAVING count(DISTINCT page) >= greatest(3, ceil(0.3 * (SELECT count(DISTINCT page) FROM pg WHERE pg.doc = ky.doc))))"""


def _pages(spark, sf_dir):
    head = F.array(F.concat(F.lit("Course Book "), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 17).alias("doc"), F.col("doc_id").alias("page"), F.concat(head, F.split("text", "\n")).alias("lines"))


@query(f"WITH {_LINES} SELECT doc, key, pages FROM run")
def running_lines(spark, sf_dir):
    return pages.running_lines(_pages(spark, sf_dir))


@query(rf"""WITH {_LINES} SELECT doc, page, line, text FROM ky LEFT JOIN (SELECT doc, key, true AS runs FROM run) USING (doc, key)
WHERE NOT coalesce(edge AND (regexp_matches(trim(text), '(?i)^(page\s*)?[0-9ivxlc]{{1,6}}(\s*(of|/)\s*[0-9]+)?$') OR regexp_matches(trim(text), '(?i)^this content downloaded from')
  OR (length(trim(text)) < 200 AND coalesce(runs, false))), false)""")
def strip_running_lines(spark, sf_dir):
    return pages.strip_running_lines(_pages(spark, sf_dir))


#: Order lines as detected page numbers of one document for each supplier.
_DETECTED = """det0 AS (SELECT l_suppkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS page, l_partkey, l_linenumber FROM lineitem),
det AS (SELECT doc, page, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN l_linenumber ELSE page + 100 END AS detected FROM det0)"""
_NUMBERS = f"""{_DETECTED}, o AS (SELECT doc, page, detected - page AS off FROM det),
tr AS (SELECT doc, page, CASE WHEN off IS NOT NULL AND count(*) OVER (PARTITION BY doc, off) >= 2 THEN off END AS off FROM o),
nb AS (SELECT *, last_value(CASE WHEN off IS NOT NULL THEN page END IGNORE NULLS) OVER b AS bp, last_value(off IGNORE NULLS) OVER b AS bo,
  first_value(CASE WHEN off IS NOT NULL THEN page END IGNORE NULLS) OVER f AS ap, first_value(off IGNORE NULLS) OVER f AS ao FROM tr
  WINDOW b AS (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY doc ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
num AS (SELECT doc, page, page + CASE WHEN ap IS NULL OR page - bp <= ap - page THEN bo ELSE ao END AS n, off IS NOT NULL AS sure FROM nb)"""


def _numbers(spark, sf_dir):
    by = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.row_number().over(by) - 1).alias("page"), "l_partkey", "l_linenumber")
    detected = F.when(F.col("l_partkey") % 5 == 0, None).when(F.col("l_partkey") % 7 == 0, F.col("l_linenumber")).otherwise(F.col("page") + 100)
    return pages.infer_page_numbers(rows.select("doc", "page", detected.alias("detected")))


@query(f"WITH {_NUMBERS} SELECT doc, page, n, sure FROM num")
def page_numbers(spark, sf_dir):
    return _numbers(spark, sf_dir)


_RANGES = "rg AS (SELECT s_suppkey AS doc, 'Read pages ' || (100 + s_suppkey % 9) || '-' || (110 + s_suppkey % 9) || ' and ' || (130 + s_suppkey % 50) || ' (skim it)' AS t, 100 + s_suppkey % 9 AS a1, 110 + s_suppkey % 9 AS b1, 130 + s_suppkey % 50 AS a2 FROM supplier)"


def _ranges(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat(F.lit("Read pages "), (100 + k % 9).cast("string"), F.lit("-"), (110 + k % 9).cast("string"), F.lit(" and "), (130 + k % 50).cast("string"), F.lit(" (skim it)"))
    return table(spark, sf_dir, "supplier").select(k.alias("doc"), pages.parse_assigned_pages(text).alias("ranges"))


@query(f"WITH {_RANGES}, u AS (SELECT doc, a1 AS a, b1 AS b FROM rg UNION ALL SELECT doc, a2, a2 FROM rg) SELECT doc, a, b FROM u")
def assigned_pages(spark, sf_dir):
    return _ranges(spark, sf_dir).select("doc", F.explode("ranges").alias("r")).select("doc", F.col("r.a").cast("long").alias("a"), F.col("r.b").cast("long").alias("b"))


_SKIP = f"""{_NUMBERS}, {_RANGES}, ins AS (SELECT num.*, coalesce((n BETWEEN a1 AND b1) OR n = a2, false) AS inside FROM num JOIN rg USING (doc)),
bes AS (SELECT *, coalesce(lag(inside) OVER w, false) OR coalesce(lead(inside) OVER w, false) AS beside, bool_or(sure AND inside) OVER (PARTITION BY doc) AS lands FROM ins WINDOW w AS (PARTITION BY doc ORDER BY page)),
sk AS (SELECT doc, page, NOT inside AND n IS NOT NULL AND NOT (NOT sure AND beside) AS skip FROM bes WHERE lands)"""


@query(f"WITH {_SKIP} SELECT doc, page, skip FROM sk")
def unassigned_pages(spark, sf_dir):
    return pages.unassigned_pages(_numbers(spark, sf_dir), _ranges(spark, sf_dir))


@query(f"WITH {_SKIP} SELECT doc, 'partial' AS kind, count(*) FILTER (WHERE NOT skip) AS pages_read, count(*) AS pages_total FROM sk GROUP BY 1")
def assignment_totals(spark, sf_dir):
    skips = pages.unassigned_pages(_numbers(spark, sf_dir), _ranges(spark, sf_dir))
    return skips.groupBy("doc").agg(F.when(F.bool_or("skip"), "partial").otherwise("whole").alias("kind"), F.count_if(~F.col("skip")).alias("pages_read"), F.count("*").alias("pages_total"))


#: Page k of a reading starts at its paragraph 3k; paragraphs that no page skips are read.
@query(f"""WITH {READINGS}, {CLEANED}, p AS (SELECT doc_id AS doc, unnest(range(len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda z: trim(z) <> '')))) AS p FROM cleaned)
SELECT doc, p, p // 3 AS page FROM p""")
def paragraph_pages(spark, sf_dir):
    paras = readings(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.posexplode(T.paragraphs(F.col("text"))).alias("p", "t")).select("doc", "p")
    starts = paras.where("p % 3 = 0").select("doc", F.col("p").alias("start"), F.floor(F.col("p") / 3).cast("int").alias("page"))
    return pages.paragraph_pages(paras, starts)


def with_references(spark, sf_dir):
    """Readings of which every third ends in a list of references."""
    entries = "\n\n".join(f"Author{c}, A. B. (20{k:02d}). A title of note. University Press." for k, c in enumerate("xyzvw", 10))
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit("\n\nReferences\n\n" + entries)).otherwise("")
    return readings(spark, sf_dir).withColumn("text", F.concat("text", tail))


#: The same rules over whole sets: flags of paragraphs, the stop of each heading, and how far sections reach.
_ENTRIES = "chr(10) || chr(10) || 'References'" + "".join(f" || chr(10) || chr(10) || 'Author{c}, A. B. (20{k:02d}). A title of note. University Press.'" for k, c in enumerate("xyzvw", 10))
_REFERRED = f"referred AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN text || {_ENTRIES} ELSE text END AS text) FROM readings)"
KINDS = rf"""{READINGS}, {_REFERRED}, {CLEANED.replace("FROM readings", "FROM referred")},
raws AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS p FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda z: regexp_replace(z, '^\s+|\s+$', '', 'g')), lambda z: z <> '') AS l FROM cleaned)),
shaped AS (SELECT doc_id, p, raw, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t, list_filter(list_transform(string_split(raw, chr(10)), lambda z: trim(z)), lambda z: z <> '') AS lines, regexp_replace(raw, '\s+', '', 'g') AS bare FROM raws),
medians AS (SELECT doc_id, list_sort(flatten(list(list_transform(lines, lambda z: length(z))))) AS l FROM shaped GROUP BY doc_id),
flags AS (SELECT doc_id, p, t, length(t) AS len,
  regexp_matches(t, '\b(?:(?:1[6-9]\d\d|20\d\d)[a-z]?|n\.\s?d\.)\b') OR regexp_matches(t, '\b(?:Press|Publish\w*|Journal|Quarterly|Review|University|Vol\.|vol\.|no\.|pp\.|Retrieved|doi|Ibid|op\. cit|Eds?\.)') OR regexp_matches(t, 'https?:|www\.') AS cite,
  regexp_matches(t, '(?i)^\d{{1,3}}\.\s+Ibid\b') OR (length(t) BETWEEN 15 AND 900 AND (regexp_matches(t, '^\[?\d{{1,3}}[.)\]]\s+\S') OR regexp_matches(t, '^[A-Z][A-Za-z''’\-]+,\s(?:[A-Z]\.\s?){{1,3}}') OR (regexp_matches(t, '^[A-Z][A-Za-z''’\-]+,\s[A-Z][a-z]+') AND regexp_matches(t, '\.\s')))
    AND (regexp_matches(t, '\b(?:(?:1[6-9]\d\d|20\d\d)[a-z]?|n\.\s?d\.)\b') OR regexp_matches(t, '\b(Press|Publish|Journal|Review|University|Vol\.|vol\.|no\.|pp\.|Retrieved|doi|https?:|ed\.|eds\.|Ibid|Ibid\.|op\. cit)\b'))) AS entry,
  len(list_filter(string_split(raw, chr(10))[1:2], lambda z: regexp_matches(trim(z), '(?i)^(?:\d+\.?\s*)?(references?|reference list|notes|endnotes|end notes|bibliography|works cited|sources|literature cited|selected bibliography|suggested readings?)\s*:?$'))) > 0 AS head,
  (len(lines) >= 5 AND list_sum(list_transform(lines, lambda z: length(z))) / len(lines) < coalesce(m.l[len(m.l) // 2 + 1], 80) * 0.5 AND len(list_filter(lines, lambda z: regexp_matches(z, '[.!?:]["”’)]?$'))) / len(lines) < 0.25
    AND len(regexp_extract_all(raw, '[a-z0-9)\]"”’][.!?]["”’)]?(?:\s|$)')) / greatest(len(regexp_split_to_array(raw, '\s+')) / 18, 1) < 0.35)
  OR (length(bare) BETWEEN 1 AND 60 AND (len(regexp_extract_all(bare, '[A-Za-z0-9]')) / length(bare) < 0.5 OR len(regexp_extract_all(bare, '[~^|\\{{}}<>_=;]')) >= 3)) AS tabular
  FROM shaped JOIN medians m USING (doc_id)),
placed AS (SELECT *, len >= 200 AND NOT cite AS prose, max(p) OVER d AS final, sum(cite::INTEGER) OVER w AS cites, sum(cite::INTEGER) OVER d AS cites_all,
  (sum(len) OVER w - len) / greatest(sum(len) OVER d, 1) >= 0.3 AS past FROM flags WINDOW d AS (PARTITION BY doc_id), w AS (PARTITION BY doc_id ORDER BY p)),
stops AS (SELECT *, CASE WHEN prose AND lag(prose) OVER w THEN p END AS stop, lag(cites, 2) OVER w AS cites2, lead(t) OVER w AS next FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
sections AS (SELECT h.doc_id, h.p AS a, CASE WHEN h.p = h.final THEN h.p ELSE coalesce(s.p - 2, h.final - e.prose::INTEGER) END AS b, h.p = h.final OR coalesce(s.cites2, h.cites_all) - h.cites + h.cite::INTEGER >= 2 AS good
  FROM stops h JOIN stops e ON e.doc_id = h.doc_id AND e.p = h.final LEFT JOIN stops s ON s.doc_id = h.doc_id AND s.p = (SELECT min(x.stop) FROM stops x WHERE x.doc_id = h.doc_id AND x.stop >= h.p + 2) WHERE h.head AND h.past),
tails AS (SELECT doc_id, coalesce(max(p) FILTER (WHERE prose OR NOT (cite OR len < 60)), -1) + 1 AS start FROM placed GROUP BY doc_id),
ends AS (SELECT doc_id, any_value(start) AS start, count(*) FILTER (WHERE cite) >= ceil(count(*) * 0.6) AND (sum(len(regexp_extract_all(chr(10) || t || chr(10) || coalesce(next, '')[1:1], '\s\d{{1,3}}\.\s+[A-Z“"]'))) >= 3 OR count(*) FILTER (WHERE entry) >= 3) AS ends
  FROM stops JOIN tails USING (doc_id) WHERE p >= start GROUP BY doc_id),
kinds AS (SELECT f.doc_id, f.p, CASE WHEN EXISTS (SELECT 1 FROM sections s WHERE s.doc_id = f.doc_id AND s.good AND f.p BETWEEN s.a AND s.b) THEN 'references' WHEN tabular THEN 'table' WHEN ends AND f.p >= start THEN 'references' END AS kind FROM flags f LEFT JOIN ends USING (doc_id))"""
#: What is spoken of the given texts, which hold none of the marks that are left out but numbers behind words.
_AUTHORS = r"\s?\((?:(?:see|e\.g\.,?|cf\.|for example,?)\s+)?[A-Z][^()]{0,160}?\b(?:(?:1[6-9]\d\d|20\d\d)[a-z]?|n\.\s?d\.)(?:,?\s*(?:pp?\.\s*)?[0-9\-–, ]+)?(?:;\s*[^()]{0,160}?\b(?:(?:1[6-9]\d\d|20\d\d)[a-z]?|n\.\s?d\.)(?:,?\s*(?:pp?\.\s*)?[0-9\-–, ]+)?)*\)"
SPOKEN = rf"""{KINDS}, {PARAS}, {SENTS}, planned AS (SELECT s.doc_id, s.pos, s.p, s.text, k.kind AS skip FROM sents s LEFT JOIN kinds k ON k.doc_id = s.doc_id AND k.p = s.p),
bare AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\s?(?:https?://|www\.)\S+|\s?\bdoi:\s?\S+', '', 'g'), '{_AUTHORS}', '', 'g'), '\s?\[(?:\d{{1,3}}(?:\s*[-–,]\s*\d{{1,3}})*)\]', '', 'g'), '(?i)\s?\((?:pp?\.|page|pages)\s*[\d\-–, ]+\)', '', 'g') AS o FROM planned),
tidy AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(o, '([a-z)\]][.,;:!?]?["”’]?)\d{{1,3}}(\s|$|[,.;:])', '\1\2', 'g'), '\s+([.,;:!?])', '\1', 'g'), '\(\s*\)', '', 'g'), '\s{{2,}}', ' ', 'g')) AS o2 FROM bare),
spoken AS (SELECT doc_id, pos, p, CASE WHEN skip IS NULL AND regexp_matches(o2, '[A-Za-z]{{2}}') THEN o2 ELSE text END AS speak, skip FROM tidy)"""


@query(f"WITH {KINDS} SELECT doc_id, p, kind FROM kinds")
def paragraph_kinds(spark, sf_dir):
    return classify.paragraph_kinds(with_references(spark, sf_dir))


@query(f"WITH {KINDS} SELECT doc_id, p, kind FROM kinds")
def paragraph_kinds_rows(spark, sf_dir):
    """The same of paragraphs that come as rows, as those of a book do that no row holds."""
    paras = with_references(spark, sf_dir).select("doc_id", F.posexplode_outer(T.raw_paragraphs(F.col("text"))).alias("p", "raw")).where("p is not null")
    return classify.kinds_of_rows(paras)


@query(f"WITH {SPOKEN} SELECT doc_id, pos, p, speak, skip FROM spoken")
def narration_plan(spark, sf_dir):
    docs = with_references(spark, sf_dir)
    return classify.narration_plan(docs)


@query(f"WITH {KINDS}, b AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM kinds) SELECT doc_id, p, kind FROM b WHERE kind IS NOT NULL AND kind IS DISTINCT FROM before")
def skip_runs(spark, sf_dir):
    """Paragraphs that begin a run of passed-over ones, with the kind of the run."""
    kinds = classify.paragraph_kinds(with_references(spark, sf_dir))
    before = F.lag("kind").over(Window.partitionBy("doc_id").orderBy("p"))
    return kinds.withColumn("before", before).where(F.col("kind").isNotNull() & ~F.col("kind").eqNullSafe(F.col("before"))).select("doc_id", "p", "kind")


@query(rf"WITH {SPOKEN} SELECT doc_id, sum(CASE WHEN skip IS NULL THEN len(regexp_extract_all(speak, '\S+')) ELSE 0 END)::BIGINT AS listen_words FROM spoken GROUP BY doc_id")
def spoken_words(spark, sf_dir):
    """Words that narration speaks."""
    docs = with_references(spark, sf_dir)
    plan = classify.narration_plan(docs)
    return plan.groupBy("doc_id").agg(F.sum(F.when(F.col("skip").isNull(), T.word_count(F.col("speak"))).otherwise(0)).alias("listen_words"))


@query(r"""WITH p AS (SELECT doc_id, p - 1 AS p, unnest(l) AS t0, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, 1 AS p, string_split(text, chr(10)) AS l FROM documents)),
q AS (SELECT doc_id, i - 1 AS p, regexp_replace(t0, '\s+', '', 'g') AS t FROM p)
SELECT doc_id, p, length(t) BETWEEN 1 AND 60 AND (len(regexp_extract_all(t, '[A-Za-z0-9]')) / length(t) < 0.5 OR len(regexp_extract_all(t, '[~^|\\{}<>_=;]')) >= 3) AS noise FROM q""")
def symbol_noise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).select("doc_id", "p", classify.is_symbol_noise(F.col("t")).alias("noise"))


def damaged(spark, sf_dir):
    """Documents of which every fourth lost the h of its ``th``."""
    text = F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("text", "th", "t")).otherwise(F.col("text"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.alias("text"))


_REPAIRED = """damaged AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN regexp_replace(text, 'th', 't', 'g') ELSE text END AS text FROM documents),
parts AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') AS l FROM damaged)),
exact AS (SELECT doc_id, w, count(*) AS here FROM parts WHERE regexp_matches(w, '[A-Za-z]') GROUP BY ALL),
own AS (SELECT doc_id, lower(w) AS word, sum(here)::BIGINT AS own FROM exact GROUP BY ALL), every AS (SELECT word, sum(own)::BIGINT AS n FROM own GROUP BY 1),
lost(letter, k, x) AS (VALUES ('f', 0, 'i'), ('f', 1, 'l'), ('f', 2, 'f'), ('f', 3, 't'), ('f', 4, 'fi'), ('f', 5, 'fl'), ('F', 0, 'i'), ('F', 1, 'l'), ('T', 0, 'h'), ('t', 0, 'h')),
tried AS (SELECT w, pos, k, w[:pos] || x || w[pos + 1:] AS form FROM (SELECT w, unnest(range(1, length(w) + 1)) AS pos FROM (SELECT w FROM exact UNION SELECT word FROM own)) JOIN lost ON w[pos] = letter),
known AS (SELECT w, pos, k, form, lower(form) AS low, n FROM tried JOIN every ON every.word = lower(form)),
first AS (SELECT o.doc_id, o.word, o.own, arg_max(c.form, (c.n - coalesce(m.own, 0), -c.pos, -c.k)) AS fix, max(c.n - coalesce(m.own, 0)) AS seen
  FROM own o JOIN every e ON e.word = o.word AND e.n = o.own JOIN known c ON c.w = o.word LEFT JOIN own m ON m.doc_id = o.doc_id AND m.word = c.low GROUP BY ALL HAVING max(c.n - coalesce(m.own, 0)) >= 3),
shown AS (SELECT doc_id FROM first GROUP BY 1 HAVING count(*) >= 4 AND sum(own) >= 10), fixes AS (SELECT doc_id, word, fix FROM first SEMI JOIN shown USING (doc_id)),
second AS (SELECT x.doc_id, x.w, x.here, e.n - o.own AS seen, arg_max(c.form, (c.n - coalesce(m.own, 0), -c.pos, -c.k)) AS form, max(c.n - coalesce(m.own, 0)) AS most
  FROM exact x SEMI JOIN shown USING (doc_id) ANTI JOIN fixes f ON f.doc_id = x.doc_id AND f.word = lower(x.w) JOIN own o ON o.doc_id = x.doc_id AND o.word = lower(x.w) JOIN every e ON e.word = lower(x.w)
  JOIN known c ON c.w = x.w LEFT JOIN own m ON m.doc_id = x.doc_id AND m.word = c.low GROUP BY ALL),
rare AS (SELECT s.doc_id, s.w, s.form FROM second s LEFT JOIN exact i ON i.doc_id = s.doc_id AND i.w = s.form WHERE most >= 3 AND most >= 20 * greatest(seen, 1) AND coalesce(i.here, 0) * 5 < s.here),
done AS (SELECT p.doc_id, p.i, p.w, coalesce(r.form, CASE WHEN fix IS NULL THEN NULL WHEN p.w = upper(p.w) AND length(p.w) > 1 THEN upper(fix) WHEN p.w[1] = upper(p.w[1]) THEN upper(fix[1]) || fix[2:] ELSE fix END) AS t
  FROM parts p SEMI JOIN shown USING (doc_id) LEFT JOIN fixes f ON f.doc_id = p.doc_id AND f.word = lower(p.w) LEFT JOIN rare r ON r.doc_id = p.doc_id AND r.w = p.w),
repaired AS (SELECT doc_id, string_agg(coalesce(t, w), '' ORDER BY i) AS text, count(t) AS fixes FROM done GROUP BY doc_id)"""


@query(f"WITH {_REPAIRED} SELECT doc_id, text, fixes FROM repaired")
def repair_words(spark, sf_dir):
    return repair.repair(damaged(spark, sf_dir))


@query(f"WITH {_REPAIRED} SELECT coalesce(sum(fixes), 0)::BIGINT AS words, count(*) FILTER (WHERE fixes > 0) AS documents FROM repaired")
def repair_summary(spark, sf_dir):
    return repair.repair(damaged(spark, sf_dir)).agg(F.coalesce(F.sum("fixes"), F.lit(0)).alias("words"), F.count_if(F.col("fixes") > 0).alias("documents"))


@query(f"WITH {TO_SENTS}, f AS (SELECT doc_id, p, min(pos) AS pos FROM sents GROUP BY 1, 2) SELECT doc_id, p, pos, lead(pos) OVER w AS next_pos, lag(pos) OVER w AS prev_pos FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY p)")
def paragraph_jumps(spark, sf_dir):
    firsts = segment.sentences(readings(spark, sf_dir)).groupBy("doc_id", "p").agg(F.min("pos").alias("pos"))
    by = Window.partitionBy("doc_id").orderBy("p")
    return firsts.select("doc_id", "p", "pos", F.lead("pos").over(by).alias("next_pos"), F.lag("pos").over(by).alias("prev_pos"))


@query(rf"""WITH {TO_SENTS}, r AS (SELECT doc_id, position AS pos0 FROM readings) SELECT doc_id, sum(CASE WHEN pos >= pos0 THEN len(regexp_extract_all(text, '\S+')) ELSE 0 END)::BIGINT AS words_left FROM sents JOIN r USING (doc_id) GROUP BY 1""")
def remaining_words_exact(spark, sf_dir):
    docs = readings(spark, sf_dir)
    rows = docs.select("doc_id", "position", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    return rows.groupBy("doc_id").agg(F.sum(F.when(F.col("pos") >= F.col("position"), T.word_count(F.col("s.text"))).otherwise(0)).alias("words_left"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda z: trim(z)), lambda z: z <> '') AS l FROM documents)
SELECT doc_id, doc_id % 900 AS printed FROM p""")
def printed_numbers(spark, sf_dir):
    """Documents as pages that end in their number."""
    lines = F.concat(F.split("text", "\n"), F.array(F.format_string("Page %d", F.col("doc_id") % 900)))
    return table(spark, sf_dir, "documents").select("doc_id", pages.detect_printed_number(lines).cast("long").alias("printed"))


@query("SELECT doc_id, 0 AS n, 0 AS para FROM documents UNION ALL SELECT doc_id, 1, len(list_filter(string_split(text, chr(10)), lambda z: trim(z) <> '')) FROM documents")
def markers(spark, sf_dir):
    """Image markers before the first paragraph and after the last, and where they stood."""
    text = F.concat(F.lit("[[img0]]\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n[[img1]]"))
    rows = table(spark, sf_dir, "documents").select("doc_id", T.take_markers(text, r"\[\[img([0-9]+)\]\]").alias("t"))
    return rows.select("doc_id", F.explode("t.positions").alias("x")).select("doc_id", F.col("x.n").cast("long").alias("n"), F.col("x.para").cast("long").alias("para"))

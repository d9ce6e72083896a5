"""Queries in the order of a language, and text in other forms of its letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.order import by_language, numbered
from lectern.plans import ledger_queries as L
from lectern.plans.base import READINGS, fold_sql, query, readings, table


@query(f"WITH {READINGS} SELECT doc_id, course, row_number() OVER (ORDER BY course COLLATE en, ord, doc_id) AS place FROM readings")
def play_order(spark, sf_dir) -> DataFrame:
    """All readings by course, as its language sorts it, and their order in it: one list, cut into ranges."""
    rows = readings(spark, sf_dir).select("doc_id", "course", "ord")
    return numbered(rows, [], [by_language(F.col("course")), F.col("ord"), F.col("doc_id")], "place").select("doc_id", "course", "place")


@query(f"WITH {READINGS} SELECT doc_id, title, row_number() OVER (ORDER BY title COLLATE en, doc_id) AS place FROM readings")
def title_order(spark, sf_dir) -> DataFrame:
    """Readings by title: accents and capitals count only where letters are the same."""
    rows = readings(spark, sf_dir).select("doc_id", "title")
    return numbered(rows, [], [by_language(F.col("title")), F.col("doc_id")], "place")


WIDE = "".join(chr(0xFF01 + k) for k in range(94))
PLAIN = "".join(chr(0x21 + k) for k in range(94))


@query(f"""SELECT doc_id, {fold_sql("text")} AS plain, {fold_sql("text")} || ' fi 1⁄2 km ᄒ' AS wide FROM documents""")
def fold_forms(spark, sf_dir) -> DataFrame:
    """Texts, and the same in full width with a ligature, a fraction, a unit and half a syllable block: both fold alike."""
    wide = F.concat(F.translate("text", PLAIN, WIDE), F.lit(" ﬁ ½ ㎞ ﾾ"))
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("plain"), T.fold(wide).alias("wide"))


@query(f"""WITH {L.USAGE}, f AS (SELECT CASE WHEN feature LIKE 'Ask%' THEN 'Ask' ELSE feature END AS name, sum(CAST(round(cost * 1e9) AS BIGINT))::BIGINT AS nanos FROM usage GROUP BY 1),
m AS (SELECT strftime(called, '%Y-%m') AS name, sum(CAST(round(cost * 1e9) AS BIGINT))::BIGINT AS nanos FROM usage GROUP BY 1)
SELECT 'feature' AS list, name, nanos, row_number() OVER (ORDER BY nanos DESC, name) AS place FROM f UNION ALL SELECT 'month', name, nanos, row_number() OVER (ORDER BY name DESC) FROM m""")
def cost_lists(spark, sf_dir) -> DataFrame:
    """Features by cost, dearest first, and months, newest first."""
    calls = L.usage(spark, sf_dir).withColumn("nanos", F.round(F.col("cost") * 1e9).cast("long"))
    feature = F.when(F.startswith("feature", F.lit("Ask")), "Ask").otherwise(F.col("feature"))
    features = calls.groupBy(F.lit("feature").alias("list"), feature.alias("name")).agg(F.sum("nanos").alias("nanos"))
    months = calls.groupBy(F.lit("month").alias("list"), F.date_format("at", "yyyy-MM").alias("name")).agg(F.sum("nanos").alias("nanos"))
    # later months have the higher number
    by = F.when(F.col("list") == "month", -F.replace("name", F.lit("-"), F.lit("")).cast("long")).otherwise(-F.col("nanos"))
    return numbered(features.unionByName(months), ["list"], [by, F.col("name")], "place")

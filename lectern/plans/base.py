"""How queries are registered, and the views over the given tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function by its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it lies in fewer files, which may have one row group each; a table of many stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as readings: their source is the course, their id the play order."""
    docs, labels = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    quality = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(quality, "doc_id", "left").select(
        "doc_id",
        F.col("source").alias("course"),
        T.trim(F.regexp_extract("text", r"^[^.\n]*", 0)).alias("title"),
        F.col("doc_id").alias("ord"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
        T.word_count(F.col("text")).alias("word_count"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("completed"),
        (F.col("doc_id") % 7).alias("position"),
    )


READINGS = r"""
readings AS (SELECT d.doc_id, source AS course, trim(regexp_extract(text, '^[^.\n]*')) AS title, d.doc_id AS ord,
  replace(text, chr(10), chr(10) || chr(10)) AS text, len(regexp_extract_all(text, '\S+'))::BIGINT AS word_count,
  coalesce(quality, 0) = 1 AS completed, d.doc_id % 7 AS position
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))"""

#: Cleaned text, paragraphs and sentences of ``readings`` in the other dialect.
_CLEAN = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(173), ''), "
    r"'([A-Za-z0-9_])-\n([A-Za-z0-9_])', '\1\2', 'g'), '[ \t\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))"
)
CLEANED = f"cleaned AS (SELECT doc_id, course, {_CLEAN} AS text FROM readings)"
PARAS = r"""
paras AS (SELECT doc_id, p - 1 AS p, text FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS p FROM
  (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda z: trim(replace(z, chr(10), ' '))), lambda z: z <> '') AS l FROM cleaned)))"""
_CL = "[\"''”’)\\]]"
SENTS = rf"""
marked AS (SELECT doc_id, p, regexp_replace(regexp_replace(regexp_replace(text, '([.!?]{_CL}*)\s+', '\1' || chr(30), 'g'),
  '(\.{_CL}*)\x1e([^\p{{L}}.!?\x1e]*\p{{Ll}})', '\1 \2', 'g'), '(?i)\b({T.ABBREVIATIONS})\.\x1e', '\1. ', 'g') AS text FROM paras),
pieces AS (SELECT doc_id, p, unnest(l) AS text, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, p, list_filter(list_transform(string_split(text, chr(30)), lambda z: trim(z)), lambda z: z <> '') AS l FROM marked)),
cut AS (SELECT doc_id, p, k, CASE WHEN length(text) > 320 THEN list_filter(list_transform(regexp_extract_all(text, '{T.LONG_PIECES}', 1), lambda z: trim(z)), lambda z: z <> '') ELSE [text] END AS l FROM pieces),
sents AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p, k, j) - 1 AS pos, text FROM (SELECT doc_id, p, k, unnest(l) AS text, generate_subscripts(l, 1) AS j FROM cut))"""
TO_SENTS = f"{READINGS}, {CLEANED}, {PARAS}, {SENTS}"


def fold_sql(x: str) -> str:
    return f"lower(strip_accents(replace(replace(replace(replace({x}, '‘', ''''), '’', ''''), '“', '\"'), '”', '\"')))"


_STOP = ", ".join(f"'{w}'" for w in sorted(set(T.STOP_WORDS)))


def stem_sql(w: str) -> str:
    arms = " ".join(
        f"WHEN ends_with({w}, '{s}') AND length({w}) >= {len(s) + 4}" + (f" AND NOT regexp_matches({w}, '(ss|is|us)$')" if s == "s" else "") + f" THEN substr({w}, 1, length({w}) - {len(s)})"
        for s in T.SUFFIXES
    )
    return f"CASE {arms} ELSE {w} END"


def tokens_sql(x: str, folded: bool = False) -> str:
    inner = x if folded else fold_sql(x)
    found = f"list_transform(regexp_extract_all({inner}, '[a-z0-9]+(?:''[a-z]+)?'), lambda z: regexp_replace(z, '''s$', ''))"
    return f"list_transform(list_filter({found}, lambda z: length(z) > 1 AND z NOT IN ({_STOP})), lambda z: {stem_sql('z')})"

"""Batches of phrase searches over sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.shared import settle

#: Rows of a table derived from a batch of queries up to which it is sent to every executor; a larger one is joined by sorting.
BROADCAST_ROWS = 200_000
#: Characters of a word up to which it is looked at in one row.
LONG_WORD = 256


def sized(df: DataFrame) -> DataFrame:
    """A written table with the join hint that its number of rows allows."""
    return df.hint("broadcast" if df.count() <= BROADCAST_ROWS else "merge")


def words_of(c: Column) -> Column:
    """The distinct stretches between white space."""
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def containing(texts: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """``key`` columns and ``qid``: the texts (column ``folded``) that hold every one of a query's ``terms`` as a substring.

    A term's occurrence lies in words that hold the term's own words. So the vocabulary of the texts is searched for the words
    of the terms, by joining on their substrings of the lengths that are asked for; of a query's words the one in the fewest
    texts picks the texts to test, by a join on the vocabulary's words that hold it.
    """
    asked = settle(asked.select("qid", "terms"))
    wanted = asked.select("qid", F.explode(F.flatten(F.transform("terms", words_of))).alias("part")).distinct()
    wanted = settle(wanted)
    lengths = [r["n"] for r in wanted.select(F.length("part").alias("n")).distinct().collect()]
    if not lengths:
        return texts.select(*key, F.lit(None).cast(asked.schema["qid"].dataType).alias("qid")).where("false")
    rows = texts.select(*key, F.explode_outer(words_of(F.col("folded"))).alias("word")).where("word is not null")
    vocabulary = settle(rows.groupBy("word").agg(F.count("*").alias("n")))

    def stretches(n: int) -> Column:
        """A word's substrings of ``n`` characters."""
        found = F.transform(F.sequence(F.lit(1), F.length("piece") - (n - 1)), lambda i: F.substring("piece", i, F.lit(n)))
        return F.when(F.length("piece") >= n, found).otherwise(F.array().cast("array<string>"))

    # a long word is cut into overlapping ones first, so that no row grows with it
    longest = max(lengths)
    width = max(LONG_WORD, 2 * longest)
    starts = F.sequence(F.lit(0), F.greatest(F.length("word") - longest, F.lit(0)), F.lit(width - longest + 1))
    vocabulary = vocabulary.select("word", "n", F.explode(F.transform(starts, lambda k: F.substring("word", k + 1, F.lit(width)))).alias("piece"))
    cut = F.array_distinct(F.flatten(F.array(*map(stretches, sorted(lengths)))))
    parts = settle(wanted.select("part").distinct())
    holds = settle(vocabulary.select("word", "n", F.explode(cut).alias("part")).join(sized(parts), "part", "left_semi").distinct())
    # a word that no text has leaves its query without any text
    weight = wanted.join(sized(settle(holds.groupBy("part").agg(F.sum("n").alias("n")))), "part", "left")
    rarest = weight.groupBy("qid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("r")).select("qid", "r.part")
    by_word = settle(holds.select("part", "word").join(rarest.hint("merge"), "part").select("qid", "word"))
    met = settle(rows.join(sized(by_word), "word").select(*key, "qid").distinct())
    tested = texts.select(*key, "folded").join(sized(met), key)
    tested = tested.join(sized(asked), "qid")
    return tested.where(F.forall("terms", lambda t: F.contains("folded", t))).select(*key, "qid")


def search_hits(sents: DataFrame, titles: DataFrame, queries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``qid``, ``id_col``, ``pos``: sentences that hold every term of a query.

    ``sents`` has ``id_col, pos, text``, ``titles`` has ``id_col, title, course``, ``queries`` has
    ``qid, q`` and perhaps ``course``. A document without a hit whose title holds every term gives its first
    sentence.
    """
    course = F.col("course") if "course" in queries.columns else F.lit(None).cast("string")
    parsed = settle(queries.select("qid", course.alias("only"), T.parse_query(F.col("q")).alias("terms")).where(F.size("terms") > 0))
    folded = settle(sents.select(id_col, "pos", T.fold(F.col("text")).alias("folded")))
    named = settle(titles.select(id_col, "course", T.fold(F.col("title")).alias("folded")))
    only = sized(parsed.select("qid", "only"))
    in_scope = F.col("only").isNull() | (F.col("only") == F.col("course"))
    found = containing(folded, parsed, [id_col, "pos"]).join(only, "qid")
    if "course" in queries.columns:
        found = found.join(named.select(id_col, "course").hint("merge"), id_col).where(in_scope)
    found = settle(found.select("qid", id_col, "pos"))
    by_title = containing(named, parsed, [id_col]).join(only, "qid")
    if "course" in queries.columns:
        by_title = by_title.join(named.select(id_col, "course").hint("merge"), id_col).where(in_scope)
    fallback = by_title.join(found.select("qid", id_col).distinct().hint("merge"), ["qid", id_col], "left_anti").select("qid", id_col, F.lit(0).alias("pos"))
    return found.unionByName(fallback)


def search_groups(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hits of each document and query, and of the query in all."""
    counted = hits.groupBy("qid", id_col).agg(F.count("*").alias("hits"))
    totals = counted.groupBy("qid").agg(F.sum("hits").alias("total"))
    return counted.join(totals.hint("merge"), "qid")


def capped(hits: DataFrame, limit: int = 500, id_col: str = "doc_id") -> DataFrame:
    """The first ``limit`` hits of each query: documents with most hits first, then by id and position."""
    groups = search_groups(hits, id_col)
    ranked = Window.partitionBy("qid").orderBy(F.desc("hits"), id_col, "pos")
    rows = hits.join(groups.hint("merge"), ["qid", id_col]).withColumn("n", F.row_number().over(ranked))
    return rows.where(F.col("n") <= limit).select("qid", id_col, "pos", "total", (F.col("total") > limit).alias("truncated"))

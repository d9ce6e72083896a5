"""Words damaged by ligatures that were lost, repaired with the rest of the library as the dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import search
from lectern.shared import settle

# What may be lost after a letter of a broken ligature.
LOST = {"f": ("i", "l", "f", "t", "fi", "fl"), "F": ("i", "l"), "T": ("h",), "t": ("h",)}
LEAST_SEEN, LEAST_WORDS, LEAST_PLACES, RARER, INTACT = 3, 4, 10, 20, 5


def candidates(word: Column) -> Column:
    """Array of (rank, form): the forms the word may have had, in the order in which they are tried."""
    at = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))

    def forms(i: Column) -> Column:
        c = F.substring(word, i, F.lit(1))
        head, tail = F.substring(word, F.lit(1), i), F.substring(word, i + 1, F.length(word))
        none = F.array().cast("array<string>")
        arms = None
        for letter, lost in LOST.items():
            made = F.array(*(F.concat(head, F.lit(x), tail) for x in lost))
            arms = F.when(c == letter, made) if arms is None else arms.when(c == letter, made)
        return arms.otherwise(none)

    return F.transform(F.flatten(F.transform(at, forms)), lambda w, k: F.struct(k.alias("rank"), w.alias("form")))


def word_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, F.explode_outer(F.regexp_extract_all(text_col, F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).where("w is not null")


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``id_col, word, own`` and ``word, n, docs, only``: words of each document and of all, in lower case, written once.

    ``docs`` tells how many documents have a word, ``only`` the one that does if it is one.
    """
    own = settle(word_rows(df, id_col, text_col).groupBy(id_col, F.lower("w").alias("word")).agg(F.count("*").alias("own")))
    return own, settle(own.groupBy("word").agg(F.sum("own").alias("n"), F.count("*").alias("docs"), F.max(id_col).alias("only")))


def _forms(words: DataFrame, every: DataFrame, col: str) -> DataFrame:
    """``words`` by their candidates that the library has: ``rank``, ``form``, ``low`` and ``all``, its count."""
    tried = words.select("*", F.explode_outer(candidates(F.col(col))).alias("c")).where("c is not null")
    tried = settle(tried.select(*words.columns, "c.rank", "c.form", F.lower("c.form").alias("low")))
    return settle(tried.join(every.select(F.col("word").alias("low"), F.col("n").alias("all")).hint("merge"), "low"))


def damaged_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``id_col``, ``word`` (lower case), ``fix``, ``own``: pass one, with the documents that clearly show damage.

    A document's library is all words but its own: global counts less its own, so no self-join.
    Candidates are made for words that others hardly use only, and looked up by equality.
    """
    own, every = counts or word_counts(df, id_col, text_col)
    # a word that the library never uses is one that this document alone has
    alone = every.where(F.col("docs") == 1).select(F.col("only").alias(id_col), "word", F.col("n").alias("own"))
    known = _forms(alone, every, "word")
    # of all documents' words only those that are such a form stay
    asked = search.sized(settle(known.select(F.col(id_col), F.col("form").alias("word")).distinct()))
    mine = own.join(asked, [id_col, "word"], "left_semi").select(F.col(id_col).alias("of"), F.col("word").alias("same"), F.col("own").alias("mine"))
    seen = known.join(mine.hint("merge"), (F.col(id_col) == F.col("of")) & (F.col("form") == F.col("same")), "left").withColumn("seen", F.col("all") - F.coalesce("mine", F.lit(0)))
    best = seen.groupBy(id_col, "word", "own").agg(F.max(F.struct("seen", (-F.col("rank")).alias("first"), "form")).alias("b")).where(F.col("b.seen") >= LEAST_SEEN)
    fixes = best.select(id_col, "word", "own", F.col("b.form").alias("fix"))
    gate = fixes.groupBy(id_col).agg(F.count("*").alias("words"), F.sum("own").alias("places")).where((F.col("words") >= LEAST_WORDS) & (F.col("places") >= LEAST_PLACES))
    return fixes.join(gate.select(id_col).hint("merge"), id_col, "left_semi")


def rare_words(df: DataFrame, fixes: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``id_col``, ``w``, ``exact``: pass two, real but rare words of damaged documents, case by case.

    Candidates are made once for each word, and what a damaged document has of a word comes from its own rows.
    """
    gated = search.sized(settle(fixes.select(id_col).distinct()))
    _, every = counts or word_counts(df, id_col, text_col)
    exact = settle(word_rows(df.join(gated, id_col, "left_semi"), id_col, text_col).groupBy(id_col, "w").agg(F.count("*").alias("here")).withColumn("word", F.lower("w")))
    forms = search.sized(_forms(exact.select("w").distinct(), every, "w"))
    mine = exact.groupBy(id_col, F.col("word").alias("low")).agg(F.sum("here").alias("mine"))
    left = exact.withColumn("own", F.sum("here").over(Window.partitionBy(id_col, "word"))).join(fixes.select(id_col, "word").hint("merge"), [id_col, "word"], "left_anti")
    known = settle(left.join(forms, "w")).join(every.select("word", "n").hint("merge"), "word").withColumn("seen", F.col("n") - F.col("own")).drop("n", "own", "word")
    known = known.join(mine.hint("merge"), [id_col, "low"], "left").withColumn("count", F.col("all") - F.coalesce("mine", F.lit(0)))
    best = known.groupBy(id_col, "w", "here", "seen").agg(F.max(F.struct("count", (-F.col("rank")).alias("first"), "form")).alias("b"))
    intact = exact.select(id_col, F.col("w").alias("form"), F.col("here").alias("intact"))
    rows = best.select(id_col, "w", "here", "seen", F.col("b.count").alias("count"), F.col("b.form").alias("form")).join(intact.hint("merge"), [id_col, "form"], "left")
    ok = (F.col("count") >= LEAST_SEEN) & (F.col("count") >= RARER * F.greatest("seen", F.lit(1))) & (F.coalesce("intact", F.lit(0)) * INTACT < F.col("here"))
    return rows.where(ok).select(id_col, "w", F.col("form").alias("exact"))


def repair(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the repaired text and ``fixes`` of each damaged document."""
    counts = word_counts(df, id_col, text_col)
    fixes = settle(damaged_words(df, id_col, text_col, counts))
    low = fixes.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("word", "fix"))).alias("low"))
    exact = rare_words(df, fixes, id_col, text_col, counts).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("w", "exact"))).alias("exact"))
    # one row for each damaged document, with words of its own
    fixed_words = settle(low.join(exact.hint("merge"), id_col, "left"))
    rows = df.select(id_col, text_col).join(fixed_words, id_col)
    parts = F.regexp_extract_all(text_col, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))

    def fixed(w: Column) -> Column:
        fix = F.try_element_at("low", F.lower(w))
        upper_first = F.concat(F.upper(F.substring(fix, 1, 1)), F.substring(fix, F.lit(2), F.length(fix)))
        cased = F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(fix)).when(F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1)), upper_first).otherwise(fix)
        return F.coalesce(F.try_element_at("exact", w), F.when(fix.isNotNull(), cased))

    done = F.transform(parts, lambda w: F.struct(F.coalesce(fixed(w), w).alias("t"), fixed(w).isNotNull().cast("int").alias("n")))
    rows = rows.withColumn("done", done)
    return rows.select(id_col, F.array_join(F.transform("done", lambda d: d["t"]), "").alias(text_col), F.aggregate("done", F.lit(0), lambda a, d: a + d["n"]).cast("long").alias("fixes"))

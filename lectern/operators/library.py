"""Keyed tables: upserts, deletes, imports without repeats, progress and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.order import numbered


def upsert(base: DataFrame, delta: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key, the one of the highest version; of equals that of ``delta``."""
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    row = F.struct(*base.columns)
    return both.groupBy(key).agg(F.max_by(row, F.struct(version, "_new")).alias("_row")).select("_row.*")


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def import_key(course: Column, title: Column) -> Column:
    return F.lower(F.concat(course, F.lit("\x01"), title))


def import_new(base: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Rows of ``batch`` with an ``outcome``: 'added', 'updated' (page data put on an equal text) or 'skipped'.

    Within the batch the first of equal keys counts. Both have ``course, title, text, has_pages``.
    """
    rows = batch.withColumn("key", import_key(F.col("course"), F.col("title")))
    first = rows.groupBy("key").agg(F.min(order).alias("_first"))
    have = base.select(import_key(F.col("course"), F.col("title")).alias("key"), F.col("text").alias("_text"), F.col("has_pages").alias("_pages"))
    have = have.groupBy("key").agg(F.min_by(F.struct("_text", "_pages"), "_text").alias("_have"))
    joined = rows.join(first, "key").join(have, "key", "left")
    same = F.col("has_pages") & ~F.col("_have._pages") & (F.col("_have._text") == F.col("text"))
    outcome = F.when(F.col(order) != F.col("_first"), "skipped").when(F.col("_have").isNull(), "added").when(same, "updated").otherwise("skipped")
    return joined.withColumn("outcome", outcome).drop("_first", "_have", "key")


def assign_order(base: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``new`` with ``ord`` that goes on after the highest of its course."""
    highest = base.groupBy("course").agg(F.max("ord").alias("_max"))
    rows = numbered(new, ["course"], [F.col(order)], "_n")
    return rows.join(highest.hint("merge"), "course", "left").withColumn("ord", F.coalesce("_max", F.lit(0)) + F.col("_n")).drop("_max", "_n")


def merge_progress(stored: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """The live position wins where there is one; completed stays once it was."""
    a = stored.select(key, F.col("position").alias("_p"), F.col("completed").alias("_c"))
    b = live.select(key, F.col("position").alias("_lp"), F.col("completed").alias("_lc"))
    return a.join(b, key, "full").select(key, F.coalesce("_lp", "_p").alias("position"), (F.coalesce("_c", F.lit(False)) | F.coalesce("_lc", F.lit(False))).alias("completed"))


def patch(base: DataFrame, patches: DataFrame, key: str, columns: list[str], maps: tuple[str, ...] = ()) -> DataFrame:
    """Fields of ``patches`` that are not null replace those of ``base``; ``maps`` are merged key by key."""
    p = patches.select(key, *(F.col(c).alias(f"_{c}") for c in (*columns, *maps)))
    kept = [c for c in base.columns if c not in columns and c not in maps]
    merged = [F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.map_zip_with(F.coalesce(c, F.col(f"_{c}")), f"_{c}", lambda k, a, b: F.coalesce(b, a))).alias(c) for c in maps]
    return base.join(p, key, "left").select(*kept, *(F.coalesce(f"_{c}", c).alias(c) for c in columns), *merged)

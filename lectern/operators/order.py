"""Orders: by the rules of a language, by numbers inside names, and positions in an order of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.shared import settle


def by_language(c: Column, locale: str = "UNICODE") -> Column:
    """``c`` as a string that is compared by Unicode's collation (of a locale, if one is named)."""
    return F.collate(c, locale)


def ranged(df: DataFrame, group: list[str], order: list[Column]) -> tuple[DataFrame, list[str]]:
    """``df`` written in ranges of its order within groups, with the range (``_range``) and the columns to order by."""
    keys = {f"_o{k}": c for k, c in enumerate(order)}
    rows = settle(df.withColumns(keys))
    # as written, a row's range is fixed
    return settle(rows.repartitionByRange(*group, *keys).withColumn("_range", F.spark_partition_id())), list(keys)


def running_total(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows of its group up to it in order.

    Rows are dealt out by ranges of the whole order, so a group of any size is spread over as many
    tasks as its rows fill. Each range adds up its own rows; what comes before it in its group
    follows from the sums of the ranges before it. ``order`` holds values, lowest first, nulls before
    them. Rows that are equal in ``order`` take any order.
    """
    rows, keys = ranged(df.withColumn("_value", value), group, order)
    sums = settle(rows.groupBy(*group, "_range").agg(F.sum("_value").alias("_sum")))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.col("_range").alias("_r"), before.alias("_before"))
    own = F.sum("_value").over(Window.partitionBy("_range", *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_range") == F.col("_r")
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return rows.withColumn("_own", own).join(starts.hint("shuffle_hash"), same).select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row in its group's order, from 1."""
    return running_total(df, group, order, F.lit(1).cast("long"), name)

"""The usage ledger: prices by pattern, cost, and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE_WRITE = 1.25
MILLION = 1_000_000
NEAR, REACHED = 0.8, 1.0
#: Rules of a price list; a list is sent to every executor, so its length is checked.
MOST_RULES = 1000


def with_cost(usage: DataFrame, rules: DataFrame) -> DataFrame:
    """``usage`` with ``cost``: the first rule whose pattern fits the model, else the list's first rule.

    ``rules`` has ``rule_no, pattern, in_price, out_price, cache_read``. A model's rule is looked up once for each
    distinct model, so the pattern join is small.
    """
    if (n := rules.count()) > MOST_RULES:
        raise ValueError(f"{n} price rules; at most {MOST_RULES} are taken")
    price = F.struct("in_price", "out_price", "cache_read")
    models = usage.select("model").distinct()
    fitting = models.join(F.broadcast(rules), F.expr("rlike(model, pattern)")).groupBy("model").agg(F.min_by(price, "rule_no").alias("rule"))
    first = rules.agg(F.min_by(price, "rule_no").alias("first"))
    joined = usage.join(fitting, "model", "left").crossJoin(F.broadcast(first)).withColumn("rule", F.coalesce("rule", "first"))
    p = F.col("rule")
    cost = (F.col("input") * p["in_price"] + F.col("cache_write") * p["in_price"] * CACHE_WRITE + F.col("cache_read_tokens") * p["in_price"] * p["cache_read"] + F.col("output") * p["out_price"]) / MILLION
    return joined.withColumn("cost", cost).drop("rule", "first")


def with_cost_streaming(usage: DataFrame, rules: DataFrame) -> DataFrame:
    """``with_cost`` for a stream: the price list is an array in each row's expression, tried in order."""
    if (n := rules.count()) > MOST_RULES:
        raise ValueError(f"{n} price rules; at most {MOST_RULES} are taken")
    listed = rules.agg(F.sort_array(F.collect_list(F.struct("rule_no", "pattern", "in_price", "out_price", "cache_read"))).alias("rules"))
    p = F.coalesce(F.get(F.filter("rules", lambda r: F.regexp_like(F.col("model"), r["pattern"])), F.lit(0)), F.get("rules", F.lit(0)))
    cost = (F.col("input") * p["in_price"] + F.col("cache_write") * p["in_price"] * CACHE_WRITE + F.col("cache_read_tokens") * p["in_price"] * p["cache_read"] + F.col("output") * p["out_price"]) / MILLION
    return usage.crossJoin(F.broadcast(listed)).withColumn("cost", cost).drop("rules")


def by_feature(usage: DataFrame) -> DataFrame:
    """Calls, tokens and cost by feature; everything that asks is one row, whose calls are the final answers."""
    asks = F.startswith("feature", F.lit("Ask"))
    feature = F.when(asks, "Ask").otherwise(F.col("feature"))
    calls = F.count_if(~asks | (F.col("feature") == "Ask: answer"))
    tokens_in = F.sum(F.col("input") + F.col("cache_write") + F.col("cache_read_tokens"))
    return usage.groupBy(feature.alias("feature")).agg(calls.alias("calls"), tokens_in.alias("tokens_in"), F.sum("output").alias("tokens_out"), F.round(F.sum("cost"), 6).alias("cost"))


def spend(usage: DataFrame, as_of: str) -> DataFrame:
    """Spend of this month, the last one and all time, in one pass."""
    month = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    last = F.add_months(month, -1).cast("timestamp")
    part = lambda keep: F.round(F.coalesce(F.sum(F.when(keep, F.col("cost"))), F.lit(0.0)), 6)
    return usage.agg(
        part(F.col("at") >= month).alias("this_month"), part((F.col("at") >= last) & (F.col("at") < month)).alias("last_month"), F.round(F.sum("cost"), 6).alias("all_time")
    )


def budget_status(spent: Column, limit: Column) -> Column:
    share = F.when(limit > 0, spent / limit)
    return F.when(share >= REACHED, "reached").when(share >= NEAR, "near").otherwise("ok")


def format_usd(n: Column) -> Column:
    return F.when(n == 0, "$0.00").when(n < 0.01, F.format_string("$%.4f", n)).otherwise(F.format_string("$%.2f", n))


def csv_field(c: Column) -> Column:
    """A field quoted only where it must be."""
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

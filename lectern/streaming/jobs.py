"""Streams: spend by day and its limits, reading progress, newest errors, incremental imports.

A job has a folder of its own for the stream's checkpoint and for the tables that it keeps up to
date. Started again on the same folder it goes on where it was, and applies no batch twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import ledger, library
from lectern.operators.order import running_total
from lectern.shared import settle
from lectern.streaming.tables import KeyedTable, replacing

#: How late a call may come and still count.
LATENESS = "90 days"
SPENT = "day timestamp, feature string, cost double"
PROGRESS = "reading bigint, position bigint, completed boolean"
ALERTS = "month string, share int, call_id bigint, spent bigint"
SUMS = "month string, spent bigint"


def kept(spark: SparkSession, folder: str, name: str, schema, keys: list[str], parts: int = 16) -> KeyedTable:
    """A table of a job."""
    made = spark.createDataFrame([], schema).schema
    return KeyedTable(spark, f"{folder}/{name}", made, keys, parts)


def drain(stream: DataFrame, folder: str, on_batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run everything that is there now through ``on_batch``, going on from the folder's checkpoint."""
    query = stream.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def source(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    schema = spark.read.parquet(path).schema
    # as a pattern the path may name a folder or a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def spend_by_day(usage: DataFrame, folder: str, lateness: str = LATENESS, parts: int = 16) -> KeyedTable:
    """Cost by day and feature, kept up to date: each batch's changed days replace theirs."""
    out = kept(usage.sparkSession, folder, "days", SPENT, ["day", "feature"], parts)
    days = usage.withWatermark("at", lateness).groupBy(F.window("at", "1 day").alias("w"), "feature").agg(F.sum("cost").alias("cost"))
    days = days.select(F.col("w.start").alias("day"), "feature", "cost")
    drain(days, folder, lambda batch, n: out.apply(batch, n, replacing(out.keys)), "update")
    return out


def progress(events: DataFrame, folder: str, parts: int = 16) -> KeyedTable:
    """Latest position of each reading, completion that stays: from ``reading, ts, event_id, position, completed``."""
    out = kept(events.sparkSession, folder, "progress", PROGRESS, ["reading"], parts)
    latest = events.groupBy("reading").agg(F.max_by("position", F.struct("ts", "event_id")).alias("position"), F.bool_or("completed").alias("completed"))
    drain(latest, folder, lambda batch, n: out.apply(batch, n, replacing(out.keys)), "update")
    return out


def crossings(calls: DataFrame, sums: DataFrame, limit: int, shares: dict[int, float]) -> DataFrame:
    """``month, share, call_id, spent``: the calls with which a month's spend, on top of ``sums``, first reaches a share of its limit.

    ``calls`` has ``month, at, call_id, nanos``. Calls count in order of ``at`` and ``call_id``.
    """
    before = sums.select("month", F.col("spent").alias("_spent"))
    total = running_total(calls.select("month", "at", "call_id", "nanos"), ["month"], [F.col("at"), F.col("call_id")], F.col("nanos"), "_total")
    told = total.join(before.hint("shuffle_hash"), "month", "left").withColumn("_spent", F.coalesce("_spent", F.lit(0)))
    told = told.withColumn("spent", F.col("_spent") + F.col("_total")).withColumn("_was", F.col("spent") - F.col("nanos"))
    steps = F.array(*(F.struct(F.lit(k).alias("share"), F.lit(round(x * limit)).cast("long").alias("at_least")) for k, x in shares.items()))
    rows = told.select("month", "at", "call_id", "spent", "_was", F.explode(steps).alias("s")).where((F.col("spent") >= F.col("s.at_least")) & (F.col("_was") < F.col("s.at_least")))
    first = F.min_by(F.struct("call_id", "spent"), F.struct("at", "call_id")).alias("f")
    return rows.groupBy("month", F.col("s.share").alias("share")).agg(first).select("month", "share", "f.call_id", "f.spent")


def limit_alerts(calls: DataFrame, folder: str, limit: int, shares: dict[int, float] | None = None, parts: int = 16) -> KeyedTable:
    """A log of one alert for each month and share of its ``limit`` (in nanos) that the month's calls reach while they come in.

    A batch's calls are added up in order of time by ranges of that order, so a month may have any number of calls. An alert once
    told is told for good: a batch looks at the months' sums before it, and at what was told.
    """
    shares = shares or {round(100 * x): x for x in (ledger.NEAR, ledger.REACHED)}
    spark = calls.sparkSession
    log = kept(spark, folder, "alerts", ALERTS, ["month", "share"], parts)
    sums = kept(spark, folder, "sums", SUMS, ["month"], parts)

    def add(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy("month").agg(F.sum("spent").alias("spent"))

    def on_batch(batch: DataFrame, n: int) -> None:
        # alerts count first: if the job ends between the two, the same batch comes again and finds the sums of before
        log.apply(crossings(batch, sums.read(), limit, shares), n, lambda old, new: old.unionByName(new.join(old, log.keys, "left_anti")))
        sums.apply(batch.groupBy("month").agg(F.sum("nanos").alias("spent")), n, add)

    drain(calls, folder, on_batch)
    return log


def newest(rows: DataFrame, folder: str, keep: int, *order: Column) -> KeyedTable:
    """A log of the newest ``keep`` rows, which is one part."""
    out = KeyedTable(rows.sparkSession, f"{folder}/newest", rows.schema, rows.columns[:1], 1)
    drain(rows, folder, lambda batch, n: out.apply(batch, n, lambda old, new: old.unionByName(new).orderBy(*order).limit(keep)))
    return out


def imports(batches: DataFrame, folder: str, parts: int = 16) -> KeyedTable:
    """Only rows whose course and title are new are added; of equal keys the first id stays."""
    schema = batches.withColumn("import_key", library.import_key(F.col("course"), F.col("title"))).schema
    out = KeyedTable(batches.sparkSession, f"{folder}/library", schema, ["import_key"], parts)

    def merge(have: DataFrame, batch: DataFrame) -> DataFrame:
        added = library.import_new(have, batch, "doc_id").where("outcome = 'added'").drop("outcome")
        return have.unionByName(added)

    def on_batch(batch: DataFrame, n: int) -> None:
        out.apply(batch.withColumn("import_key", library.import_key(F.col("course"), F.col("title"))), n, merge)

    drain(batches, folder, on_batch)
    return out


def refresh_index(index: DataFrame, docs: DataFrame, build: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs`` from an old one: only texts that changed are built again, and removed ids go.

    ``index`` has ``id_col``, ``hash`` and what ``build`` gives.
    """
    now = docs.select(id_col, F.xxhash64(text_col).alias("hash"), text_col)
    known = index.select(id_col, "hash").distinct()
    kept = index.join(now.select(id_col, "hash").hint("merge"), [id_col, "hash"], "left_semi")
    changed = now.join(known.hint("merge"), [id_col, "hash"], "left_anti")
    built = build(changed.select(id_col, text_col)).join(changed.select(id_col, "hash").hint("merge"), id_col)
    return settle(kept.unionByName(built.select(kept.columns)))

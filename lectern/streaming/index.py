"""A persisted index of terms: postings in hash parts, written by generations and merged when they are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.shared import files_of, settle
from lectern.streaming.tables import KeyedTable, replacing

#: Generations that a part may have before it is merged into one.
GENERATIONS = 8
POSTINGS = "term string, doc_id bigint, tf bigint"


def term_counts(docs: DataFrame) -> DataFrame:
    """``term, doc_id, tf`` of ``doc_id, text``."""
    return docs.select("doc_id", F.explode_outer(T.tokens(F.col("text"))).alias("term")).where("term is not null").groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


class PostingIndex:
    """Postings of documents under ``path``.

    ``update`` writes the postings of new and changed texts as one more generation, in the parts
    of their terms only, and notes which older postings are dead: those of documents that changed
    or went. ``lookup`` reads the parts of the terms that are asked for and leaves the dead out.
    ``merge`` joins the generations of parts that have many, without the dead. What a generation or
    a merge wrote counts once it is listed in ``docs`` or ``merged``; one that was broken off is written over.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 16, build: Callable[[DataFrame], DataFrame] = term_counts) -> None:
        self.spark, self.path, self.parts, self.build = spark, path.rstrip("/"), parts, build
        self.files = files_of(spark, self.path)
        row = lambda ddl: spark.createDataFrame([], ddl).schema
        #: What is indexed, and since which generation a document's older postings are dead.
        self.docs = KeyedTable(spark, f"{self.path}/docs", row("doc_id bigint, hash bigint"), ["doc_id"], parts)
        self.dead = KeyedTable(spark, f"{self.path}/dead", row("doc_id bigint, since bigint"), ["doc_id"], parts)
        #: Up to which generation a part is merged, and by which merge.
        self.merged = KeyedTable(spark, f"{self.path}/merged", row("part int, upto bigint, number bigint"), ["part"], 1)

    def update(self, docs: DataFrame, removed: DataFrame | None = None) -> int:
        """Bring the index up to date with ``docs`` (``doc_id, text``; all that may have changed) and the ids ``removed``."""
        generation = self.docs.last() + 1
        known = self.docs.read()
        now = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
        changed = settle(now.join(known.hint("merge"), ["doc_id", "hash"], "left_anti"))
        made = self.build(changed.select("doc_id", "text")).withColumn("part", self.part_of(F.col("term")))
        made.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings/generation={generation}")
        gone = removed.select("doc_id").join(known.hint("merge"), "doc_id", "left_semi") if removed is not None else known.select("doc_id").limit(0)
        gone = settle(gone.distinct())
        dying = changed.select("doc_id").join(known.hint("merge"), "doc_id", "left_semi").union(gone)
        self.dead.apply(dying.select("doc_id", F.lit(generation).cast("long").alias("since")), generation, replacing(["doc_id"]))
        after = changed.select("doc_id", "hash").unionByName(gone.select("doc_id", F.lit(None).cast("long").alias("hash")))
        self.docs.apply(after, generation, lambda old, new: replacing(["doc_id"])(old, new).where("hash is not null"))
        return generation

    def part_of(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.parts)).cast("int")

    def postings(self, parts: list[int] | None = None) -> DataFrame:
        """Living postings of all parts, or of some, with their ``part`` and ``generation``."""
        schema = f"{POSTINGS}, generation bigint, part int"
        if not self.files.names("postings"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/postings").where(F.col("generation") <= self.docs.last())
        if parts is not None:
            rows = rows.where(F.col("part").isin(parts))
        done = {r["part"]: (r["upto"], r["number"]) for r in self.merged.read().collect()}  # a row a part
        if done:
            upto = F.create_map(*(F.lit(x) for part, (n, _) in done.items() for x in (part, n)))
            rows = rows.where(F.col("generation") > F.coalesce(F.try_element_at(upto, F.col("part")), F.lit(-1)))
        for part, (upto, number) in done.items():
            if (parts is None or part in parts) and self.files.exists(f"bases/number={number}/part={part}"):
                base = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/bases/number={number}/part={part}")
                rows = rows.unionByName(base.withColumns({"generation": F.lit(upto).cast("long"), "part": F.lit(part)}))
        dead = self.dead.read().select(F.col("doc_id").alias("_dead"), "since").hint("merge")
        return rows.join(dead, (F.col("doc_id") == F.col("_dead")) & (F.col("generation") < F.col("since")), "left_anti")

    def lookup(self, terms: DataFrame) -> DataFrame:
        """``term, doc_id, tf`` of the distinct ``term`` of ``terms``, from their parts only."""
        asked = settle(terms.select("term").distinct())
        parts = [r[0] for r in asked.select(self.part_of(F.col("term"))).distinct().collect()]  # no more than ``parts``
        return self.postings(parts).join(asked.hint("merge"), "term", "left_semi").select("term", "doc_id", "tf")

    def crowded(self) -> list[int]:
        """Parts of more than ``GENERATIONS`` generations."""
        count: dict[int, int] = {}
        for folder in self.files.names("postings"):
            for part in self.files.names(f"postings/{folder}"):
                if part.startswith("part="):
                    count[int(part[5:])] = count.get(int(part[5:]), 0) + 1
        return sorted(p for p, n in count.items() if n > GENERATIONS)

    def merge(self, parts: list[int] | None = None) -> list[int]:
        """Write the living postings of ``parts`` (the crowded ones, if not given) as one base each; returns the parts."""
        parts = self.crowded() if parts is None else parts
        last = self.docs.last()
        if not parts or last < 0:
            return []
        number, before = self.merged.last() + 1, {r["part"]: r["number"] for r in self.merged.read().collect()}
        living = self.postings(parts).select("term", "doc_id", "tf", "part")
        living.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/bases/number={number}")
        listed = self.spark.createDataFrame([(p, last, number) for p in parts], "part int, upto bigint, number bigint")
        self.merged.apply(listed, number, replacing(["part"]))
        # from here on the bases count, and what they took in can go
        for folder in self.files.names("postings"):
            if folder.startswith("generation=") and int(folder[11:]) <= last:
                for p in parts:
                    self.files.remove(f"postings/{folder}/part={p}")
        for p in parts:
            if p in before:
                self.files.remove(f"bases/number={before[p]}/part={p}")
        return parts

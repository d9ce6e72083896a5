"""Tables that batches keep up to date: hash parts of which a batch writes only those it touches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.shared import files_of


class KeyedTable:
    """A table in ``parts`` parts by the hash of its key columns.

    ``apply`` writes the parts that a batch touches under the batch's number, and then a list of
    the parts' newest numbers, which makes the batch count. A batch whose number is not above the
    last one that counts was applied before and is passed over, so a stream that starts again from
    its checkpoint applies each batch once. Files of a batch that never came to count are
    written over. Parts that neither the last list nor the one before names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], parts: int = 16) -> None:
        self.spark, self.path, self.schema, self.keys, self.parts = spark, path.rstrip("/"), schema, keys, parts
        self.files = files_of(spark, self.path)

    def numbers(self) -> list[int]:
        """Numbers of the batches that count, of which the last two are kept."""
        found = [int(name[6:]) for name in self.files.names("lists") if name.startswith("batch=")]
        return sorted(n for n in found if self.files.exists(f"lists/batch={n}/_SUCCESS"))

    def last(self) -> int:
        return max(self.numbers(), default=-1)

    def newest(self, number: int | None = None) -> dict[int, int]:
        """The batch that wrote each part."""
        number = self.last() if number is None else number
        if number < 0:
            return {}
        rows = self.spark.read.schema("part int, batch bigint").parquet(f"{self.path}/lists/batch={number}").collect()  # a row a part
        return {r["part"]: r["batch"] for r in rows}

    def _read(self, places: Iterable[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.path}/data/batch={batch}/_part={part}" for part, batch in places]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        return self._read(self.newest().items())

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def apply(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched parts by ``merge(their rows, batch)``; returns their numbers."""
        if number <= self.last():
            return []
        newest = self.newest()
        touched = sorted(r[0] for r in batch.select(self.part_of()).distinct().collect())  # no more than ``parts``
        if touched:
            old = self._read((p, newest[p]) for p in touched if p in newest)
            merged = merge(old, batch).select([f.name for f in self.schema.fields]).withColumn("_part", self.part_of())
            merged.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/data/batch={number}")
        # a part that is left without rows has no folder
        written = {int(name[6:]) for name in self.files.names(f"data/batch={number}") if name.startswith("_part=")} if touched else set()
        now = {p: b for p, b in newest.items() if p not in touched} | {p: number for p in touched if p in written}
        listed = self.spark.createDataFrame(sorted(now.items()), "part int, batch bigint")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/batch={number}")
        self._forget(newest, now)
        return touched

    def _forget(self, before: dict[int, int], now: dict[int, int]) -> None:
        kept = {*before.items(), *now.items()}
        for folder in self.files.names("data"):
            for part in self.files.names(f"data/{folder}"):
                if part.startswith("_part=") and (int(part[6:]), int(folder[6:])) not in kept:
                    self.files.remove(f"data/{folder}/{part}")
        for n in self.numbers()[:-2]:
            self.files.remove(f"lists/batch={n}")


def replacing(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge by which rows of the batch take the place of those of the same keys."""
    return lambda old, new: old.join(new.select(keys), keys, "left_anti").unionByName(new)

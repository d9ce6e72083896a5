"""Images of readings in a layout by reading, from which one reading's images are read without the others'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ImageStore:
    """``reading, n, data`` in ``parts`` folders by the hash of the reading, sorted by reading and n in each file.

    A scan of one reading reads its folder only, and of the files there those row groups whose range of readings holds it.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 16) -> None:
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _part(self, reading: Column) -> Column:
        return F.pmod(F.xxhash64(reading), F.lit(self.parts)).cast("int")

    def write(self, images: DataFrame) -> None:
        rows = images.select("reading", "n", "data").withColumn("_part", self._part(F.col("reading")))
        rows.repartition(self.parts, "_part").sortWithinPartitions("_part", "reading", "n").write.mode("append").partitionBy("_part").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def scan(self, reading) -> DataFrame:
        """The images of one reading, in order."""
        rows = self.read()
        key = F.lit(reading).cast(rows.schema["reading"].dataType)
        return rows.where((F.col("_part") == self._part(key)) & (F.col("reading") == key)).drop("_part").orderBy("n")

    def scans(self, readings: DataFrame) -> DataFrame:
        """The images of many readings; both sides lie in parts, so only those of the asked readings' folders meet."""
        asked = readings.select("reading").distinct().withColumn("_part", self._part(F.col("reading")))
        return self.read().join(asked.hint("shuffle_hash"), ["_part", "reading"], "left_semi").drop("_part")


def without(images: DataFrame, readings: DataFrame) -> DataFrame:
    """What is left when ``readings`` go with all of their images."""
    return images.join(readings.select("reading").distinct().hint("shuffle_hash"), "reading", "left_anti")

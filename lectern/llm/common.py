"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.shared import forget, settle, shared_dir

__all__ = ["forget", "map_texts", "settle", "shared_dir", "table"]

#: Rows that a Python task holds in its output before it hands them on.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(
    df: DataFrame,
    schema: StructType | str,
    make: Callable[[], Callable[[list], Sequence]],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Run ``make()(texts) -> columns`` over the texts and return ``id_col`` plus the columns of ``schema``.

    Only the id and the text are read, so other columns of ``df`` can neither clash nor slow the
    scan. ``make`` runs once in each task. A null text arrives as None.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    out = StructType([rows.schema["id"], *fields.fields])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = run(part.column(1).to_pylist())
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(made, list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], schema=arrow)

    return rows.mapInArrow(work, out).withColumnRenamed("id", id_col)

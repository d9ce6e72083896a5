"""Sentences of documents, their context, and passages over them.

Arrays that took work to make are exploded by ``explode_outer``, with a test for null behind it: a plain ``explode`` has Catalyst
infer a filter on the array's size and push it to the scan, with all that makes the array in it a second time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from lectern.functions import text as T

WINDOW_WORDS = 110


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``p``, ``pos``, ``text``: a row for each sentence; positions count through the document."""
    found = df.select(id_col, F.posexplode_outer(T.sentences(F.col(text_col))).alias("pos", "s")).where("pos is not null")
    return found.select(id_col, F.col("s.p").alias("p"), "pos", F.col("s.text").alias("text"))


def sentence_context(sents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each sentence with its neighbours inside the same paragraph."""
    by = Window.partitionBy(id_col, "p").orderBy("pos")
    return sents.select("*", F.lag("text").over(by).alias("prev"), F.lead("text").over(by).alias("next"))


def sentence_arrays(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """``df``'s ``id_col``, the columns ``keep``, ``sents`` (array of (p, text)) and ``before``: words before each sentence, and in all."""

    @F.pandas_udf("array<int>")
    def running(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: np.concatenate([[0], np.cumsum(c)]).astype(np.int32) if c is not None else None)

    rows = df.select(id_col, *keep, T.sentences(F.col(text_col)).alias("sents"))
    # only the numbers go to Python, where a sum over a document of any length takes one pass
    return rows.select(id_col, *keep, "sents", running(F.transform("sents", lambda s: F.size(F.split(s["text"], r"\s+")))).alias("before"))


def spans_of(before: np.ndarray, words: int = WINDOW_WORDS) -> list[dict[str, int]]:
    """The passages of a document by the words before each sentence: each ends where it has enough words, and the next begins half way back."""
    out, i, n = [], 0, len(before) - 1
    while i < n:
        end = min(n - 1, int(np.searchsorted(before[1:], before[i] + words)))
        out.append({"start": i, "end": end})
        if end == n - 1:
            break
        i = max(i + 1, (i + end + 1) // 2)
    return out


def windows(rows: DataFrame, id_col: str = "doc_id", words: int = WINDOW_WORDS) -> DataFrame:
    """``rows`` of ``sentence_arrays`` with ``spans``: arrays of (start, end), the passages of each document."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(before: pd.Series) -> pd.Series:
        return before.map(lambda b: spans_of(np.asarray(b), words) if b is not None else None)

    return rows.withColumn("spans", spans("before"))


def passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WINDOW_WORDS) -> DataFrame:
    """``id_col``, ``start``, ``end``: windows of sentences of at least ``words`` words that overlap by about half.

    One document's windows come from its own sentence counts, so nothing is shuffled.
    """
    counts = F.transform(T.sentences(F.col(text_col)), lambda s: F.size(F.split(s["text"], r"\s+")))
    rows = df.select(F.col(id_col).alias("id"), counts.alias("counts"))
    schema = StructType([rows.schema["id"], StructField("start", IntegerType()), StructField("end", IntegerType())])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(np.concatenate([[0], np.cumsum(np.asarray(c or [], np.int64))]), words) for c in batch.column(1).to_pylist()]
            owner = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            ends = [pa.array([w[k] for x in found for w in x], pa.int32()) for k in ("start", "end")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *ends], schema=arrow)

    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)

"""Operator 12: lines that several documents hold stay in the first of them only.

Two Bloom filters hold the hashes of line keys that were seen once and those that were seen twice.
Each task fills a pair of its own over its documents, each key counting once in a document. Pairs
are merged segment by segment: what one has seen once and the other too is seen twice. A key whose
bits are not all set in the second filter is surely held by one document alone and goes nowhere;
only the others, suspected repeats, are shuffled, as SHA-256 of the key and the document's id. Counting these exactly tells
the repeated keys and the first document of each, and every other document learns which keys it loses.

The filters have ``BITS`` bits for each line of the table, up to ``MOST_BITS`` (128 MB, which is
what may be collected and broadcast). A table with more lines than that serves has no filter: all of
its keys are suspects, and the rows are the same. A key held by more than one in ``HOT`` of all suspects is
hot; there are fewer than ``HOT`` such keys, which are joined by broadcast, and the others by shuffle.

Defined results: a null or empty text is one empty line; lines whose key has fewer than ``least``
code points stay; texts and lines of any length are read whole; a key repeated only within one
document stays; rows of one id are one document, rows without id are one document too, behind all
others; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType
from xxhash import xxh3_64_intdigest

from lectern.llm.common import SLICE_ROWS, settle, table

LEAST = 10
BLANKS = b" \t\n\x0b\x0c\r"
#: Bits for each line, bits of one segment of a filter, most bits of a filter.
BITS, SEGMENT, MOST_BITS = 8, 1 << 22, 1 << 30
HOT = 1000
#: Rows and bytes of a table of lost keys that may be sent to every executor.
FEW_ROWS, FEW_BYTES = 500_000, 1 << 26


def key_of(line: bytes, least: int) -> bytes:
    """What lines are compared by, or nothing if that is too short to count."""
    key = line.strip(BLANKS).lower()
    if len(key) < least or (not key.isascii() and len(key.decode()) < least):
        return b""
    return key


def keys_of(text: str | None, least: int) -> set[bytes]:
    keys = {key_of(line, least) for line in (text or "").encode().split(b"\n")}
    keys.discard(b"")
    return keys


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    low = np.uint64(bits - 1)
    return (hashes & low).astype(np.int64), ((hashes >> np.uint64(32)) & low).astype(np.int64)


def filter_bits(lines: int) -> int:
    """Bits of a filter for so many lines: a power of two, of a segment at least."""
    return max(SEGMENT, 1 << (max(1, lines) * BITS - 1).bit_length())


def twice_seen(rows: DataFrame, bits: int, least: int = LEAST) -> np.ndarray:
    """The bytes of the filter of keys that two rows (id, text) or more hold."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.fromiter(map(xxh3_64_intdigest, keys_of(t, least)), np.uint64) for b in batches for t in b.column(0).to_pylist()]
        hashes, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *seen]), return_counts=True)
        once, twice = (np.unique(np.concatenate(places(h, bits))) for h in (hashes, hashes[counts > 1]))
        parts = np.unique(once // SEGMENT)
        cut = lambda x, part: (x[np.searchsorted(x, part * SEGMENT) : np.searchsorted(x, (part + 1) * SEGMENT)] - part * SEGMENT).astype(np.uint32).tobytes()
        for part in parts.tolist():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([part], pa.int64()), "once": pa.array([cut(once, part)], pa.binary()), "twice": pa.array([cut(twice, part)], pa.binary())})

    def merge(pairs: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
        for a, b in zip(pairs["once"], pairs["twice"], strict=True):
            at = np.frombuffer(a, np.uint32)
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.frombuffer(b, np.uint32)] = True
        return pd.DataFrame({"segment": [int(pairs["segment"].iloc[0])], "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    pairs = rows.select("text").mapInArrow(fill, "segment bigint, once binary, twice binary")
    merged = pairs.groupBy("segment").applyInPandas(merge, "segment bigint, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        out[r["segment"] * SEGMENT // 8 : (r["segment"] + 1) * SEGMENT // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def suspects(rows: DataFrame, least: int = LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """``id`` and ``key`` (a digest) of each row's distinct keys that another row may hold."""
    spark = rows.sparkSession
    lines = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = filter_bits(lines)
    told = spark.sparkContext.broadcast(twice_seen(rows, bits, least)) if bits <= most_bits else None
    schema = StructType([rows.schema["id"], StructField("key", BinaryType())])
    arrow = to_arrow_schema(schema)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                held = [sorted(keys_of(t, least)) for t in part.column(1).to_pylist()]
                keys = [k for ks in held for k in ks]
                owner = np.repeat(np.arange(len(held)), [len(ks) for ks in held])
                likely = np.arange(len(keys))
                if told is not None and keys:
                    a, b = places(np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys)), bits)
                    likely = np.flatnonzero((told.value[a >> 3] >> (a & 7)) & (told.value[b >> 3] >> (b & 7)) & 1)
                digests = pa.array([sha256(keys[k]).digest() for k in likely.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[likely])), digests], schema=arrow)

    return rows.mapInArrow(sift, schema)


def lost_keys(found: DataFrame) -> DataFrame:
    """Of rows ``id``, ``key`` the keys that each id loses: ``of``, ``keys``. ``found`` must be written."""
    total = found.count()
    told = found.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("unnamed"), F.count("*").alias("n"))
    several = F.col("first").isNotNull() & (F.col("unnamed") | (F.col("first") < F.col("last")))
    repeated = settle(told.where(several).select(F.col("key").alias("same"), "first", (F.col("n") * HOT > total).alias("hot")))
    hot = repeated.where("hot").drop("hot")
    rare = repeated.where("not hot").drop("hot")
    later = (F.col("key") == F.col("same")) & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    # fewer than HOT rows of a digest and an id
    of_hot = found.join(F.broadcast(hot), later)
    others = found.join(F.broadcast(hot.select(F.col("same").alias("common"))), F.col("key") == F.col("common"), "left_anti")
    of_rare = others.join(rare.hint("merge"), later)
    return of_hot.unionByName(of_rare).groupBy(F.col("id").alias("of")).agg(F.collect_set("key").alias("keys"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """``id_col``, ``kept`` (the text that stays), ``n_lines`` before, and ``n_dropped``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lost = settle(lost_keys(settle(suspects(rows, least, most_bits))))
    size = lost.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    few = size[0] <= FEW_ROWS and 48 * (size[0] + size[1]) <= FEW_BYTES
    both = rows.join(lost.hint("broadcast" if few else "merge"), F.col("id").eqNullSafe(F.col("of")), "left").select("id", "text", "keys")
    schema = StructType([rows.schema["id"], StructField("kept", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    arrow = to_arrow_schema(schema)

    def left_of(text: str | None, keys: list[bytes] | None) -> tuple[str, int, int]:
        lines = (text or "").split("\n")
        if not keys:
            return text or "", len(lines), 0
        gone = set(keys)
        kept = [line for line in lines if not ((k := key_of(line.encode(), least)) and sha256(k).digest() in gone)]
        return "\n".join(kept), len(lines), len(lines) - len(kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = list(zip(*map(left_of, part.column(1).to_pylist(), part.column(2).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(made, list(arrow)[1:], strict=True))], schema=arrow)

    return both.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
told AS (SELECT k.*, coalesce(k.doc_id > r.first, false) AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY doc_id
"""

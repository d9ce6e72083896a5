"""Operator 10: benchmark decontamination, with DataFrame functions only.

Short test items are searched inside long documents. An item belongs to a size class by the
number of its distinct five-word shingles. Its sketch holds the shingles of least hash, as many as
the class's lower bound asks for: a document with at least ``threshold`` of the item's shingles
misses at most ``floor((1 - threshold) * n)`` of them, so one more than that many always
contains a shared one and no qualifying pair is lost, whatever the length of the document.
Candidates are then verified by counting shared distinct shingles as text.

Words are runs of letters and digits of the lower-cased text. Defined results: a null or empty
text and one of fewer than five words has no shingle and matches nothing; very long texts are
searched whole; rows of one id count as one document, null ids as one too; repeated items
(same id) count as one item, items of null id are ignored; an empty table gives no pairs; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import settle, table

WORDS = 5
THRESHOLD = 0.8
#: Rows of a table of candidates or sketches that may be sent to every executor.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a join hint that fits its counted rows."""
    return df.hint("broadcast") if rows <= BROADCAST_ROWS else df.hint("merge")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``w`` (the words) and ``i`` (where a shingle starts), a row for each shingle."""
    rows = df.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") >= WORDS)
    return rows.select("id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - WORDS)).alias("i"))


def shingle_hash() -> Column:
    return F.xxhash64(*(F.get("w", F.col("i") + k) for k in range(WORDS)))


def shingle_text() -> Column:
    return F.concat_ws(" ", *(F.get("w", F.col("i") + k) for k in range(WORDS)))


def contained(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    item_text_col: str = "text",
) -> DataFrame:
    """Pairs ``id_col``, ``item_col`` with ``n_item``, ``n_shared`` (bigint) and ``containment`` of at least ``threshold``."""
    items = items.where(F.col(item_col).isNotNull())
    of_items = settle(shingle_rows(items, item_col, item_text_col).select("id", shingle_hash().alias("h"), shingle_text().alias("s")).distinct())
    sizes = of_items.groupBy("id").agg(F.count("*").alias("n_item"))
    # Size classes are powers of two; a sketch is as long as the largest item of its class needs.
    needed = F.floor(F.lit(1 - threshold + 1e-9) * F.pow(F.lit(2.0), F.ceil(F.log2("n_item")))) + 1
    ranked = of_items.select("id", "h", "s").join(sizes.hint("shuffle_hash"), "id")
    least = F.row_number().over(Window.partitionBy("id").orderBy("h", "s"))
    sketch = settle(ranked.withColumn("least", least).where(F.col("least") <= needed).select(F.col("id").alias("item"), F.col("h").alias("item_h")))
    seen = (
        shingle_rows(docs, id_col, text_col)
        .select("id", shingle_hash().alias("h"))
        .join(sized(sketch, sketch.count()), F.col("h") == F.col("item_h"))
        .select("id", "item")
    )
    candidates = settle(seen.distinct())
    ids = settle(candidates.select(F.col("id").alias("found")).distinct())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(sized(ids, ids.count()), F.col("id").eqNullSafe(F.col("found")), "left_semi")
    mine = shingle_rows(chosen, "id", "text").select("id", shingle_text().alias("s"))
    both = of_items.select(F.col("id").alias("item"), F.col("s").alias("item_s"))
    shared = (
        mine.join(sized(both, both.count()), F.col("s") == F.col("item_s"))
        .groupBy("id", "item")
        .agg(F.count_distinct("s").alias("n_shared"))
    )
    sizes = settle(sizes.withColumnRenamed("id", "of_item"))
    found = shared.join(sized(sizes, sizes.count()), F.col("item") == F.col("of_item"))
    return found.where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - F.lit(1e-9)).select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        "n_item",
        "n_shared",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def without(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those whose id is in ``found``; a null id stays only if no null was found."""
    gone = settle(found.select(F.col(id_col).alias("gone_id")).distinct())
    few = sized(gone, gone.count())
    return docs.join(few, docs[id_col].eqNullSafe(few["gone_id"]), "left_anti")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
it AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw WHERE len(w) >= 5)),
sz AS (SELECT item_id, count(*) AS n_item FROM it GROUP BY 1),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
sh AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN it USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM sh JOIN sz USING (item_id) WHERE n_shared >= n_item * 0.8 - 1e-9
"""

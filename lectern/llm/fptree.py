"""Operator 13: the best documents for each item, by branch and bound over trees of frequent terms.

A document is kept as the terms that some item asks for, most frequent first, with their counts
(tf) and its length number (m). Each task puts its documents into trees, a bounded number at a time: documents
that begin with the same frequent terms share a path, and small neighbouring branches share a leaf.
A node knows the greatest tf of every term and the least m below it. A term's part of a score grows with tf
and falls with m, so these bound the score of every document below. For each item a tree is
searched depth first, best branch first; a branch goes if its bound is below the item's tenth score
so far, which is carried from tree to tree. Leaves are scored exactly. Each task hands on ten rows
an item, of which the ten best are chosen.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A to Z
lower-cased. Items are taken in blocks of at most ``ITEMS`` items and ``CHARS`` characters, which
bounds what is broadcast; each block reads the documents once.

Defined results: a null or empty text has no terms; it is in no result and does not count among
the documents; an item without terms has no rows; equal scores come in order of id, no id last; repeated
rows are documents, or items, of their own; texts of any length are read whole; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lectern.llm.common import SLICE_ROWS, map_texts, settle, table

TOP = 10
#: Items and characters of one block.
ITEMS, CHARS = 500, 1_000_000
#: Documents and terms of one tree; documents of a leaf.
TREE_DOCS, TREE_TERMS, LEAF = 8192, 2_000_000, 16
#: Least weight of length in a hundred, and what is left of it.
FLAT, SLOPE = 25, 75
#: Parts into which an item's rows are ranked before they meet.
PARTS = 64

# bytes that end a term become blanks; those of letters beyond ASCII stay
TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def part_of_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_numbers(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents of ``n`` terms, in a corpus of so many documents and terms."""
    if len(n) and SLOPE * int(n.max()) * docs < 1 << 63:
        return FLAT + SLOPE * n * docs // terms
    return np.array([FLAT + SLOPE * x * docs // terms for x in n.tolist()], np.int64)


def vectors(docs: DataFrame, words: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n`` (terms in all), and the numbers and counts of those terms that are in ``words``."""
    told = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words)})

    def make():
        number, many = told.value, len(told.value)

        def work(texts: list) -> list:
            split = [terms_of(t) for t in texts]
            sizes = [len(ws) for ws in split]
            codes = np.fromiter((number.get(w, -1) for ws in split for w in ws), np.int64, sum(sizes))
            owner = np.repeat(np.arange(len(split)), sizes)[codes >= 0]
            keys, counts = np.unique(owner * many + codes[codes >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(split) + 1) * many).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % max(many, 1), counts)]
            return [pa.array(sizes, pa.int64()), *lists]

        return work

    return map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "n bigint, terms array<int>, tfs array<int>", make, "id")


class Tree:
    """Documents as paths of terms by rank. ``offsets`` cut ``terms`` (numbers) and ``tfs`` into documents; none is empty."""

    def __init__(self, ids: list, m: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, rank: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.lexsort((rank[terms], owner))
        terms, tfs = terms[order], tfs[order]
        self.children: list[list[int]] = [[]]
        #: Of each leaf, which documents it has.
        self.leaves: dict[int, np.ndarray] = {}
        self._branch(rank[terms], offsets)
        self._bound(len(rank), m, owner, terms, tfs)
        self.ids, self.offsets, self.terms, self.parts = ids, offsets, terms, part_of_score(tfs.astype(np.int64), m[owner])

    def _branch(self, ranks: np.ndarray, offsets: np.ndarray) -> None:
        todo = [(0, np.arange(len(offsets) - 1), 0)]
        while todo:
            node, docs, depth = todo.pop()
            groups: list[np.ndarray] = []
            while len(docs) > LEAF:
                at = offsets[docs] + depth
                over = at >= offsets[docs + 1]
                here = np.where(over, -1, ranks[np.where(over, 0, at)])
                depth += 1
                if (here == here[0]).all():
                    if over[0]:
                        break
                    continue
                order = np.argsort(here, kind="stable")
                groups = np.split(docs[order], np.flatnonzero(np.diff(here[order])) + 1)
                break
            if not groups:
                self.leaves[node] = docs
                continue
            small: list[np.ndarray] = []
            for k, group in enumerate(groups):
                if len(group) > LEAF:
                    todo.append((self._child(node), group, depth))
                else:
                    small.append(group)
                if small and (k + 1 == len(groups) or sum(map(len, small)) >= LEAF):
                    self.leaves[self._child(node)] = np.concatenate(small)
                    small = []

    def _child(self, node: int) -> int:
        self.children.append([])
        self.children[node].append(len(self.children) - 1)
        return len(self.children) - 1

    def _bound(self, words: int, m: np.ndarray, owner: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """The greatest part that each term can have below each node."""
        nodes = len(self.children)
        most, least_m = np.zeros((nodes, words), np.int32), np.full(nodes, np.iinfo(np.int64).max)
        leaf_of = np.empty(len(m), np.int64)
        for node, docs in self.leaves.items():
            leaf_of[docs] = node
            least_m[node] = m[docs].min()
        np.maximum.at(most, (leaf_of[owner], terms), tfs)
        for node in range(nodes - 1, -1, -1):
            if self.children[node]:
                most[node] = most[self.children[node]].max(axis=0)
                least_m[node] = least_m[self.children[node]].min()
        self.most = np.empty((nodes, words), np.int32)
        for node in range(nodes):
            self.most[node] = part_of_score(most[node].astype(np.int64), least_m[node])

    def search(self, terms: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, best: list, k: int) -> list:
        """The ``k`` best of ``best`` (keys of score and id) and the documents of this tree, best first."""
        todo = [(int(self.most[0, terms] @ weights), 0)]
        while todo:
            bound, node = todo.pop()
            if bound <= 0 or (len(best) == k and bound < -best[-1][0]):
                continue
            if (docs := self.leaves.get(node)) is None:
                below = np.array(self.children[node])
                bounds = self.most[np.ix_(below, terms)] @ weights
                order = np.argsort(bounds, kind="stable")
                todo += zip(bounds[order].tolist(), below[order].tolist(), strict=True)
                continue
            scores = self.score(docs, weight_of)
            floor = max(1, -best[-1][0]) if len(best) == k else 1
            good = np.flatnonzero(scores >= floor)
            if len(good) > k:  # those at or above the k-th of these
                good = good[scores[good] >= np.partition(scores[good], -k)[-k]]
            if len(good):
                best = sorted(best + [sort_key(int(scores[g]), self.ids[docs[g]]) for g in good.tolist()])[:k]
        return best

    def score(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        sizes = self.offsets[docs + 1] - self.offsets[docs]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.offsets[docs] - starts, sizes)
        return np.add.reduceat(weight_of[self.terms[at]] * self.parts[at], starts)


def sort_key(score: int, doc) -> tuple:
    """Highest score first, then lowest id, no id last."""
    return -score, doc is None, doc if doc is not None else 0


def best_of_tasks(found: DataFrame, items: list[tuple], words: list[bytes], item_field: StructField, top: int) -> DataFrame:
    """``at`` (which item), ``item_id``, ``doc_id`` and ``score``: the best of each task for each item. ``found`` must be written."""
    spark = found.sparkSession
    docs, terms = found.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator())  # no more rows than ``words``
    df = np.array([held.get(k, 0) for k in range(len(words))], np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((np.arange(len(words)), -df))] = np.arange(len(words))
    number = {w: k for k, w in enumerate(words)}
    asked = [(item, sorted((number[w], c) for w, c in Counter(ts).items())) for item, ts in items]
    told = spark.sparkContext.broadcast((asked, weight, rank))
    schema = StructType([StructField("at", IntegerType()), item_field, StructField("doc_id", found.schema["id"].dataType), StructField("score", LongType())])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight, rank = told.value
        wanted = []
        for _, counted in asked:
            ts, counts = np.array(counted, np.int64).reshape(-1, 2).T
            weight_of = np.zeros(len(rank), np.int64)
            weight_of[ts] = weight[ts] * counts
            wanted.append((ts, weight_of[ts], weight_of))
        best: list[list] = [[] for _ in asked]
        for ids, n, offsets, ts, tfs in tree_loads(batches):
            tree = Tree(ids, length_numbers(n, docs, terms), offsets, ts, tfs, rank)
            for k, (own, weights, weight_of) in enumerate(wanted):
                if len(own):
                    best[k] = tree.search(own, weights, weight_of, best[k], top)
        rows = [(k, asked[k][0], None if none else doc, -score) for k, found in enumerate(best) for score, none, doc in found]
        for at in range(0, len(rows), SLICE_ROWS):
            part = list(zip(*rows[at : at + SLICE_ROWS], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, arrow, strict=True)], schema=arrow)

    return found.where(F.size("terms") > 0).mapInArrow(work, schema)


def tree_loads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Documents for one tree after another: ids, lengths, offsets, terms, tfs."""
    held: list[tuple] = []
    docs = size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            ids, n, ts, tfs = batch.slice(at, SLICE_ROWS).columns
            sizes = np.diff(ts.offsets.to_numpy())
            held.append((ids.to_pylist(), n.to_numpy(), sizes, ts.flatten().to_numpy(), tfs.flatten().to_numpy()))
            docs, size = docs + len(ids), size + int(sizes.sum())
            if docs >= TREE_DOCS or size >= TREE_TERMS:
                yield joined(held)
                held, docs, size = [], 0, 0
    if held:
        yield joined(held)


def joined(held: list[tuple]) -> tuple:
    ids, n, sizes, ts, tfs = zip(*held, strict=True)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    return [x for i in ids for x in i], np.concatenate(n), offsets, np.concatenate(ts), np.concatenate(tfs)


def blocks_of(items: DataFrame) -> Iterator[list[tuple]]:
    """Items (id, terms) in blocks of a bounded size; a longer text is a block of its own."""
    block, size = [], 0
    for item, text in items.toLocalIterator():
        if block and (len(block) == ITEMS or size + len(text or "") > CHARS):
            yield block
            block, size = [], 0
        block.append((item, terms_of(text)))
        size += len(text or "")
    if block:
        yield block


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    item_text_col: str = "text",
) -> DataFrame:
    """``item_col``, ``rank`` from 1, ``id_col`` and ``score`` of the ``top`` documents of each item whose score is above 0."""
    item_field = StructField("item_id", items.schema[item_col].dataType)
    parts = []
    for block in blocks_of(items.select(item_col, item_text_col)):
        words = sorted({w for _, ts in block for w in ts})
        best = settle(best_of_tasks(settle(vectors(docs, words, id_col, text_col)), block, words, item_field, top))
        first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
        few = best.withColumn("place", F.row_number().over(Window.partitionBy("at", salt).orderBy(*first))).where(F.col("place") <= top)
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(*first))).where(F.col("rank") <= top)
        parts.append(ranked.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"))
    if not parts:
        kinds = StructType([StructField(item_col, item_field.dataType), StructField("rank", IntegerType()), StructField(id_col, docs.schema[id_col].dataType), StructField("score", LongType())])
        return docs.sparkSession.createDataFrame([], kinds)
    return reduce(DataFrame.unionByName, parts)


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
total AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM cut WHERE len(t) > 0),
held AS (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM cut),
counts AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM held SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY term, docs),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS part FROM counts JOIN weights USING (term), total),
scores AS (SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 10
"""

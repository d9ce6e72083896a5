"""Operator 4: SimHash near-duplicates by a Gray-order hierarchical index.

Equal fingerprints are one class, so copies never meet in pairs. Two classes at ``distance`` or
fewer differing bits agree on ``m - distance`` of ``m`` blocks of bits; each class goes to one
bucket for every such choice of blocks, and ``m`` grows with the number of classes so that
buckets stay small. In a bucket the fingerprints are sorted by Gray rank, so neighbours share
most bits. Eight neighbours form a node that keeps the bits on which all agree; eight nodes form
an upper node. The search walks pairs of nodes from the top, adds up differences in the bits that
are newly fixed at each level, and drops a pair, with all that lies below, once they exceed the
distance. A bucket of many rows has the upper levels of its tree as tables: chunks of neighbours in
Gray order and nodes over 64 chunks, whose pairs are dropped in the same way before any row is copied. Each bucket hands on a spanning forest of the links that it found, never all pairs, and
components follow by star contraction.

Defined results: a null text counts as empty, and an empty text has fingerprint zero and links
like any other; texts of any length count whole; rows of one id are separate rows; a component's id
is its smallest id that is not null (null if it has none); an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import map_texts, settle, table

WORDS = 4
DISTANCE = 4
SEED = 42
#: Children of an index node.
FAN = 8
#: Rows of a bucket beyond which its Gray index is spread over tasks, in chunks of half this size.
BUCKET_ROWS = 2048
#: Classes for each bucket up to which a number of blocks is kept.
CLASSES_A_BUCKET = 256
#: Pairs of rows that a task compares at once at most (a single bucket may exceed it).
PAIRS_AT_ONCE = 4_000_000
#: Shingles hashed at once.
SHINGLES_AT_ONCE = 1 << 16
#: Rows of a table of hot buckets or index nodes that may be sent to every executor.
BROADCAST_ROWS = 100_000
#: Ids of dropped rows that may be sent to every executor.
BROADCAST_IDS = 1_000_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a text, as an unsigned number."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    starts = list(accumulate([len(w) + 1 for w in tokens], initial=0))
    n = max(1, len(tokens) - words + 1)
    ends = [starts[min(i + words, len(tokens))] - 1 for i in (range(n) if n == 1 else ())] or [e - 1 for e in starts[words:]]
    digest, sums = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = zip(starts[at : min(n, at + SHINGLES_AT_ONCE)], ends[at : at + SHINGLES_AT_ONCE], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], ">u8")
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed bigint, of each row."""

    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_texts(df, "fp bigint", make, id_col, text_col)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in Gray order: the prefix parity of its bits."""
    out = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def close_pairs(fps: np.ndarray, bucket: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j), i < j, of rows in one bucket at ``distance`` or fewer bits.

    Rows come sorted by bucket and, in a bucket, by Gray rank.
    """
    levels = []
    pattern, shared, group = fps, np.full(len(fps), ~np.uint64(0)), bucket
    while True:
        levels.append((pattern, shared))
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, len(group)])
        if size.max() == 1:
            break
        place = np.arange(len(group)) - np.repeat(first, size)
        heads = np.flatnonzero(place % FAN == 0)
        ones = np.bitwise_and.reduceat(pattern | ~shared, heads)
        zeros = np.bitwise_and.reduceat(~pattern | ~shared, heads)
        known = np.bitwise_and.reduceat(shared, heads)
        shared = (ones | zeros) & known
        pattern, group = ones & shared, group[heads]
        levels.append(np.r_[heads, len(place)])
    left = right = np.arange(len(group))
    used, gone = np.zeros(len(left), np.uint64), np.zeros(len(left), np.int64)
    while True:
        pattern, shared = levels.pop()
        fixed = shared[left] & shared[right]
        gone = gone + np.bitwise_count((pattern[left] ^ pattern[right]) & fixed & ~used)
        keep = gone <= distance
        left, right, used, gone = left[keep], right[keep], fixed[keep], gone[keep]
        if not levels:
            apart = left != right
            return left[apart], right[apart]
        heads = levels.pop()
        wide_l, wide_r = heads[left + 1] - heads[left], heads[right + 1] - heads[right]
        count = wide_l * wide_r
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        across = np.repeat(wide_r, count)
        below_l, below_r = np.repeat(heads[left], count) + k // across, np.repeat(heads[right], count) + k % across
        ordered = below_l <= below_r
        left, right = below_l[ordered], below_r[ordered]
        used, gone = np.repeat(used, count)[ordered], np.repeat(gone, count)[ordered]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the first row of its component under the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _link_batches(distance: int):
    """A function of batches sorted by bucket that gives its links; a bucket may go over several batches."""

    def search(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        change = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
        bucket = np.cumsum(change) - 1
        order = np.lexsort((gray_rank(fps), bucket))
        fps, size = fps[order], np.bincount(bucket)
        src, dst = [], []
        cost = np.cumsum(size.astype(np.int64) ** 2) // PAIRS_AT_ONCE
        ends = np.cumsum(size)
        for block in np.unique(cost):
            mine = np.flatnonzero(cost == block)
            a, b = ends[mine[0]] - size[mine[0]], ends[mine[-1]]
            i, j = close_pairs(fps[a:b], bucket[a:b], distance)
            label = forest(b - a, i, j)
            child = np.flatnonzero(label != np.arange(b - a))
            src.append(fps[a:b][label[child]])
            dst.append(fps[a:b][child])
        cols = [np.concatenate(x).view(np.int64) for x in (src, dst)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys = np.concatenate([keys, np.stack(cols[:3], 1).astype(np.int64)])
            fps = np.concatenate([fps, cols[3].astype(np.int64).view(np.uint64)])
            last = np.flatnonzero((keys != keys[-1]).any(1)) if len(keys) else []
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield search(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(fps):
            yield search(keys, fps)

    return run


def masks(classes: int, distance: int = DISTANCE) -> list[int]:
    """Bit masks of the choices of blocks on which two close fingerprints must agree for one choice at least."""
    m = distance + 1
    while classes > CLASSES_A_BUCKET << (64 * (m - distance) // m) and m < distance + 4:
        m += 1
    edges = [64 * k // m for k in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) - (sum(c) >> 63 << 64) for c in combinations(blocks, m - distance)]


def _gray_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their Gray rank, as a signed number."""
    for batch in batches:
        fps = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gray_rank(fps).view(np.int64))], names=["k", "v", "fp", "gray"])


def _chunk_batches(chunk_rows: int):
    """A function of batches sorted by bucket and Gray rank that numbers chunks of neighbours in one bucket."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        last, chunk, held = None, -1, 0
        for batch in batches:
            k, v = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            out = np.empty(len(k), np.int64)
            at = 0
            while at < len(k):
                if last != (k[at], v[at]) or held == chunk_rows:
                    last, chunk, held = (k[at], v[at]), chunk + 1, 0
                other = np.flatnonzero((k[at:] != k[at]) | (v[at:] != v[at]))
                n = min(int(other[0]) if len(other) else len(k) - at, chunk_rows - held)
                out[at : at + n] = base + chunk
                at, held = at + n, held + n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), batch.column(2)], names=["k", "v", "chunk", "fp"])

    return number


def _nodes(rows: DataFrame, name: str) -> DataFrame:
    """One row for each node ``name``: the bits on which all fingerprints below it agree, and which bits these are."""
    found = rows.groupBy("k", "v", name).agg(F.bit_and("ones").alias("ones"), F.bit_or("any").alias("any"))
    return settle(found)


def _near_nodes(nodes: DataFrame, name: str, distance: int, within: DataFrame | None = None) -> DataFrame:
    """``a``, ``b``: pairs of nodes of one bucket whose shared bits differ in ``distance`` places at most."""
    left = nodes.select("k", "v", *(F.col(c).alias(f"{c}_a") for c in nodes.columns if c not in ("k", "v")))
    right = nodes.select("k", "v", *(F.col(c).alias(f"{c}_b") for c in nodes.columns if c not in ("k", "v")))
    fixed = F.bitwise_not(F.col("ones_a").bitwiseXOR(F.col("any_a"))).bitwiseAND(F.bitwise_not(F.col("ones_b").bitwiseXOR(F.col("any_b"))))
    near = F.bit_count(F.col("ones_a").bitwiseXOR(F.col("ones_b")).bitwiseAND(fixed)) <= distance
    ordered = F.col(f"{name}_a") <= F.col(f"{name}_b")
    if within is None:
        met = left.join(right.hint("broadcast" if nodes.count() <= BROADCAST_ROWS else "merge"), ["k", "v"])
    else:
        met = left.join(within.hint("merge"), F.col("upper_a") == F.col("up_a")).drop("k", "v").join(right.drop("k", "v").hint("merge"), F.col("upper_b") == F.col("up_b"))
    return met.where(ordered & near).select(F.col(f"{name}_a").alias("a"), F.col(f"{name}_b").alias("b"))


def _hot_links(hot: DataFrame, distance: int) -> DataFrame:
    """Links inside buckets of many rows, through the Gray index over the whole bucket.

    Neighbours in Gray order form chunks, and neighbouring chunks upper nodes. Pairs of upper nodes whose shared bits
    differ too much go with all that lies below; then so do pairs of chunks. Rows are copied for the pairs that are left.
    """
    ranked = hot.mapInArrow(_gray_batches, "k bigint, v bigint, fp bigint, gray bigint")
    ordered = ranked.repartitionByRange("k", "v", "gray").sortWithinPartitions("k", "v", "gray").select("k", "v", "fp")
    rows = settle(ordered.mapInArrow(_chunk_batches(max(2, BUCKET_ROWS // 2)), "k bigint, v bigint, chunk bigint, fp bigint"))
    chunks = _nodes(rows.withColumns({"ones": F.col("fp"), "any": F.col("fp")}), "chunk")
    chunks = chunks.withColumn("upper", F.shiftright("chunk", 6))
    # a node over chunks of two buckets is told apart by its bucket
    uppers = _nodes(chunks, "upper").withColumn("up", F.xxhash64("k", "v", "upper"))
    chunks = chunks.withColumn("upper", F.xxhash64("k", "v", "upper"))
    wide = settle(_near_nodes(uppers.drop("upper"), "up", distance).withColumnsRenamed({"a": "up_a", "b": "up_b"}))
    # pairs of upper nodes come in one order of their names, those of their chunks in any
    both = wide.union(wide.where("up_a <> up_b").select("up_b", "up_a"))
    pairs = settle(_near_nodes(chunks, "chunk", distance, both).distinct())
    mine = rows.select("chunk", "fp")
    placed = mine.join(pairs.hint("merge"), F.col("chunk") == F.col("a")).select("a", "b", "fp").union(
        mine.join(pairs.where("a <> b").hint("merge"), F.col("chunk") == F.col("b")).select("a", "b", "fp")
    )
    dealt = placed.select("a", "b", F.lit(0).cast("bigint").alias("pair"), "fp").repartition("a", "b").sortWithinPartitions("a", "b")
    return dealt.mapInArrow(_link_batches(distance), "src bigint, dst bigint")


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``src``, ``dst``: links that connect the distinct fingerprints of column ``fp`` as all close pairs would."""
    chosen = masks(classes.count(), distance)
    keyed = classes.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(chosen)))).alias("b")
    ).select("fp", "b.k", "b.v")
    hot = settle(keyed.groupBy("k", "v").agg(F.count("*").alias("rows")).where(F.col("rows") > BUCKET_ROWS).select("k", "v"))
    n_hot = hot.count()
    mark = hot.hint("broadcast" if n_hot <= BROADCAST_ROWS else "merge")
    cool = keyed.join(mark, ["k", "v"], "left_anti") if n_hot else keyed
    dealt = cool.select("k", "v", F.lit(0).cast("bigint").alias("pair"), "fp").repartition("k", "v").sortWithinPartitions("k", "v")
    found = dealt.mapInArrow(_link_batches(distance), "src bigint, dst bigint")
    if n_hot:
        found = found.union(_hot_links(keyed.join(mark, ["k", "v"], "left_semi").select("k", "v", "fp"), distance))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: each linked node but the roots, with the smallest node of its component.

    Star contraction: link every neighbour that is larger to the least neighbour, then every
    smaller one, until only stars are left. Rounds grow with the logarithm of the component's size;
    each is one job that writes its edges.
    """

    def star(e: DataFrame, below: bool) -> DataFrame:
        """Edges (src < dst) after each node has met its least neighbour (``below``: of those smaller than itself)."""
        near = e.select(F.col("dst").alias("u"), F.col("src").alias("v"))
        if not below:
            near = near.union(e.select(F.col("src").alias("u"), F.col("dst").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("m", "u").alias("m"))
        met = near.join(least, F.col("u") == F.col("of"))
        if below:
            # a node's edge to its least neighbour stays; the others go there too
            made = met.select(F.col("m").alias("src"), F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("dst"))
        else:
            made = met.where("v > u").select(F.col("m").alias("src"), F.col("v").alias("dst"))
        return made.where("src <> dst")

    def stars(e: DataFrame) -> bool:
        """Whether each node is either a root or linked to one root alone."""
        ends = e.select(F.col("dst").alias("u"), F.lit(1).alias("tail"), F.lit(0).alias("head")).union(e.select(F.col("src").alias("u"), F.lit(0).alias("tail"), F.lit(1).alias("head")))
        return ends.groupBy("u").agg(F.sum("tail").alias("tails"), F.max("head").alias("heads")).where("tails > 1 or (tails = 1 and heads = 1)").isEmpty()

    edges = settle(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    while not stars(edges):
        edges = settle(star(star(edges, False).distinct(), True).distinct())
    return edges.select(F.col("dst").alias("node"), F.col("src").alias("root"))


def near_duplicates(df: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (smallest id that links reach) of each row."""
    rows = settle(fingerprints(df, id_col, text_col))
    classes = settle(rows.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = settle(components(links(classes, distance)))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = settle(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = settle(rooted.join(ids, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is their component's, one of each; rows with a null id stay."""
    return keep_first(df, near_duplicates(df, distance, id_col, text_col), id_col)


def keep_first(df: DataFrame, named: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is the ``component_id`` that ``named`` has for it, one of each; rows with a null id stay."""
    of_id = named.groupBy(F.col(id_col).alias("gone_id")).agg(F.max(F.col(id_col) != F.col("component_id")).alias("gone"), F.count("*").alias("rows"))
    told = settle(of_id.where("gone or rows > 1").select("gone_id", "gone"))
    n = told.count()
    told = told.hint("broadcast" if n <= BROADCAST_IDS else "merge")
    kept = df.join(told.where("gone"), df[id_col] == told["gone_id"], "left_anti")
    if told.where("not gone and gone_id is not null").isEmpty():
        return kept
    few = told.where("not gone")
    single = kept.join(few, kept[id_col] == few["gone_id"], "left_anti")
    row = F.struct(*(F.col(c) for c in kept.columns))
    one = kept.join(few, kept[id_col] == few["gone_id"], "left_semi").groupBy(id_col).agg(F.min(row).alias("_row")).select("_row.*")
    return single.unionByName(one)

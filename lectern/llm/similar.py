"""Near copies by exact similarity of their shingles, for the pipeline.

The shingles of a text are its distinct runs of five words. Two texts whose sets have a Jaccard
similarity of 0.8 or more share one of the first fifth (and one) of their shingles in any order of
all shingles, so texts that meet in a bucket of these are all candidates there are. In the order
used, shingles that are common in a sample of the texts come last, which keeps buckets small. Of the first
shingle that two texts share, its place tells how many more they can share at most; a pair for which that is not
enough is no candidate of the bucket.

Each candidate is held against the shingles of both texts, which are read again for these alone. Equal sets are one class. A first round
tries a few partners of each class, a second one partner in each bucket that the first has not
connected it with, and the last round all pairs of a bucket that are not connected then, so that a
large group of near copies doesn't meet in pairs. A bucket of more than ``BUCKET_ROWS`` classes is dealt
into parts, every two of which meet in a bucket of their own, so no task holds more than two parts
of one bucket. Pairs whose sketches show that they differ too
much are left out before any text is read; long texts, which fill a sketch, have tallies besides. Components follow by
star contraction.

Defined results: a null text counts as empty; empty texts are copies of each other; a text of
fewer than five words is one shingle; texts of any length count whole; rows with a null id stay;
an empty table gives an empty one; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import forget, map_texts, settle
from lectern.llm.simhash import components, keep_first

WORDS = 5
#: Texts sampled for common shingles, the texts of these that a common one is in, and how many are kept.
SAMPLE_ROWS, COMMON_ROWS, MAX_COMMON = 10_000, 4, 500_000
#: Partners of a class that the first round tries, and partners in each bucket that each later round tries (None: all).
PARTNERS, LATER = 12, (1, None)
#: Pairs handed on at once.
PAIRS_AT_ONCE = 1 << 18
SEED = 42
#: Words of 64 bits in the sketch that bounds how much two sets differ.
SKETCH = 16
#: Members from which a set has a tally too, and places of a tally.
LONG, TALLY = 1500, 1024
#: Members of a bucket that are looked at one by one for a partner.
SMALL_BUCKET = 8
#: Classes of a bucket that one task holds at once; larger buckets are dealt into parts of about that size.
BUCKET_ROWS = 1 << 16
#: Large buckets that are told to every task at once; beyond that the table of these is joined by sorting.
BROADCAST_ROWS = 100_000
#: Classes whose texts are read again up to which their marks are sent to every task; beyond that texts and marks are joined by sorting.
SENT_MARKS = 5_000_000


def hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles, repeats included, in order."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    starts = list(accumulate((len(w) + 1 for w in tokens), initial=0))
    ends = [end - 1 for end in starts[words:] or starts[-1:]]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends)), repeat(SEED)), np.uint64, len(ends))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    return np.unique(hashes(text, words))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which any similar set shares one; common ones come last."""
    n = len(found)
    if n and len(common):
        hit = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.r_[found[~hit], found[hit]]
    return found[: n - (4 * n + 4) // 5 + 1] if n else found


def sketch(found: np.ndarray) -> bytes:
    """The parity of the set's members at each of 64 * ``SKETCH`` places.

    Where the sketches of two sets differ, one set has a member that the other lacks, so they differ in as many members
    at least.
    """
    places = (found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (64 * SKETCH).bit_length() + 1)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1).tobytes()


def tally(found: np.ndarray) -> bytes | None:
    """How many members of a long set are at each of ``TALLY`` places, modulo 256.

    Where the tallies of two sets differ by d, at least d members are in one of them only.
    """
    if len(found) < LONG:
        return None
    places = (found * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TALLY.bit_length() + 1)
    return np.bincount(places.astype(np.int64), minlength=TALLY).astype(np.uint8).tobytes()


def can_meet(m: np.ndarray, i: np.ndarray, n: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of sizes m and n may be similar if the first member that they share is at place i of one and j of the other.

    No more than ``m - i`` and ``n - j`` members can be shared, and 4/9 of all must be.
    """
    return 9 * np.minimum(m - i, n - j) >= 4 * (m + n)


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def common_shingles(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Shingles that several texts of a sample have, sorted."""
    texts = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    share = SAMPLE_ROWS / max(SAMPLE_ROWS, df.count())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["s"])

    # equal texts have one hash, so all copies of a text are in the sample or none, and count once
    chosen = texts.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))).groupBy("h").agg(F.first("text").alias("text")).select("text")
    counted = chosen.mapInArrow(spread, "s bigint").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_ROWS)
    return np.sort(np.array([r["s"] for r in counted.orderBy(F.desc("n"), "s").limit(MAX_COMMON).collect()], np.int64).view(np.uint64))


def _array(col: pa.Array) -> np.ndarray:
    """A column of numbers, or of sketches as one row each."""
    if pa.types.is_binary(col.type):
        return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, SKETCH)
    return col.to_numpy(zero_copy_only=False).astype(np.int64)


def _in_buckets(work: Callable[..., Iterator[list[np.ndarray]]], names: list[str], piece: int | None = None) -> Callable:
    """A function of record batches sorted by their first column, which gives ``work`` whole buckets.

    With ``piece``, a bucket of twice as many rows and more is handed on in pieces of at least so many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def made(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for out in work(*cols):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

        for batch in batches:
            new = [_array(c) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            other = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else []
            if len(other):
                cut = other[-1] + 1
                yield from made([c[:cut] for c in held])
                held = [c[cut:] for c in held]
            while piece and len(held[0]) >= 2 * piece:
                yield from made([c[:piece] for c in held])
                held = [c[piece:] for c in held]
        if held and len(held[0]):
            yield from made(held)

    return run


def _shared(p: np.ndarray, key: np.ndarray, n: np.ndarray, i: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The rows of buckets of more than one class that can meet another one, each with the bucket's centre (itself where that is too long or short)."""
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    size = np.diff(np.r_[first, len(p)])
    mixed = (key ^ p).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((mixed, p))
    centre = np.repeat(order[first], size)
    # sizes are enough for a try that connects what is alike
    near = (5 * n >= 4 * n[centre]) & (4 * n <= 5 * n[centre])
    keep = np.repeat(size > SMALL_BUCKET, size)
    for far in range(1, min(SMALL_BUCKET, len(p))):
        meet = (p[far:] == p[:-far]) & can_meet(n[far:], i[far:], n[:-far], i[:-far])
        keep[far:] |= meet
        keep[:-far] |= meet
    yield [p[keep], key[keep], n[keep], i[keep], np.where(near, key[centre], key)[keep]]


def _dealt(placed: DataFrame, sizes: DataFrame, all_parts: bool) -> DataFrame:
    """``placed`` with the buckets in ``sizes`` (``p, size``) dealt into parts by their classes.

    A part is a bucket of its own, and with ``all_parts`` so are every two parts. ``part`` is a row's part where two
    meet, and -1 where all rows of the bucket may pair.
    """
    rows = placed.join(sizes.hint("broadcast" if sizes.count() <= BROADCAST_ROWS else "merge"), "p", "left")
    parts = F.ceil(F.col("size") / BUCKET_ROWS).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key", "p"), parts).cast("int"))
    others = F.sequence(F.lit(0), parts - 1) if all_parts else F.array("own")
    met = rows.withColumn("other", F.explode_outer(F.when(F.col("size").isNotNull(), others)))
    bucket = F.when(F.col("size").isNull(), F.col("p")).otherwise(F.xxhash64("p", F.least("own", "other"), F.greatest("own", "other")))
    part = F.when(F.col("size").isNull() | (F.col("own") == F.col("other")), F.lit(-1)).otherwise(F.col("own"))
    return met.select(bucket.alias("p"), "key", "n", "i", "root", part.alias("part"), "bits")


def _apart(p: np.ndarray, key: np.ndarray, n: np.ndarray, i: np.ndarray, root: np.ndarray, part: np.ndarray, bits: np.ndarray, most: int | None = None) -> Iterator[list[np.ndarray]]:
    """Pairs of a bucket's classes of different roots whose sizes, places and sketches allow them to be similar (``most``: so many of each class).

    Classes of one part (if not -1) pair in another bucket.

    Sets of sizes m and n with a similarity of 0.8 differ in (m + n) / 9 members at most.
    """
    src: list[np.ndarray] = []
    dst: list[np.ndarray] = []
    held = 0
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    for a, b in zip(first, np.r_[first[1:], len(p)], strict=True):
        roots, group, size = np.unique(root[a:b], return_inverse=True, return_counts=True)
        if len(roots) == 1:
            continue
        # the largest group comes last, so that its members are met by others only
        place = np.empty(len(roots), np.int64)
        place[np.argsort(size, kind="stable")] = np.arange(len(roots))
        order = np.lexsort((n[a:b], place[group]))
        k, m, q, g, o, s = key[a:b][order], n[a:b][order], i[a:b][order], place[group][order], part[a:b][order], bits[a:b][order]
        after = np.searchsorted(g, g, side="right")
        for x in range(int(after[after < len(g)].max(initial=0))):
            others = m[after[x] :]
            # the last round looks for what is left in the bucket of the first shared member only; before it any bucket will do
            fits = can_meet(others, q[after[x] :], m[x], q[x]) if most is None else (5 * others >= 4 * m[x]) & (4 * others <= 5 * m[x])
            if o[x] >= 0:
                fits &= o[after[x] :] != o[x]
            at = after[x] + np.flatnonzero(fits)
            at = at[9 * np.bitwise_count(s[at] ^ s[x]).sum(1, dtype=np.int64) <= m[at] + m[x]][:most]
            src.append(np.minimum(k[x], k[at]))
            dst.append(np.maximum(k[x], k[at]))
            held += len(at)
            if held >= PAIRS_AT_ONCE:
                yield list(np.unique(np.stack([np.concatenate(src), np.concatenate(dst)]), axis=1))
                src, dst, held = [], [], 0
    if held:
        yield list(np.unique(np.stack([np.concatenate(src), np.concatenate(dst)]), axis=1))


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and sketches allow them to be similar."""
    for batch in batches:
        n, m, a, b = (_array(c) for c in batch.columns[2:])
        good = 9 * np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= n + m
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose tallies, if both have one, allow them to be similar."""
    for batch in batches:
        good = []
        for n, m, a, b in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            if a is not None and b is not None:
                apart = np.frombuffer(a, np.uint8) - np.frombuffer(b, np.uint8)
                good.append(9 * int(np.minimum(apart, -apart).sum(dtype=np.int64)) <= n + m)
            else:
                good.append(True)
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, mark, text`` of each row; the mark tells rows of different ids or texts apart."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("id", F.xxhash64("id", "text").alias("mark"), "text")


def _texts_of(keys: DataFrame, classes: DataFrame, marked: DataFrame) -> DataFrame:
    """``key`` and ``text`` of those classes (``key, mark`` of one of its rows) whose key is in ``keys``."""
    wanted = settle(classes.select("key", "mark").join(keys.hint("merge"), "key", "left_semi"))
    sent = wanted.hint("broadcast" if wanted.count() <= SENT_MARKS else "merge")
    found = settle(marked.select("mark", "text").join(sent, "mark").groupBy("key").agg(F.first("text").alias("text")))
    forget(wanted)
    return found


def _verified(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], tallies: DataFrame) -> DataFrame:
    """Those of the pairs ``src``, ``dst`` of classes that are similar, by the shingles of their texts.

    Pairs of long texts are held against their ``tallies`` (``key, n, tally``) first. ``texts_of`` gives ``key, text``
    of a table of keys; it is asked for what the pairs need alone.
    """
    a = tallies.withColumnsRenamed({"key": "src", "n": "n", "tally": "tally"}).hint("merge")
    b = tallies.withColumnsRenamed({"key": "dst", "n": "m", "tally": "other"}).hint("merge")
    both = pairs.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "n", "m", "tally", "other")
    pairs = settle(both.mapInArrow(_tallied, "src bigint, dst bigint"))
    texts = texts_of(pairs.select(F.col("src").alias("key")).union(pairs.select("dst")).distinct())
    left = texts.select(F.col("key").alias("src"), F.col("text").alias("src_text")).hint("merge")
    right = texts.select(F.col("key").alias("dst"), F.col("text").alias("dst_text")).hint("merge")
    both = pairs.join(left, "src").join(right, "dst").select("src", "dst", "src_text", "dst_text").sortWithinPartitions("src")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(key: int, text: str) -> np.ndarray:
            if key not in kept:
                if len(kept) >= 1000:
                    kept.clear()
                kept[key] = shingles(text)
            return kept[key]

        for batch in batches:
            good = [similar(of(a, t), of(b, u)) for a, b, t, u in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield batch.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    good = settle(both.mapInArrow(check, "src bigint, dst bigint"))
    forget(pairs, texts)
    return good


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node``, ``root`` after more ``links``; only what these connect is contracted again."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")).hint("merge")
    met = links.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    new = settle(components(met.select(F.coalesce("src_root", "src").alias("src"), F.coalesce("dst_root", "dst").alias("dst"))))
    # nodes of ``new`` are roots or were alone, so none of them is a node of ``roots``
    to = new.select(F.col("node").alias("root"), F.col("root").alias("to")).hint("merge")
    return roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")).union(new)


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``component_id`` (smallest id that similar texts reach) of each row."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(common_shingles(df, text_col))

    def make():
        common = sent.value

        def run(texts):
            found = [shingles(t) for t in texts]
            keys = np.array([_key(s) for s in found], np.uint64).view(np.int64)
            return [keys, [len(s) for s in found], [prefix(s, common).view(np.int64) for s in found], [sketch(s) for s in found], [tally(s) for s in found]]

        return run

    marked = _marked(df, id_col, text_col)
    held = marked.select(F.struct("id", "mark").alias("row"), "text")
    full = settle(map_texts(held, "key bigint, n bigint, prefix array<bigint>, bits binary, tally binary", make, "row", "text"))
    rows = settle(full.select(F.col("row.id").alias(id_col), "key"))
    one = F.first(F.struct("row.mark", "n", "prefix", "bits", "tally")).alias("one")
    wide = settle(full.groupBy("key").agg(F.min("row.id").alias("least_id"), one).select("key", "least_id", "one.*"))
    forget(full)
    posted = wide.select(F.posexplode("prefix").alias("i", "p"), "key", F.col("n").cast("int").alias("n")).select("p", "key", "n", "i").repartition("p").sortWithinPartitions("p")
    shared = settle(posted.mapInArrow(_in_buckets(_shared, ["p", "key", "n", "i", "centre"], BUCKET_ROWS), "p bigint, key bigint, n bigint, i bigint, centre bigint"))
    tallies = settle(wide.where("tally is not null").select("key", "n", "tally"))
    classes = settle(wide.select("key", "least_id", "mark", "n", "bits"))
    forget(wide)
    texts_of = partial(_texts_of, classes=classes, marked=marked)

    # of a class's centres those that the sketches allow, so that the few partners tried are likely to be similar
    met_centres = settle(shared.where("key <> centre").select("key", "centre").distinct())
    sized = classes.select("key", "n", "bits")
    both = met_centres.join(sized.hint("merge"), "key").join(sized.withColumnsRenamed({"key": "centre", "n": "m", "bits": "centre_bits"}).hint("merge"), "centre")
    likely = both.select("key", "centre", "n", "m", "bits", "centre_bits").mapInArrow(_allowed, "key bigint, centre bigint")
    few = likely.groupBy("key").agg(F.slice(F.sort_array(F.collect_set("centre")), 1, PARTNERS).alias("c")).select("key", F.explode("c").alias("c"))
    tried = settle(few.select(F.least("key", "c").alias("src"), F.greatest("key", "c").alias("dst")))
    roots = settle(components(_verified(tried, texts_of, tallies)))
    bits = classes.select(F.col("key").alias("node"), "bits")
    sizes = settle(shared.groupBy("p").agg(F.count("*").alias("size")).where(F.col("size") > BUCKET_ROWS))
    for most in LATER:
        known = bits.join(roots.hint("merge"), "node", "left")
        ours = shared.select("p", "key", F.col("n").cast("int").alias("n"), F.col("i").cast("int").alias("i"))
        placed = ours.join(known.hint("merge"), F.col("key") == F.col("node")).select("p", "key", "n", "i", F.coalesce("root", "key").alias("root"), "bits")
        placed = _dealt(placed, sizes, all_parts=most is None).repartition("p").sortWithinPartitions("p")
        pairs = placed.mapInArrow(_in_buckets(partial(_apart, most=most), ["src", "dst"]), "src bigint, dst bigint").distinct()
        new = settle(pairs.join(tried.hint("merge"), ["src", "dst"], "left_anti"))
        if new.isEmpty():
            continue
        links, tried = _verified(new, texts_of, tallies), tried.union(new)
        if not links.isEmpty():
            roots = settle(_joined(roots, links))

    rooted = classes.join(roots, F.col("key") == F.col("node"), "left").select("key", "least_id", F.coalesce("root", "key").alias("root"))
    ids = settle(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = settle(rooted.join(ids, "root").select("key", "component_id"))
    forget(shared, tallies, classes, met_centres)
    return rows.join(named, "key").select(id_col, "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is their component's, one of each; rows with a null id stay."""
    return keep_first(df, near_copies(df, id_col, text_col), id_col)

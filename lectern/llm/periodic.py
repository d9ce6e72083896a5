"""Operator 11: stretches of words that repeat with a period, found by online dyadic square catching.

Words arrive in a stream. For every power of two ``b`` the completed blocks of ``b`` words, cut at
multiples of ``b``, get a catcher each. A catcher waits for its block to come back ``2b - 1`` to
``4b - 2`` words later, which it sees by comparing the suffix of ``b`` words that each appended word
completes. Every period belongs to just one ``b``, and a stretch of four periods holds several
neighbouring blocks that come back at that distance; each such return is a square in the making.
Returns of neighbouring blocks at one distance merge into a run, which is then extended word by
word at both ends and held against the words themselves, so that equal hashes alone decide nothing.
A catcher inside a run of a period up to ``b`` is passed over: by the theorem of Fine and Wilf it
could find only multiples of that period.

``Catchers.append`` takes any number of words at once, one word or a million, with the same runs in
the end; catchers of one ``b`` are compared side by side. A batch of documents is one stream in
which a word of its own stands behind each document, so that no run crosses it.

Defined results: a null or empty text has no words and no runs, and its collapsed text is empty;
texts of any length are read whole; rows of one id are taken each on its own; an empty table gives
an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import map_texts, table

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Comparisons that are made at once, and bytes of text whose words are one stream.
AT_ONCE, STREAM_BYTES = 1 << 22, 1 << 23
WORDS = r"[^\x20\x09-\x0D]+"

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers for ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


class Level:
    """Catchers over blocks of ``b`` words."""

    def __init__(self, b: int) -> None:
        #: The words that were compared; and where ``ids`` begins.
        self.b, self.compared, self.base = b, 0, 0
        #: Hashes of the ``b`` words from ``base`` on; and returns not yet settled, as starts and distances.
        self.ids = np.zeros(0, np.uint64)
        self.starts, self.periods = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self, periods: np.ndarray) -> np.ndarray:
        """Neighbouring blocks that surely return in a run of a period."""
        same = np.maximum(LEAST_WORDS, LEAST_PERIODS * periods) - periods
        return np.maximum((same - self.b + 1) // self.b, 1)

    def grow(self, below: Level | None, words: np.ndarray) -> None:
        """Hashes of all suffixes that the appended words complete."""
        have, end = self.base + len(self.ids), len(words) - self.b + 1
        if below is None:
            new = mixed(words[have:end].astype(np.uint64) + _ODD)
        else:
            at, half = have - below.base, self.b // 2
            new = mixed(below.ids[at : at + end - have] * _ODD + below.ids[at + half : at + half + end - have])
        self.ids = np.concatenate([self.ids, new]) if len(self.ids) else new

    def catch(self, n: int, inside: tuple[np.ndarray, np.ndarray]) -> None:
        """Returns that end at the words up to ``n`` that were not compared before, but for those inside shorter runs."""
        b, width, before, self.compared = self.b, 2 * self.b, self.compared, n
        first, last = max(0, -((4 * b - 2 - (before - b + 1)) // b)), (n - 3 * b + 1) // b
        step = max(1, AT_ONCE // width)
        for at in range(first, last + 1, step):
            rows = np.arange(at, min(at + step, last + 1))
            lo = at * b + 2 * b - 1 - self.base
            need = (len(rows) - 1) * b + width
            part = self.ids[lo : lo + need]
            gone = need - len(part)
            if gone:
                part = np.concatenate([part, np.zeros(gone, np.uint64)])
            seen = np.lib.stride_tricks.sliding_window_view(part, width)[::b]
            row, far = np.nonzero(seen == self.ids[rows * b - self.base][:, None])
            if not len(row):
                continue
            starts, periods = rows[row] * b, far + width - 1
            ends = starts + periods + b
            new = (ends > before) & (ends <= n)
            if len(inside[0]):
                k = np.searchsorted(inside[0], starts, "right") - 1
                new &= (k < 0) | (inside[1][np.maximum(k, 0)] < ends)
            self.starts, self.periods = np.concatenate([self.starts, starts[new]]), np.concatenate([self.periods, periods[new]])

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring returns at one distance: first start, last start, period."""
        order = np.lexsort((self.starts, self.periods))
        self.starts, self.periods = self.starts[order], self.periods[order]
        cut = np.flatnonzero((np.diff(self.periods) != 0) | (np.diff(self.starts) != self.b)) + 1
        heads, tails = np.concatenate([[0], cut]), np.concatenate([cut, [len(order)]]) - 1
        return self.starts[heads], self.starts[tails], self.periods[heads]

    def settle(self, words: np.ndarray, last: bool) -> list[tuple[int, int, int]]:
        """Runs of the returns whose next block has been compared; ``last`` if no word will follow."""
        if not len(self.starts):
            return []
        b, (first, end, period) = self.b, self.groups()
        closed = np.full(len(first), True) if last else end + 2 * b + period <= len(words)
        runs: list[tuple[int, int, int]] = []
        for s, e, p in zip(*(x[closed & ((end - first) // b + 1 >= self.least(period))].tolist() for x in (first, end, period)), strict=True):
            runs += stretches(words, max(0, s - b), min(e + 2 * b, len(words) - p), p)
        if closed.all():
            self.starts, self.periods = self.starts[:0], self.periods[:0]
        else:
            keep = np.repeat(~closed, (end - first) // b + 1)
            self.starts, self.periods = self.starts[keep], self.periods[keep]
        return runs

    def open_runs(self) -> list[tuple[int, int, int]]:
        """What is known of runs whose end has not been seen."""
        if not len(self.starts):
            return []
        first, end, period = self.groups()
        long = (end - first) // self.b + 1 >= self.least(period)
        return list(zip(first[long].tolist(), (end + self.b + period)[long].tolist(), period[long].tolist(), strict=True))


def stretches(words: np.ndarray, lo: int, hi: int, p: int) -> list[tuple[int, int, int]]:
    """Runs of smallest period ``p`` among the words whose equals ``p`` later are sought from ``lo`` to ``hi``: start, end, period."""
    borders = np.concatenate([[lo - 1], np.flatnonzero(words[lo:hi] != words[lo + p : hi + p]) + lo, [hi]])
    long = np.flatnonzero(np.diff(borders) - 1 >= max(LEAST_WORDS, LEAST_PERIODS * p) - p)
    found = zip((borders[long] + 1).tolist(), (borders[long + 1] + p).tolist(), strict=True)
    return [(s, e, p) for s, e in found if not any((words[s : e - p // f] == words[s + p // f : e]).all() for f in prime_factors(p))]


def prime_factors(n: int) -> list[int]:
    found, f = [], 2
    while f * f <= n:
        if n % f == 0:
            found.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return found + [n] * (n > 1)


class Catchers:
    """Runs of a stream of word numbers. No run is sought in more words than ``longest``, if given."""

    def __init__(self, longest: int | None = None) -> None:
        self.longest = longest
        self.words = np.zeros(0, np.int64)
        self.levels: list[Level] = []
        self.runs: list[tuple[int, int, int]] = []

    def append(self, words: np.ndarray, last: bool = False) -> list[tuple[int, int, int]]:
        """The runs (start, end, period) that are known to have ended with these words; all, if none follow."""
        before = len(self.words)
        self.words = np.concatenate([self.words, words]) if before else np.asarray(words, np.int64)
        n, found, unended = len(self.words), [], []
        most = n if self.longest is None else min(n, self.longest)
        k, below = 0, None
        while (b := 1 << k) <= n and LEAST_PERIODS * (2 * b - 1) <= max(most, LEAST_WORDS):
            if k == len(self.levels):
                self.levels.append(Level(b))
            level = self.levels[k]
            level.grow(below, self.words)
            if below is not None:
                self.forget(below, n)
            if n >= 3 * b - 1:
                level.catch(n, self.inside(unended, b))
            done = level.settle(self.words, last)
            found += done
            self.runs += done
            if not last:
                unended += level.open_runs()
            k, below = k + 1, level
        if below is not None:
            self.forget(below, n)
        return found

    def inside(self, unended: list, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of runs of periods up to ``b``, and how far the runs up to each start reach."""
        known = sorted((s, e) for s, e, p in (*self.runs, *unended) if p <= b)
        if not known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, ends = np.array(known, np.int64).T
        return starts, np.maximum.accumulate(ends)

    @staticmethod
    def forget(level: Level, n: int) -> None:
        """Hashes that no catcher will look at again."""
        gone = max(0, (n - 16 * level.b - level.base) // level.b * level.b)
        if gone:
            level.ids, level.base = level.ids[gone:].copy(), level.base + gone


def runs_of(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """For each text its words and its runs (start, length, period), by start and period."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    coded = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
    codes, n_codes = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    # behind each text comes a word that occurs nowhere else
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    stream = np.empty(int(offsets[-1]), np.int64)
    stream[np.arange(len(codes)) + np.repeat(np.arange(len(texts)), sizes)] = codes
    stream[offsets[1:] - 1] = n_codes + np.arange(len(texts))
    found = sorted(Catchers(int(sizes.max(initial=0))).append(stream, last=True), key=lambda r: (r[0], r[2]))
    owner = np.searchsorted(offsets, [s for s, _, _ in found], "right") - 1
    own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (s, e, p) in zip(owner.tolist(), found, strict=True):
        own[k].append((s - int(offsets[k]), e - s, p))
    return zip(split, own, strict=True)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words but for those behind the first period of a run that holds them."""
    if not runs:
        return b" ".join(words).decode()
    kept = np.full(len(words), True)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(compress(words, kept.tolist())).decode()


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, the runs by start and period, and the text with every run cut to its first period."""

    def make():
        def work(texts: list) -> list:
            data, out, at = [(t or "").encode() for t in texts], [], 0
            while at < len(data):
                end, held = at + 1, len(data[at])
                while end < len(data) and held + len(data[end]) <= STREAM_BYTES:
                    held, end = held + len(data[end]), end + 1
                out += [(len(w), [{"start": s, "length": n, "period": p} for s, n, p in r], collapsed(w, r)) for w, r in runs_of(data[at:end])]
                at = end
            return list(zip(*out, strict=True)) if out else [()] * 3

        return work

    return map_texts(df, "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", make, id_col, text_col)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where a tenth of the texts repeats a stretch of its words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w")).withColumn("n", F.size("w").cast("long"))
    a = F.col("g") % F.col("n")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", at(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("longest"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    rows = found.withColumn("best", best).withColumn("longest", -F.col("best.longest"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("longest").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("longest") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

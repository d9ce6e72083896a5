"""Operator 2: language-model scores from subword lattices.

A word's spellings by pieces of an existing vocabulary form a lattice. The pieces' scores in the
model file weight all segmentations at first; rounds of expected counts over the distinct
words of the training documents turn them into the probabilities of this corpus. A forward
recursion in logarithms over all segmentations gives a word's marginal probability. On top, a
word that the training documents have counts for keeps them, with an absolute discount whose mass
goes to the lattice, as one more arc over the whole word. A text's score is the sum over its words
and its end.

The most frequent words (``HEAD_WORDS`` at most) are sent to every task; the other tokens meet their
words' scores in a join.

Defined results: a null or empty text has its end alone; texts of any length are scored whole; rows
of one id are scored on their own, and train each if their id does; a null id is a training id; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import settle, table
from lectern.llm.pieces import NORMAL, SPACE, _fields, model_bytes

FOLDS = 10
#: Rounds of expected counts; more change held-out scores by less than a hundredth of a digit a word.
ROUNDS = 2
#: Distinct words whose scores every task holds.
HEAD_WORDS = 200_000
#: Distinct words that a counting task holds before it hands on their counts.
HELD_WORDS = 300_000
#: Words that a scoring task takes side by side.
BLOCK_WORDS = 8192
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FLOOR = -1e30


class Pieces:
    """The surface forms of a vocabulary, their log probabilities, and those of bytes and of a word's end."""

    def __init__(self, forms: list[str], logs: np.ndarray, log_byte: float, log_end: float):
        self.forms, self.log_byte, self.log_end = forms, log_byte, log_end
        keys = np.array([self.key(f) for f in forms], np.uint64)
        self.order = np.argsort(keys)
        self.keys, self.logs = keys[self.order], np.asarray(logs, np.float64)[self.order]
        self.longest = max(map(len, forms))

    @staticmethod
    def key(form: str) -> int:
        value = 0
        for c in form:
            value = (value * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return value

    @classmethod
    def existing(cls, blob: bytes) -> Pieces:
        """The file's pieces without their space mark; their scores are ranks, read as a Zipf law."""
        weight: dict[str, float] = {}
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                if piece.get(3, NORMAL) == NORMAL and (form := piece[1].decode().replace(SPACE, "")):
                    rank = float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0
                    weight[form] = weight.get(form, 0.0) + 1 / (abs(rank) + 10)
        forms = sorted(weight)
        logs = np.log([weight[f] for f in forms])
        logs += math.log(0.7) - np.logaddexp.reduce(logs)
        return cls(forms, logs, math.log(0.01 / 256), math.log(0.29))

    def arcs(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length: the place of the arc over codes[:, i : i + length] (-1: none), and its log probability."""
        rows, n = codes.shape
        prefix, power = np.zeros((rows, n + 1), np.uint64), np.ones(n + 1, np.uint64)
        for k in range(n):
            prefix[:, k + 1] = prefix[:, k] * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
            power[k + 1 : k + 2] = power[k : k + 1] * _BASE
        out = []
        for size in range(1, min(n, self.longest) + 1):
            key = prefix[:, size:] - prefix[:, : n + 1 - size] * power[size]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            logs = np.where(found, self.logs[at], _FLOOR)
            if size == 1:
                # a character without a piece is spelled in bytes
                spelled = (1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)) * self.log_byte
                logs = np.where(found, logs, spelled)
            out.append((np.where(found, at, -1), logs))
        return out

    def forward(self, codes: np.ndarray, arcs: list) -> np.ndarray:
        rows, n = codes.shape
        alpha = np.full((rows, n + 1), _FLOOR)
        alpha[:, 0] = 0.0
        for j in range(1, n + 1):
            terms = np.stack([alpha[:, j - s] + arcs[s - 1][1][:, j - s] for s in range(1, min(j, len(arcs)) + 1)])
            top = terms.max(0)
            alpha[:, j] = top + np.log(np.exp(terms - top).sum(0))
        return alpha

    def scores(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability, its end included."""
        out = np.empty(len(words))
        for at, codes in blocks(words):
            out[at] = self.forward(codes, self.arcs(codes))[:, -1] + self.log_end
        return out

    def expected(self, words: list[str]) -> tuple[np.ndarray, float]:
        """Expected uses of each piece (in order of ``keys``) and of bytes, over all segmentations of each word."""
        counts, spelled = np.zeros(len(self.keys)), 0.0
        for _, codes in blocks(words):
            arcs = self.arcs(codes)
            alpha = self.forward(codes, arcs)
            rows, n = codes.shape
            beta = np.full((rows, n + 1), _FLOOR)
            beta[:, n] = 0.0
            for i in range(n - 1, -1, -1):
                terms = np.stack([beta[:, i + s] + arcs[s - 1][1][:, i] for s in range(1, min(n - i, len(arcs)) + 1)])
                top = terms.max(0)
                beta[:, i] = top + np.log(np.exp(terms - top).sum(0))
            for s, (at, logs) in enumerate(arcs, 1):
                share = np.exp(alpha[:, : n + 1 - s] + logs + beta[:, s:] - alpha[:, -1:])
                found = at >= 0
                counts += np.bincount(at[found], share[found], len(counts))
                if s == 1:
                    spelled += float(share[~found].sum())
        return counts, spelled

    def reweighted(self, counts: np.ndarray, spelled: float, words: float) -> Pieces:
        """The pieces with probabilities in proportion to expected uses, a tenth of a use added to each."""
        total = counts.sum() + 0.1 * len(counts) + spelled + 1 + words
        logs = np.empty(len(counts))
        logs[self.order] = np.log((counts + 0.1) / total)
        return Pieces(self.forms, logs, math.log((spelled + 1) / total / 256), math.log(max(words, 1e-9) / total))


def blocks(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time: where they stand, and their code points."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        for k in range(0, len(part), step := max(1, BLOCK_WORDS * 8 // max(8, int(sizes[part[0]])) if len(part) else 1)):
            at = part[k : k + step]
            codes = np.frombuffer("".join([words[i] for i in at.tolist()]).encode("utf-32-le"), np.uint32)
            yield at, codes.reshape(len(at), -1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def count_words(rows: DataFrame) -> DataFrame:
    """``word`` and ``c``, its count in training texts (0: seen in others only), from ``held_out`` and ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), set()

        def flush():
            for w in other:
                train.setdefault(w, 0)
            if train:
                yield pa.RecordBatch.from_arrays([pa.array(list(train), pa.binary()), pa.array(list(train.values()), pa.int64())], names=["word", "c"])
            train.clear()
            other.clear()

        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held:
                    other.update(_words(text))
                else:
                    train.update(_words(text))
                if len(train) + len(other) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def fit_pieces(words: DataFrame, pieces: Pieces) -> Pieces:
    """``pieces`` after one round over the distinct training words."""
    sent = words.sparkSession.sparkContext.broadcast(pieces)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        total, spelled, n = np.zeros(len(model.keys)), 0.0, 0
        for batch in batches:
            got = [w.decode() for w in batch.column(0).to_pylist()]
            counts, more = model.expected(got)
            total, spelled, n = total + counts, spelled + more, n + len(got)
        used = np.flatnonzero(total)
        place = np.r_[used, [-1, -2]]
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(np.r_[total[used], [spelled, n]], pa.float64())], names=["piece", "uses"])

    # one row for each piece of the vocabulary, so its size bounds what the driver gets
    got = words.where("c > 0").select("word").mapInArrow(expect, "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
    uses = dict(zip(got["piece"], got["uses"], strict=True))
    counts = np.array([uses.get(k, 0.0) for k in range(len(pieces.keys))])
    return pieces.reweighted(counts, uses.get(-1, 0.0), uses.get(-2, 0.0)) if uses.get(-2) else pieces


def word_scores(words: DataFrame, pieces: Pieces, totals: dict) -> DataFrame:
    """``word``, ``c``, ``base`` and ``lp``: log10 of the base rule and of the model for each word."""
    sent = words.sparkSession.sparkContext.broadcast(pieces)
    n_words, types, discount = totals["words"], totals["types"], totals["discount"]
    log_base = math.log10(totals["tokens"] + 0.1 * (totals["distinct"] + 1))
    log_word = math.log(totals["p_word"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            c = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            sub = model.scores([w.decode() for w in batch.column(0).to_pylist()])
            if n_words:
                arc = np.log(np.maximum(c - discount, 1e-300) / n_words)
                lp = np.where(c > 0, np.logaddexp(arc, math.log(discount * types / n_words) + sub), math.log(discount * types / n_words) + sub)
            else:
                lp = sub
            cols = [batch.column(0), batch.column(1), pa.array(np.log10(c + 0.1) - log_base), pa.array((lp + log_word) / math.log(10))]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "c", "base", "lp"])

    return words.mapInArrow(score, "word binary, c bigint, base double, lp double")


def score_texts(docs: DataFrame, path: str | None = None, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    words = settle(count_words(rows.select("held_out", "text")))
    got = words.agg(F.sum("c").alias("words"), F.expr("count_if(c > 0)").alias("types"), F.expr("count_if(c = 1)").alias("once"), F.expr("count_if(c = 2)").alias("twice")).first()
    ends = rows.where("not held_out").count()
    n_words, types = got["words"] or 0, got["types"] or 0
    once, twice = got["once"] or 0, got["twice"] or 0
    totals = {
        "words": n_words, "types": types, "tokens": n_words + ends, "distinct": types + (ends > 0),
        "discount": min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5,
        "p_word": (n_words + 1) / (n_words + ends + 2),
    }
    pieces = Pieces.existing(model_bytes(path))
    for _ in range(ROUNDS):
        pieces = fit_pieces(words, pieces)
    model = settle(word_scores(words, pieces, totals))
    # at most HEAD_WORDS rows come to the driver and go to the tasks: those of the highest steps of count that fit
    step = F.floor(F.log2("c") * 64)
    steps = sorted(((r["step"], r["n"]) for r in model.where("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, fit = 1 << 20, 0
    for at, n in steps:
        if (fit := fit + n) > HEAD_WORDS:
            break
        least = at
    head = model.where("c > 0").where(step >= least).select("word", "base", "lp").toPandas()
    sent = spark.sparkContext.broadcast((list(map(bytes, head["word"])), head["base"].to_numpy(), head["lp"].to_numpy()))
    end_base = math.log10(ends + 0.1) - math.log10(totals["tokens"] + 0.1 * (totals["distinct"] + 1))
    end_lp = math.log10(1 - totals["p_word"])
    end_known = int(ends > 0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, base, lp = sent.value
        place = {w: k for k, w in enumerate(listed)}.get
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[], [], [], [], []]
                for text in part.column(2).to_pylist():
                    tokens = _words(text)
                    places = [place(w, -1) for w in tokens]
                    known = np.array(places, np.int64)
                    known = known[known >= 0]
                    for col, x in zip(
                        cols,
                        (len(tokens) + 1, len(known) + end_known, base[known].sum() + end_base, lp[known].sum() + end_lp, [w for w, k in zip(tokens, places, strict=True) if k < 0]),
                        strict=True,
                    ):
                        col.append(x)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
                arrays = [part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "held_out", "n_tokens", "n_known", "base", "lp", "rare"])

    kind = dict(rows.dtypes)["id"]
    done = rows.mapInArrow(split, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, lp double, rare array<binary>")
    done = settle(done.withColumn("row", F.monotonically_increasing_id()))
    rare = done.select("row", F.explode("rare").alias("word"))
    joined = rare.join(model.hint("merge"), "word")
    sums = settle(joined.groupBy("row").agg(F.sum("base").alias("rare_base"), F.sum("lp").alias("rare_lp"), F.expr("count_if(c > 0)").alias("rare_known")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return done.drop("rare").join(sums.hint("merge"), "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(totals["tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("lp") + zero("rare_lp")).alias("score"),
    )


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))

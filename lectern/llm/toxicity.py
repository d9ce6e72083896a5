"""Operator 9: toxicity of texts whose words may be disguised.

A disguised word (digits or signs for letters, stretched letters, letters apart) becomes a lattice
of the characters that may have been meant. Viterbi decoding under a trigram character model, with
a cost for every step of disguise, restores the word; a word with a single reading restores to
itself. The restored text is scored by a log-linear model over its words, their beginnings and pairs
of neighbours: the logistic function of a bias and the weights of what occurs, none of them below zero.

Everything is learned from all labelled texts without the held-out fold. Near copies share one weight: a text counts as one over the number of texts of its
label that it shares a least shingle hash with, in the middle of ``SLOTS`` hash functions (a passage
that texts share has few of their least hashes). What occurs in
more toxic texts than chance allows gets a weight, by a fit with an L1 penalty. Texts are scored whole.

Defined results: a null or empty text gets the score of the bias alone; rows of one id are
scored on their own; labels that are null or of unknown ids are ignored; of labels that
contradict, the toxic one counts; without toxic or without clean labels no text is toxic; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Set
from functools import lru_cache
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import similar
from lectern.llm.common import forget, settle, table

#: Folds, and the one that is held out.
FOLDS, HELD_OUT = 5, 0
#: Rows of a narrow table up to which it is sent to every executor, and features that a task sums before it passes them on.
NARROW_ROWS, HELD = 5_000_000, 500_000
#: Letters of a word's beginnings, and texts that a feature's weight needs at least.
BEGINNINGS, LEAST_TEXTS = (4, 5, 6), 3.0
#: Features expected to pass by chance alone.
CHANCE = 0.05
#: Hash functions whose least values tell near copies.
SLOTS = 8
#: Score of a text of which nothing is known, the penalty of weights, and steps of the fit.
MISS, PENALTY, STEPS = 0.02, 0.05, 1000
#: Stretches with restored places that a task remembers, and the longest of them in characters.
KEPT, KEPT_CHARS = 30_000, 200

# What each sign or digit may stand for in disguised words.
MEANT = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i",
}
#: Signs that may stand between the letters of a word.
BETWEEN = " .-_*~"
#: Costs, as negative logarithms, of a replaced, a dropped and a kept odd character.
REPLACED, DROPPED, KEPT_ODD = 0.7, 0.4, 6.0
#: Costs of a sign that is the border of two words, besides the end of one and the start of the other. Each gives a
#: reading; below zero they make up for word ends, which are rarer among distinct words than in running text.
BORDERS = (0.4, -1.0, -2.0)

WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(MEANT))
#: Letters apart, a word with odd characters inside, or one with a letter three times in a row.
_PLACE = (
    rf"(?<![^\W\d_])[^\W\d_](?:[{re.escape(BETWEEN)}][\w{_SIGNS}](?![^\W\d_])){{3,}}"
    rf"|[{_SIGNS}]*+[^\W\d_]++[{_SIGNS}*._\-~][\w{_SIGNS}*._\-~]*[\w{_SIGNS}]"
    rf"|[{_SIGNS}]++[^\W\d_][\w{_SIGNS}*._\-~]*"
    r"|\w*(?P<thrice>[^\W\d_])(?P=thrice){2}\w*"
)
#: No place begins between two letters, as it would begin at the first of them then; so a word is read once, not from each of its letters.
_BORDER = r"(?:(?<![^\W\d_])|(?![^\W\d_]))"
DISGUISED = re.compile(f"{_BORDER}(?P<place>{_PLACE})")
#: For texts without a letter three times: plain words in a row are one match without a place, as no place begins in them.
DISGUISED_ONLY = re.compile(rf"{_BORDER}(?:(?:[^\W\d_]{{2,}}+(?:[^\w{_SIGNS}*._\-~]|\.[ \n]))++|(?P<place>{_PLACE}))")
#: A text without any of these has single readings only: a sign, a point between letters, a letter three times, letters apart.
#: Letters apart with a point are found by the points, so only blanks are left to search.
ODD_ASCII, ODD_OTHER = b"*_~-" + "".join(c for c in MEANT if c.isascii()).encode(), [c for c in MEANT if not c.isascii()]
ODD_POINT, TREBLED = re.compile(r"\.(?<=\w\.)\w"), re.compile(r"([^\W\d_])\1\1")
LONG_RUN = re.compile(r"(.)\1{3,}")
MAY_BE_APART, APART = re.compile(r" \w \w "), re.compile(r"(?<!\w)\w \w \w \w(?!\w)")
#: Letters apart, as in a place, and what those with a blank among them hold, which begins with a fixed sign and is searched fast.
_ONE, _NEXT = rf"[\w{_SIGNS}]", rf"[{re.escape(BETWEEN)}][\w{_SIGNS}]"
SPACED = re.compile(rf"(?<![^\W\d_])[^\W\d_](?:{_NEXT}(?![^\W\d_])){{3,}}")
MAY_BE_SPACED = re.compile(rf" (?:(?<={_ONE}[ ]){_ONE}{_NEXT}{_NEXT}|(?<={_ONE}{_NEXT}[ ]){_ONE}{_NEXT}|(?<={_ONE}{_NEXT}{_NEXT}[ ]){_ONE})(?![^\W\d_])")

# What replaces the ASCII characters that are no letters, and those that no place holds but as a blank.
_ASCII = bytes(range(128))
_LETTERS = bytes(k if k > 127 or chr(k).isalpha() else 32 for k in range(256))
_PLACES = bytes(k if k > 127 or chr(k).isalnum() or k in ODD_ASCII + b"." else 32 for k in range(256))


def blanked(text: str, table: bytes, keeps: Callable[[str], bool]) -> str:
    """``text`` with a blank for each character that ``table`` (ASCII) or ``keeps`` (others) doesn't keep."""
    units = text.encode("utf-8", "surrogatepass")
    if not text.isascii():
        others = units.translate(None, _ASCII).decode("utf-8", "surrogatepass")
        if not others.isalpha():  # letters are always kept
            gone = [c for c in set(others) if not keeps(c)]
            if gone:
                units = text.translate(dict.fromkeys(map(ord, gone), " ")).encode("utf-8", "surrogatepass")
    return units.translate(table).decode("utf-8", "surrogatepass")


def words_of(text: str) -> list[str]:
    """``WORD.findall(text)``, faster."""
    return blanked(text, _LETTERS, lambda c: c.isalnum() and not c.isdecimal()).split()


def stretches(text: str) -> list[str]:
    """The parts of a text between characters that no place holds; letters apart by blanks stay together. Each place is in one part."""
    spaced = blanked(text, _PLACES, lambda c: c.isalnum() or c in MEANT)
    apart = [m.span() for m in SPACED.finditer(text) if " " in m[0]] if MAY_BE_SPACED.search(text) else []
    if not apart:
        return spaced.split()
    pieces, at = [], 0
    for start, end in apart:
        pieces += [spaced[at:start], spaced[start:end].replace(" ", "\0")]
        at = end
    return [part.replace("\0", " ") for part in "".join([*pieces, spaced[at:]]).split()]


def thrice(text: str) -> np.ndarray:
    """The places from which a character comes three times in a row."""
    units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = units[1:] == units[:-1]
    return np.flatnonzero(same[1:] & same[:-1])


def trebled(text: str) -> bool:
    """Whether a text has a letter three times in a row."""
    return any(map(WORD.match, {text[k] for k in thrice(text).tolist()}))


def stretched(words: Iterable[str]) -> set[str]:
    """Those of ``words``, which are of letters, that have one three times in a row."""
    joined, out, end = " ".join(words), set(), -1
    for at in thrice(joined).tolist():
        if at > end:
            start, end = joined.rfind(" ", 0, at) + 1, joined.find(" ", at)
            end = len(joined) if end < 0 else end
            out.add(joined[start:end])
    return out


def odd(text: str) -> bool:
    """Whether a text may have more than one reading."""
    units = text.encode("utf-8", "surrogatepass")
    if len(units.translate(None, ODD_ASCII)) < len(units) or any(c in text for c in ODD_OTHER) or ODD_POINT.search(text):
        return True
    return bool(MAY_BE_APART.search(text) and APART.search(text)) or trebled(text)


class Model(NamedTuple):
    """Weights of features by name, the bias, and counts of character trigrams."""

    weights: dict[str, float]
    bias: float
    trigrams: dict[str, float]


def features(words: list[str]) -> set[str]:
    """The features of a text: whole words (after ``=``), their beginnings, and pairs of neighbours with a blank between."""
    whole = set(words)
    out = {"=" + w for w in whole}
    out.update(w[:n] for w in whole for n in BEGINNINGS if len(w) >= n)
    out.update(map(" ".join, zip(words, words[1:])))
    return out


def finder(wanted: Set[str]) -> Callable[[str], set[str]]:
    """A function: those of a text's features that are ``wanted``, without making the others."""
    seconds: dict[str, dict[str, str]] = defaultdict(dict)
    for f in wanted:
        if " " in f:
            first, second = f.split(" ", 1)
            seconds[first][second] = f
    seconds, full = dict(seconds), {f[1:]: f for f in wanted if f[0] == "="}
    begins = {n: {f for f in wanted if len(f) == n and f[0] != "=" and " " not in f} for n in BEGINNINGS}
    short = {f[: BEGINNINGS[0]] for of in begins.values() for f in of}

    def find(text: str) -> set[str]:
        words = words_of(text.lower())
        whole = set(words)
        out = {full[w] for w in whole if w in full}
        longer = [w for w in whole if w[: BEGINNINGS[0]] in short]
        for n, of in begins.items():
            out |= of.intersection([w[:n] for w in longer])
        if not seconds.keys().isdisjoint(whole):
            out.update([seconds[a][b] for a, b in zip(words, words[1:]) if a in seconds and b in seconds[a]])
        return out

    return find


class CharacterModel:
    """Add-half trigram model over the letters of restored words."""

    def __init__(self, trigrams: dict[str, float]):
        pairs: dict[str, float] = defaultdict(float)
        letters = {c for t in trigrams for c in t}
        for t, n in trigrams.items():
            pairs[t[:2]] += n
        wide = 0.5 * max(len(letters), 26)
        self.cost = {t: -math.log((n + 0.5) / (pairs[t[:2]] + wide)) for t, n in trigrams.items()}
        self.unseen = {p: -math.log(0.5 / (n + wide)) for p, n in pairs.items()}
        self.other = math.log(2 * wide)

    def step(self, before: str, c: str) -> float:
        found = self.cost.get(before + c)
        return found if found is not None else self.unseen.get(before, self.other)


@lru_cache(4096)
def readings(c: str, inside: bool, border: float | None = None) -> tuple[tuple[str, float], ...]:
    """What one written character may mean, with costs: letters, nothing, or (a blank) the border of two words."""
    if c in MEANT:
        return (*((m, REPLACED) for m in MEANT[c]), (c, KEPT_ODD) if c.isdigit() else ("", DROPPED + REPLACED))
    if c in BETWEEN:
        return (("", DROPPED if inside else KEPT_ODD), *([(" ", border)] if inside and border is not None else []))
    return ((c, 0.0),)


def restore(written: str, model: CharacterModel, border: float | None = None) -> str:
    """The likeliest word behind ``written``, by Viterbi over its lattice; with ``border``, words with blanks between them.

    A state is the last two letters; after the border of two words it is the start of the model.
    """
    # a state's path is a linked list of its letters, so long runs take no more than their length
    best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    last, cost_of, step = "", model.cost.get, model.step
    for place, c in enumerate(written):
        new: dict[str, tuple[float, tuple | None]] = {}
        options = readings(c, place > 0, border)
        if c == last and c not in BETWEEN:
            options = (*options, ("", DROPPED))
        for state, (cost, path) in best.items():
            for letter, extra in options:
                if letter == " ":
                    if state == "^^":
                        continue
                    to, total = "^^", cost + extra + step(state, "$")
                elif letter:
                    found = cost_of(state + letter)
                    to, total = state[1] + letter, cost + extra + (found if found is not None else step(state, letter))
                else:
                    to, total = state, cost + extra
                if to not in new or total < new[to][0]:
                    new[to] = (total, (letter, path) if letter else path)
        best = new
        last = c
    path = min(((cost + step(state, "$"), state, path) for state, (cost, path) in best.items()), key=itemgetter(0, 1))[2]
    letters = []
    while path is not None:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters))


class Reading(NamedTuple):
    """A text with its disguised places restored: all words that it may hold, and pairs of neighbours in further readings of its places."""

    found: Set[str]
    pairs: Set[str]
    text: str
    parts: list[str]
    first: dict[str, list[str]]

    def words(self) -> list[str]:
        """The words of the restored text, in order."""
        return [w for part in self.parts for w in (self.first[part] if part in self.first else (part,))] if self.first else self.parts

    def near(self, firsts: Set[str]) -> set[str]:
        """Pairs of neighbours, restored, as written and in further readings; of those in the text, the ones that begin with one of ``firsts``."""
        told = [self.words()] + [words_of(self.text)] * bool(self.first)
        return {f"{a} {b}" for words in told for a, b in zip(words, words[1:]) if a in firsts} | self.pairs


def read(part: str, model: CharacterModel) -> tuple[list[str], frozenset[str], frozenset[str]]:
    """Of a stretch of text: its words with places restored, all words that it may hold, and pairs of neighbours of further readings."""
    pieces, others, at = [], [], 0
    for m in (DISGUISED if TREBLED.search(part) else DISGUISED_ONLY).finditer(part):
        written = m["place"]
        if not written:
            continue
        # a stretched word may be longer than any limit: runs beyond three carry nothing more
        short = LONG_RUN.sub(r"\1\1\1", written)
        apart = sum(map(short.count, BETWEEN))
        # a single sign between plain letters has its parts among the words of the text already
        borders = BORDERS if apart > 1 or apart and not MEANT.keys().isdisjoint(short) else ()
        found = list(dict.fromkeys(restore(short, model, b) for b in (None, *borders)))
        pieces += [part[at : m.start()], found[0]]
        others += map(WORD.findall, found[1:])
        at = m.end()
    first = WORD.findall("".join([*pieces, part[at:]]))
    pairs = frozenset(" ".join(p) for words in others for p in zip(words, words[1:]))
    return first, frozenset(first).union(WORD.findall(part), *others), pairs


def restored(text: str, model: CharacterModel, kept: dict[str, tuple]) -> Reading:
    """The words that a text may hold. Stretches with disguised places are kept with their readings."""
    text = text.lower()
    if not odd(text):
        words = words_of(text)
        return Reading(set(words), frozenset(), text, words, {})
    parts = stretches(text)
    found = set(parts)
    # plain words, also with points around them, have no place but that of a letter three times in a row
    bare = {part: part.strip(".") for part in found if not part.isalpha()}
    found.difference_update(bare)
    plain = set(filter(str.isalpha, bare.values()))
    long = stretched(found | plain) if trebled(text) else frozenset()
    first: dict[str, list[str]] = {}
    pairs: set[str] = set()
    for part in [*(found & long), *bare]:
        word = bare.get(part, part)
        if word in plain and word not in long:
            first[part] = [word]
            found.add(word)
            continue
        readings_of = kept.get(part)
        if readings_of is None:
            readings_of = read(part, model)
            if len(part) <= KEPT_CHARS:
                if len(kept) >= KEPT:
                    kept.clear()
                kept[part] = readings_of
        first[part], more, further = readings_of
        found |= more
        pairs |= further
    return Reading(found, pairs, text, parts, first)


def restored_words(text: str, model: CharacterModel, kept: dict[str, tuple]) -> set[str]:
    """The distinct words of the restored text, of the text as written and of other readings."""
    return set(restored(text, model, kept).found)


class Scorer:
    """Scores of texts under a model; what was restored is remembered for a while."""

    def __init__(self, model: Model):
        self.letters, self.kept, self.bias = CharacterModel(model.trigrams), {}, model.bias
        self.whole = {f[1:]: w for f, w in model.weights.items() if f.startswith("=")}
        self.pairs = {f: w for f, w in model.weights.items() if " " in f}
        self.begins = {f: w for f, w in model.weights.items() if f[0] != "=" and " " not in f}
        self.firsts, self.short = {f.split(" ")[0] for f in self.pairs}, {f[:4] for f in self.begins}

    def score(self, text: str | None) -> float:
        if not text:
            return 1 / (1 + math.exp(-self.bias))
        reading = restored(text, self.letters, self.kept)
        all_words = reading.found
        total = sum(map(self.whole.__getitem__, all_words & self.whole.keys()))
        if self.short:
            total += sum(map(self.begins.__getitem__, {w[:n] for w in all_words if w[:4] in self.short for n in BEGINNINGS if len(w) >= n} & self.begins.keys()))
        if not self.firsts.isdisjoint(all_words):
            near = reading.near(self.firsts)
            total += sum(map(self.pairs.__getitem__, near & self.pairs.keys()))
        return 1 / (1 + math.exp(-min(700.0, max(-700.0, total + self.bias))))


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == HELD_OUT, F.lit(False))


def slots(text: str) -> np.ndarray:
    """The least shingle hashes of a whole text under ``SLOTS`` hash functions; near copies share most of them."""
    found = similar.hashes(text)
    if not len(found):
        return np.zeros(SLOTS, np.int64)
    odd = np.uint64(0x9E3779B97F4A7C15) * (2 * np.arange(SLOTS, dtype=np.uint64) + np.uint64(1))
    return (found[:, None] * odd).min(0).view(np.int64)


def narrow(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row: sent to every executor up to ``NARROW_ROWS`` rows, joined by sorting beyond that."""
    return df.hint("broadcast" if df.count() <= NARROW_ROWS else "merge")


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``toxic``, ``text`` and ``weight`` of all labelled texts; those of one text share its weight, and near copies share one."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("label_id")).agg((F.max("toxic") > 0).alias("toxic"))
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = settle(known)
    rows = rows.join(narrow(known), F.col("id") == F.col("label_id")).select(F.xxhash64("text", "toxic").alias("key"), "toxic", "text")
    rows = settle(rows)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [slots(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.list_(pa.int64()))], names=["h", "t", "slots"])

    marks = rows.mapInArrow(told, "h bigint, t boolean, slots array<bigint>").groupBy("h", "t").agg(F.first("slots").alias("slots"), F.count("*").alias("many"))
    each = marks.select("h", "t", "many", F.posexplode("slots").alias("slot", "least"))
    alike = each.withColumn("n", F.count("*").over(Window.partitionBy("slot", "least", "t")))
    weights = alike.groupBy("h").agg((1 / F.sort_array(F.collect_list("n"))[SLOTS // 2] / F.first("many")).alias("weight"))
    weights = settle(weights)
    out = settle(rows.join(narrow(weights), F.col("key") == F.col("h")).select("toxic", "text", "weight"))
    forget(known, rows, weights)
    return out


def counted(texts: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """``feature`` and ``weight``: of the texts that have it, summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, float] = defaultdict(float)

        find = (lambda text: features(words_of(text.lower()))) if wanted is None else finder(wanted)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], names=["feature", "weight"])

        for batch in batches:
            for text, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in find(text):
                    sums[f] += weight
                if len(sums) >= HELD:
                    yield told()
                    sums.clear()
        yield told()

    return texts.select("text", "weight").mapInArrow(count, "feature string, weight double").groupBy("feature").agg(F.sum("weight").alias("weight"))


def surprise(toxic: float, clean: float, rate: float) -> float:
    """How far beyond chance the toxic share of a feature's texts is: a bound on minus the logarithm of its probability."""
    n = toxic + clean
    q = toxic / n
    if q <= rate:
        return 0.0
    return n * (q * math.log(q / rate) + ((1 - q) * math.log((1 - q) / (1 - rate)) if q < 1 else 0.0))


def fit(rows: list[list[int]], toxic: np.ndarray, weight: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias of least logistic loss with an L1 penalty, no weight below zero, by accelerated proximal steps.

    One toxic text of half a weight and no features keeps the bias finite.
    """
    lengths = np.array([*map(len, rows), 0])
    at = np.concatenate([np.array(r, np.int64) for r in rows] + [np.zeros(0, np.int64)])
    of = np.repeat(np.arange(len(lengths)), lengths)
    y, w = np.r_[toxic, 1.0], np.r_[weight, 0.5]
    forward = lambda b: np.bincount(of, b[at], len(lengths))
    back = lambda r: np.bincount(at, r[of], n_features)
    # the largest curvature, by power iteration over features and bias
    v = np.ones(n_features + 1)
    for _ in range(30):
        v /= np.linalg.norm(v)
        r = w * (forward(v[:-1]) + v[-1])
        v = np.r_[back(r), r.sum()]
    step = 4 / (1.05 * np.linalg.norm(v))
    b = now = np.r_[np.zeros(n_features), math.log((w @ y) / (w @ (1 - y)))]
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(forward(now[:-1]) + now[-1], -50, 50)))
        r = w * (p - y)
        new = np.r_[np.maximum(0, now[:-1] - step * (back(r) + PENALTY)), now[-1] - step * r.sum()]
        if (now - new) @ (new - b) > 0:
            t = 1.0
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        now, b = new + (before - 1) / t * (new - b), new
    return b[:-1], float(b[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of all labelled texts; what comes to the driver is counts of theirs, and how often each set of telling features occurs."""
    texts = training_texts(docs, labels, id_col, text_col)
    total = {r["toxic"]: r["w"] for r in texts.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text.lower()))
                if len(seen) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["word"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["word"])

    padded = texts.select("text").mapInArrow(words, "word string").distinct().select(F.concat(F.lit("^^"), "word", F.lit("$")).alias("w"))
    grams = padded.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.col("w").substr(i, F.lit(3)))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    trigrams: dict[str, float] = {r["gram"]: float(r["n"]) for r in grams.collect()}
    if not (total.get(True) and total.get(False)):
        forget(texts)
        return Model({}, math.log(MISS / (1 - MISS)), trigrams)

    rate = total[True] / (total[True] + total[False])
    in_toxic = settle(counted(texts.where("toxic")))
    bound = math.log(max(1, in_toxic.count()) / CHANCE)
    t = {r["feature"]: r["weight"] for r in in_toxic.where((F.col("weight") >= LEAST_TEXTS - 1e-9) & (F.col("weight") * -math.log(rate) >= bound)).collect()}
    clean = {r["feature"]: r["weight"] for r in counted(texts.where("not toxic"), frozenset(t)).collect()} if t else {}
    names = sorted(f for f, n in t.items() if surprise(n, clean.get(f, 0.0), rate) >= bound)
    place = {f: k for k, f in enumerate(names)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(place.keys())
        for batch in batches:
            found = [sorted(place[f] for f in find(text)) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int32()))], names=["toxic", "weight", "found"])

    # texts of the same label and features are one row of the fit
    sparse = texts.select("toxic", "weight", "text").mapInArrow(placed, "toxic boolean, weight double, found array<int>")
    got = sparse.groupBy("toxic", "found").agg(F.sum("weight").alias("weight")).toArrow()
    forget(texts, in_toxic)
    got = sorted(zip(*(got[c].to_pylist() for c in ("toxic", "found", "weight")), strict=True))
    b, bias = fit([g[1] for g in got], np.array([float(g[0]) for g in got]), np.array([g[2] for g in got]), len(names))
    weights = {f: float(x) for f, x in zip(names, b, strict=True) if x > 1e-6}
    # words that tell toxic texts are rare among distinct words, so their letters count more in restoring
    whole = [f[1:] for f in weights if f.startswith("=")]
    boost = max(1.0, sum(trigrams.values()) / max(1, 4 * len(whole)) / 10)
    for gram, n in Counter(p[k : k + 3] for w in whole for p in [f"^^{w}$"] for k in range(len(p) - 2)).items():
        trigrams[gram] = trigrams.get(gram, 0.0) + boost * n
    return Model(weights, bias, trigrams)


def scorer(spark: SparkSession, trained: Model) -> callable:
    """A column function: the toxicity score of a text column."""
    sent = spark.sparkContext.broadcast(tuple(trained))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Scorer(Model(*sent.value))
        for texts in batches:
            yield texts.map(lambda t: of.score(t if isinstance(t, str) else None)).astype("float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of each row."""
    score = scorer(docs.sparkSession, train(docs, labels, id_col, text_col))
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(F.col(text_col).cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

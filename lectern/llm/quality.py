"""Operator 5: line-first cleaning.

Every line is judged alone: a line without a word, one that looks like navigation, one that holds
boilerplate, one of signs rather than words, one in which no sentence closes, and one that repeats an
earlier line are removed. Then the document is judged: it is rejected if the base rule
fails it, or if the lines that remain hold less than ``LEAST_KEPT`` of its word characters.

Defined results: a null or empty text has no words, fails the base rule and is rejected; texts of
any length are read whole; rows of one id are judged on their own; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

import re


import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import map_texts, table

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Share of word characters that must survive, and of signs that a line may have.
LEAST_KEPT, MOST_SIGNS = 0.5, 0.1
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

# Phrases of boilerplate lines, and signs between links of a menu.
BOILERPLATE = re.compile(
    r"(?i)cookie|javascript|terms of (?:use|service)|privacy policy|all rights reserved|lorem ipsum|"
    r"\bsign (?:in|up)\b|\blog ?in\b|subscribe (?:to|now)|click here|read more|share (?:on|this)|[{}]"
)
MENU = re.compile(r"[|»›•→]|\s>\s")
CLOSED = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:\s|$)|[:;]$")


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    likely = np.zeros(n, bool)
    likely[order[1:][same]] = True
    likely[order[:-1][same]] = True
    found: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(likely).tolist():
        found.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    starts = [i for at in found.values() if len(at) > 1 for i in at]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, [i + WINDOW for i in starts], -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def line_fails(line: str) -> str | None:
    """The rule that removes a line with a word, if any."""
    bare = line.strip(SPACES)
    if len(MENU.findall(bare)) >= 3 or (bare.count("|") and 4 * bare.count("|") >= len(bare.split())):
        return "navigation"
    if BOILERPLATE.search(bare):
        return "boilerplate"
    if sum(bare.count(c) for c in SYMBOLS) > MOST_SIGNS * len(bare):
        return "signs"
    if not CLOSED.search(bare):
        return "punctuation"
    return None


def judge(text: str | None) -> tuple[str, int, int, int, int, int, bool, float, bool]:
    """Cleaned text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_share, kept."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    repeated = repeated_words(words)
    seen: set[str] = set()
    left, dup, left_chars = [], 0, 0
    for line in text.split("\n"):
        held = len(line) - sum(line.count(c) for c in SPACES)
        if not held:
            continue
        if line in seen:
            dup += 1
            continue
        seen.add(line)
        if line_fails(line) is None:
            left.append(line)
            left_chars += held
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    share = left_chars / chars if chars else 0.0
    return "\n".join(left), len(words), chars, symbols, dup, repeated, failed, share, not failed and share >= LEAST_KEPT


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the cleaned text, the measures, and the verdict of each row."""

    def make():
        return lambda texts: list(zip(*map(judge, texts), strict=True)) if texts else [()] * 9

    return map_texts(
        df,
        "cleaned string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept_share double, kept boolean",
        make,
        id_col,
        text_col,
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

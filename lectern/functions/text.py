"""Column expressions over text: cleaning, paragraphs, sentences, folding, terms, durations."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations after which a sentence goes on, words that carry no search meaning,
# and suffixes that stemming removes, in the order in which they are tried.
ABBREVIATIONS = (
    r"Mr|Mrs|Ms|Dr|Gen|Lt|Col|Maj|Capt|Sgt|Adm|Cmdr|Brig|Sen|Rep|Gov|St|Jr|Sr|vs|etc|e\.g|i\.e|cf|al|Fig|No|Vol|pp?|"
    r"U\.S|U\.K|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)
STOP_WORDS = (
    "a an and are as at be been but by can could did do does for from had has have how i if in into is it its "
    "me my of on or our should so than that the their them then there these they this those to was we were what "
    "when where which who whom why will with would you your about between does explain describe define compare "
    "according author authors reading readings article text say says said tell discuss"
).split()
SUFFIXES = "ational ations ation ingly ings ing ness ments ment ies ed es ly al s".split()

CLOSERS = "[\"'”’)\\]]"
LONGEST_SENTENCE = 320
WORDS_A_MINUTE = 165
WORDS_A_SENTENCE = 18

#: The first test, of one character on each side, fails fast at nearly every place.
SENTENCE_BREAK = (
    rf"(?=\s)(?<=[.!?\"'”’)\]])(?<=[.!?]{CLOSERS}{{0,4}})(?<!(?<![A-Za-z0-9_])(?i:{ABBREVIATIONS})\.)"
    rf"(?:(?<=[!?]{CLOSERS}{{0,4}})\s+|(?<=\.{CLOSERS}{{0,4}})\s+(?![^\p{{L}}.!?]*\p{{Ll}}))"
)
LONG_PIECES = r"(?s)(.{1,320}$|.{107,318}[;,:] |.{1,319} |.{320})"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Line ends made one kind, soft hyphens and line-break hyphens gone, runs of blanks and empty lines collapsed.

    A single blank and a bare line end stay what they are, so they are no matches.
    """
    for pattern, to in (
        (r"\r\n?", "\n"), ("­", ""), (r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2"), (r"[\t\f\x0B][ \t\f\x0B]*| [ \t\f\x0B]+", " "), (r" +\n *|\n +", "\n"), (r"\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, to)
    return trim(c)


def raw_paragraphs(c: Column, cleaned: bool = False) -> Column:
    """Paragraphs of the cleaned text with their line breaks."""
    return F.filter(F.transform(F.split(c if cleaned else clean_text(c), r"\n\s*\n"), lambda p: trim(p)), lambda p: p != "")


def paragraphs(c: Column, cleaned: bool = False) -> Column:
    return F.filter(F.transform(F.split(c if cleaned else clean_text(c), r"\n\s*\n"), lambda p: trim(F.regexp_replace(p, "\n", " "))), lambda p: p != "")


def split_long(sentence: Column) -> Column:
    """Pieces of at most 320 characters, cut after a clause mark, a space, or where nothing else helps."""
    pieces = F.filter(F.transform(F.regexp_extract_all(sentence, F.lit(LONG_PIECES), F.lit(1)), lambda z: trim(z)), lambda z: z != "")
    return F.when(F.length(sentence) > LONGEST_SENTENCE, pieces).otherwise(F.array(sentence))


def sentences(c: Column, cleaned: bool = False) -> Column:
    """Array of (p, text): the sentences of each paragraph, in order; ``cleaned`` tells that the text is clean."""

    def of(paragraph: Column, p: Column) -> Column:
        parts = F.filter(F.transform(F.split(paragraph, SENTENCE_BREAK), lambda s: trim(s)), lambda s: s != "")
        return F.transform(F.flatten(F.transform(parts, lambda s: split_long(s))), lambda s: F.struct(p.alias("p"), s.alias("text")))

    return F.flatten(F.transform(paragraphs(c, cleaned), of))


def _folded(c: str) -> str:
    """What one character folds to, by the rules of Unicode."""
    plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
    return plain.translate({0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"'}).lower()


#: Ranges of characters, besides those of Latin script, that are looked at first.
PLAIN_RANGES = 16


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, str, list[str]]:
    """Characters that fold to one, and these; the ranges of those that fold to none or to several, as a class
    of a regular expression, and ranges without any of these that hold most texts; and, longest first, these
    characters with the letters of each place."""
    single, several = [], []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        to = _folded(chr(code))
        if len(to) == 1 and to != chr(code):
            single.append((chr(code), to))
        elif len(to) != 1 and not 0x300 <= code <= 0x36F:
            several.append((code, to))
    ranges: list[list[int]] = []
    for code, _ in several:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    longest = sorted(several, key=lambda x: -len(x[1]))
    # a character without a letter in a place is left out there
    places = ["".join(to[k] for _, to in longest if len(to) > k) for k in range(len(longest[0][1]))]
    between = [(a + 1, b - 1) for (_, a), (b, _) in zip([(0, -1), *ranges], [*ranges, (0x110000, 0)], strict=True) if b - a > 1]
    latin = [r for r in between if r[0] < 0x180]
    wide = sorted((r for r in between if r[0] >= 0x180), key=lambda r: r[0] - r[1])[:PLAIN_RANGES]
    named, harmless = ("".join(rf"\x{{{x:X}}}-\x{{{y:X}}}" for x, y in rs) for rs in (ranges, [*latin, *wide]))
    return "".join(x for x, _ in single), "".join(y for _, y in single), named, harmless, ["".join(chr(c) for c, _ in longest), *places]


def fold(c: Column) -> Column:
    """Compatibility decomposition in lower case, without accents and with straight quotes.

    Equal to Unicode's on every character; marks that follow each other keep their order.
    """
    source, to, named, harmless, (sources, *places) = _fold_tables()

    def spelled_out(plain: Column) -> Column:
        parts = F.regexp_extract_all(plain, F.lit(f"([{named}]|[^{named}]+)"), F.lit(1))
        # a part of one such character is spelled place by place
        spelled = F.transform(parts, lambda p: F.when(p.rlike(f"^[{named}]"), F.concat(*(F.translate(p, sources, x) for x in places))).otherwise(p))
        # few ranges pass most texts by
        return F.when(plain.rlike(f"[^{harmless}]") & plain.rlike(f"[{named}]"), F.array_join(spelled, "")).otherwise(plain)

    def of_one(plain: Column) -> Column:
        return F.when(plain.rlike(r"[^\x00-\x7F]"), F.translate(plain, source, to)).otherwise(plain)

    plain = F.replace(F.regexp_replace(c, "[\u0300-\u036f]", ""), F.lit("…"), F.lit("..."))
    return F.lower(_once(_once(plain, spelled_out), of_one))


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+")).cast("long")


def parse_query(q: Column) -> Column:
    """Folded terms; quoted phrases stay together."""
    found = F.regexp_extract_all(fold(q), F.lit(r'("[^"]+"|\S+)'), F.lit(1))
    bare = F.transform(found, lambda t: trim(F.when(t.rlike(r'^"[^"]+"$'), F.regexp_replace(t, '^"|"$', "")).otherwise(t)))
    return F.filter(bare, lambda t: t != "")


def stem(w: Column) -> Column:
    arms = None
    for s in SUFFIXES:
        fits = F.endswith(w, F.lit(s)) & (F.length(w) >= len(s) + 4)
        if s == "s":
            fits = fits & ~w.rlike("(ss|is|us)$")
        cut = F.substring(w, F.lit(1), F.length(w) - len(s))
        arms = F.when(fits, cut) if arms is None else arms.when(fits, cut)
    return arms.otherwise(w)


def tokens(c: Column) -> Column:
    """Stemmed search terms in order, without stop words and single characters."""
    found = F.transform(F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+(?:'[a-z]+)?"), F.lit(0)), lambda t: F.regexp_replace(t, "'s$", ""))
    stop = sorted(set(STOP_WORDS))
    return F.transform(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(stop)), lambda t: stem(t))


def highlight_ranges(text: Column, terms: Column) -> Column:
    """Merged [start, end) ranges of the terms; none where folding changes the length."""
    folded = fold(text)
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def found_of(t: Column) -> Column:
        # occurrences of one term do not overlap: they are what splitting at the term takes out
        between = F.transform(F.split(folded, F.concat(F.lit(r"\Q"), t, F.lit(r"\E")), -1), lambda x: F.length(x))
        state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(s: Column, n: Column) -> Column:
            start = s["at"] + n
            return F.struct((start + F.length(t)).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("a"), (start + F.length(t)).alias("b")))).alias("out"))

        return F.aggregate(F.slice(between, 1, F.size(between) - 1), state, step, lambda s: s["out"])

    def merge(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (r["a"] <= last["b"]), grown).otherwise(F.concat(acc, F.array(r)))

    found = F.array_sort(F.flatten(F.transform(terms, found_of)))
    return F.when(F.length(folded) == F.length(text), F.aggregate(found, empty, merge)).otherwise(empty)


# What is not spoken, as patterns. Digits and word borders are written out, since Java's classes take in
# no more than ASCII either way, but a border beside a letter with an accent would differ.
_YEAR = r"(?:1[6-9][0-9][0-9]|20[0-9][0-9])[a-z]?|n\.\s?d\."
_PAGES = r"(?:,?\s*(?:pp?\.\s*)?[0-9\-–, ]+)?"
#: In order: links, author-year citations, numbered ones, page references, footnote numbers, then tidying.
SPEAKABLE = (
    (r"(?i)\s?(?:https?://|www\.)\S+|\s?(?<![A-Za-z0-9_])doi:\s?\S+", ""),
    (
        rf"\s?\((?:(?:see|e\.g\.,?|cf\.|for example,?)\s+)?[A-Z][^()]{{0,160}}?(?<![A-Za-z0-9_])(?:{_YEAR}){_PAGES}"
        rf"(?:;\s*[^()]{{0,160}}?(?<![A-Za-z0-9_])(?:{_YEAR}){_PAGES})*\)",
        "",
    ),
    (r"\s?\[(?:[0-9]{1,3}(?:\s*[-–,]\s*[0-9]{1,3})*)\]", ""),
    (r"(?i)\s?\((?:pp?\.|page|pages)\s*[0-9\-–, ]+\)", ""),
    (r"(?<=[a-z)\]][.,;:!?]{0,1}[\"”’]{0,1})[0-9]{1,3}(?=\s|$|[,.;:])", ""),
    (r"\s+([.,;:!?])", "$1"),
    (r"\(\s*\)", ""),
    (r"\s{2,}", " "),
)


#: What every match of these patterns holds; most sentences hold nothing of it.
MARKED = r"(?i)[(\[0-9]|https?:|www\.|doi:|\s[\s.,;:!?]"


def speakable(c: Column) -> Column:
    """The sentence as it is spoken: without links, citations and footnote numbers, unless nothing would be left."""
    out = c
    for pattern, to in SPEAKABLE:
        out = F.regexp_replace(out, pattern, to)
    out = F.when(c.rlike(MARKED), out).otherwise(c)
    return _once(trim(out), lambda o: F.when(o.rlike("[A-Za-z]{2}"), o).otherwise(c))


def listen_minutes(words: Column, rate: Column) -> Column:
    return words / (F.lit(WORDS_A_MINUTE) * F.greatest(rate, F.lit(0.1)))


def format_duration(minutes: Column) -> Column:
    hours = F.floor(minutes / 60)
    rest = F.floor(minutes - hours * 60 + 0.5)
    text = F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m"))).otherwise(F.concat(F.greatest(rest, F.lit(1)).cast("string"), F.lit("m")))
    return F.when(minutes.isNull() | F.isnan(minutes) | (minutes <= 0) | (minutes == float("inf")), "0m").otherwise(text)


def remaining_words(words: Column, listen_words: Column, position: Column, completed: Column) -> Column:
    left = F.greatest(F.lit(0), F.coalesce(listen_words, words) - position * WORDS_A_SENTENCE)
    return F.when(completed, F.lit(0)).otherwise(left).cast("long")


def take_markers(c: Column, pattern: str) -> Column:
    """(text, positions): paragraphs that are markers taken out, and the paragraph that each one precedes.

    ``pattern`` has one group, the marker's number.
    """
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: trim(p)), lambda p: p != "")
    number = lambda p: F.regexp_extract(p, f"^{pattern}$", 1)
    kept = F.filter(parts, lambda p: number(p) == "")
    # each marker with its place among all paragraphs; of those before it the earlier markers are no paragraphs of the text
    placed = F.filter(F.transform(parts, lambda p, i: F.struct(number(p).alias("n"), i.alias("i"))), lambda x: x["n"] != "")
    found = F.transform(placed, lambda x, k: F.struct(x["n"].cast("int").alias("n"), (x["i"] - k).alias("para")))
    return F.struct(F.array_join(kept, "\n\n").alias("text"), found.alias("positions"))

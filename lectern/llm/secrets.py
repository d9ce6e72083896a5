"""Operator 6: secrets in texts and in what their encoded stretches hide.

A worklist starts with the text. Each layer is scanned with the patterns; then every stretch that
reads as URL escapes, Unicode escapes, hexadecimal, base64 (both also over line breaks), or as either of
these over compressed bytes (gzip, zlib, raw deflate, bzip2, xz), is decoded and put on the list, and so is the layer as a whole with its escapes replaced, unless a
layer of the same content at the same places was there before (so that cycles end). The list
empties at the fixpoint. A layer knows where each of its characters came from, so what is found in
it is reported as a span of the original text.

What stands in front of an encoded stretch, as a path, a name or a stray letter, may shift it.
Base64 is therefore read from each of the first four characters of its stretch, and hexadecimal from each of
the first two. Where the bytes are no text as a whole, the runs of ASCII text in them are layers, and compressed data
begin wherever their head stands (raw deflate, which has none: at those first characters and behind ``CUTS``).

Defined results: a null or empty text has no spans; texts of any length are scanned whole; rows of
one id are scanned on their own; an empty table gives an empty one; other columns are ignored.
Compressed stretches are unpacked to their end, all members of them, in pieces that overlap, whatever
their bytes are; a layer that is broken or holds a longer block than ``MOST_HELD`` is counted in
``given_up``, besides what its readable pieces hold. What only looks like the head of compressed data is not counted.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import map_texts, table

KINDS = ("assign", "access", "hex")
#: Bytes unpacked at once, characters that pieces of unpacked text share at least, and the longest unended block carried over.
CHUNK, OVERLAP, MOST_HELD = 4 << 20, 1 << 16, 16 << 20

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_CALLED = ("passw", "secret", "token", "apikey", "api_key")

BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64 that follow each other, and one of them.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t\r]*\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_HEX_LINE = re.compile(r"[0-9A-Fa-f]+")
#: Hexadecimal digits of twelve bytes or more.
HEX_RUN = re.compile(r"[0-9A-Fa-f]{24,}")
#: Runs of text among other bytes; what often stands in front of an encoded stretch, and how many of these are tried.
ASCII_RUN = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
CUTS, MOST_CUTS = re.compile(r"[/_-]"), 8
#: Heads of compressed data: gzip, zlib, bzip2, xz.
HEADS = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
_SIGNED = re.compile(r"[0-9+/=_]|[a-z][A-Z]")


class Guess(bytes):
    """Bytes that may be deflated, which nothing but their reading tells."""


#: Where each character of a layer begins and ends in the text.
Places = tuple[np.ndarray, np.ndarray]


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches in one layer."""
    found = []
    lower = text.lower()
    if any(c in lower for c in _CALLED):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _unescape(stretch: str, unit: re.Pattern, decode: Callable[[str], str | None]) -> tuple[str, Places] | None:
    texts, starts, ends, last = [], [], [], 0
    for m in unit.finditer(stretch):
        made = decode(m.group())
        if made is None:
            continue
        plain = np.arange(last, m.start())
        texts += [stretch[last : m.start()], made]
        starts += [plain, np.full(len(made), m.start())]
        ends += [plain + 1, np.full(len(made), m.end())]
        last = m.end()
    if not texts:
        return None
    plain = np.arange(last, len(stretch))
    return "".join([*texts, stretch[last:]]), (np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1]))


_PERCENT_CHAR = re.compile(r"(?:%[CDcd][0-9A-Fa-f]%[89ABab][0-9A-Fa-f]|%[Ee][0-9A-Fa-f](?:%[89ABab][0-9A-Fa-f]){2}|%[Ff][0-7](?:%[89ABab][0-9A-Fa-f]){3}|%[0-9A-Fa-f]{2})")
_ESCAPE_CHAR = re.compile(r"(?:\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})")


def _stretches(text: str, unit: re.Pattern) -> list[tuple[int, int]]:
    """The spans between white space that hold an escape."""
    out: list[tuple[int, int]] = []
    for m in unit.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        low = out[-1][1] if out else 0
        start = max(low, *(text.rfind(c, low, m.start()) + 1 for c in " \t\n\r"))
        close = _SPACE.search(text, m.end())
        out.append((start, close.start() if close else len(text)))
    return out


_SPACE = re.compile(r"\s")


def _percent(unit: str) -> str | None:
    data = bytes.fromhex(unit.replace("%", ""))
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _escape(unit: str) -> str | None:
    codes = [int(x, 16) for x in re.findall(r"\\[ux]([0-9A-Fa-f]+)", unit)]
    if len(codes) == 2:
        return chr(0x10000 + (codes[0] - 0xD800) * 0x400 + codes[1] - 0xDC00)
    return None if 0xD800 <= codes[0] < 0xE000 else chr(codes[0])


def _opener(data: bytes) -> Callable | None:
    """What makes a decompressor for bytes that begin like gzip, zlib, bzip2 or xz data."""
    if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0):
        return lambda: zlib.decompressobj(47)
    if data[:3] == b"BZh" and data[3:4].isdigit():
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


def _bare_deflate(data: bytes) -> bool:
    """Whether bytes without a head are deflated text, by what their beginning gives."""
    try:
        out = zlib.decompressobj(-15).decompress(data, 4096)
    except zlib.error:
        return False
    return len(out) > 8 and as_text(out.decode("utf-8", "ignore").encode()) is not None and len(out.decode("utf-8", "ignore").encode()) >= len(out) - 3


def packed(data: bytes) -> bool:
    """Whether the bytes are compressed in a way that is known here."""
    return _opener(data) is not None or (as_text(data) is None and _bare_deflate(data))


def unpack(data: bytes) -> Iterator[bytes]:
    """The bytes inside compressed data, all members of it, in chunks of ``CHUNK`` at most.

    Data that are broken or cut off give what comes before that, and then a ``zlib.error``.
    """
    opener = _opener(data) or (lambda: zlib.decompressobj(-15))
    while opener is not None:
        member = opener()
        while not member.eof:
            try:
                out = member.decompress(data, CHUNK)
            except (OSError, lzma.LZMAError) as e:
                raise zlib.error(str(e)) from e
            # zlib hands back what it has not read; the others keep it
            data = getattr(member, "unconsumed_tail", b"")
            if out:
                yield out
            elif not member.eof and (getattr(member, "needs_input", True)):
                raise zlib.error("cut off")
        data = member.unused_data
        opener = _opener(data)


def _odd(text: str) -> int:
    return sum(c < " " and c not in "\t\n\r" or c == "\x7f" for c in text)


def as_text(data: bytes) -> str | None:
    """Bytes that read as text: UTF-8 with few control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and 20 * _odd(text) <= len(text) else None


def _base64_bytes(stretch: str) -> bytes:
    """The bytes of base64 letters of either kind; a single letter left over says nothing."""
    bare = stretch.rstrip("=")
    bare = bare[: len(bare) - (len(bare) % 4 == 1)]
    try:
        return base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _hex_bytes(stretch: str) -> bytes:
    return bytes.fromhex(stretch[: len(stretch) // 2 * 2])


def _reads(data: bytes) -> bool:
    """Whether bytes that have the head of compressed data give text at their beginning."""
    opener = _opener(data)
    if opener is None:
        return False
    try:
        out = opener().decompress(data[: 1 << 16], 4096)
    except (OSError, EOFError, zlib.error, lzma.LZMAError):
        return False
    return len(ASCII_RUN.findall(out)) > 0


def _blocks(text: str) -> list[list[tuple[int, int]]]:
    """Base64 runs, and runs joined over line breaks, as the spans of their lines.

    Of the lines that follow each other all are joined, with and without the first and last, and
    those of equal length with the shorter one that ends them, and without it.
    """
    out = [[m.span()] for m in BASE64.finditer(text)]
    if "\n" not in text:
        return out
    for m in WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m.group())]
        tries = {(0, len(lines)), (0, len(lines) - 1), (1, len(lines)), (1, len(lines) - 1)}
        at = 0
        while at < len(lines):
            width, end = lines[at][1] - lines[at][0], at + 1
            while end < len(lines) and lines[end][1] - lines[end][0] == width:
                end += 1
            tries |= {(at, end), (at, min(end + 1, len(lines)))}
            at = end
        out += [lines[a:b] for a, b in sorted(tries) if b - a > 1]
    return out


def _hex_blocks(text: str) -> list[list[tuple[int, int]]]:
    """Runs of hexadecimal digits, and blocks of lines that hold nothing else."""
    out = [[m.span()] for m in HEX_RUN.finditer(text)]
    if "\n" in text:
        out += [lines for lines in _blocks(text) if len(lines) > 1 and all(_HEX_LINE.fullmatch(text, a, b) for a, b in lines)]
    return out


def layers_in(text: str) -> list[tuple[str | bytes, Places]]:
    """What escapes and stretches decode to, and where its characters lie; compressed bytes lie at all of their stretch.

    Escapes are decoded in their stretch between white space, and in the text as a whole.
    """
    out: list[tuple[str | bytes, Places]] = []
    for sign, unit, decode in (("%", _PERCENT_CHAR, _percent), ("\\", _ESCAPE_CHAR, _escape)):
        if sign in text:
            for a, b in {*_stretches(text, unit), (0, len(text))}:
                if made := _unescape(text[a:b], unit, decode):
                    out.append((made[0], (made[1][0] + a, made[1][1] + a)))
    for lines in _blocks(text):
        written = "".join(text[a:b] for a, b in lines)
        if _SIGNED.search(written):
            cuts = [m.end() for m, _ in zip(CUTS.finditer(written), range(MOST_CUTS))]
            out += _decoded(written, lines, _base64_bytes, 4, 3, cuts)
    for lines in _hex_blocks(text):
        out += _decoded("".join(text[a:b] for a, b in lines), lines, _hex_bytes, 2, 1, [])
    return out


def _decoded(written: str, lines: list[tuple[int, int]], read: Callable[[str], bytes], wide: int, bytes_in: int, cuts: list[int]) -> Iterator[tuple[str | bytes, Places]]:
    """Layers of one stretch: ``wide`` letters of it stand for ``bytes_in`` bytes, from wherever it may begin."""
    at = np.concatenate([np.arange(a, b) for a, b in lines])

    def places(start: int, first: int, text: str) -> Places:
        """Where the characters of text lie whose bytes begin with the stretch's ``first``."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        ends = first + np.cumsum(sizes)
        return at[start + (ends - sizes) * wide // bytes_in], at[np.minimum(start - (-ends * wide // bytes_in), len(at)) - 1] + 1

    heads: set[int] = set()
    for start in range(min(wide, len(written))):
        data = read(written[start:])
        if start == 0 and packed(data):
            yield data, (at[:1], at[-1:] + 1)
            continue
        if made := as_text(data):
            yield made, places(start, 0, made)
            continue
        for m in ASCII_RUN.finditer(data):
            yield (run := m.group().decode()), places(start, m.start(), run)
        for m in HEADS.finditer(data):
            where = start + m.start() * wide // bytes_in
            if where not in heads and _reads(data[m.start() :]):
                heads.add(where)
                yield data[m.start() :], (at[where : where + 1], at[-1:] + 1)
        if start and _bare_deflate(data):
            yield Guess(data), (at[start : start + 1], at[-1:] + 1)
    for cut in cuts:
        if len(written) - cut >= 16 and cut >= wide and _bare_deflate(data := read(written[cut:])):
            yield Guess(data), (at[cut : cut + 1], at[-1:] + 1)


def _unended(text: str) -> int:
    """Where the last stretch begins, or the block of base64 lines that it ends."""
    at = len(text)
    while True:
        cut = text.rfind("\n", 0, at)
        line = text[cut + 1 : at].rstrip()
        blank = max(line.rfind(" "), line.rfind("\t"))
        if blank >= 0 and line.strip() != line[blank + 1 :]:
            return cut + 1 + blank + 1
        if cut < 0 or len(text) - cut > MOST_HELD or (at < len(text) and not _LINE.fullmatch(line.strip())):
            return cut + 1
        at = cut


def _pieces(data: bytes) -> Iterator[str | None]:
    """Texts that cover what is compressed in ``data``, each with the end of the one before; None for what can't be read."""
    # bytes that are not UTF-8 stand for themselves, as the patterns hold ASCII only
    read, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    try:
        for chunk in unpack(data):
            held += read.decode(chunk)
            if len(held) >= CHUNK:
                yield held
                # a stretch or block that is not ended goes on in the next piece
                tail = _unended(held)
                if len(held) - tail > MOST_HELD:
                    yield None
                    tail = len(held)
                held = held[max(0, min(tail, len(held) - OVERLAP)) :]
        held += read.decode(b"", True)
    except zlib.error:
        yield None
    if held:
        yield held


def read_all(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans with those of decoded layers, as (start, kind, end), and how many compressed layers are not read whole."""
    if not text:
        return [], [], 0
    base = sorted(scan(text))
    every, given_up = set(base), 0
    # a layer of the same content at the same places holds nothing new, which ends cycles as well
    seen = set()
    work: deque[tuple[str | bytes, Places | None]] = deque([(text, None)])
    while work:
        layer, places = work.popleft()
        if isinstance(layer, bytes):
            found = 0
            for piece in _pieces(layer):
                if piece is None:
                    found = 1
                    continue
                spread = np.broadcast_to(places[0], len(piece)), np.broadcast_to(places[1], len(piece))
                for s, kind, e in scan(piece):
                    _tell(every, base, int(spread[0][s]), kind, int(spread[1][e - 1]))
                work.extend(_unseen(layers_in(piece), spread, seen))
            given_up += found and not isinstance(layer, Guess)
            continue
        if places is not None:
            for s, kind, e in scan(layer):
                _tell(every, base, int(places[0][s]), kind, int(places[1][e - 1]))
        work.extend(_unseen(layers_in(layer), places, seen))
    return base, sorted(every), given_up


def _tell(every: set, base: list[tuple[int, int, int]], a: int, kind: int, b: int) -> None:
    # what a pattern already covers in the text is not told again
    if not any(kind == k and x <= a and b <= y for x, k, y in base):
        every.add((a, kind, b))


def _unseen(layers: list[tuple[str | bytes, Places]], above: Places | None, seen: set) -> Iterator[tuple[str | bytes, Places]]:
    """Layers that are new, with their places in the text."""
    for made, (starts, ends) in layers:
        if above is not None:
            starts, ends = above[0][starts], above[1][ends - 1]
        content = made if isinstance(made, bytes) else made.encode("utf-8", "surrogatepass")
        name = tuple(hashlib.blake2b(x, digest_size=16).digest() for x in (content, starts.tobytes(), ends.tobytes()))
        if name not in seen:
            seen.add(name)
            yield made, (starts, ends)


def all_spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those of decoded layers, as (start, kind, end)."""
    return read_all(text)[:2]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``base`` and ``spans`` (arrays of (kind, start, end) in code points, end exclusive), and ``given_up``,
    how many compressed layers are not read whole."""

    def make():
        named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

        def run(texts):
            got = [read_all(t) for t in texts]
            return [[named(b) for b, _, _ in got], [named(x) for _, x, _ in got], [n for _, _, n in got]]

        return run

    kind = "array<struct<kind:string,start:int,end:int>>"
    return map_texts(df, f"base {kind}, spans {kind}, given_up bigint", make, id_col, text_col)


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), "given_up"
    )

"""Operator 1: SentencePiece encoding and decoding that keeps byte offsets.

A text is normalised by longest-prefix matches in the model's compiled character map. Each
normalised character remembers the byte of the original text at which its source starts, so every
piece projects to a span of original bytes. Pieces are merged best pair first, as the model's
scores say, inside chunks that no piece of the vocabulary can cross; chunks repeat, so each task
keeps the merged form of recent ones.

Defined results: a null text counts as empty; an empty text has the end id alone; texts of any
length are encoded whole; a null id stays null; repeated rows give repeated results; an empty
table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import map_texts, table

SPACE = "▁"
#: Chunks that a task remembers, and the longest of them in characters.
KEPT_CHUNKS, KEPT_CHARS = 200_000, 64
#: Chunks that are merged side by side.
BLOCK_CHUNKS = 4096
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 prefixes and its replacement strings."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.values = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
            self.values = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``data[at:]`` and what replaces it."""
        units = self.units
        jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, found = jump(units[0]), None
        for end in range(at, len(data)):
            c = data[end]
            if node ^ c >= len(units):
                break
            unit = units[node := node ^ c]
            if unit & 0x800000FF != c:
                break
            node ^= jump(unit)
            if unit & 0x100:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        size, start = found
        return size, self.values[start : self.values.index(b"\0", start)]


class PieceModel:
    """A model file of kind BPE."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        charsmap, self.dummy_prefix, self.trim, escape = b"", True, True, True
        self.eos_id, kind = 2, 1
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                kind = trainer.get(3, 1)
                self.eos_id = trainer.get(42, 2)
            elif number == 3:
                norm = dict(_fields(value))
                charsmap = norm.get(2, b"")
                self.dummy_prefix, self.trim, escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        if kind != 2 or not escape:
            raise ValueError("a BPE model with escaped spaces is needed")
        self.map = CharacterMap(charsmap)
        self.id_of = {p: i for i, p in enumerate(self.pieces)}
        self.unk_id = self.types.index(UNKNOWN)
        self.byte_ids = [self.id_of.get(f"<0x{b:02X}>", self.unk_id) for b in range(256)]
        self.score = {p: s for p, s, t in zip(self.pieces, scores, self.types, strict=True) if t in (NORMAL, USER, UNUSED)}
        self.has_bytes = BYTE in self.types
        multi = [p for p in self.score if len(p) > 1]
        crosses = any(SPACE in p.lstrip(SPACE) for p in multi) or USER in self.types or UNUSED in self.types
        inner = "".join(sorted(set(chain.from_iterable(multi)) - {SPACE}))
        inside = f"[{re.escape(inner)}]" if inner else "(?!)"
        self.chunks = re.compile(".+" if crosses else f"{SPACE}*{inside}+|{SPACE}+|.", re.DOTALL).findall
        self._pair_table(multi)
        self.plain = not self.map.units and not self.trim
        self.kept: dict[str, bytes] = {}
        surface = [b"" if t == CONTROL else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        for b, i in enumerate(self.byte_ids):
            if i != self.unk_id:
                surface[i] = bytes([b])
        surface[self.unk_id] = " ⁇ ".encode()
        self.surface = surface

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and its end the byte where its source starts."""
        data = text.encode()
        if self.plain:
            if not text:
                return "", np.zeros(1, np.int64)
            raw = np.frombuffer(data, np.uint8)
            starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(data))
            prefix = [0] if self.dummy_prefix else []
            return (SPACE if prefix else "") + text.replace(" ", SPACE), np.append(np.array(prefix, np.int64), starts)
        out: list[str] = []
        source: list[int] = []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map.units else None
            if hit:
                size, made = hit[0], hit[1].decode()
            else:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                made = data[at : at + size].decode()
            out.extend(made)
            source.extend([at] * len(made))
            at += size
        if self.trim:
            held = [k for k, c in enumerate(out) if c != " " or (k and out[k - 1] != " ")]
            while held and out[held[-1]] == " ":
                held.pop()
            out, source = [out[k] for k in held], [source[k] for k in held]
        if out and self.dummy_prefix:
            out.insert(0, " ")
            source.insert(0, 0)
        return "".join(out).replace(" ", SPACE), np.array([*source, len(data)], np.int64)

    def merged(self, chunk: str) -> list[str]:
        """The chunk's symbols after merging the best pair, leftmost of equals, until none is a piece."""
        score, parts = self.score.get, list(chunk)
        if len(parts) > KEPT_CHARS:
            return self._merged_long(parts)
        ranks = [score(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
        while ranks and (best := max(ranks)) > -np.inf:
            i = ranks.index(best)
            parts[i : i + 2] = [new := parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = score(parts[i - 1] + new, -np.inf)
            if i < len(ranks):
                ranks[i] = score(new + parts[i + 1], -np.inf)
        return parts

    def _merged_long(self, parts: list) -> list[str]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (s := self.score.get(p := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(queue, (-s, i, p))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, p = heapq.heappop(queue)
            j = after[i]
            if parts[i] is None or j >= n or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _chunk(self, chunk: str) -> bytes:
        """For each id: itself, the normalised characters that it closes, and its byte inside a character."""
        ids, closes, inner = [], [], []
        for part in self.merged(chunk):
            found = self.id_of.get(part)
            if found is not None and self.types[found] in (NORMAL, USER, UNUSED):
                ids.append(found)
                closes.append(len(part))
                inner.append(0)
            elif self.has_bytes:
                data = part.encode()
                ids.extend(self.byte_ids[b] for b in data)
                closes.extend([0] * (len(data) - 1) + [len(part)])
                inner.extend(range(len(data)))
            else:
                ids.append(self.unk_id)
                closes.append(len(part))
                inner.append(0)
        return array("i", chain.from_iterable(zip(ids, closes, inner, strict=True))).tobytes()

    def _pair_table(self, multi: list[str]) -> None:
        """Every pair of symbols that makes a piece: sorted keys, the place of its score, and the piece."""
        symbol = dict(self.id_of)
        for c in sorted(set(chain.from_iterable(multi))):
            symbol.setdefault(c, len(symbol))
        place = {s: k for k, s in enumerate(sorted({self.score[p] for p in multi}, reverse=True))}
        found = sorted(
            (symbol[p[:k]] << 20 | symbol[p[k:]], place[self.score[p]], self.id_of[p])
            for p in multi
            for k in range(1, len(p))
            if p[:k] in symbol and p[k:] in symbol
        )
        self.pair_key, self.pair_place, self.pair_id = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1 and (i >= len(self.types) or self.types[i] == NORMAL):
                self.char_symbol[ord(c)] = i

    def _find_pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return at, (self.pair_key[at] == key) & (left >= 0) & (right >= 0)

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """``_chunk`` of many chunks, whose merges run side by side in numpy."""
        learned: dict[str, bytes] = {}
        short = sorted((c for c in chunks if len(c) <= KEPT_CHARS), key=len)
        for c in chunks:
            if len(c) > KEPT_CHARS or not len(self.pair_key):
                learned[c] = self._chunk(c)
        for at in range(0, len(short) if len(self.pair_key) else 0, BLOCK_CHUNKS):
            part = short[at : at + BLOCK_CHUNKS]
            wide = len(part[-1])
            codes = np.frombuffer("".join([c.ljust(wide, "\0") for c in part]).encode("utf-32-le"), np.uint32).reshape(len(part), wide)
            used = np.arange(wide) < np.fromiter(map(len, part), int, len(part))[:, None]
            symbols = np.where(used, self.char_symbol[codes], -1)
            sizes = used.astype(np.int32)
            rows = np.arange(len(part))
            done_symbols, done_sizes = symbols.copy(), sizes.copy()
            while len(rows) and symbols.shape[1] > 1:
                where, found = self._find_pairs(symbols[:, :-1], symbols[:, 1:])
                places = np.where(found, self.pair_place[where], np.iinfo(np.int64).max)
                best = places.argmin(1)
                each = np.arange(len(rows))
                live = found[each, best]
                wide = symbols.shape[1]
                done_symbols[rows[~live], :wide], done_sizes[rows[~live], :wide] = symbols[~live], sizes[~live]
                done_sizes[rows[~live], wide:] = 0
                made = self.pair_id[where[each, best]][live]
                rows, symbols, sizes, best = rows[live], symbols[live], sizes[live], best[live]
                each = np.arange(len(rows))
                symbols[each, best] = made
                sizes[each, best] += sizes[each, best + 1]
                keep = np.arange(wide) != best[:, None] + 1
                symbols, sizes = symbols[keep].reshape(len(rows), wide - 1), sizes[keep].reshape(len(rows), wide - 1)
            if len(rows):
                done_symbols[rows, :1], done_sizes[rows, :1] = symbols, sizes
                done_sizes[rows, 1:] = 0
            full = done_sizes > 0
            odd = (full & ((done_symbols < 0) | (done_symbols >= len(self.pieces)))).any(1)
            flat = np.stack([done_symbols[full], done_sizes[full], np.zeros(full.sum(), np.int64)], 1).astype(np.int32).tobytes()
            ends = np.cumsum(full.sum(1)) * 12
            for chunk, end, begin, strange in zip(part, ends.tolist(), [0, *ends[:-1].tolist()], odd.tolist(), strict=True):
                learned[chunk] = self._chunk(chunk) if strange else flat[begin:end]
        return learned

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids with the end id last, and the original byte at which each one's span starts.

        A span ends where the next one starts; the end id's span is empty, at the text's end.
        """
        if len(self.kept) >= KEPT_CHUNKS:
            self.kept.clear()
        kept, out = self.kept, []
        normed = [self.normalise(t) for t in texts]
        chunks = [self.chunks(norm) for norm, _ in normed]
        known = [list(map(kept.get, each)) for each in chunks]
        missing = {c for each, got in zip(chunks, known, strict=True) if None in got for c, g in zip(each, got, strict=True) if g is None}
        learned = self._learn(list(missing))
        kept.update((c, x) for c, x in learned.items() if len(c) <= KEPT_CHARS)
        for (_, source), each, got in zip(normed, chunks, known, strict=True):
            if None in got:
                got = [g or learned[c] for c, g in zip(each, got, strict=True)]
            ids, closes, inner = np.frombuffer(b"".join(got), np.int32).reshape(-1, 3).T
            ends = np.cumsum(closes)
            starts = source[ends - closes] + inner
            if not self.plain and len(starts):
                starts = np.minimum(starts, source[np.minimum(ends - closes + 1, len(source) - 1)])
                starts[0] = 0
            out.append((np.append(ids, np.int32(self.eos_id)), np.append(starts, source[-1])))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids`` as the model writes it, without control pieces and the added first space."""
        surface = self.surface
        data = b"".join([surface[i] for i in ids])
        first = next((i for i in ids if self.types[i] != CONTROL), None)
        if self.dummy_prefix and first is not None and self.pieces[first].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", data.decode("utf-8", "surrogateescape"))


_MODELS: dict[bytes, PieceModel] = {}


def load_model(blob: bytes) -> PieceModel:
    """One model for each worker process."""
    import hashlib

    key = hashlib.sha256(blob).digest()
    if key not in _MODELS:
        _MODELS[key] = PieceModel(blob)
    return _MODELS[key]


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver and sent to the tasks (about half a megabyte)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_col``, ``ids``, ``starts`` and ``n_bytes``: pieces of each whole text and the bytes where they start.

    With ``decoded`` the text that the ids decode to is added in the same pass, so ids need not go to Python again.
    """
    blob = df.sparkSession.sparkContext.broadcast(model_bytes(path))

    def make():
        model = load_model(blob.value)

        def lists(arrays):
            offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32)))

        def run(texts):
            got = model.encode_all([t or "" for t in texts])
            back = [[model.decode(g[0].tolist()) for g in got]] if decoded else []
            return lists([g[0] for g in got]), lists([g[1] for g in got]), [int(g[1][-1]) for g in got], *back

        return run

    more = ", decoded string" if decoded else ""
    return map_texts(df, "ids array<int>, starts array<int>, n_bytes bigint" + more, make, id_col, text_col)


def decode(df: DataFrame, path: str | None = None, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` in ``to`` (null ids: null; an equally named column is replaced)."""
    blob = df.sparkSession.sparkContext.broadcast(model_bytes(path))

    @F.pandas_udf("string")
    def text_of(ids):
        model = load_model(blob.value)
        return ids.map(lambda x: None if x is None else model.decode(x.tolist()))

    return df.withColumn(to, text_of(ids_col))


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"), decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_bytes",
        F.element_at("starts", -1).cast("long").alias("spans_end"),
    )

"""Operator 7: personal data, by patterns and a character-level bidirectional LSTM with a CRF.

The patterns give the base spans of four kinds. The network is trained in numpy on windows of at
most ``MAX_WINDOWS`` places of ``max_docs`` documents: places as they stand, labelled by the patterns,
and stretches of text with data planted in them, alone and side by side, in the forms that the
patterns cover and in others (spelled-out addresses, other separators, numbers that run into each
other, at which a pattern stops). It reads overlapping windows around every place that can hold
personal data of these kinds, which all have a digit, an at sign or a spelled-out address; the scores of
overlapping windows are averaged by their distance from the window's rim, and one Viterbi pass
under the CRF's transitions runs over each whole region. Spans of the network that keep clear of
base spans and hold what their kind needs are added.

Defined results: a null or empty text has no spans; texts of any length are read whole; rows of one
id are read on their own; an empty table gives an empty one (the network then stays untrained and
adds nothing); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import map_texts, settle, table

KINDS = ("email", "ip", "card", "phone")
#: Documents that the network is trained on at most, windows of them, stretches with planted data, and passes over these.
MAX_DOCS, MAX_WINDOWS, PLANTED, PASSES = 600, 900, 2200, 8
#: Characters of a place that is taken for training at once.
PLACE = 192
#: Characters of a window, from one window to the next, and around a number and an at sign that may belong to data.
WINDOW, STRIDE, AROUND, AROUND_AT = 64, 32, 24, 56
#: Cells of each direction.
CELLS = 20
TAGS = 1 + 2 * len(KINDS)
#: Symbols: padding, printable ASCII, and three classes of other characters.
SYMBOLS = 1 + 95 + 3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]").search
_PLACES = re.compile(r"[0-9]+|@|\bat\b(?=[^\n]{1,80}?\bdot\b)|\[at\]|\(at\)", re.IGNORECASE)
_MAY_HOLD = re.compile(r"[0-9@]|\bdot\b|[\[(]at[\])]", re.IGNORECASE).search


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans, sorted; leftmost and non-overlapping in each kind."""
    found = []
    if "@" in text:
        ended, at = 0, text.find("@")
        while at >= 0:
            # the local part reaches back over allowed characters, but not into the last match
            run = at
            while run > ended and _LOCAL_CHAR(text[run - 1]):
                run -= 1
            domain = _DOMAIN.match(text, at + 1) if run < at else None
            if domain:
                found.append((run, 0, domain.end()))
                ended = domain.end()
            at = text.find("@", max(at + 1, ended))
    if _ANY_DIGIT(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


_LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-").__contains__


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of the text that the network reads."""
    if not _MAY_HOLD(text):
        return []
    out: list[list[int]] = []
    for m in _PLACES.finditer(text):
        around = AROUND if m.group()[0].isdigit() else AROUND_AT
        a, b = max(0, m.start() - around), min(len(text), m.end() + around)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((codes >= 32) & (codes < 127), codes - 31, 97)
    out[codes < 32] = 96
    out[codes == 0xA0] = 98
    return out


class Tagger:
    """One layer of LSTM in each direction, tag scores, and CRF transitions."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.normal(size=s) * 0.1).astype(np.float32)
        self.p = {"x": f(2, SYMBOLS, 4 * CELLS), "h": f(2, CELLS, 4 * CELLS), "w": f(2 * CELLS, TAGS), "b": np.zeros(TAGS, np.float32), "t": f(TAGS, TAGS)}
        self.p["x"][:, :, CELLS : 2 * CELLS] += 0.5  # remember at first

    def read(self, x: np.ndarray, keep: bool = False):
        """Tag scores (B, T, TAGS) of windows (B, T)."""
        p, (b, t) = self.p, x.shape
        both = np.stack([x, x[:, ::-1]])
        z = np.stack([p["x"][d][both[d].T] for d in (0, 1)])  # 2, T, B, 4H
        h = c = np.zeros((2, b, CELLS), np.float32)
        hs, seen = np.empty((2, t, b, CELLS), np.float32), []
        for k in range(t):
            a = z[:, k] + h @ p["h"]
            s = 1 / (1 + np.exp(-a[..., : 3 * CELLS]))
            g = np.tanh(a[..., 3 * CELLS :])
            i, f, o = s[..., :CELLS], s[..., CELLS : 2 * CELLS], s[..., 2 * CELLS :]
            old_c, old_h = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[:, k] = h
            if keep:
                seen.append((i, f, o, g, old_c, tc, old_h))
        out = np.concatenate([hs[0], hs[1, ::-1]], -1)  # T, B, 2H
        scores = (out @ p["w"] + p["b"]).transpose(1, 0, 2)
        return (scores, out, seen, both) if keep else scores

    def gradients(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        p, (b, t) = self.p, x.shape
        scores, out, seen, both = self.read(x, True)
        e, trans = scores.transpose(1, 0, 2), p["t"]  # T, B, K
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha, beta = [e[0]], [np.zeros_like(e[0])]
        for k in range(1, t):
            alpha.append(lse(alpha[-1][:, :, None] + trans, 1) + e[k])
        for k in range(t - 1, 0, -1):
            beta.append(lse(trans + (e[k] + beta[-1])[:, None, :], 2))
        beta = beta[::-1]
        z = lse(alpha[-1], 1)
        de, dt = np.empty_like(e), np.zeros_like(trans)
        rows = np.arange(b)
        gold = e[0, rows, tags[:, 0]].copy()
        for k in range(t):
            de[k] = np.exp(alpha[k] + beta[k] - z[:, None])
            de[k, rows, tags[:, k]] -= 1
            if k:
                pair = np.exp(alpha[k - 1][:, :, None] + trans + (e[k] + beta[k])[:, None, :] - z[:, None, None])
                dt += pair.sum(0)
                np.subtract.at(dt, (tags[:, k - 1], tags[:, k]), 1)
                gold += trans[tags[:, k - 1], tags[:, k]] + e[k, rows, tags[:, k]]
        de /= b
        d = {"w": np.einsum("tbh,tbk->hk", out, de), "b": de.sum((0, 1)), "t": dt / b}
        dout = de @ p["w"].T
        dh_all = np.stack([dout[..., :CELLS], dout[::-1, :, CELLS:]])
        d["x"], d["h"] = np.zeros_like(p["x"]), np.zeros_like(p["h"])
        dh = dc = np.zeros((2, b, CELLS), np.float32)
        steps = np.empty((2, t, b, 4 * CELLS), np.float32)
        for k in range(t - 1, -1, -1):
            i, f, o, g, old_c, tc, old_h = seen[k]
            dh = dh + dh_all[:, k]
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * g * i * (1 - i), dc * old_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], -1)
            steps[:, k] = da
            d["h"] += old_h.transpose(0, 2, 1) @ da
            dh, dc = da @ p["h"].transpose(0, 2, 1), dc * f
        for way in (0, 1):
            is_symbol = (np.arange(SYMBOLS)[:, None] == both[way].T.reshape(1, -1)).astype(np.float32)
            d["x"][way] = is_symbol @ steps[way].reshape(-1, 4 * CELLS)
        return float((z - gold).mean()), d

    def fit(self, x: np.ndarray, tags: np.ndarray, passes: int = PASSES, batch: int = 64, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Adam over shuffled batches; the mean loss of each pass."""
        r, losses, step = np.random.default_rng(seed), [], 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for turn in range(passes):
            order, lost = r.permutation(len(x)), []
            for at in range(0, len(x), batch):
                step += 1
                loss, d = self.gradients(x[order[at : at + batch]], tags[order[at : at + batch]])
                lost.append(loss)
                norm = np.sqrt(sum(float((g * g).sum()) for g in d.values()))
                now = rate * (1 - turn / passes)
                for k, g in d.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(lost)))
        return losses

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The best tags of one region with scores (T, TAGS)."""
        trans, best, back = self.p["t"], e[0], []
        for row in e[1:]:
            total = best[:, None] + trans
            back.append(total.argmax(0))
            best = total.max(0) + row
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def window_starts(length: int) -> list[int]:
    return [*range(0, max(1, length - WINDOW), STRIDE), max(0, length - WINDOW)] if length > WINDOW else [0]


def read_regions(tagger: Tagger, parts: list[str], block: int = 512) -> list[list[int]]:
    """Tags of each part: windows in blocks, overlaps averaged, one Viterbi pass over the whole part."""
    codes = [symbols(p) for p in parts]
    jobs = [(k, s) for k, c in enumerate(codes) for s in window_starts(len(c))]
    weight = np.minimum(np.arange(WINDOW) + 1, np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    sums = [np.zeros((len(c), TAGS), np.float32) for c in codes]
    total = [np.zeros((len(c), 1), np.float32) for c in codes]
    for at in range(0, len(jobs), block):
        some = jobs[at : at + block]
        x = np.zeros((len(some), WINDOW), np.int64)
        for row, (k, s) in enumerate(some):
            part = codes[k][s : s + WINDOW]
            x[row, : len(part)] = part
        for (k, s), e in zip(some, tagger.read(x), strict=True):
            n = min(WINDOW, len(codes[k]) - s)
            sums[k][s : s + n] += e[:n] * weight[:n]
            total[k][s : s + n] += weight[:n]
    return [tagger.viterbi(s / t) if len(s) else [] for s, t in zip(sums, total, strict=True)]


def tag_spans(tags: list[int]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans that tags begin and continue."""
    out, open_at, kind = [], None, None
    for k, t in enumerate([*tags, 0]):
        if open_at is not None and t != 2 + 2 * kind:
            out.append((open_at, kind, k))
            open_at = None
        if t and open_at is None and (t % 2 or not out or out[-1][2] < k):
            open_at, kind = k, (t - 1) // 2
    return out


def plausible(kind: int, span: str) -> bool:
    """Whether a span that the network found holds what its kind needs."""
    numbers = re.findall("[0-9]+", span)
    digits = sum(map(len, numbers))
    if kind == 0:
        return bool(re.search(r"(?:@|\bat\b).*?[A-Za-z0-9].*?(?:\.|\bdot\b).*?[A-Za-z0-9]", span, re.IGNORECASE | re.DOTALL))
    if kind == 1:
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    if re.search("[A-Za-z]", span) and (kind == 2 or not span[:3].lower() == "tel"):
        return False
    if kind == 2:
        return 14 <= digits <= 19 and luhn("".join(numbers))
    return 10 <= digits <= 15 and len(numbers) > 1


def all_spans(texts: list[str | None], tagger: Tagger | None) -> tuple[list, list]:
    """Base spans and all spans of each text."""
    base = [base_spans(t or "") for t in texts]
    every = [list(b) for b in base]
    if tagger is not None:
        jobs = [(k, a, t[a:b]) for k, t in enumerate(texts) if t for a, b in regions(t)]
        for (k, a, part), tags in zip(jobs, read_regions(tagger, [j[2] for j in jobs]), strict=True):
            for s, kind, e in tag_spans(tags):
                lead, trail = len(part[s:e]) - len(part[s:e].lstrip()), len(part[s:e]) - len(part[s:e].rstrip())
                s, e = s + lead, e - trail
                clear = all(a + e <= x or a + s >= y for x, _, y in base[k])
                if e > s and clear and plausible(kind, part[s:e]):
                    every[k].append((a + s, kind, a + e))
    return base, [sorted(x) for x in every]


def rewritten(kind: int, span: str, r: random.Random) -> str:
    """Another way in which people write the same datum."""
    if kind == 0:
        at, dot = r.choice([(" at ", " dot "), (" AT ", " DOT "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), (" @ ", ".")])
        made = span.replace("@", at).replace(".", dot)
        return made.upper() if r.random() < 0.25 else made
    if kind == 1:
        return span.replace(".", r.choice(["[.]", " . ", "(.)", "[dot]"]))
    digits = re.sub("[^0-9]", "", span)
    if kind == 2:
        return r.choice([".", " - ", "_", "  ", "/"]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    cut = len(digits) - r.choice((7, 8))
    area, rest = digits[max(0, cut - 3) : cut], digits[cut:]
    return r.choice([f"00{digits[: max(1, cut - 3)]} {area} {rest}", f"({area}) {rest[:3]}-{rest[3:]}", f"+{digits[:2]}/{digits[2:5]}/{digits[5:]}", f"0{area}/{rest}", span.replace("+", "00 ")])


def luhn_number(r: random.Random, length: int) -> str:
    """A number whose last digit makes it pass."""
    head = "".join(r.choice("0123456789") for _ in range(length - 1))
    return next(head + d for d in "0123456789" if luhn(head + d))


def datum(kind: int, words: list[str], r: random.Random) -> str:
    """A datum as the patterns know it, its names made of the corpus's words."""
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: r.choice(words)
    if kind == 0:
        local = r.choice([name(), f"{name()}.{name()}", f"{name()}{number(2)}", f"{name()}.{number(2)}", f"{name()}_{name()}"])
        return f"{local}@{name()}{r.choice(['', number(1)])}.{r.choice(['', name() + '.', 'example.'])}{r.choice(['com', 'org', 'net', 'de', 'example'])}".lower()
    if kind == 1:
        return ".".join(str(r.randrange(256)) for _ in range(4))
    if kind == 2:
        digits = luhn_number(r, r.choice((14, 15, 16, 16, 16, 16, 19)))
        return r.choice(["", "", " ", "-"]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    country, area, rest = str(r.randrange(1, 99)), number(3), number(7)
    return r.choice([f"+{country} ({area}) {rest[:3]}-{rest[3:]}", f"+{country} {area} {rest}", f"+{country}-{area}-{rest[:3]}-{rest[3:]}", f"+{country}{area}{rest}"])


def planted(stretch: str, words: list[str], r: random.Random) -> tuple[str, list[int]]:
    """A stretch of text with one to three data put in at a border of words, alone or side by side, and its tags."""
    cuts = [m.start() for m in re.finditer(r"\s", stretch)] or [len(stretch)]
    at = r.choice(cuts)
    text, tags = stretch[:at], [0] * at
    for k in range(r.choice((1, 1, 2, 3))):
        kind = r.randrange(len(KINDS))
        span = datum(kind, words, r)
        if r.random() < 0.45:
            span = rewritten(kind, span, r)
        gap = " " if k == 0 or r.random() < 0.6 else f" {r.choice(words)} "
        text += gap + span
        tags += [0] * len(gap) + [1 + 2 * kind] + [2 + 2 * kind] * (len(span) - 1)
    return text + stretch[at:], tags + [0] * (len(stretch) - at)


def unclear(text: str) -> bool:
    """Whether a pattern gives up a run of digits here, so that its labels can't be trusted."""
    spans = base_spans(text)
    runs = [*_CARD.finditer(text), *_PHONE.finditer(text)]
    return any(sum(c.isdigit() for c in m.group()) >= 10 and not any(s < m.end() and m.start() < e for s, _, e in spans) for m in runs)


def windows_of(text: str, tags: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for s in window_starts(len(text)):
        x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        piece = symbols(text[s : s + WINDOW])
        x[: len(piece)], y[: len(piece)] = piece, tags[s : s + WINDOW]
        out.append((x, y))
    return out


def training_windows(places: list[str], stretches: list[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows with tags: places as they stand, labelled by the patterns, and stretches with data planted in them."""
    r, out = random.Random(seed), []
    for part in places:
        if unclear(part):
            continue
        tags = [0] * len(part)
        for s, kind, e in base_spans(part):
            tags[s:e] = [1 + 2 * kind] + [2 + 2 * kind] * (e - s - 1)
        out += windows_of(part, tags)
    r.shuffle(out)
    out = out[:MAX_WINDOWS]
    words = sorted({w for t in stretches for w in re.findall(r"[A-Za-z]{2,12}", t)}) or ["ann"]
    for k in range(PLANTED if stretches else 0):
        text, tags = planted(stretches[k % len(stretches)], words, r)
        first = next(i for i, t in enumerate(tags) if t)
        # one window that holds the data, at any place in it
        start = max(0, min(first - r.randrange(0, WINDOW // 2), len(text) - WINDOW))
        out += windows_of(text[start : start + WINDOW], tags[start : start + WINDOW])
    return (np.stack([x for x, _ in out]), np.stack([y for _, y in out])) if out else (np.zeros((0, WINDOW), np.int64),) * 2


def train(docs: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """A tagger fitted to a sample of places and stretches of the documents of least hash (None: there are none).

    The sample is of all places of these documents, by least hash; its size bounds what comes to the driver.
    """
    may = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(id_col).alias("chosen_id")).where("chosen_id is not null").distinct()
    chosen = settle(may.orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(max_docs))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("chosen_id")).select(F.xxhash64("chosen_id").alias("h"), "t")

    def cut(batches):
        import pandas as pd

        for part in batches:
            # places are cut where the texts are, so that the driver gets a sample of them
            got, at = [], 0
            for h, t in zip(part["h"], part["t"], strict=True):
                found = regions(t)
                got += [(int(h), True, t[s : min(b, s + PLACE)]) for a, b in found for s in range(a, b, PLACE)]
                free = [(x, y) for x, y in zip([0, *(b for _, b in found)], [*(a for a, _ in found), len(t)], strict=True) if y - x > WINDOW]
                got += [(int(h), False, t[s : min(y, s + 2 * WINDOW)]) for x, y in free for s in range(x, y, 2 * WINDOW)]
            yield pd.DataFrame(got, columns=["h", "place", "s"]).astype({"h": "int64", "place": "bool", "s": "str"})

    found = settle(rows.mapInPandas(cut, "h bigint, place boolean, s string"))
    order = [F.xxhash64("h", "s"), "s"]
    take = lambda place, n: [r["s"] for r in found.where(F.col("place") == place).orderBy(*order).limit(n).collect()]
    places = take(True, MAX_WINDOWS)
    if not places:
        return None
    tagger = Tagger()
    tagger.fit(*training_windows(places, take(False, PLANTED)))
    return tagger


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(df: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``base`` and ``spans``: arrays of (kind, start, end) in code points, end exclusive."""
    sent = df.sparkSession.sparkContext.broadcast(tagger)

    def make():
        named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

        def run(texts):
            base, every = all_spans(texts, sent.value)
            return [[named(b) for b in base], [named(x) for x in every]]

        return run

    kind = "array<struct<kind:string,start:int,end:int>>"
    return map_texts(df, f"base {kind}, spans {kind}", make, id_col, text_col)


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redactor(spark: SparkSession, tagger: Tagger | None):
    """A column function: the text with every span replaced by its kind in brackets."""
    sent = spark.sparkContext.broadcast(tagger)

    @F.pandas_udf("string")
    def redact(texts):
        import pandas as pd

        given = [t if isinstance(t, str) else None for t in texts]
        out = []
        for at in range(0, len(given), 256):
            part = given[at : at + 256]
            for t, spans in zip(part, all_spans(part, sent.value)[1], strict=True):
                done, last = [], 0
                for s, kind, e in spans:
                    if s >= last:
                        done += [t[last:s], f"[{KINDS[kind].upper()}]"]
                    elif e <= last:
                        continue
                    last = e
                out.append(None if t is None else "".join([*done, t[last:]]))
        return pd.Series(out, dtype="object")

    return redact


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(_written(spans).encode()).hexdigest()

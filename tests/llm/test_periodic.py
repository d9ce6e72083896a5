"""Runs of words against a search through all periods."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from lectern.llm import periodic


def brute_runs(words):
    """Every maximal stretch of each period, of which the smallest period counts."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(6, 4 * p):
                found.setdefault((s, i + p - s), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def streams():
    r = random.Random(3)
    yield from ([], [1], [1] * 5, [1] * 6, [1] * 700, [1, 2] * 300, [1] * 90 + [2] + [1] * 90, ([1] * 30 + [2]) * 9, ([1, 1, 2] * 8 + [3]) * 7)
    a, b = [1], [1, 2]
    for _ in range(12):
        a, b = b, b + a
    yield b  # a Fibonacci word
    yield [bin(k).count("1") % 2 for k in range(1024)]  # a Thue-Morse word
    for k in range(300):
        n = r.randrange(1, 250)
        words = [r.randrange(r.choice((1, 2, 3, 50))) for _ in range(n)]
        for _ in range(r.randrange(4)):
            s, p = r.randrange(n), r.randrange(1, 1 + n // 4) if n > 4 else 1
            for i in range(s + p, min(n, s + p * r.randrange(2, 9) + r.randrange(p))):
                words[i] = words[i - p]
        yield words


def test_catchers():
    for words in streams():
        want = brute_runs(words)
        got = sorted((s, e - s, p) for s, e, p in periodic.Catchers().append(np.array(words, np.int64), last=True))
        assert got == want, words


def test_catchers_take_words_one_by_one():
    """However the words arrive, the runs are the same, and each is told once."""
    r = random.Random(4)
    for k, words in enumerate(streams()):
        if k > 60:
            break
        for size in (1, 2, 7, 40):
            catchers, got, at = periodic.Catchers(), [], 0
            while at < len(words):
                n = size if size < 40 else r.randrange(1, 60)
                got += catchers.append(np.array(words[at : at + n], np.int64))
                at += n
            got += catchers.append(np.zeros(0, np.int64), last=True)
            assert sorted((s, e - s, p) for s, e, p in got) == brute_runs(words), (size, words)


def test_long_streams():
    """A period of thousands of words in a million, beside a million equal words."""
    r = np.random.default_rng(5)
    words = r.integers(0, 50_000, 1_000_000)
    words[100_000:160_000] = np.resize(words[100_000:112_345], 60_000)
    assert words[99_999] != words[99_999 + 12_345] and words[160_000] != words[160_000 - 12_345]
    assert periodic.Catchers().append(np.concatenate([words, np.full(1_000_000, 7)]), last=True)[::-1] in (
        [(100_000, 160_000, 12_345), (1_000_000 - int(words[-1] == 7), 2_000_000, 1)],
    )


TEXTS = [None, "", " \n", "la la la la la", "la la la la la la", "a b a b a b a b c", "x " * 9000, "é é\té\né\x0bé\x0cé é", "a\x00b a\x00b a\x00b a\x00b a\x00b a\x00b"]
SCHEMA = "doc_id bigint, text string, runs string, start string, length string, period string, w string, n string, g string, id string, collapsed string"


def test_find_runs(spark):
    docs = spark.createDataFrame([(k, t, *["z"] * 9) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], *["z"] * 9), (None, TEXTS[4], *["z"] * 9)], SCHEMA)
    rows = periodic.find_runs(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        words = (TEXTS[r["doc_id"] if r["doc_id"] is not None else 4] or "").encode().split()
        assert [tuple(x) for x in r["runs"]] == brute_runs(words) and r["n_words"] == len(words)
    assert {r["doc_id"]: r["collapsed"] for r in rows}[5] == "a b c"
    assert periodic.find_runs(docs.limit(0)).count() == 0


def want_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.mark.parametrize("extra", [False, True])
def test_op11(spark, small, tmp_path, extra):
    """All documents; and nulls, empty texts and short ones under ids of every remainder."""
    if extra:
        rows = [(k, TEXTS[k % len(TEXTS)] if k % 3 else f"w{k} " * (k % 40)) for k in range(400)]
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
        got = periodic.op11_periodic(spark, str(tmp_path))
    else:
        rows = [(d, t) for d, t in duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall() if len((t or "").split()) < 4000]
        got = periodic.op11_periodic(spark, small)
    found = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert len(found) >= len(rows) and got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for d, t in rows:
        assert found[d] == want_row(d, t)

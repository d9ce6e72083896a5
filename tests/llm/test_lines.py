"""Repeated lines against a plain count of all keys."""

import collections
import random

import numpy as np
import oracle
import pytest

from lectern.llm import lines

SCHEMA = "doc_id bigint, text string, key string, keys string, id string, of string, kept string, first string, same string, segment string"
SHARED = "This line stands in many documents."


def brute(rows, least=lines.LEAST):
    """Kept text, lines and dropped lines of each row; ids in order, no id last."""
    rank = lambda d: (d is None, d or 0)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(rank(d))
    out = []
    for d, t in rows:
        given = (t or "").split("\n")
        kept = [x for x in given if not (len(held.get(key(x), ())) > 1 and min(held[key(x)]) < rank(d))]
        out.append((d, "\n".join(kept), len(given), len(given) - len(kept)))
    return sorted(out, key=repr)


def some_rows():
    r = random.Random(7)
    pool = [f"Shared sentence number {k} of the pool" for k in range(60)] + ["short", "", "  ", "ÄÖÜ ÄÖÜ äö", "ÄÖÜäöüßéèê"]
    rows = [(k, "\n".join(r.choice(pool) if r.random() < 0.3 else f"own line {k} {r.random()}" for _ in range(r.randrange(1, 12)))) for k in range(300)]
    rows += [(k, f" \t{SHARED.upper()}\r\nown line of {k}\n{SHARED}\x0b") for k in range(300, 700)]
    rows += [(700, None), (701, ""), (702, "\n\n"), (703, "x" * 300_000 + "\n" + SHARED), (704, "x" * 300_000), (705, "only here twice\nonly here twice"), (705, "only here twice"), (None, SHARED + "\nno id, no place"), (None, "no id, no place"), (706, "123456789\n1234567890"), (707, "123456789\n1234567890")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("most_bits", [lines.MOST_BITS, 0])
def test_dedup_lines(spark, most_bits):
    """With filters, and as beyond the lines that they serve; hot keys are those of 400 documents."""
    rows = some_rows()
    df = spark.createDataFrame([(d, t, *["z"] * 8) for d, t in rows], SCHEMA).repartition(7)
    got = lines.dedup_lines(df, most_bits=most_bits).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert lines.dedup_lines(df.limit(0), most_bits=most_bits).count() == 0


def test_joined_by_shuffle(spark, monkeypatch):
    """The same rows when lost keys are too many to be sent to all, and when half of the keys are hot."""
    monkeypatch.setattr(lines, "FEW_ROWS", 0)
    monkeypatch.setattr(lines, "HOT", 100_000)
    rows = some_rows()
    assert sorted((tuple(r) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr) == brute(rows)


def test_filter_passes_all_repeats_and_few_others(spark):
    """Keys of two tasks, of one task twice, and 20,000 keys of one document each."""
    rows = [(k, f"single line {k:06d}\n" + (f"pair of lines {k // 2:06d}" if k < 2000 else "")) for k in range(20_000)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(5)
    bits = lines.filter_bits(40_000)
    told = lines.twice_seen(df, bits)

    def suspected(key):
        a, b = (int(x[0]) for x in lines.places(np.array([lines.xxh3_64_intdigest(key)], np.uint64), bits))
        return bool(told[a >> 3] >> (a & 7) & told[b >> 3] >> (b & 7) & 1)

    assert all(suspected(b"pair of lines %06d" % k) for k in range(1000))
    assert sum(suspected(b"single line %06d" % k) for k in range(20_000)) < 40
    assert lines.suspects(df).count() < 2040


def test_op12(spark, small):
    assert oracle.compare(lines.op12_lines(spark, small), lines.OP12_SQL, oracle.connect(small)) == ""

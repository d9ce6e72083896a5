"""Paragraph kinds against a model that scans from every heading, as arrays and as rows."""

import math
import random
import re

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import classify

YEAR = re.compile(r"\b(?:1[6-9]\d\d|20\d\d)\b")


def model(paras):
    """Sections and the list at the end, for paragraphs that are neither tables nor noise."""
    kinds, n, total = [None] * len(paras), len(paras), sum(map(len, paras)) or 1
    cite = [bool(YEAR.search(p)) or "Press" in p for p in paras]
    prose = [len(p) >= 200 and not c for p, c in zip(paras, cite, strict=True)]
    for i, p in enumerate(paras):
        if sum(map(len, paras[:i])) / total < 0.3 or not p.startswith("References") or (len(p) > 10 and not p.startswith("References\n")):
            continue
        if i == n - 1:
            kinds[i] = "references"
            continue
        last, run, j = i, 0, i + 1
        while j < n and run < 2:
            run = run + 1 if prose[j] else 0
            last = last if prose[j] else j
            j += 1
        if sum(cite[i : last + 1]) >= 2:
            kinds[i : last + 1] = ["references"] * (last + 1 - i)
    start = n
    while start and not prose[start - 1] and (cite[start - 1] or len(paras[start - 1]) < 60):
        start -= 1
    tail = range(start, n)
    entries = sum(bool(re.match(r"[A-Z][a-z]+, [A-Z]\. |\d{1,3}\. ", paras[k])) and cite[k] for k in tail)
    numbers = len(re.findall(r"(?:^|\s)\d{1,3}\.\s+[A-Z]", "\n".join(paras[k].replace("\n", " ") for k in tail)))
    if len(tail) and (entries >= 3 or numbers >= 3) and sum(cite[k] for k in tail) >= math.ceil(0.6 * len(tail)):
        kinds[start:] = [k or "references" for k in kinds[start:]]
    return kinds


def documents():
    r = random.Random(9)
    prose = "The ship went along the shore and nobody on board said a word about the weather that day. " * 3
    shapes = {
        "prose": lambda: prose.strip(), "short": lambda: "A few words only here.", "head": lambda: "References", "long head": lambda: "References\n" + prose.strip(),
        "entry": lambda: "Smith, J. A title of a work. University Press, 1999.", "cite": lambda: "See the study of 2004 for what is meant.", "number": lambda: f"{r.randrange(1, 99)}. Another thing was said there in 1984 by them.", "ends": lambda: "It was told in 1971 on page 12.",
    }
    for _ in range(400):
        weights = [r.random() for _ in shapes]
        yield [shapes[k]() for k in r.choices(list(shapes), weights, k=r.randrange(1, 14))]


def test_kinds(spark):
    docs = list(documents())
    df = spark.createDataFrame([(k, "\n\n".join(d)) for k, d in enumerate(docs)], "doc_id int, text string").repartition(4)
    want = {(k, p): kind for k, d in enumerate(docs) for p, kind in enumerate(model(d))}
    assert sum(v is not None for v in want.values()) > 300
    got = {(r["doc_id"], r["p"]): r["kind"] for r in classify.paragraph_kinds(df).collect()}
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {}
    paras = df.select("doc_id", F.posexplode(T.raw_paragraphs(F.col("text"))).alias("p", "raw"))
    rows = {(r["doc_id"], r["p"]): r["kind"] for r in classify.kinds_of_rows(paras).collect()}
    assert rows == got
    assert classify.kinds_of_rows(paras.limit(0)).count() == 0

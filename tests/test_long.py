"""Documents and words far longer than usual: work grows in proportion."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import search, segment


def test_spans():
    """Passages against a walk that adds up words one by one."""
    r = random.Random(2)
    for _ in range(200):
        counts = [r.choice((1, 3, 20, 150)) for _ in range(r.randrange(0, 60))]
        want, i, n = [], 0, len(counts)
        while i < n:
            end = i
            while end < n - 1 and sum(counts[i : end + 1]) < 110:
                end += 1
            want.append({"start": i, "end": end})
            if end == n - 1:
                break
            i = max(i + 1, (i + end + 1) // 2)
        assert segment.spans_of(np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])) == want


def test_long_document(spark):
    """A document of a million words beside a short one."""
    line = "The ship went along the quiet shore until the evening came. " * 5
    docs = spark.createDataFrame([(1, 1), (2, 18_000)], "doc_id int, n int").select("doc_id", F.repeat(F.lit(line), F.col("n")).alias("text"))
    began = time.time()
    got = {r["doc_id"]: (r["n"], r["last"]) for r in segment.passages(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end").alias("last")).collect()}
    assert got[1] == (1, 4) and got[2][1] == 89_999 and got[2][0] > 15_000
    assert time.time() - began < 120


def test_long_word(spark):
    """A word of 300,000 characters is found by what it holds at its beginning, its end, and over the borders of its pieces."""
    r = random.Random(3)
    word = "".join(r.choice("abcdefghij") for _ in range(300_000))
    sents = spark.createDataFrame([(1, 0, f"see {word} there"), (2, 0, "nothing here"), (3, 0, word[:1000])], "doc_id int, pos int, text string").withColumn("folded", T.fold(F.col("text")))
    asked = [word[:12], word[-12:], word[250:262], word[255:270], word[299_000:299_020], "there", "zz"]
    queries = spark.createDataFrame([(k, [q]) for k, q in enumerate(asked)], "qid int, terms array<string>")
    got = {(x["qid"], x["doc_id"]) for x in search.containing(sents, queries, ["doc_id", "pos"]).collect()}
    assert got == {(k, d) for k, q in enumerate(asked) for d, t in ((1, f"see {word} there"), (2, "nothing here"), (3, word[:1000])) if q in t}

"""Faster patterns against the plain ones that they stand for."""

import random

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import classify

PLAIN = ((r"\r\n?", "\n"), ("­", ""), (r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2"), (r"[ \t\f\x0B]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"))


def test_same_as_plain_patterns(spark):
    r = random.Random(7)
    bits = ["a", "b-\nc", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\f ", "­", ".", " .", "(", ")", "(2001)", "(see Boyd, 1976; Coe 1999)", "[1, 2]", "(pp. 3-4)", "end.12", "HTTPS://x.y", "www.a", "Doi: x", "1999", "n. d.", "Vol.", "xVol.", "é2001", "Press", "　", " "]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randrange(0, 14)))) for k in range(4000)]
    df = spark.createDataFrame(rows, "id int, t string")
    c = F.col("t")
    clean, spoken = c, c
    for pattern, to in PLAIN:
        clean = F.regexp_replace(clean, pattern, to)
    for pattern, to in T.SPEAKABLE:
        spoken = F.regexp_replace(spoken, pattern, to)
    spoken = T.trim(spoken)
    years, published = (p[p.index(")") + 1 :] for p in (classify.YEAR, classify.PUBLISHED))
    pairs = {
        "clean": (T.clean_text(c), T.trim(clean)), "flat": (classify.flat(c), T.trim(F.regexp_replace(c, r"\s+", " "))),
        "spoken": (T.speakable(c), F.when(spoken.rlike("[A-Za-z]{2}"), spoken).otherwise(c)), "cite": (classify.citeish(c), c.rlike(years) | c.rlike(published) | c.rlike(r"https?:|www\.")),
    }
    told = df.agg(*(F.count_if(~a.eqNullSafe(b)).alias(n) for n, (a, b) in pairs.items()))
    assert told.first().asDict() == dict.fromkeys(pairs, 0)
    assert df.where(c.rlike(T.MARKED)).count() > 1000 and classify.YEAR.startswith("(?=")


def test_a_text_is_cleaned_once(spark):
    """Kinds and sentences come from one cleaned text."""
    plan = classify.narration_plan(spark.createDataFrame([(1, "One. Two.")], "doc_id int, text string"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("­") == 1

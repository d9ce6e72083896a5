"""Page numbers and assignments against a walk over each document; work in proportion to its pages."""

import random

from pyspark.sql import functions as F

from lectern.operators import classify, pages


def walked(detected):
    """(n, sure) of each page: the nearest page whose offset another one shares, the earlier of equals."""
    offs = [None if d is None else d - p for p, d in enumerate(detected)]
    offs = [o if o is not None and offs.count(o) >= 2 else None for o in offs]
    known = [p for p, o in enumerate(offs) if o is not None]
    near = [min(known, key=lambda k: (abs(k - p), k)) for p in range(len(offs))] if known else [None] * len(offs)
    return [(None if k is None else p + offs[k], offs[p] is not None) for p, k in enumerate(near)]


def test_numbers_walked(spark):
    r = random.Random(5)
    docs = [[r.choice((None, p + 3, p + 40, r.randrange(900))) for p in range(r.randrange(1, 40))] for _ in range(120)]
    rows = [(d, p, x) for d, xs in enumerate(docs) for p, x in enumerate(xs)]
    r.shuffle(rows)
    got = {(x["doc"], x["page"]): (x["n"], x["sure"]) for x in pages.infer_page_numbers(spark.createDataFrame(rows, "doc int, page int, detected int")).collect()}
    assert got == {(d, p): v for d, xs in enumerate(docs) for p, v in enumerate(walked(xs))}


def test_work_in_proportion(spark):
    """No frame that is summed anew for each row, and numbers made once for all that is asked of them."""
    detected = spark.range(2000).select((F.col("id") % 2).alias("doc"), F.floor(F.col("id") / 2).alias("page"), (F.floor(F.col("id") / 2) + 100).alias("detected"))
    ranges = spark.createDataFrame([(0, [(105, 106)]), (1, [(5, 6)])], "doc bigint, ranges array<struct<a:int,b:int>>")
    skips = pages.unassigned_pages(pages.infer_page_numbers(detected), ranges)
    plan = skips._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan and plan.count("Range (0, 2000") == 1
    assert sorted(r["page"] for r in skips.where("not skip").collect()) == [5, 6] and skips.count() == 1000


def test_unassigned_paragraphs_of_a_plan(spark):
    """Paragraphs that are not assigned, in any order and twice, of documents with others; kept columns stay; nothing is joined by sentence."""
    docs = spark.createDataFrame([(1, "One. Two.\n\nThree.\n\nFour.", "x"), (2, "Five.\n\nSix.", "y"), (3, None, "z")], "doc_id int, text string, at string")
    left_out = spark.createDataFrame([(1, 2), (1, 0), (1, 2), (2, 9), (4, 0)], "doc_id int, p bigint")
    rows = classify.narration_plan(docs, cleanup=False, unassigned=left_out, keep=("at",))
    got = {(r["doc_id"], r["speak"]): (r["skip"], r["at"]) for r in rows.collect()}
    assert got == {(1, "One."): ("unassigned", "x"), (1, "Two."): ("unassigned", "x"), (1, "Three."): (None, "x"), (1, "Four."): ("unassigned", "x"), (2, "Five."): (None, "y"), (2, "Six."): (None, "y")}

"""What takes work is made once: course scripts, searched sentences, terms of a text."""

from lectern.operators import package, segment
from lectern.plans import package_queries, text_queries
from lectern.streaming import index


def test_scripts_read_once(spark, small, monkeypatch):
    plans, settle = [], package.settle
    monkeypatch.setattr(package, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
    package_queries.built(spark, small)
    assert sum("COURSE_DATA" in p for p in plans) == 1


def test_sentences_cut_once(spark, small, monkeypatch):
    calls, sentences = [], segment.sentences
    monkeypatch.setattr(segment, "sentences", lambda *a, **k: calls.append(a) or sentences(*a, **k))
    text_queries.highlight(spark, small)
    assert len(calls) == 1


def test_terms_made_once(spark):
    counts = index.term_counts(spark.createDataFrame([(1, "The winds of the sea, sea"), (2, None), (3, "")], "doc_id bigint, text string"))
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("'s$") == 1
    assert {tuple(r) for r in counts.collect()} == {("wind", 1, 1), ("sea", 1, 2)}

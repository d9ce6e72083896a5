"""Edits, completion, answers without passages, moved notes."""

from pyspark.sql import functions as F

from lectern.operators import reader


def test_questions_without_passages_are_not_found(spark):
    asked = spark.createDataFrame([(1,), (2,)], "qid int")
    found = spark.createDataFrame([(1, 7), (1, 7), (1, 8)], "qid int, doc_id int")
    rows = {r.qid: r for r in reader.answer_states(asked, found).collect()}
    assert (rows[1].passages, rows[1].readings, rows[1].coverage, rows[1].answer) == (3, 2, None, None)
    assert (rows[2].passages, rows[2].readings, rows[2].coverage, rows[2].answer) == (0, 0, "not_found", reader.NO_ANSWER)
    notice = spark.range(1).select(*(reader.coverage_notice(F.lit(c)) for c in ("not_found", "partial", "answered"))).first()
    assert list(notice) == [reader.NOTICES["not_found"], reader.NOTICES["partial"], None]


def test_edit_and_toggle(spark):
    stored = spark.createDataFrame([(1, "a b", 5, [0]), (2, "c", 4, [0]), (3, None, 3, [0])], "doc_id int, text string, position int, page_starts array<int>")
    edits = spark.createDataFrame([(1, "a b  "), (2, "c d e"), (3, None), (9, "x")], "doc_id int, text string")
    rows = {r.doc_id: r for r in reader.edited(stored, edits).collect()}
    assert len(rows) == 3
    assert (rows[1].changed, rows[1].position, rows[1].page_starts, rows[1].word_count) == (False, 5, [0], 2)
    assert (rows[2].changed, rows[2].position, rows[2].page_starts, rows[2].word_count) == (True, 0, None, 3)
    assert (rows[3].changed, rows[3].position, rows[3].text) == (False, 3, None)
    docs = spark.createDataFrame([(1, True, 5), (2, False, 6)], "doc_id int, completed boolean, position int")
    set_ = spark.createDataFrame([(1, True, 1), (1, False, 2)], "doc_id int, completed boolean, version int")
    assert sorted(map(tuple, reader.toggled(docs, set_).collect())) == [(1, False, 0), (2, False, 6)]


def test_moved_notes_stay_in_the_text(spark):
    cases = [(0, 1, 5, "start", 1, 0, 1), (1, 1, 5, "start", -1, 1, 1), (3, 4, 5, "end", 1, 3, 4), (2, 2, 5, "end", -1, 2, 2), (1, 3, 5, "start", -1, 2, 3), (1, 3, 5, "end", 1, 1, 4)]
    df = spark.createDataFrame(cases, "a int, b int, n int, edge string, delta int, first int, last int")
    first, last = reader.moved(F.col("a"), F.col("b"), F.col("n"), F.col("edge"), F.col("delta"))
    assert df.where((first != F.col("first")) | (last != F.col("last"))).count() == 0


def test_every_file_comes_once(spark):
    refs = spark.createDataFrame([("a2", 2, 1), ("a2", 1, 3), ("zz", 1, 1)], "path string, module int, item int")
    files = spark.createDataFrame([("a2",), ("a10",), ("a3",)], "path string")
    rows = reader.linked_files(refs, files, ["module", "item"]).orderBy("leftover", "natural").collect()
    assert [(r.path, r.module, r.item, r.leftover) for r in rows] == [("a2", 1, 3, False), ("a3", None, None, True), ("a10", None, None, True)]

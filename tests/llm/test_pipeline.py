"""The corpus pipeline, stage by stage, against plain Python."""

import collections
import re

import oracle

import corpus_pipeline as cp
from lectern.llm import decontam, pieces, pii, toxicity
from lectern.llm.common import settle, table
from test_similar import brute


def test_pipeline(spark, small):
    con = oracle.connect(small)
    docs = table(spark, small, "documents")
    columns = docs.columns
    texts = dict(con.execute("select doc_id, text from documents").fetchall())
    items = con.execute("select item_id, text from benchmark").fetchall()

    labels = table(spark, small, "labels")
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    one = settle(cp.drop_toxic(spark, docs, small))
    want = {d for d, t in texts.items() if scorer.score(t) < 0.5}
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == want

    two = settle(cp.drop_near_duplicates(spark, one, small))
    want = brute({d: texts[d] for d in want})
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == want

    three = settle(cp.drop_contaminated(spark, two, small))

    def shingles(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[k : k + decontam.WORDS]) for k in range(len(w) - decontam.WORDS + 1)}

    tests = [s for _, t in items if (s := shingles(t))]
    want = {d for d in want if not any(len(s & shingles(texts[d])) >= 0.8 * len(s) - 1e-9 for s in tests)}
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == want

    four = settle(cp.redact_personal(spark, three, small))
    rows = {r["doc_id"]: r for r in four.collect()}
    assert four.columns == columns and set(rows) == want
    for d, r in rows.items():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not pii.regions(texts[d]):
            assert r["text"] == texts[d]

    model = pieces.load_model(pieces.model_bytes())
    five = cp.encode_pieces(spark, four, small).collect()
    assert collections.Counter(r["doc_id"] for r in five) == collections.Counter(want)
    for r in five:
        assert model.decode(r["ids"]) == rows[r["doc_id"]]["text"] and r["n_tokens"] == len(r["ids"])


def test_stages_are_named():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near copies", "decontamination", "pii", "pieces"] and cp.ORACLE_SQL is None


def write(spark, path, docs, labels=(), items=()):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, id string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and long texts, clashing names, without labels and items."""
    long = "a long tale of the sea and of the land, told twice by sailors. " * 2000
    rows = [(1, None), (2, ""), (3, "some words here"), (3, "some words here"), (4, long), (None, "no id here"), (None, None), (5, "Some  WORDS here"), (6, "other words altogether")]
    write(spark, tmp_path, [(d, t, None, None, None, "k", "i") for d, t in rows])
    got = sorted((r["doc_id"] or 0 for r in cp.run(spark, str(tmp_path)).collect()))
    assert got == [0, 0, 1, 3, 4, 6]


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [])
    made = cp.run(spark, str(tmp_path))
    assert made.count() == 0 and made.columns[:2] == ["doc_id", "n_tokens"]

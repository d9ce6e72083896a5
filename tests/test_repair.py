"""Repair by counts: what is read of all documents' words, and that each pass is right on a small library."""

from lectern.operators import repair

LIBRARY = [(2, "thunder thicket thimble thorough " * 4 + "then " * 30), (3, "Then they then went then. ten " + "then " * 20)]
DAMAGED = (1, "tunder ticket timble torough " * 3 + "ten Ten ten here")


def test_passes(spark):
    """A document's own words come from its own rows: without all documents' words pass two finds the same."""
    df = spark.createDataFrame([DAMAGED, *LIBRARY], "doc_id int, text string")
    own, every = repair.word_counts(df)
    told = {r["word"]: (r["n"], r["docs"], r["only"]) for r in every.where("word in ('tunder', 'then')").collect()}
    assert told["tunder"] == (3, 1, 1) and told["then"][1] == 2
    fixes = repair.damaged_words(df, counts=(own, every)).cache()
    assert {(r["doc_id"], r["word"], r["fix"], r["own"]) for r in fixes.collect()} == {(1, w.replace("th", "t"), w, 3) for w in ("thunder", "thicket", "thimble", "thorough")}
    rare = [{(r["doc_id"], r["w"], r["exact"]) for r in repair.rare_words(df, fixes, counts=(x, every)).collect()} for x in (own, own.limit(0))]
    assert rare[0] == rare[1] == {(1, "ten", "then"), (1, "Ten", "Then")}
    got = {r["doc_id"]: (r["text"], r["fixes"]) for r in repair.repair(df).collect()}
    assert got == {1: ("thunder thicket thimble thorough " * 3 + "then Then then here", 15)}

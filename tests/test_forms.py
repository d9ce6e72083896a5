"""Folding of every character, and orders by language."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.order import by_language, numbered


def test_fold_is_unicodes(spark):
    """Every assigned character, alone and among others; a newer Unicode in Java may know a few letters' lower case that Python does not."""
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    df = spark.createDataFrame([(c, chr(c)) for c in codes], "c int, x string").repartition(4)
    got = df.select("c", T.fold(F.col("x")).alias("one"), T.fold(F.concat(F.lit("É"), F.col("x"), F.lit("ﬁ…"))).alias("among")).toPandas()
    want = {c: T._folded(chr(c)) for c in codes}
    other = [c for c, one, among in got.itertuples(index=False) if one != want[c] or among != f"e{want[c]}fi..."]
    assert len(got) == len(codes) and all(chr(c).lower() == chr(c) and unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt") for c in other) and len(other) < 60


@pytest.mark.parametrize(("text", "folded"), [("Ｆｕｌｌ　Ｗｉｄｔｈ", "full width"), ("각하", unicodedata.normalize("NFKD", "각하")), ("½ ㎞ № ﷺ", unicodedata.normalize("NFKD", "½ ㎞ № ﷺ").lower()), ("“Déjà ‘vu’”…", "\"deja 'vu'\"..."), ("", ""), (None, None)])
def test_fold_cases(spark, text, folded):
    assert spark.createDataFrame([(text,)], "x string").select(T.fold(F.col("x"))).first()[0] == folded


def test_language_order(spark):
    words = ["zebra", "Écho", "echo", "Echo", "écho", "apple", "Äpfel", "10", "2", "", None]
    got = numbered(spark.createDataFrame([(w,) for w in words], "w string"), [], [by_language(F.col("w")), F.col("w")], "n").orderBy("n").collect()
    assert [r["w"] for r in got] == [None, "", "10", "2", "Äpfel", "apple", "echo", "Echo", "écho", "Écho", "zebra"]

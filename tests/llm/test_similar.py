"""Near copies of the pipeline against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from lectern import shared
from lectern.llm import similar


def brute(texts):
    """The ids that stay: the smallest of each component of texts with a five-word Jaccard similarity of 0.8 or more."""

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    ids = sorted(texts)
    sets = {d: shingles(texts[d]) for d in ids}
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


@pytest.mark.parametrize(("common", "bucket", "partners"), [(4, 1 << 16, 12), (10**9, 1 << 16, 12), (10**9, 10, 12), (10**9, 10, 1)])
def test_edited_copies(spark, monkeypatch, common, bucket, partners):
    """Copies with one to many words edited, chains, a shared passage, short and empty texts; buckets whole and in parts."""
    monkeypatch.setattr(similar, "COMMON_ROWS", common)
    monkeypatch.setattr(similar, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(similar, "PARTNERS", partners)
    r = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    passage = r.choices(words, k=30)
    texts: dict[int, str | None] = {}
    for _ in range(25):
        own = r.choices(words, k=r.choice((8, 40, 120, 400)))
        own = passage + own if r.random() < 0.5 else own
        for _ in range(4):
            for _ in range(r.choice((0, 1, 1, 2, 3, 5))):
                own = list(own)
                own[r.randrange(len(own))] = r.choice(words)
            texts[len(texts)] = " ".join(own)
    own = r.choices(words, k=200)
    for _ in range(60):
        copy = list(own)
        for _ in range(r.choice((1, 2, 3))):
            copy[r.randrange(200)] = r.choice(words)
        texts[len(texts)] = " ".join(copy)
    for t in ("", None, "One two", "one  TWO", "one two three", "other"):
        texts[len(texts)] = t
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute(texts)
    assert len(want) < len(texts) - 50
    assert {r["doc_id"] for r in cp.drop_near_duplicates(spark, df, "").collect()} == want


def test_rows_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (None, text + " more"), (3, text + " end"), (5, "alone"), (5, "alone too"), (4, text)]
    kept = similar.one_of_each(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, key string"))
    assert kept.columns == ["doc_id", "text", "key"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 3, 5]
    assert similar.one_of_each(kept.limit(0)).count() == 0


def test_later_links_join_components(spark):
    """Components after links of a second round are those of all links at once."""
    r = random.Random(3)
    first = [(r.randrange(80), r.randrange(80)) for _ in range(30)]
    later = [(r.randrange(90), r.randrange(90)) for _ in range(25)]
    frame = lambda pairs: spark.createDataFrame(pairs, "src bigint, dst bigint")
    got = similar._joined(similar.settle(similar.components(frame(first))), frame(later))
    want = similar.components(frame(first + later))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bounds_pass_all_similar_pairs():
    """Tallies never say more than the sets differ in, and the first shared member's places allow what is similar."""
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(2500, 6000))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        gone, new = r.integers(0, len(a) // 4 + 1), r.integers(0, len(a) // 4 + 1)
        b = np.unique(np.r_[r.permutation(a)[gone:], r.integers(0, 2**63, new).astype(np.uint64)])
        x, y = (np.frombuffer(similar.tally(s), np.uint8) for s in (a, b))
        apart = int(np.minimum(x - y, y - x).sum(dtype=np.int64))
        assert apart <= len(np.setxor1d(a, b))
        if similar.similar(a, b):
            assert 9 * apart <= len(a) + len(b)
            common = np.sort(r.choice(a, 50))
            p, q = similar.prefix(a, common), similar.prefix(b, common)
            met = [(i, int(np.flatnonzero(q == s)[0])) for i, s in enumerate(p) if (q == s).any()]
            assert met and any(similar.can_meet(len(a), i, len(b), j) for i, j in met)
    other = [np.unique(r.integers(0, 2**63, 4000).astype(np.uint64)) for _ in range(2)]
    x, y = (np.frombuffer(similar.tally(s), np.uint8) for s in other)
    assert 9 * int(np.minimum(x - y, y - x).sum(dtype=np.int64)) > 8000 and similar.tally(other[0][:100]) is None


def test_long_copies(spark):
    """Long texts that share a passage but are no copies, and edited copies of two of them."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(9000)]
    passage = r.choices(words, k=200)
    texts = {k: " ".join(passage + r.choices(words, k=r.randrange(1700, 3200))) for k in range(12)}
    for k in (3, 7):
        for _ in range(3):
            own = texts[k].split()
            for _ in range(20):
                own[r.randrange(len(own))] = r.choice(words)
            texts[len(texts)] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"] for r in similar.one_of_each(df).collect()} == brute(texts) == set(range(12))


def test_parts_of_a_bucket(spark, monkeypatch):
    """Every two rows of a bucket in parts meet once, and pairs of the parts are the pairs of the whole bucket."""
    monkeypatch.setattr(similar, "BUCKET_ROWS", 7)
    r = np.random.default_rng(5)
    rows = [(int(p), k, 100 + int(r.integers(0, 4)), 0, k, bytes(8 * similar.SKETCH)) for k, p in enumerate(r.integers(0, 3, 90))]
    placed = spark.createDataFrame(rows, "p bigint, key bigint, n int, i int, root bigint, bits binary")
    sizes = placed.where("p < 2").groupBy("p").count().withColumnRenamed("count", "size")
    run = lambda df: df.repartition("p").sortWithinPartitions("p").mapInArrow(similar._in_buckets(similar._apart, ["src", "dst"]), "src bigint, dst bigint").collect()
    dealt = similar._dealt(placed, sizes, all_parts=True)
    assert dealt.groupBy("p").count().agg({"count": "max"}).first()[0] <= 45
    got = sorted(map(tuple, run(dealt)))
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1])
    assert got == want
    alone = run(similar._dealt(placed, sizes, all_parts=False))
    assert set(map(tuple, alone)) < set(want)


def test_only_texts_of_pairs_are_read_again(spark, monkeypatch, tmp_path):
    """Texts that share a passage, but whose sketches differ, are not read again, and no wide table stays in the shared folder."""
    monkeypatch.setattr(similar, "COMMON_ROWS", 10**9)
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    made, plain = [], similar.settle

    def spy(df):
        out = plain(df)
        made.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(similar, "settle", spy)
    r = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    passage = r.choices(words, k=30)
    texts = {k: " ".join(passage + r.choices(words, k=60)) for k in range(40)}
    texts |= {40: texts[3] + " one", 41: texts[3] + " two", 42: texts[3]}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {x["doc_id"] for x in similar.one_of_each(df).collect()} == brute(texts) == set(range(40))
    assert sum(n for columns, n in made if {"p", "centre"} <= columns) > 40
    assert 3 <= sum(n for columns, n in made if columns == {"key", "text"}) <= 6
    left = [set(spark.read.parquet(str(f)).columns) for f in tmp_path.iterdir()]
    assert left and not any({"text", "prefix", "bits", "tally"} & columns for columns in left)

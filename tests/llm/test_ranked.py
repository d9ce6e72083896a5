"""Ranked search against scores of all documents, and against its SQL."""

import collections
import math
import random
import re

import numpy as np
import oracle
import pytest

from lectern.llm import fptree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, id string, n string, terms string, tfs string, score string, rank string, item_id string, at string"


def cut(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    split = [(d, cut(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = collections.Counter(w for _, t in split for w in set(t))
    out = []
    for item, text in items:
        found = []
        for d, t in split:
            if not t:
                continue
            m, tf = 25 + 75 * len(t) * n_docs // n_terms, collections.Counter(t)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in cut(text))
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def some_tables():
    r = random.Random(11)
    words = [f"w{k}" for k in range(400)] + ["Straße", "ÉTÉ", "été", "日本", "x1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(r.choices(words, weights, k=r.randrange(1, 80)))) for k in range(3000)]
    copied = "w3 w5 w8, W13! w21 w34"
    docs += [(k, copied) for k in range(5000, 5400)] + [(4000, None), (4001, ""), (4002, "?!"), (4003, "w7 " * 70_000), (None, copied), (None, "日本 w9"), (10, copied), (10, copied)]
    r.shuffle(docs)
    items = [(k, " ".join(r.choices(words, weights, k=r.randrange(1, 40)))) for k in range(60)]
    return docs, [*items, (60, copied), (61, copied), (61, copied), (62, None), (63, " "), (64, "unknown words only"), (65, "unknown w7 W7"), (None, "日本, w9")]


@pytest.mark.parametrize("small_trees", [False, True])
def test_rank_documents(spark, monkeypatch, small_trees):
    """One tree a task, and many; one block of items, and several; ties of 400 copies."""
    if small_trees:
        monkeypatch.setattr(fptree, "TREE_DOCS", 300)
        monkeypatch.setattr(fptree, "ITEMS", 25)
    docs, items = some_tables()
    d = spark.createDataFrame([(*x, *["z"] * 8) for x in docs], SCHEMA).repartition(3)
    i = spark.createDataFrame([(*x, "z") for x in items], "item_id bigint, text string, doc_id string")
    got = fptree.rank_documents(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)
    assert fptree.rank_documents(d.limit(0), i).count() == fptree.rank_documents(d, i.limit(0)).count() == 0


def test_branches_are_passed_over():
    """Bounds hold, and few leaves are scored for an item that one document holds whole."""
    r = np.random.default_rng(2)
    n, words = 4000, 300
    rank = np.arange(words)
    rows = [np.unique(np.minimum(r.geometric(0.02, 30), words) - 1) for _ in range(n)]
    rows[1234] = np.arange(200, 230)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    terms, tfs = np.concatenate(rows), np.ones(int(offsets[-1]), np.int64)
    tree = fptree.Tree(list(range(n)), np.full(n, 100), offsets, terms, tfs, rank)
    held = np.concatenate(list(tree.leaves.values()))
    assert sorted(held.tolist()) == list(range(n))
    weight_of = np.zeros(words, np.int64)
    weight_of[200:230] = 5000
    scores = tree.score(np.arange(n), weight_of)
    for node, docs in tree.leaves.items():
        assert tree.most[node].astype(np.int64) @ weight_of >= scores[docs].max()
    scored, plain = [], tree.score
    tree.score = lambda docs, w: scored.append(len(docs)) or plain(docs, w)
    best = tree.search(np.arange(200, 230), weight_of[200:230], weight_of, [], 1)
    assert best[0][2] == 1234 and sum(scored) < n / 4


def test_op13(spark, small):
    assert oracle.compare(fptree.op13_ranked(spark, small), fptree.OP13_SQL, oracle.connect(small)) == ""

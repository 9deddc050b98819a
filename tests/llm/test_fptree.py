"""Ranked search against plain scoring of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from forescale.llm import fptree, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda c: c.group().lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_all = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    rows = []
    for item_id, text in items:
        scores = []
        for doc_id, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in plain_terms(text) if bag[t])
            if score > 0 and doc_id is not None:
                scores.append((-score, doc_id))
        rows += [(item_id, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return rows


def corpus(rng, n):
    words = ["The", "of", "ünï", "漢字", "x9", "é"] + [f"w{i}" for i in range(300)]
    weights = [40, 30, 20, 10, 10, 5] + [200 / (i + 3) for i in range(300)]
    return [(i, rng.choice([" ", ", ", "\n", "--"]).join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 80])))) for i in range(n)]


@pytest.mark.parametrize("leaf,shard_docs", [(64, 1 << 15), (2, 100), (1, 1)])
def test_search_equals_plain_scoring(spark, monkeypatch, leaf, shard_docs):
    monkeypatch.setattr(fptree, "LEAF", leaf)
    monkeypatch.setattr(fptree, "SHARD_DOCS", shard_docs)
    rng = random.Random(leaf)
    docs = corpus(rng, 300 if shard_docs > 1 else 40)
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(5, docs[5][1]), (5, "w1 W1 w2"), (None, "w1 w299"), (2000, None), (2001, ""), (2002, "w1 " * 9000)]
    items = [(i, " ".join(t.split()[:20])) for i, t in corpus(rng, 25)] + [(7, "w1 w1 w2"), (7, "w1 w1 w2"), (None, "w250"), (90, None), (91, "unheard-of"), (92, docs[3][1])]
    key = lambda r: tuple(str(v) for v in r)
    found = fptree.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 20)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_search(docs, items, 20), key=key)


def test_blocks_of_items_find_the_same(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame(corpus(rng, 120), "doc_id long, text string")
    items = spark.createDataFrame(corpus(rng, 12), "item_id long, text string")
    whole = sorted(map(tuple, fptree.search(docs, items, 5).collect()))
    assert sorted(map(tuple, fptree.search(docs, items, 5, block_bytes=1500).collect())) == whole


def test_bounds_cover_every_document_below():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 12, 400)
    ranks = np.concatenate([np.sort(rng.choice(30, s, replace=False)) for s in sizes])
    tree = fptree.Tree(np.arange(400), rng.integers(75, 400, 400), sizes, ranks, rng.integers(1, 9, len(ranks)), 30)
    assert len(tree.low) > 20
    for _ in range(50):
        weights = {int(t): int(rng.integers(0, 5000)) for t in rng.choice(30, 6, replace=False)}
        dense = np.zeros(30, np.int64)
        dense[list(weights)] = list(weights.values())
        scores = np.add.reduceat(dense[tree.terms] * tree.shares, tree.starts[:-1])
        assert all(b >= scores[low:high].max() for b, low, high in zip(tree.bounds(weights), tree.low, tree.high))
        assert sorted(tree.best(weights, 20, dense)) == sorted(sorted(((int(s), -int(d)) for s, d in zip(scores, tree.docs) if s), reverse=True)[:20])


def test_empty_tables_and_extra_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words", 3)], "doc_id long, text string, rank int")
    items = spark.createDataFrame([(4, "words", 5)], "item_id long, text string, score int")
    assert fptree.search(docs, items.limit(0)).count() == 0
    assert fptree.search(docs.limit(0), items).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.op13_ranked_search(spark, str(tmp_path))
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and [r[:3] for r in found.collect()] == [(4, 1, 1)]

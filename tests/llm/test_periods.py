"""Periodic runs against brute force over all periods, and the columns of the query."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from forescale.llm import periods, queries


def plain_runs(words):
    """(start, stop, period) of every run by trying each period at each place."""
    found = set()
    n = len(words)
    for q in range(1, n // periods.TIMES + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stop = i + q
            if stop - start >= max(periods.LEAST, periods.TIMES * q):
                own = words[start:stop]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    found.add((start, stop, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(rng, longest):
    words = []
    while len(words) < rng.randint(0, longest):
        k = rng.randint(1, max(1, longest // 6))
        base = [b"%d" % rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(k)]
        if rng.random() < 0.3:
            base *= rng.randint(2, 4)
        words += (base * rng.choice([1, 1, 2, 3, 4, 5, 7]))[rng.randint(0, k) :]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for longest in [150] * 300 + [1500] * 12:
        texts = [repetitive(rng, longest) for _ in range(rng.randint(1, 4))]
        assert [[tuple(r) for r in found.tolist()] for found in periods.runs_of(texts)] == [plain_runs(t) for t in texts]


def test_equal_neighbouring_texts_share_no_run():
    texts = [[b"a"] * 5, [b"a"] * 5, [], [b"a"] * 6]
    assert [len(r) for r in periods.runs_of(texts)] == [0, 0, 0, 1]


def plain_row(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, b" ".join(repetitive(rng, 120)).decode()) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (3, "twice twice"), (3, "twice twice"), (None, "x x x x x x"), (204, "ä\x0bä ä\x0cä ä\nä\x1cä")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_runs", F.lit("own")).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_periodic_runs(spark, str(tmp_path)).select(*COLUMNS).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted((plain_row(*r) for r in rows), key=key)


def test_collapse_keeps_other_columns_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "go " * 9, "mine", 7)], "doc_id long, text string, period string, size int")
    assert periods.collapse(docs).select("text", "size", "collapsed", "period").first() == ("go " * 9, 7, "go", 1)
    assert periods.collapse(docs.limit(0)).count() == 0

"""Minimax shards against brute force over all capacities, and the columns of the query."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from forescale.llm import queries, sharding


def sums_of(groups):
    """The sums of an in-memory dict key -> weight."""

    def sums(bits, within):
        parts = defaultdict(list)
        for key, weight in groups.items():
            if within is None or key >> sharding.BITS - within[0] in within[1]:
                parts[key >> sharding.BITS - bits].append((key, weight))
        return [sharding.Range(min(p)[0], max(p)[0], sum(w for _, w in p), max(w for _, w in p), bits) for p in parts.values()]

    return sums


def needed(weights, limit):
    """Shards that going through the groups needs."""
    count, filled = 1, 0
    for w in weights:
        if filled and filled + w > limit:
            count, filled = count + 1, 0
        filled += w
    return count


def least_capacity(weights, shards, low=None):
    return next(c for c in range(low or max(weights), sum(weights) + 1) if needed(weights, c) <= shards)


@pytest.mark.parametrize("crowded", [False, True])
def test_capacity_is_the_smallest_and_cuts_keep_to_it(crowded):
    rng = random.Random(crowded)
    for _ in range(300):
        base = rng.getrandbits(sharding.BITS - 20) if crowded else 0
        groups = {base + rng.getrandbits(19 if crowded else sharding.BITS): rng.choice([1, 3, rng.randint(1, 60)]) for _ in range(rng.randint(1, 90))}
        if rng.random() < 0.3:
            groups[rng.choice(list(groups))] = sum(groups.values()) // 2 + 1
        shards = rng.randint(1, 9)
        keys = sorted(groups)
        limit = least_capacity([groups[k] for k in keys], shards)
        cuts = sharding.cut_keys(sums_of(groups), shards)
        assert len(cuts) == shards - 1 and cuts == sorted(cuts)
        filled = Counter()
        for k in keys:
            filled[sum(k >= c for c in cuts)] += groups[k]
        assert max(filled.values()) == limit
        level = least_capacity([groups[k] for k in keys], shards, 1)  # heavier groups are alone
        assert all(w <= level or w in groups.values() for w in filled.values())


def test_hot_group_leaves_no_shard_empty():
    groups = {i << 40: 1 for i in range(900)} | {450 << 40: 1000}
    cuts = sharding.cut_keys(sums_of(groups), 8)
    filled = Counter()
    for k, w in groups.items():
        filled[sum(k >= c for c in cuts)] += w
    assert len(filled) == 8 and filled.most_common(1)[0][1] == 1000 and min(filled.values()) > 80


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "bé", "漢字", "dog"], k=rng.randint(0, 30))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[7]) for i in range(40)]
    rows += [(1000, None), (1001, ""), (3, texts[3]), (3, texts[3]), (None, "no id"), (None, None), (-5, "x" * 5000)]
    spark.createDataFrame([(*r, "own", 9) for r in rows], "doc_id long, text string, shard string, slot int").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_minimax_shards(spark, str(tmp_path)).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == expected
    slots, weights, of_text = defaultdict(list), Counter(), defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        weights[r.shard] += r["size"]
        of_text[r.text_crc32].add(r.shard)
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    groups = Counter()
    for _, t in rows:
        groups[int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)] += len((t or "").encode()) + 1
    assert max(weights.values()) == least_capacity([groups[k] for k in sorted(groups)], 8)


def test_small_slices_number_alike(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id % 1700) as text")
    whole = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs).collect()}
    monkeypatch.setattr(sharding, "SLICE_ROWS", 50)
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs).collect()} == whole


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0

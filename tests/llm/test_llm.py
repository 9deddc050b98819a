"""Each operator against brute force, exact round trips or known answers, and on nulls, empty and odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from forescale.llm import bpe, chat, common, decontaminate, html_text, licenses, lines, ppm, simhash, substrings, topk
from forescale.llm.common import word_pieces
from forescale.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "er", "th", "ou", "st", "le", "ri", "né"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def docs_of(spark, texts, langs=None):
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], langs[i] if langs else "xx", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


# Byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_encoding(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.machine.ranks, special_tokens={})


def test_bpe_equals_the_merges_of_the_library(codec, reference_encoding):
    rng = random.Random(3)
    letters = "abcdeEéß漢字🙂 \n\t'sll0129%$#ing tion\xa0\x1c"
    texts = ["", " ", "  a", "a  ", "\n\n x", "é" * 300, "ab " * 500, "<|endoftext|>", prose(1, 200)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text in texts:
        ids = codec.encode(text)
        assert list(ids) == reference_encoding.encode_ordinary(text)
        assert codec.decode_bytes(ids) == text.encode()
        assert "".join(codec.decode_stream(ids)) == text


def test_bpe_emits_after_bounded_lookahead_and_survives_resets(codec, reference_encoding, monkeypatch):
    for piece in ("abcdefgh" * 200, "é" * 300, "thereonanin" * 100):
        assert codec.machine.encode(piece.encode(), ahead=8) == codec.machine.encode(piece.encode())
    monkeypatch.setattr(bpe, "MAX_STATES", 5)
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    text = prose(2, 300)
    assert list(bpe.Codec(PATH, public_tokenizers.PATTERN).encode(text)) == reference_encoding.encode_ordinary(text)


def test_bpe_holds_moves_and_digits_once(reference_encoding):
    texts = [prose(seed, 400) for seed in range(6)]
    plain, decimal = bpe.Codec(PATH, public_tokenizers.PATTERN), bpe.Codec(PATH, public_tokenizers.PATTERN, decimal=True)
    expected = [reference_encoding.encode_ordinary(t) for t in texts]
    assert [(list(ids), digits) for ids, digits in plain.encoded(texts)] == [(ids, "") for ids in expected]
    assert [(list(ids), digits) for ids, digits in decimal.encoded(texts)] == [(ids, ",".join(map(str, ids))) for ids in expected]
    assert not plain.digits and not plain.machine.moves and plain.machine.table.count > 1000


def test_bpe_pairs_are_kept_apart_as_the_merges_do(codec):
    rng, machine = random.Random(5), codec.machine
    tokens = list(machine.halves)
    for _ in range(5000):
        left, right = rng.choice(tokens), rng.choice(tokens)
        assert machine.may_follow(left, right) == (machine.merge(machine.bytes_of[left] + machine.bytes_of[right]) == [left, right])


def test_utf8_machine_in_any_cuts():
    data = "aé漢🙂".encode() + b"\xff\xc3(\xe2\x82" + "z".encode()
    for step in (1, 2, 3, 5):
        machine = bpe.Utf8Machine()
        out = "".join(machine.feed(data[i : i + step]) for i in range(0, len(data), step)) + machine.finish()
        assert out == data.decode("utf-8", errors="replace")


def test_bpe_tables(spark):
    df = docs_of(spark, ["one two", None, "", "one two"]).withColumn("ids", F.lit("clash"))
    rows = bpe.encode_table(df, PATH, public_tokenizers.PATTERN).collect()
    assert [r.decoded for r in rows] == ["one two", "", "", "one two"] and rows[0].ids == rows[3].ids and rows[1].ids == []
    got = bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()
    assert got[1].n_tokens == 0 and got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(df.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


# Language ID


def test_language_id_on_held_out_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = ppm.train(docs)
    found = ppm.predict(docs.withColumn("held", ppm.held_out()), model).where("held and lang is not null")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_code_lengths_are_exact_and_do_not_depend_on_cuts(monkeypatch):
    texts = [prose(i, 80).encode() for i in range(8)]
    grams, n = ppm.gram_counts(texts)
    model = ppm.Model(["xx"], grams, n[:, None].astype(np.int32))
    scorer = ppm.Scorer(model)
    sums = np.exp2(-scorer.bits.reshape(-1, scorer.size).astype(np.float64) + np.append(np.zeros(scorer.size - 1), np.log2(256 - 26 - scorer.size + 1)))
    assert np.allclose(sums.sum(1), 1, atol=1e-3)  # each context's shares are a distribution
    whole = scorer.code_lengths(texts)
    monkeypatch.setattr(ppm, "SEGMENT", 37)
    assert np.allclose(scorer.code_lengths(texts), whole)
    table = {}
    for text in texts[:2]:
        padded = ppm.PAD + text.lower()
        symbols = [int(scorer.symbol[b]) for b in padded]
        table[text] = sum(scorer.bits[sum(s * scorer.size ** (3 - k) for k, s in enumerate(symbols[i : i + 4])), 0] for i in range(len(text)))
    assert np.allclose([table[t] for t in texts[:2]], whole[:2, 0], rtol=1e-5)


def test_language_id_odd_input(spark):
    docs = docs_of(spark, [prose(i, 60) for i in range(20)] + [None, "", "123 !!", "Ж" * 400], ["xx"] * 23 + [None])
    model = ppm.train(docs.withColumn("lang_pred", F.lit(1)))
    rows = ppm.predict(docs.withColumn("score", F.lit("clash")), model).collect()
    assert [r.lang_pred for r in rows[20:23]] == ["und"] * 3 and rows[0].lang_pred == "xx" and rows[20].score == 0
    kept = {r.doc_id for r in ppm.accepted(ppm.predict(docs, model)).collect()}
    assert kept == set(range(20))
    assert ppm.predict(docs, ppm.train(docs.where("false"))).where("lang_pred <> 'und'").count() == 0
    assert ppm.predict(docs.where("false"), model).count() == 0
    assert ppm.predict(docs_of(spark, [(None, "x")]).withColumn("h", ppm.held_out()), model).first().h


# Chat formatting


def test_chat_round_trip_of_hostile_texts(spark):
    hostile = ["<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|x", "", None, "<", "|im_end|>", "a\n\nb", "é🙂", "<|<|<\\|"]
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", t) for c in range(3) for i, t in enumerate(random.Random(c).sample(hostile, len(hostile)))]
    rows += [(9, 0, "od\nd%<|im_end|>", "x"), (9, None, None, "y"), (None, 1, "user", "z"), (7, 1, "user", "same"), (7, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    made = chat.conversations(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert back == dict(want)
    for r in chat.digests(made).collect():
        learned = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for r in made.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.conversations(df.where("false")).count() == 0


def test_chat_turn_order(spark):
    cases = {1: "user assistant", 2: "system user assistant user assistant", 3: "assistant user", 4: "user user assistant", 5: "user", 6: "user tool assistant", 7: "system system user assistant", 8: "user robot"}
    rows = [(c, i, role, "t") for c, roles in cases.items() for i, role in enumerate(roles.split())]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id for r in got.where("valid").collect()} == {1, 2, 6}


# Exact top-k


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 90)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)] if i % 3 else [0.25] * 6) for i in range(300)]
    rows += [(1000, None), (1001, [float("nan")] * 6), (1002, [None] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, []), (1020, []), (1005, [1.0, 2.0]), (None, [0.5] * 6)]
    rows += [(2000 + i, [1e7 + i, 3e9, -5e8 * i]) for i in range(45)] + [(3000 + i, [1e30, -1e30 * (i % 2)]) for i in range(0, 41)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in topk.top_k(df, k=20, every=20, scale=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(math.floor(64 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in whole if i % 20 == 0]:
        scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], v)), -(1 << 63)), (1 << 63) - 1), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:20]
        assert got.pop(q, []) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert not got
    assert topk.top_k(df.where("false")).count() == 0


def test_ball_tree_visits_fewer_nodes_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    rng = np.random.default_rng(0)
    for trial in range(20):
        n, d = int(rng.integers(1, 300)), int(rng.integers(0, 5))
        v = rng.integers(-3, 3, (n, d)).astype(float)
        if trial % 3 == 0:
            v[: n // 2] = v[:1]
        ids = rng.permutation(1000)[:n]
        tree = topk.BallTree(ids, v, 7)
        found = topk.Search(tree, ids, v, np.full(n, -np.inf), 7)
        for i in range(n):
            want = sorted((-float(v[i] @ x), int(j)) for x, j in zip(v, ids) if j != ids[i])[:7]
            assert [(-s, int(j)) for s, j in zip(found.scores[i], found.found[i]) if s > -np.inf] == want


# SimHash


def plain_fingerprint(text):
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    """Smallest id reachable over links of at most three bits."""
    parent = {i: i for i, _ in fps}
    for n, (i, x) in enumerate(fps):
        for j, y in fps[:n]:
            if (x ^ y).bit_count() <= 3:
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i, _ in fps}


def test_fingerprints(monkeypatch):
    texts = ["", "one", "One TWO", "É é x y", "a b\tc\x0bd\x85e", prose(1, 400), prose(2, 3)]
    assert simhash.simhash([t.encode() for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "_FLUSH", 7)
    monkeypatch.setattr(simhash, "word_pieces", lambda data: word_pieces(data, 50))
    assert simhash.simhash([t.encode() for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]


def test_simhash_groups_equal_brute_force(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = []
    for i in range(400):
        x = centres[i % 6] if i % 4 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.choice([1, 5, 30, 31, 32, 33, 50, 63, rng.randrange(64)])
        fps.append((1000 - i, x))
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fps], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in df.join(simhash.groups(df), "fp").collect()}
    assert got == plain_groups(fps)


def test_simhash_documents(spark):
    base = prose(1, 300)
    near = base + " more"
    docs = docs_of(spark, [(5, base), (3, near), (9, base), (9, base), (7, None), (8, ""), (2, " \n"), (1, prose(3, 100)), (None, prose(4, 50))]).withColumn("fp", F.lit("clash"))
    got = simhash.dedup_groups(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    want = plain_groups([(i, plain_fingerprint(t)) for i, t in dict(rows).items()])
    assert {r.doc_id: r.component_id for r in got.where("doc_id is not null").collect()} == want and got.count() == 9
    kept = simhash.representatives(docs)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted([0, *set(want.values())]) and kept.columns == docs.columns
    assert simhash.dedup_groups(docs.where("false")).count() == 0 and simhash.representatives(docs.where("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Substring dedup


def plain_substrings(rows):
    first, out = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = SPACE.findall(text or "")
        gone = [False] * len(words)
        for j in range(len(words) - 12):
            if first.setdefault(tuple(words[j : j + 13]), i) < i:
                gone[j : j + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings_equal_brute_force(spark):
    rng = random.Random(4)
    passage, page = prose(50, 60), prose(51, 300).split()
    texts = []
    for i in range(60):
        words = prose(i, rng.randint(0, 80)).split()
        cut = rng.randint(0, len(words))
        copied = passage.split() if i % 3 == 0 else page[(at := rng.randint(0, 250)) : at + rng.randint(5, 50)]
        texts.append((rng.randrange(10**6), "  ".join(words[:cut] + copied + words[cut:]) + "\n"))
    rows = texts + [(10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, "ab " * 400), (10**6 + 4, "ab " * 400), (10**6 + 5, prose(51, 300)), (10**6 + 5, prose(51, 300)), (None, prose(51, 300))]
    got = substrings.dedup(docs_of(spark, rows).withColumn("found", F.lit("clash")).repartition(7))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.where("doc_id is not null").collect()} == plain_substrings(rows)
    assert got.count() == len(rows) and got.where("doc_id is null").first().n_removed == 0
    assert substrings.dedup(docs_of(spark, [(1, "a")]).where("false")).count() == 0


def test_substrings_do_not_depend_on_cuts(monkeypatch):
    text = prose(7, 500).encode()
    whole = substrings.runs([1], [2], [text])
    monkeypatch.setattr(substrings, "word_pieces", lambda data: word_pieces(data, 90))
    cut = substrings.runs([1], [2], [text])

    def windows(found):
        anchor, first, count, window, _, spot = found
        return {(int(s) + k, int(a), int(window[f + k])) for a, f, c, s in zip(anchor, first, count, spot) for k in range(c)}

    assert windows(whole) == windows(cut) and len(windows(whole)) == 488
    found = np.array([(100 << 16) | 3, (480 << 16) | 1])
    total, removed, parts = substrings.cleaned(text, found)
    words = text.split()
    assert (total, removed) == (500, 27) and b" ".join(parts).split() == words[:100] + words[114:480] + words[493:]


def test_substring_windows_that_share_32_bits_are_told_apart(monkeypatch):
    """Two documents of one anchor whose window hashes differ in the upper 32 bits only."""
    import pyarrow as pa

    def runs(ids, keys, texts):
        return tuple(np.array(x, t) for x, t in (([7, 7], np.uint64), ([0, 1], np.int64), ([1, 1], np.int64), ([5, 5 | 1 << 40], np.uint64), ([1, 2], np.int64), ([1 << 32, 2 << 32], np.int64)))

    monkeypatch.setattr(substrings, "runs", runs)
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", "b"]), pa.array([1, 2])], names=["doc_id", "text", "key"])
    rows = pa.Table.from_batches(substrings.anchored(iter([docs]))).sort_by([("anchor", "ascending"), ("places", "ascending")])
    assert rows.num_rows == 2 and sum(b.num_rows for b in substrings.matched(iter(rows.combine_chunks().to_batches()))) == 0


# Decontamination


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(5)
    items = [(i, prose(100 + i, rng.randint(15, 60))) for i in range(30)] + [(90, "two words"), (91, None), (92, "")]
    rows = []
    for k in range(90):
        words = items[k % 30][1].split()
        rate = (0, 0.1, 0.2)[k % 3]
        edited = [w if rng.random() >= rate else "changed" for w in words]
        rows.append((k, " ".join([prose(k + 500, 50), *edited, prose(k + 900, 50)]).upper()))
    rows += [(k, prose(k, 200)) for k in range(1000, 1040)] + [(2000, None), (2001, ""), (None, items[0][1]), (2002, items[3][1] + " x " + items[3][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for block in (16 << 20, 400):
        got = decontaminate.matches(docs_of(spark, rows).withColumn("leaks", F.lit(0)), benchmark, block_bytes=block).collect()
        found = {(r.doc_id, r.item_id) for r in got}
        assert {(k, k % 30) for k in range(90)} <= found and (None, 0) in found and (2002, 3) in found
        assert not [r for r in got if r.doc_id is not None and 1000 <= r.doc_id <= 2001]
    assert all(r.similarity == 1 and r.last_word - r.first_word + 1 == len(items[r.item_id][1].split()) for r in got if r.doc_id is not None and r.doc_id < 90 and r.doc_id % 3 == 0 and r.item_id == r.doc_id % 30)
    assert decontaminate.matches(docs_of(spark, rows), benchmark.where("false")).count() == 0
    assert decontaminate.matches(docs_of(spark, rows).where("false"), benchmark).count() == 0


def test_decontamination_finds_evenly_spaced_edits_and_short_items(spark):
    items = [(i, prose(300 + i, n)) for i, n in enumerate((15, 20, 38, 59))] + [(90, "zwei wörter"), (91, "wort")]
    rows = []
    for k in range(24):
        words = items[k % 4][1].split()
        edited = [w if i % (4 + k % 2) != 1 else "changed" for i, w in enumerate(words)]
        rows.append((k, " ".join([prose(k + 700, 40), *edited, prose(k + 800, 40)])))
    rows += [(100 + k, prose(900 + k, 10) + " " + items[k][1]) for k in range(4)]  # full copies make the missing n-grams frequent
    rows += [(200, "a Zwei, Wörter b"), (201, "zwei andere wörter"), (202, "Wort!"), (203, "wörtern zwei")]
    found = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(k, k % 4) for k in range(24)} | {(100 + k, k) for k in range(4)} <= set(found)
    assert {p for p in found if p[1] >= 90} == {(200, 90), (202, 91)}
    assert (found[200, 90].similarity, found[200, 90].first_word, found[200, 90].last_word) == (1, 1, 2)


def test_alignment_equals_the_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 25))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(0, table[i, j] + (2 if a[i] == b[j] else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == table.max()


# HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/x>menu</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><p>We use cookies and all that of the site.</p></div>
<div class="ad">Buy this.</div><article><h1>Title &amp; more</h1><p>One  <b>two<br>three</b>\n four&nbsp;five<p title="a>b">Short.
<ul><li>x<li>y &lt; z</ul><form><p>mail</p><input></form><aside>related</aside><div id="comments"><p>A reader of the page says that it is good.</p></div><p>End 3 < 4</article>
<footer>&copy; site</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nOne two three four five\n\nShort.\n\nx\n\ny < z\n\nEnd 3 < 4"
    long = "the house of the man is in the town and it was as old as the hills that are on the way to the sea"
    links = "<ul>" + "".join(f"<li><a href=/{i}>go to {i}</a> <a href=/b>and {i}</a>" for i in range(5)) + "</ul>"
    assert html_text.main_text(f"<body>{links}<p>{long}</p><p>Short one.</p><p>{long}</p>{links}</body>") == f"{long}\n\nShort one.\n\n{long}"
    assert [html_text.main_text(x) for x in (None, "", "<", "plain", "<script>never ends", "</p></div>")] == ["", "", "<", "plain", "", ""]
    assert html_text.main_text("<article>" + "<b>" * 3000 + "deep" + "</article>") == "deep"


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("content", F.lit(3))
    rows = html_text.extract(df).collect()
    assert rows[1].content == "" and rows[0].content == rows[2].content != "" and html_text.extract(df.where("false")).count() == 0


# Line dedup


def plain_lines(rows, similarity=0.8):
    def norm(line):
        return re.sub(r"[ \t\n\x0b\f\r!-/:-@\[-`{-~]+", " ", line.lower()).strip(" ")

    rows = sorted(dict.fromkeys((i, t) for i, t in rows if i is not None and t is not None), key=lambda r: (r[0], xxhash.xxh64_intdigest(r[1].encode(), 42) ^ 1 << 63))
    kinds = sorted({n for _, t in rows for n in map(norm, t.split("\n")) if n})
    parent = {n: n for n in kinds}
    frame = pd.DataFrame({"n": kinds, "size": [len(n) for n in kinds]})  # noqa: F841
    links = duckdb.sql(f"""
        SELECT x.n, y.n FROM frame x JOIN frame y ON x.n < y.n AND y.size BETWEEN x.size * {similarity} - 1 AND x.size / {similarity} + 1
        WHERE levenshtein(x.n, y.n) <= {1 - similarity} * greatest(x.size, y.size) + 1e-9""").fetchall()
    for a, b in links:
        parent[find(parent, a)] = find(parent, b)
    seen, out = set(), {}
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            group = find(parent, n) if (n := norm(line)) else None
            if group is None or group not in seen:
                kept.append(line)
            seen.add(group)
        out[i, t] = "\n".join(kept)
    return out


@pytest.mark.parametrize("broadcast_rows", [4_000_000, 0])
def test_lines_equal_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(common, "BROADCAST_NUMBERS", broadcast_rows)
    rng = random.Random(6)
    stock = [prose(i, rng.randint(1, 60)) for i in range(25)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(0, 8)):
            words = rng.choice(stock).split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "edit%d" % rng.randrange(9)
            own.append(rng.choice([" ".join(words), " ".join(words).upper() + " !", "", "---", " ".join(reversed(words))]))
        rows.append((rng.randrange(1000), "\n".join(own)))
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (None, stock[0]), rows[0], (rows[1][0], stock[1] + "\n" + stock[0])]
    docs = docs_of(spark, rows).withColumns({c: F.lit("clash") for c in ("key", "gone", "row", "line", "n_removed")})
    got = lines.dedup(docs)
    want = plain_lines(rows)
    back = Counter((r.doc_id, r.text) for r in got.collect())
    assert back == Counter((i, want.get((i, t), t)) for i, t in rows)
    assert got.columns == docs.columns and lines.dedup(docs.where("false")).count() == 0


def test_all_pairs_of_a_large_bucket_are_looked_at(spark, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", 8)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    base = [" ".join(word() for _ in range(6)) for _ in range(40)]
    texts = [*base, *[t + " zzzzz" for t in base[:15]], *["the same short line again " + "xyz"[: i % 4] * (i // 4 % 3) + str(i) for i in range(30)]]
    docs = docs_of(spark, list(enumerate(texts)))
    found = lines.occurrences(docs).withColumn("blocks", F.array(F.lit(7).cast("long"))).cache()
    names = {r.line: r.doc_id for r in found.select("line", "doc_id").collect()}

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if distance(texts[i], texts[j]) <= max(len(texts[i]), len(texts[j])) * 0.2 + 1e-9:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    got = {}
    for r in lines.line_groups(docs, found).collect():
        got.setdefault(r.component, set()).add(names[r.line])
    groups = {frozenset(i for i, w in enumerate(want) if w == k) for k in want}
    assert {frozenset(g) for g in got.values() if len(g) > 1} == {g for g in groups if len(g) > 1} and len(groups) < 60


def test_lines_apart_by_their_letters_or_texts_are_no_pairs(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeinorstüж") for _ in range(rng.randrange(2, 9)))
    rows = []
    for k in range(300):
        x = " ".join(word() for _ in range(rng.randrange(1, 9)))[:80].strip()
        y = list(x)
        for _ in range(rng.randrange(len(x) // 2 + 1)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", *"aeznr ж"])
        rows += [(2 * k, x), (2 * k + 1, " ".join("".join(y).split()) or "x")]
    docs = docs_of(spark, rows)
    found = lines.occurrences(docs).withColumn("blocks", F.array(F.lit(7).cast("long"))).cache()
    named = found.select("doc_id", "size", "fp", *lines.TALLIES).join(docs.select("doc_id", "text"), "doc_id")
    both = named.where("doc_id % 2 = 0").alias("a").join(named.alias("b"), F.expr("b.doc_id - a.doc_id = 1 or b.doc_id - a.doc_id > 590"))
    fit = lines.possible(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), 0.8)
    whole = F.expr("levenshtein(a.text, b.text) <= 0.2 * greatest(a.size, b.size) + 1e-9").alias("whole")
    got = Counter(tuple(r) for r in both.where("greatest(a.size, b.size) <= 80").select(whole, fit.alias("fit")).collect())
    assert not got[True, False] and got[True, True] > 50 and got[False, False] > 50

    seen = []
    similar = lines.similar
    monkeypatch.setattr(lines, "similar", lambda pairs, *rest: seen.append(pairs.count()) or similar(pairs, *rest))
    lines.line_groups(docs, found).count()
    assert len(seen) == 3 and sum(seen) < 2500 and seen[2] < 200  # of 180,000


def test_lines_compared_by_pieces_pass_as_whole_lines_do(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for k in range(160):
        words = prose(k, rng.choice([12, 30, 90, 300])).split()
        other = [w for word in words for w in rng.choices([[word], [], [word, "neu"], ["xé" + word]], [10, k % 5, k % 4, k % 7])[0]] or ["a"]
        rows.append((2 * k, " ".join(words), 2 * k + 1, " ".join(other)))
    frame = spark.createDataFrame(rows, "a long, x string, b long, y string")
    texts = frame.select(F.col("a").alias("line"), F.col("x").alias("norm")).unionByName(frame.select(F.col("b").alias("line"), F.col("y").alias("norm")))
    sums = [lines.worded(F.col("x"), F.col("y")), *[lines.pieced(F.col("x"), F.col("y"), size) for size in (7, 64, 10**6)]]
    for r in frame.select(F.levenshtein("x", "y").alias("whole"), *[c.alias(f"sum{i}") for i, c in enumerate(sums)]).collect():
        assert (r.sum0 is None or r.sum0 >= r.whole) and r.sum1 >= r.whole and r.sum2 >= r.whole and r.sum3 == r.whole
    pairs = frame.select("a", "b")
    got = {tuple(r) for r in lines.similar(pairs, texts).collect()}
    monkeypatch.setattr(lines, "PIECES", ())
    monkeypatch.setattr(lines, "worded", lambda x, y: F.lit(None).cast("int"))
    assert got == {tuple(r) for r in lines.similar(pairs, texts).collect()} and 20 < len(got) < 140


def test_lines_of_a_text_are_normalised_as_lines_are(spark):
    texts = ["A  b!\n ..\n\nÄ\tΣΑΣ\r\nx\x0b-\x0cY ", "", "\n", "!", "ΑΣ\nΑ\u2028b\x1c c", None]
    docs = docs_of(spark, texts)
    whole = docs.select("doc_id", F.posexplode(lines.norms_of(F.col("text"))))
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n"))).withColumn("col", lines.norm_of(F.col("col")))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, each.collect())) and whole.count() > 10


def test_line_fingerprints_are_majorities(spark):
    rng = random.Random(7)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, [signed(rng.getrandbits(64)) for _ in range(n)]) for i, n in enumerate([1, 2, 3, 7, 30, 31, 32, 90])]
    frame = spark.createDataFrame(rows, "i int, h array<long>")
    got = lines.with_simhash(frame, "h", "fp").select("i", "fp", lines.blocks(F.col("h"), 2, 10, 1).alias("two"), lines.blocks(F.col("h"), 3, 10, 1).alias("three"))
    for (_, h), r in zip(rows, got.orderBy("i").collect()):
        slots = [h[k % len(h)] for k in range(31)]
        assert r.fp == signed(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in slots) >= 16))
        assert [len(r.two), len(r.three)] == [max(0, min(len(h), 10) - 1), max(0, min(len(h), 10) - 2)]
    moved = spark.createDataFrame([(0, rows[4][1]), (1, rows[4][1][:4] + [5] + rows[4][1][5:])], "i int, h array<long>")
    one, other = moved.orderBy("i").select(lines.blocks(F.col("h"), 3, 10, 1).alias("b")).collect()
    assert [x == y for x, y in zip(one.b, other.b)] == [True, True, False, False, False, True, True, True]


def test_lines_with_edits_beyond_three_bits_are_found(spark):
    rng = random.Random(11)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    spell = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(3, 9)))
    kinds = [(1, 1), (3, 1), (10, 1), (10, 2), (20, 2), (30, 3), (50, 5)]
    rows = []
    for n_words, edits in kinds:
        for _ in range(40):
            words = [spell() for _ in range(n_words)] if n_words > 1 else [spell() + spell() + spell()]
            changed = list(words)
            for i in range(edits):  # evenly spaced typos; all pairs have an edit similarity of at least 0.8
                at = i * n_words // edits
                changed[at] = changed[at][:2] + "é" + changed[at][3:]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(changed))]
    got = {r.doc_id: r.n_removed for r in lines.dedup(docs_of(spark, rows)).collect()}
    found = [sum(got[80 * i + 2 * k + 1] for k in range(40)) for i in range(len(kinds))]
    assert not any(got[i] for i in range(0, len(rows), 2)) and min(found) >= 36, found


# Licence scan


def test_licences_and_inheritance(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    files = [
        ("a/LICENSE", mit), ("a/x.py", "print(1)"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "some code here\n" * 30), ("a/b/z.py", None), ("a/b/c/w.py", ""),
        ("d/q.py", "no words of that kind"), ("top.py", "x"), ("a/b/c/COPYING", licenses.TEMPLATES["GPL-3.0"][1]), ("a/b/c/d/e.py", "deep " * 5000), (None, "Released under the MIT License."),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumn("given", F.lit(1)).withColumn("cosine", F.lit("clash"))
    rows = licenses.inherit(licenses.scan(df)).collect()
    got = {r.path: (r.licence, r.from_folder) for r in rows}
    assert got == {
        "a/LICENSE": ("MIT", None), "a/x.py": ("MIT", "a"), "a/b/y.py": ("Apache-2.0", None), "a/b/z.py": ("MIT", "a"), "a/b/c/w.py": ("GPL-3.0", "a/b/c"),
        "d/q.py": (None, None), "top.py": (None, None), "a/b/c/COPYING": ("GPL-3.0", None), "a/b/c/d/e.py": ("GPL-3.0", "a/b/c"), None: ("MIT", None),
    }
    assert len(rows) == len(files) and licenses.inherit(licenses.scan(df.where("false"))).count() == 0


def test_wrapped_licence_headers(spark):
    wrap = lambda text: "\n".join("# " + line for line in textwrap.wrap(text, 34))
    names = ("Apache-2.0", "BSD-3-Clause", "GPL-3.0", "MIT")
    files = [(name, "x = 1\n" * 20 + wrap(licenses.TEMPLATES[name][1]) + "\n\n" + "some code here\n" * 30) for name in names] + [("none", "some code here\n" * 30)]
    df = spark.createDataFrame(files, "path string, text string")
    got = {r.path: (r.licence, r.cosine) for r in licenses.scan(df).collect()}
    assert got["none"] == (None, None) and all(got[n][0] == n and got[n][1] > 0.9 for n in names), got


def test_licence_cosine_equals_dense_vectors():
    weighted = licenses.Weighted.of(licenses.TEMPLATES, {"the": 90, "license": 5, "mit": 2}, 100)
    names = sorted({*weighted.weight, "foo", "bar"})
    weight = np.array([weighted.weight.get(t, weighted.unseen) for t in names])

    def vector(text):
        counts = Counter(licenses.terms(text))
        v = np.array([counts[t] for t in names]) * weight
        return v / np.linalg.norm(v)

    text = "Foo: released under the MIT License bar"
    want = max((float(vector(text) @ vector(t)), n) for n, ts in licenses.TEMPLATES.items() for t in ts)
    got = weighted.best(Counter(licenses.terms(text)))
    assert got[1] == want[1] == "MIT" and abs(got[0] - want[0]) < 1e-9


# Pipeline


def test_pipeline_stages_against_brute_force(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(150)
    extra = [(10**6, "", "en", "s", 0), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, "12 34", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, DOCS))
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = texts(docs)
    after = stages["language_id"](spark, docs, folder)
    assert after.columns == docs.columns
    kept = texts(after)
    assert set(kept) == {i for i, t in before.items() if t and any(map(str.isalpha, t))}
    cleaned = stages["line_dedup"](spark, after, folder).cache()
    want = plain_lines(list(kept.items()))
    assert texts(cleaned) == {i: want[i, t] for i, t in kept.items()} and cleaned.where("n_chars <> length(text)").count() == 0
    single = stages["near_dedup"](spark, cleaned, folder).cache()
    groups = plain_groups(sorted((i, plain_fingerprint(t)) for i, t in texts(cleaned).items()))
    assert set(texts(single)) == set(groups.values()) and single.columns == docs.columns
    clean = texts(stages["decontamination"](spark, single, folder))
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    holds = {i for i, t in texts(single).items() if any(item in t for item in items)}
    assert set(texts(single)) - set(clean) == holds
    coded = stages["byte_bpe"](spark, single, folder).collect()
    assert all(r.decoded == r.text for r in coded)
    assert {name for name, _ in corpus_pipeline.STAGES} == set(stages) and len(stages) == 5


def test_groups_that_share_their_smallest_doc_id_keep_a_row_each(spark):
    one, other = prose(1, 80), prose(2, 80)
    docs = docs_of(spark, [(1, one), (1, other), (2, one), (3, other), (3, other)]).withColumns({c: F.lit("own") for c in ("copies", "text_hash", "stay_id", "stays", "row")})
    assert sorted(tuple(r)[:2] for r in simhash.representatives(docs).collect()) == sorted([(1, one), (1, other)])


def test_stages_keep_columns_of_clashing_names(spark, folder):
    import corpus_pipeline

    texts = [prose(i, 60) for i in range(12)]
    names = ["lang_pred", "score", "bits", "n_removed", "leaks", "copies", "text_hash", "stay_id", "row", "line", "gone", "fp", "leak"]
    docs = docs_of(spark, texts + [texts[0]], ["xx"] * 13).withColumns({c: F.lit(f"own {c}") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns, name
        kept = found.collect()
        assert len(kept) >= 12 and all(r[c] == f"own {c}" for r in kept for c in names), name
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_html_of_hostile_pages_takes_linear_time():
    import time

    text = "The cat is in the house and it was not on the table at all that day, he said to her. "
    pages = ['<a "', "<a \"'>", '<a ">', "<a <", "<!", "</x>", "<b>", "<div>", f"<p>x</p><p>{text}</p>"]
    for first in pages:
        for second in ("", "</p>", "<div></div>", "<td></td>", "</i>"):
            seconds = []
            for n in (4000, 16000):
                started = time.process_time()
                html_text.main_text(first * n + second * n)
                seconds.append(time.process_time() - started)
            assert seconds[1] < 10 * max(seconds[0], 0.05), (first, second, seconds)
    assert html_text.main_text(f'<p {"x=" * 9}"a>b"\'>\'>{text}</p><p "{text}>tail</p>') == f"{text.strip()}\n\ntail"

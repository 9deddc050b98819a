"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Every n-gram of an item is a seed, so a copy of
which any ``SEED_WORDS`` neighbouring words stayed is looked at, whatever else of the item stands elsewhere. Where seeds
predict an item to lie, its words are aligned locally (match 2, mismatch -1, gap -1), unless too few of its words stand
there for any alignment to pass. A passage counts when its score reaches ``SIMILARITY`` of the score of the unchanged
item, which lets edited and reordered copies through to be found.

The items are dealt to blocks of about ``BLOCK_BYTES`` of text, and one block at a time is broadcast, so what is sent is
bounded whatever the number of items. Documents are never shuffled, so no key can be hot.

Defined results: a null or empty text matches nothing; items with fewer words than a seed are found where all their words
stand in order without others between, at the first such place; repeated items are found each, repeated documents too; an empty benchmark finds nothing. Extra columns are kept; the output name
``leaks`` replaces a clashing one.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forescale.llm.common import pieces

SEED_WORDS = 3
SIMILARITY = 0.4
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, 1, 1
_BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())]))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_BREAKS).split()


class Numbers(dict):
    """Number of a known word, 0 of any other."""

    def __missing__(self, word: bytes) -> int:
        return 0


@dataclass
class Items:
    """Item words as numbers, and the places of each n-gram: ``grams`` sorted, ``heads`` into (item, offset) rows.

    ``short`` holds the items with fewer words than a seed, by size and by the number of all their words.
    """

    ids: list[int]
    words: list[np.ndarray]
    number: Numbers
    grams: np.ndarray
    heads: np.ndarray
    places: np.ndarray
    short: dict[int, dict[int, list[int]]]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        texts = [(i, words(t or "")) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))]
        number = Numbers({w: n + 1 for n, w in enumerate(sorted({w for _, own in texts for w in own}))})
        own = [np.fromiter((number[w] for w in t), np.int64, len(t)) for _, t in texts]
        places = [(g, i, at) for i, w in enumerate(own) for at, g in enumerate(keys(w, len(number)).tolist())]
        places = np.array(sorted(places), np.int64).reshape(-1, 3)
        grams, heads = np.unique(places[:, 0], return_index=True)
        short: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(own):
            if 0 < len(w) < SEED_WORDS:
                short.setdefault(len(w), {}).setdefault(int(keys(w, len(number), len(w))[0]), []).append(i)
        return Items([i for i, _ in texts], own, number, grams, np.append(heads, len(places)), places[:, 1:], short)


def keys(numbers: np.ndarray, known: int, size: int = SEED_WORDS) -> np.ndarray:
    """One number for each n-gram; -1 where it holds an unknown word."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key, whole = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(size):
        part = numbers[i : i + n]
        key = key * (known + 1) + part
        whole &= part > 0
    return np.where(whole, key, -1)


def found(items: Items, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``numbers`` where a gram of the items starts, and which."""
    key = keys(numbers, len(items.number))
    at = np.nonzero(key >= 0)[0]
    if not len(items.grams) or not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    which = np.minimum(np.searchsorted(items.grams, key[at]), len(items.grams) - 1)
    same = items.grams[which] == key[at]
    return at[same], which[same]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the place in ``text`` just after it."""
    steps = np.arange(len(text) + 1) * GAP
    row = np.zeros(len(text) + 1, np.int64)
    best = end = 0
    for word in item:
        fresh = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(text == word, MATCH, -MISMATCH), row[1:] - GAP, out=fresh[1:])
        np.maximum(fresh, 0, out=fresh)
        row = np.maximum.accumulate(fresh + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def passable(item: np.ndarray, text: np.ndarray, least: float) -> bool:
    """Whether any alignment may score ``least``: enough words of the item stand in some stretch as long as it may span."""
    n = len(item)
    span = n + int(MATCH * n - least) // GAP + 1
    inside = np.cumsum(np.append(0, np.isin(text, item)))
    most = (inside[span:] - inside[:-span]).max() if len(text) >= span else inside[-1]
    return MATCH * int(most) >= least


def leaks(items: Items, numbers: np.ndarray, similarity: float) -> list[dict]:
    """Items that one document holds: seeds predict where they start, alignment decides; the best passage of each."""
    best: dict[int, tuple[int, int, int]] = {}
    for length, known in items.short.items():
        for first, key in enumerate(keys(numbers, len(items.number), length).tolist()):
            for own in known.get(key, ()):
                best.setdefault(own, (MATCH * length, first, first + length - 1))
    at, which = found(items, numbers)
    if len(at):
        seeded(items, numbers, at, which, similarity, best)
    return [
        {"item_id": items.ids[i], "similarity": score / (MATCH * len(items.words[i])), "first_word": first, "last_word": last}
        for i, (score, first, last) in sorted(best.items())
    ]


def seeded(items: Items, numbers: np.ndarray, at: np.ndarray, which: np.ndarray, similarity: float, best: dict[int, tuple[int, int, int]]) -> None:
    """Adds to ``best`` the score and first and last word of the items that alignment finds at the seeds."""
    rows = np.concatenate([np.arange(items.heads[w], items.heads[w + 1]) for w in which])
    item = items.places[rows, 0]
    start = np.repeat(at, np.diff(items.heads)[which]) - items.places[rows, 1]
    order = np.lexsort((start, item))
    item, start = item[order], start[order]
    size = np.array([len(w) for w in items.words])
    cuts = np.nonzero((np.diff(item) != 0) | (np.diff(start) > size[item[1:]]))[0] + 1
    for begin, end in zip(np.append(0, cuts).tolist(), np.append(cuts, len(item)).tolist()):
        own = int(item[begin])
        words_ = items.words[own]
        slack = len(words_) // 2 + 2
        low = max(0, int(start[begin]) - slack)
        high = min(len(numbers), int(start[end - 1]) + len(words_) + slack)
        least = similarity * MATCH * len(words_)
        if not passable(words_, numbers[low:high], least):
            continue
        score, stop = align(words_, numbers[low:high])
        if score >= least and score > best.get(own, (0,))[0]:
            back = align(words_[::-1], numbers[low : low + stop][::-1])[1]
            best[own] = score, low + stop - back, low + stop - 1


def numbered(items: Items, texts: list[str | None]) -> list[np.ndarray]:
    return [np.fromiter(map(items.number.__getitem__, own), np.int64, len(own)) for own in (words(t or "") for t in texts)]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for block in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select(F.col("item_id").cast("long"), "text").collect()  # one block
        yield Items.of([tuple(r) for r in rows])


def with_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs``, then ``leaks``: the items that the text holds, each with similarity and first and last word."""
    out = docs.drop("leaks").withColumn("leaks", F.array().cast(_LEAKS))
    for items in item_blocks(benchmark, block_bytes):
        out = scanned(out, items, similarity)
    return out


def scanned(docs: DataFrame, items: Items, similarity: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in pieces(batches, "text", 4 << 20):
            out = []
            for before, numbers in zip(batch.column("leaks").to_pylist(), numbered(own, batch.column("text").to_pylist())):
                out.append(before + leaks(own, numbers, similarity))
            column = batch.schema.get_field_index("leaks")
            yield batch.set_column(column, batch.schema.field(column), pa.array(out, batch.schema.field(column).type))

    return docs.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, similarity, first_word, last_word: a row for each document and item that it holds."""
    return with_leaks(docs.select("doc_id", "text"), benchmark, **options).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")

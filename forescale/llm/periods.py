"""Periodic run detection: string synchronising sets propose periods, and later repetitions of a run's words go.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, TIMES * q)`` words that no
neighbouring word extends. For each scale t = 4, 8, 16, ... the synchronising set holds the places whose window of t words
has the smallest hash in reach, which equal surroundings decide alike. In a run with t <= q < 2t each t places hold one
of them, and the next place with equal context (2t words) is q further on, so neighbours of equal context propose all
periods from t to 2t. Places inside highly periodic stretches (period up to a quarter of t) are left out of the set: runs
found at smaller scales supply them, periods below 4 are read off directly. Each proposal is compared word by word and
extended to its ends, so hashes only propose.

The texts of a batch are one array of word numbers with a mark of its own after each text, so all texts share the passes
over it; their number is the logarithm of the longest text, and the memory is a few numbers a word of a batch or of the
longest text. Nothing is shuffled.

Defined results: a null text has no words; a null doc_id is kept and, in ``planted``, changes nothing; repeated rows are
rows of their own. Extra columns are kept by ``collapse``; the output names replace clashing ones.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forescale.llm.common import pieces

TIMES = 4
LEAST = 6
DIRECT = 4  # periods below are read off directly
BATCH_BYTES = 4 << 20
OUTPUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string, collapsed_sha256 string"

#: Odd multipliers that mix 64 bits.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of twice ``size`` words from those of windows of ``size`` words."""
    return mixed(hashes[:-size] * _MIX[0] + hashes[size:] * _MIX[3])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours: running minima of blocks from both sides meet."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def streaks(same: np.ndarray, least: int) -> np.ndarray:
    """(start, stop) of each stretch of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    long = stops - starts >= least
    return np.stack([starts[long], stops[long]], 1)


def extend(words: np.ndarray, low: int, high: int, period: int) -> tuple[int, int]:
    """Ends of the stretch around ``low`` to ``high`` in which words ``period`` apart are equal; looks in growing steps."""
    step = 64
    while high + period < len(words):
        ahead = words[high : high + step]
        later = words[high + period : high + period + step]
        differ = np.flatnonzero(ahead[: len(later)] != later)
        if len(differ):
            high += int(differ[0])
            break
        high += len(later)
        step *= 2
    step = 64
    while low > 0:
        start = max(0, low - step)
        differ = np.flatnonzero(words[start:low] != words[start + period : low + period])
        if len(differ):
            low = start + int(differ[-1]) + 1
            break
        low = start
        step *= 2
    return low, high + period


def proposals(window: np.ndarray, context: np.ndarray, scale: int, periodic: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first place, last place, period) of neighbours of equal context in the synchronising set, joined where they overlap."""
    ids = np.where(periodic[: len(window)], np.iinfo(np.uint64).max, window)
    least = sliding_least(ids, scale + 1)
    n = min(len(least), len(context))
    chosen = ((least[:n] == ids[:n]) | (least[:n] == ids[scale : scale + n])) & (least[:n] != np.iinfo(np.uint64).max)
    places = np.flatnonzero(chosen)
    order = np.argsort(context[places], kind="stable")
    places = places[order]
    same = np.flatnonzero(context[places[1:]] == context[places[:-1]])
    start, period = places[same], places[same + 1] - places[same]
    fits = (period >= scale) & (period < 2 * scale)
    start, period = start[fits], period[fits]
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    if not len(start):
        return
    head = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] > start[:-1] + 2 * scale)]))
    last = np.append(head[1:], len(start)) - 1
    covered = start[last] + 2 * scale - start[head]
    wide = covered >= (TIMES - 1) * period[head] - 2 * scale  # less can't grow to a run
    yield from zip(start[head][wide].tolist(), (start[last][wide] + 2 * scale).tolist(), period[head][wide].tolist())


def all_runs(words: np.ndarray, longest: int) -> np.ndarray:
    """Sorted (start, stop, period) of the stretches with a smallest period and at least ``TIMES`` repetitions.

    ``words`` are numbers; a mark after each text is equal to nothing else. ``longest`` bounds the words of one text.
    """
    found: dict[tuple[int, int], int] = {}
    for period in range(1, min(DIRECT, len(words))):
        for start, stop in streaks(words[:-period] == words[period:], (TIMES - 1) * period).tolist():
            found.setdefault((start, stop + period), period)
    window = mixed(words.astype(np.uint64) * _MIX[0] + _MIX[3])
    size = 1
    while size < DIRECT and len(window) > size:
        window = doubled(window, size)
        size *= 2
    while TIMES * size <= longest and len(window) > size + 1:
        periodic = np.zeros(len(words) + 1, np.int64)
        for (start, stop), period in found.items():
            if TIMES * period <= size <= stop - start:
                periodic[start] += 1
                periodic[stop - size + 1] -= 1
        context = doubled(window, size)
        for first, last, period in proposals(window, context, size, np.cumsum(periodic) > 0):
            if np.array_equal(words[first:last], words[first + period : last + period]):
                start, stop = extend(words, first, last, period)
                if stop - start >= TIMES * period and found.get((start, stop), period) >= period:
                    found[start, stop] = period
        window, size = context, 2 * size
    rows = [(start, stop, period) for (start, stop), period in found.items() if stop - start >= LEAST]
    return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def digest(words: list[bytes], runs: np.ndarray) -> tuple:
    """The output columns of one text."""
    lines = b"".join(b"%d,%d,%d\n" % (start, stop - start, period) for start, stop, period in runs.tolist())
    kept = words
    best = (None, None, None, None)
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 1], -1)
        kept = list(compress(words, np.cumsum(change)[:-1] == 0))
        start, stop, period = runs[0].tolist()
        for s, e, q in runs[1:].tolist():
            if (e - s) * period > (stop - start) * q:
                start, stop, period = s, e, q
        best = (start, stop - start, period, 1000 * (stop - start) // period)
    text = b" ".join(kept)
    return (len(runs), *best, hashlib.sha256(lines).hexdigest(), text, hashlib.sha256(text).hexdigest())


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of each text: (start, stop, period) in words."""
    flat = np.empty(sum(map(len, texts)), object)
    flat[:] = [w for words in texts for w in words]
    numbers = pd.factorize(flat)[0]
    lengths = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(lengths + 1) - 1
    joined = np.empty(len(flat) + len(texts), np.int64)
    marks = np.zeros(len(joined), bool)
    marks[stops] = True
    joined[~marks] = numbers
    joined[marks] = -1 - np.arange(len(texts))
    found = all_runs(joined, int(lengths.max(initial=0)))
    starts = stops - lengths
    owner = np.searchsorted(stops, found[:, 0])
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [found[cut[i] : cut[i + 1]] - np.array([starts[i], starts[i], 0]) for i in range(len(texts))]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: a tenth of the documents, by crc32 of the id, repeat a stretch from some word on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapse(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...), then the columns of ``OUTPUT``: the runs of each text and what is left of it.

    ``change`` may replace the words of a document before.
    """
    names = [c for c in docs.columns if c not in T.StructType.fromDDL(OUTPUT).names]
    rows = docs.select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"), F.struct(*names).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "bytes", BATCH_BYTES):
            texts = [t.split() for t in batch.column("bytes").to_pylist()]
            if change:
                texts = [change(i, words) for i, words in zip(batch.column("id").to_pylist(), texts)]
            out = list(zip(*map(digest, texts, runs_of(texts))))
            longs = [pa.array(column, pa.int64()) for column in out[:5]]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), *longs, pa.array(out[5], pa.string()), pa.array(out[6], pa.binary()).cast(pa.string()), pa.array(out[7], pa.string()),
            ], names=schema.names)

    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(OUTPUT).fields])
    return rows.mapInArrow(run, schema).select("row.*", *schema.names[1:])

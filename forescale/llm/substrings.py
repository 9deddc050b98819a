"""Substring dedup: seeds from winnowed anchors, extended to whole windows, removed where an earlier document has them.

Every window of ``WINDOW`` words has one anchor, its smallest hash of ``SEED_WORDS`` consecutive words. Equal windows
have equal anchors, so documents meet on anchors only: about two in eleven words instead of all. Around each anchor the
match is extended both ways to all windows that hold it (a run); of each window the smallest doc_id with it is found.
Runs of matched windows that overlap are the maximal repeats; each word they cover in a later document goes.

Skew: equal runs in a batch of documents travel as one row that lists them, so a passage in a third of all documents
sends one row per batch. Where anchors meet, rows come sorted by anchor and doc_id and are passed once, holding only the
different windows of the current anchor.

Windows are compared by 56 bits of their own hash, below 64 bits of the anchor's: of ten million different windows under
one anchor a false equality is expected in less than a thousandth of a case. Texts travel compressed. Defined results: a null text has no
words; windows of rows with a null doc_id neither remove nor are removed; rows that share a doc_id are not earlier than
one another, and rows that share doc_id and text are treated alike. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forescale.llm.common import pieces, resident, word_pieces

WINDOW = 13
SEED_WORDS = 4
WIDTH = 7  # bytes of a window's hash that travel
GRAMS = WINDOW - SEED_WORDS + 1  # anchors to choose from in a window
_SIGN = np.int64(-1 << 63)  # turned, the bytes of numbers sort like the numbers
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    return x ^ (x >> np.uint64(29))


def stretches(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """First word's number and words, in overlapping stretches such that each window lies in exactly one as a start."""
    tail: list[bytes] = []
    at = 0
    for words in word_pieces(text):
        words = tail + words
        yield at, words
        at += max(0, len(words) - WINDOW + 1)
        tail = words[-(WINDOW - 1) :] if len(words) >= WINDOW else words


def runs(ids: list[int], keys: list[int], texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchor, first window's place, window count, window hashes, doc_id and spot of each run of windows with one anchor."""
    words: list[bytes] = []
    lengths, owners, firsts = [], [], []
    for i, text in enumerate(texts):
        for at, own in stretches(text):
            if len(own) >= WINDOW:
                words += own
                lengths.append(len(own))
                owners.append(i)
                firsts.append(at)
    known = resident("words", WordHashes)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    lengths = np.array(lengths, np.int64)
    n = len(w) - WINDOW + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.uint64, np.int64, np.int64))
    m = len(w) - SEED_WORDS + 1
    gram = mixed(sum(w[i : i + m] * _ODD[i] for i in range(SEED_WORDS)))
    window = mixed(gram[:n] * _ODD[0] + gram[4 : 4 + n] * _ODD[1] + gram[8 : 8 + n] * _ODD[2] + w[12 : 12 + n] * _ODD[3])
    stretch = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    valid = np.nonzero(stretch[:n] == stretch[WINDOW - 1 : WINDOW - 1 + n])[0]
    anchor = (np.lib.stride_tricks.sliding_window_view(gram, GRAMS)[:n].argmin(1) + np.arange(n))[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
    head = np.nonzero(new)[0]
    first = valid[head]
    count = np.diff(np.append(head, len(valid)))
    of = stretch[first]
    owner = np.array(owners, np.int64)[of]
    place = np.array(firsts, np.int64)[of] + first - starts[of]
    spot = np.array(keys, np.int64)[owner] << 32 | place
    return gram[anchor[head]], first, count, window, np.array(ids, np.int64)[owner], spot


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per different run of a batch: anchor, window hashes, and all its (doc_id, spot) by doc_id, as bytes that sort alike."""
    for batch in pieces(batches, "text", 8 << 20):
        anchor, first, count, window, doc, spot = runs(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), [t.encode() for t in batch.column("text").to_pylist()])
        if not len(anchor):
            continue
        whole = mixed(window[first] * _ODD[0] + window[first + count - 1] * _ODD[1] + count.astype(np.uint64))  # equal runs
        order = np.lexsort((spot, doc, whole, anchor))
        anchor, first, count, doc, spot, whole = (x[order] for x in (anchor, first, count, doc, spot, whole))
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
        head = np.nonzero(new)[0]
        windows = window[expand(first[head], count[head])].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].reshape(-1)
        places = np.append(head, len(anchor))
        yield pa.RecordBatch.from_arrays([
            pa.array(anchor[head].view(np.int64)), binary(windows, np.append(0, np.cumsum(count[head]) * WIDTH)), binary(np.stack([doc ^ _SIGN, spot], 1).astype(">i8"), places * 16),
        ], names=["anchor", "windows", "places"])


def values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column and how many each row has."""
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // size


def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and first doc_id: which windows of which document a smaller doc_id has too, as place and bits."""
    held = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)  # windows of the last anchor
    for batch in pieces(batches, "places", 2 << 20):
        anchor = batch.column("anchor").to_numpy()
        packed_windows, n_bytes = values(batch.column("windows"), "u1")
        n_windows = n_bytes // WIDTH
        windows = np.zeros((len(packed_windows) // WIDTH, 8), np.uint8)
        windows[:, :WIDTH] = packed_windows.reshape(-1, WIDTH)
        windows = windows.view("<u8").reshape(-1)
        places, n_places = values(batch.column("places"), ">i8")
        places, n_places = places.astype(np.int64).reshape(-1, 2), n_places // 2
        places[:, 0] ^= _SIGN
        doc = places[np.cumsum(n_places) - n_places, 0]
        row = np.repeat(np.arange(len(anchor)), n_windows)
        a = np.concatenate([held[0], anchor[row]])
        w = np.concatenate([held[1], windows])
        d = np.concatenate([held[2], doc[row]])
        order = np.lexsort((d, w, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (w[order][1:] != w[order][:-1])
        least = np.empty(len(order), np.int64)
        least[order] = d[order][np.nonzero(new)[0]][np.cumsum(new) - 1]
        last = order[new]
        last = last[a[last] == anchor[-1]]
        held = a[last], w[last], d[last]
        least = least[len(least) - len(windows) :]
        begins = np.cumsum(n_windows) - n_windows
        each = np.repeat(np.arange(len(anchor)), n_places)  # a row's documents
        pair = np.repeat(np.arange(len(places)), n_windows[each])
        which = expand(np.zeros(len(places), np.int64), n_windows[each])
        later = places[pair, 0] > least[begins[each][pair] + which]
        bits = np.bincount(pair, later * (1 << which), len(places)).astype(np.int64)
        some = np.nonzero(bits)[0]
        spot = places[some, 1]
        yield pa.RecordBatch.from_arrays([pa.array(places[some, 0]), pa.array(spot >> 32), pa.array((spot & 0xFFFFFFFF) << 16 | bits[some])], names=["doc_id", "key", "found"])


def covered(found: np.ndarray, start: int, stop: int) -> np.ndarray:
    """For the words from ``start`` to ``stop`` of a document: whether a found window covers them."""
    change = np.zeros(stop - start + 1, np.int64)
    for bit in range(GRAMS):
        at = (found[(found >> bit) & 1 == 1] >> 16) + bit
        np.add.at(change, np.clip(at - start, 0, stop - start), 1)
        np.add.at(change, np.clip(at + WINDOW - start, 0, stop - start), -1)
    return np.cumsum(change)[:-1] > 0


def cleaned(text: bytes, found: np.ndarray | None) -> tuple[int, int, Iterator[bytes]]:
    """Word count, removed count and kept words in parts."""
    total = removed = 0
    parts = []
    for words in word_pieces(text):
        if found is not None:
            gone = covered(found, total, total + len(words))
            removed += int(gone.sum())
            kept = list(compress(words, ~gone))
        else:
            kept = words
        total += len(words)
        if kept:
            parts.append(b" ".join(kept))
    return total, removed, parts


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, key (32 bits of the text's hash) and found windows (place << 16 | bits of the windows from there) that an earlier document has."""
    rows = keyed(docs).where("doc_id is not null and text is not null")
    seeds = rows.mapInArrow(anchored, "anchor long, windows binary, places binary")
    met = seeds.repartition("anchor").sortWithinPartitions("anchor", "places")
    return met.mapInArrow(matched, "doc_id long, key long, found long")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).alias("key"))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle."""
    squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False)
    for batch in pieces(batches, "text"):
        texts = [None if t is None else squeeze.compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(texts, pa.binary())], names=["doc_id", "key", "packed"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the words that stay, joined by one space), n_words, n_removed, kept_sha256 of every row."""
    found = repeats(docs).groupBy("doc_id", "key").agg(F.collect_set("found").alias("found"))
    texts = keyed(docs).mapInArrow(packed, "doc_id long, key long, packed binary")
    joined = texts.join(found, ["doc_id", "key"], "left").select("doc_id", "packed", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = zstandard.ZstdDecompressor()
        for batch in pieces(batches, "packed", 4 << 20):
            out = [
                cleaned(b"" if t is None else spread.decompress(t), None if f is None else np.array(f, np.int64))
                for t, f in zip(batch.column("packed").to_pylist(), batch.column("found").to_pylist())
            ]
            kept = [b" ".join(parts) for _, _, parts in out]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([n for n, _, _ in out], pa.int64()),
                pa.array([n for _, n, _ in out], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ], names=["doc_id", "kept", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long, kept_sha256 string")

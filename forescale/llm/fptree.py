"""Ranked lexical search: a frequency-ordered prefix tree of documents, searched depth first by branch and bound.

Each document becomes the vector of its terms that stand in any item, with their numbers of occurrences, most frequent
term of the corpus first. A shard of documents is sorted by these vectors, so documents with equal beginnings share a
path of a prefix tree; paths without branches are one node, and a subtree of few documents or of equal vectors is a leaf.
Every node knows, of the documents below it, the largest number of occurrences of each term and the smallest length norm
m. A term's share of a score grows with the occurrences and falls with m, so both bound the score of everything below.
For one item the bounds of all nodes are added up from the lists that each term has of its nodes; then the tree is gone
through depth first, best child first, and a subtree whose bound can't reach the item's k-th place so far is left out.

The statistics (documents with terms, all their terms, documents of each term) cover all documents and are found first.
Items are taken in blocks of bounded text, so what a task is sent doesn't grow with their number; each block reads the
texts once and stores its vectors in the shared folder. A shard is bounded in numbers and lies in one task; its best k of
each item go on, the k best are first chosen within slices and then among them. No text is shuffled.

Terms are maximal runs of ASCII digits, letters and all characters beyond ASCII, with A to Z lower-cased. Defined results:
a null or empty text has no terms; a row without doc_id counts in the statistics and is not ranked; repeated documents are
ranked each; repeated items are searched each; an item without terms, an empty benchmark and an empty table find nothing.
Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forescale.llm.common import pieces, staged, word_pieces

BLOCK_BYTES = 4 << 20  # text of the items that are searched together
SHARD_NUMBERS = 1 << 21  # term numbers of a shard
SHARD_DOCS = 1 << 15
LEAF = 64
SLICES = 64
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded size."""
    return word_pieces((text or "").encode().translate(_FOLD))


@dataclass
class Items:
    """A block of items: their identifiers, each item's term numbers with repeats, and the number of each term."""

    ids: list[int | None]
    bags: list[Counter]
    number: dict[bytes, int]

    @staticmethod
    def of(rows: list[Row]) -> Items:
        rows = sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text or ""))
        bags = [Counter(t for part in terms(r.text) for t in part) for r in rows]
        number = {t: i for i, t in enumerate(sorted({t for bag in bags for t in bag}))}
        return Items([r.item_id for r in rows], [Counter({number[t]: n for t, n in bag.items()}) for bag in bags], number)


def vectors(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and tfs (known terms and their occurrences) of the documents that have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids, sizes, names, counts, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                bag: Counter = Counter()
                n = 0
                for part in terms(text):
                    n += len(part)
                    bag.update(filter(number.__contains__, part))
                if n:
                    ids.append(doc_id)
                    sizes.append(n)
                    names += map(number.__getitem__, bag)
                    counts += bag.values()
                    ends.append(len(names))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(names, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
            ], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Saturated occurrences: 1,000,000 at most."""
    return 1_000_000_000 * tf // (1_000 * tf + 12 * m)


class Tree:
    """Prefix tree over one shard: documents in the order of their vectors, nodes as ranges of them, parents first."""

    def __init__(self, docs: np.ndarray, m: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, n_terms: int):
        owner = np.repeat(np.arange(len(docs)), sizes)
        inner = np.lexsort((ranks, owner))
        ranks, tfs = ranks[inner], tfs[inner]
        ends = np.cumsum(sizes)
        keys = ranks.astype(">u4").tobytes()
        paths = [keys[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist())]
        order = np.array(sorted(range(len(docs)), key=lambda i: (paths[i], docs[i])), np.int64)
        self.docs, self.m, self.sizes = docs[order], m[order], sizes[order]
        self.paths = [paths[i] for i in order.tolist()]
        first = (ends - sizes)[order]
        self.starts = np.append(0, np.cumsum(self.sizes))
        entry = np.arange(self.starts[-1]) - np.repeat(self.starts[:-1] - first, self.sizes)
        self.terms, self.tfs = ranks[entry], tfs[entry]
        self.shares = share(self.tfs, np.repeat(self.m, self.sizes))
        self.low, self.high, self.children = [], [], []
        self._grow()
        self._summarise(n_terms)

    def _grow(self) -> None:
        """Nodes (ranges of documents that share a path) and their children, from the root on."""
        todo = [(0, len(self.docs), 0, -1)]
        while todo:
            low, high, depth, parent = todo.pop()
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if high - low <= LEAF or self.paths[low] == self.paths[high - 1]:
                continue
            one, two = self.paths[low], self.paths[high - 1]
            while one[4 * depth : 4 * depth + 4] == two[4 * depth : 4 * depth + 4]:  # the shared path is one node
                depth += 1
            at = self.starts[low:high] + depth
            step = np.where(depth < self.sizes[low:high], self.terms[np.minimum(at, len(self.terms) - 1)], -1)
            cuts = low + np.flatnonzero(np.diff(step)) + 1
            bounds = [low, *cuts.tolist(), high]
            todo += [(a, b, depth, node) for a, b in zip(bounds, bounds[1:])]

    def _summarise(self, n_terms: int) -> None:
        """Of each node the smallest m and doc_id, and of each term its nodes with the bound of its share there."""
        self.least_m, self.least_doc = np.zeros(len(self.low), np.int64), np.zeros(len(self.low), np.int64)
        nodes, names, shares = [], [], []
        peak = np.zeros(n_terms, np.int64)
        for node, (low, high) in enumerate(zip(self.low, self.high)):
            self.least_m[node] = self.m[low:high].min()
            self.least_doc[node] = self.docs[low:high].min()
            own, tfs = self.terms[self.starts[low] : self.starts[high]], self.tfs[self.starts[low] : self.starts[high]]
            np.maximum.at(peak, own, tfs)
            present = np.unique(own)
            names.append(present)
            shares.append(share(peak[present], self.least_m[node]))
            nodes.append(np.full(len(present), node))
            peak[present] = 0
        names = np.concatenate(names)
        order = np.argsort(names, kind="stable")
        self.of_node, self.of_share = np.concatenate(nodes)[order], np.concatenate(shares)[order]
        self.heads = np.searchsorted(names[order], np.arange(n_terms + 1))

    def bounds(self, weights: dict[int, int]) -> np.ndarray:
        total = np.zeros(len(self.low), np.int64)
        for term, weight in weights.items():
            part = slice(self.heads[term], self.heads[term + 1])
            total[self.of_node[part]] += weight * self.of_share[part]
        return total

    def best(self, weights: dict[int, int], k: int, dense: np.ndarray) -> list[tuple[int, int]]:
        """The k highest (score, -doc_id) above score 0; ``dense`` holds the weights by term."""
        bounds = self.bounds(weights)
        heap: list[tuple[int, int]] = []
        todo = [0]
        while todo:
            node = todo.pop()
            if not bounds[node] or len(heap) == k and (bounds[node], -self.least_doc[node]) <= heap[0]:
                continue
            if self.children[node]:
                todo += sorted(self.children[node], key=lambda c: bounds[c])
                continue
            low, high = self.low[node], self.high[node]
            start, stop = self.starts[low], self.starts[high]
            running = np.append(0, np.cumsum(dense[self.terms[start:stop]] * self.shares[start:stop]))
            scores = running[self.starts[low + 1 : high + 1] - start] - running[self.starts[low:high] - start]
            docs = self.docs[low:high]
            some = np.flatnonzero(scores >= (heap[0][0] if len(heap) == k else 1))
            some = some[np.lexsort((docs[some], -scores[some]))[:k]]
            for found in zip(scores[some].tolist(), (-docs[some]).tolist()):
                if len(heap) < k:
                    heapq.heappush(heap, found)
                else:
                    heapq.heappushpop(heap, found)
        return heap


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """doc_id, n, number of terms, terms and tfs of up to ``SHARD_DOCS`` documents or about ``SHARD_NUMBERS`` terms."""
    held: list[tuple[np.ndarray, ...]] = []
    docs = numbers = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            names, tfs = part.column("terms"), part.column("tfs")
            sizes = names.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((part.column("doc_id").to_numpy(), part.column("n").to_numpy(), sizes, names.flatten().to_numpy(), tfs.flatten().to_numpy()))
            docs += part.num_rows
            numbers += int(sizes.sum())
            if docs >= SHARD_DOCS or numbers >= SHARD_NUMBERS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, docs, numbers = [], 0, 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def block_top(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """item (place in the block), item_id, doc_id, score: the best k documents of every shard for each item."""
    own = staged(vectors(docs, items.number), "search-vectors")
    n_docs, n_all = own.agg(F.count(F.lit(1)), F.sum("n")).first()
    frequency = np.zeros(len(items.number), np.int64)
    for row in own.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequency[row["term"]] = row["count"]
    rank = np.empty(len(frequency), np.int64)
    rank[np.lexsort((np.arange(len(frequency)), -frequency))] = np.arange(len(frequency))
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()]
    bags = [{int(rank[t]): n * weight[t] for t, n in bag.items() if frequency[t]} for bag in items.bags]
    ids = items.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, n, sizes, names, tfs in shards(batches):
            tree = Tree(doc, 75 + 25 * n * n_docs // n_all, sizes, rank[names], tfs, len(rank))
            out: list[tuple] = []
            dense = np.zeros(len(rank), np.int64)
            for i, bag in enumerate(bags):
                dense[list(bag)] = list(bag.values())
                out += [(i, ids[i], -doc_id, score) for score, doc_id in tree.best(bag, k, dense)]
                dense[list(bag)] = 0
            if out:
                item, item_id, doc_id, score = zip(*out)
                yield pa.RecordBatch.from_arrays([
                    pa.array(item, pa.int32()), pa.array(item_id, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64()),
                ], names=["item", "item_id", "doc_id", "score"])

    some = own.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
    return some.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def best_rows(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key, numbered by ``rank``."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents (doc_id, text) of each item (item_id, text).

    Ties go to the smaller doc_id. One block of items is with the driver at a time, its results are stored.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()
    n_blocks = -(-max(size, 64 * total, 1) // block_bytes)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    found = None
    for block in range(n_blocks):
        top = block_top(docs, Items.of(dealt.where(F.col("block") == block).collect()), k)
        sliced = best_rows(top.withColumn("slice", F.pmod("doc_id", F.lit(SLICES))), ["item", "slice"], k)
        part = best_rows(sliced.drop("rank", "slice"), ["item"], k).select("item_id", "rank", "doc_id", "score")
        part = staged(part, "search-results") if n_blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found

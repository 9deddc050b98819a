"""Language ID by prediction by partial matching: per-language byte context trees, frozen after training.

A language is a tree of contexts of up to three bytes with the counts of the byte that followed. In a context, a byte
that was seen has its share of the counts; the others share the escape probability (method C: as many escape counts as
different bytes) in proportion to what the next shorter context gives them, seen bytes excluded. A text's code length
under a language is the exact sum over all its bytes; the shortest wins.

Training reads a bounded sample: about ``DOCS_PER_LANG`` whole documents of each language, chosen by a hash of doc_id.
What it collects is bounded by that sample. ``MODEL_BYTES`` bounds a worker's tables: bytes beyond the most frequent
ones count as one symbol with equal shares.

Defined results: a null text or one without letters is ``und`` with score 0; without any labelled row all texts are.
Equal code lengths go to the smaller language name. Repeated rows are predicted each. Extra columns are kept by
``predict``; its own output names replace clashing ones. A null doc_id counts as held out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forescale.llm.common import bounded, pieces, resident, staged

ORDER = 3
DOCS_PER_LANG = 1500
MODEL_BYTES = 64 << 20
PAD = b" " * ORDER
SEGMENT = 1 << 20


@dataclass
class Model:
    """Counts of byte strings of length ORDER + 1 by language; ``grams`` are the strings as big-endian numbers."""

    langs: list[str]
    grams: np.ndarray
    counts: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(lower_ascii(PAD + PAD.join(texts)), np.uint8).astype(np.uint32)
    if len(data) <= ORDER:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    grams = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    return np.unique(grams, return_counts=True)


def lower_ascii(data: bytes) -> bytes:
    return data.lower()


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Fit on labelled documents that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out())
    share = rows.groupBy("lang").agg((F.lit(float(docs_per_lang)) / F.count(F.lit(1))).alias("share"))
    draw = (F.xxhash64(F.col("doc_id"), F.lit(5)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("draw")
    share = staged(share, "language-shares")
    chosen = rows.select("lang", "text", draw).join(bounded(share, 2 * share.count()), "lang")
    sample = chosen.where("draw < share and text is not null").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                grams, n = gram_counts([t.encode() for t, of in zip(texts, langs) if of == lang])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    found = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(found.column("lang").to_pylist(), object)
    langs = sorted(set(names))
    grams, at = np.unique(found.column("gram").to_numpy().astype(np.uint32), return_inverse=True)
    counts = np.zeros((len(grams), len(langs)), np.int32)
    number = {lang: i for i, lang in enumerate(langs)}
    counts[at, np.array([number[x] for x in names], int) if len(names) else np.zeros(0, int)] = found.column("n").to_numpy()
    return Model(langs, grams, counts)


class Scorer:
    """Code lengths in bits: a symbol for each byte, and a table of ORDER + 1 symbols by language."""

    def __init__(self, model: Model, model_bytes: int = MODEL_BYTES):
        langs = max(1, len(model.langs))
        size = min(256, int((model_bytes / 4 / langs) ** (1 / (ORDER + 1))))
        weight = np.bincount((model.grams & 255).astype(np.int64), model.counts.sum(1), 256)
        order = np.argsort(-weight, kind="stable")
        own = sorted(b for b in order[: size - 1] if weight[b] > 0)
        self.size = size = len(own) + 1  # the last symbol stands for all other bytes
        self.symbol = np.full(256, size - 1, np.int32)
        self.symbol[own] = np.arange(len(own))
        upper = np.arange(65, 91)
        self.symbol[upper] = self.symbol[upper + 32]
        rest = np.log2(256 - 26 - len(own) or 1)
        numbers = [self.symbol[(model.grams >> np.uint32(8 * (ORDER - i))).astype(np.int64) & 255].astype(np.int64) for i in range(ORDER + 1)]
        at = sum(x * size ** (ORDER - i) for i, x in enumerate(numbers))
        block = size**ORDER  # strings that begin with the same symbol
        self.bits = np.empty((size * block, len(model.langs)), np.float32)
        for lang in range(len(model.langs)):
            counts = np.bincount(at, model.counts[:, lang], size * block).astype(np.float32).reshape(size, block)
            whole = counts.sum(0, dtype=np.float64)
            share = np.full((1, size), 1 / size)
            for k in range(ORDER):
                seen = whole.reshape(-1, size ** (k + 1)).sum(0).reshape(-1, size)
                share = self.refine(seen, np.tile(share, (len(seen) // len(share), 1)))
            for first in range(size):
                bits = -np.log2(self.refine(counts[first].reshape(-1, size), share))
                bits[:, size - 1] += rest
                self.bits[first * block : (first + 1) * block, lang] = bits.reshape(-1)

    @staticmethod
    def refine(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Shares in each context from its counts and the shares in the context without its first byte."""
        seen = counts > 0
        total, different = counts.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        left = np.maximum(1 - (shorter * seen).sum(1, keepdims=True), 1e-300)
        whole = different == counts.shape[1]  # nothing to escape to
        base = np.where(whole, total, total + different)
        return np.where(total == 0, shorter, np.where(seen, counts / np.maximum(base, 1), different / np.maximum(base, 1) * shorter / left))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), self.bits.shape[1]))
        blob, starts, ends, owners, at = [], [], [], [], 0
        for i, text in enumerate(texts):
            for start in range(0, len(text), SEGMENT):  # a long text goes on with the bytes before as context
                before = (PAD + text[max(0, start - ORDER) : start])[-ORDER:]
                part = text[start : start + SEGMENT]
                blob += [before, part]
                starts.append(at)
                at += len(part)
                ends.append(at)
                at += ORDER
                owners.append(i)
                if at > SEGMENT:
                    self.add(out, blob, starts, ends, owners)
                    blob, starts, ends, owners, at = [], [], [], [], 0
        self.add(out, blob, starts, ends, owners)
        return out

    def add(self, out: np.ndarray, blob: list[bytes], starts: list[int], ends: list[int], owners: list[int]) -> None:
        if not starts:
            return
        s = self.symbol[np.frombuffer(b"".join(blob), np.uint8)]
        at = s[:-3] * self.size
        for k in (1, 2):
            at += s[k : k - 3]
            at *= self.size
        at += s[3:]
        bits = np.vstack([np.take(self.bits, at, axis=0), np.zeros((1, self.bits.shape[1]), np.float32)])
        sums = np.add.reduceat(bits, np.array([starts, ends]).T.reshape(-1), axis=0, dtype=np.float64)[::2]
        np.add.at(out, owners, sums)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``df``, then lang_pred, score (posterior for equal priors) and bits, the best code length."""
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    kept = [f for f in df.schema.fields if f.name not in {m.name for m in made}]
    schema = T.StructType([*kept, *made])
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        scorer = resident(own.name, lambda: Scorer(own))
        for batch in pieces(batches, text, 4 << 20):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            if own.langs:
                bits = scorer.code_lengths([t.encode() for t in texts])
                best = bits.argmin(1)
                least = bits[np.arange(len(texts)), best]
                score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            else:
                best, least, score, letters = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
            langs = [own.langs[b] if ok else "und" for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(langs, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(least, mask=~letters)],
                names=schema.names,
            )

    return df.mapInArrow(run, schema)


def accepted(df: DataFrame, slack: float = 64.0, text: str = "text") -> DataFrame:
    """Rows of ``predict`` whose text is in a learned language: not ``und``, and shorter in its code than 8 bits a byte, give or take ``slack`` bits."""
    return df.where((F.col("lang_pred") != "und") & (F.col("bits") <= 8.0 * F.octet_length(F.col(text)) + slack))

"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Of two fingerprints that differ in at most three bits, one segment differs
in at most one. So each fingerprint looks up, for each segment, the Hamming ball of radius one around its value in the
table of segment values, and the complete distance of what it finds is checked. Of two values one bit apart exactly one
has that bit set, so it is enough that each clears its set bits: half the ball finds every pair once.

Dense groups: fingerprints that share all bits but one cleared bit are at most two apart, so they are linked without
looking at pairs; at most 65 share one. After that only pairs between different components are looked for, and in a
segment value where one component holds most rows, the rows of that component meet only the others.

Defined results: null texts and texts without words have fingerprint zero and are linked like any other; rows with the
same doc_id are fingerprinted each and share a component only if linked; a null doc_id is never the smallest of a
component unless nothing else is in it; extra columns are kept by ``fingerprints``, output names replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forescale.llm.common import pieces, staged, word_pieces
from forescale.llm.components import components

SHINGLE = 3
DISTANCE = 3  # the segments and the radius above are made for it
SEED = 42
_FLUSH = 1 << 15


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[list[int]]:
    """XXH64 of all word shingles, in lists of bounded length; fewer words than ``size`` are one shingle."""
    tail: list[bytes] = []
    made = False
    for words in word_pieces(text):
        words = tail + words
        if len(words) >= size:
            made = True
            yield hash_all(words, size)
            words = words[len(words) - size + 1 :]
        tail = words
    if not made and tail:
        yield [xxhash.xxh64_intdigest(b" ".join(tail), SEED)]


def hash_all(words: list[bytes], size: int) -> list[int]:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], SEED) for i, j in zip(starts, ends[size - 1 :].tolist())]


def majority(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Counts of set bits per group of hashes, groups starting at ``firsts``."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)


def simhash(texts: list[bytes]) -> np.ndarray:
    """Fingerprint of each text: a bit is set if more than half of the hashes have it."""
    ones, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[int] = []
    firsts: list[int] = []
    owners: list[int] = []

    def flush() -> None:
        if owners:
            np.add.at(ones, owners, majority(np.array(held, np.uint64), np.array(firsts)))
        held.clear(), firsts.clear(), owners.clear()

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text.lower()):  # on bytes this lowers A-Z only
            totals[i] += len(hashes)
            for at in range(0, len(hashes), _FLUSH):
                part = hashes[at : at + _FLUSH]
                firsts.append(len(held))
                owners.append(i)
                held += part
                if len(held) >= _FLUSH:
                    flush()
    flush()
    bits = (2 * ones > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df``, then ``fp long``, the 64 bits of the fingerprint."""
    kept = [f for f in df.schema.fields if f.name != "fp"]
    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 4 << 20):
            found = simhash([(t or "").encode() for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(found.view(np.int64))], names=schema.names)

    return df.mapInArrow(run, schema)


def cleared(value: Column, bits: int) -> Column:
    """The value and the value with each one of its set bits cleared."""
    ones = F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda m: value.bitwiseAND(m) != 0)
    return F.concat(F.array(value), F.transform(ones, lambda m: value.bitwiseXOR(m)))


def near_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of nodes (node, fp; fps distinct) that at most two bits set apart: enough of them to connect all such pairs."""
    keys = nodes.select("node", F.explode(cleared(F.col("fp"), 64)).alias("key"))
    groups = keys.groupBy("key").agg(F.collect_list("node").alias("of")).where(F.size("of") > 1)  # at most 65
    return groups.select(F.array_min("of").alias("b"), F.explode("of").alias("a")).where("a <> b").select("a", "b").distinct()


def far_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between different components of nodes (node, fp, component) at most ``distance`` bits apart."""
    segments = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    table = nodes.select("node", "fp", "component", F.posexplode(segments).alias("segment", "value"))
    balls = table.select("node", "fp", "component", "segment", F.explode(cleared(F.col("value"), 32)).alias("value"))
    sizes = table.groupBy("segment", "value", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("segment", "value").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("kinds"))
    left = balls.alias("x").join(main.alias("m"), ["segment", "value"])
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
    other = F.col("x.component") != F.col("y.component")
    same = [F.col("x.segment") == F.col("y.segment"), F.col("x.value") == F.col("y.value")]
    strangers = left.where("component <> main").select("node", "fp", "component", "segment", "value")
    members = left.where("component = main and kinds > 1").select("node", "fp", "component", "segment", "value")
    minor = table.join(main, ["segment", "value"]).where("component <> main").select("node", "fp", "component", "segment", "value")
    a = strangers.alias("x").join(table.alias("y"), [*same, other, close]).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    b = members.alias("x").join(minor.alias("y"), [*same, other, close]).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return a.unionByName(b).distinct()


def groups(rows: DataFrame) -> DataFrame:
    """fp, whole (one fingerprint of the group) and component_id, the smallest doc_id that rows (doc_id, fp) reach over links of at most three bits."""
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints").withColumn("node", F.col("fp"))
    near = components(near_links(nodes))
    merged = staged(nodes.join(near, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-components")
    of = {row: merged.select(F.col("node").alias(row), F.col("component").alias(f"{row}_component")) for row in ("a", "b")}
    links = far_links(merged).join(of["a"], "a").join(of["b"], "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b"))
    far = components(links).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    final = merged.join(far, "component", "left").withColumn("whole", F.coalesce("whole", "component"))
    least = final.groupBy("whole").agg(F.min("least").alias("component_id"))
    return final.select("fp", "whole").join(least, "whole").select("fp", "whole", "component_id")


def dedup_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    rows = staged(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "document-fingerprints")
    return rows.join(groups(rows), "fp", "left").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay: of each group one, the smallest doc_id (of rows that share it, the smallest text hash).

    A row that is equal to the one that stays in doc_id and text goes too, except that rows without a doc_id stay.
    """
    hashed = F.xxhash64("text")
    rows = staged(fingerprints(docs.select("doc_id", "text", hashed.alias("text_hash"))).select("doc_id", "text_hash", "fp"), "document-fingerprints")
    grouped = rows.where("doc_id is not null").join(groups(rows).select("fp", "whole"), "fp")
    kinds = grouped.groupBy("whole", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    stays = staged(kinds.groupBy("whole").agg(F.min(F.struct("doc_id", "text_hash", "copies")).alias("stays")).select("stays.*"), "document-stays").alias("stays")
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    id_, text = F.col("row")["doc_id"], F.col("row")["text"]
    found = whole.join(stays, (id_ == F.col("stays.doc_id")) & (F.xxhash64(text) == F.col("stays.text_hash")))
    once = found.where(F.col("stays.copies") == 1).select("row")
    again = found.where(F.col("stays.copies") > 1).select("row", id_.alias("id"), text.alias("text")).dropDuplicates(["id", "text"]).select("row")
    return once.unionByName(again).unionByName(whole.where(id_.isNull())).select("row.*")

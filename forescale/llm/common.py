"""Helpers that several operators share: reading, staging, words and batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forescale.session import shared_dir

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


#: What is looked for in a large table is broadcast up to so many numbers, else joined by a shuffle.
BROADCAST_NUMBERS = 4_000_000

_resident: dict[object, object] = {}


def resident(key: object, make: Callable[[], Any]) -> Any:
    """The model a worker holds; asking for another one drops it, so reused workers hold one at a time."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def bounded(df: DataFrame, numbers: int) -> DataFrame:
    """``df``, to be broadcast if it holds few enough numbers."""
    return F.broadcast(df) if numbers <= BROADCAST_NUMBERS else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_pieces(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in lists of about ``size`` bytes, so that a huge text needs little memory."""
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = _SPACE.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``size`` bytes, one row at least."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)

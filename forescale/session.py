"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_local_folders: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """All instants are UTC; everything else stays as the cluster set it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, for tables written between steps.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that names none
    gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="forescale-")
    return _local_folders[app]


_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "double": pa.float64(), "string": pa.string(),
    "boolean": pa.bool_(), "date": pa.date32(), "timestamp": pa.timestamp("us", "UTC"), "array<string>": pa.list_(pa.string()),
}


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Literal rows as a local relation: its size is known, so joins with it are planned right."""
    fields = T.StructType.fromDDL(schema).fields
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(values, _ARROW[f.dataType.simpleString()]) for values, f in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=[f.name for f in fields]))

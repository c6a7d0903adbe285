"""What the operators of this folder share: scratch tables, words, inputs as two plain columns."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII blanks; `bytes.split` cuts the same.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared storage that ``spark.checkpoint.dir`` names.

    Where a local session (tests, a laptop) names none, one is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Written once to shared storage and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_by_worker(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in each Python worker and kept from task to task.

    The code of this package travels by value, so its own globals are new in each task.
    """
    keep = sys.modules.setdefault("colprism worker state", ModuleType("colprism worker state")).__dict__
    if name not in keep:
        keep[name] = make()
    return keep[name]


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that other columns cannot clash."""
    return df.select(*[column(old).alias(new) for new, old in columns.items()])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def modulo_crc(id_column: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "UTF-8")) % m


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column as one array, and where each row starts and ends in it.

    Null texts are empty.  No copy of the text is made.
    """
    array = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = array.buffers()
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    cuts = np.frombuffer(offsets, kind, n + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[cuts[0] : cuts[-1]], cuts - cuts[0]


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """Row by row, so that the batch is not held twice."""
    whole, cuts = text_bytes(batch, name)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield whole[a:b].tobytes()

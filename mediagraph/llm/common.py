"""What several corpus operators share: scratch tables, tables by name and free column names."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mediagraph.operators.graph import saved, scratch_path

__all__ = ["as_bytes", "fresh", "kept", "saved", "scratch_path", "spread", "table"]


_KEPT: dict = {}


def kept(key, build):
    """What build makes, kept in this Python worker for its next tasks, until another key is asked for: what an operator remembers goes
    when the worker turns to another one."""
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = build()
    return _KEPT[key]


def give_back() -> None:
    """Returns freed memory of this Python worker to the system, as the executor's processes share one limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(stored: DataFrame) -> DataFrame:
    """A stored table, dealt out over all cores where it would be read in fewer parts: a row group is never read by two tasks. A table
    of as many parts as cores, or more, isn't moved."""
    cores = stored.sparkSession.sparkContext.defaultParallelism
    return stored.repartition(cores) if stored.rdd.getNumPartitions() < cores else stored


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df lacks, so that a helper column never clashes with a given one."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_bytes(value) -> bytes:
    """UTF-8 bytes of an Arrow string scalar; null is empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")

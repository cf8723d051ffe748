"""What the operators of this subpackage share: tables, written intermediates and word splitting."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.shared import cached, delete, drop, exists, new_path, shared_dir, written  # noqa: F401

#: Words are maximal runs without these six white-space characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(kind: str, name: str, make):
    """make()'s value, kept until another name of this kind is asked for."""
    store = sys.__dict__.setdefault("_pageloom_cache", {})
    if store.get(kind, (None,))[0] != name:
        store.pop(kind, None)
        store[kind] = (name, make())
    return store[kind][1]


def slices(batch, size: int = 4 << 20):
    """An Arrow batch in runs of rows whose texts, in the last column, have about this many bytes; one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(text: Column) -> Column:
    """Array of a text's words; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def has(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so further columns of the input cannot clash with an operator's own."""
    return df.select(*names)

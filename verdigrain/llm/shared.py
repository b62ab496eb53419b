"""Folders and Arrow helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigrain.session import dropped_tables, fresh_path, shared_dir, stored

__all__ = ["buffers", "dropped_tables", "fresh_path", "hot_keys", "join_hot", "released", "shared_dir", "slices", "stored", "text_or_empty"]

#: Bytes of text that vectorised code works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def join_hot(rows: DataFrame, leads: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """rows.join(leads, keys) where some keys hold much of the rows: those in `hot`, fewer than a thousand.

    Hot leads are broadcast and meet the rows where those are; the others meet by sort-merge.
    """
    few = F.broadcast(hot.select(*keys))
    near = rows.join(F.broadcast(leads.join(few, keys, "left_semi")), keys)
    return near.unionByName(rows.join(few, keys, "left_anti").join(leads.hint("merge"), keys))


def hot_keys(groups: DataFrame, size: str) -> DataFrame:
    """The groups that hold over a thousandth of all rows each: there are fewer than a thousand of them."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    return groups.where(F.col(size) * 1000 > total)


def released() -> None:
    """Give freed memory back to the system, where its C library can: Python workers are kept between stages."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of at most so many bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j

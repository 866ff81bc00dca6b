"""mapInArrow over texts in bounded chunks, with a shared way to name columns and keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _words as W


def select_text(df: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """The two columns that an operator reads, and more as name=column, renamed so that no other column clashes; rows without an id go."""
    cols = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    return df.select(*cols, *[F.col(f"`{c}`").alias(name) for name, c in more.items()]).where(F.col("doc_id").isNotNull())


def map_texts(df: DataFrame, f: Callable[[np.ndarray, list], dict | None], schema: str) -> DataFrame:
    """Apply f(ids, texts) -> columns to chunks of rows (doc_id, text); a chunk that gives None has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            texts = texts.to_pylist()
            for i, j in W.chunks(texts):
                out = f(ids[i:j], texts[i:j])
                if out is not None and len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})

    return df.select("doc_id", "text").mapInArrow(run, schema)


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A 2-d array as binary values, one a row, without a loop."""
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.shape[1] * rows.itemsize if rows.ndim == 2 else 0
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def lists(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """Lists values[ptr[i]:ptr[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(ptr, np.int32)), pa.array(values))

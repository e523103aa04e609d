"""Arrow helpers for functions that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.llm.words import utf8_buffers

SLICE_BYTES = 2 << 20
"""Text bytes handled at a time inside a task; a longer single text is a slice of its own."""


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about ``most`` bytes of ``column``; no empty ones."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8_buffers(batch.column(column))
        if offsets[-1] - offsets[0] <= most:
            yield batch
            continue
        piece = (offsets[:-1] - offsets[0]) // most
        edges = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [batch.num_rows]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)


def column(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(names: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column is called so."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def as_arrow(schema: str) -> pa.Schema:
    """``"a long, b string"`` as an Arrow schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by integer ``keys``, one table at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]]).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)

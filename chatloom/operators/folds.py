"""Folds over the rows of a key in order, of which a task holds one batch and one state at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _changes(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, tuple]]:
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield row[:n_keys], row[n_keys:]


def _sorted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*rows.columns)


def fold_keys(rows: DataFrame, keys: list[str], step: Callable[[object, tuple], object], out: str) -> DataFrame:
    """The keys and a double column ``out``, the state after each key's last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, fields = None, None, None
        for batch in batches:
            fields, done = [batch.schema.field(i) for i in range(len(keys))], []
            for key, row in _changes(batch, len(keys)):
                if key != last:
                    if last is not None:
                        done.append((*last, state))
                    last, state = key, None
                state = step(state, row)
            yield _rows(done, fields)
        if last is not None:
            yield _rows([(*last, state)], fields)

    def _rows(done: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
        kinds = [*(f.type for f in fields), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names=[*keys, out])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return _sorted(rows, keys).mapInArrow(run, f"{schema}, `{out}` double")

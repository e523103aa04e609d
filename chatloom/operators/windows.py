"""Windows that begin with their first event, for keys of any size: each key's rows are shared out over tasks.

A window of ``window_ms`` begins at the first row at or after the end of the one before it, so what a window's start does is jump to
the first row ``window_ms`` later.  The rows of equal key and time become one with its number; these are dealt by ranges of
(key, time) into chunks, so a hot key has many.  For a key that goes on from an earlier chunk, a chunk is a function from the
last start before it to the last start inside it.  The first start inside is a row of the chunk's first ``window_ms``, so the function has no
more steps than there are times in one window, and few where ways from different rows soon meet.  Every chunk
sends its steps; a pass over these, key by key, gives each chunk the start that it goes on from, and the chunks then mark their rows by themselves.

Inside a chunk, jumps are found by binary search and followed by pointer doubling, all rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import ship, written

_NONE = np.iinfo(np.int64).min


def group_numbers(columns: list[pa.Array]) -> np.ndarray:
    """A number for each row that grows by one where any column changes; nulls are equal."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    for column in columns:
        if pa.types.is_dictionary(column.type):
            column = column.dictionary_decode()
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def jumps(group: np.ndarray, times: np.ndarray, window_ms: int) -> np.ndarray:
    """For each row (sorted by group and time) the first row of its group at least ``window_ms`` later, or the number of rows."""
    n = len(times)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.searchsorted(group, group, side="right")
    span = int(times.max()) - int(times.min()) + window_ms + 1
    out = np.empty(n, np.int64)
    at = 0
    while at < n:  # as many groups at a time as fit into 63 bits
        stop = int(np.searchsorted(group, group[at] + max((1 << 62) // span, 1)))
        place = (group[at:stop] - group[at]) * span + (times[at:stop] - times.min())
        out[at:stop] = np.searchsorted(place, place + window_ms) + at
        at = stop
    return np.where(out < ends, out, n)


def followed(starts: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """Which rows are reached from ``starts`` (a mask) by jumping on, by pointer doubling."""
    n = len(jump)
    reached, ahead = np.append(starts, False), np.append(jump, n)
    while True:
        new = reached.copy()
        new[ahead[reached]] = True
        new[n] = False
        if (ahead == n).all():
            return new[:n]
        reached, ahead = new, ahead[ahead]


def lasts(jump: np.ndarray) -> np.ndarray:
    """The last row on the way from each row."""
    n = len(jump)
    last = np.where(jump < n, jump, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def _edge_steps(chunk: int, table: pa.RecordBatch, keys: int, window_ms: int) -> Iterator[pa.RecordBatch]:
    """The step function of a chunk's first key, and what its last key has come to, as rows (keys, chunk, upper, start, after, total)."""
    times, n = table.column(keys).to_numpy(), table.column(keys + 1).to_numpy()
    group = group_numbers([table.column(i) for i in range(keys)])
    for g in {0, int(group[-1])}:
        a, b = np.searchsorted(group, [g, g + 1]).tolist()
        last = lasts(jumps(group[a:b], times[a:b], window_ms))
        entries = int(np.searchsorted(times[a:b], times[a] + window_ms)) + 1  # what can be the first start of a key that goes on
        steps = np.flatnonzero(np.append(np.diff(last[:entries]) != 0, True)) if g == 0 else np.zeros(1, np.int64)
        upto = np.concatenate([np.cumsum(n[a:b][::-1])[::-1], [0]])
        columns = [table.column(i).take(pa.array(np.full(len(steps), a))) for i in range(keys)]
        values = (np.full(len(steps), chunk), times[a:b][steps], times[a:b][last[steps]], upto[last[steps]], np.full(len(steps), upto[0]))
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v) for v in values)], names=[*table.schema.names[:keys], "chunk", "upper", "start", "after", "total"])


def _chunks(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each chunk in one batch; a task's rows are sorted by chunk."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch.column(batch.schema.get_field_index(by)).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [batch.num_rows]]).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a < b:
                if held and held[0].column(batch.schema.get_field_index(by))[0].as_py() != number[a]:
                    yield _joined(held, by)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held, by)


def _joined(held: list[pa.RecordBatch], by: str) -> tuple[int, pa.RecordBatch]:
    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return whole.column(whole.schema.get_field_index(by))[0].as_py(), whole


def _composed(keys: int, window_ms: int):
    """For every chunk that a key goes on in: the last start before it and the rows since, from steps sorted by key, chunk and upper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, state, open_chunk, done = None, None, None, False
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, (chunk, upper, start, after, total) = row[:keys], row[keys:]
                if key != last_key:
                    last_key, state, open_chunk = key, None, None
                if chunk != open_chunk:
                    if open_chunk is not None and not done:  # the chunk before had no row late enough
                        state = (state[0], state[1] + left)
                    open_chunk, done, left = chunk, False, total
                    if state is not None:
                        out.append((*key, chunk, *state))
                if not done and (state is None or state[0] + window_ms <= upper):
                    state, done = (start, after), True
            columns = [pa.array([r[i] for r in out], batch.schema.field(i).type) for i in range(keys)]
            columns += [pa.array([r[keys + i] for r in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:keys], "chunk", "goes_on", "since"])

    return run


def _marked(keys: int, window_ms: int):
    """A chunk's rows with the start of the window that they are in and the number of rows in it before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _chunks(batches, "chunk"):
            times, n = rows.column(keys).to_numpy(), rows.column(keys + 1).to_numpy()
            group = group_numbers([rows.column(i) for i in range(keys)])
            size = len(times)
            starts = np.diff(group, prepend=-1) > 0
            goes_on, since = (rows.column(rows.schema.get_field_index(c))[0].as_py() for c in ("goes_on", "since"))
            if goes_on is not None:
                end = int(np.searchsorted(group, 0, side="right"))
                entry = int(np.searchsorted(times[:end], goes_on + window_ms))
                starts[0] = False
                starts[entry : entry + (entry < end)] = True
            marked = followed(starts, jumps(group, times, window_ms))
            at = np.maximum.accumulate(np.where(marked, np.arange(size), -1))
            so_far = np.concatenate([[0], np.cumsum(n)[:-1]])
            start = np.where(at >= 0, times[at], goes_on if goes_on is not None else _NONE)
            before = np.where(at >= 0, so_far - so_far[at], so_far + (since or 0))
            columns = [rows.column(i) for i in range(keys + 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(start), pa.array(before)], names=[*rows.schema.names[: keys + 2], "start", "before"])

    return run


def window_starts(rows: DataFrame, keys: list[str], time: str, window_ms: int) -> DataFrame:
    """(keys, time, n, start, before) for each distinct key and time: its rows, the start of its window, and the window's rows before it.

    Rows without a time go.  No task holds more than a range of (key, time), whatever a key's share of the rows.
    """
    if window_ms <= 0:
        raise ValueError("a window takes some time")
    ship(rows.sparkSession)
    known = rows.select(*keys, F.col(time).cast("long").alias(time)).filter(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n"))
    order = [*keys, time]
    ranged = written(known.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id().cast("long")), "window-ranges")
    dealt = ranged.repartition("chunk").sortWithinPartitions("chunk", *order)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in _chunks(batches, "chunk"):
            yield from _edge_steps(chunk, table, len(keys), window_ms)

    fields = ", ".join(f"`{k}` {ranged.schema[k].dataType.simpleString()}" for k in keys)
    found = dealt.mapInArrow(steps, f"{fields}, chunk long, upper long, start long, after long, total long")
    found = found.repartition(*keys).sortWithinPartitions(*keys, "chunk", "upper")
    entries = written(found.mapInArrow(_composed(len(keys), window_ms), f"{fields}, chunk long, goes_on long, since long"), "window-entries")
    entries = entries.select("chunk", *(F.col(k).alias(f"{k}_entry") for k in keys), "goes_on", "since")
    same = F.col("chunk") == F.col("entry_chunk")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_entry"))
    with_entry = ranged.join(F.broadcast(entries.withColumnRenamed("chunk", "entry_chunk")), same, "left").select(*order, "n", "chunk", "goes_on", "since")  # a row for each chunk at most
    with_entry = with_entry.repartition("chunk").sortWithinPartitions("chunk", *order)
    return with_entry.mapInArrow(_marked(len(keys), window_ms), f"{fields}, `{time}` long, n long, start long, before long")

"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes; each partition is sorted externally by Spark, so equal
texts are adjacent, and neighbouring rows are compared in full.  The splitter key is bounded (the first 32
bytes, a 64-bit hash of the whole text and the identifier), so the driver's sample never holds whole texts, and
a group of copies of any size is dealt over as many partitions as it needs: the identifier is part of the key.
Only runs at a partition's edges can go on in another partition.  They are summed up over all partitions, at most two
for each, told apart by the SHA-256 of their texts, and rows of such runs are joined with the sums by digest and
partition: a key of this join has the rows of one partition at most, however large its group is.

Defined results: a null text counts as empty; a very long text is compared and hashed whole; null identifiers never win over others; of rows that repeat an
identifier and a text, one is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.batches import as_arrow, column
from chatloom.session import written

PREFIX_BYTES = 32
_RUNS = "doc_id long, text_sha256 string, local_keep long, local_size long, leads boolean, at_edge boolean, part int"


def _mark_runs(largest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = as_arrow(_RUNS)
        part_no = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, str]] = []  # rows of the splitter key at hand: ids, nulls, digest
        key, body, first_key = None, None, True

        def flush(edge: bool) -> pa.RecordBatch:
            runs: dict[str, list] = {}
            for ids, null, digest in held:
                runs.setdefault(digest, []).append((ids, null))
            parts: list[list] = [[] for _ in schema]
            for digest, pieces in runs.items():
                ids = np.concatenate([p[0] for p in pieces])
                null = np.concatenate([p[1] for p in pieces])
                known = ids[~null]
                best = None if not len(known) else int(known.max() if largest else known.min())
                leads = np.ones(len(ids), bool)
                leads[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
                n = len(ids)
                for part, value in zip(parts, (pa.array(ids, pa.int64(), mask=null), pa.repeat(digest, n), pa.array([best], pa.int64()).take(pa.array(np.zeros(n, np.int64))), pa.repeat(pa.scalar(n, pa.int64()), n), pa.array(leads), pa.repeat(edge, n), pa.repeat(part_no, n)), strict=True):
                    part.append(value)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(f.type) for x in p]) for p, f in zip(parts, schema, strict=True)], schema=schema)

        ready: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            prefix, h, bodies, ids = (batch.column(c) for c in ("prefix", "h", "body", "doc_id"))
            null = np.asarray(ids.is_null())
            values = ids.fill_null(0).to_numpy()
            new_body = np.ones(n, bool)
            new_key = np.ones(n, bool)
            if n > 1:
                new_body[1:] = ~np.asarray(pc.equal(bodies.slice(1), bodies.slice(0, n - 1)))
                new_key[1:] = ~np.asarray(pc.and_(pc.equal(h.slice(1), h.slice(0, n - 1)), pc.equal(prefix.slice(1), prefix.slice(0, n - 1))))
            head = (prefix[0].as_py(), h[0].as_py())
            new_key[0] = head != key
            new_body[0] = new_key[0] or bodies[0].as_py() != body
            starts = np.flatnonzero(new_body)
            edges = np.concatenate([starts if len(starts) and starts[0] == 0 else np.concatenate([[0], starts]), [n]]).astype(np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if new_key[a] and held:
                    done = flush(first_key)
                    first_key = False
                    ready.append(done)
                    rows += done.num_rows
                    if rows >= 5000:
                        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                        ready, rows = [], 0
                digest = hashlib.sha256(bodies[a].as_buffer()).hexdigest() if new_body[a] else held[-1][2]
                held.append((values[a:b], null[a:b], digest))
            key, body = (prefix[n - 1].as_py(), h[n - 1].as_py()), bodies[n - 1].as_py()
        if held:
            ready.append(flush(True))
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return mark


def content_sort(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    ``keep`` is ``"smallest"`` or ``"largest"``: which identifier of equal texts stays.
    """
    body = F.coalesce((normalise or (lambda c: c))(column(text)), F.lit("")).cast("binary")
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), body.alias("body"))
    rows = rows.select("doc_id", "body", F.substring("body", 1, PREFIX_BYTES).alias("prefix"), F.xxhash64("body").alias("h"))
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    ranged = rows.repartitionByRange("prefix", "h", order).sortWithinPartitions("prefix", "h", "body", order)
    runs = written(ranged.mapInArrow(_mark_runs(keep == "largest"), _RUNS), "content-runs")
    best = F.max if keep == "largest" else F.min
    edges = written(runs.filter("at_edge").groupBy("text_sha256", "part").agg(F.count(F.lit(1)).alias("n"), best("doc_id").alias("b")), "content-edges")
    groups = edges.groupBy("text_sha256").agg(F.sum("n").alias("size"), best("b").alias("best"))
    edges = edges.join(groups, "text_sha256").select("text_sha256", "part", "size", "best")
    inner = runs.filter(~F.col("at_edge")).withColumns({"size": F.col("local_size"), "best": F.col("local_keep")})
    out = inner.unionByName(runs.filter("at_edge").join(edges, ["text_sha256", "part"]))
    return out.select(
        "doc_id",
        F.col("best").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("best"))).alias("kept"),
        "text_sha256",
    )

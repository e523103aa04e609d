"""Vector code compression: product codes with integer codebooks, assigned behind segment-mean lower bounds.

A component x becomes floor(``SCALE`` * x) and a vector is cut into equal consecutive parts.  Each part position has a
codebook that starts as that part of the vectors of the smallest identifiers; every round assigns all parts to their nearest
entries and puts the floor of its parts' mean in an entry's place.  All values are integers, so results don't depend on how
rows are dealt.

The nearest entry is found coarse to fine.  With a block's sum s, length m and residual norm r (the norm of what is left
without the block's mean), (s - s')^2 / m + (r - r')^2 is no more than the squared distance inside the block, so the sum over
blocks bounds the distance from below.  Blocks start as whole parts and are halved until they are single components; entries whose bound
(less what rounding may add) is over the distance of the likeliest entry go, and survivors get exact integer distances.

Each round is one pass whose tasks send a sum and a count for each cell of the codebooks; the driver holds codebooks and at most
``entries`` vectors.  Sums over labels are aggregated before they are joined back; they are broadcast where they are no more than
``MOST_BROADCAST`` rows, else Spark joins by label and splits a frequent one.

Defined results: a vector that is null, holds a null or non-finite component, or has another length than the one of the least
identifier whose length is a positive multiple of ``parts`` (empty ones too) goes; so does one with a component beyond ``LARGEST``, as distances
would not fit a long.  Rows without an identifier are coded and seed a codebook only after all others; rows that repeat an identifier
are vectors of their own, in the order of their components when seeding; null labels are one label; with fewer vectors than
``entries`` the codebooks are shorter; very long vectors have longer parts; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.batches import as_arrow, column
from chatloom.session import ship, written

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LARGEST = float(1 << 19)
ROWS_AT_ONCE = 4096
MOST_BROADCAST = 100_000
_SLACK, _SLACK_PLUS = 2e-9, 0.01
"""More than rounding can add to a bound, as a share of it and beside."""


@dataclass(frozen=True)
class Codebooks:
    """``entries``: (parts, entries, components of a part)."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def block_edges(length: int) -> list[np.ndarray]:
    """Edges of the blocks at each level: the whole part, halves, and so on down to single components."""
    levels, edges = [], np.array([0, length])
    while length:
        levels.append(edges)
        if len(edges) == length + 1:
            break
        middle = (edges[:-1] + edges[1:]) // 2
        edges = np.unique(np.concatenate([edges, middle]))
    return levels


def _blocks(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and root of length times squared residual, for each row and block, over the root of the block's length."""
    length = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    spread = np.maximum(length * np.add.reduceat(x.astype(np.float64) ** 2, edges[:-1], axis=1) - sums.astype(np.float64) ** 2, 0)
    return sums / np.sqrt(length), np.sqrt(spread / length)


def lower_bounds(means: np.ndarray, norms: np.ndarray, entry_means: np.ndarray, entry_norms: np.ndarray) -> np.ndarray:
    """No more than the squared distances, rounding included."""
    bound = ((means - entry_means) ** 2).sum(-1) + ((norms - entry_norms) ** 2).sum(-1)
    return bound * (1 - _SLACK) - _SLACK_PLUS


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (the lower one of equals) and the squared distance to it."""
    first, *finer = block_edges(x.shape[1])
    means, norms = _blocks(x, first)
    entry_means, entry_norms = _blocks(entries, first)
    bound = lower_bounds(means[:, None], norms[:, None], entry_means[None], entry_norms[None])
    reach = ((x - entries[bound.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(bound <= reach[:, None])
    for edges in finer:
        means, norms = _blocks(x, edges)
        entry_means, entry_norms = _blocks(entries, edges)
        left = lower_bounds(means[row], norms[row], entry_means[entry], entry_norms[entry]) <= reach[row]
        row, entry = row[left], entry[left]
    distance = ((x[row] - entries[entry]) ** 2).sum(1)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(distance, starts)
    hit = np.flatnonzero(distance == np.repeat(least, np.diff(np.append(starts, len(row)))))
    hit = hit[np.diff(row[hit], prepend=-1) > 0]
    return entry[hit], least


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows, their parts (rows, parts, components), entry numbers and distances (rows, parts)."""
    parts, _, length = books.shape
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(values * SCALE).astype(np.int64).reshape(batch.num_rows, parts, length)
            found = [nearest(np.ascontiguousarray(x[:, p]), books[p]) for p in range(parts)]
            yield batch, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _cell_sums(books: np.ndarray):
    """Sum of every component and count of rows, for each cell of the codebooks that a task's rows use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, length = books.shape
        sums, count = np.zeros((parts * entries, length), np.int64), np.zeros(parts * entries, np.int64)
        for _, x, code, _ in _assigned(batches, books):
            cell = (code + np.arange(parts) * entries).reshape(-1)
            np.add.at(sums, cell, x.reshape(-1, length))
            count += np.bincount(cell, minlength=parts * entries)
        used = np.flatnonzero(count)
        place = (used[:, None] * length + np.arange(length)).reshape(-1)
        rows = (place, np.repeat(count[used], length), sums[used].reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], schema=as_arrow("place long, n long, total long"))

    return run


def usable(vectors: DataFrame, parts: int, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> tuple[DataFrame, int]:
    """(vec_id, vector, label) of the vectors that can be coded, and the length of these, 0 if there is none."""
    rows = vectors.select(column(vec_id).cast("long").alias("vec_id"), column(vector).alias("vector"), column(label).alias("label"))

    def fits(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)

    rows = rows.filter(F.col("vector").isNotNull() & F.forall("vector", fits))
    size = F.size("vector")
    first = rows.filter((size > 0) & (size % parts == 0)).orderBy(F.col("vec_id").asc_nulls_last(), size).select(size).head()
    return rows.filter(size == (first[0] if first else -1)), first[0] if first else 0


def learn_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the rows that :func:`usable` gives."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so a codebook has 1 to 256 entries")
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).toArrow()  # bounded by entries
    values = np.array(seeds["vector"].to_pylist(), np.float64).reshape(len(seeds), parts, -1)
    books = np.floor(values * SCALE).astype(np.int64).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(seeds) else 0):
        total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        sums = rows.select("vector").mapInArrow(_cell_sums(books), "place long, n long, total long").groupBy("place").agg(F.sum("n").alias("n"), total)
        new = books.reshape(-1).copy()
        for place, n, value in sums.collect():  # at most one for each number in the codebooks
            new[place] = int(value) // n
        books = new.reshape(books.shape)
    return Codebooks(books)


def encode(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances, summed over parts); no shuffle."""
    books, kind = codebooks.entries, rows.schema["label"].dataType.simpleString()
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, code, distance in _assigned(batches, books):
            codes = pa.array(["".join(r) for r in digits[code].tolist()], pa.string())
            arrays = [batch.column("vec_id"), batch.column("label"), codes, pa.array(distance.sum(1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "vector", "label").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decode(codes: DataFrame, codebooks: Codebooks, code: str = "code") -> DataFrame:
    """``codes`` with the vectors that their codes stand for, as ``decoded``."""
    books = codebooks.entries.tolist()  # a proven size: parts, entries and components
    table = F.array(*(F.array(*(F.array(*(F.lit(v / SCALE) for v in entry)) for entry in part)) for part in books))
    numbers = [F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books))]
    return codes.withColumn("decoded", F.flatten(F.array(*(table[p][n] for p, n in enumerate(numbers)))))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error (error summed over equal labels), codebooks_sha256."""
    spark = ship(vectors.sparkSession)
    rows, length = usable(vectors, parts, vector, vec_id, label)
    if not length:
        kind = vectors.schema[label].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    codebooks = learn_codebooks(rows, parts, entries, rounds)
    coded = written(encode(rows, codebooks), "vector-codes")
    sums = written(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "vector-labels")
    sums = F.broadcast(sums) if sums.count() <= MOST_BROADCAST else sums
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
    return out.withColumn("codebooks_sha256", F.lit(codebooks.sha256))

"""Toxicity by a classifier chain of linear models over the presence of hashed subwords.

Categories are predicted one after the other; each later model also takes the probabilities of the earlier ones.
In training these are out-of-fold predictions, so a later model sees what it will see when scoring.  A model is a
logistic regression with an L2 penalty over the subwords (byte n-grams of words framed by boundaries) that best
separate its category, chosen by chi-square and scaled by their log-odds inside the fold, so that rare but telling
ones are learned as fast as common ones.

Training uses a bounded sample of labelled documents, at most ``STRATUM_ROWS`` for each combination of categories,
those of the smallest hash of doc_id; of rows that repeat an identifier the least text is the document's.  Subwords are counted on the
executors; the driver gets the ``KEPT`` best buckets of each fit and, for each row of the sample, which of these it has, never texts.
Scoring is one pass over all documents with the weights (a fixed size) in the task's closure.

Defined results: null and empty texts have no subwords and get the models' intercepts; rows with a null label in any
category aren't used in training; repeated labels of a document count once, as positive if any is; a category with
only one class in the sample always predicts that class; with no labels every probability is 0; repeated rows
repeat their result; a probability of exactly the threshold is positive; very long texts count whole, in parts; an empty ``docs`` gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.batches import as_arrow, column, text_slices
from chatloom.llm.sampling import smallest_hashes
from chatloom.llm.words import subword_hashes
from chatloom.session import ship, written

BITS = 21
BUCKETS = 1 << BITS
STRATUM_ROWS = 1500
LEAST_ROWS = 3
SIZES = (4, 5, 6)
KEPT = 2000
LEAST_CHI = 15.0
PART_BYTES = 1 << 17
FOLDS = 3
STEPS = 150
PENALTY = 1.0


def subword_buckets(texts: list[bytes], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct subwords of every text, in order; only the ``chosen`` buckets where given.

    Texts go through in parts of ``PART_BYTES``; a longer one is cut, and its parts' subwords are put together.  Parts
    overlap by as much as a subword may reach over the cut, and a cut is no boundary, so cutting changes nothing.
    """
    over = max(SIZES) - 1
    parts: list[tuple[int, bytes, bool, bool]] = [
        (i, t[max(a - over, 0) : a + PART_BYTES], a > over, a + PART_BYTES < len(t)) for i, t in enumerate(texts) for a in range(0, len(t), PART_BYTES)
    ]
    keys, at = [], 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end][1]) <= PART_BYTES):
            size += len(parts[end][1])
            end += 1
        own = parts[at:end]
        hashes, offsets = subword_hashes([p[1] for p in own], SIZES, np.array([p[2] for p in own]), np.array([p[3] for p in own]))
        bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        key = np.repeat(np.array([p[0] for p in own], np.int64), np.diff(offsets)) * BUCKETS + bucket
        keys.append(np.unique(key if chosen is None else key[chosen[bucket]]))
        at = end
    every = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return every // BUCKETS, every % BUCKETS


@dataclass(frozen=True)
class Linear:
    """``weights`` over buckets, then one for each earlier category."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sample:
    """The distinct subword buckets of some rows, an array for each, so that no step needs them all in one.

    ``rows`` has places in ``buckets``, those that any row has, so that a fit's arrays are as long as these, not as all buckets.
    """

    def __init__(self, rows: list[np.ndarray]) -> None:
        met = np.zeros(BUCKETS, bool)
        for x in rows:
            met[x] = True
        self.buckets = np.flatnonzero(met)
        self.rows = [np.searchsorted(self.buckets, x).astype(np.int32) for x in rows]

    def scores(self, model: Linear, earlier: np.ndarray) -> np.ndarray:
        dense = np.zeros(len(self.buckets))
        dense[np.searchsorted(self.buckets, model.buckets)] = model.weights
        return np.array([dense[x].sum() for x in self.rows]) + earlier @ model.earlier + model.bias


def fit(sample: Sample, rows: np.ndarray, label: np.ndarray, earlier: np.ndarray) -> Linear:
    """Fit one category on some rows by accelerated gradient steps."""
    y = label[rows].astype(np.float64)
    k = earlier.shape[1]
    if not len(rows) or y.min() == y.max():
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(k), 40.0 if len(rows) and y[0] else -40.0)
    n, positive = len(rows), y.sum()
    seen, hit = np.zeros(len(sample.buckets)), np.zeros(len(sample.buckets))
    for r, label_of_row in zip(rows, y, strict=True):
        seen[sample.rows[r]] += 1
        hit[sample.rows[r]] += label_of_row
    expected = seen * positive / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (hit - expected) ** 2 / (expected * (1 - positive / n) * (1 - seen / n + 1e-9))
    chi[(seen < LEAST_ROWS) | ~np.isfinite(chi)] = 0
    kept = np.argsort(-chi, kind="stable")[:KEPT]
    kept = kept[chi[kept] > LEAST_CHI]
    odds = np.log((hit[kept] + 0.5) / (positive + 1)) - np.log((seen[kept] - hit[kept] + 0.5) / (n - positive + 1))
    scale = np.concatenate([odds, np.ones(k)])
    place = np.full(len(sample.buckets), -1)
    place[kept] = np.arange(len(kept))
    own = [p[p >= 0] for p in (place[sample.rows[r]] for r in rows)]
    column = np.concatenate([*own, np.repeat(np.arange(k) + len(kept), n)]).astype(np.int64)
    at = np.concatenate([np.repeat(np.arange(n), [len(x) for x in own]), np.tile(np.arange(n), k)])
    value = np.concatenate([*(odds[x] for x in own), earlier[rows].T.reshape(-1)])

    def ahead_of(x: np.ndarray) -> np.ndarray:
        return np.bincount(at, value * x[column], n).astype(np.float64)  # whole numbers where nothing is kept

    def back_of(x: np.ndarray) -> np.ndarray:
        return np.bincount(column, value * x[at], len(scale)).astype(np.float64)

    top, size = np.ones(len(scale)), 1.0
    for _ in range(20):  # the largest curvature, by power iteration
        top = back_of(ahead_of(top))
        size = float(np.linalg.norm(top)) or 1.0
        top /= size
    rate = 1.0 / (0.25 * size / n * 1.1 + PENALTY / n + 0.25)
    w, here, bias, bias_here, t = np.zeros(len(scale)), np.zeros(len(scale)), 0.0, 0.0, 1.0
    for _ in range(STEPS):
        error = _sigmoid(ahead_of(here) + bias_here) - y
        new = here - rate * (back_of(error) / n + PENALTY / n * here)
        new_bias = bias_here - rate * float(error.mean())
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        here, bias_here = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    w = w * scale
    return Linear(sample.buckets[kept], w[: len(kept)], w[len(kept) :], bias)


def fit_chain(sample: Sample, labels: np.ndarray) -> list[Linear]:
    """``labels``: a column per category, in the order of the chain."""
    n = len(sample.rows)
    fold, chain, earlier = np.arange(n) % FOLDS, [], np.zeros((n, 0))
    for c in range(labels.shape[1]):
        chain.append(fit(sample, np.arange(n), labels[:, c], earlier))
        if c + 1 < labels.shape[1]:
            held_out = np.zeros(n)
            for f in range(FOLDS):
                model = fit(sample, np.flatnonzero(fold != f), labels[:, c], earlier)
                held_out[fold == f] = _sigmoid(sample.scores(model, earlier))[fold == f]
            earlier = np.column_stack([earlier, held_out])
    return chain


def chain_probabilities(chain: list[Linear], texts: list[bytes]) -> np.ndarray:
    chosen = np.zeros(BUCKETS, bool)
    for model in chain:
        chosen[model.buckets] = True
    row, bucket = subword_buckets(texts, chosen)
    out = np.zeros((len(texts), 0))
    for model in chain:
        dense = np.zeros(BUCKETS)
        dense[model.buckets] = model.weights
        score = np.bincount(row, dense[bucket], len(texts)) + out @ model.earlier + model.bias
        out = np.column_stack([out, _sigmoid(score)])
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def _row_buckets(chosen: np.ndarray | None):
    """The distinct buckets (only the ``chosen`` ones where given) of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            row, bucket = subword_buckets(_bytes(batch.column("text")), chosen)
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))], names=["doc_id", "buckets"])

    return run


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many rows of a cell (a fold and combination of categories) each bucket is, for the rows at hand."""
    for batch in text_slices(batches, "text"):
        row, bucket = subword_buckets(_bytes(batch.column("text")))
        cells = batch.column("cell").to_numpy()
        key, n = np.unique(cells[row] * BUCKETS + bucket, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key % BUCKETS), pa.array(key // BUCKETS), pa.array(n)], schema=as_arrow("bucket long, cell long, n long"))


def _telling_buckets(texts: DataFrame, cells: dict[int, tuple[int, list[int]]], sizes: dict[int, int], categories: int) -> np.ndarray:
    """The buckets that any fit may choose: those of each fit's KEPT highest chi-squares.

    ``cells``: fold and categories of each cell; ``sizes``: its rows.  Counts stay on the executors; KEPT buckets for each fit come back.
    """
    counts = texts.select("text", "cell").mapInArrow(_cell_counts, "bucket long, cell long, n long")
    fits = [(c, f) for c in range(categories) for f in (None, *range(FOLDS))]

    def total(test: Callable[[int, list[int]], bool]) -> Column:
        own = [cell for cell, (fold, y) in cells.items() if test(fold, y)]
        return F.coalesce(F.sum(F.when(F.col("cell").isin(own), F.col("n"))), F.lit(0))

    sums = []
    for i, (c, f) in enumerate(fits):
        sums.append(total(lambda fold, y, f=f: fold != f).alias(f"s{i}"))
        sums.append(total(lambda fold, y, c=c, f=f: fold != f and y[c] == 1).alias(f"h{i}"))
    table = written(counts.groupBy("bucket").agg(F.sum("n").alias("rows"), *sums).filter(F.col("rows") >= LEAST_ROWS), "toxicity-buckets")
    chosen = np.zeros(BUCKETS, bool)
    for i, (c, f) in enumerate(fits):
        n = sum(sizes[cell] for cell, (fold, _) in cells.items() if fold != f)
        share = sum(sizes[cell] for cell, (fold, y) in cells.items() if fold != f and y[c] == 1) / max(n, 1)
        if 0 < share < 1:
            expected = F.col(f"s{i}") * share
            chi = (F.col(f"h{i}") - expected) ** 2 / (expected * (1 - share) * (1 - F.col(f"s{i}") / n + 1e-9))
            best = table.filter(F.col(f"s{i}") >= LEAST_ROWS).select("bucket", chi.alias("chi")).filter(F.col("chi") > 0.99 * LEAST_CHI)
            chosen[[r["bucket"] for r in best.orderBy(F.desc("chi"), "bucket").limit(2 * KEPT).collect()]] = True  # beyond KEPT, so that rounding decides nothing
    return chosen


def train(docs: DataFrame, labels: DataFrame, categories: list[str], text: str = "text", doc_id: str = "doc_id") -> list[Linear]:
    """Fit the chain of ``categories``, 0/1 columns of ``labels``, on the bounded sample."""
    spark = ship(docs.sparkSession)
    known = labels.dropna(subset=[doc_id, *categories]).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(*(F.max(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)))
    ys = [f"y{i}" for i in range(len(categories))]
    known = known.join(docs.select(F.col(doc_id).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    picked, _ = smallest_hashes(known, ys, "doc_id", STRATUM_ROWS, "toxicity")
    if not picked:
        return []
    picked = sorted(picked, key=lambda r: r["doc_id"])
    labelled = np.array([[r[y] for y in ys] for r in picked]).reshape(len(picked), len(ys))
    folds = np.arange(len(picked)) % FOLDS
    cell = folds * (1 << len(ys)) + ((labelled > 0) << np.arange(len(ys))).sum(1)
    cells = {int(k): (int(k) >> len(ys), [int(k) >> i & 1 for i in range(len(ys))]) for k in set(cell.tolist())}
    sizes = dict(zip(*(v.tolist() for v in np.unique(cell, return_counts=True)), strict=True))
    sample = spark.createDataFrame([(r["doc_id"], int(k)) for r, k in zip(picked, cell, strict=True)], "doc_id long, cell long")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")  # STRATUM_ROWS for each combination
    texts = written(texts.groupBy("doc_id", "cell").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "toxicity-sample")
    chosen = _telling_buckets(texts, cells, sizes, len(ys))
    found = texts.select("doc_id", "text").mapInArrow(_row_buckets(chosen), "doc_id long, buckets array<int>").orderBy("doc_id").toArrow().combine_chunks()
    return fit_chain(Sample([found["buckets"][i].values.to_numpy() for i in range(found.num_rows)]), labelled)


def _score(chain: list[Linear], n: int):
    fields = "doc_id long, " + ", ".join(f"p{i} double" for i in range(n))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = as_arrow(fields)
        for batch in text_slices(batches, "text"):
            p = chain_probabilities(chain, _bytes(batch.column("text"))) if chain else np.zeros((batch.num_rows, n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, i]) for i in range(n))], schema=schema)

    return score, fields


def toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("low_quality", "toxic"), text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> for each category of the chain, and <last category> as a boolean."""
    chain = train(docs, labels, list(categories), text, doc_id)
    score, fields = _score(chain, len(categories))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = rows.mapInArrow(score, fields)
    last = f"p{len(categories) - 1}"
    return scored.select("doc_id", *(F.col(f"p{i}").alias(f"p_{c}") for i, c in enumerate(categories)), (F.col(last) >= threshold).alias(categories[-1]))


def clean_documents(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("low_quality", "toxic"), text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the last category of the chain doesn't reject, with their columns; no shuffle."""
    chain = train(docs, labels, list(categories), text, doc_id)

    names = docs.columns
    where = names.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            values = pa.RecordBatch.from_arrays(whole.column("row").flatten(), names=[f"c{i}" for i in range(len(names))])
            for batch in text_slices([values], f"c{where}"):
                rejected = chain_probabilities(chain, _bytes(batch.column(where)))[:, -1] >= threshold if chain else np.zeros(batch.num_rows, bool)
                yield batch.filter(pa.array(~rejected)).rename_columns(names)

    return docs.select(F.struct(*map(column, names)).alias("row")).mapInArrow(keep, docs.schema)

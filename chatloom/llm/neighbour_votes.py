"""Quality classifier: nearest neighbours in a latent-semantic space vote by similarity.

A text's terms are n-grams of its shape (its bytes as classes: lower case and letters beyond ASCII, upper case, digits, blanks, line ends and
each punctuation mark, runs of a class cut to two), words, and repeats of one of the three words before; all are counted in ``BUCKETS`` hash
buckets.  A bucket weighs the root of its count times its inverse document frequency, which covers all documents.

The labelled vectors are those of at most ``STRATUM_ROWS`` labelled documents for each label (a parameter), those of the smallest hash of
doc_id; their singular value decomposition gives the space's ``RANK`` directions.  Directions and labelled vectors are broadcast,
``BUCKETS`` * ``RANK`` + labels * ``STRATUM_ROWS`` * ``RANK`` numbers whatever the size of the corpus.  Scoring is one narrow pass: for a block of documents
the exact cosines to every labelled vector are one matrix product; the ``NEIGHBOURS`` nearest (and all that tie with the last of them) vote, each with its
similarity times the number of labelled documents that one of its label stands for, so the score is a share as in the corpus.

Texts are read whole, in pieces of ``PIECE_BYTES`` that end after a blank where there is one; a term doesn't reach over two pieces.

Defined results: null, empty and blank texts, and all others that no labelled vector is similar to, get the share of label 1 among the labelled
documents (0.5 without any); rows whose ``held_out`` is null (those without an identifier) aren't learned from and come back as not held out; null labels
are none; a document with unequal labels has the smaller one; of rows that repeat a labelled identifier the least text is learned from;
equal texts have equal scores, very long texts count whole, an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.batches import as_arrow, column, text_slices
from chatloom.llm.sampling import smallest_hashes
from chatloom.llm.words import mix64, utf8_buffers, word_hashes
from chatloom.session import ship

BUCKETS = 2048
WORD_BUCKETS = 512
REPEATS = 3
SHAPE_SIZES = (2, 4)
STRATUM_ROWS = 1500
RANK = 48
NEIGHBOURS = 25
PIECE_BYTES = 1 << 17
ROWS_AT_ONCE = 512
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    code = np.arange(256)
    classes = np.where(code < 128, code, ord("a"))
    for name, first, last in (("a", "a", "z"), ("A", "A", "Z"), ("0", "0", "9"), ("\n", "\n", "\r")):
        classes[ord(first) : ord(last) + 1] = ord(name)
    classes[ord("\t")] = ord(" ")
    return classes.astype(np.uint64)


_CLASS = _classes()


def pieces(data: np.ndarray, offsets: np.ndarray, most: int | None = None) -> Iterator[np.ndarray]:
    """Arrays of (row, begin, end), of about ``most`` bytes together."""
    most = PIECE_BYTES if most is None else most
    held, size = [], 0
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while begin < end:
            cut = min(begin + most, end)
            if cut < end:
                blanks = np.flatnonzero(data[begin:cut] == 32)
                cut = begin + int(blanks[-1]) + 1 if len(blanks) else cut
            held.append((row, begin, cut))
            size += cut - begin
            begin = cut
            if size >= most:
                yield np.array(held)
                held, size = [], 0
    if held:
        yield np.array(held)


def piece_terms(data: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every term of some pieces, repeats and all."""
    text = np.concatenate([data[a:b] for _, a, b in spans])
    edges = np.concatenate([[0], np.cumsum(spans[:, 2] - spans[:, 1])])
    rows, buckets = [], []
    piece = np.repeat(np.arange(len(spans)), np.diff(edges))
    shape = _CLASS[text]
    run = np.ones(len(text), bool)
    run[2:] = (shape[2:] != shape[1:-1]) | (shape[1:-1] != shape[:-2]) | (piece[2:] != piece[:-2])
    shape, of = shape[run], piece[run]
    shape_buckets = BUCKETS - WORD_BUCKETS - REPEATS
    for n in SHAPE_SIZES:
        m = len(shape) - n + 1
        if m > 0:
            value = np.full(m, n, np.uint64)
            for i in range(n):
                value = value * np.uint64(128) + shape[i : i + m]
            whole = of[:m] == of[n - 1 :]
            rows.append(of[:m][whole])
            buckets.append((mix64(value[whole]) % np.uint64(shape_buckets)).astype(np.int64))
    words, at = word_hashes(text, edges)
    of = np.repeat(np.arange(len(spans)), np.diff(at))
    rows.append(of)
    buckets.append(shape_buckets + (words % np.uint64(WORD_BUCKETS)).astype(np.int64))
    for back in range(1, REPEATS + 1):
        same = np.flatnonzero((words[back:] == words[:-back]) & (of[back:] == of[:-back]))
        rows.append(of[same + back])
        buckets.append(np.full(len(same), BUCKETS - back))
    return spans[np.concatenate(rows), 0], np.concatenate(buckets)


def term_counts(texts: pa.Array) -> np.ndarray:
    """(rows, BUCKETS) counts of the terms of some texts; nulls have none."""
    data, offsets = utf8_buffers(texts)
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    for spans in pieces(data, offsets):
        row, bucket = piece_terms(data, spans)
        low = int(row.min()) if len(row) else 0
        part = np.bincount((row - low) * BUCKETS + bucket)
        counts[low * BUCKETS : low * BUCKETS + len(part)] += part
    return counts.reshape(len(texts), BUCKETS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in text_slices(batches, "text"):
        for at in range(0, part.num_rows, ROWS_AT_ONCE):
            batch = part.slice(at, ROWS_AT_ONCE)
            yield batch, term_counts(batch.column("text"))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, documents = np.zeros(BUCKETS, np.int64), 0
    for batch, counts in _blocks(batches):
        total += (counts > 0).sum(0)
        documents += batch.num_rows
    rows = (pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[documents], total])))
    yield pa.RecordBatch.from_arrays(list(rows), schema=as_arrow("bucket long, n long"))


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log(1 + documents / documents with the bucket), over all rows; 0 where none has it."""
    rows = texts.select("text").mapInArrow(_document_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(BUCKETS + 1)  # one row for each bucket and one for the documents
    for bucket, count in rows:
        n[bucket + 1] = count
    return np.log1p(np.divide(n[0], n[1:], out=np.zeros(BUCKETS), where=n[1:] > 0))


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.sqrt(counts) * idf)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-9)


@dataclass(frozen=True)
class Voters:
    """``idf`` of the buckets, ``directions`` (BUCKETS, rank), unit ``vectors`` (labelled, rank), their ``labels``, the number each ``stands_for``, and the share of label 1."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    stands_for: np.ndarray
    share: float

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 in the neighbours' votes for each row of ``counts``."""
        if not len(self.labels):
            return np.full(len(counts), self.share)
        cosine = np.round(unit(weighted(counts, self.idf) @ self.directions) @ self.vectors.T, 9)
        last = np.partition(cosine, -min(neighbours, len(self.labels)), axis=1)[:, [-min(neighbours, len(self.labels))]]
        vote = np.where(cosine >= last, np.maximum(cosine, 0), 0) * self.stands_for
        total = vote.sum(1)
        return np.round(np.divide(vote @ self.labels, total, out=np.full(len(counts), self.share), where=total > 0), 6)


def fit_voters(counts: np.ndarray, labels: np.ndarray, stands_for: np.ndarray, idf: np.ndarray, rank: int = RANK) -> Voters:
    """The latent space of the labelled rows: the leading right singular vectors of their weighted terms, each row as often as it stands for."""
    total = stands_for.sum()
    share = float(labels @ stands_for / total) if total else 0.5
    x = weighted(counts, idf)
    _, vectors = np.linalg.eigh((x * stands_for[:, None]).T @ x)
    directions = vectors[:, ::-1][:, :rank]
    return Voters(idf, directions, unit(x @ directions), labels.astype(np.float64), stands_for.astype(np.float64), share)


def _sparse_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = as_arrow("label long, stands_for double, buckets array<long>, counts array<long>")
    for batch, counts in _blocks(batches):
        row, bucket = np.nonzero(counts)
        offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = (pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (bucket, counts[row, bucket]))
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("stands_for"), *lists], schema=schema)


def train(rows: DataFrame, labels: DataFrame, stratum_rows: int = STRATUM_ROWS) -> Voters:
    """``rows``: doc_id, text, held_out of all documents; ``labels``: doc_id, label (0 or 1)."""
    learned = rows.filter(~F.col("held_out")).select("doc_id").distinct()
    known = labels.filter("label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("long").alias("label")).join(learned, "doc_id", "left_semi")
    picked, sizes = smallest_hashes(known, ["label"], "doc_id", stratum_rows, "votes")
    idf = inverse_frequencies(rows)
    spark = rows.sparkSession
    strata = {y: n / min(n, stratum_rows) for (y,), n in sizes.items()}
    chosen = spark.createDataFrame([(d, y, strata[y]) for d, y in picked], "doc_id long, label long, stands_for double")
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "stands_for").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = texts.mapInArrow(_sparse_counts, "label long, stands_for double, buckets array<long>, counts array<long>").toArrow().combine_chunks()
    counts = np.zeros((found.num_rows, BUCKETS), np.int32)  # at most stratum_rows rows for each label
    for i in range(found.num_rows):
        counts[i, found["buckets"][i].values.to_numpy()] = found["counts"][i].values.to_numpy()
    return fit_voters(counts, found["label"].to_numpy(), found["stands_for"].to_numpy(), idf)


def quality_votes(docs: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality", stratum_rows: int = STRATUM_ROWS) -> DataFrame:
    """doc_id, held_out, score (share of label 1 among the votes), predicted (1 if score >= THRESHOLD).  Only labels of rows where ``held_out`` is false are learned."""
    spark = ship(docs.sparkSession)
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"), held_out.alias("held_out"))
    voters = train(rows, labels.select(column(doc_id).cast("long").alias("doc_id"), column(label).alias("label")), stratum_rows)
    model = spark.sparkContext.broadcast(voters)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts in _blocks(batches):
            scores = model.value.scores(counts)
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, schema=as_arrow("doc_id long, held_out boolean, score double, predicted int"))

    rows = rows.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")

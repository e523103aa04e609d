"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of all training documents and of their n-grams are summed per task and then per (language, bucket), at most
``BUCKETS`` + 1 numbers for each language; the logarithms of the smoothed shares make a matrix of fixed width that is
broadcast, and documents are scored in batches by gathering its rows and adding the languages' log shares of documents.

Texts are lower-cased, framed by spaces and handled in pieces of ``PIECE_BYTES`` that look two characters ahead, so every
n-gram counts once and a text of any length takes the memory of a piece.

Defined results: null texts and texts without letters are ``und`` with score 0; the languages are those of training
rows with a language; without any, all is ``und``; more than ``MOST_LANGUAGES`` are an error; of equal scores the first language by code point wins; rows whose
``held_out`` is null (those without an identifier) are not learned from and come back as not held out; very long texts
count whole; repeated rows repeat their result; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.batches import as_arrow, column, text_slices
from chatloom.llm.words import mix64, utf8_buffers
from chatloom.session import ship

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
SMOOTHING = 0.5
PIECE_BYTES = 1 << 17
MOST_LANGUAGES = 1000
"""More languages are refused, not cut: the matrix on the driver and in the tasks has a column for each."""
PRIOR = -1
"""The bucket that stands for a language's documents in the counts."""


@dataclass(frozen=True)
class Piece:
    """A part of a row's text, lower-cased, with up to two characters of what follows."""

    row: int
    own: str
    ahead: str
    has_letter: bool


_LETTER = regex.compile(r"\p{L}")


def lowered(text: str) -> str:
    """Lower case that doesn't depend on what is around a character (a final sigma is a sigma)."""
    return text.replace("\u03a3", "\u03c3").lower()


def text_pieces(texts: pa.Array, most: int | None = None) -> Iterator[list[Piece]]:
    """Lists of pieces, of ``most`` bytes together, of the framed texts of a column."""
    most = PIECE_BYTES if most is None else most
    data, offsets = utf8_buffers(texts)
    held, size = [], 0
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = begin
        while at == begin or at < end:
            cut = min(at + most, end)
            while cut < end and data[cut] & 0xC0 == 0x80:  # not inside a character
                cut += 1
            after = cut
            for _ in range(ORDERS[-1] - 1):
                after = min(after + 1, end)
                while after < end and data[after] & 0xC0 == 0x80:
                    after += 1
            text = data[at:cut].tobytes().decode()
            own = (" " if at == begin else "") + lowered(text) + (" " if cut == end else "")
            ahead = "" if cut == end else (lowered(data[cut:after].tobytes().decode()) + " " * (after == end))[: ORDERS[-1] - 1]
            held.append(Piece(row, own, ahead, _LETTER.search(text) is not None))
            size += cut - at + 2
            if size >= most:
                yield held
                held, size = [], 0
            at = cut if cut > at else end + 1
    if held:
        yield held


def ngram_buckets(pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every character n-gram that starts in a piece, and where each piece's begin in that array."""
    sizes = np.array([len(p.own) + len(p.ahead) for p in pieces], np.int64)
    points = np.frombuffer("".join(p.own + p.ahead for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))  # characters from here to the end of the piece
    own = left > np.repeat([len(p.ahead) for p in pieces], sizes)
    buckets = np.zeros((len(points), len(ORDERS)), np.int32)
    usable = np.zeros((len(points), len(ORDERS)), bool)
    for k, order in enumerate(ORDERS):
        value = np.full(len(points), order, np.uint64)
        for i in range(order):
            shifted = np.zeros(len(points), np.uint64)
            shifted[: len(points) - i] = points[i:]
            value = value * np.uint64(1000003) + shifted
        buckets[:, k] = (mix64(value) >> np.uint64(64 - 15)).astype(np.int32)
        usable[:, k] = own & (left >= order)
    per_point = np.concatenate([[0], np.cumsum(usable.sum(1))])
    return buckets.reshape(-1)[usable.reshape(-1)], per_point[np.concatenate([[0], ends[:-1]])]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    documents: Counter[str] = Counter()
    for batch in text_slices(batches, "text"):
        langs = batch.column("lang").to_pylist()
        documents.update(langs)
        for pieces in text_pieces(batch.column("text")):
            buckets, at = ngram_buckets(pieces)
            of = np.array([langs[p.row] for p in pieces], object)
            size = np.diff(np.append(at, len(buckets)))
            for lang in set(of):
                total[lang] = total.get(lang, 0) + np.bincount(buckets[np.repeat(of == lang, size)], minlength=BUCKETS)
    for lang, counts in total.items():
        some = np.flatnonzero(counts)
        rows = (pa.array(np.append(some, PRIOR), pa.int64()), pa.array(np.append(counts[some], documents[lang]), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some) + 1).cast(pa.string()), *rows], schema=as_arrow("lang string, bucket long, n long"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log shares of documents, and the (BUCKETS, languages) matrix of log probabilities.  ``docs``: text, lang, all for training."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if docs.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; put dirty values of lang in order first")
    counts = docs.mapInArrow(_count, "lang string, bucket long, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS + 1 rows for each language
    names = sorted(set(rows["lang"].to_pylist()))
    matrix, prior = np.full((BUCKETS, len(names)), SMOOTHING), np.zeros(len(names))
    if names:
        number = {x: i for i, x in enumerate(names)}
        bucket, lang, n = rows["bucket"].to_numpy(), np.array([number[x] for x in rows["lang"].to_pylist()]), rows["n"].to_numpy()
        prior[lang[bucket == PRIOR]] = n[bucket == PRIOR]
        matrix[bucket[bucket != PRIOR], lang[bucket != PRIOR]] += n[bucket != PRIOR]
        matrix, prior = np.log(matrix / matrix.sum(0)), np.log(prior / prior.sum())
    return names, prior, matrix.astype(np.float32)


def _predict(names: list[str], prior: np.ndarray, model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = as_arrow("doc_id long, held_out boolean, lang_pred string, score double")
        matrix = model.value
        for batch in text_slices(batches, "text"):
            n = batch.num_rows
            letters, sums = np.zeros(n, bool), np.zeros((n, len(names))) + prior
            for pieces in text_pieces(batch.column("text")) if names else ():
                buckets, at = ngram_buckets(pieces)
                row = np.array([p.row for p in pieces])
                np.add.at(sums, row, np.add.reduceat(matrix[buckets], at, axis=0, dtype=np.float64))
                np.logical_or.at(letters, row, [p.has_letter for p in pieces])
            langs, scores = [UNKNOWN] * n, np.zeros(n)
            if names:
                p = np.exp(sums - sums.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                for i in np.flatnonzero(letters).tolist():
                    langs[i], scores[i] = names[best[i]], p[i, best[i]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)], schema=schema)

    return predict


def identify(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score.  Only rows where ``held_out`` is false are learned from."""
    ship(docs.sparkSession)
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"), column(lang).alias("lang"), held_out.alias("held_out"))
    names, prior, matrix = train(rows.filter(~F.col("held_out")).select("text", "lang"))
    model = docs.sparkSession.sparkContext.broadcast(matrix)
    rows = rows.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_predict(names, prior, model), "doc_id long, held_out boolean, lang_pred string, score double")

"""Phrase collocations: candidates from a sketch's upper bounds, counted by delimiter-guarded automata, one shard of text at a time.

Texts have A-Z lower-cased, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks into words.  Everything is per language.

1. Every task counts its word runs of 1 to ``words`` words in a sketch of one row of 2^``SKETCH_BITS`` cells, saturated at ``least``.  Only cells in use are
   sent, in chunks, and summed in two steps; what is left of a cell is whether it reaches ``least``, so the broadcast is 2^``SKETCH_BITS`` bits whatever the corpus.
   A run can only be a candidate if its own cell and those of all shorter runs inside it are set: an upper bound, so no candidate is lost.
2. A task takes its texts in shards of ``SHARD_BYTES``.  The runs of two words and more that pass the bound are compiled into the shard's Aho-Corasick automaton,
   each with a blank before and behind it, so that it matches whole words of one piece only; the shard is scanned once and all matches, overlapping ones too, are
   counted.  Words that pass are counted by their numbers in the shard.
   A run that can be frequent passes in every shard that holds it, so the sums over shards are exact counts, and a worker's memory is that of a shard.
3. Counts are summed with map-side aggregation and those under ``least`` go.  Cuts look their parts up by key, in exact decimal arithmetic.

A language of ``small`` words or more has its first ``top`` phrases sought above a score first, as most of its frequent runs are far below the last of these:

4. Words are counted exactly.  A cell of a table of fixed size keeps the least and the largest count of its words, a cell of the sketch the sum of its runs.
   A phrase's count is at most that of each part.  So from the least counts of its end words follows how frequent it must be to reach the score, and from that how
   frequent a longer phrase must be to drop it (``promising``).  Only runs that may be as frequent as that go into the shard's automaton, which scans
   the text around them.
5. Whether a run is counted depends on its words alone, so its sum is whole or missing.  Parts of cuts that are missing are counted in a further pass.
6. Phrases below the score are left out last, so what is there is the head of the full order.  A language with ``top`` phrases there is done; the others
   go on to the next score of ``thresholds`` and at last, as small ones do at once, to steps 1 to 3 without a score.

The score bounds a count by the frequency of words, and both grow with the corpus, so these bounds keep their force when the sketch is full.  In steps 1 to 3,
where distinct runs outnumber the sketch's cells by far, more rare runs pass the bound; then more counts are shuffled, and results stay the same.

Defined results: a null language is ``und`` and is one with rows that say so; null, empty and blank texts and rows without an identifier count like others
(the first three have no words); repeated rows count each time; a text longer than a shard is cut between words and read whole, runs over a cut included;
ties are broken as the order says, to the phrase's bytes; an empty table gives no rows; other columns, whatever their names, are not read.
Counts up to 10^15 are exact.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import itemgetter
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.llm.batches import as_arrow, column
from chatloom.llm.words import mix64, utf8_buffers, word_hashes
from chatloom.session import ship, written

LEAST = 10
WORDS = 3
SHARE = 50
TOP = 2000
UNKNOWN = "und"
SKETCH_BITS = 26
SHARD_BYTES = 8 << 20
WORD_BITS = 24
RUN_BITS = 25
CHUNK_BITS = 16
SALTS = 64
SMALL = 1 << 22
THRESHOLDS = (100_000, 1_000)
MOST = (1 << 16) - 1
STEPS = 8

_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _DELIMITERS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_DELIMITERS))
_SEPARATOR = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")


def framed(text: bytes) -> bytes:
    """Pieces on lines of their own, every word between single blanks."""
    text = text.translate(_PLAIN)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    text = text.replace(b" \n", b"\n").replace(b"\n ", b"\n")
    while b"\n\n" in text:
        text = text.replace(b"\n\n", b"\n")
    text = text.strip(b" \n")
    return b" \n " + text.replace(b"\n", b" \n ") + b" \n " if text else b" \n "


def _salts(langs: list[str]) -> np.ndarray:
    return mix64(np.array([crc32(lang.encode()) for lang in langs], np.uint64))


class Shard:
    """Some text of one language; what begins in ``ahead`` belongs to the next shard."""

    def __init__(self, lang: str, text: bytes, ahead: bytes = b"") -> None:
        self.lang = lang
        self.data = framed(text + ahead)
        self.ahead = framed(ahead) if ahead else b""
        codes = np.frombuffer(self.data, np.uint8)
        blank = (codes == 32) | (codes == 10)
        self.starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        self.ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        edges = np.searchsorted(self.starts, np.flatnonzero(codes == 10))
        self.piece = np.repeat(np.arange(len(edges) + 1), np.diff(edges, prepend=0, append=len(self.starts)))
        self.own = len(self.starts) - len(self.ahead.split())
        edges = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(edges), pa.py_buffer(codes[~blank])]).dictionary_encode()
        self.words, self.ids = words.dictionary, words.indices.to_numpy().astype(np.int64)
        self.word_hashes = word_hashes(*utf8_buffers(self.words))[0] ^ _salts([lang])
        self.hashes = self.word_hashes[self.ids] if len(self.ids) else np.zeros(0, np.uint64)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first word, and hash, of every run of ``size`` words inside a piece."""
        m = max(len(self.starts) - size + 1, 0)
        value = np.full(m, size, np.uint64)
        for k in range(size):
            value = mix64(value) + self.hashes[k : k + m]
        first = np.flatnonzero(self.piece[:m] == self.piece[size - 1 : size - 1 + m])
        return first, mix64(value[first])

    def keys(self, first: np.ndarray, size: int) -> np.ndarray:
        """Numbers that are equal for equal runs only."""
        key, most = self.ids[first], len(self.words)
        for k in range(1, size):
            if most * len(self.words) >= 1 << 62:
                distinct, key = np.unique(key, return_inverse=True)
                most = len(distinct)
            key, most = key * len(self.words) + self.ids[first + k], most * len(self.words)
        return key

    def distinct(self, first: np.ndarray, size: int) -> list[bytes]:
        """The different ones of these runs, with a blank before and behind."""
        first = first[np.unique(self.keys(first, size), return_index=True)[1]]
        return [self.data[a:b] for a, b in zip((self.starts[first] - 1).tolist(), (self.ends[first + size - 1] + 1).tolist(), strict=True)]

    def around(self, runs: list[np.ndarray]) -> bytes:
        """The text that these runs of two words, of three, and so on cover; runs that share words stay together."""
        linked = np.zeros(len(self.starts) + 2, np.int8)  # a word's, if a run goes on from it to the next word
        for size, first in enumerate(runs, 2):
            for k in range(size - 1):
                linked[first + k + 1] = 1
        change = np.flatnonzero(np.diff(linked))
        return b"\n".join(self.data[a:b] for a, b in zip((self.starts[change[::2]] - 1).tolist(), (self.ends[change[1::2]] + 1).tolist(), strict=True))


def shards(batches: Iterator[pa.RecordBatch], words: int, most: int | None = None) -> Iterator[Shard]:
    """The texts of a task, by language, in shards of about ``most`` bytes."""
    most = SHARD_BYTES if most is None else most
    next_words = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % (words - 1))
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs, texts = batch.column("lang"), batch.column("text").cast(pa.large_binary())
        for lang, scalar in zip(langs.to_pylist(), texts, strict=True):
            text = scalar.as_py() or b""
            begin = 0
            while len(text) - begin > most:
                found = _SEPARATOR.search(text, begin + most)
                cut = found.start() if found else len(text)
                yield Shard(lang, text[begin:cut], next_words.match(text, cut).group())
                begin = cut
            held.setdefault(lang, []).append(text[begin:])
            size += len(text) - begin + 100
            if size >= most:
                yield from (Shard(k, b"\n".join(v)) for k, v in held.items())
                held, size = {}, 0
    yield from (Shard(k, b"\n".join(v)) for k, v in held.items())


def _chunks(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The cells in use, a row for each chunk that has some."""
    used = np.flatnonzero(cells)
    edges = np.searchsorted(used, np.arange(0, len(cells) + 1, 1 << CHUNK_BITS))
    for chunk in np.flatnonzero(np.diff(edges)).tolist():
        own = used[edges[chunk] : edges[chunk + 1]]
        planes = cells[own].view(np.uint8).reshape(len(own), -1).T  # low bytes, then high ones, which are mostly 0
        row = (pa.array([chunk]), pa.array([(own & (1 << CHUNK_BITS) - 1).astype(np.uint16).tobytes()]), pa.array([planes.tobytes()]))
        yield pa.RecordBatch.from_arrays(list(row), schema=as_arrow(_CHUNK))


_CHUNK = "chunk long, cells binary, counts binary"


def _unpacked(row: tuple, kind: np.dtype) -> tuple[int, np.ndarray, np.ndarray]:
    """Chunk, its cells and their counts."""
    chunk, at, planes = row
    planes = np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return chunk, np.frombuffer(at, np.uint16).astype(np.int64), np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _raise(cells: np.ndarray, at: np.ndarray, counts: np.ndarray, least: int) -> None:
    """Add to distinct cells, saturating."""
    cells[at] = np.minimum(cells[at].astype(np.int64) + counts, least)


def _sketch(words: int, least: int, bits: int, fewest: int = 1):
    """Sums of the runs of ``fewest`` to ``words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.min_scalar_type(least))
        for shard in shards(batches, words):
            slots = []
            for size in range(fewest, words + 1):
                first, hashes = shard.runs(size)
                slots.append(_slots(hashes[first < shard.own], bits).astype(np.int32))
            _raise(cells, *np.unique(np.concatenate(slots), return_counts=True), least)
        yield from _chunks(cells)

    return run


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _merged(least: int, last: Callable[[np.ndarray], np.ndarray] | None = None):
    """Sum rows of the same chunk; a task holds its own chunks only.  ``last``: what to leave of a chunk's cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk, at, counts = _unpacked(row, np.min_scalar_type(least))
                _raise(held.setdefault(chunk, np.zeros(1 << CHUNK_BITS, counts.dtype)), at, counts, least)
        for chunk, cells in held.items():
            for row in _chunks(last(cells) if last else cells):
                yield row.set_column(0, "chunk", pa.array([chunk]))

    return run


def _summed_cells(rows: DataFrame, sketch, least: int, bits: int, last: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``last``, of one byte a cell, leaves of the sums over all tasks."""
    partial = rows.mapInArrow(sketch, _CHUNK)
    partial = partial.repartition("chunk", F.spark_partition_id() % SALTS).mapInArrow(_merged(least), _CHUNK)
    out = np.zeros(1 << bits, np.uint8)
    for row in partial.repartition("chunk").mapInArrow(_merged(least, last), _CHUNK).toLocalIterator():
        chunk, at, left = _unpacked(row, np.uint8)
        out[(chunk << CHUNK_BITS) + at] = left
    return out


def frequent_cells(rows: DataFrame, words: int, least: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """A bit for every cell of the sketch that reaches ``least``."""
    return np.packbits(_summed_cells(rows, _sketch(words, least, bits), least, bits, lambda cells: (cells >= least).astype(np.uint8)).view(bool))


def _levels(counts: np.ndarray, least: int) -> np.ndarray:
    """Counts on a scale of ``STEPS`` to the power of two from ``least``; 0 is less than that, 255 has no upper bound."""
    level = np.floor(np.log2(np.maximum(counts, least) / least) * STEPS) + 1
    return np.where(counts < least, 0, np.minimum(level, 255)).astype(np.uint8)


def _scale(least: int) -> tuple[np.ndarray, np.ndarray]:
    """No count of a level is under its lower bound or over its upper one, whatever is rounded on the way."""
    level = np.arange(256)
    lower, upper = least * 2.0 ** ((level - 1) / STEPS) * (1 - 1e-5), least * 2.0 ** (level / STEPS) * (1 + 1e-5)
    upper[0], upper[255] = 0, np.inf
    return lower.astype(np.float32), upper.astype(np.float32)


def _word_cells(least: int, bits: int):
    """For each cell in use the pair 255 - least level and largest level of its words, so that pairs merge by their maxima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((1 << bits, 2), np.uint8)
        for batch in batches:
            langs = pa.array(batch.column("lang")).dictionary_encode()
            salts = _salts(langs.dictionary.to_pylist())[langs.indices.to_numpy()]
            at = _slots(word_hashes(*utf8_buffers(batch.column("phrase")))[0] ^ salts, bits)
            level = _levels(batch.column("f").to_numpy(), least)
            np.maximum.at(pairs[:, 0], at, 255 - level)
            np.maximum.at(pairs[:, 1], at, level)
        yield from _chunks(pairs.view(np.uint16).reshape(-1))

    return run


def _merged_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            chunk, at, pairs = _unpacked(row, np.uint16)
            own = held.setdefault(chunk, np.zeros((1 << CHUNK_BITS, 2), np.uint8))
            own[at] = np.maximum(own[at], pairs.view(np.uint8).reshape(-1, 2))
    for chunk, own in held.items():
        for row in _chunks(own.view(np.uint16).reshape(-1)):
            yield row.set_column(0, "chunk", pa.array([chunk]))


def word_levels(counts: DataFrame, least: int, bits: int = WORD_BITS) -> np.ndarray:
    """255 - least level and largest level of the words of every cell.  ``counts``: a written table of words that reach ``least``."""
    out = np.zeros(1 << bits, np.uint16)
    for row in counts.mapInArrow(_word_cells(least, bits), _CHUNK).repartition("chunk").mapInArrow(_merged_pairs, _CHUNK).toLocalIterator():
        chunk, at, pairs = _unpacked(row, np.uint16)
        out[(chunk << CHUNK_BITS) + at] = pairs
    return out.view(np.uint8).reshape(-1, 2)


def promising(shard: Shard, words: int, least: int, share: int, threshold: int, of_words: np.ndarray, of_runs: np.ndarray) -> list[np.ndarray]:
    """The first words of the runs of 2 to ``words`` words that may reach the score ``threshold``, or drop a run inside them that may.

    A run's count is at most that of a part, and a part's at least the run's, so with a score of t / 1000000 or more a * a >= t * l * r gives
    a >= sqrt(t * f(x) * f(y)) for two words x and y, and a >= t * f(x) for the first and the last of more words.  That depends on the run alone.
    """
    lower, upper = _scale(least)
    of_words = of_words[_slots(shard.word_hashes, len(of_words).bit_length() - 1)]
    low, high = lower[255 - of_words[:, 0]][shard.ids], upper[of_words[:, 1]][shard.ids]
    rate, most = np.float32(threshold / 1_000_000), np.append(high, np.float32(0))
    dropped: list[np.ndarray] = []  # by size and first word: how frequent a longer run must be to drop it
    out = []
    for size in range(2, words + 1):
        first, hashes = shard.runs(size)
        a = np.minimum(most[first], most[first + 1])
        a = np.minimum(a, upper[of_runs[_slots(hashes, len(of_runs).bit_length() - 1)]])
        x, y = low[first], low[first + size - 1]
        needed = np.maximum(np.sqrt(rate * x * y) if size == 2 else rate * np.maximum(x, y), np.float32(least))
        best = a >= needed
        inside = np.full(len(first), np.inf, np.float32)
        for n, floor in enumerate(dropped, 2):
            for k in range(size - n + 1):
                inside = np.minimum(inside, floor[first + k])
        out.append(first[best | (a >= np.maximum(inside, np.float32(least)))])
        floor = np.full(len(shard.starts) + 1, np.inf, np.float32)
        floor[first[best]] = needed[best] * np.float32(share / 100)
        dropped.append(floor)
        most = np.zeros(len(shard.starts) + 1, np.float32)
        most[first] = a
    return out


def _set_cells(hashes: np.ndarray, reached: np.ndarray, bits: int) -> np.ndarray:
    slot = _slots(hashes, bits)
    return (reached[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def passing(shard: Shard, words: int, reached: np.ndarray, bits: int) -> tuple[np.ndarray, list[bytes]]:
    """What in a shard has an upper bound that reaches the threshold: which words (by id), and the longer runs, with a blank before and behind."""
    found: list[bytes] = []
    shorter = np.zeros(len(shard.starts) + 1, bool)
    first, hashes = shard.runs(1)
    shorter[first] = _set_cells(hashes, reached, bits)
    likely = np.zeros(len(shard.words), bool)
    likely[shard.ids[shorter[:-1]]] = True
    for size in range(2, words + 1):
        first, hashes = shard.runs(size)
        first = first[_set_cells(hashes, reached, bits) & shorter[first] & shorter[first + 1]]
        shorter = np.zeros(len(shard.starts) + 1, bool)
        shorter[first] = True
        found += shard.distinct(first, size)
    return likely, found


def count_matches(shard: Shard, patterns: list[bytes], runs: list[np.ndarray] | None = None) -> np.ndarray:
    """How often each pattern lies in what is the shard's own, overlapping matches included.  ``runs``: all places of the patterns, by size from 2; then no other text is scanned."""
    if not patterns:
        return np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton()
    for i, pattern in enumerate(patterns):
        automaton.add_word(pattern.decode("latin-1"), i)  # a character for each byte
    automaton.make_automaton()

    def scan(data: bytes) -> np.ndarray:
        matches = np.fromiter(map(itemgetter(1), automaton.iter(data.decode("latin-1"))), np.int64)
        return np.bincount(matches, minlength=len(patterns))

    data, ahead = shard.data, shard.ahead
    if runs is not None:
        data, ahead = shard.around(runs), shard.around([first[first >= shard.own] for first in runs])
    return scan(data) - scan(ahead) if ahead else scan(data)


def _counted(words: int, reached, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, words):
            likely, patterns = passing(shard, words, reached.value, bits)
            of_words = np.bincount(shard.ids[: shard.own], minlength=len(shard.words))
            phrases = pa.array([b"", *shard.words.filter(pa.array(likely)).to_pylist(), *(p[1:-1] for p in patterns)], pa.binary())
            counts = np.concatenate([[shard.own], of_words[likely], count_matches(shard, patterns)])
            arrays = [pa.repeat(shard.lang, len(phrases)).cast(pa.string()), phrases, pa.array(counts)]
            yield pa.RecordBatch.from_arrays(arrays, schema=as_arrow(_COUNT))

    return run


def _counted_promising(words: int, least: int, share: int, threshold: int, of_words, of_runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, words):
            runs = promising(shard, words, least, share, threshold, of_words.value, of_runs.value)
            patterns = [p for size, first in enumerate(runs, 2) for p in shard.distinct(first, size)]
            phrases = pa.array([p[1:-1] for p in patterns], pa.binary())
            arrays = [pa.repeat(shard.lang, len(phrases)).cast(pa.string()), phrases, pa.array(count_matches(shard, patterns, runs))]
            yield pa.RecordBatch.from_arrays(arrays, schema=as_arrow(_COUNT))

    return run


_COUNT = "lang string, phrase binary, f long"


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(column(lang), F.lit(UNKNOWN)).alias("lang"), column(text).alias("text"))


def _summed(rows: DataFrame, counted, least: int) -> DataFrame:
    counts = rows.mapInArrow(counted, _COUNT)
    counts = counts.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
    return counts.filter((F.col("f") >= least) | (F.col("phrase") == ""))


def phrase_counts(docs: DataFrame, words: int = WORDS, least: int = LEAST, bits: int = SKETCH_BITS, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, f of every run of 1 to ``words`` words with f >= ``least``; the empty phrase has a language's number of words."""
    spark = ship(docs.sparkSession)
    rows = _rows(docs, text, lang)
    reached = spark.sparkContext.broadcast(frequent_cells(rows, words, least, bits))
    return _summed(rows, _counted(words, reached, bits), least)


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all words of each shard, and of its words together under the empty phrase."""
    for shard in shards(batches, 1):
        phrases = pa.concat_arrays([pa.array([b""], pa.binary()), shard.words.cast(pa.binary())])
        counts = np.concatenate([[shard.own], np.bincount(shard.ids[: shard.own], minlength=len(shard.words))])
        arrays = [pa.repeat(shard.lang, len(phrases)).cast(pa.string()), phrases, pa.array(counts)]
        yield pa.RecordBatch.from_arrays(arrays, schema=as_arrow(_COUNT))


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f of every word with f >= ``least``; the empty phrase has a language's number of words."""
    return _summed(rows, _counted_words, least)


def _cut_score(a: Column, head: Column, rest: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals."""
    wide = "decimal(19,0)"
    return F.call_function("div", a.cast(wide) * a.cast(wide) * F.lit(1000000), head.cast(wide) * rest.cast(wide)).cast("long")


def scored_candidates(counts: DataFrame) -> DataFrame:
    """lang, phrase, size, a, and k, l, r, score of the lowest-scoring cut, if all cuts have their counts.  ``counts``: a written table."""
    size = F.size(F.split("phrase", " "))
    candidates = counts.withColumn("size", size).filter((F.col("phrase") != "") & (F.col("size") > 1)).withColumnRenamed("f", "a")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    parts = F.split("phrase", " ")
    cut = cut.withColumn("head", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(parts, F.col("k") + 1, F.col("size")), " "))
    heads = counts.select(F.col("lang"), F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = counts.select(F.col("lang"), F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    score = _cut_score(F.col("a"), F.col("l"), F.col("r"))
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    cut = cut.groupBy("lang", "phrase", "size", "a").agg(least, F.count(F.lit(1)).alias("cuts")).filter("cuts = size - 1")
    return cut.select("lang", "phrase", "size", "a", "cut.*")


def without_contained(scored: DataFrame, counts: DataFrame, share: int = SHARE) -> DataFrame:
    """The candidates that lie in no longer candidate of ``share`` percent of their count."""
    size = F.size(F.split("phrase", " "))
    longer = counts.withColumn("size", size).filter((F.col("phrase") != "") & (F.col("size") > 2))
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, n), " "))))
    inside = longer.select("lang", F.explode(F.array_distinct(runs)).alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def missing_parts(counts: DataFrame, words: DataFrame, threshold: int) -> DataFrame:
    """lang, phrase of the parts of two words and more that cuts of what may reach ``threshold`` need and ``counts`` hasn't."""
    parts = F.split("phrase", " ")
    size = F.size(parts)
    longer = counts.withColumn("size", size).filter("size > 2").withColumn("first", F.element_at(parts, 1)).withColumn("last", F.element_at(parts, -1))
    for end in ("first", "last"):
        longer = longer.join(words.select("lang", F.col("phrase").alias(end), F.col("f").alias(f"f_{end}")), ["lang", end])
    longer = longer.filter(F.col("f") * F.lit(1_000_000 * (1 + 1e-9)) >= F.greatest("f_first", "f_last") * F.lit(float(threshold)))
    lengths = F.sequence(F.lit(2), F.col("size") - 1)
    heads = F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), " "))
    rests = F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.col("size") - n + 1, n), " "))
    return longer.select("lang", F.explode(F.concat(heads, rests)).alias("phrase")).distinct().join(counts, ["lang", "phrase"], "left_anti")


def run_levels(rows: DataFrame, words: int, least: int, bits: int) -> np.ndarray:
    """The level of every cell of a sketch of the runs of 2 to ``words`` words."""

    def last(cells: np.ndarray) -> np.ndarray:
        return np.where(cells == MOST, 255, _levels(cells, least)).astype(np.uint8)

    return _summed_cells(rows, _sketch(words, MOST, bits, 2), MOST, bits, last)


def phrases_above(rows: DataFrame, counted: DataFrame, of_words, of_runs, threshold: int, words: int, least: int, share: int, bits: int) -> DataFrame:
    """The phrases that reach the score ``threshold``.  ``counted``: word counts, written; ``of_words``, ``of_runs``: levels, broadcast."""
    counts = written(_summed(rows, _counted_promising(words, least, share, threshold, of_words, of_runs), least), "run-counts")
    missing = written(missing_parts(counts, counted, threshold), "missing-parts")
    if not missing.isEmpty():
        cells = frequent_cells(missing.select("lang", F.col("phrase").alias("text")), words - 1, 1, bits)
        wanted = rows.sparkSession.sparkContext.broadcast(cells)
        parts = _summed(rows, _counted(words - 1, wanted, bits), least).join(missing, ["lang", "phrase"], "left_semi")
        counts = counts.unionByName(written(parts, "part-counts"))
    scored = scored_candidates(counts.unionByName(counted)).filter(F.col("score") >= threshold)
    return without_contained(scored, counts, share)


def ranked(kept: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))  # so that the last step sees no more than SALTS * top rows of a language
    for by in (["lang", part], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "score")


def collocations(
    docs: DataFrame, words: int = WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP, bits: int = SKETCH_BITS, text: str = "text", lang: str = "lang", small: int = SMALL, thresholds: tuple[int, ...] = THRESHOLDS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score, a, and the phrase's bytes."""
    spark = ship(docs.sparkSession)
    rows = _rows(docs, text, lang)
    counted = written(word_counts(rows, least), "word-counts")
    total = counted.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    counted = counted.filter("phrase != ''")
    left = total.filter(F.col("n") >= small).select("lang")
    found: list[DataFrame] = []
    if thresholds and not left.isEmpty():
        large = rows.join(F.broadcast(left), "lang")
        of_words = spark.sparkContext.broadcast(word_levels(counted, least, min(bits, WORD_BITS)))
        run_bits = min(bits, RUN_BITS)
        of_runs = spark.sparkContext.broadcast(run_levels(large, words, least, run_bits))
        for threshold in thresholds:
            above = phrases_above(rows.join(F.broadcast(left), "lang"), counted, of_words, of_runs, threshold, words, least, share, run_bits)
            above = written(ranked(above, top), "phrases-above")
            done = above.filter(F.col("rank") == top).select("lang")
            found.append(above.join(F.broadcast(done), "lang", "left_semi"))
            left = left.join(done, "lang", "left_anti")
            if left.isEmpty():
                break
        of_words.destroy()
        of_runs.destroy()
    left = left.unionByName(total.filter(F.col("n") < small).select("lang"))
    if not found or not left.isEmpty():
        counts = written(phrase_counts(rows.join(F.broadcast(left), "lang"), words, least, bits), "phrase-counts")
        found.append(ranked(without_contained(scored_candidates(counts), counts, share), top))
    return reduce(DataFrame.unionByName, found).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Mixing sources to target weights.

Words are packed into blocks of a fixed length, per source, in a pseudorandom order of documents.  The mix is a row of
output shards of ``SHARD_SLOTS`` slots; how many slots of a shard each source gets is a multinomial draw by the target
weights, keyed by the shard.  A source's slots are numbered through its shards by prefix sums; slot ``t`` takes block
``permutation(t mod blocks)`` under a keyed index permutation of pass ``t div blocks``, so a block is met at most once
in each pass, and slots and blocks are joined by index.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at
``ceiling`` times its source's size and the excess is shared again by weight.  What a source gets is what was drawn for it,
if that is within ``TOLERANCE`` of its target's slots and no more than ``ceiling`` passes.  Beyond this its last slots are
given back and sources with too few take them, each at the next number of its own; so a source's words are within
``TOLERANCE`` and two blocks of its target, and only sources of few blocks, under about a hundred thousand, are corrected at all.

No step holds a source in one task: offsets are prefix sums in three levels, over groups of bins, the ``BINS`` bins of a
source and the documents of a bin; shards are summed up by chunks of ``CHUNK``.  The method draws for all sources at once in each shard, so one number per source is in
every task and on the driver; over ``MOST_SOURCES`` sources are refused.  Every draw is keyed by the seed and indices
alone, so reruns and retried tasks agree.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of its own; rows
that repeat are documents of their own; documents of equal identifier and text are placed in any order, as they can't be
told apart; an empty table gives no rows; a very long text is a run of blocks like any other; other columns pass through
``mixed_documents`` whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.llm.batches import as_arrow, column, text_slices
from chatloom.llm.words import mix64, utf8_buffers, word_counts, word_starts
from chatloom.session import written

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
CHUNK = 1024
BINS = 1 << 16
TOLERANCE = 0.005
MOST_SOURCES = 100_000
SEED = 20240131
DRAW_SEED = 7


@dataclass(frozen=True)
class Mix:
    """``placed``: a row per document with its place; ``slots``: shard, slot, source and block of the mix; ``own``: the pieces
    of documents in each block; ``pieces``: those of the blocks taken, with how often."""

    placed: DataFrame
    slots: DataFrame
    own: DataFrame
    pieces: DataFrame


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = as_arrow("doc_id long, source string, tie long, size long")
    for batch in text_slices(batches, "text"):
        counts = word_counts(*utf8_buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("tie"), pa.array(counts, pa.int64())], schema=schema)


def water_targets(sizes: np.ndarray, weights: np.ndarray, ceiling: float) -> np.ndarray:
    """Shares of all words by weight, of which none is above ``ceiling`` times its source's size."""
    full = np.zeros(len(sizes), bool)
    while not full.all():
        level = (sizes.sum() - ceiling * sizes[full].sum()) / weights[~full].sum()
        over = ~full & (level * weights > ceiling * sizes)
        if not over.any():
            return np.where(full, ceiling * sizes, level * weights)
        full |= over
    return ceiling * sizes.astype(np.float64)


def _draw(seed: int, slots: np.ndarray, shard_slots: int):
    """Slots of each source in every shard of a chunk, and how many it had in the chunk's shards before."""
    share, every = slots / max(1, slots.sum()), int(slots.sum())
    shards = -(-every // shard_slots)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = as_arrow("chunk long, shard long, source_no long, first long, count long")
        for chunk in (c for batch in batches for c in batch.column("id").to_pylist()):
            before, parts, rows = np.zeros(len(share), np.int64), [], 0
            for shard in range(chunk * CHUNK, min((chunk + 1) * CHUNK, shards)):
                counts = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(min(shard_slots, every - shard * shard_slots), share)
                some = np.flatnonzero(counts)
                parts.append((np.full(len(some), chunk), np.full(len(some), shard), some, before[some], counts[some]))
                before += counts
                rows += len(some)
                if rows >= 1 << 16 or shard + 1 == min((chunk + 1) * CHUNK, shards):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], schema=schema)
                    parts, rows = [], 0

    return draw, -(-shards // CHUNK)


def settled(drawn: np.ndarray, wanted: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Slots that each source keeps or is given: the draw, moved as little as its bounds ask for, with the same sum."""
    slack = np.floor(TOLERANCE * wanted).astype(np.int64)
    low, high = wanted - slack, np.minimum(wanted + slack, most)
    out = np.clip(drawn, low, high)
    left = int(drawn.sum() - out.sum())
    room = high - out if left > 0 else out - low
    return out + np.sign(left) * np.clip(abs(left) - (np.cumsum(room) - room), 0, room)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed bijection of [0, size) for every element: a Feistel network on an even number of bits, walked until it falls inside."""
    size = size.astype(np.int64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mix64(right + k * np.uint64(4) + np.uint64(turn)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _to_blocks(seed: int, facts):
    """Slots beyond what a source keeps go to the sources that are given some, by number; then each slot finds its block."""

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = as_arrow("shard long, source_no long, slot long, block long")
        blocks, drawn, kept = facts.value
        back, given = np.maximum(drawn - kept, 0), np.maximum(kept - drawn, 0)
        back_start, given_end = np.cumsum(back) - back, np.cumsum(given)
        for batch in batches:
            source, slot = batch.column("source_no").to_numpy().copy(), batch.column("slot").to_numpy().copy()
            moved = np.flatnonzero(slot >= kept[source])
            number = back_start[source[moved]] + slot[moved] - kept[source[moved]]
            taker = np.searchsorted(given_end, number, side="right")
            source[moved], slot[moved] = taker, drawn[taker] + number - (given_end - given)[taker]
            size = blocks[source]
            key = mix64(mix64(source.astype(np.uint64) + np.uint64(seed)) + (slot // size).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(source), pa.array(slot), pa.array(permuted(slot % size, size, key))], schema=schema)

    return to_blocks


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    ceiling: int = 3,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
    draw_seed: int = DRAW_SEED,
) -> Mix:
    """``seed`` keys the order of documents and the permutations, ``draw_seed`` the multinomial draws."""
    spark = docs.sparkSession
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(source).cast("string").alias("source"), F.xxhash64(column(text)).alias("tie"), column(text).alias("text"))
    sizes = rows.mapInArrow(_sizes, "doc_id long, source string, tie long, size long")
    sizes = written(sizes.withColumn("bin", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.lit(BINS))), "mix-sizes")

    bins = written(sizes.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    found = bins.groupBy("source").agg(F.sum("bin_size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    size = np.array([r.n for r in found], np.int64)
    target = water_targets(size, np.array([weights[i % len(weights)] for i in range(len(found))], np.int64), ceiling)
    blocks = -(-size // block_words)
    wanted = np.minimum(np.round(target * blocks / np.maximum(size, 1)).astype(np.int64), blocks * ceiling)
    facts = spark.createDataFrame([(r.source, i, r.n, float(target[i])) for i, r in enumerate(found)], "s string, source_no long, source_size long, target double")

    bins = bins.withColumn("high", F.shiftright("bin", BINS.bit_length() // 2))
    highs = bins.groupBy("source", "high").agg(F.sum("bin_size").alias("n")).join(facts, F.col("source").eqNullSafe(F.col("s")))
    before = W.partitionBy("source_no").orderBy("high").rowsBetween(W.unboundedPreceding, -1)
    highs = highs.select("source_no", "source_size", "target", "s", F.col("high").alias("h"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("high_start"))
    before = W.partitionBy("source", "high").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    bins = bins.join(highs, F.col("source").eqNullSafe(F.col("s")) & (F.col("high") == F.col("h"))).withColumn("bin_start", F.col("high_start") + F.col("before"))
    bins = bins.select("source_no", "source_size", "target", "s", F.col("bin").alias("b"), "bin_start")
    placed = sizes.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    before = F.sum("size").over(W.partitionBy("source", "bin").orderBy("doc_id", "tie").rowsBetween(W.unboundedPreceding, -1))
    placed = placed.withColumn("start", F.col("bin_start") + F.coalesce(before, F.lit(0)))
    placed = written(placed.select("doc_id", "tie", "source_no", "size", "source_size", "target", "start"), "mix-placed")

    draw, chunks = _draw(draw_seed, wanted, shard_slots)
    dealt = written(spark.range(chunks).mapInArrow(draw, "chunk long, shard long, source_no long, first long, count long"), "mix-dealt")
    per_chunk = dealt.groupBy("source_no", "chunk").agg(F.sum("count").alias("n"))
    chunk_start = F.coalesce(F.sum("n").over(W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.join(per_chunk.select("source_no", "chunk", chunk_start.alias("chunk_start")), ["source_no", "chunk"])
    drawn = np.zeros(len(found), np.int64)
    for r in per_chunk.groupBy("source_no").agg(F.sum("n").alias("n")).collect():  # a row for each source
        drawn[r.source_no] = r.n
    per_source = spark.sparkContext.broadcast((blocks, drawn, settled(drawn, wanted, blocks * ceiling)))
    first = F.col("chunk_start") + F.col("first")
    slots = dealt.select("shard", "source_no", F.explode(F.sequence(first, first + F.col("count") - 1)).alias("slot"))
    slots = slots.mapInArrow(_to_blocks(seed, per_source), "shard long, source_no long, slot long, block long")
    times = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    times = written(times, "mix-times")  # a row for each block drawn: the join is to be planned by its true size

    own = placed.filter("size > 0").select("doc_id", "tie", "source_no", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("block"))
    first_word = F.greatest(F.col("block") * block_words, F.col("start")) - F.col("start")
    end_word = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size")) - F.col("start")
    own = own.select("doc_id", "tie", "source_no", "start", "block", first_word.alias("first_word"), end_word.alias("end_word"))
    return Mix(placed, slots, own, own.join(times, ["source_no", "block"]).drop("block"))


def shard_layout(mix: Mix) -> DataFrame:
    """shard, source_no, slot, doc_id, tie, first_word, end_word: what each slot of the mix holds, slots and blocks joined by index."""
    return mix.slots.join(mix.own, ["source_no", "block"]).select("shard", "source_no", "slot", "doc_id", "tie", "first_word", "end_word")


def taken_words(mix: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    taken = mix.pieces.groupBy("source_no", "start").agg(F.sum((F.col("end_word") - F.col("first_word")) * F.col("times")).alias("t"))
    some, none = mix.placed.filter("size > 0"), mix.placed.filter("size = 0")
    out = some.join(taken, ["source_no", "start"], "left").unionByName(none.withColumn("t", F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("t", F.lit(0)).cast("long").alias("taken"))


def _cut(names: list[str], text: str, ceiling: int):
    where = names.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            values = pa.RecordBatch.from_arrays([*whole.column("row").flatten(), whole.column("spans")], names=[f"c{i}" for i in range(len(names) + 1)])
            for batch in text_slices([values], f"c{where}"):
                data, offsets = utf8_buffers(batch.column(where))
                starts, bounds = word_starts(data, offsets)
                rows, texts = [], []
                for i, spans in enumerate(batch.column(len(names)).to_pylist()):
                    at = np.append(starts[bounds[i] : bounds[i + 1]], offsets[i + 1])
                    for turn in range(1, ceiling + 1):
                        parts: list[list[int]] = []
                        for a, b in sorted((s["first_word"], s["end_word"]) for s in spans or () if s["times"] >= turn):
                            if parts and parts[-1][1] == a:
                                parts[-1][1] = b
                            else:
                                parts.append([a, b])
                        if parts:
                            rows.append(i)
                            texts.append(b"".join(data[at[a] : at[b]].tobytes() for a, b in parts).decode("utf-8").strip(" \t\n\v\f\r"))
                if rows:
                    kept = [c.take(pa.array(rows)) for c in batch.columns[: len(names)]]
                    kept[where] = pa.array(texts, pa.string())
                    yield pa.RecordBatch.from_arrays(kept, names=names)

    return cut


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", ceiling: int = 3, **options: object) -> DataFrame:
    """The mix as rows of ``docs``: for each pass over a document, the words of it that the pass takes, in order.

    A document that is taken whole appears unchanged, one that is taken twice appears twice, and one whose blocks
    were not drawn does not appear.  Columns are those of ``docs``.
    """
    mix = mix_sources(docs, text, doc_id, source, ceiling=ceiling, **options)
    spans = mix.pieces.groupBy("doc_id", "tie", "source_no", "start").agg(F.collect_list(F.struct("first_word", "end_word", "times")).alias("spans"))
    spans = spans.groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("t")).agg(F.sort_array(F.collect_list(F.struct("start", "spans"))).alias("places"))
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("row"), column(doc_id).cast("long").alias("id"), F.xxhash64(column(text)).alias("tie"))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("id", "tie").orderBy("tie")))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))
    one = F.try_element_at("places", F.col("nth")).getField("spans")
    return joined.select("row", one.alias("spans")).mapInArrow(_cut(docs.columns, text, ceiling), docs.schema)

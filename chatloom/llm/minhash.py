"""Near-duplicate detection by b-bit MinHash.

A document's set is its distinct word shingles.  Documents with equal sets form a class and only its smallest
identifier goes on.  Of ``BANDS * ROWS`` minima, band keys generate candidates and the low ``BITS`` bits of each
minimum are packed into a signature; the share of equal b-bit values, corrected for chance collisions, estimates
the similarity, and what is left is confirmed on the full sets.

Candidates of a bucket are never expanded into all pairs:

1. every member is compared with its bucket's leader, the member that meets most others over all bands;
2. the confirmed links give components, and a bucket whose members are all in one is done;
3. the members of the other buckets are told apart by their rarest shingles: two sets that are similar enough
   share one of the ``n - ceil(percent * n / 100) + 1`` rarest of each, so boilerplate that brings many documents into a bucket
   brings none of them together here.  Members of one such shingle are a group, groups of the same members are one, and
   a group of more than ``BLOCK`` is dealt by the open bands of its members as well;
4. in a group, members outside the largest component are compared with the members of other components in blocks of
   about ``BLOCK`` rows, by signature first, if they share a band.  A pair is looked at in one group only, that of the least shingle by
   which both are in groups, and of a group that was dealt by bands in the first band that both share; and in full only while its ends aren't connected, so a block gives at most
   a spanning forest.  A set of many shingles counts as several rows, which bounds what a block holds.

So every candidate pair between different components is decided, and no bucket is capped.

Miss rate: a pair at the threshold shares no band with probability (1 - s**ROWS)**BANDS (7e-7 at 0.85, 5e-5 at
0.8), and its estimate falls short of ``MARGIN`` standard deviations with about 3e-6.

Defined results: null or blank texts have an empty set and are linked with nothing; a text with fewer words than
a shingle is one shingle; texts of rows that share an identifier are linked; very long texts are worked on whole, in pieces; of equals the
least identifier stands for a class; rows with a null identifier are compared like
others and pass links on, take the least identifier that they reach (null if there is none) and are not kept unless that is
null too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.llm.batches import as_arrow, column, sorted_groups, text_slices
from chatloom.llm.components import components
from chatloom.llm.words import mix64, shingle_hashes, utf8_buffers, word_hashes
from chatloom.session import ship, written

BANDS, ROWS, BITS = 25, 5, 4
MINIMA = BANDS * ROWS
MARGIN = 4.5
BLOCK = 1024
MOST_BLOCKS = 8
"""Members of a group of more blocks are dealt by bands first, so a member meets no more than so many blocks of a group that isn't."""
ROW_SHINGLES = 4096
"""Shingles that count as one row of a block."""
SEED = 7
_SIGNED = "doc_id long, t long, n long, d1 long, d2 long, bands array<long>, sig array<long>"
_NIBBLE = 0x1111111111111111


def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.Philox(SEED))
    return draw.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1), draw.integers(0, 2**32, MINIMA, dtype=np.uint32)


def shingle_sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    words, offsets = word_hashes(*utf8_buffers(batch.column("text")))
    shingles, at = shingle_hashes(words, offsets, size)
    return [np.unique(shingles[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of MINIMA values for each non-empty set."""
    times, plus = _factors()
    out = np.empty((len(sets), MINIMA), np.uint32)
    for a in range(0, len(sets), 64):  # a block of sets that stays in the cache
        part = sets[a : a + 64]
        starts = np.concatenate([[0], np.cumsum([len(s) for s in part])[:-1]])
        x = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
        for k in range(MINIMA):
            out[a : a + 64, k] = np.minimum.reduceat(x * times[k] + plus[k], starts)
    return out


def _sign(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = as_arrow(_SIGNED)
        for batch in text_slices(batches, "text"):
            sets = shingle_sets(batch, size)
            n = np.array([len(s) for s in sets], np.int64)
            some = [s for s in sets if len(s)]
            d1, d2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            offsets = np.concatenate([[0], np.cumsum(n > 0)]).astype(np.int32)
            bands, packed = np.zeros((len(some), BANDS), np.uint64), np.zeros((len(some), (MINIMA + 15) // 16), np.uint64)
            if some:
                every, starts = np.concatenate(some), np.concatenate([[0], np.cumsum(n[n > 0])[:-1]])
                d1[n > 0], d2[n > 0] = _digests(every, starts)
                least = _minima(some)
                for b in range(BANDS):
                    key = np.full(len(some), b, np.uint64)
                    for r in range(ROWS):
                        key = mix64(key * np.uint64(31) + least[:, b * ROWS + r])
                    bands[:, b] = key
                low = mix64(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
                for k in range(MINIMA):
                    packed[:, k // 16] |= low[:, k] << np.uint64(4 * (k % 16))

            def lists(values: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(offsets * values.shape[1], pa.int32()), pa.array(values.view(np.int64).reshape(-1)))

            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists(bands), lists(packed)], schema=schema)

    return sign


def _digests(every: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set of a concatenation."""
    return np.add.reduceat(mix64(every), starts), np.bitwise_xor.reduceat(mix64(every + np.uint64(0x5851F42D4C957F2D)), starts)


def _sets(size: int):
    """The sets of the texts whose digests are those of the class that ``doc_id`` stands for."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = as_arrow("doc_id long, shingles array<long>")
        for batch in text_slices(batches, "text"):
            found = shingle_sets(batch, size)
            asked = zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True)
            meant = [len(s) > 0 and tuple(int(d.view(np.int64)[0]) for d in _digests(s, np.zeros(1, np.int64))) == want for s, want in zip(found, asked, strict=True)]
            batch, found = batch.filter(pa.array(meant)), [s for s, m in zip(found, meant, strict=True) if m]
            if not found:
                continue
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            values = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], schema=schema)

    return sets


def least_estimate(percent: int) -> float:
    s = percent / 100
    return s - MARGIN * float(np.sqrt(s * (1 - s) / MINIMA)) / (1 - 2.0**-BITS)


def estimated(a: str, b: str):
    """Collision-corrected similarity of two packed signatures, as a Column."""
    unequal = F.lit(0)
    for i in range((MINIMA + 15) // 16):
        x = F.expr(f"{a}[{i}] ^ {b}[{i}]")
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(_NIBBLE)))
    chance = 2.0**-BITS
    return ((1 - unequal / F.lit(float(MINIMA))) - chance) / (1 - chance)


def _candidates(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Row pairs of a block pair between different components whose estimate is high enough, the best first."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    own = table["side"].to_numpy()
    root = table["root"].to_numpy()
    band = table["band"].to_numpy()
    doc = table["doc_id"].to_numpy()
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    sig = table["sig"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(doc), -1)
    left, right = (np.arange(len(doc)), np.arange(len(doc))) if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
    unequal = np.zeros((len(left), len(right)), np.int32)
    for w in range(sig.shape[1]):
        x = sig[left, w][:, None] ^ sig[right, w][None, :]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        unequal += np.bitwise_count(x & np.uint64(_NIBBLE))
    chance = 2.0**-BITS
    score = ((1 - unequal / MINIMA) - chance) / (1 - chance)
    fit = (score >= least_estimate(percent)) & (root[left][:, None] != root[right][None, :])
    if i == j:
        fit &= np.tri(len(doc), k=-1, dtype=bool)
    a, b = np.nonzero(fit)
    order = np.argsort(-score[a, b], kind="stable")
    a, b = left[a[order]], right[b[order]]
    same = bands[a] == bands[b]
    first = same.any(1) & ((band[a] == 0) | (bands[a, same.argmax(1)] == band[a]))  # the band in which this pair is looked at
    shared = table["shared"][0].as_py()
    groups = [frozenset(g.values.to_pylist()) for g in table["groups"]]
    return [(x, y) for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True) if min(groups[x] & groups[y]) == shared]  # and the group


_MEMBER = "key long, band long, shared long, i long, j long, side long, doc_id long, root long, bands array<long>, sig array<long>, groups array<long>"


def _active(percent: int):
    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = as_arrow(_MEMBER)
        for table in sorted_groups(batches, ["key", "i", "j"]):
            rows = sorted({r for pair in _candidates(table, percent) for r in pair})
            if rows:
                yield from table.take(pa.array(rows)).cast(schema).combine_chunks().to_batches()

    return active


def _confirmed(percent: int):
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["key", "i", "j"]):
            root = table["root"].to_pylist()
            doc = table["doc_id"].to_pylist()
            up = {r: r for r in root}

            def top(x: int, up: dict[int, int] = up) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            sets = [s.values.to_numpy() for s in table["shingles"]]
            links = []
            for a, b in _candidates(table, percent):
                if top(root[a]) != top(root[b]):
                    both = len(np.intersect1d(sets[a].view(np.uint64), sets[b].view(np.uint64), True))
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        up[top(root[a])] = top(root[b])
                        links.append((doc[a], doc[b]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], schema=as_arrow("u long, v long"))

    return confirmed


def _leaders(members: DataFrame) -> DataFrame:
    """(key, leader): the member that meets most others over all bands, the smallest of equals."""
    score = members.groupBy("doc_id").agg(F.sum("met").alias("score"))
    best = members.join(score, "doc_id").groupBy("key").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("minus"))).alias("m"))
    return best.select("key", (-F.col("m.minus")).alias("leader"))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, doc_id, root): the members of buckets that have several components."""
    rooted = members.join(roots, members["doc_id"] == roots["node"], "left").select(F.col("key").alias("band"), "doc_id", F.coalesce("root", "doc_id").alias("root"))
    rooted = written(rooted, "mh-rooted")
    several = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return written(rooted.join(several, "band", "left_semi"), "mh-open")


def _groups(opened: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, band, shared, doc_id, root, weight): the members of open buckets by the rare shingle that they share; band is 0 in undealt groups.

    And (doc_id, groups): the shingles by which each one is in a group.
    """
    nodes = opened.select("doc_id", "root").distinct()
    held = sets.join(nodes, "doc_id").select("doc_id", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    common = written(held.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "mh-common")
    by_doc = W.partitionBy("doc_id")
    ranked = held.join(common, "key").withColumn("rank", F.dense_rank().over(by_doc.orderBy("times", "key")))
    ranked = ranked.withColumn("alone", F.col("n") - F.max("rank").over(by_doc))  # shingles of this document only are rarer than all others
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rare = ranked.filter(F.col("alone") + F.col("rank") <= prefix)
    rare = written(rare.select("key", "doc_id", "root", (1 + F.floor(F.col("n") / ROW_SHINGLES)).alias("weight")).distinct(), "mh-rare")

    per_key = rare.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"),
    )
    kept = per_key.filter("low < high").groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    grouped = written(rare.join(kept, "key"), "mh-groups")
    small = grouped.filter(F.col("size") <= MOST_BLOCKS * BLOCK).select("key", F.lit(0).cast("long").alias("band"), F.col("key").alias("shared"), "doc_id", "root", "weight")
    dealt = grouped.filter(F.col("size") > MOST_BLOCKS * BLOCK).join(opened.select("doc_id", "band"), "doc_id")
    dealt = dealt.select(F.xxhash64("key", "band").alias("key"), "band", F.col("key").alias("shared"), "doc_id", "root", "weight")
    return written(small.unionByName(dealt), "mh-dealt"), grouped.groupBy("doc_id").agg(F.collect_set("key").alias("groups"))


def _blocks(groups: DataFrame) -> DataFrame:
    """Members of groups with several components, dealt to block pairs (i, j) of queries and others."""
    per_root = groups.groupBy("key", "root").agg(F.sum("weight").alias("n"))
    per_key = per_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"))
    split = per_key.filter("n > m.n").select("key", F.col("m.root").alias("major"), F.ceil(F.col("m.n") / BLOCK).alias("major_blocks"), F.ceil((F.col("n") - F.col("m.n")) / BLOCK).alias("query_blocks"))
    rows = groups.join(written(split, "mh-split"), "key")
    spread = F.xxhash64("doc_id")
    is_major = F.col("root") == F.col("major")
    side = F.when(is_major, F.col("query_blocks") + F.pmod(spread, "major_blocks")).otherwise(F.pmod(spread, "query_blocks"))
    partners = F.when(is_major, F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") + F.col("major_blocks") - 1))
    rows = rows.select("key", "band", "shared", "doc_id", "root", side.cast("long").alias("side"), F.explode(partners).alias("other"))
    return rows.select("key", "band", "shared", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "doc_id", "root")


def _classes(signed: DataFrame) -> DataFrame:
    """d1, d2, n, rep (least identifier), key (of a row of it), node: the classes of equal sets.

    A class is a node by its least identifier; where several have the same one, or none, by a hash of its digests.
    """
    classes = signed.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("doc_id").isNull(), F.col("t"))).alias("nameless"))
    several = classes.groupBy("rep").agg(F.min(F.struct("d1", "d2", "n")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    named = F.col("first").isNull() | (F.col("first") == F.struct("d1", "d2", "n"))
    node = F.coalesce(F.when(named, F.col("rep")), F.xxhash64("d1", "d2", "n"))
    return classes.join(several, "rep", "left").select("d1", "d2", "n", "rep", F.coalesce("rep", "nameless").alias("key"), node.alias("node"))


def _same_identifier(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (u, v) of the classes that have rows of one identifier, None if there are none."""
    rows, one = signed.filter("n > 0 AND doc_id IS NOT NULL"), F.struct("d1", "d2", "n")
    shared = written(rows.groupBy("doc_id").agg(F.min(one).alias("low"), F.max(one).alias("high")).filter("low < high").select("doc_id", "low"), "mh-shared")
    if shared.isEmpty():
        return None
    nodes = classes.select("d1", "d2", "n", "node")
    ends = rows.select("doc_id", "d1", "d2", "n").join(shared, "doc_id").distinct().join(nodes, ["d1", "d2", "n"])
    first = nodes.select(F.struct("d1", "d2", "n").alias("low"), F.col("node").alias("v"))
    return written(ends.join(first, "low").filter("node <> v").select(F.col("node").alias("u"), "v"), "mh-identifiers")


def _decided(docs: DataFrame, text: str, doc_id: str, words: int, percent: int) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id, kept: one row per input row.

    ``key`` is a row's identifier or, where that is null, the hash of its text; with ``t`` it tells texts apart.
    """
    ship(docs.sparkSession)
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text")).withColumn("t", F.xxhash64("text"))
    key = F.coalesce("doc_id", "t").alias("key")
    signed = written(rows.mapInArrow(_sign(words), _SIGNED), "mh-signed")
    classes = written(_classes(signed), "mh-classes")
    reps = signed.select("t", "d1", "d2", "n", "bands", "sig", key).join(classes.select("d1", "d2", "n", "key", "node"), ["key", "d1", "d2", "n"])
    reps = written(reps.select(F.col("node").alias("doc_id"), "key", "t", "d1", "d2", "bands", "sig").dropDuplicates(["doc_id"]), "mh-reps")

    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    met = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1"), "mh-buckets")
    members = written(keyed.join(met, "key"), "mh-members")
    leaders = written(_leaders(members), "mh-leaders")

    stars = members.join(leaders, "key").filter("doc_id <> leader").select("doc_id", "leader").distinct()
    near = stars.join(reps.select("doc_id", F.col("sig").alias("sig_a")), "doc_id").join(reps.select(F.col("doc_id").alias("leader"), F.col("sig").alias("sig_b")), "leader")
    near = near.filter(estimated("sig_a", "sig_b") >= least_estimate(percent)).select("doc_id", "leader")

    wanted = reps.select("doc_id", "key", "t", "d1", "d2").join(members, "doc_id", "left_semi")
    texts = rows.groupBy(key, "t").agg(F.first("text").alias("text"))  # copies are put together before the shuffle
    sets = written(texts.join(wanted, ["key", "t"]).select("doc_id", "d1", "d2", "text").mapInArrow(_sets(words), "doc_id long, shingles array<long>"), "mh-sets")
    pairs = near.join(sets.withColumnRenamed("shingles", "a"), "doc_id").join(sets.select(F.col("doc_id").alias("leader"), F.col("shingles").alias("b")), "leader")
    both = F.size(F.array_intersect("a", "b"))
    links = pairs.withColumn("both", both).filter(F.col("both") * 100 >= (F.size("a") + F.size("b") - F.col("both")) * percent)
    links = written(links.select(F.col("doc_id").alias("u"), F.col("leader").alias("v")), "mh-links")
    same = _same_identifier(signed, classes)
    links = links if same is None else links.unionByName(same)
    roots = components(links)

    opened = _open(members, roots)
    if not opened.isEmpty():
        more = _links_of_open_buckets(opened, sets, reps, percent)
        if not more.isEmpty():
            roots = components(roots.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))

    least = written(roots.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component")), "mh-least")
    found = classes.join(roots.join(least, "root").select("node", "component"), "node", "left")
    found = written(found.select("d1", "d2", "n", F.coalesce("component", "rep").alias("component")), "mh-found")
    out = signed.select("doc_id", "t", "n", "d1", "d2").join(found, ["d1", "d2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _links_of_open_buckets(opened: DataFrame, sets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between the components of open buckets, at most a spanning forest from each block."""
    dealt, groups = _groups(opened, sets, percent)
    facts = reps.select("doc_id", "bands", "sig").join(groups, "doc_id")
    blocks = _blocks(dealt).join(facts, "doc_id").select(*(c.split()[0] for c in _MEMBER.split(", ")))
    blocks = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    active = written(blocks.mapInArrow(_active(percent), _MEMBER), "mh-active")
    full = active.join(sets, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return written(full.mapInArrow(_confirmed(percent), "u long, v long"), "mh-more-links")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B|; component_id is the smallest identifier
    reachable over links.
    """
    return _decided(docs, text, doc_id, words, percent).drop("t")


def without_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component those of its smallest identifier.

    Rows without an identifier go if their component has one; a component of such rows alone stays whole.
    """

    def keys(identifier: Column, text_hash: Column) -> list[Column]:
        return [identifier.isNull().alias("nameless"), F.coalesce(identifier, text_hash).alias("key")]

    dropped = _decided(docs, text, doc_id, words, percent).filter(~F.col("kept") & F.col("component_id").isNotNull())
    dropped = dropped.select(*keys(F.col("doc_id"), F.col("t"))).distinct()
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("row"), *keys(column(doc_id).cast("long"), F.xxhash64(column(text))))
    return rows.join(dropped, ["nameless", "key"], "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))

"""Line deduplication by winnowing over line hashes, with DataFrame functions only.

Units are a document's lines with at least one word, trimmed.  The gram at a line is the shortest run of lines from
it with ``gram_words`` words.  Among the grams that start within ``window_words - gram_words`` words of a line, the
one of least hash is selected: a fingerprint.  Runs that are equal in two places have equal windows, so every
repeated run of at least ``window_words`` words has a fingerprint in common, however its lines are cut.

Every place of a shared fingerprint is extended backwards and forwards over the lines that are equal at any earlier
place of it, to the first unequal one, and these runs, of ``gram_words`` words at least, are deleted.  For this, each
run of lines that begins or ends at the fingerprint's line has a key (the hash of the gram and of the lines passed), and
it is a repeat if the key has an earlier place; so all earlier places count and no pairs are made.  "Earlier" is by
doc_id, then by line, so the first copy of any line stays.

Keys go as far as a window before the fingerprint's line and less than a window after its end, and this is no limit:
what is equal beyond has a fingerprint of its own there, at both places.  Else a gram that starts within
``window_words - gram_words`` words of the next line would reach over the end of the equal lines, so less than
``window_words`` words of them would be left, whatever the length of the fingerprint's line.

Nothing is per source or per hash in one task: minima are pre-aggregated, and shared fingerprints and first places are
written tables, so Spark splits a fingerprint that a third of all documents share.

Defined results: null and blank texts stay as they are; rows with a null doc_id stay as they are and are matched with
nothing; rows that repeat a doc_id and a text are one document and get the same cuts; a document of which every line is
cut gets an empty text; a very long text is many lines, whose windows hold no more than their words; an empty table gives no
rows; other columns pass through, whatever their names, and where one is called ``n_lines`` or ``removed_lines``, the added
column has an underscore more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.llm.batches import column, unused
from chatloom.session import written

GRAM_WORDS = 25
WINDOW_WORDS = 50
_TRIMMED = " \t\r\x0b\x0c"


def _units(text: Column) -> Column:
    """array<struct<pos, h, w>> of the lines that have words."""

    def unit(line: Column, pos: Column) -> Column:
        bare = F.trim(line, F.lit(_TRIMMED))
        return F.struct(pos.alias("pos"), F.xxhash64(bare).alias("h"), F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[ \\t\\r\\x0b\\x0c]+"))).alias("w"))

    return F.filter(F.transform(F.split(text, "\n"), unit), lambda u: u["w"] > 0)


def fingerprints(docs: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    """(d, t, pos, gram, before, before_pos, after, after_pos) of every selected gram.  ``docs``: d, t, units."""
    lines = docs.groupBy("d", "t").agg(F.first("units").alias("units")).select("d", "t", F.inline("units"))
    by_doc = W.partitionBy("d", "t")
    lines = lines.withColumn("at", F.coalesce(F.sum("w").over(by_doc.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    by_word = by_doc.orderBy("at")
    gram = by_word.rangeBetween(0, gram_words - 1)
    lines = lines.withColumn("gram", F.when(F.sum("w").over(gram) >= gram_words, F.xxhash64(F.collect_list("h").over(gram))))
    slack = window_words - gram_words
    lines = lines.withColumn("least", F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "pos"))).over(by_word.rangeBetween(0, slack)))
    chosen = F.collect_list("least.pos").over(by_word.rangeBetween(-slack, 0))
    before, after = by_word.rangeBetween(-window_words, -1), by_doc.orderBy(F.col("at") + F.col("w")).rangeBetween(1, window_words - 1)
    lines = lines.withColumns({"chosen": chosen} | {name + suffix: F.collect_list(c).over(frame) for name, frame in (("before", before), ("after", after)) for suffix, c in (("", "h"), ("_pos", "pos"))})
    return lines.filter(F.col("gram").isNotNull() & F.array_contains("chosen", F.col("pos"))).select("d", "t", "pos", "gram", "before", "before_pos", "after", "after_pos")


def _keyed(shared: DataFrame) -> DataFrame:
    """(key, d, t, pos, end): the runs of lines between a fingerprint's line and each line around it."""

    def runs(lines: Column, ends: Column, side: int) -> Column:
        keys = F.transform(lines, lambda _, k: F.xxhash64(F.lit(side), "gram", F.slice(lines, 1, k + 1)))
        return F.zip_with(keys, ends, lambda key, end: F.struct(key.alias("key"), end.alias("end")))

    own = F.array(F.struct(F.col("gram").alias("key"), F.col("pos").alias("end")))
    every = F.concat(own, runs(F.reverse("before"), F.reverse("before_pos"), -1), runs(F.col("after"), F.col("after_pos"), 1))
    return shared.select("d", "t", "pos", F.inline(every))


def repeated_runs(prints: DataFrame) -> DataFrame:
    """(d, t, first_line, last_line): disjoint runs of lines that repeat an earlier place."""
    prints = written(prints, "ld-prints")
    repeated = prints.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    keyed = _keyed(written(prints.join(written(repeated, "ld-repeated"), "gram"), "ld-shared"))
    place = F.struct("d", "t", "pos")
    first = keyed.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    found = keyed.join(written(first, "ld-first"), "key").filter(place != F.col("first"))
    runs = found.select("d", "t", F.least("pos", "end").alias("s"), F.greatest("pos", "end").alias("e"))
    by_doc = W.partitionBy("d", "t").orderBy("s", "e")
    reach = F.max("e").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0))
    runs = runs.withColumn("island", F.sum("new").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("d", "t", "island").agg(F.min("s").alias("first_line"), F.max("e").alias("last_line")).drop("island")


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of lines cut from ``text``, and two more columns: n_lines and removed_lines."""
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("row"), column(doc_id).cast("long").alias("d"), column(text).alias("text"), F.xxhash64(column(text)).alias("t"))
    units = rows.filter("d IS NOT NULL AND text IS NOT NULL").select("d", "t", _units(F.col("text")).alias("units"))
    runs = repeated_runs(fingerprints(units.filter(F.size("units") > 0), gram_words, window_words))
    cuts = runs.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("first_line", "last_line"))).alias("cuts"))
    out = rows.join(cuts, ["d", "t"], "left").withColumn("lines", F.when(F.col("cuts").isNotNull(), F.split("text", "\n")))

    def kept(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.col("cuts")[i - 1]["last_line"] + 1)
        end = F.when(i == F.size("cuts"), F.size("lines")).otherwise(F.col("cuts")[i]["first_line"])
        return F.slice("lines", start + 1, end - start)

    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts")), kept))
    cut_text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(pieces, "\n"))
    removed = F.aggregate("cuts", F.lit(0), lambda n, c: n + c["last_line"] - c["first_line"] + 1)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    same = [cut_text.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    counts = [n_lines.cast("long").alias(unused(docs.columns, "n_lines")), F.coalesce(removed, F.lit(0)).cast("long").alias(unused(docs.columns, "removed_lines"))]
    return out.select(*same, *counts)

"""Table-driven tests of text and time functions at a fixed as_of (Thursday, 2024-02-01 12:00 UTC)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chatloom.functions import arrays as A
from chatloom.functions import text as X
from chatloom.functions import timeparse as P
from chatloom.sources.messages import AS_OF_MS

GRAMMAR = [
    ("09:30", (9, 30, None, None, None)),
    ("昨天 21:45", (21, 45, 1, 31, 2024)),
    ("昨天21：45", (21, 45, 1, 31, 2024)),
    ("周三 20:40", (20, 40, 1, 31, 2024)),
    ("星期四 20:40", (20, 40, 1, 25, 2024)),
    ("2月11日 20:54", (20, 54, 2, 11, None)),
    ("13月1日 10:00", None),
    ("25:00", None),
    ("1/15 09:30", None),
    ("2025/1/15 09:30", None),
    ("今天21:30", None),
    ("21：30", None),
    ("21:200", None),
    ("see you at 9:30 tomorrow ok then", None),
    (None, None),
    ("", None),
]

CHECKPOINTS = [
    ("14:27", 1706797620000, 1706797620000),
    ("昨日 08:05", 1706688300000, 1706688300000),
    ("周三 20:40", 1706733600000, 1706733600000),
    ("是期三 20:40", 1706733600000, 1706733600000),
    ("星期三 20:40", 1706820000000, 1706733600000),
    ("1/15 09:30", 1705311000000, 1705311000000),
    ("2月17日 14:27", 1708180020000, 1708180020000),
    ("2月31日 10:00", 1709373600000, 1709373600000),
    ("2025/1/15 09:30", 1736933400000, 1736933400000),
    ("现在", 1706745600000, 1706788800000),
]


def test_grammar(spark):
    df = spark.createDataFrame([(s,) for s, _ in GRAMMAR], "s string")
    got = [r.p for r in df.select(P.parse_timestamp(F.col("s"), AS_OF_MS).alias("p")).collect()]
    want = [w for _, w in GRAMMAR]
    assert [None if g is None else tuple(g) for g in got] == want


@pytest.mark.parametrize("parity", [True, False])
def test_checkpoints(spark, parity):
    df = spark.createDataFrame([(s,) for s, _, _ in CHECKPOINTS], "s string")
    got = [r.e for r in df.select(P.checkpoint(F.col("s"), AS_OF_MS, strict_parity=parity)["epoch_ms"].alias("e")).collect()]
    assert got == [(a if parity else b) for _, a, b in CHECKPOINTS]


def test_zone_moves_the_wall_clock(spark):
    df = spark.createDataFrame([("14:27",)], "s string")
    got = df.select(P.checkpoint(F.col("s"), AS_OF_MS, tz="Asia/Shanghai")["epoch_ms"].alias("e")).first().e
    assert got == 1706797620000 - 8 * 3600000


def test_unicode_spaces_are_stripped(spark):
    df = spark.createDataFrame([("　Hello  ﻿World\t",), (None,)], "s string")
    assert [r.n for r in df.select(X.norm_content(F.col("s")).alias("n")).collect()] == ["helloworld", ""]


def test_targets_and_lists(spark):
    df = spark.createDataFrame([("A|群聊, B ,|x",)], "s string")
    row = df.select(X.targets(F.col("s")).alias("t"), X.csv_list(F.col("s")).alias("c")).first()
    assert [tuple(t) for t in row.t] == [("A", "群聊"), ("B", "联系人")]
    assert row.c == ["A|群聊", "B", "|x"]


def test_stamps_take_missing_parts_from_today(spark):
    df = spark.createDataFrame([("14:27",), ("2月17日 14:27",), ("2025/1/15 09:30",), ("昨天 8:05",), ("0月3日 10:00",)], "s string")
    got = [r[0] for r in df.select(P.checkpoint_stamp(P.checkpoint(F.col("s"), AS_OF_MS), AS_OF_MS)).collect()]
    assert got == ["20240201_1427", "20240217_1427", "20250115_0930", "20240131_0805", "20240203_1000"]
    none = F.lit(None).cast("struct<year:int,month:int,day:int,hour:int,minute:int>")
    assert df.select(P.checkpoint_stamp(none, AS_OF_MS).alias("x")).first().x == "00000000_0000"


def test_every_marker_of_a_content(spark):
    text = "a【图片：截图】b【文件|报表.xlsx|2.5MB】c【图片】【文件|x】"
    row = spark.createDataFrame([(text,), ("none",)], "c string").select(X.all_markers(F.col("c")).alias("m"), X.truncated(F.col("c"), 3).alias("t"), X.random_delay(5, 7).alias("d")).collect()
    assert [(m.kind, m.label, m.size) for m in row[0].m] == [("picture", "截图", ""), ("file", "报表.xlsx", "2.5MB"), ("picture", "", "")] and row[1].m == []
    assert row[0].t == "a【图" and all(5 <= r.d <= 7 for r in row)


def test_adjacent_duplicates_go(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, [1.0, 2.0]), (1, 3, [9.0, 2.0]), (1, 4, [1.0, 2.0]), (2, 1, [1.0, 2.0])], "g int, i int, a array<double>")
    assert sorted((r.g, r.i) for r in A.without_adjacent_duplicates(df, ["g"], "i", "a", 0.5, 0.9).collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]


def test_log_record(spark):
    df = spark.createDataFrame([("2024-01-15 21:30:45 [INFO]: message",), ("junk",)], "s string")
    got = [r.r for r in df.select(X.log_record(F.col("s")).alias("r")).collect()]
    assert tuple(got[0]) == ("2024-01-15 21:30:45", "info", "message") and got[1] is None


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 9.0, 4.0], [])], "a array<double>, b array<double>, e array<double>")
    row = df.select(
        A.share_within(F.col("a"), F.col("b"), 1.0).alias("s"),
        A.share_within(F.col("a"), F.col("e"), 1.0).alias("unequal"),
        A.p75(F.col("a"), 40.0).alias("p"),
        A.p75(F.col("e"), 40.0).alias("none"),
        A.longest_run(F.col("a"), 1.5).alias("run"),
        A.overlap(F.array(*map(F.lit, range(0, 4000, 40))).cast("array<double>"), F.array(*map(F.lit, range(1600, 5600, 40))).cast("array<double>"), 1).alias("o"),
    ).first()
    assert (row.s, row.unequal, row.p, row.none, row.run, row.o) == (0.75, 0.0, 4.0, 40.0, 3, 60)

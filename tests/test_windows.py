"""Windows of hot keys against a row-by-row version."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from chatloom.operators import dedup as D
from chatloom.operators import states as S
from chatloom.operators import windows as W
from chatloom.streaming.stateful import window_positions


def plain(rows, window):
    """(key, t, start, before) of each row, in order of time."""
    out, state = [], {}
    for key, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        start, n = state.get(key, (None, 0))
        if start is None or t >= start + window:
            start, n = t, 0
        out.append((key, t, start, n))
        state[key] = (start, n + 1)
    return out


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("window", "reach"), [(1, 500), (7, 2000), (50, 3000), (1000, 3000), (10**6, 5000), (40, 80)])
def test_one_hot_key_and_others(many_partitions, window, reach):
    rnd = random.Random(window)
    rows = [("hot", rnd.randrange(reach)) for _ in range(900)]
    rows += [(rnd.choice(["a", "b", "zz", None]), rnd.randrange(reach)) for _ in range(120)] + [(f"k{i}", rnd.randrange(reach)) for i in range(60)]
    df = many_partitions.createDataFrame([*rows, ("hot", None)], "key string, t long").repartition(5)
    want = plain(rows, window)
    first: dict = {}
    for key, t, start, before in want:
        first.setdefault((key, t), (start, before))
    got = W.window_starts(df, ["key"], "t", window).collect()
    assert {(r.key, r.t): (r.start, r.before) for r in got} == first
    assert sum(r.n for r in got) == len(rows)
    kept = sorted((str(r.key), r.t) for r in D.seen_cache(df, ["key"], "t", window).collect())
    assert kept == sorted({(str(k), t) for k, t, start, _ in want if start == t})
    for limit in (0, 1, 3):
        allowed = sorted((str(r.key), r.t, r.allowed) for r in S.rate_limit(df, "key", "t", limit, window).collect())
        assert allowed == sorted((str(k), t, before < max(limit, 1)) for k, t, _, before in want)


def test_one_key_alone_is_shared_out(many_partitions):
    rows = [("only", t * 3 % 4001) for t in range(4000)]
    df = many_partitions.createDataFrame(rows, "key string, t long")
    out = W.window_starts(df, ["key"], "t", 25)
    sizes = out.groupBy(W.F.spark_partition_id()).count().collect()
    assert len(sizes) > 3 and max(r["count"] for r in sizes) < 3000
    first: dict = {}
    for key, t, start, before in plain(rows, 25):
        first.setdefault((key, t), (start, before))
    assert {(r.key, r.t): (r.start, r.before) for r in out.collect()} == first


def test_several_key_columns_and_no_rows(many_partitions):
    rnd = random.Random(3)
    rows = [(rnd.choice(["x", None]), rnd.randrange(3), rnd.randrange(400)) for _ in range(500)]
    df = many_partitions.createDataFrame(rows, "a string, b int, t long")
    got = D.seen_cache(df, ["a", "b"], "t", 20).collect()
    want = plain([(f"{a}/{b}", t) for a, b, t in rows], 20)
    assert sorted((f"{r.a}/{r.b}", r.t) for r in got) == sorted({(k, t) for k, t, start, _ in want if start == t})
    assert D.seen_cache(df.limit(0), ["a", "b"], "t", 20).count() == 0
    with pytest.raises(ValueError):
        W.window_starts(df, ["a"], "t", 0)


def test_jumps_and_orbits():
    rnd = np.random.default_rng(1)
    group = np.sort(rnd.integers(0, 40, 500))
    times = rnd.integers(-(10**15), 10**15, 500)  # a few groups fit into 63 bits at a time
    times = times[np.lexsort((times, group))]
    jump = W.jumps(group, times, 10**13)
    for i in range(500):
        later = [j for j in range(500) if group[j] == group[i] and times[j] >= times[i] + 10**13]
        assert jump[i] == (min(later) if later else 500)
    starts = np.diff(group, prepend=-1) > 0
    want = set()
    for i in np.flatnonzero(starts):
        while i < 500:
            want.add(int(i))
            i = jump[i]
    assert set(np.flatnonzero(W.followed(starts, jump)).tolist()) == want
    last = W.lasts(jump)
    for i in range(500):
        j = i
        while jump[j] < 500:
            j = jump[j]
        assert last[i] == j
    assert W.group_numbers([pa.array(["a", "a", None, None, "b"]), pa.array([1, 2, 2, 2, 2])]).tolist() == [0, 1, 2, 2, 3]


def test_positions_of_a_stream():
    times = np.array([0, 1, 5, 5, 9, 10, 11, 30])
    assert window_positions(times, None, 5) == [0, 2, 5, 7]
    assert window_positions(times, 6, 5) == [4, 7]
    assert window_positions(times, 99, 5) == []

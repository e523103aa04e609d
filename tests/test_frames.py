"""Strips, dividers and separators of small pictures against plain loops."""

from __future__ import annotations

import random

import pytest

from chatloom.operators import frames as R


def picture(rnd, width, height, edge, faint):
    """Texture on the left, a lighter and calmer panel from ``edge`` on."""
    rows = []
    for y in range(height):
        rows.append([float(100 + rnd.randrange(30) if x < edge else 170 + rnd.randrange(4)) if not faint else float(100 + rnd.randrange(4)) for x in range(width)])
    return rows


def plain_divider(v, width, height, r):
    top, end = int(height * r.top), height - int(height * r.bottom)
    first, last = int(width * r.left), width - max(r.right_pad, int(width * 0.03))
    d = lambda y, x: abs(v[y][x] - v[y][x - 1])
    step = max(1, (end - top) // r.samples)
    every = sorted(d(y, x) for x in range(first + 1, last) for y in range(top, end, step))
    threshold = max(r.threshold[0], min(r.threshold[1], every[int(len(every) * 0.75)] or r.threshold[2]))

    def run_of(flags):
        best = now = 0
        for f in flags:
            now = now + 1 if f else 0
            best = max(best, now)
        return best

    scores = []
    for x in range(first + 1, last):
        ds = [d(y, x) for y in range(top, end, step)]
        above = [z > threshold for z in ds]
        scores.append(sum(ds) / len(ds) * (sum(above) / len(ds)) * (0.5 + 0.5 * run_of(above) / len(ds)))
    smooth = []
    for i in range(len(scores)):
        near = [(scores[i + j], 1 - abs(j) / (r.reach + 1)) for j in range(-r.reach, r.reach + 1) if 0 <= i + j < len(scores)]
        smooth.append(sum(s * w for s, w in near) / sum(w for _, w in near))
    mean = sum(smooth) / len(smooth)
    bands, now = [], None
    for i, s in enumerate([*smooth, -1.0]):
        if s >= mean * r.band_factor:
            now = [i, i, s] if now is None else [now[0], i, max(now[2], s)]
        elif now is not None:
            bands.append((first + 1 + now[0], first + 1 + now[1], now[2]))
            now = None
    found = []
    for a, b, peak in bands:
        c = (a + b) // 2
        if b - a < r.least_width or not int(width * r.least_center) <= c <= int(width * r.most_center):
            continue
        flags = [d(y, c) > threshold for y in range(top, end, r.strength_step)]
        run, coverage = run_of(flags) * r.strength_step, sum(flags) / len(flags)
        fine = max(1, (end - top) // r.texture_samples)
        mean_of = lambda xs: (lambda q: sum(q) / len(q) if q else 0.0)([d(y, x) for x in xs for y in range(top, end, fine)])
        delta = mean_of(range(max(1, c - r.gap - r.panel), max(1, c - r.gap))) - mean_of(range(min(width - 2, c + r.gap), min(width - 2, c + r.gap + r.panel)))
        found.append((round(run / (end - top) * 100 + coverage * 20 + max(0, delta) + peak * 0.05, 9), -c, delta, run, coverage))
    if not found:
        return int(width * r.fallback), False
    _, minus, delta, run, coverage = max(found)
    sure = delta >= 0 and run / (end - top) >= r.least_continuity and coverage >= r.least_coverage
    return (-minus if sure else int(width * r.fallback)), sure


@pytest.mark.parametrize("rules", [R.DividerRules(right_pad=5), R.DividerRules(right_pad=5, samples=7, strength_step=1, panel=9, gap=2, reach=2)])
def test_dividers(spark, rules):
    rnd = random.Random(8)
    pictures = {k: picture(rnd, 70, 40, edge, edge == 0) for k, edge in enumerate((30, 22, 45, 0, 60, 33))}
    df = spark.createDataFrame([(k, [x for row in p for x in row]) for k, p in pictures.items()], "frame int, pixels array<double>")
    got = {r.frame: (r.divider, r.confident) for r in R.dividers(R.pixels_of(df, 70), 70, 40, rules).collect()}
    assert got == {k: plain_divider(p, 70, 40, rules) for k, p in pictures.items()}
    assert rules.samples < 50 or got[0] == (30, True) and not got[3][1]


def test_separators(spark):
    rnd = random.Random(2)
    rows = []
    for frame, (head, foot) in enumerate(((9, 80), (20, 70), (12, None), (None, None))):
        for y in range(100):
            level = 100 + 60 * (head is not None and y >= head) - 60 * (foot is not None and y >= foot)
            rows += [(frame, y, x, float(level + rnd.randrange(3))) for x in range(30)]
    df = spark.createDataFrame(rows, "frame int, y int, x int, v double")
    got = {r.frame: tuple(r)[1:] for r in R.separators(df, 100, R.SeparatorRules(least_gap=20)).collect()}
    assert got == {0: (9, 80, 1.0), 1: (20, 70, 1.0), 2: (12, 88, 0.5), 3: (12, 88, 0.0)}
    near = {r.frame: tuple(r)[1:] for r in R.separators(df, 100).collect()}
    assert near[0] == (12, 88, 1.0)  # nearer than the least gap


def test_strips_show_what_repeats_once(spark):
    rnd = random.Random(4)
    lines = [[float(rnd.randrange(256)) for _ in range(6)] for _ in range(60)]
    flat = lambda a, b: [x for row in lines[a:b] for x in row]
    shots = [("s", 0, flat(0, 20)), ("s", 1, flat(0, 20)), ("s", 2, flat(12, 32)), ("s", 3, flat(40, 60)), ("t", 0, flat(5, 9))]
    df = spark.createDataFrame(shots, "strip string, seq int, pixels array<double>")
    got = R.strip_rows(df, "strip", "seq", "pixels", 6, step=1).orderBy("strip", "at").collect()
    mine = [r for r in got if r.strip == "s"]
    assert [r.at for r in mine] == list(range(52)) and {r.seq for r in mine} == {0, 2, 3}
    assert [r.pixels for r in mine] == lines[:32] + lines[40:]
    assert [r.pixels for r in got if r.strip == "t"] == lines[5:9]


def test_pixels_of_arrays(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "frame int, pixels array<double>")
    got = sorted(tuple(r) for r in R.pixels_of(df, 3).select("y", "x", "v").collect())
    assert got == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (1, 1, 5.0), (1, 2, 6.0)]
    assert R.dividers(R.pixels_of(df.limit(0), 3), 70, 40).count() == 0


def test_null_is_json():
    from chatloom.operators.vlm_json import recover

    assert recover("null") == (1, "null") and recover("```json\nnull\n```") == (2, "null") and recover("nul")[0] == 5


def test_lines_of_fragments_in_any_batches(spark):
    from chatloom.operators.states import y_groups

    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(0, 60, 3)]), rnd.choice([None, *range(9)]), rnd.choice(["u", "v", None])) for _ in range(200)]
    want = []
    for p in ("a", "b", None):
        mine = sorted((r[1:] for r in rows if r[0] == p), key=lambda r: tuple((c is not None, c or 0) if i < 2 else (c is not None, c or "") for i, c in enumerate(r)))
        lines = []
        for y, x, t in mine:
            if lines and y is not None and lines[-1][0] is not None and abs(y - lines[-1][0]) <= 8:
                mean, parts = lines[-1]
                lines[-1] = (float((mean * len(parts) + y) / (len(parts) + 1) + 0.5) // 1, [*parts, (x, t)])
            else:
                lines.append((y, [(x, t)]))
        for k, (mean, parts) in enumerate(lines):
            text = "".join(t for _, t in sorted(parts, key=lambda q: (q[0] is not None, q[0] or 0, q[1] is not None, q[1] or "")) if t is not None)
            want.append((p, k, None if mean is None else float(mean), text))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = [tuple(r) for r in y_groups(spark.createDataFrame(rows, "pg string, y int, x int, text string"), "pg").collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(repr, got)) == sorted(map(repr, want))

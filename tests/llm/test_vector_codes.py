"""Product codes against a plain version in Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from chatloom.llm.vector_codes import Codebooks, block_edges, compress, decode, encode, learn_codebooks, lower_bounds, nearest, usable
from chatloom.llm.vector_codes import _blocks

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n int"


def plain(rows, parts, entries, rounds):
    """(vec_id, label, code, error) of every row, and the final entries, by brute force."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    values = [[math.floor(256 * x) for x in r[1]] for r in rows]
    length = len(values[0]) // parts
    cut = [[v[p * length : (p + 1) * length] for p in range(parts)] for v in values]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def assign():
        out = []
        for v in cut:
            pairs = [min((sum((a - b) ** 2 for a, b in zip(v[p], c)), e) for e, c in enumerate(books[p])) for p in range(parts)]
            out.append(pairs)
        return out

    for _ in range(rounds):
        assigned = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut[i][p] for i, a in enumerate(assigned) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = [(r[0], r[2], "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a)) for r, a in zip(rows, assign())]
    return out, books


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(150):
        v = [float(np.float32(x + rng.gauss(0, 0.2))) for x in rng.choice(centres)]
        rows.append((i * 3, v, rng.choice([1, 2, None])))
    rows += [(400 + i, rows[7][1], 1) for i in range(20)]  # equal vectors
    rows += [(None, rows[9][1], None), (12, rows[3][1], 2), (12, rows[3][1], 2)]
    return rows


def test_codes_errors_and_codebooks_equal_the_plain_version(shipped, vectors):
    df = shipped.createDataFrame([(*r, "x", 1) for r in vectors], SCHEMA).repartition(5)
    want, books = plain(vectors, 4, 16, 2)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
    got = [tuple(r) for r in compress(df, parts=4, entries=16).collect()]
    assert sorted(map(repr, got)) == sorted(repr((*w, sums[w[1]], digest)) for w in want)


def test_unusable_vectors_go(shipped, vectors):
    odd = [(-9, None, 1), (-8, [], 1), (-7, [1.0], 1), (-6, [float("nan")] * 12, 1), (-5, [float("inf")] + [0.0] * 11, 1), (-4, [None] + [0.0] * 11, 1), (5000, [0.0] * 24, 1), (5001, [1e9] * 12, 1)]
    df = shipped.createDataFrame([(*r, "x", 1) for r in vectors + odd], SCHEMA)
    with_odd = sorted(map(repr, compress(df, parts=4, entries=16).collect()))
    without = shipped.createDataFrame([(*r, "x", 1) for r in vectors], SCHEMA)
    assert with_odd == sorted(map(repr, compress(without, parts=4, entries=16).collect()))


def test_empty_and_small_tables(shipped):
    none = shipped.createDataFrame([], SCHEMA)
    assert compress(none).count() == 0
    assert compress(shipped.createDataFrame([(1, None, 1, "x", 1)], SCHEMA)).count() == 0
    one = compress(shipped.createDataFrame([(1, [0.5] * 16, None, "x", 1)], SCHEMA)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00" * 16, 0, 0)]


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 8, 13])
@pytest.mark.parametrize("reach", [3, 300, 2**27])
def test_bounds_never_pass_the_distance_and_nearest_is_the_least(length, reach):
    rng = np.random.default_rng(length * reach)
    x, c = rng.integers(-reach, reach + 1, (300, length)), rng.integers(-reach, reach + 1, (40, length))
    c[20:30] = c[:10]  # ties
    exact = ((x[:, None] - c[None]) ** 2).sum(-1)
    for edges in block_edges(length):
        bound = lower_bounds(*(b[:, None] for b in _blocks(x, edges)), *(b[None] for b in _blocks(c, edges)))
        assert (bound <= exact).all()
    entry, distance = nearest(x, c)
    assert (entry == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_decoded_vectors_are_the_entries(shipped, vectors):
    df = shipped.createDataFrame([(*r, "x", 1) for r in vectors], SCHEMA)
    rows, length = usable(df, 4)
    books = learn_codebooks(rows, 4, 16, 1)
    assert length == 12 and books.entries.shape == (4, 16, 3)
    for r in decode(encode(rows, books), books).collect():
        code = [int(r["code"][2 * p : 2 * p + 2], 16) for p in range(4)]
        assert r["decoded"] == [v / 256 for p, e in enumerate(code) for v in books.entries[p, e].tolist()]


def test_too_many_entries_are_refused(shipped):
    with pytest.raises(ValueError, match="two hex digits"):
        learn_codebooks(shipped.createDataFrame([], SCHEMA), 4, 300)
    assert Codebooks(np.zeros((1, 1, 1), np.int64)).sha256 == hashlib.sha256(b"0").hexdigest()

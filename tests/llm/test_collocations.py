"""Collocations against a plain count of every run of words."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chatloom.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_runs(text, most):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        words = re.findall(r"[^\x20\x09]+", piece)
        for k in range(1, most + 1):
            for i in range(len(words) - k + 1):
                yield tuple(words[i : i + k])


def plain(rows, words, least, share, top):
    f: dict[str, Counter] = {}
    for text, lang in rows:
        f.setdefault(lang or "und", Counter()).update(plain_runs(text, words))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        scored = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if all(100 * b < share * a for b in longer):
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def _texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é☃", "new", "york", "city", "x", "don't", "a-b"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(["New York City", "of the", "la la la la"]))
            parts.append(rng.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n", " ! ", "\r\n", " "]))
        rows.append(("".join(parts), rng.choice(["en", "en", "de", None])))
    return rows + [(None, "en"), ("", "fr"), ("  \n", "fr"), ("...", None)]


@pytest.mark.parametrize(("words", "least", "share", "top"), [(3, 10, 50, 2000), (3, 4, 80, 25), (2, 3, 50, 10), (4, 3, 60, 50)])
def test_phrases_equal_the_plain_count(shipped, monkeypatch, words, least, share, top):
    rows = _texts(words * least, 150)
    df = shipped.createDataFrame([(t, x, 1, "q", 2) for t, x in rows], "text string, lang string, f int, phrase string, n int").repartition(5)
    got = co.collocations(df, words, least, share, top, bits=18)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, words, least, share, top))


def test_a_full_sketch_changes_no_result(shipped):
    rows = _texts(1, 60)
    df = shipped.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, co.collocations(df, 3, 4, bits=16).collect())) == sorted(plain(rows, 3, 4, 50, 2000))


@pytest.mark.parametrize("most", [1, 7, 64, 1000])
def test_shards_count_every_run_once_wherever_they_are_cut(most):
    rows = _texts(9, 12)
    batch = pa.RecordBatch.from_pydict({"lang": [x or "und" for _, x in rows], "text": [t for t, _ in rows]})
    got: dict[str, Counter] = {}
    for shard in co.shards(iter([batch]), 3, most):
        likely, patterns = co.passing(shard, 3, np.full(1 << 13, 255, np.uint8), 16)
        assert likely.all() and len(set(patterns)) == len(patterns)
        counts = co.count_matches(shard, patterns)
        own = got.setdefault(shard.lang, Counter())
        own.update({tuple(p[1:-1].decode().split(" ")): int(c) for p, c in zip(patterns, counts, strict=True) if c})
        own.update((shard.words[i].as_py().decode(),) for i in shard.ids[: shard.own].tolist())
        got[shard.lang][()] += shard.own
    want: dict[str, Counter] = {}
    for text, lang in rows:
        runs = Counter(plain_runs(text, 3))
        want.setdefault(lang or "und", Counter()).update(runs)
        want[lang or "und"][()] += sum(c for p, c in runs.items() if len(p) == 1)
    assert {k: +v for k, v in got.items()} == {k: +v for k, v in want.items()}


def test_bounds_never_lose_a_frequent_run(shipped):
    rows = _texts(4, 80)
    df = shipped.createDataFrame([(t, x or "und") for t, x in rows], "text string, lang string").repartition(6)
    reached = co.frequent_cells(df.select("lang", "text"), 3, 5, 16)
    frequent: dict[str, Counter] = {}
    for text, lang in rows:
        frequent.setdefault(lang or "und", Counter()).update(plain_runs(text, 3))
    for text, lang in rows:
        shard = co.Shard(lang or "und", (text or "").encode())
        likely, found = co.passing(shard, 3, reached, 16)
        found = {*found, *(b" " + w + b" " for w in shard.words.filter(pa.array(likely)).to_pylist())}
        for run in plain_runs(text, 3):
            if frequent[lang or "und"][run] >= 5:
                assert (" " + " ".join(run) + " ").encode() in found


def test_scores_are_exact_beyond_64_bits(shipped):
    a, left, right = 10**15 - 7, 10**15 + 3, 10**15 + 11
    counts = shipped.createDataFrame([("en", "p q", a), ("en", "p", left), ("en", "q", right), ("en", "", 5)], "lang string, phrase string, f long")
    (row,) = co.scored_candidates(counts).collect()
    assert (row["a"], row["l"], row["r"], row["score"]) == (a, left, right, 1000000 * a * a // (left * right))


def test_odd_rows(odd_docs, no_docs):
    got = co.collocations(odd_docs, 3, 2, bits=18).collect()
    want = plain([(r["text"], r["lang"]) for r in odd_docs.select("text", "lang").collect()], 3, 2, 50, 2000)
    assert sorted(map(tuple, got)) == sorted(want)
    assert co.collocations(no_docs, bits=16).count() == 0


def test_keys_of_many_words_stay_exact():
    shard = co.Shard("en", " ".join(f"w{i}" for i in range(3000)).encode() * 2)
    first = shard.runs(6)[0]
    keys = shard.keys(first, 6)
    runs = [tuple(shard.ids[i : i + 6].tolist()) for i in first.tolist()]
    assert len(np.unique(keys)) == len(set(runs))


def _frequent_far_below_the_best(seed, n):
    """Words of very different frequency, phrases that keep together, and phrases inside longer ones."""
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    phrases = [f"p{i} q{i % 40} p{i + 1}" for i in range(0, 200, 2)] + [f"p{i} q{i % 40}" for i in range(0, 200, 5)] + [f"c{i % 30} s{i} c{i % 7}" for i in range(90)] + ["t t t t"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(common if (x := rng.random()) < 0.6 else rare if x < 0.75 else phrases) + rng.choice([" "] * 9 + [". ", "\n", "\t"]) for _ in range(rng.randint(0, 80))]
        rows.append(("".join(parts), rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize(("words", "least", "share", "top", "thresholds"), [(3, 10, 50, 60, (100_000, 1_000)), (3, 4, 80, 25, (300_000,)), (2, 3, 50, 10, (50_000,)), (4, 3, 60, 50, (200_000, 20_000)), (3, 5, 50, 2000, (400_000,))])
def test_a_score_to_reach_first_changes_no_result(shipped, words, least, share, top, thresholds):
    rows = [*_texts(words + least, 100), *_frequent_far_below_the_best(top, 150)]
    df = shipped.createDataFrame(rows, "text string, lang string").repartition(5)
    got = co.collocations(df, words, least, share, top, 16, small=0, thresholds=thresholds)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, words, least, share, top))


@pytest.mark.parametrize("full", [False, True])
def test_few_runs_are_counted_however_full_the_sketch_is(full):
    """What goes into an automaton is bounded by what may reach the score, not by the cells of the sketch."""
    rng = random.Random(5)
    text = " ".join(rng.choice([f"c{rng.randrange(40)}", f"c{rng.randrange(40)}", f"r{rng.randrange(4000)}"]) for _ in range(60000))
    text += " " + " ".join("new york city" for _ in range(300))
    shard = co.Shard("en", text.encode())
    frequent = np.bincount(shard.ids) >= 10
    words = np.zeros((1 << 20, 2), np.uint8)
    levels = co._levels(np.bincount(shard.ids), 10)
    at = co._slots(shard.word_hashes, 20)
    np.maximum.at(words[:, 0], at[frequent], 255 - levels[frequent])
    np.maximum.at(words[:, 1], at, levels)
    cells = np.full(1 << 16, 60 if full else 0, np.int64)
    for size in (2, 3):
        np.add.at(cells, co._slots(shard.runs(size)[1], 16), 1)
    runs = co.promising(shard, 3, 10, 50, 100_000, words, co._levels(cells, 10))
    found = [p for size, first in enumerate(runs, 2) for p in shard.distinct(first, size)]
    assert {b" new york ", b" york city ", b" new york city "} <= set(found)
    assert len(found) < len(co.passing(shard, 3, np.full(1 << 13, 255, np.uint8), 16)[1]) / 20
    want = Counter(" ".join(r) for r in plain_runs(text, 3))
    assert co.count_matches(shard, found, runs).tolist() == [want[p[1:-1].decode()] for p in found]


@pytest.mark.parametrize("most", [7, 64, 1000])
def test_runs_over_a_cut_are_counted_once_by_the_text_around_them(most):
    rows = _texts(2, 10)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(rows), "text": [t for t, _ in rows]})
    got: Counter = Counter()
    for shard in co.shards(iter([batch]), 3, most):
        runs = [shard.runs(size)[0][size % 2 :: 2] for size in (2, 3)]
        keys = [np.unique(shard.keys(first, size)) for size, first in enumerate(runs, 2)]
        runs = [first[np.isin(shard.keys(first, size), keys[size - 2])] for size, (first, _) in ((k, shard.runs(k)) for k in (2, 3))]
        patterns = [p for size, first in enumerate(runs, 2) for p in shard.distinct(first, size)]
        assert co.count_matches(shard, patterns, runs).tolist() == co.count_matches(shard, patterns).tolist()
        got.update(patterns)
    assert got

"""Deduplication, mixing, tokens, media, language and toxicity against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from chatloom.llm import language_id, line_dedup, media, minhash, mixing, prefix_bpe, toxicity
from chatloom.llm.components import components
from chatloom.llm.content_sort import content_sort
from chatloom.llm.words import shingle_hashes, utf8_buffers, word_counts, word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# exact dedup


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_content_sort(odd_docs, keep):
    best = max if keep == "largest" else min
    rows = odd_docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = content_sort(odd_docs, keep=keep).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for t in groups if sha(t.encode()) == r.text_sha256)
        known = [i for i in groups[text] if i is not None]
        assert (r.group_size, r.keep_id) == (len(groups[text]), best(known) if known else None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter({sha(t.encode()): 1 for t in groups})


def test_content_sort_of_one_large_group_over_many_partitions(shipped):
    shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shipped.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = shipped.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same" * 30)).otherwise(F.concat(F.lit("same" * 30), F.col("id").cast("string"))).alias("text"))
        got = content_sort(df, keep="largest").collect()
    finally:
        shipped.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        shipped.conf.set("spark.sql.shuffle.partitions", "4")
    big = [r for r in got if r.doc_id % 3 == 0]
    assert {(r.keep_id, r.group_size) for r in big} == {(3999, 1334)} and sum(r.kept for r in big) == 1
    assert all(r.kept and r.group_size == 1 for r in got if r.doc_id % 3)


def test_content_sort_empty(no_docs):
    assert content_sort(no_docs).count() == 0


# words


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["Ab  cd\te", None, "", "ab cd E", "x", " \n", "ab cd e f", "y" * 9_000_000 + " z", "é " * 10]
    data, offsets = utf8_buffers(pa.array(texts))
    words, at = word_hashes(data, offsets)
    want = [WORD.findall((t or "").encode()) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in want] == word_counts(data, offsets).tolist()
    assert words[at[0] : at[1]].tolist() == words[at[3] : at[4]].tolist()
    assert len(set(words.tolist())) == len({w.lower() for ws in want for w in ws})
    shingles, s = shingle_hashes(words, at, 3)
    assert np.diff(s).tolist() == [max(len(w) - 2, 1) if w else 0 for w in want]
    assert shingles[s[0]] == shingles[s[3]] == shingles[s[6]] and shingles[s[4]] != shingles[s[0]]


def test_words_longer_than_a_piece_anywhere_in_a_batch(monkeypatch):
    """Cutting into small pieces changes nothing, and every step moves on."""
    import pyarrow as pa

    from chatloom.llm import words as module

    texts = ["foo " + "y" * 40, "z" * 40, "", "a " * 20, " \t" + "Q" * 33 + "\n", "b", "c" * 17 + " d " + "e" * 16 + " f", None, "é" * 20 + " x"]
    data, offsets = utf8_buffers(pa.array(texts))
    whole, at = word_hashes(data, offsets)
    assert np.diff(at).tolist() == [len(WORD.findall((t or "").encode())) for t in texts]

    def long_word(word, symbol, hashed=module._long_word):
        assert len(word), "an empty word: no progress"
        return hashed(word, symbol)

    monkeypatch.setattr(module, "_long_word", long_word)
    for size in (1, 2, 3, 16, 17, 64):
        monkeypatch.setattr(module, "PIECE_BYTES", size)
        words, offset = word_hashes(data, offsets)
        assert words.tolist() == whole.tolist() and offset.tolist() == at.tolist()


# near-duplicates


def shingle_set(text: str | None, k: int) -> frozenset:
    words = WORD.findall((text or "").encode().lower()) if (text or "").isascii() else [w for w in WORD.findall((text or "").encode())]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)])


def brute_components(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, int]:
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {i: shingle_set(t, k) for i, t in rows}
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {i: top(i) for i in up}


def family(seed: int, n: int, edits: int) -> list[str]:
    """Texts derived from each other by random word edits: a chain and a star of near copies."""
    rnd = random.Random(seed)
    base = [f"v{rnd.randrange(400)}" for _ in range(120)]
    out, words = [" ".join(base)], list(base)
    for i in range(n):
        source = list(words if i % 2 else base)
        for _ in range(rnd.randrange(edits + 1)):
            source[rnd.randrange(len(source))] = f"n{rnd.randrange(10**6)}"
        words = source
        out.append(" ".join(source))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(shipped, k, percent):
    texts = family(1, 40, 4) + family(2, 25, 2) + family(3, 30, 9) + ["a b", "A  b", "a", "", None, "lone text of some words here"]
    random.Random(5).shuffle(texts)
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(shipped.createDataFrame(rows, "doc_id long, text string"), words=k, percent=percent).collect()
    want = brute_components(rows, k, percent)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingle_set(texts[r.doc_id], k)) for r in got)


def test_near_duplicates_in_small_blocks(shipped, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = list(enumerate(family(7, 60, 9)))
    got = minhash.near_duplicates(shipped.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, 3, 85)


def boilerplate(n: int) -> list[str]:
    """Texts that share most of their words and come nowhere near the threshold."""
    core = " ".join(f"c{i}" for i in range(60))
    return [core + " " + " ".join(f"u{i}x{j}" for j in range(20)) for i in range(n)]


def test_open_buckets_of_boilerplate_bring_nobody_together(shipped, monkeypatch):
    seen = []
    blocks = minhash._blocks
    monkeypatch.setattr(minhash, "_blocks", lambda groups: seen.append(groups.count()) or blocks(groups))
    texts = boilerplate(10000)
    texts[9000] = texts[3].replace("u3x5", "other")
    got = minhash.near_duplicates(shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 3 if i == 9000 else i for i in range(10000)}
    assert seen[0] <= 200  # rows to compare in blocks; the buckets themselves hold thousands


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_made_of_frequent_lines(shipped, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(17)
    lines = [" ".join(f"w{i}q{j}" for j in range(8)) for i in range(24)]
    picks = [sorted(rnd.sample(range(24), 14)) for _ in range(160)]
    picks += [rnd.choice(picks)[:-1] for _ in range(60)]  # linked with what they were cut from
    texts = [" ".join(lines[k] for k in p) for p in picks]
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(shipped.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    want = brute_components(rows, 3, 85)
    assert len(set(want.values())) < len(set(texts))
    assert {r.doc_id: r.component_id for r in got} == want


def test_texts_under_one_identifier_are_linked(shipped):
    """Copies of both texts reach each other over the identifier that they share, whatever the order of rows."""
    a, b, c = (family(seed, 1, 1)[0] for seed in (21, 22, 23))
    rows = [(5, a), (5, b), (5, a), (7, a.replace(" v", " V", 3) + " end"), (9, b + " end"), (3, c), (11, c), (11, b + " end end"), (20, None), (20, "alone but for a null")]
    runs = []
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(shipped.createDataFrame(order, "doc_id long, text string").repartition(3), words=3, percent=85).collect()
        runs.append(sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got))
    assert runs[0] == runs[1]
    assert {i: c for i, _, c, _ in runs[0]} == {5: 3, 7: 3, 9: 3, 3: 3, 11: 3, 20: 20}
    assert {i for i, _, _, kept in runs[0] if kept} == {3, 20}


def test_repeated_identifiers_equal_brute_force(shipped):
    rnd = random.Random(77)
    base = [[f"b{k}w{rnd.randrange(200)}" for _ in range(60)] for k in range(6)]
    rows = []
    for i in range(80):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(60)] = f"n{i}"
        rows.append((rnd.randrange(60), " ".join(words)))
    numbered = list(enumerate(t for _, t in rows))
    root = brute_components(numbered, 3, 85)
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for group in {r: [rows[k][0] for k in root if root[k] == r] for r in root.values()}.values():
        for other in group:
            up[max(top(group[0]), top(other))] = min(top(group[0]), top(other))
    got = minhash.near_duplicates(shipped.createDataFrame(rows, "doc_id long, text string").repartition(4), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i, _ in rows}


def test_rows_without_an_identifier_are_linked_and_pass_links_on(shipped):
    """The middle text links two identified ones that are too far apart; a pair without identifiers has no component."""
    words = [f"v{i}" for i in range(100)]
    chain = [" ".join(words[i * 6 :] + [f"n{j}" for j in range(i * 6)]) for i in range(3)]
    alone = [" ".join(f"q{i}" for i in range(40)), " ".join(f"q{i}" for i in range(41))]
    texts = {7: chain[0], 4: chain[2], 9: "some lone text of a few words"}
    nameless = [chain[1], chain[1].upper(), chain[1], *alone]
    numbered = [*texts.items(), *((100 + i, t) for i, t in enumerate(nameless))]
    want = brute_components(numbered, 3, 85)
    assert want[7] == want[4] == want[100] == 4
    assert brute_components(list(texts.items()), 3, 85) == {7: 7, 4: 4, 9: 9}
    docs = shipped.createDataFrame([*texts.items(), *((None, t) for t in nameless)], "doc_id long, text string").withColumn("a.key", F.lit(1)).repartition(3)
    got = minhash.near_duplicates(docs, words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {7: 4, 4: 4, 9: 9}
    assert sorted((str(r.component_id), r.kept) for r in got if r.doc_id is None) == [("4", False)] * 3 + [("None", True)] * 2
    stay = minhash.without_near_duplicates(docs, words=3, percent=85)
    assert stay.columns == docs.columns
    assert sorted(r.text for r in stay.collect()) == sorted([texts[4], texts[9], *alone])


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[1] == {(1, True)} and by[5] == {(1, False)} and by[2] == {(2, True)} and (1, False) in by[None] and (None, True) in by[None]
    assert minhash.near_duplicates(no_docs).count() == 0


def test_estimate_is_near_the_similarity(shipped):
    texts = family(11, 12, 6)
    sets = [np.unique(np.frombuffer(b"".join(hashlib.blake2b(repr(s).encode(), digest_size=8).digest() for s in shingle_set(t, 3)), np.uint64)) for t in texts]
    least = minhash._minima(sets)
    for i, j in itertools.combinations(range(len(sets)), 2):
        true = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
        assert abs((least[i] == least[j]).mean() - true) < 0.2


def test_components_of_long_paths_and_stars(shipped):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(201, 200), (200, 201), (7, 7)]
    got = {r.node: r.root for r in components(shipped.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


# line dedup


def brute_line_dedup(spark, docs: list[tuple[int, str]], gram: int, window: int) -> dict[int, str]:
    """Winnowing in plain loops, extended by every earlier place to the first unequal line; only the hashes of lines and grams come from Spark."""
    units = {i: [(p, line.strip(" \t\r\x0b\x0c")) for p, line in enumerate(text.split("\n")) if line.strip(" \t\r\x0b\x0c")] for i, text in docs}
    lines = sorted({u for us in units.values() for _, u in us})
    h = {r.l: r.h for r in spark.createDataFrame([(x,) for x in lines], "l string").select("l", F.xxhash64("l").alias("h")).collect()}
    grams, starts = {}, {}
    for i, us in units.items():
        starts[i] = at = list(itertools.accumulate([0] + [len(u.split()) for _, u in us]))
        for q in range(len(us)):
            end = next((e for e in range(q, len(us) + 1) if at[e] - at[q] >= gram), None)
            grams[i, q] = None if end is None else tuple(h[u] for _, u in us[q:end])
    lists = sorted({g for g in grams.values() if g})
    gh = {tuple(r.g): r.x for r in spark.createDataFrame([(list(g),) for g in lists], "g array<long>").select("g", F.xxhash64("g").alias("x")).collect()}
    prints = set()
    for i, us in units.items():
        for p in range(len(us)):
            inside = [q for q in range(p, len(us)) if starts[i][q] - starts[i][p] <= window - gram and grams[i, q]]
            if inside:
                prints.add((i, min(inside, key=lambda q: (gh[grams[i, q]], q))))
    cut = brute_extension(units, [(i, units[i][q][0], grams[i, q]) for i, q in prints])
    return {i: "\n".join(x for p, x in enumerate(text.split("\n")) if p not in cut[i]) for i, text in docs}


def test_line_dedup_equals_brute_force(shipped):
    rnd = random.Random(21)
    pool = [" ".join(f"p{i}x{j}" for j in range(rnd.choice((1, 2, 7, 15, 26, 60)))) for i in range(40)] + ["", "  "]
    docs = []
    for i in range(80):
        lines = []
        for _ in range(rnd.randrange(1, 5)):
            s = rnd.randrange(42)
            lines += [pool[(s + j) % 42] for j in range(rnd.randrange(1, 9))]
        docs.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(shipped.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_line_dedup(shipped, docs, 25, 50)


def brute_extension(units: dict[int, list[tuple[int, str]]], prints: list[tuple[int, int, int]]) -> dict[int, set[int]]:
    """Lines of every equal run around a shared fingerprint (doc, line, gram), with each earlier place and to the first unequal line."""
    at = {i: {p: q for q, (p, _) in enumerate(us)} for i, us in units.items()}
    places, cut = defaultdict(list), {i: set() for i in units}
    for i, p, gram in sorted(prints):
        places[gram].append((i, at[i][p]))
    for (i0, q0), (i, q) in itertools.chain.from_iterable(itertools.combinations(same, 2) for same in places.values()):

        def equal(k: int, i0: int = i0, q0: int = q0, i: int = i, q: int = q) -> bool:
            return 0 <= q0 + k < len(units[i0]) and 0 <= q + k < len(units[i]) and units[i0][q0 + k][1] == units[i][q + k][1]

        a, b = 0, 0
        while equal(a - 1):
            a -= 1
        while equal(b + 1):
            b += 1
        cut[i].update(range(units[i][q + a][0], units[i][q + b][0] + 1))
    return cut


@pytest.mark.parametrize(("seed", "widths"), [(4, (1, 2, 7, 15, 26, 60)), (5, (2, 10, 22, 93, 140)), (6, (1, 3, 24, 25, 49, 50, 76)), (7, (1, 2, 3))])
def test_line_dedup_extends_to_the_first_unequal_line(shipped, seed, widths):
    """Brute force without any limit of reach, with lines longer than a gram and a window together."""
    rnd = random.Random(seed)
    pool = [" ".join(f"p{i}x{j}" for j in range(rnd.choice(widths))) for i in range(40)] + ["", "  "]
    docs = []
    for i in range(70):
        lines = []
        for _ in range(rnd.randrange(1, 5)):
            s = rnd.randrange(42)
            lines += [pool[(s + j) % 42] for j in range(rnd.randrange(1, 25 if widths[-1] == 3 else 9))]
        docs.append((i, "\n".join(lines)))
    df = shipped.createDataFrame(docs, "doc_id long, text string")
    units = df.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), line_dedup._units(F.col("text")).alias("units")).filter(F.size("units") > 0)
    prints = [(r.d, r.pos, r.gram) for r in line_dedup.fingerprints(units, 25, 50).select("d", "pos", "gram").collect()]
    cut = brute_extension({i: [(p, x.strip()) for p, x in enumerate(text.split("\n")) if x.strip()] for i, text in docs}, prints)
    want = {i: "\n".join(x for p, x in enumerate(text.split("\n")) if p not in cut[i]) for i, text in docs}
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()} == want


def test_line_dedup_cuts_the_tail_after_a_long_line(shipped):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate((10, 22, 93, 2)))
    got = {r.doc_id: r for r in line_dedup.line_dedup(shipped.createDataFrame([(4, text), (446, text)], "doc_id long, text string")).collect()}
    assert (got[4].text, got[4].removed_lines) == (text, 0) and (got[446].text, got[446].removed_lines) == ("", 4)


def test_line_dedup_cuts_the_tail_after_a_long_line_of_the_gram(shipped):
    """Nothing after the long line has a fingerprint, and both documents go on differently."""
    run = "\n".join(" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate((80, 9, 9, 9)))
    docs = [(1, f"{run}\nend one"), (2, f"{run}\nend two")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(shipped.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "end two"}


def test_line_dedup_compares_with_every_earlier_place(shipped):
    """A licence's first place goes on differently; a later place, and one after it, share more with the last."""
    line = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    licence, before = line("licence", 30), [line("b", 6), line("c", 5)]
    tail = [line("x", 8), line("y", 7), line("z", 7)]
    docs = {1: [licence, "one"], 2: [licence, *tail, "two"], 3: [licence, *tail, "three"], 4: [licence, tail[0], "four"], 5: [*before, licence, "five"], 6: ["six", *before, licence, *tail[:2], "6"]}
    df = shipped.createDataFrame([(i, "\n".join(lines)) for i, lines in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.line_dedup(df).collect()}
    assert got == {1: docs[1], 2: [*tail, "two"], 3: ["three"], 4: ["four"], 5: [*before, "five"], 6: ["six", "6"]}


def test_line_dedup_cuts_later_passages(shipped):
    rnd = random.Random(2)
    fresh = lambda n: " ".join(f"u{rnd.randrange(10**9)}" for _ in range(n))
    passage = [fresh(n) for n in (9, 20, 3, 30)]
    one_line = fresh(60)
    short = [fresh(4), fresh(5)]
    docs = [
        (0, [fresh(12), *passage, fresh(30)]),
        (1, [fresh(8), *passage, *short]),
        (2, [*short, fresh(40), one_line]),
        (3, [fresh(3), one_line, fresh(3), one_line]),
        (4, passage + passage),
    ]
    df = shipped.createDataFrame([(i, "\n".join(lines)) for i, lines in docs], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert got[0].removed_lines == 0 and got[0].text == "\n".join(docs[0][1])
    assert got[1].text.split("\n") == [docs[1][1][0], *short] and got[1].removed_lines == 4
    assert got[2].removed_lines == 0
    assert got[3].text.split("\n") == [docs[3][1][0], docs[3][1][2]]
    assert got[4].text == "" and got[4].removed_lines == 8


def test_line_dedup_never_loses_a_line_and_finds_every_long_run(shipped):
    """Every line that was there still is, and of every repeated run of 50 words something is cut."""
    rnd = random.Random(9)
    pool = [" ".join(f"p{i}x{j}" for j in range(rnd.choice((2, 7, 15, 40)))) for i in range(60)]
    docs = [(i, [pool[(s + j) % 60] for s in [rnd.randrange(60)] for j in range(rnd.randrange(1, 12))]) for i in range(60)]
    df = shipped.createDataFrame([(i, "\n".join(lines)) for i, lines in docs], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    left = {line for r in got.values() for line in r.text.split("\n")}
    assert {line for _, lines in docs for line in lines} <= left
    seen: set[tuple] = set()
    for i, lines in docs:
        words = [len(x.split()) for x in lines]
        runs = [tuple(lines[a:b]) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if sum(words[a:b]) >= 50]
        if any(r in seen for r in runs):
            assert got[i].removed_lines > 0
        seen.update(runs)


def test_line_dedup_of_odd_rows(odd_docs, no_docs):
    got = line_dedup.line_dedup(odd_docs).collect()
    assert sorted((r.text or "?") for r in got) == sorted((r.text or "?") for r in odd_docs.collect())
    assert line_dedup.line_dedup(no_docs).count() == 0
    assert line_dedup.line_dedup(odd_docs).columns == [*odd_docs.columns, "n_lines", "removed_lines"]


def test_line_dedup_with_clashing_names(shipped):
    passage = "\n".join(" ".join(f"c{i}x{j}" for j in range(20)) for i in range(4))
    df = shipped.createDataFrame([(i, passage) for i in range(2)], "doc_id long, text string")
    names = ("n_lines", "removed_lines", "Removed_Lines_", "cuts", "lines", "row", "d", "t", "_ld_cuts", "a.b", "x`y")
    df = df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    out = line_dedup.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines_", "removed_lines__"]
    got = {r[0]: r for r in out.collect()}
    assert got[1][1] == "" and got[0][1] == passage and list(got[1])[2:] == [*range(len(names)), 4, 4] and list(got[0])[2:] == [*range(len(names)), 4, 0]


def test_line_dedup_is_native(odd_docs):
    plan = line_dedup.line_dedup(odd_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# mixing


def brute_targets(sizes: dict, ceiling: int = 3) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        level = (total - sum(ceiling * sizes[s] for s in full)) / free if free else 0
        over = {s for s in names if s not in full and level * weight[s] > ceiling * sizes[s]}
        if not over:
            return {s: ceiling * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def mix_docs(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rnd.choice((0, 1, 40, 300, 2000)))), rnd.choice(("a", "b", "c", "ä", None, "tiny" if i < 30 else "a"))) for i in range(600)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing(shipped):
    rows, df = mix_docs(shipped)
    got = {r.doc_id: r for r in mixing.taken_words(mixing.mix_sources(df)).collect()}
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    targets = brute_targets(sizes)
    taken = Counter()
    for i, text, source in rows:
        r = got[i]
        assert r.size == len(text.split()) and r.source_size == sizes[source] and abs(r.target - targets[source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 2 * mixing.BLOCK_WORDS + 0.01 * targets[s], s
    again = {r.doc_id: r.taken for r in mixing.taken_words(mixing.mix_sources(df.repartition(7))).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def brute_taken(placed: list, draw_seed: int, seed: int) -> dict[int, int]:
    """Draws, numbering, settlement and permutations slot by slot; ``placed`` has the documents' places in their sources."""
    sizes = {r.source_no: r.source_size for r in placed}
    order = sorted(sizes)
    target = {r.source_no: r.target for r in placed}
    blocks = {s: -(-sizes[s] // mixing.BLOCK_WORDS) for s in order}
    wanted = {s: min(round(target[s] * blocks[s] / max(1, sizes[s])), 3 * blocks[s]) for s in order}
    every = sum(wanted.values())
    mix, number = [], Counter()
    for shard in range(-(-every // mixing.SHARD_SLOTS)):
        draw = np.random.Generator(np.random.Philox(key=[draw_seed, shard]))
        counts = draw.multinomial(min(mixing.SHARD_SLOTS, every - shard * mixing.SHARD_SLOTS), np.array([wanted[s] for s in order]) / every)
        for s, n in zip(order, counts.tolist(), strict=True):
            for _ in range(n):
                mix.append((s, number[s]))
                number[s] += 1
    keep = dict(zip(order, mixing.settled(np.array([number[s] for s in order]), np.array([wanted[s] for s in order]), np.array([3 * blocks[s] for s in order])).tolist(), strict=True))
    assert sum(keep.values()) == every == len(mix)
    for s in order:
        assert abs(keep[s] - wanted[s]) <= mixing.TOLERANCE * wanted[s] and keep[s] <= 3 * blocks[s]
    freed = sorted((s, t) for s, t in mix if t >= keep[s])
    open_slots = [(s, t) for s in order for t in range(number[s], keep[s])]
    assert len(freed) == len(open_slots)
    slots = [x for x in mix if x[1] < keep[x[0]]] + open_slots
    times = Counter()
    for s, t in slots:
        n = blocks[s]
        key = mixing.mix64(mixing.mix64(np.array([s + seed], np.uint64)) + np.uint64(t // n))
        times[s, int(mixing.permuted(np.array([t % n]), np.array([n]), key)[0])] += 1
    assert max(times.values()) <= 3
    out = {}
    for r in placed:
        out[r.doc_id] = sum(times[r.source_no, w // mixing.BLOCK_WORDS] for w in range(r.start, r.start + r.size))
    return out


def test_mixing_equals_brute_force_and_follows_the_draw(shipped, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    rnd = random.Random(14)
    rows = [(i, " ".join("w" for _ in range(rnd.choice((0, 1, 40, 900, 4000)))), rnd.choice(("a", "b", "b", "c", None)) if i > 3 else "tiny") for i in range(700)]
    df = shipped.createDataFrame(rows, "doc_id long, text string, source string")
    found = []
    for draw_seed in (1, 2):
        mix = mixing.mix_sources(df, shard_slots=64, draw_seed=draw_seed)
        got = {r.doc_id: r.taken for r in mixing.taken_words(mix).collect()}
        assert got == brute_taken(mix.placed.collect(), draw_seed, mixing.SEED)
        layout = mixing.shard_layout(mix).withColumn("n", F.col("end_word") - F.col("first_word"))
        assert {r.doc_id: r.n for r in layout.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()} == {i: n for i, n in got.items() if n}
        assert all(n <= 64 for n in (r["count"] for r in mix.slots.groupBy("shard").count().collect()))
        found.append(got)
    assert found[0] != found[1]


def test_settling_keeps_the_sum_and_the_bounds():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        wanted = rnd.integers(0, 5000, 6)
        most = wanted + rnd.integers(0, 50, 6)
        drawn = rnd.multinomial(wanted.sum(), wanted / wanted.sum())
        kept = mixing.settled(drawn, wanted, most)
        assert kept.sum() == wanted.sum() and (kept <= most).all() and (np.abs(kept - wanted) <= np.floor(mixing.TOLERANCE * wanted)).all()


def test_mixed_documents_with_clashing_names(shipped):
    _, df = mix_docs(shipped)
    names = ("row", "spans", "_tie", "_spans", "id", "tie", "nth", "places", "d", "t", "a.b", "x`y")
    wide = df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    out = mixing.mixed_documents(wide)
    assert out.columns == wide.columns
    rows = out.collect()
    assert all(list(r)[3:] == list(range(len(names))) for r in rows)
    assert sorted((r[0], r[1]) for r in rows) == sorted((r.doc_id, r.text) for r in mixing.mixed_documents(df).collect())


def test_mixed_documents_hold_the_words_taken(shipped):
    _, df = mix_docs(shipped)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(mixing.mix_sources(df)).collect() if r.taken}
    out = mixing.mixed_documents(df)
    assert out.schema.names == df.schema.names
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == taken


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 64, 1000):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(out.tolist()) == list(range(n))


def test_mixing_of_odd_rows(odd_docs, no_docs):
    got = mixing.taken_words(mixing.mix_sources(odd_docs)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.taken_words(mixing.mix_sources(no_docs)).count() == 0
    assert mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mixed_documents(odd_docs).count() > 0


# tokens


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        return prefix_bpe.PrefixCoder(f.read())


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.rank, special_tokens={})


def test_tokens_equal_the_library(odd_docs, no_docs, reference):
    texts = odd_docs.select("doc_id", "text").collect()
    got = prefix_bpe.encode_and_decode(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for r in texts:
        ids = reference.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()), ids))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got) == sorted((w[0] or -1, *w[1:]) for w in want)
    assert prefix_bpe.encode_and_decode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_random_pieces_appends_and_edits(coder, reference):
    rnd = random.Random(8)
    for _ in range(400):
        piece = bytes(rnd.choice(b"aabcde thn\xc3\xa9\xff0") for _ in range(rnd.randrange(1, 24)))
        want = reference._core_bpe.encode_single_piece(piece)
        assert coder.encode(piece) == want
        last = coder.extend(piece, [])
        cut = rnd.randrange(len(piece))
        grown, grown_last = coder.append(piece[:cut], last[:cut], piece[cut:])
        assert grown == piece and grown_last == last
        edited, edited_last = coder.edit(piece, last, cut, b"the")
        assert edited_last == coder.extend(edited, [])
        assert b"".join(coder.token[t] for t in coder.walk_back(edited_last)) == edited


# media


@pytest.mark.parametrize("form", media.FORMATS)
def test_media_round_trip(odd_docs, no_docs, form):
    texts = {}
    stored = media.media_column(odd_docs, form=form)
    assert {bytes(r.media[:2]) for r in stored.collect()} == {{"pgm": b"P5", "ppm": b"P6", "bmp": b"BM"}[form]}
    got = media.media_features(stored).collect()
    assert len(got) == odd_docs.count()
    for r, row in zip(sorted(got, key=lambda r: (r.doc_id or -1, r.n_bytes)), sorted(odd_docs.collect(), key=lambda r: (r.doc_id or -1, len((r.text or "").encode()))), strict=True):
        raw = (row.text or "").encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), sha(padded), zlib.crc32(padded[-32:]))
        assert texts.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.media_features(media.media_column(no_docs)).count() == 0


def test_decoders_agree():
    rnd = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (24, 7), (8, 8)):
        rgb = rnd.integers(0, 256, (h, w, 3), dtype=np.uint8)
        grey = rgb[:, :, 0]
        assert (media.decode(media.encode_ppm(rgb)) == rgb).all() and (media.decode(media.encode_bmp(rgb)) == rgb).all() and (media.decode(media.encode_pgm(grey)) == grey).all()
        assert (media.decode(b"P3 # c\n%d %d\n255\n" % (w, h) + b" ".join(b"%d" % v for v in rgb.reshape(-1))) == rgb).all()
        assert (media.decode(b"P2\n%d %d 255\n" % (w, h) + b"\n".join(b"%d" % v for v in grey.reshape(-1))) == grey).all()
        bits = grey > 127
        assert (media.decode(b"P4\n%d %d\n" % (w, h) + np.packbits(~bits, axis=1).tobytes()) == np.where(bits, 255, 0)).all()
        assert (media.decode(b"P1\n%d %d\n" % (w, h) + b"".join(b"0" if v else b"1" for v in bits.reshape(-1))) == np.where(bits, 255, 0)).all()


def test_null_and_broken_media(shipped):
    rgb = np.random.default_rng(2).integers(0, 256, (4, 4, 3), dtype=np.uint8)
    bmp = media.encode_bmp(rgb)
    eight = bytearray(b"BM" + bytes(8) + (54 + 8).to_bytes(4, "little") + bmp[14:54] + bytes(8) + b"\x00\x01\x05\x00" * 4)
    eight[28:30] = (8).to_bytes(2, "little")  # a palette of two colours, and a sample of 5
    broken = [b"", b"P5", b"P5\n4 4\n", b"P5\n4 4\n255\nxy", b"P5\n0 4\n255\n", b"P5\n4 4\n0\n" + bytes(16), b"P2\n2 2\n255\n1 x 3 4", b"P6\n# no end", b"PNG", b"BM", bmp[:60], bytes(eight), b"P1\n2 2\n1"]
    rows = [(i, 3, bytearray(m)) for i, m in enumerate(broken)] + [(100, None, None), (101, 3, bytearray(bmp))]
    got = {r.doc_id: r for r in media.media_features(shipped.createDataFrame(rows, "doc_id long, n_bytes long, media binary").withColumn("feature", F.lit(1))).collect()}
    assert all(got[100][c] is None for c in got[100].__fields__[1:]) and got[101].feature is not None
    for i, m in enumerate(broken):
        assert (got[i].media_bytes, got[i].media_sha256, got[i].payload_sha256, got[i].feature, got[i].tile_npy) == (len(m), sha(m), None, None, None)


def test_no_header_or_sample_raises():
    huge = [b"P5\n99999999999 99999999999\n255\n", b"P4\n99999999999999999999 9\n", b"P2\n1 1\n255\n99999999999999999999999", b"P2\n1 1\n255\n-5", b"P2\n1 1\n255\n256", b"P5\n2 1\n9\n\x09\x0a"]
    for m in huge:
        assert media.features(m)[0] is None and media.features(m)[4] == sha(m)
    assert media.decode(b"P2\n2 1\n9\n0 9").tolist() == [[0, 255]]
    rnd = random.Random(4)
    bmp = media.encode_bmp(np.zeros((3, 3, 3), np.uint8))
    for _ in range(3000):
        head = b"P%d" % rnd.randrange(8) + b"".join(rnd.choice([b" ", b"\n", b"#c\n", b""]) + b"%d" % rnd.choice([0, 1, 2, 3, 255, 65535, 65536, rnd.randrange(10**30)]) for _ in range(rnd.randrange(5))) + b"\n"
        m = rnd.choice([head + rnd.randbytes(rnd.randrange(40)), head + b" ".join(b"%d" % rnd.randrange(-3, 10**rnd.randrange(1, 25)) for _ in range(9)), bytes(rnd.choice([b, rnd.randrange(256)]) if rnd.random() < 0.1 else b for b in bmp)])
        assert media.features(m)[3] == len(m)


def test_bmp_with_masks():
    rgb = np.random.default_rng(5).integers(0, 256, (3, 5, 3), dtype=np.uint8)
    packed = np.zeros((3, 5), "<u4")
    for k, shift in enumerate((4, 12, 20)):
        packed |= rgb[:, :, k].astype("<u4") << shift
    header = bytearray(media.encode_bmp(rgb)[:54])
    header[10:14], header[28:30], header[30:34] = (66).to_bytes(4, "little"), (32).to_bytes(2, "little"), (3).to_bytes(4, "little")
    masks = b"".join((0xFF << s).to_bytes(4, "little") for s in (4, 12, 20))
    assert (media.decode(bytes(header) + masks + packed[::-1].tobytes()) == rgb).all()


@pytest.mark.parametrize("strip", [1, 24, 100, 1 << 18])
def test_difference_hash_equals_brute_force(monkeypatch, strip):
    monkeypatch.setattr(media, "STRIP_SAMPLES", strip)
    rnd = np.random.default_rng(8)
    for shape in ((1, 1), (24, 24), (5, 3), (72, 24), (17, 9, 3), (40, 24, 3)):
        image = rnd.integers(0, 256, shape, dtype=np.uint8)
        light = image if image.ndim == 2 else image @ np.array([299, 587, 114]) / 1000
        h, w = light.shape
        fine = np.kron(light.astype(float), np.ones((8, 9)))  # every sample as 8 x 9 cells
        mean = np.round(fine.reshape(8, h, 9, w).mean((1, 3)), 6)
        bits = [mean[i, j + 1] > mean[i, j] for i in range(8) for j in range(8)]
        assert media.difference_hash(image) == "".join(f"{int(''.join('01'[int(b)] for b in bits[k : k + 8]), 2):02x}" for k in range(0, 64, 8))


def test_area_resize_is_the_exact_mean():
    rnd = np.random.default_rng(1)
    image = rnd.integers(0, 256, (13, 10)).astype(float)
    fine = np.kron(image, np.ones((4, 5)))  # 52 x 50: a whole number of cells for 4 x 5
    want = fine.reshape(4, 13, 5, 10).mean((1, 3))
    assert np.allclose(media.area_resize(image, 4, 5), want)
    tile = np.lib.format.read_array(__import__("io").BytesIO(media.npy_tile(image)))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8


# language


def test_language(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = language_id.identify(docs, held_out).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 250 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def brute_buckets(text: str) -> list[int]:
    framed, out = f" {language_id.lowered(text)} ", []
    for order in language_id.ORDERS:
        for i in range(len(framed) - order + 1):
            value = order
            for c in framed[i : i + order]:
                value = (value * 1000003 + ord(c)) & (1 << 64) - 1
            out.append(int(language_id.mix64(np.array([value], np.uint64))[0]) >> 49)
    return out


@pytest.mark.parametrize("piece", [1, 7, 1 << 17])
def test_language_equals_brute_force(shipped, monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE_BYTES", piece)
    texts = ["Der Hund ist müde", "die Katze schläft ΣΑΣ", "the dog sleeps", "a cat İs tired", "the 😀 end", None, "", "1 2", "ΟΔΟΣ", "Hunde", "x"]
    rows = [(i, t, ("de", "de", "en", "en", "en", "de", "fr", None, "el", None, None)[i]) for i, t in enumerate(texts)]
    import pyarrow as pa

    buckets = Counter()
    for pieces in language_id.text_pieces(pa.array(texts), piece):
        found, at = language_id.ngram_buckets(pieces)
        for p, a, b in zip(pieces, at.tolist(), [*at.tolist()[1:], len(found)], strict=True):
            buckets.update((p.row, x) for x in found[a:b].tolist())
    assert buckets == Counter((i, x) for i, t in enumerate(texts) for x in brute_buckets(t or ""))

    got = {r.doc_id: r for r in language_id.identify(shipped.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") == 0).collect()}
    train = [(t, lang) for i, t, lang in rows if i and lang and t is not None]
    names = sorted({lang for _, lang in train})
    n = {lang: Counter(x for t, own in train if own == lang for x in brute_buckets(t)) for lang in names}
    for i, t, _ in rows:
        logs = []
        for lang in names:
            total = sum(n[lang].values()) + language_id.SMOOTHING * language_id.BUCKETS
            prior = np.log(sum(own == lang for _, own in train) / len(train))
            logs.append(prior + sum(float(np.float32(np.log((n[lang][x] + language_id.SMOOTHING) / total))) for x in brute_buckets(t or "")))
        p = np.exp(np.array(logs) - max(logs)) / np.exp(np.array(logs) - max(logs)).sum()
        want = (names[int(p.argmax())], p.max()) if t and any(c.isalpha() for c in t) else ("und", 0.0)
        assert got[i].lang_pred == want[0] and abs(got[i].score - want[1]) < 1e-9 and got[i].held_out == (i == 0)


def test_rows_without_identifier_are_not_learned_from(shipped):
    df = shipped.createDataFrame([(1, "hund", "de"), (None, "dog", "en")], "doc_id long, text string, lang string")
    got = language_id.identify(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()
    assert "en" not in {r.lang_pred for r in got} and all(r.held_out is not None for r in got)


def test_language_of_odd_rows(odd_docs, no_docs):
    got = language_id.identify(odd_docs, F.lit(False)).collect()
    assert {r.lang_pred for r in got} == {"en", "und"} and all(r.lang_pred == "und" for r in got if r.doc_id in (2, 3, 4))
    assert {r.lang_pred for r in language_id.identify(odd_docs, F.lit(True)).collect()} == {"und"}
    assert language_id.identify(no_docs, F.lit(False)).count() == 0


def test_too_many_languages_are_refused(shipped, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    docs = shipped.createDataFrame([(i, "some text", f"l{i % 3}") for i in range(9)], "doc_id long, text string, lang string")
    assert language_id.identify(docs, F.lit(False)).count() == 9
    with pytest.raises(ValueError, match="languages"):
        language_id.identify(docs.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string"))), F.lit(False))


# toxicity


def toxic_docs(spark, n=400):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(20, 200))]
        bad, junk = i % 4 == 0, i % 5 == 0
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(("rotter", "rotting", "Rotten,")))
        if junk:
            words += ["###spam"] * 3
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(junk), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int")


def test_toxicity_finds_unseen_documents(shipped):
    docs, labels = toxic_docs(shipped)
    got = toxicity.toxicity(docs, labels).collect()
    unseen = [r for r in got if r.doc_id % 2 and r.doc_id % 3]
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in got)
    assert unseen and sum((r.p_low_quality > 0.5) == (r.doc_id % 5 == 0) for r in unseen) >= 0.95 * len(unseen)
    left = toxicity.clean_documents(docs, labels)
    assert left.schema == docs.schema and sorted(r.doc_id for r in left.collect()) == [i for i in range(400) if i % 4]


def brute_subwords(text: bytes) -> set[bytes]:
    out = set()
    for word in re.findall(rb"[A-Za-z0-9\x80-\xff]+", text):
        framed = b" " + word.lower() + b" "
        out |= {framed[i : i + n] for n in toxicity.SIZES for i in range(len(framed) - n + 1)}
    return out


@pytest.mark.parametrize("part", [1, 5, 16, 1 << 17])
def test_subwords_and_scores_do_not_depend_on_parts(monkeypatch, part):
    """Cuts of long texts are no word boundaries; scoring equals plain sums over the distinct subwords."""
    monkeypatch.setattr(toxicity, "PART_BYTES", part)
    rnd = random.Random(12)
    texts = [" ".join("".join(rnd.choice("abcDE9é-") for _ in range(rnd.randrange(1, 30))) for _ in range(rnd.randrange(0, 6))).encode() for _ in range(40)] + [b"", b"x", b"longword" * 9]
    row, bucket = toxicity.subword_buckets(texts)
    names = sorted(set().union(*map(brute_subwords, texts)))
    framed = {}
    for name in names:  # a subword's bucket: of a text that is the subword alone, open where it has no boundary
        hashes, _ = toxicity.subword_hashes([name.strip(b" ")], (len(name),), np.array([name[:1] != b" "]), np.array([name[-1:] != b" "]))
        (framed[name],) = (hashes >> np.uint64(64 - toxicity.BITS)).tolist()
    got = defaultdict(set)
    for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
        got[r].add(b)
    assert all(got[i] == {framed[x] for x in brute_subwords(t)} for i, t in enumerate(texts))
    kept = np.array(sorted(set(framed.values())))[::3]
    chain = [toxicity.Linear(kept, np.linspace(-1, 1, len(kept)), np.zeros(0), 0.1), toxicity.Linear(kept[:5], np.ones(5), np.array([2.0]), -1.0)]
    p = toxicity.chain_probabilities(chain, texts)
    for i in range(len(texts)):
        first = 1 / (1 + np.exp(-(sum(w for b, w in zip(kept, chain[0].weights, strict=True) if b in got[i]) + 0.1)))
        second = 1 / (1 + np.exp(-(sum(b in got[i] for b in kept[:5].tolist()) + 2 * first - 1)))
        assert np.allclose(p[i], [first, second], atol=1e-12)


def test_the_chain_learns_from_out_of_fold_predictions(monkeypatch):
    """The second model's training input is, row by row, what a model that never saw the row's fold predicts."""
    rnd = np.random.default_rng(1)
    rows = [np.unique(rnd.integers(0, 60, 12)) for _ in range(240)]
    first = np.array([int(5 in r or 9 in r) for r in rows])
    labels = np.column_stack([first, first ^ np.array([int(17 in r) for r in rows])])
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda s, r, y, e: seen.append((r, y, e)) or fit(s, r, y, e))
    sample = toxicity.Sample(rows)
    toxicity.fit_chain(sample, labels)
    assert len(seen) == 2 + toxicity.FOLDS
    none = np.zeros((240, 0))
    for f in range(toxicity.FOLDS):
        inside = np.arange(240) % toxicity.FOLDS == f
        model = fit(sample, np.flatnonzero(~inside), labels[:, 0], none)
        want = [1 / (1 + np.exp(-(sum(dict(zip(model.buckets.tolist(), model.weights, strict=True)).get(b, 0.0) for b in rows[i].tolist()) + model.bias))) for i in np.flatnonzero(inside)]
        assert np.allclose(seen[-1][2][inside, 0], want)


def test_a_fit_is_the_penalised_optimum():
    """Against Newton's method on the same scaled features, in plain matrices."""
    rnd = np.random.default_rng(12)
    label = rnd.integers(0, 2, 200)
    rows = [np.flatnonzero(rnd.random(40) < np.where(np.arange(40) < 12, 0.2 + 0.5 * y, 0.4)) for y in label]
    earlier = rnd.random((200, 1))
    model = toxicity.fit(toxicity.Sample(rows), np.arange(200), label, earlier)
    assert len(model.buckets) >= 6
    x = np.array([[b in r for b in model.buckets] for r in map(set, (r.tolist() for r in rows))], float)
    hit, seen, positive = x[label == 1].sum(0), x.sum(0), label.sum()
    chi = [(h - s * positive / 200) ** 2 / (s * positive / 200 * (1 - positive / 200) * (1 - s / 200)) for h, s in zip(hit, seen)]
    assert min(chi) > toxicity.LEAST_CHI * 0.99
    odds = np.log((hit + 0.5) / (positive + 1)) - np.log((seen - hit + 0.5) / (200 - positive + 1))
    a = np.column_stack([x * odds, earlier, np.ones(200)])
    penalty = np.diag([toxicity.PENALTY] * (a.shape[1] - 1) + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - label) + penalty @ w)
    want = 1 / (1 + np.exp(-a @ w))
    got = toxicity._sigmoid(toxicity.Sample(rows).scores(model, earlier))
    assert np.abs(got - want).max() < 0.02


def test_repeats_of_a_labelled_document_change_no_probability(shipped):
    docs, labels = toxic_docs(shipped)
    one = docs.limit(1)
    copies = one.crossJoin(shipped.range(2500)).drop("id")
    want = {r.doc_id: r.p_toxic for r in toxicity.toxicity(docs, labels).collect()}
    got = toxicity.toxicity(docs.unionByName(copies), labels).collect()
    assert len(got) == len(want) + 2500
    assert all(r.p_toxic == want[r.doc_id] for r in got)


def test_other_texts_under_a_labelled_identifier_are_no_further_rows(shipped, monkeypatch):
    docs, labels = toxic_docs(shipped)
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda sample, y: seen.append((len(sample.rows), len(y))) or [])
    toxicity.train(docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more")))), labels, ["low_quality", "toxic"])
    assert seen == [(labels.select("doc_id").distinct().count(),) * 2]


def test_buckets_kept_by_executors_hold_all_that_a_fit_chooses(shipped, monkeypatch):
    docs, labels = toxic_docs(shipped)
    chains = []
    for every in (False, True):
        if every:
            monkeypatch.setattr(toxicity, "_telling_buckets", lambda *_: np.ones(toxicity.BUCKETS, bool))
        chains.append(toxicity.train(docs, labels, ["low_quality", "toxic"]))
    for a, b in zip(*chains, strict=True):
        assert a.buckets.tolist() == b.buckets.tolist() and np.allclose(a.weights, b.weights)


def test_toxicity_of_odd_rows(shipped, odd_docs, no_docs):
    _, labels = toxic_docs(shipped)
    assert toxicity.toxicity(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.toxicity(no_docs, labels).count() == 0
    none = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert all(r.p_toxic == 0 and not r.toxic for r in none)
    one_class = toxicity.toxicity(odd_docs, shipped.createDataFrame([(1, 0, 0), (9, 0, None)], "doc_id long, low_quality int, toxic int")).collect()
    assert not any(r.toxic for r in one_class)


def test_a_very_long_text_is_read_whole(shipped):
    docs, labels = toxic_docs(shipped)
    long_text = "w1 " * 900_000 + "rotter"
    got = toxicity.toxicity(shipped.createDataFrame([(1, long_text), (2, "w1 " * 900_000)], "doc_id long, text string").unionByName(docs), labels).filter("doc_id in (1, 2) AND p_toxic IS NOT NULL").collect()
    assert any(r.toxic for r in got)


def test_a_fit_is_as_large_as_the_buckets_of_its_sample():
    import tracemalloc

    from chatloom.llm import toxicity

    rnd = np.random.default_rng(3)
    few = np.sort(rnd.choice(toxicity.BUCKETS, 500, replace=False))
    label = np.arange(400) % 2
    rows = [np.sort(rnd.choice(few[:300] if y else few[200:], 40, replace=False)) for y in label]
    tracemalloc.start()
    sample = toxicity.Sample(rows)
    model = toxicity.fit(sample, np.arange(400), label, np.zeros((400, 0)))
    scores = sample.scores(model, np.zeros((400, 0)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6
    assert set(model.buckets.tolist()) <= set(few.tolist()) and len(model.buckets) > 100
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    assert np.allclose(scores, [sum(weight.get(b, 0.0) for b in x.tolist()) + model.bias for x in rows]) and ((scores > 0) == (label == 1)).mean() > 0.95

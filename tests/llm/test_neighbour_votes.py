"""Neighbour votes against a row-by-row version, and their held-out accuracy."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatloom.llm import neighbour_votes as nv
from chatloom.llm.words import mix64, utf8_buffers, word_hashes


def plain_counts(text: str | None) -> dict[int, int]:
    """Counts of a text of one piece, term by term."""
    data = (text or "").encode()
    shape = []
    for b in data:
        c = "a" if b >= 128 or chr(b).islower() else "A" if chr(b).isupper() else "0" if chr(b).isdigit() else " " if b == 9 else "\n" if 10 <= b <= 13 else chr(b)
        if shape[-2:] != [c, c]:
            shape.append(c)
    out: dict[int, int] = {}
    first = nv.BUCKETS - nv.WORD_BUCKETS - nv.REPEATS
    for n in nv.SHAPE_SIZES:
        for i in range(len(shape) - n + 1):
            value = n
            for c in shape[i : i + n]:
                value = value * 128 + ord(c)
            bucket = int(mix64(np.array([value], np.uint64))[0]) % first
            out[bucket] = out.get(bucket, 0) + 1
    hashes = []
    for w in data.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" "):
        if w:
            hashes.append(int(word_hashes(*utf8_buffers(pa.array([w])))[0][0]))
    for i, h in enumerate(hashes):
        out[first + h % nv.WORD_BUCKETS] = out.get(first + h % nv.WORD_BUCKETS, 0) + 1
        for back in range(1, nv.REPEATS + 1):
            if i >= back and hashes[i - back] == h:
                out[nv.BUCKETS - back] = out.get(nv.BUCKETS - back, 0) + 1
    return out


TEXTS = ["The cat SAT on the mat!!", None, "", " \n\t", "a a a b a b a b", "é" * 40 + " ☃ | x | y ***", "no 12345 !!!! ,,,, end.\r\n\r\nNew", "x"]


def test_terms_equal_the_plain_version():
    counts = nv.term_counts(pa.array(TEXTS))
    for text, row in zip(TEXTS, counts, strict=True):
        assert {i: int(row[i]) for i in np.flatnonzero(row)} == plain_counts(text)


def test_long_texts_are_read_whole_in_pieces_of_their_own(monkeypatch):
    text = " ".join(f"word{i % 91}" for i in range(4000))
    monkeypatch.setattr(nv, "PIECE_BYTES", 1000)
    alone = nv.term_counts(pa.array([text]))[0]
    assert (nv.term_counts(pa.array(["before", text, "after it"]))[1] == alone).all()
    words = alone[nv.BUCKETS - nv.WORD_BUCKETS - nv.REPEATS : nv.BUCKETS - nv.REPEATS]
    assert words.sum() == 4000
    assert nv.term_counts(pa.array(["y" * 5000]))[0].sum() >= 5


def test_votes_equal_a_row_by_row_count():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.2, (60, nv.BUCKETS))
    labels, stands = rng.integers(0, 2, 60), rng.choice([1.0, 2.5], 60)
    voters = nv.fit_voters(counts, labels, stands, rng.uniform(0.5, 2, nv.BUCKETS), rank=8)
    new = np.vstack([rng.poisson(0.2, (10, nv.BUCKETS)), counts[:2], np.zeros((1, nv.BUCKETS), int)])
    got = voters.scores(new, neighbours=7)
    for row, score in zip(new, got, strict=True):
        weights = [math.sqrt(c) * i for c, i in zip(row, voters.idf)]
        place = np.array(weights) @ voters.directions
        size = float(np.linalg.norm(place))
        cosine = [round(float(v @ place) / size, 9) if size > 0 else 0.0 for v in voters.vectors]
        least = sorted(cosine, reverse=True)[6]
        votes = [(max(c, 0) * s, y) for c, s, y in zip(cosine, stands, labels) if c >= least]
        total = sum(v for v, _ in votes)
        want = sum(v * y for v, y in votes) / total if total else float(labels @ stands / stands.sum())
        assert score == pytest.approx(want, abs=2e-6)


def _corpus(n: int) -> list[tuple[int, str, int]]:
    rng = random.Random(11)
    syllables = ["ta", "ri", "mo", "shen", "ul", "ker"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(30, 80))]
        bad = rng.random() < 0.25
        if bad:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + rng.choice(["***", "%%%"]) for w in words]
        rows.append((i, " ".join(words).capitalize() if not bad else " ".join(words), int(not bad)))
    return rows


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@pytest.fixture(scope="module")
def labelled(shipped):
    rows = _corpus(400)
    docs = shipped.createDataFrame([(i, t, "en", 1) for i, t, _ in rows], "doc_id long, text string, label string, held_out int").repartition(4)
    return docs, shipped.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(labelled):
    docs, labels = labelled
    rows = nv.quality_votes(docs, labels, held_out()).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_change_nothing(labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one = sorted(map(tuple, nv.quality_votes(docs, labels, held_out()).collect()))
    assert one == sorted(map(tuple, nv.quality_votes(docs, turned, held_out()).collect()))


def test_repeated_documents_and_labels_enlarge_no_sample(labelled):
    docs, labels = labelled
    copies = docs.filter("doc_id = 1").crossJoin(docs.sparkSession.range(300)).drop("id")
    voters = nv.train(docs.unionByName(copies).select("doc_id", "text", held_out().alias("held_out")), labels.unionByName(labels).select("doc_id", F.col("quality").alias("label")), 50)
    assert voters.vectors.shape == (100, nv.RANK)
    learned = labels.filter(~held_out()).count()
    assert voters.stands_for.sum() == pytest.approx(learned)


def test_odd_rows(odd_docs, no_docs, shipped):
    labels = shipped.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 1), (6, None), (7, 1)], "doc_id long, quality int")
    rows = nv.quality_votes(odd_docs, labels, held_out()).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["score"] is not None and not r["held_out"] for r in rows if r["doc_id"] is None)
    same = {r["score"] for r in rows if r["doc_id"] in (1, 5)}
    assert len(same) == 1
    assert nv.quality_votes(no_docs, labels, held_out()).count() == 0
    unlabelled = nv.quality_votes(odd_docs, labels.limit(0), held_out()).collect()
    assert {r["score"] for r in unlabelled} == {0.5}

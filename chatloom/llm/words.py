"""Vectorised words and word shingles over the buffers of an Arrow string column.

A word is a maximal run of bytes other than space, TAB, LF, VT, FF and CR; A-Z are lower-cased.  Everything
here works on the UTF-8 bytes of a whole batch at once, so no Python string is made for any document.
Nulls and empty texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18
"""Bytes hashed at a time; bounds the tables that a worker keeps and the scratch arrays for very long texts."""

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, ...]:
    code = np.arange(256, dtype=np.int64)
    lowered = np.where((code >= 65) & (code <= 90), code + 32, code)
    symbol = mix64((lowered + 1).astype(np.uint64))
    space = (code == 0x20) | ((code >= 0x09) & (code <= 0x0D))
    plain = (code >= 128) | ((lowered >= 97) & (lowered <= 122)) | ((code >= 48) & (code <= 57))
    ones = np.full(PIECE_BYTES + 1, 1, np.uint64)
    powers, inverse = ones.copy(), ones.copy()
    powers[1:] = _BASE
    inverse[1:] = _BASE_INV
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    return symbol, ~space, powers, inverse, plain


_CACHE: list = []


def _cached_tables():
    if not _CACHE:
        _CACHE.append(_tables())
    return _CACHE[0]


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the offsets of each document's words in that array."""
    symbol, is_word, powers, inverse, _ = _cached_tables()
    lo, hi = int(offsets[0]), int(offsets[-1])
    hashes, at = [], []
    begin = lo
    first_of_doc = np.zeros(hi - lo + 1, bool)
    first_of_doc[offsets - lo] = True
    while begin < hi:
        end = min(begin + PIECE_BYTES, hi)
        piece = data[begin:end]
        inside = is_word[piece]
        if end < hi and inside[-1] and not first_of_doc[end - lo] and is_word[data[end]]:
            breaks = np.flatnonzero(~inside | first_of_doc[begin - lo : end - lo])
            cut = int(breaks[-1]) + int(not inside[breaks[-1]]) if len(breaks) else 0  # after white space, or before a text
            if cut > 0:
                end = begin + cut
                piece, inside = data[begin:end], inside[: end - begin]
            else:  # one word longer than a piece
                stop, found = begin + 1, False
                while stop < hi and not found:
                    ahead = min(stop + PIECE_BYTES, hi)
                    ends = np.flatnonzero(~is_word[data[stop:ahead]] | first_of_doc[stop - lo : ahead - lo])
                    found = len(ends) > 0
                    stop = stop + int(ends[0]) if found else ahead
                hashes.append(_long_word(data[begin:stop], symbol))
                at.append(np.array([begin], np.int64))
                begin = stop
                continue
        edge = first_of_doc[begin - lo : end - lo]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:]
        start = np.flatnonzero(starts)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:]
        stop = np.flatnonzero(ends)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(symbol[piece] * powers[: len(piece)], out=total[1:])
        hashes.append(mix64((total[stop + 1] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)))
        at.append(start + begin)
        begin = end
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    where = np.concatenate(at) if at else np.zeros(0, np.int64)
    return every, np.searchsorted(where, offsets)


def _long_word(word: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    value, scale = 0, 1
    for i in range(0, len(word), PIECE_BYTES):
        part = symbol[word[i : i + PIECE_BYTES]]
        powers = _cached_tables()[2][: len(part)]
        value = (value + scale * int((part * powers).sum(dtype=np.uint64))) & (1 << 64) - 1
        scale = scale * pow(int(_BASE), len(part), 1 << 64) & (1 << 64) - 1
    return mix64(np.array([value + len(word) - 1 & (1 << 64) - 1], np.uint64))


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every run of ``size`` words, and the offsets per document.

    A document with fewer words, but some, has its whole sequence as its one shingle.
    """
    n = np.diff(offsets)
    value = np.zeros(len(words), np.uint64)
    for k in range(size):
        scale = mix64(np.array([k + 1], np.uint64))[0] | np.uint64(1)
        value[: len(words) - k] += words[k:] * scale
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    out = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    source = np.repeat(offsets[:-1] - out[:-1], count) + np.arange(out[-1])
    value = value[source] if len(source) else value[:0]
    for d in np.flatnonzero((n > 0) & (n < size)):  # too short for one full shingle
        total = np.uint64(n[d])
        for k, w in enumerate(words[offsets[d] : offsets[d + 1]]):
            total = np.uint64((int(total) + int(w) * int(mix64(np.array([k + 101], np.uint64))[0] | np.uint64(1))) & (1 << 64) - 1)
        value[out[d]] = total
    return mix64(value), out


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position of every word's first byte, and the offsets of each document's words in that array."""
    is_word = _cached_tables()[1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = is_word[data[lo:hi]]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = offsets[(offsets > lo) & (offsets < hi)] - lo
    starts[edge] = inside[edge]
    where = np.flatnonzero(starts) + lo
    return where, np.searchsorted(where, offsets)


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(word_starts(data, offsets)[1])


def subword_hashes(texts: list[bytes], sizes: tuple[int, ...], open_left: np.ndarray, open_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all byte n-grams inside words framed by one boundary each, and the offsets per text.

    Here words are of ASCII letters and digits and bytes over 127, and the texts together have less than PIECE_BYTES.
    A text that is open at an end was cut there, so no n-gram has a boundary at that end.
    """
    symbol, _, powers, inverse, plain = _cached_tables()
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    inside = plain[data]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(inside, symbol[data], symbol[32]) * powers[: len(data)], out=total[1:])
    breaks = np.concatenate([[0], np.cumsum(~inside)])
    hashes, usable = np.zeros((len(data), len(sizes)), np.uint64), np.zeros((len(data), len(sizes)), bool)
    for k, n in enumerate(sizes):
        m = len(data) - n + 1
        if m > 0:
            hashes[:m, k] = mix64((total[n:] - total[:-n]) * inverse[:m] + np.uint64(n))
            usable[:m, k] = breaks[n - 1 : n - 1 + m] == breaks[1 : 1 + m]
            usable[bounds[:-1][open_left], k] = False
            end = bounds[1:][open_right] - n + 1
            usable[end[end >= 0], k] = False
    counts = np.concatenate([[0], np.cumsum(usable.sum(1))])
    return hashes[usable], counts[bounds]

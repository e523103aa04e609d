"""Media columns: Netpbm and BMP images in binary columns, decoded to numpy arrays.

Images are area-resized by integral images: the table of sums is read at fractional corners, so each output sample
is the exact mean of the part of the image it covers.  The table is made in strips of rows and only the rows that are
read are kept, so an image of any height takes the memory of a strip.  Tiles are NPY bytes, and a difference hash
compares neighbours of a 9 x 8 resize.

Defined results: a null payload counts as empty; payloads are padded with bytes 255 to a positive multiple of
``UNIT``; equal payloads give equal media and features; very long payloads are tall images; null media give nulls, and
media that can't be decoded give their size and digest and nulls for what would be read from them; repeated rows repeat
their result; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.batches import as_arrow, column, text_slices

UNIT = 576
WIDTH = 24
TILE = 16
STRIP_SAMPLES = 1 << 18


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    h, w, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """24-bit BMP: rows from the bottom up, BGR, each padded to four bytes."""
    h, w, _ = samples.shape
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = samples[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm_header(media: bytes, numbers: int) -> tuple[list[int], int]:
    """The header's numbers and where the samples start; comments run from # to the end of a line."""
    at, found = 2, []
    while len(found) < numbers:
        while media[at : at + 1].isspace() or media[at : at + 1] == b"#":
            at = media.index(b"\n", at) + 1 if media[at : at + 1] == b"#" else at + 1
        end = at
        while media[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        found.append(int(media[at:end]))
        at = end
    return found, at + 1


def _decode_netpbm(media: bytes) -> np.ndarray:
    kind = media[1] - ord("0")
    bitmap, channels = kind in (1, 4), 3 if kind in (3, 6) else 1
    numbers, at = _netpbm_header(media, 2 if bitmap else 3)
    w, h = numbers[:2]
    if not w or not h or not bitmap and not 0 < numbers[2] < 65536:
        raise ValueError("broken Netpbm header")
    per_byte = 8 if kind == 4 else 1
    if w * h * channels > (len(media) - at + 1) * per_byte:  # also in text forms a sample takes a byte at least
        raise ValueError("fewer samples than the header says")
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(media, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w]
        out = (1 - bits) * 255
    elif kind == 1:
        bits = [c - 48 for c in media[at - 1 :] if c in b"01"][: w * h]
        out = (1 - np.array(bits, np.int64).reshape(h, w)) * 255
    else:
        if kind < 4:
            flat = np.array([int(x) for x in media[at - 1 :].split()[: w * h * channels]], np.int64)
        else:
            flat = np.frombuffer(media, ">u2" if numbers[2] > 255 else np.uint8, w * h * channels, at)
        if flat.min() < 0 or flat.max() > numbers[2]:
            raise ValueError("a sample is out of range")
        out = flat if numbers[2] == 255 else (flat.astype(np.int64) * 255 + numbers[2] // 2) // numbers[2]
        out = out.reshape((h, w, 3) if channels == 3 else (h, w))
    return out.astype(np.uint8)


def _decode_bmp(media: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", media, 10)[0]
    header, w, h, _, depth, packing = struct.unpack_from("<IiiHHI", media, 14)
    if (depth, packing) not in ((8, 0), (24, 0), (32, 0), (32, 3)) or w < 1 or not h:
        raise ValueError("only BMP of 8, 24 or 32 bits without compression")
    stride = (w * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(media, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)[:, : w * depth // 8]
    if h > 0:
        rows = rows[::-1]
    if depth == 8:
        palette = np.frombuffer(media, np.uint8, (start - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        if len(palette) <= rows.max():
            raise ValueError("a sample is not in the palette")
        return np.ascontiguousarray(palette[rows])
    if packing == 3:
        masks = struct.unpack_from("<III", media, 54)
        packed = np.ascontiguousarray(rows).view("<u4")
        return np.stack([_by_mask(packed, mask) for mask in masks], axis=-1)
    return np.ascontiguousarray(rows.reshape(abs(h), w, depth // 8)[:, :, 2::-1])


def _by_mask(packed: np.ndarray, mask: int) -> np.ndarray:
    """The samples under a bit mask, scaled to 0 to 255; 0 where the mask is empty."""
    if not mask:
        return np.zeros(packed.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return (((packed & np.uint32(mask)) >> np.uint32(low)).astype(np.uint64) * 255 // most).astype(np.uint8)


def decode(media: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) array of bytes."""
    if media[:2] == b"BM":
        return _decode_bmp(media)
    if media[:1] == b"P" and media[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _decode_netpbm(media)
    raise ValueError("neither Netpbm nor BMP")


FORMATS = ("pgm", "ppm", "bmp")


def store(payload: bytes, form: str = "pgm") -> bytes:
    """A padded payload as an image of one of ``FORMATS``."""
    samples = np.frombuffer(payload, np.uint8)
    if form == "pgm":
        return encode_pgm(samples.reshape(-1, WIDTH))
    return {"ppm": encode_ppm, "bmp": encode_bmp}[form](samples.reshape(-1, WIDTH, 3))


def gray(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 2 else samples @ np.array([299, 587, 114], np.float64) / 1000


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean brightness of each of height x width equal parts of an image."""
    h, w = samples.shape[:2]

    def corners(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(parts + 1) * size / parts
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, (at - low)[:, None]

    (top, part), (left, part_x) = corners(h, height), corners(w, width)
    wanted = np.unique(np.concatenate([top, top + 1]))
    table, carry = np.zeros((len(wanted), w + 1)), np.zeros(w)
    step = max(1, STRIP_SAMPLES // w)
    for a in range(0, h, step):
        sums = carry + np.cumsum(gray(samples[a : a + step]), axis=0, dtype=np.float64)
        carry = sums[-1]
        inside = np.flatnonzero((wanted > a) & (wanted <= a + len(sums)))
        table[inside, 1:] = np.cumsum(sums[wanted[inside] - a - 1], axis=1)
    at = np.searchsorted(wanted, top)
    rows = table[at] * (1 - part) + table[np.searchsorted(wanted, top + 1)] * part
    cut = (rows.T[left] * (1 - part_x) + rows.T[left + 1] * part_x).T
    return np.diff(np.diff(cut, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(samples: np.ndarray) -> str:
    small = np.round(area_resize(samples, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(np.round(area_resize(samples, TILE, TILE)), np.uint8), version=(1, 0))
    return out.getvalue()


def _store_rows(form: str):
    def store_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = as_arrow("doc_id long, n_bytes long, media binary")
        for batch in text_slices(batches, "payload"):
            sizes, media = [], []
            for payload in batch.column("payload").to_pylist():
                payload = payload or b""
                sizes.append(len(payload))
                media.append(store(payload + b"\xff" * (max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload)), form))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return store_rows


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary"


def features(media: bytes | None) -> tuple:
    """Payload's size, digest and tail's checksum, the media's size and digest, the hash and the tile."""
    if media is None:
        return (None,) * 7
    stored = (len(media), hashlib.sha256(media).hexdigest())
    try:
        samples = decode(media)
    except (ValueError, OverflowError, struct.error):
        return (None, None, None, *stored, None, None)
    payload = samples.tobytes()
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, difference_hash(samples), npy_tile(samples))


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = as_arrow(_FEATURES)
    for batch in text_slices(batches, "media"):
        rows = [features(media) for media in batch.column("media").to_pylist()]
        columns = [batch.column("doc_id"), batch.column("n_bytes")]
        columns += [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), list(schema)[2:], strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def media_column(docs: DataFrame, payload: str = "text", doc_id: str = "doc_id", form: str = "pgm") -> DataFrame:
    """doc_id, n_bytes (without padding) and media, the payload's bytes as an image of one of ``FORMATS``."""
    if form not in FORMATS:
        raise ValueError(f"not one of {FORMATS}")
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(payload).cast("binary").alias("payload"))
    return rows.mapInArrow(_store_rows(form), "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Decode a media column (doc_id, n_bytes, media): what was read back, its difference hash and an NPY tile."""
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(_read_rows, _FEATURES)

"""WARC archives: writing with segments and chunked framing, and segment reassembly on reading.

A payload is framed as an HTTP response with chunked transfer coding.  A block longer than ``SEGMENT_BYTES`` is cut
into a first record and continuations, which carry the first one's identifier, a segment number and, on the last,
the total length.  Reading groups continuations by origin identifier, orders them by segment number, verifies that
they are complete and have the total length, and decodes the chunks.

Records are lines of a text sink whose separator is the two line ends after a record, so Spark writes the archives
(gzip) to any file system; ``SEGMENT_BYTES`` and ``FILE_RECORDS`` bound a file, which reading takes whole.

Of records with equal payloads, the one of the largest page_id is the response and the others are revisits without
a payload.  Only digests and identifiers are grouped, so a payload that a third of all pages share is no burden.

Pages without an identifier that share a payload are numbered by groups of their urls, so these are no single group either.

Defined results: a null payload is empty; a null url is left out; a very long payload is many segments; of ties in page_id the first url is the response; rows that repeat a page_id and a payload are
records of their own, one of them the response; rows with a null page_id are responses unless others with the
payload have one; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.llm.batches import as_arrow, text_slices
from chatloom.session import shared_path, ship, written

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FILE_RECORDS = 1024
SALTS = 1024
DATE = "2024-02-01T12:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(piece), piece) for i in range(0, len(body), size) if (piece := body[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer coding; sizes may carry extensions, trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(_END, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) != size or body[end + 2 + size : end + 4 + size] != _END:
            raise ValueError("broken chunk")
        out.append(piece)
        at = end + 4 + size


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records_of(page_id: int | None, nth: int, url: str | None, payload: bytes, refers_to: int | None) -> list[bytes]:
    """The records of one page, without the two line ends that follow each."""
    digest = payload_digest(payload)

    def name(page: int | None, n: int) -> str:
        return f"<urn:chatloom:page:{page}:{digest}:{n}>"

    own = name(page_id, nth)
    head = [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.insert(0, ("WARC-Target-URI", "".join(url.splitlines())))
    http = [("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", name(refers_to, 0)), ("WARC-Profile", _PROFILE), *head, *http], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *head, *http], block)]
    out = []
    for i in range(0, len(block), SEGMENT_BYTES):
        number = i // SEGMENT_BYTES + 1
        kind = [("WARC-Type", "response" if number == 1 else "continuation"), ("WARC-Record-ID", own if number == 1 else f"{own[:-1]}:segment:{number}>")]
        kind += [("WARC-Segment-Number", number)] + ([("WARC-Segment-Origin-ID", own)] if number > 1 else [])
        kind += [("WARC-Segment-Total-Length", len(block))] if i + SEGMENT_BYTES >= len(block) else []
        out.append(_record(kind + head + (http if number == 1 else []), block[i : i + SEGMENT_BYTES]))
    return out


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a file that may be compressed, as a whole or by record."""
    if archive[:2] == b"\x1f\x8b":
        plain, rest = [], archive
        while rest:
            stream = zlib.decompressobj(31)
            plain.append(stream.decompress(rest))
            rest = stream.unused_data
        archive = b"".join(plain)
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not at a WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        block = archive[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("record cut short")
        yield headers, block
        at = end + 8 + size


def _to_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "payload"):
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "nth", "url", "payload", "refers_to")), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([r for row in rows for r in records_of(*row)], pa.binary())], schema=as_arrow("record binary"))


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments int, verified boolean, payload binary"
_PARTS = f"origin string, segment int, total long, last boolean, {_PAGES}"


def _page_of(urn: str | None) -> int | None:
    page = (urn or ":::None").split(":")[3]
    return None if page == "None" else int(page)


def _from(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _decoded(parts: list[dict], with_payload: bool) -> dict:
    """One page from the parts of its record, in order of segments; their payload is the record's block so far."""
    block = b"".join(p["payload"] for p in parts)
    complete = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["last"] and parts[-1]["total"] == len(block)
    page = parts[0] | {"segments": len(parts), "verified": complete, "payload": None}
    if not complete:
        return page
    head, body = block.split(b"\r\n\r\n", 1)
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    if page["record_type"] == "revisit":
        return page | {"payload_bytes": int(fields[b"Content-Length"])}
    payload = unchunked(body) if fields.get(b"Transfer-Encoding") == b"chunked" else body
    digest = payload_digest(payload)
    return page | {"payload_bytes": len(payload), "payload_digest": digest, "verified": digest == page["payload_digest"], "payload": payload if with_payload else None}


def _to_parts(with_payload: bool):
    """Records of archives: those in one part are decoded at once, segments keep their block as payload until they meet."""

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = as_arrow(_PARTS)
        for batch in batches:
            for content in batch.column("content"):
                rows: list[dict] = []
                size = 0
                for h, block in read_records(content.as_buffer().to_pybytes()):
                    total, alone = h.get("WARC-Segment-Total-Length"), "WARC-Segment-Number" not in h
                    part = {
                        "origin": h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]),
                        "segment": int(h.get("WARC-Segment-Number", 1)),
                        "total": len(block) if alone else total and int(total),
                        "last": alone or total is not None,
                        "page_id": _page_of(h["WARC-Record-ID"]),
                        "record_type": h["WARC-Type"],
                        "refers_to": _page_of(h.get("WARC-Refers-To")),
                        "payload_digest": h.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
                        "payload": block,
                    }
                    rows.append(_decoded([part], with_payload) if alone else part)
                    size += len(rows[-1]["payload"] or b"")
                    if size > 4 << 20:
                        yield _from(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _from(rows, schema)

    return to_parts


def _reassemble(with_payload: bool):
    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = as_arrow(_PAGES)
        held: list[dict] = []

        def page() -> dict:
            return held[0] if held[0]["segments"] else _decoded(held, with_payload)

        for batch in text_slices(batches, "payload"):
            out = []
            for row in batch.to_pylist():
                if held and held[0]["origin"] != row["origin"]:
                    out.append(page())
                    held = []
                held.append(row)
            if out:
                yield _from(out, schema)
        if held:
            yield _from([page()], schema)

    return reassemble


def write_archives(pages: DataFrame, path: str, payload: str = "html", page_id: str = "page_id", url: str = "url", least_bytes: int = 0) -> None:
    """Write WARC files under ``path``; payloads under ``least_bytes`` are never revisits."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"), F.coalesce("page_id", F.lit(0)).alias("page"), F.col("page_id").isNull().alias("no_page"))
    rows = rows.withColumn("salt", F.when(F.col("no_page"), F.pmod(F.xxhash64("url"), F.lit(SALTS))).otherwise(0).cast("long"))
    narrow = rows.select("page_id", "page", "no_page", "sha1", "salt", "size")
    shared = narrow.filter(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND keeper IS NOT NULL")
    shared = written(shared.drop("n"), "warc-shared")
    key = ["page", "no_page", "sha1", "salt"]  # never null, so numbering and joining share one shuffle of the payloads
    roles = narrow.join(shared, ["sha1", "size"]).select(*key, "keeper").distinct()
    nth = (F.row_number().over(W.partitionBy(key).orderBy("url")) - 1).cast("long")
    rows = rows.withColumn("nth", F.when(F.col("no_page"), nth * SALTS + F.col("salt")).otherwise(nth))
    roled = rows.join(roles, key, "left")
    own = F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("nth") == 0)
    refers_to = F.when(~own, F.col("keeper"))
    records = roled.select("page_id", "nth", "url", "payload", refers_to.alias("refers_to")).mapInArrow(_to_records, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to, segments, verified, payload.

    A record with missing or wrong segments is returned with ``verified`` false and no length.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parts = files.mapInArrow(_to_parts(with_payload), _PARTS)
    parts = parts.repartition("origin").sortWithinPartitions("origin", "segment")
    return parts.mapInArrow(_reassemble(with_payload), _PAGES)


def archived(pages: DataFrame, **options: object) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read them back."""
    ship(pages.sparkSession)
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path, with_payload=False)

"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every byte prefix of a piece there is exactly one token that can end its encoding: the one whose remaining
prefix ends in a token with which it forms a valid pair.  Storing that token for each prefix gives the encoding
by walking back from the end; appending bytes only adds entries, and after an edit only the entries from the
edit on are made again.

A pair (a, b) is valid if merging the bytes of both by rank gives a and b again; answers are kept in a bounded
table.  A piece that is itself in the vocabulary is that one token, as the reference encoders of this file format do.

Defined results: a null text counts as empty and has no tokens; special tokens' strings are ordinary text;
any valid Unicode text round-trips; repeated rows repeat their result; a very long text is split by the pattern like any
other, and only its own ids are held; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.batches import as_arrow, text_slices

PIECE_CACHE = 200_000
PAIR_CACHE = 400_000
LONG_PIECE = 64
"""Bounds of a worker's tables, which keep them at some tens of MB."""


class PrefixCoder:
    """Encoder of single pieces for one rank table."""

    def __init__(self, rank_file: bytes) -> None:
        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self._halves: dict[int, tuple[int, int]] = {}
        self._pair: dict[int, bool] = {}

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; itself twice for a single byte, (-1, -1) if merging never gives it."""
        if (known := self._halves.get(token)) is None:
            parts = [bytes([c]) for c in self.token[token]]
            while len(parts) > 2:
                ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
                if not ranked:
                    break
                i = min(ranked)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 1:
                known = (token, token)
            elif len(parts) == 2:
                known = (self.rank[parts[0]], self.rank[parts[1]])
            else:
                known = (-1, -1)
            self._halves[token] = known
        return known

    def fits(self, before: int, token: int) -> bool:
        """Does the boundary between the two tokens outlive merging by rank?

        The tokens that touch the boundary are taken back to the bytes beside it, the latest merge first.  Two that
        touched for some time would have been merged across it if that merge has a lower rank than the one which ended
        that time (of equal ranks, the left one comes first).
        """
        key = before << 32 | token
        if (known := self._pair.get(key)) is not None:
            return known
        if len(self._pair) >= PAIR_CACHE:
            self._pair.clear()
        left, right, until, bound = before, token, 1 << 40, self._split(token)[0] >= 0
        while bound:
            across = self.rank.get(self.token[left] + self.token[right])
            if across is not None and across < until:
                bound = False
                break
            of_left, of_right = len(self.token[left]) > 1, len(self.token[right]) > 1
            if of_left and (left > right or not of_right):
                until, left = left, self._split(left)[1]
            elif of_right:
                until, right = right + 1, self._split(right)[0]
            else:
                break
        self._pair[key] = bound
        return bound

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Add the last token of every prefix of ``piece`` that ``last`` doesn't have yet.

        Exactly one candidate fits; short ones are tried first.
        """
        rank, pair, longest = self.rank, self._pair, self.longest
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                token = rank.get(piece[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start - 1]
                    fits = pair.get(before << 32 | token)
                    if fits is None:
                        fits = self.fits(before, token)
                else:
                    fits = self._split(token)[0] >= 0
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError("a byte of the text has no token")
        return last

    def append(self, piece: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        return piece + more, self.extend(piece + more, last)

    def edit(self, piece: bytes, last: list[int], at: int, new_tail: bytes) -> tuple[bytes, list[int]]:
        """Replace everything from byte ``at`` on; entries of the shared prefix are used again."""
        changed = piece[:at] + new_tail
        return changed, self.extend(changed, last[:at])

    def walk_back(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.token[ids[-1]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        return [whole] if whole is not None else self.walk_back(self.extend(piece, []))


class _Pieces(dict):
    """Piece of text -> its ids, joined by commas.  When it is full, what wasn't used since it last was goes."""

    def __init__(self, coder: PrefixCoder) -> None:
        super().__init__()
        self.coder = coder
        self.older: dict[str, str] = {}

    def __missing__(self, piece: str) -> str:
        ids = self.older.get(piece)
        if ids is None:
            ids = ",".join(map(str, self.coder.encode(piece.encode())))
            if len(piece) > LONG_PIECE:
                return ids
        if len(self) >= PIECE_CACHE:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


_LOADED: dict[bytes, tuple[_Pieces, dict[str, bytes]]] = {}


def _loaded(rank_file: bytes) -> tuple[_Pieces, dict[str, bytes]]:
    """A worker's tables, made once for each rank file."""
    name = hashlib.sha256(rank_file).digest()
    if name not in _LOADED:
        coder = PrefixCoder(rank_file)
        _LOADED[name] = _Pieces(coder), {str(r): t for r, t in coder.token.items()}
    return _LOADED[name]


def _coded(ranks, pattern: str, with_ids: bool):
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, tokens = _loaded(ranks.value)
        split = regex.compile(pattern).findall
        schema = as_arrow(fields)
        if with_ids:
            schema = schema.append(pa.field("ids", pa.list_(pa.int32())))
        for batch in text_slices(batches, "text"):
            counts, digests, decoded, every = [], [], [], []
            for text in batch.column("text").to_pylist():
                joined = ",".join(map(pieces.__getitem__, split(text or "")))
                ids = joined.split(",") if joined else []
                counts.append(len(ids))
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(tokens.__getitem__, ids))).hexdigest())
                if with_ids:
                    every.append(pa.array(ids, pa.string()).cast(pa.int32()))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                offsets = pa.array([0, *accumulate(counts)], pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(every)))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return code, fields + (", ids array<int>" if with_ids else "")


def encode_and_decode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (of the bytes decoded from the ids) and the ids.

    The rank file has a fixed size and is read once by the driver and broadcast.
    """
    with open(rank_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    code, fields = _coded(ranks, pattern, with_ids)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(code, fields)

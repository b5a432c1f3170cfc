"""Byte-level BPE encoding and decoding as a tree reduction over a monoid.

The elements are (bytes, ids of their encoding); the operation joins two neighbours.  Two facts make it exact: a list
of ids is the encoding of its bytes if and only if each adjacent pair of ids is the encoding of that pair's bytes, and
any part of an encoding is an encoding.  So if the pair at the seam is stable, the join is the concatenation; else a
window of ids on both sides of the seam is encoded anew and doubled until the pairs at both of its edges are stable.
From there no id outside the window can change.  Halves recur in many pre-tokens, so the results for short ones are kept
in a bounded cache.  Decoding concatenates bytes up a tree in the same way.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import batch_rows, load_ranks, one_cache, texts
from llm.stretches import stretches

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CACHE_ENTRIES = 800_000
KEEP_BYTES = 48
LEAF_TOKENS = 512


class TreeCodec:
    """Encoder and decoder for a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, entries: int = CACHE_ENTRIES):
        self.ranks, self.entries = ranks, entries
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.spaced: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        first, *rest = stretches(text)
        spaced = self.spaced
        try:
            ids = [spaced[s] for s in rest]
        except KeyError:
            if len(spaced) > self.entries:
                spaced.clear()
            for s in rest:
                if s not in spaced:
                    spaced[s] = self._stretch(f" {s}")
            ids = [spaced[s] for s in rest]
        return self._stretch(first) + b"".join(ids)

    def _stretch(self, text: str) -> bytes:
        if len(self.halves) > self.entries:
            self.halves.clear()
        if len(self.pairs) > self.entries:
            self.pairs.clear()
        ids: list[int] = []
        for match in self.find(text):
            ids.extend(self.encode_piece(match.encode()))
        return np.array(ids, "<u4").tobytes() if ids else b""

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one match of the pattern: both halves, joined."""
        if len(piece) == 1:
            return (self.ranks[piece],)
        if (kept := self.halves.get(piece)) is not None:
            return kept
        half = len(piece) // 2
        ids = self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))
        if len(piece) <= KEEP_BYTES:
            self.halves[piece] = ids
        return ids

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the joined bytes of two encodings."""
        window = self.pair(left[-1], right[0])
        if window == (left[-1], right[0]):
            return left + right
        width = 1
        while True:
            if width > 1:
                window = self.merge(b"".join([self.bytes_of[i] for i in left[-width:] + right[:width]]))
            if ((width >= len(left) or self.stable(left[-width - 1], window[0]))
                    and (width >= len(right) or self.stable(window[-1], right[width]))):
                return left[:-width] + window + right[width:]
            width *= 2

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of the bytes of two ids."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b])
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of two ids are encoded as just these two."""
        return self.pair(a, b) == (a, b)

    def merge(self, window: bytes) -> tuple[int, ...]:
        """Encode a window from its bytes: the adjacent pair of lowest rank is merged first, from the left."""
        ranks, n = self.ranks, len(window)
        if (whole := ranks.get(window)) is not None and n == 1:
            return (whole,)
        end = list(range(1, n + 1))  # a part from i to end[i]
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(window[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j = heapq.heappop(heap)
            middle = end[i]
            if not alive[i] or middle >= n or end[middle] != j or middle == j:
                continue
            alive[middle] = False
            end[i] = j
            if j < n:
                before[j] = i
                if (r := ranks.get(window[i:end[j]])) is not None:
                    heapq.heappush(heap, (r, i, end[j]))
            if (k := before[i]) >= 0 and (r := ranks.get(window[k:j])) is not None:
                heapq.heappush(heap, (r, k, j))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[window[i:end[i]]])
            i = end[i]
        return tuple(ids)

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ids: both halves, concatenated."""
        if len(ids) <= LEAF_TOKENS:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_documents(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every document; a null text has none.

    Repeated rows are encoded each on its own, an empty table gives no rows, other columns are ignored.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path)
        for batch in batch_rows(batches, 256):
            ids = [codec.encode(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and decoded (binary) of encode_documents' rows; null ids are none."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path)
        for batch in batch_rows(batches, 256):
            out = [codec.decode(np.frombuffer(b or b"", "<u4").tolist()) for b in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of what they decode to; both steps run in the task that reads."""
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path)
        for batch in batch_rows(batches, 256):
            n, encoded, decoded = [], [], []
            for text in batch["text"].to_pylist():
                ids = codec.encode(text)
                n.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(both, SCHEMA)


def _codec(ranks_path: str) -> TreeCodec:
    return one_cache(f"codec {ranks_path}", lambda: TreeCodec(load_ranks(ranks_path)))

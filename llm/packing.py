"""Best-fit packing of token sequences with matching of large items.

Documents of the same length are interchangeable, so the packing is decided on the histogram of piece lengths: at most
``capacity`` numbers, whatever the number of documents.  Pieces above a third of the capacity go at most two to a bin,
by greedy matching: the largest is paired with the largest that still fits.  The smaller ones, longest first, go
to the tightest remaining gap.  The result is a list of runs ("ranks a to b of length L lie in bins x to y at offset
o").  Every piece has a rank within its length, from the number of equal pieces in earlier partitions plus its
place in its own, and looks up its run.  No text is shuffled, nothing is sorted, and no length is a hot group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import batch_rows, byte_letters, load_tokenizer, materialize, one_cache, texts

CAPACITY = 2048
END_ID = 0
CACHE_ENTRIES = 800_000
#: Python's str.split() also splits at these; the tokenizer does not count them as white space.
_EXTRA_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")

#: Fixed value: the pattern of the tokenizer's file.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long, part int"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class WordEncoder:
    """Ids of a tokenizer that drops white space: every stretch between spaces is encoded on its own and kept.

    Stretches of letters whose case and classes all Unicode versions share are cut here and given to the library's
    model; any other goes through the whole library.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tokenizer, self.entries, self.kept = load_tokenizer(path), entries, {}
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.cut = regex.compile(_WORDS).findall

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(c in text for c in _EXTRA_SPACE):
            return self._ids([text])[0]
        words, kept = text.split(), self.kept
        ids = list(map(kept.get, words))
        if None in ids:
            if len(kept) > self.entries:
                kept.clear()
            for k, found in enumerate(ids):
                if found is None:
                    w = words[k]
                    ids[k] = kept[w] = self._plain(w) if max(w) < "\u0300" and "<|" not in w else self._ids([w])[0]
        return b"".join(ids)

    def _plain(self, word: str) -> bytes:
        word, ids = word.lower(), []
        for piece in [word] if word.isalpha() else self.cut(word):
            if not piece.isascii() or not piece.isprintable():  # else each byte stands for itself
                piece = piece.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.tokenize(piece)]
        return pack(f"<{len(ids)}I", *ids)

    def _ids(self, strings: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document's ids plus the end id, and each piece's place among equals in its partition.

    Only a document longer than ``capacity`` has more than one piece.  A null text is empty (the end id alone).
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = one_cache(f"words {tokenizer}", lambda: WordEncoder(tokenizer)), TaskContext.get().partitionId()
        places = np.zeros(capacity + 1, np.int64)
        for batch in batch_rows(batches, 256):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    length = len(own) // 4
                    rows.append((doc_id, k, at // 4, length, zlib.crc32(own), int(places[length]), part))
                    places[length] += 1
            yield _record_batch(rows, [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                                       ("length", pa.int64()), ("ids_crc32", pa.int64()), ("place", pa.int64()),
                                       ("part", pa.int32())])

    return texts(docs).mapInArrow(cut, PIECES)


def _record_batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)],
                                      names=[n for n, _ in fields])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first bin, offset) for ``counts`` pieces of each length.

    Rank ``first + i`` of a run lies in bin ``first bin + i``.  A run is made for whole groups of equal bins, so
    the number of runs and the time depend on ``capacity`` and hardly on the number of pieces.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    left = {length: n for length, n in counts.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free space -> groups of bins (first, number)
    sizes: list[int] = []

    def put(length: int, n: int, first_bin: int, offset: int) -> None:
        runs.append((length, rank[length], n, first_bin, offset))
        rank[length] += n
        left[length] -= n

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    large = sorted(length for length in left if 3 * length > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect_left(large, capacity - length + 1) - 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            partner = large[at] if at >= 0 else None
            if partner == length:
                n = left[length] // 2
                partner = length if n else next((x for x in reversed(large[:at]) if left[x]), None)
                n = n or 1
            else:
                n = left[length]
            if partner is None:
                n = left[length]
                put(length, n, bins, 0)
                keep(capacity - length, bins, n)
            else:
                n = min(n, left[partner]) if partner != length else n
                put(length, n, bins, 0)
                put(partner, n, bins, length)
                keep(capacity - length - partner, bins, n)
            bins += n
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(sizes, length)
            if at == len(sizes):  # no gap is large enough: open bins for all that remain
                fit = capacity // length
                n = -(-left[length] // fit)
                keep(capacity, bins, n)
                bins += n
                continue
            gap = sizes[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            fit = gap // length
            whole = min(n, left[length] // fit)
            if whole:
                for k in range(fit):
                    put(length, whole, first, capacity - gap + k * length)
                keep(gap - fit * length, first, whole)
            if whole < n and left[length]:  # what is left is less than one bin takes
                some = left[length]
                for k in range(some):
                    put(length, 1, first + whole, capacity - gap + k * length)
                keep(gap - some * length, first + whole, 1)
                whole += 1
            keep(gap, first + whole, n - whole)
    return runs


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Place every document's pieces into as few sequences of ``capacity`` tokens as the method can.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Null texts are empty documents,
    repeated rows are packed each on its own, an empty table gives no rows, and other columns are ignored.  To the
    driver goes the histogram of lengths (``capacity`` rows); the runs made from it are bounded by
    ``capacity`` as well and reach the tasks with the function.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, end_id), "pack-pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # runs are sorted by (length, first rank); one number orders both
        scale = int(runs[:, 1].max(initial=0)) + int(runs[:, 2].max(initial=0)) + 1
        keys = runs[:, 0] * scale + runs[:, 1]
        for batch in batches:
            length = batch["length"].to_numpy(zero_copy_only=False)
            rank = batch["rank"].to_numpy(zero_copy_only=False)
            run = runs[np.searchsorted(keys, length * scale + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(starts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PACKED)

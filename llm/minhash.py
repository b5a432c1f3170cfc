"""Document fingerprints by MinHash.

A shingle is five words; its hash is a sum of the words' hashes with odd factors, mixed.  ``LANES`` universal hash functions
(a * x + b modulo 2^64) permute the shingles' hashes, all in numpy arrays; the lowest value under each, cut to 16 bits,
is a lane of the fingerprint.  Two texts agree in a lane with a probability that is the Jaccard likeness of their
shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import batch_rows, partitions, texts

LANES = 128
WORDS = 5
CHUNK = 1024
BANDS, ROWS = 25, 5  # of near.py: texts of likeness 0.8 share no band with a probability of 0.00005
NO_SHINGLE = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 2**64, LANES, dtype=np.uint64) | np.uint64(1)
_TERMS = _random.integers(0, 2**64, LANES, dtype=np.uint64)
_PLACES = _random.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of UTF-8 text, ASCII letters in either case alike."""
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in data.lower().split()]), ">u8").astype(np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; of fewer words, of the whole run; of none, nothing."""
    if not len(words):
        return words
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for at in range(k):
        out += words[at:at + n] * _PLACES[at]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


def lowest(hashes: np.ndarray) -> np.ndarray:
    """The lowest value of the hashes under each function."""
    out = NO_SHINGLE
    for at in range(0, len(hashes), CHUNK):
        out = np.minimum(out, (hashes[at:at + CHUNK, None] * _FACTORS + _TERMS).min(axis=0))
    return out


def lanes(low: np.ndarray) -> np.ndarray:
    return (low >> np.uint64(32)).astype(np.uint16)


def signature(text: str) -> np.ndarray:
    return lanes(lowest(shingles(word_hashes(text.encode()))))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


@dataclass
class _Row:
    doc_id: int | None
    text: str
    ahead: int

    def __post_init__(self) -> None:
        n = len(self.text)
        self.kept = self.text[:n - n // 2].encode()
        data = self.text.encode()
        self.words = word_hashes(data)
        hashes = shingles(self.words)
        # all shingles of the kept half but those that its last word, which may be cut, takes part in
        self.whole = max(0, len(self.kept.split()) - 1)
        self.shared = max(0, self.whole - WORDS + 1) if len(self.words) > WORDS else 0
        self.shared_low = lowest(hashes[:self.shared])
        self.signature = lanes(np.minimum(self.shared_low, lowest(hashes[self.shared:])))

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """SHA-256 and signature of the text with its last half replaced by the start of the next one."""
        n = len(self.text)
        data = self.kept + following[:n // 2].encode()
        at = self.whole and len(self.kept.rsplit(None, 1)[0]) if not self.kept[-1:].isspace() else None
        rest = data[at:] if at is not None else data
        words = word_hashes(data) if at is None else np.concatenate([self.words[:self.whole], word_hashes(rest)])
        hashes = shingles(words)
        if len(words) < WORDS or not self.shared:
            low = lowest(hashes)
        else:
            low = np.minimum(self.shared_low, lowest(hashes[self.shared:]))
        return hashlib.sha256(data).hexdigest(), lanes(low)


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, and of the text whose last half the next document's start replaces.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (512 hex digits), near_edited, near_next.  Documents are in
    the order of doc_id (rows without one first; of equal ids, in the order of a hash of the text); after the last
    comes the first, so a single document is followed by itself.  A null text is empty.  Texts without a word share one
    fingerprint.  Repeated rows are documents of their own, an empty table gives no rows, other columns are ignored.

    Texts move once: percentiles of doc_id cut the table into parts of about the same number of rows, each part is sorted,
    and a part also gets the first row of the next one.
    """
    spark = docs.sparkSession
    rows = texts(docs).select(F.col("doc_id").cast("long"), "text")
    parts = partitions(spark)
    cuts, first, unnamed = rows.agg(
        F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts), F.min("doc_id"),
        F.count_if(F.col("doc_id").isNull())).first()
    splits = np.array(sorted(set(cuts or []) - ({first} if not unnamed else set())), np.int64)
    start = None if unnamed else first

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(batches, 2048):
            ids = batch["doc_id"].to_pylist()
            known = np.array([-(1 << 63) if i is None else i for i in ids], np.int64)
            part = np.searchsorted(splits, known, side="right")
            opens = np.flatnonzero((part > 0) & (splits[part - 1] == known)) if len(splits) else np.zeros(0, np.int64)
            wraps = np.array([k for k, i in enumerate(ids) if i == start], np.int64)
            take = np.concatenate([np.arange(len(ids)), opens, wraps])
            where = np.concatenate([part, part[opens] - 1, np.full(len(wraps), len(splits))])
            ahead = np.repeat([0, 1, 2], [len(ids), len(opens), len(wraps)])
            out = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(where, pa.int32()), pa.array(ahead, pa.int32())],
                                             names=["doc_id", "text", "part", "ahead"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: _Row | None = None
        for batch in batch_rows(batches, 256):
            out = []
            for doc_id, text, ahead in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "ahead")), strict=True):
                if ahead and (last is None or last.ahead):
                    continue  # the next part's first row came already
                row = _Row(doc_id, text, ahead)
                if last is not None and not last.ahead:
                    digest, changed = last.edited(row.text)
                    out.append((last.doc_id, len(last.text), digest, _hex(last.signature), _hex(changed),
                                likeness(last.signature, changed), likeness(last.signature, row.signature)))
                last = row
            types = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=[f.split()[0] for f in EDITED.split(", ")])

    dealt = rows.mapInArrow(deal, "doc_id long, text string, part int, ahead int")
    dealt = dealt.withColumn("mark", F.xxhash64("text")).repartitionById(len(splits) + 1, F.col("part"))
    return dealt.sortWithinPartitions("ahead", F.col("doc_id").asc_nulls_first(), "mark").mapInArrow(pair, EDITED)

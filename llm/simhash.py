"""Near-duplicates by SimHash with Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into segments of 22, 21 and 21 bits, each padded to a 23-bit word of the perfect binary
Golay code, in which every word lies within three bits of exactly one codeword.  A segment decodes to the index of that
codeword (its own key) and to the indices of all codewords within four bits (its nearby keys, six at most).  Words
one bit apart: the own key of either is a nearby key of the other.  Words two bits apart share a nearby key.

Four differing bits fall on three segments in one of two ways.  Either two segments i < j have at most one each: then
(own key of i, a nearby key of j) of one fingerprint equals (a nearby key of i, own key of j) of the other.  Or one
segment i has none and both others have two: then (all bits of i, a nearby key of the next segment) are shared.  About
45 keys a fingerprint find all links; each candidate is verified on all 64 bits.

Fingerprints that many documents share count once.  Equal keys are brought together by one shuffle of 16-byte
rows, sorted, and linked as they stream by; of a group only a spanning forest of its links is kept, never its
pairs.  Groups of more than ``block`` fingerprints are dealt again, in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import batch_rows, materialize, partitions, texts
from llm.components import components

SEED = 42
WORDS = 4
BITS = 4
BLOCK = 2048
CHUNK = 65_536
_SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, width)
_GENERATOR = 0b101011100011  # fixed value: generator polynomial of the binary Golay code (23, 12)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 without a word."""
    found = text.encode().lower().split()  # of bytes, both know ASCII alone
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    k = min(words, len(found))
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(found) - k + 1].tolist()
    ends = ends[k - 1:].tolist()
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and simhash (the fingerprint as a signed long) of every row; a null text has fingerprint 0."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(batches, 512):
            found = np.array([fingerprint(t, words) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(found)],
                                             names=["doc_id", "mark", "simhash"])

    rows = texts(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(hashed, "doc_id long, mark long, simhash long")


class Golay:
    """Decoding tables of the perfect Golay code over 23 bits."""

    def __init__(self) -> None:
        remainder = np.zeros(1 << 12, np.int64)  # of high bits, modulo the generator
        for k in range(12):
            r = 1 << (k + 11)
            for bit in range(22, 10, -1):
                if r >> bit & 1:
                    r ^= _GENERATOR << (bit - 11)
            remainder[1 << k] = r
        for x in range(1, 1 << 12):
            low = x & -x
            remainder[x] = remainder[low] ^ remainder[x ^ low]
        self.high = remainder
        self.low = np.arange(1 << 11)
        errors: list[list[int]] = [[] for _ in range(1 << 11)]  # by syndrome: all errors of four bits or fewer
        for weight in range(5):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                errors[int(self._syndrome(np.int64(e)))].append(e)
        assert max(map(len, errors)) == 6 and all(errors)
        self.count = np.array([len(e) for e in errors])
        self.errors = np.array([e + [e[0]] * (6 - len(e)) for e in errors], np.int64)

    def _syndrome(self, word: np.ndarray) -> np.ndarray:
        return self.high[word >> 11] ^ (word & 0x7FF)

    def keys(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of nearby codewords, six a word, the own one first; of fewer, the own one repeats."""
        s = self._syndrome(word)
        return (word[:, None] ^ self.errors[s]) >> 11, self.count[s]


def keyed(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints, and the position of each key's fingerprint."""
    words, near, n = [], [], []
    for low, width in _SEGMENTS:
        word = (prints >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
        k, count = golay.keys(word)
        words.append(word)
        near.append(k)
        n.append(count)
    slots, at = np.arange(6), np.arange(len(prints))
    keys, rows = [], []

    def add(scheme: int, values: np.ndarray, used: np.ndarray) -> None:
        keys.append((values | (scheme << 48))[used])
        rows.append(np.broadcast_to(at[:, None], values.shape)[used])

    for scheme, (i, j) in enumerate(combinations(range(3), 2)):
        own_i, own_j = near[i][:, :1], near[j][:, :1]
        add(scheme, own_i << 12 | near[j], slots < n[j][:, None])
        add(scheme, near[i] << 12 | own_j, (slots < n[i][:, None]) & (slots > 0))
    for i in range(3):
        j = (i + 1) % 3
        add(3 + i, words[i][:, None] << 12 | near[j], slots < n[j][:, None])
    return np.concatenate(keys), np.concatenate(rows)


def forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what differs in ``bits`` bits or fewer, directly or by way of others: stars, no pairs."""
    left, out = np.arange(len(prints)), []
    while len(left) > 1:
        first, left = left[0], left[1:]
        front = np.array([first])
        while len(front) and len(left):
            found = np.zeros(len(left), bool)
            for at in range(0, len(front), 256):
                apart = np.bitwise_count(prints[front[at:at + 256], None] ^ prints[None, left])
                found |= (apart <= bits).any(axis=0)
            front, left = left[found], left[~found]
            out.extend((int(first), int(k)) for k in front)
    return out


def _link(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted)."""
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(cuts)
    small = np.repeat(sizes <= 8, sizes)
    a, b = [], []
    for shift in range(1, min(8, len(keys))):
        close = (keys[shift:] == keys[:-shift]) & small[shift:]
        close &= np.bitwise_count(prints[shift:] ^ prints[:-shift]) <= bits
        a.append(prints[:-shift][close])
        b.append(prints[shift:][close])
    for k in np.flatnonzero(sizes > 8):
        group = np.unique(prints[cuts[k]:cuts[k + 1]])
        if found := forest(group, bits):
            x, y = np.array(found).T
            a.append(group[x])
            b.append(group[y])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


def _linker(bits: int, block: int):
    """Streams rows (key, simhash), sorted by key: gives links (key null), and rows of groups above ``block`` as they are
    (key, fingerprint, number in the group)."""
    names = ["key", "a", "b"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        put_off, number = None, 0  # the large group that is passing by

        def linked(k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            a, b = (x.view(np.int64) for x in _link(k, p, bits))
            return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=names)

        def passed(p: np.ndarray) -> pa.RecordBatch:
            n = np.arange(number, number + len(p), dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(p), put_off)), pa.array(p.view(np.int64)), pa.array(n)], names=names)

        for batch in batches:
            keys = np.concatenate((keys, batch["key"].to_numpy(zero_copy_only=False)))
            prints = np.concatenate((prints, batch["simhash"].to_numpy(zero_copy_only=False).view(np.uint64)))
            if put_off is not None:
                end = int(np.searchsorted(keys, put_off, side="right"))
                yield passed(prints[:end])
                number += end
                if end == len(keys):
                    keys, prints = keys[:0], prints[:0]
                    continue
                keys, prints, put_off = keys[end:], prints[end:], None
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            large = _above(keys[:last], block)
            yield linked(keys[:last][~large], prints[:last][~large])
            for value in np.unique(keys[:last][large]):
                put_off, number = value, 0
                yield passed(prints[:last][keys[:last] == value])
                put_off = None
            keys, prints = keys[last:], prints[last:]
            if len(keys) > block:
                put_off, number = keys[0], 0
                yield passed(prints)
                number = len(prints)
                keys, prints = keys[:0], prints[:0]
        if len(keys):
            yield linked(keys, prints)

    return link


def _above(keys: np.ndarray, block: int) -> np.ndarray:
    if not len(keys):
        return np.zeros(0, bool)
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(cuts)
    return np.repeat(sizes > block, sizes)


def links(prints: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect all distinct fingerprints (column simhash) that differ in ``bits`` bits or fewer."""
    if not 0 <= bits <= 4:
        raise ValueError("the keys find links of up to four bits")
    spark = prints.sparkSession

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batch_rows(batches, 4096):
            own = batch["simhash"].to_numpy(zero_copy_only=False)
            keys, rows = keyed(own.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows])], names=["key", "simhash"])

    rows = prints.select("simhash").mapInArrow(spell, "key long, simhash long")
    rows = rows.repartition(partitions(spark), "key").sortWithinPartitions("key")
    found = materialize(rows.mapInArrow(_linker(bits, block), "key long, a long, b long"), "simhash-links")
    large = found.where("key is not null").select("key", F.col("a").alias("simhash"), (F.col("b") / block).cast("long").alias("x"))
    blocks = large.groupBy("key").agg((F.max("x") + 1).alias("blocks"))
    pairs = large.join(blocks, "key").withColumn("y", F.explode(F.expr("sequence(0L, blocks - 1)")))
    # a pair of blocks has a number of its own; both of its blocks meet under it
    pairs = pairs.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "simhash")
    pairs = pairs.repartition(partitions(spark), "key").sortWithinPartitions("key")
    # 2^62: a group of two blocks is never put off again
    rest = pairs.mapInArrow(_linker(bits, 1 << 62), "key long, a long, b long")
    return found.where("key is null").union(rest).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, root (a fingerprint of the component), mark (hash of the text)
    of every row.

    component_id is the smallest doc_id among all rows that links of ``bits`` bits or fewer reach, the row's own
    included.  Texts without a word (null ones too) have fingerprint zero and are linked like any other.  A row
    without doc_id belongs to its component, whose id is null only if no row of it has one.  Repeated rows stay repeated,
    an empty table gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, words), "simhash")
    nodes = materialize(prints.groupBy("simhash").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes, bits)).withColumnsRenamed({"node": "simhash"})
    named = nodes.join(roots, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    named = named.select("simhash", "root", "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("simhash", "root", "component_id")
    out = prints.join(named, "simhash")
    digits = F.lower(F.lpad(F.hex("simhash"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id", "root", "mark")


def keep_one(docs: DataFrame, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, one for each component: that of the smallest doc_id (rows without one come last, then by
    the hash of the text; of rows equal in both, any one).  All columns stay."""
    return keep_first(docs, materialize(near_duplicates(docs, bits, words), "simhash-classes"))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs``, one for each root of ``found`` (doc_id, mark, root of every row)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark"))
    keep = found.groupBy("root").agg(first.alias("best")).select("best.doc_id", "best.mark")
    marked = docs.withColumn("__mark", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    on = marked["doc_id"].cast("long").eqNullSafe(keep["doc_id"]) & (marked["__mark"] == keep["mark"])
    kept = marked.join(keep, on, "left_semi")
    # rows that agree in doc_id and text are rare; only these are brought together
    twice = found.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "mark")
    if twice.isEmpty():
        return kept.drop("__mark")
    same = kept["doc_id"].cast("long").eqNullSafe(twice["doc_id"]) & (kept["__mark"] == twice["mark"])
    single = kept.join(twice, same, "left_anti")
    double = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__mark"])
    return single.unionByName(double).drop("__mark")

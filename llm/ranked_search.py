"""Ranked lexical search over bit-sliced Bloom signatures.

``build`` turns documents into blocks of up to 1,024 rows of like size.  A document's signature is a Bloom filter over (term, step):
a term that occurs tf times enters all steps 1, 2, 3, 4, 6, 8, 12, ... up to tf.  A block keeps its signatures as slices: one
bitmap over its documents for each bit.  ``build`` also counts in how many documents each term occurs.

``search`` reads, for each term of the items, the bitmaps of its bits and intersects them, step by step.  A Bloom filter never
misses a term, so the last step found gives the largest tf that a document may have, and the weighted sum over an item's terms is an
upper bound of the document's score.  The documents with the largest bounds are scored from their texts first; the
score of the last of the best ones is a floor.  A second pass names every document whose bound reaches the floor of the
item, however many there are, and all of these are scored from their texts.  What is left out is proven to score less.

Signatures are as wide as the document needs up to WIDEST bits; beyond that they are only fuller, so bounds get looser.
Items go through in blocks of about ITEMS, for which the index is read once each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import batch_rows, materialize, texts

TOP = 20
SEEDS = 64  # documents per item that are scored for the floor
ITEMS = 1024
WIDEST = 1 << 20
PROBES = 4
BITS = 8  # of a signature for each key, at least
INDEX = ("kind string, width int, doc_ids array<long>, lengths array<long>, most array<long>, slices binary, term binary, df long")

_ROWS = 1024
_CELLS = 1 << 26  # bits in one block
_TERMS = 1 << 18  # terms that a task counts before it sends them on
_STEPS = np.array(sorted({1, *(2 ** k for k in range(1, 40)), *(3 * 2 ** k for k in range(40))}), np.int64)
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z is lower-cased."""
    return text.encode().translate(_TABLE).split()


def _hashes(words) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


def _places(hashes: np.ndarray, step: np.ndarray, width: int) -> np.ndarray:
    """The PROBES bits of each (term, step), one row each."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15) * (step.astype(np.uint64) + np.uint64(1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    first, by = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return np.stack([(first + np.uint64(k) * by) & np.uint64(width - 1) for k in range(PROBES)]).astype(np.int64)


class _Block:
    """Documents whose signatures have one width."""

    def __init__(self, width: int):
        self.width = width
        self.rows = max(8, min(_ROWS, _CELLS // width))
        self.bits = np.zeros((width, self.rows // 8), np.uint8)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.most: list[int] = []

    def add(self, doc_id: int | None, length: int, most: int, places: np.ndarray) -> bool:
        """Whether the block is full now."""
        at = len(self.ids)
        self.bits[places, at >> 3] |= np.uint8(128 >> (at & 7))
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.most.append(most)
        return at + 1 == self.rows

    def row(self) -> dict:
        used = self.bits[:, :-(-len(self.ids) // 8)]
        return {"kind": "block", "width": self.width, "doc_ids": self.ids, "lengths": self.lengths, "most": self.most,
                "slices": used.tobytes(), "term": None, "df": None}


_ARROW = pa.schema([("kind", pa.string()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                    ("most", pa.list_(pa.int64())), ("slices", pa.binary()), ("term", pa.binary()), ("df", pa.int64())])


def _term_rows(found: Counter) -> pa.RecordBatch:
    n = len(found)
    empty = [pa.nulls(n, f.type) for f in list(_ARROW)[1:6]]
    return pa.RecordBatch.from_arrays(
        [pa.array(["term"] * n, pa.string()), *empty, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
        schema=_ARROW)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    open_blocks: dict[int, _Block] = {}
    for batch in batch_rows(batches, 512):
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = terms(text)
            if not words:
                continue
            counts = Counter(words)
            found.update(counts.keys())
            tf = np.fromiter(counts.values(), np.int64, len(counts))
            steps = np.searchsorted(_STEPS, tf, side="right")
            keys = int(steps.sum())
            width = max(64, min(WIDEST, 1 << (BITS * keys - 1).bit_length()))
            step = np.arange(keys) - np.repeat(np.cumsum(steps) - steps, steps)
            block = open_blocks.get(width) or open_blocks.setdefault(width, _Block(width))
            if block.add(doc_id, len(words), int(tf.max()), _places(np.repeat(_hashes(counts), steps), step, width)):
                yield pa.RecordBatch.from_pylist([open_blocks.pop(width).row()], schema=_ARROW)
            if len(found) >= _TERMS:
                yield _term_rows(found)
                found = Counter()
    for block in open_blocks.values():
        yield pa.RecordBatch.from_pylist([block.row()], schema=_ARROW)
    if found:
        yield _term_rows(found)


def build(docs: DataFrame) -> DataFrame:
    """The index, written to the shared folder: rows of kind ``block`` (slices of signatures) and ``term`` (partial document
    counts).  Documents without terms are not in it."""
    rows = texts(docs).select(F.col("doc_id").cast("long"), "text")
    return materialize(rows.mapInArrow(_built, INDEX), "signatures")


@dataclass
class _Items:
    """A block of items: their keys, and which terms each holds how often."""

    n: int  # documents with terms
    total: int  # their terms
    keys: list[int]
    words: list[bytes]
    weights: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]  # per item: numbers of terms, weight times occurrences

    def bounds(self, block: dict) -> Iterator[tuple[int, np.ndarray]]:
        """(item's place, upper bound of each document's score)."""
        docs = len(block["lengths"])
        bits = np.frombuffer(block["slices"], np.uint8).reshape(block["width"], -1)
        hashes = _hashes(self.words)
        level = np.zeros((len(hashes), docs), np.int8)
        alive, present = np.arange(len(hashes)), None
        highest = int(np.searchsorted(_STEPS, max(block["most"]), side="right"))
        for step in range(highest):
            places = _places(hashes[alive], np.array([step]), block["width"])
            both = bits[places[0]]
            for p in places[1:]:
                both &= bits[p]
            if present is not None:
                both &= present
            some = both.any(axis=1)
            alive, present = alive[some], both[some]
            if not len(alive):
                break
            level[alive] += np.unpackbits(present, axis=1, count=docs).view(np.int8)
        m = 100 - 25 + 25 * np.array(block["lengths"], np.int64) * self.n // self.total
        tf = np.minimum(np.append(0, _STEPS[1:highest + 1] - 1)[:, None], np.array(block["most"], np.int64)[None, :])
        gain = 1_000_000_000 * tf // (1000 * tf + 12 * m[None, :])
        across = np.arange(docs)
        for k, (numbers, weights) in enumerate(self.parts):
            yield k, weights @ gain[level[numbers], across] if len(numbers) else np.zeros(docs, np.int64)

    def scores(self, text: str, items: list[int]) -> Iterator[tuple[int, int]]:
        """(key, score) of the items, given by their places."""
        words = terms(text)
        counts = Counter(words)
        m = 100 - 25 + 25 * len(words) * self.n // self.total
        for k in items:
            numbers, weights = self.parts[k]
            tfs = [counts.get(self.words[t], 0) for t in numbers.tolist()]
            yield self.keys[k], sum(w * (1_000_000_000 * tf // (1000 * tf + 12 * m)) for w, tf in zip(weights.tolist(), tfs, strict=True) if tf)


def _best(rows: DataFrame, score: str, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(score), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _largest(blocks: DataFrame, items: _Items, seeds: int) -> DataFrame:
    """item (its place in the block of items), doc_id, bound: the largest bounds per item and task."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int | None]]] = [[] for _ in items.keys]
        for batch in batch_rows(batches, 1):
            block = batch.to_pylist()[0]
            for k, bound in items.bounds(block):
                least = max(1, best[k][-1][0] if len(best[k]) >= seeds else 1)
                some = np.flatnonzero(bound >= least)
                if len(some) > seeds:
                    some = some[np.argpartition(-bound[some], seeds)[:seeds]]
                best[k] += [(int(bound[d]), block["doc_ids"][d]) for d in some.tolist()]
                best[k] = sorted(best[k], key=lambda x: -x[0])[:seeds]
        rows = [(k, doc_id, bound) for k, some in enumerate(best) for bound, doc_id in some]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3,
                                                                         (pa.int32(), pa.int64(), pa.int64()), strict=True)],
                                         names=["item", "doc_id", "bound"])

    return blocks.mapInArrow(found, "item int, doc_id long, bound long")


def _reaching(blocks: DataFrame, items: _Items, floors: np.ndarray) -> DataFrame:
    """doc_id, items: the documents whose bound reaches the floor of an item, and the places of these items."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(batches, 1):
            block = batch.to_pylist()[0]
            of: list[list[int]] = [[] for _ in block["lengths"]]
            for k, bound in items.bounds(block):
                for d in np.flatnonzero(bound >= floors[k]).tolist():
                    of[d].append(k)
            some = [d for d, places in enumerate(of) if places]
            yield pa.RecordBatch.from_arrays([pa.array([block["doc_ids"][d] for d in some], pa.int64()),
                                              pa.array([of[d] for d in some], pa.list_(pa.int32()))], names=["doc_id", "items"])

    return blocks.mapInArrow(found, "doc_id long, items array<int>")


def _scored(docs: DataFrame, wanted: DataFrame, items: _Items) -> DataFrame:
    """item (its key), doc_id, score above 0 of the documents in ``wanted`` (doc_id, items), from their texts."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(batches, 256):
            rows = [(key, doc_id, score)
                    for doc_id, text, some in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "items")), strict=True)
                    for key, score in items.scores(text, some) if score > 0]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)],
                                             names=["item", "doc_id", "score"])

    wanted = wanted.select(F.col("doc_id").alias("wanted_id"), "items")
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.expr("doc_id <=> wanted_id"))
    return rows.select("doc_id", "text", "items").mapInArrow(found, "item long, doc_id long, score long")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, word, times) for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True)
                for word, times in Counter(terms(text)).items()]
        types = (pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, types, strict=True)],
                                         names=["key", "term", "times"])


def _loaded(rows: list, n: int, total: int) -> _Items:
    """rows: (key, term, times, df) of one block of items."""
    words = sorted({bytes(r["term"]) for r in rows})
    number = {w: k for k, w in enumerate(words)}
    df = {bytes(r["term"]): r["df"] for r in rows}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) for w in words], np.int64)
    keys = sorted({r["key"] for r in rows})
    place = {key: k for k, key in enumerate(keys)}
    parts: list[list[tuple[int, int]]] = [[] for _ in keys]
    for r in rows:
        t = number[bytes(r["term"])]
        parts[place[r["key"]]].append((t, int(weights[t]) * r["times"]))
    return _Items(n, total, keys, words, weights, [tuple(np.array(p, np.int64).reshape(-1, 2).T) for p in parts])


def search(docs: DataFrame, index: DataFrame, items: DataFrame, top: int = TOP, seeds: int = SEEDS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with a score above 0 of each row of ``items`` (item_id, text).

    Equal scores go by ascending doc_id, a null one first; rows of ``docs`` that share a doc_id are ranked each on its own.
    Null and empty texts have no terms; items without terms in the documents, and empty tables, give no rows; repeated rows
    of ``items`` are ranked each on its own; other columns are ignored.
    """
    spark = docs.sparkSession
    n_blocks = max(1, -(-items.count() // ITEMS))
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("key"))
    asked = materialize(asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n_blocks))), "items")
    asked_terms = materialize(asked.select("key", "text").mapInArrow(_item_terms, "key long, term binary, times long"), "item-terms")
    blocks = index.where("kind = 'block'").select("width", "doc_ids", "lengths", "most", "slices")
    size = blocks.select(F.size("doc_ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))
    n, total = size.agg(F.sum("n"), F.sum("total")).first()
    held = index.where("kind = 'term'").join(asked_terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    asked_terms = materialize(asked_terms.join(held, "term").join(asked.select("key", "part"), "key"), "weighed-terms")
    found = None
    for part in range(n_blocks):
        rows = asked_terms.where(F.col("part") == part).select("key", "term", "times", "df").collect()
        if not rows:
            continue
        block = _loaded(rows, n, total)
        first = _best(_largest(blocks, block, seeds), "bound", seeds)
        first = materialize(first.groupBy("doc_id").agg(F.collect_list("item").alias("items")), "seeds")
        last = _best(_scored(docs, first, block), "score", top).where(F.col("rank") == top).select("item", "score").collect()
        floor = {r["item"]: r["score"] for r in last}
        floors = np.array([floor.get(key, 1) for key in block.keys], np.int64)
        wanted = materialize(_reaching(blocks, block, floors).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")),
                             "candidates")
        best = materialize(_best(_scored(docs, wanted, block), "score", top), "ranked")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.join(asked.select(F.col("key").alias("item"), "item_id"), "item").select(
        F.col("item_id").cast("long"), F.col("rank").cast("int"), "doc_id", "score")

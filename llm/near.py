"""Near copies with verified likeness: candidates by SimHash and by MinHash bands, decided by Jaccard on five-word shingles.

Every text becomes a node: equal shingle sets (by a 64-bit hash of the sorted set) are one node, however many copies there are.
Two searches give loose links.  The SimHash one finds fingerprints within four bits by their Golay keys (``simhash.links``).
It meets few pairs of likeness 0.8, which differ in about ten bits, so MinHash bands are a second one: nodes with an equal
band meet, and are linked where at most ``APART`` of 128 one-bit lanes differ.  Both stream sorted keys and
keep a spanning forest of each bucket, never its pairs; buckets above ``BLOCK`` are dealt in pairs of blocks.

Loose links only say which texts belong together.  Each connected group then meets once with its texts, large ones in pairs of
blocks of hashed ids, and all its pairs are compared exactly; of these come a count of links, the first linked document and a
local class for each node, never the pairs.  Two texts of likeness 0.8 or more go unseen with a probability below 0.0003.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import minhash, simhash
from llm.common import batch_rows, materialize, partitions, texts
from llm.components import components

THRESHOLD = 0.8
APART = 28  # of 128 one-bit lanes; likeness 0.8 differs in 12.8, with a deviation of 3.4
BLOCK = 2048
MEMBERS, SHINGLES = 1024, 4_000_000  # of one block of texts
_PRINTS = "doc_id long, mark long, node long, size long, simhash long, low long, high long, bands array<long>"


def majority(hashes: np.ndarray) -> int:
    """The SimHash of hashed shingles: a bit is 1 if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), simhash.CHUNK):
        part = np.ascontiguousarray(hashes[at:at + simhash.CHUNK], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), node, size (of the shingle set), simhash, the 128 one-bit lanes, bands of every row."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(batches, 512):
            out = []
            for text in batch["text"].to_pylist():
                hashes = minhash.shingles(minhash.word_hashes(text.encode()))
                own = np.unique(hashes)
                lanes = minhash.lanes(minhash.lowest(own))
                bits = np.packbits((lanes & 1).astype(bool)).view(np.int64)
                bands = [xxhash.xxh64_intdigest(part.tobytes(), k) - (1 << 63)
                         for k, part in enumerate(np.split(lanes[:minhash.BANDS * minhash.ROWS], minhash.BANDS))]
                out.append((xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), len(own), majority(hashes), *bits.tolist(), bands))
            node, size, found, low, high, bands = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["mark"], pa.array(node, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(np.array(found, np.uint64).view(np.int64)), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))], names=[f.split()[0] for f in _PRINTS.split(", ")])

    rows = texts(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(sketch, _PRINTS)


def _runs(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of whole runs of equal keys (first column, sorted), with -1; runs above ``block`` apart, each part with the number
    of its first row in the run."""
    held, passing, number = None, None, 0
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if passing is not None:
            end = int(np.searchsorted(rows[:, 0], passing, side="right"))
            if end:
                yield number, rows[:end]
            number += end
            rows = rows[end:]
            if not len(rows):
                continue
            passing = None
        held = rows if held is None else np.concatenate((held, rows))
        if not len(held):
            continue
        last = int(np.searchsorted(held[:, 0], held[-1, 0], side="left"))
        yield from _parted(held[:last], block)
        held = held[last:]
        if len(held) > block:
            passing, number = held[0, 0], len(held)
            yield 0, held
            held = held[:0]
    if held is not None:
        yield from _parted(held, block)


def _parted(rows: np.ndarray, block: int) -> Iterator[tuple[int, np.ndarray]]:
    if not len(rows):
        return
    large = simhash._above(rows[:, 0], block)
    yield -1, rows[~large]
    for key in np.unique(rows[large, 0]):
        yield 0, rows[rows[:, 0] == key]


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64) <= APART


def _loose(rows: np.ndarray) -> list[np.ndarray]:
    """Links (node, node) that connect the rows of each run whose lanes are close, directly or by way of others."""
    keys, nodes, lanes = rows[:, 0], rows[:, 1], rows[:, 2:]
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(cuts)
    small = np.repeat(sizes <= 8, sizes)
    out = []
    for shift in range(1, min(8, len(keys))):
        close = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:])
        close = close[_close(lanes[close], lanes[close + shift])]
        out.append(np.column_stack((nodes[close], nodes[close + shift])))
    for k in np.flatnonzero(sizes > 8):
        left = np.arange(cuts[k], cuts[k + 1])
        while len(left) > 1:
            first, left = left[0], left[1:]
            front = np.array([first])
            while len(front) and len(left):
                found = np.zeros(len(left), bool)
                for at in range(0, len(front), 256):
                    found |= _close(lanes[front[at:at + 256], None], lanes[None, left]).any(axis=0)
                front, left = left[found], left[~found]
                out.append(np.column_stack((np.full(len(front), nodes[first]), nodes[front])))
    return out


def _linker(block: int):
    names = ["key", "a", "b", "low", "high"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _runs(batches, block):
            if number < 0:
                found = np.concatenate([np.zeros((0, 2), np.int64), *_loose(rows)]) if len(rows) else np.zeros((0, 2), np.int64)
                none = pa.nulls(len(found), pa.int64())
                columns = [none, pa.array(found[:, 0]), pa.array(found[:, 1]), none, none]
            else:
                place = np.arange(number, number + len(rows), dtype=np.int64)
                columns = [pa.array(c) for c in (rows[:, 0], rows[:, 1], place, rows[:, 2], rows[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return link


def band_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect the nodes that share a band and differ in few lanes."""
    parts = partitions(nodes.sparkSession)
    names = ["key", "node", "low", "high"]
    rows = nodes.select(F.explode("bands").alias("key"), "node", "low", "high")
    rows = rows.repartition(parts, "key").sortWithinPartitions("key")
    schema = "key long, a long, b long, low long, high long"
    found = materialize(rows.mapInArrow(_linker(block), schema), "band-links")
    large = found.where("key is not null").withColumn("x", (F.col("b") / block).cast("long"))
    blocks = large.groupBy("key").agg((F.max("x") + 1).alias("blocks"))
    pairs = large.join(blocks, "key").withColumn("y", F.explode(F.expr("sequence(0L, blocks - 1)")))
    pairs = pairs.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"), F.col("a").alias("node"), "low", "high")
    pairs = pairs.select(names).repartition(parts, "key").sortWithinPartitions("key")
    rest = pairs.mapInArrow(_linker(1 << 62), schema)
    return found.where("key is null").unionByName(rest).select("a", "b").distinct()


def simhash_links(nodes: DataFrame) -> DataFrame:
    """a, b: links that connect the nodes whose SimHash fingerprints are linked by their Golay keys, or equal."""
    first = materialize(nodes.groupBy("simhash").agg(F.min("node").alias("first"), F.count("*").alias("n")), "near-prints")
    equal = nodes.join(first.where("n > 1"), "simhash").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = simhash.links(first.select("simhash"))
    ends = found.join(first.select(F.col("simhash").alias("a"), F.col("first").alias("x")), "a")
    ends = ends.join(first.select(F.col("simhash").alias("b"), F.col("first").alias("y")), "b")
    return equal.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))


def compare(sets: list[np.ndarray], weights: np.ndarray, sides: np.ndarray, threshold: float
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sets of hashes, in order: the number of texts that each is linked with, the first set that it is linked with (-1:
    none before it), the likeness of that one, and the first set that links connect.  Sets of one side from 0 up are not
    compared with each other; those of side -1 are."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    at = np.concatenate(([0], np.cumsum(sizes)))
    distinct, dense = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(distinct), bool)
    links, first, likeness, label = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n), np.arange(n)
    for i in range(n - 1):
        held[dense[at[i]:at[i + 1]]] = True
        hit = owner[at[i + 1]:][held[dense[at[i + 1]:]]]
        held[dense[at[i]:at[i + 1]]] = False
        shared = np.bincount(hit - (i + 1), minlength=n - i - 1)
        total = sizes[i] + sizes[i + 1:] - shared
        alike = np.divide(shared, total, out=np.ones(len(total)), where=total > 0)
        linked = (alike >= threshold) & ((sides[i] < 0) | (sides[i + 1:] != sides[i]))
        others = np.flatnonzero(linked) + i + 1
        if not len(others):
            continue
        links[i] += weights[others].sum()
        links[others] += weights[i]
        new = others[first[others] < 0]
        first[new], likeness[new] = i, alike[new - i - 1]
        joined = np.unique(np.append(label[others], label[i]))
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return links, first, likeness, label


_FOUND = "node long, label long, links long, copy_of long, jaccard double"


def _comparer(threshold: float):
    """Streams rows (key, node, side, weight, least, text), sorted by key; gives what ``compare`` finds in each group."""
    def found(group: dict[int, tuple]) -> list[tuple]:
        rows = sorted(group.items(), key=lambda r: (r[1][2] is None, r[1][2] or 0, r[0]))
        nodes = [node for node, _ in rows]
        side, weight, least, sets = zip(*(r for _, r in rows), strict=True)
        links, first, likeness, label = compare(list(sets), np.array(weight), np.array(side), threshold)
        return [(nodes[k], nodes[label[k]], int(links[k]), least[first[k]] if first[k] >= 0 else None,
                 float(likeness[k]) if first[k] >= 0 else None) for k in np.flatnonzero(links)]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * 5
        types = [pa.int64()] * 4 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          names=[f.split()[0] for f in _FOUND.split(", ")])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}
        for batch in batch_rows(batches, 256):
            out = []
            for k, node, side, weight, least, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(group) > 1:
                        out += found(group)
                    key, group = k, {}
                if node not in group:  # a repeated row of the same id and text comes again
                    own = np.unique(minhash.shingles(minhash.word_hashes(text.encode())))
                    group[node] = (side, weight, least, own)
            yield batch_of(out)
        if len(group) > 1:
            yield batch_of(found(group))

    return verify


def classes(docs: DataFrame, threshold: float = THRESHOLD, use_simhash: bool = True, members: int = MEMBERS
            ) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, node) of all documents, and of all nodes (node, root, least, weight, links, copy_of, jaccard).

    Nodes of one root are connected by links of likeness ``threshold`` or more (0.8 at least, as the searches are made for
    it); least is a node's smallest doc_id (null: none has one), weight its rows, links the rows of other nodes that it is
    linked with, copy_of the smallest doc_id of these before its own.  A null text is empty; texts without a word are one node.
    Repeated rows count each; an empty table gives no rows, other columns are ignored.
    """
    if threshold < THRESHOLD:
        raise ValueError("the searches find likenesses of 0.8 and more")
    spark = docs.sparkSession
    rows = materialize(prints(docs), "near-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("best")
    nodes = rows.groupBy("node").agg(best, F.count("*").alias("weight"),
                                     F.min(F.struct("size", "simhash", "low", "high", "bands")).alias("own"))
    nodes = materialize(nodes.select("node", F.col("best.doc_id").alias("least"), "best.mark", "weight", "own.*"), "near-nodes")
    loose = band_links(nodes)
    if use_simhash:
        loose = loose.unionByName(simhash_links(nodes))
    groups = materialize(components(loose).withColumnRenamed("root", "family")
                         .join(nodes.select("node", "least", "mark", "weight", "size"), "node"), "near-families")
    cut = groups.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / members, F.sum("size") / SHINGLES)).alias("blocks"))
    dealt = groups.join(cut, "family").withColumn("blocks", F.greatest("blocks", F.lit(1).cast("long")))
    # written, so that Spark knows its size when it plans the join: few texts have a loose link
    dealt = materialize(dealt.withColumn("x", F.pmod(F.xxhash64("node"), "blocks")), "near-dealt")
    text = texts(docs).select(F.col("doc_id").cast("long").alias("__id"), "text", F.xxhash64("text").alias("__mark"))
    dealt = dealt.join(text, F.col("least").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))
    dealt = dealt.withColumn("y", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.select(F.xxhash64("family", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "node",
                         F.when(F.col("x") == F.col("y"), -1).otherwise(F.col("x")).alias("side"), "weight", "least", "text")
    dealt = dealt.repartition(partitions(spark), "key").sortWithinPartitions("key")
    found = materialize(dealt.mapInArrow(_comparer(threshold), _FOUND), "near-found")
    roots = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("copy_of").alias("copy_of"),
                                       F.min_by("jaccard", "copy_of").alias("jaccard"))
    out = nodes.select("node", "least", "weight").join(counts, "node", "left").join(roots, "node", "left")
    out = out.withColumns({"root": F.coalesce("root", "node"), "links": F.coalesce("links", F.lit(0))})
    return rows.select("doc_id", "mark", "node"), materialize(out, "near-classes")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, one for each class of near copies: that of the smallest doc_id (rows without one come last, then by
    the hash of the text; of rows equal in both, any one).  All columns stay."""
    rows, nodes = classes(docs, threshold)
    found = rows.join(nodes.select("node", "root"), "node").select("doc_id", "mark", "root")
    return simhash.keep_first(docs, materialize(found, "near-members"))


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links, copy_of, jaccard of every row.

    Signatures are cut into BANDS bands of ROWS lanes; texts with an equal band meet, and the Jaccard likeness of the five-word
    shingle sets decides about each two of them (``classes``).  n_links counts the other rows that are at least
    ``threshold`` alike, copies included; copy_of is the smallest doc_id of these if it is smaller than the row's own (null:
    none), jaccard its likeness, and class_id the smallest doc_id that such links connect.

    A null text is empty; texts without a word are copies of each other.  Rows without doc_id are left out; of rows that
    repeat a doc_id the text with the smallest hash counts.  An empty table gives no rows, other columns are ignored.
    """
    rows = texts(docs).select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    mark = F.xxhash64("text")
    chosen = rows.groupBy("doc_id").agg(F.min(mark).alias("least"), F.count("*").alias("n")).where("n > 1")
    other = rows.join(chosen.select("doc_id", "least"), "doc_id", "left").where(F.col("least").isNull() | (mark == F.col("least")))
    own, nodes = classes(other.select("doc_id", "text"), threshold, use_simhash=False)
    ids = nodes.groupBy("root").agg(F.min("least").alias("class_id"))
    found = own.join(nodes.join(ids, "root"), "node")
    again = F.col("doc_id") > F.col("least")  # an equal set has a smaller id
    closer = F.coalesce(F.col("copy_of") < F.col("least"), F.lit(False))
    return found.select(
        "doc_id", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"),
        F.when(again & ~closer, F.col("least")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(again & ~closer, 1.0).otherwise(F.col("jaccard")).alias("jaccard"))

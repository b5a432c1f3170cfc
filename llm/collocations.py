"""Phrases of two and three words whose words occur together far more often than apart.

Only one kind of window is counted: the longest one, three words, that starts at each word (its lead columns), padded where its
piece of the text ends.  A task counts the windows of many texts as sorted numbers, so that what it sends on is summed already.
All counts of shorter phrases are sums over the windows with that beginning; one Spark ROLLUP over (lang, first, second)
gives them, and its level of the language is the number of its words.  No shorter n-gram is ever exploded.

Windows are dealt by ranges of their words, whose borders come from a small sample (they change the speed alone).  Windows with
the same beginning so meet in one task, which sums them before the ROLLUP's exchange; those of a very frequent word or pair
spread over several ranges.  A rare pair that no border cuts goes no further than its task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import materialize

MIN_COUNT = 10  # occurrences that a phrase needs
SHARE = 50  # per cent of a phrase's occurrences that lie in one longer phrase and so drop it
TOP = 2000
LONGEST = 3
RANGES = 1024
SAMPLE = 2048  # documents, of each of which SPOTS windows at most help to set the borders
SPOTS = 32
WINDOWS = "part int, lang string, phrase string, f long"

_CHUNK = 1 << 24  # bytes of text whose windows a task sums at a time
_KINDS = 1 << 21  # three smaller numbers fit 64 bits
_ROWS = 1 << 16
_PAD = b"."  # a separator after translation, so never part of a word
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(_PAD) if b in _SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _prepared(text: str) -> bytes:
    """The text in lower case with blanks alone between words, and two pads behind each piece."""
    return text.encode().translate(_TABLE).replace(_PAD, b" . . ") + b" . . "


def _words(data: bytes) -> pa.Array:
    letters = np.frombuffer(data, np.uint8)
    inside = letters != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    offsets = np.zeros(len(edge) // 2 + 1, np.int64)
    np.cumsum(edge[1::2] - edge[::2], out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1,
                                            [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside])])


def _numbered(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The different words in order, and each word's number among them from 1 on; pads are 0."""
    coded = _words(data).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(order))
    pad = pc.index(names, pa.scalar(_PAD, pa.large_binary())).as_py()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    rank[order[pad]] = 0
    return pa.chunked_array([pa.array([None], pa.large_binary()), names]).combine_chunks(), rank[coded.indices.to_numpy()]


def window_counts(lang: str, data: bytes, borders: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The different windows of prepared texts in one language, in order, their numbers, and the range that each lies in."""
    names, ids = _numbered(data)
    first, second, third = ids[:-2], ids[1:-1], ids[2:]
    base, whole = len(names), first > 0
    pairs = (first * base + second)[whole]
    if base < _KINDS:
        keys, f = np.unique(pairs * base + third[whole], return_counts=True)
        pairs, third = np.divmod(keys, base)
    else:
        kinds, which = np.unique(pairs, return_inverse=True)
        keys, f = np.unique(which * base + third[whole], return_counts=True)
        which, third = np.divmod(keys, base)
        pairs = kinds[which]
    first, second = np.divmod(pairs, base)
    words = [w or b"" for w in names.to_pylist()]
    cuts = [_place(words, (first, second, third), _by_words(b)) for b in borders]
    part = np.searchsorted(cuts, np.arange(len(f)), side="right").astype(np.int32)
    names = names.cast(pa.large_string())
    for at in range(0, len(f), _ROWS):
        rows = slice(at, at + _ROWS)
        taken = [names.take(pa.array(x[rows])) for x in (first, second, third)]
        phrase = pc.binary_join_element_wise(*taken, pa.scalar(" ", pa.large_string()), null_handling="skip")
        langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(phrase), np.int32)), pa.array([lang])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(part[rows]), langs, phrase.cast(pa.string()), pa.array(f[rows])],
                                         names=["part", "lang", "phrase", "f"])


def _place(words: list[bytes], numbers: tuple[np.ndarray, ...], border: list[bytes]) -> int:
    """How many of the windows, which are in order, come before the border."""
    low, high = 0, len(numbers[0])
    for column, word in zip(numbers, border, strict=False):
        at = bisect.bisect_left(words, word)
        low, high = (low + int(np.searchsorted(column[low:high], at, side=s)) for s in ("left", "right"))
        if at == len(words) or words[at] != word:
            break
    return low


def _counted(batches: Iterator[pa.RecordBatch], borders: list[bytes]) -> Iterator[pa.RecordBatch]:
    parts: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            data = _prepared(text)
            at = 0
            while at < len(data):  # a text beyond a chunk is cut behind a piece
                end = data.find(b". . ", at + _CHUNK) + 4 if len(data) - at > _CHUNK else len(data)
                end = len(data) if end == 3 else end
                parts.setdefault(lang, []).append(data[at:end])
                size[lang] = size.get(lang, 0) + end - at
                at = end
                if sum(size.values()) >= _CHUNK:
                    largest = max(size, key=size.get)
                    del size[largest]
                    yield from window_counts(largest, b"".join(parts.pop(largest)), borders)
    for lang, data in parts.items():
        yield from window_counts(lang, b"".join(data), borders)


def _by_words(window: bytes) -> list[bytes]:
    return window.split(b" ")


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch["text"].to_pylist():
            words = _prepared(text).split()
            starts = [k for k, w in enumerate(words) if w != _PAD]
            found += [b" ".join(w for w in words[k:k + 3] if w != _PAD) for k in starts[::len(starts) // SPOTS + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["window"])


def borders(texts: DataFrame, ranges: int = RANGES) -> list[bytes]:
    """Windows that part all windows into about equal ranges, from a sample of documents; at most SAMPLE x SPOTS reach the
    driver in expectation."""
    n = texts.count()
    some = texts.select("text").sample(fraction=min(1.0, SAMPLE / n), seed=42) if n else texts
    found = sorted((bytes(r[0]) for r in some.mapInArrow(_spots, "window binary").collect()), key=_by_words)
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}, key=_by_words) if found else []


def leads(dealt: DataFrame, limits: list[bytes], min_count: int) -> DataFrame:
    """part, lang, w1, w2, f: sums of the windows of each range by their first two words.

    Only a pair that begins a border has windows in several ranges; any other one is whole in its range.  If it is too rare
    there, it counts for its first word alone, as a padded one does: w2 is null.
    """
    cut = [b" ".join(_by_words(b)[:2]).decode() for b in limits]
    pairs = dealt.groupBy("part", "lang", F.substring_index("phrase", " ", 2).alias("pair")).agg(F.sum("f").alias("f"))
    kept = (F.col("f") >= min_count) | F.col("pair").isin(cut)
    rows = pairs.select("part", "lang", F.substring_index("pair", " ", 1).alias("w1"),
                        F.when(kept, F.get(F.split("pair", " "), F.lit(1))).alias("w2"), "f")
    return rows.groupBy("part", "lang", "w1", "w2").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, words, phrase, f: all contiguous occurrences of each phrase of 1 to 3 words that has at least ``min_count``; the
    rows with no words have each language's number of words.

    One shuffle of summed windows, one of the words and those sums over two words that can reach ``min_count``.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    limits = borders(texts)
    dealt = texts.mapInArrow(lambda batches: _counted(batches, limits), WINDOWS).repartition("part")
    windows = dealt.groupBy("part", "lang", "phrase").agg(F.sum("f").alias("f"))
    # one condition over the sum too, so that it stays above it and both branches share one exchange
    longest = windows.where(F.when(F.col("f") >= min_count, F.size(F.split("phrase", " "))) == LONGEST).select(
        "lang", F.lit(LONGEST).alias("words"), "phrase", "f")
    level = F.grouping_id()  # 3: the language, 1: the first word, 0: two words, of which the second may be null
    shorter = leads(dealt, limits, min_count).rollup("lang", "w1", "w2").agg(F.sum("f").alias("f"), level.alias("level")).where(
        ((F.col("level") == 3) | (F.col("f") >= min_count)) & (F.col("level") < 7) & ((F.col("level") > 0) | F.col("w2").isNotNull()))
    shorter = shorter.select("lang", F.when(F.col("level") == 3, 0).when(F.col("level") == 1, 1).otherwise(2).alias("words"),
                             F.concat_ws(" ", "w1", "w2").alias("phrase"), "f")
    return longest.unionByName(shorter)


def _joined(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, l and r its parts at the cut with the lowest score floor(1,000,000 a a / (l r)), computed in
    38-digit decimals.  A phrase with ``share`` per cent or more of its occurrences in one longer phrase is dropped.  Equal
    scores go by a descending, then by the phrase's UTF-8 bytes.  A null lang is ``und``, a null text empty; repeated rows
    count each on its own; texts without words, and empty tables, give no rows; other columns are ignored.
    """
    counts = materialize(phrase_counts(docs, min_count), "phrases")
    found = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = found.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined(F.col("w"), 1, F.col("cut")).alias("left"),
                       _joined(F.col("w"), F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    parts = counts.where("words between 1 and 2")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])

    def wide(name: str) -> str:
        return f"cast({name} AS decimal(19, 0))"

    score = F.expr(f"(cast(1000000 AS decimal(7, 0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "a", "l", "r")).alias("best"))
    inner = found.where(F.col("words") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("at"))
    longer = inner.select("lang", _joined(F.col("w"), F.col("at"), 2).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.select("lang", "phrase", "best.*").join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

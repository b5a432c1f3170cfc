"""Token counts of whole documents by map-side lookups in two tiers.

Tier one is a compact table of frequent pre-tokens and their numbers of tokens, broadcast to all workers; its size is
bounded by ``table_entries``.  Tier two is a bounded cache in each worker for everything else, filled by the
tokenizer's library.  Pre-tokens are never shuffled: a document is counted where it is read.  The table is fitted
on a sample of at most about ``fit_rows`` documents.  It decides how fast a document is counted, never its count.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import batch_rows, byte_letters, load_tokenizer, one_cache, texts
from llm.stretches import stretches

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
FIT_ROWS = 4_000
FIT_TASKS = 8
TABLE_ENTRIES = 30_000
CACHE_ENTRIES = 700_000
#: Below this code point the pattern's classes are the same in the Unicode versions of both libraries (tests/llm).
_SAME_CLASSES_BELOW = "՘"


class TwoTierCounter:
    """Counts tokens of texts: the broadcast table first, then this worker's cache, then the library."""

    def __init__(self, path: str, frequent: dict[str, int], entries: int = CACHE_ENTRIES):
        self.tokenizer, self.frequent, self.entries = load_tokenizer(path), frequent, entries
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.pieces: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    def library(self, strings: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def piece(self, piece: str) -> int:
        """Tokens of one pre-token, by the library's model alone."""
        return len(self.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def __call__(self, text: str) -> int:
        if any(s in text for s in self.special):
            return self.library([text])[0]
        first, *rest = stretches(text)
        spaced = self.spaced
        try:
            n = sum([spaced[s] for s in rest])
        except KeyError:
            if len(spaced) > self.entries:
                spaced.clear()
            new = [s for s in dict.fromkeys(rest) if s not in spaced]
            spaced.update(zip(new, self.lengths([f" {s}" for s in new]), strict=True))
            n = sum([spaced[s] for s in rest])
        return n + (self.lengths([first])[0] if first else 0)

    def lengths(self, strings: list[str]) -> list[int]:
        """Lengths of stretches: sums over their pre-tokens, or the library's where the classes could differ."""
        if len(self.pieces) > self.entries:
            self.pieces.clear()
        frequent, kept = self.frequent, self.pieces
        cut = [self.find(s) if max(s) < _SAME_CLASSES_BELOW else None for s in strings]
        new = [p for p in dict.fromkeys(p for found in cut if found for p in found) if p not in frequent and p not in kept]
        kept.update((p, self.piece(p)) for p in new)
        return [self.library([s])[0] if found is None else sum([frequent.get(p) or kept[p] for p in found])
                for s, found in zip(strings, cut, strict=True)]


def frequent_lengths(docs: DataFrame, tokenizer: str, fit_rows: int = FIT_ROWS,
                     entries: int = TABLE_ENTRIES) -> tuple[str, bytes]:
    """The most frequent pre-tokens of a sample, joined by NUL, and their numbers of tokens, one byte each.

    Every task of the sample sends its ``entries`` most frequent ones; FIT_TASKS * entries bounds what the driver sees.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = regex.compile(public_tokenizers.PATTERN).findall, Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                seen.update(find(text))
            if len(seen) > 20 * entries:
                seen = Counter(dict(seen.most_common(10 * entries)))
        top = [x for x in seen.most_common(entries) if "\0" not in x[0]]
        lengths = TwoTierCounter(tokenizer, {}).library([p for p, _ in top])  # a pre-token is cut as itself
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()),
             pa.array(lengths, pa.int32())], names=["piece", "n", "length"])

    rows = max(1, docs.count())
    sample = texts(docs).select("text").sample(fraction=min(1.0, fit_rows / rows), seed=42)
    found = sample.repartition(FIT_TASKS).mapInArrow(count, "piece string, n long, length int").collect()
    total, length = Counter(), {}
    for r in found:
        total[r["piece"]] += r["n"]
        length[r["piece"]] = r["length"]
    top = sorted(total, key=lambda p: (-total[p], p))[:entries]
    top = [p for p in top if length[p] < 256]
    return "\0".join(top), np.array([length[p] for p in top], np.uint8).tobytes()


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every document.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library.  A null text is empty and has no token; repeated
    rows are counted each on its own; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    compact = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer, fit_rows))
    name = f"counts {uuid.uuid4().hex}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> TwoTierCounter:
            joined, lengths = compact.value
            return TwoTierCounter(tokenizer, dict(zip(joined.split("\0"), lengths, strict=True)) if lengths else {})

        counter = one_cache(name, make)
        for batch in batch_rows(batches, 256):
            found = [(len(t.encode()), counter(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64()),
                 pa.array([n > limit for _, n in found], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(count, SCHEMA)

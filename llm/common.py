"""Helpers that the operators of this package share."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.session import materialize, own_scratch, scratch_path, ship_packages

_ROOT = Path(__file__).resolve().parent.parent

__all__ = ["batch_rows", "byte_letters", "load_ranks", "load_tokenizer", "materialize", "once", "one_cache", "partitions", "prepare",
           "scratch_path", "table", "texts"]


def prepare(spark: SparkSession) -> None:
    """Make the packages importable on the workers; name a folder for intermediate tables where none is set."""
    own_scratch(spark)
    ship_packages(spark, _ROOT / "spanledger", _ROOT / "catalog", _ROOT / "llm")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are; a null text is empty."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch_rows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Smaller record batches, so that what a task builds per batch stays small with long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_LOADED: dict[str, object] = {}


def once(key: str, make: Callable[[], object]) -> object:
    """Make a worker's object once per Python process."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


_CACHE: list = ["", None]


def one_cache(key: str, make: Callable[[], object]) -> object:
    """The object of this name that a worker keeps between tasks.  A worker keeps one: another name's takes its place, so
    that the caches of earlier queries and stages don't add up."""
    if _CACHE[0] != key:
        _CACHE[:] = ["", None]
        _CACHE[:] = [key, make()]
    return _CACHE[1]


def load_tokenizer(path: str):
    """A tokenizer of the tokenizers library, single-threaded: Spark runs a task for every core."""
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    return once(f"tokenizer {path}", make)


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in
    order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 0x100 + k for k, b in enumerate(hidden)}


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a base64 token and its rank on each line."""
    def make():
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}

    return once(f"ranks {path}", make)

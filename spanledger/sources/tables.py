"""CSV and parquet tables: readers with explicit schemas, plain writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanledger.session import materialize

REPORTS = T.StructType([T.StructField("patient_filename", T.StringType()), T.StructField("text", T.StringType())])
OVERLAP = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("gold", T.StringType())])
BASELINE = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("gold", T.StringType()), T.StructField("baseline_prediction", T.StringType()),
    T.StructField("baseline_confidence", T.DoubleType()), T.StructField("baseline_correct", T.BooleanType()),
    T.StructField("input_token_count", T.IntegerType()), T.StructField("was_truncated", T.BooleanType()),
])


def registry_schema(target: str) -> T.StructType:
    names = ("case_submitter_id", f"ajcc_pathologic_{target.lower()}", "project_id")
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _csv(spark: SparkSession, path: str, schema: T.StructType, *, multi_line: bool) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
        .option("escape", '"').csv(path)
    )


def with_file_order(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Add a column that orders rows as they stand in their files.

    Splits are read top to bottom, so file, split start and the running id inside the split order
    the rows whatever the partitioning.
    """
    return df.withColumn(name, F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    ))


_PIECE = "file string, start long, kind string, record string"
_ROWS = 1024


def _inside_quotes(lines: DataFrame) -> set[tuple[str, int]]:
    """The byte ranges (file, start) that begin within a quoted value: an odd number of quotes stands before them.

    One row per range is counted, so what reaches the driver is one entry for each such range of 128 MB.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    odd = ranges.withColumn("before", before).filter("before % 2 = 1")
    return {(r["file"], r["start"]) for r in odd.select("file", "start").collect()}


def _pieces(inside: set[tuple[str, int]]):
    """Cut the lines of each range into records; what reaches across its ends comes out as fragments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, held, opened, first, leading = None, [], False, False, False

        def rest():
            return [(*key, "middle" if leading else "tail", "\n".join(held))] if held else []

        for batch in batches:
            for file, start, value in zip(*(batch[c].to_pylist() for c in ("file", "start", "value")), strict=True):
                if key != (file, start):
                    out += rest()
                    key, held = (file, start), []
                    opened = leading = key in inside
                    first = start == 0
                held.append(value)
                opened ^= value.count('"') % 2
                if opened:
                    continue
                record = "\n".join(held)
                if leading:
                    out.append((*key, "head", record))
                elif not first and record not in ("", "\r"):
                    out.append((*key, "whole", record))
                held, leading, first = [], False, False
                if len(out) >= _ROWS:
                    yield _batch(out)
                    out = []
        yield _batch(out + rest())

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    types = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                      names=["file", "start", "kind", "record"])


def read_multi_line(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header whose quoted values may hold line breaks, read in parallel.

    Files are read in the byte ranges of plain lines.  The number of quotes before a range tells whether it begins inside
    a value; with that, each range finds its records alone.  A record that reaches across ranges is put together from its
    fragments.  Quotes inside a value are doubled, so they don't change the parity; an unquoted value holds none.  Records are
    written once to the shared folder, columns are parsed from there.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    pieces = materialize(lines.mapInArrow(_pieces(_inside_quotes(lines)), _PIECE), "csv-records")
    whole = pieces.filter("kind = 'whole'").select("record")
    order = F.struct("start", F.when(F.col("kind") == "tail", 1).otherwise(0).alias("late"))
    number = F.count_if(F.col("kind") == "tail").over(Window.partitionBy("file").orderBy(order))
    cut = pieces.filter("kind <> 'whole'").withColumn("number", number).groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("order"), "record"))).alias("parts"))
    joined = cut.select(F.array_join(F.col("parts.record"), "\n").alias("record"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = F.from_csv(F.rtrim("record", F.lit("\r")), F.lit(ddl), {"escape": '"', "multiLine": "true"})
    return whole.unionByName(joined).select(parsed.alias("r")).select("r.*")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report CSV; texts may hold line breaks."""
    return read_multi_line(spark, path, REPORTS)


def read_registry(spark: SparkSession, path: str, target: str) -> DataFrame:
    """One registry CSV in file order."""
    return with_file_order(_csv(spark, path, registry_schema(target), multi_line=False))


def read_overlap(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Overlap lists of all targets as one table with a target column."""
    parts = [_csv(spark, p, OVERLAP, multi_line=False).withColumn("target", F.lit(t)) for t, p in paths.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def read_baseline(spark: SparkSession, path: str, system: str = "baseline") -> DataFrame:
    """Baseline classifier predictions in the common long form; a baseline never abstains."""
    return baseline_long(_csv(spark, path, BASELINE, multi_line=False), system)


def baseline_long(table: DataFrame, system: str = "baseline") -> DataFrame:
    return table.select(
        "case_id", "target", F.lit(system).alias("system"), "gold",
        F.col("baseline_prediction").alias("prediction"), F.col("baseline_prediction").alias("prediction_raw"),
        F.col("baseline_correct").alias("correct"), F.lit(False).alias("abstained"),
        "baseline_confidence", "input_token_count", "was_truncated",
    )


def write_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """CSV with header; blanks at the ends of values stay.  ``single_file`` is for small reports."""
    out = df.coalesce(1) if single_file else df
    (
        out.write.mode("overwrite").option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)

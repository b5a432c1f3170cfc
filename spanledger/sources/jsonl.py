"""JSON lines and JSON arrays: record tables, audit sheets, checkpoints, judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanledger.operators.records import RECORD_COLUMNS
from spanledger.sources.tables import with_file_order

RECORD = (
    "case_id string, arm string, target string, ground_truth string, prediction string, evidence string, "
    "correct boolean, abstained boolean, evidence_span_found boolean, "
    "evidence_semantically_supports_prediction boolean, errors array<string>, "
    "raw_model_output map<string,string>"
)
FIELD = "struct<value:string,evidence:string,confidence:string,reason:string>"
EXTRACTION = f"struct<T_stage:{FIELD},N_stage:{FIELD},M_stage:{FIELD},pathologic_stage:{FIELD}>"
CHECKPOINT = f"case_id string, arm string, invalid boolean, raw string, extraction {EXTRACTION}"
REVIEWER = (
    "audit_id string, target string, report_excerpt string, report_truncated boolean, prediction string, "
    "evidence string, human_evidence_span_found boolean, human_semantic_support boolean, "
    "human_prediction_correct boolean, human_source_has_explicit_stage boolean, "
    "human_source_has_inferential_evidence boolean, human_source_sufficient_for_stage boolean, "
    "human_confidence string, human_error_type string, reviewer_notes string"
)
KEY = (
    "audit_id string, case_id string, arm string, target string, ground_truth string, prediction string, "
    "automated_evidence_span_found boolean, automated_semantic_support boolean, "
    "automated_errors array<string>, arm_pattern string"
)
JUDGMENT = "case_id string, reconstructed_tag string, caveat string"
ANSWER = "case_id string, arm string, patient_id string, pipeline_tag string"


def write_lines(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """One JSON object per line, NULL fields written out."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Record lines; blank lines and unknown keys are skipped, a broken line fails.

    Old files have ``supported`` in place of ``evidence_span_found``.  It stands in only when the new
    key is absent, so an explicit null of a new file stays null.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(
        F.from_json("value", f"{RECORD}, supported boolean", {"mode": "FAILFAST"}).alias("r"),
        F.array_contains(F.json_object_keys("value"), "evidence_span_found").alias("current"),
    )
    span = F.when(F.col("current"), F.col("r.evidence_span_found")).otherwise(F.col("r.supported"))
    columns = {c: F.col(f"r.{c}") for c in RECORD_COLUMNS} | {"evidence_span_found": span}
    return parsed.select(*(c.alias(name) for name, c in columns.items()))


def read_audit(spark: SparkSession, path: str, *, key: bool = False, with_gold: bool = False) -> DataFrame:
    """Reviewer or key sheet with its schema stated, in file order (``row_no``) for the key."""
    schema = KEY if key else REVIEWER + (", ground_truth string" if with_gold else "")
    df = spark.read.schema(schema).json(path)
    return with_file_order(df) if key else df


def read_array(spark: SparkSession, path: str, schema: str, *, multi_line: bool = True) -> DataFrame:
    """Objects out of JSON arrays: one array per file, or one per line if not ``multi_line``."""
    rows = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True)
    return rows.json(path)


def write_arrays(df: DataFrame, path: str, *, rows_per_array: int = 1000, one_per_file: bool = False) -> None:
    """Rows as JSON arrays of bounded size, one array per line or per file; no task gathers the whole table."""
    part = F.floor(F.monotonically_increasing_id() / F.lit(rows_per_array)).alias("part")
    lines = df.select(part, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("o")).groupBy("part").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("o"), ","), F.lit("]")).alias("value")
    )
    if one_per_file:
        lines.write.mode("overwrite").partitionBy("part").text(path)
    else:
        lines.select("value").write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics table with NaN read as NULL."""
    df = spark.read.parquet(path)
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns
    ))

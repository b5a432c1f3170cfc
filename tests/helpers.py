"""Small builders shared by the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

RECORD = (
    "case_id string, arm string, target string, ground_truth string, prediction string, evidence string, "
    "correct boolean, abstained boolean, evidence_span_found boolean, "
    "evidence_semantically_supports_prediction boolean, errors array<string>, raw_model_output map<string,string>"
)
RESPONSE = (
    "case_id string, arm string, target string, raw_value string, evidence string, confidence string, "
    "reason string, shape_valid boolean"
)
REPORT = "case_id string, text string, gold_T string, gold_N string, gold_M string"


def record(case_id, arm="D_grounded", target="T", gold=None, pred="T1", span=True, sem=True, errors=()):
    abstained = pred == "unknown"
    return (case_id, arm, target, gold, pred, None, None if gold is None else pred == gold, abstained,
            None if abstained else span, None if abstained else sem, list(errors), {"value": pred})


def records(spark, rows):
    return spark.createDataFrame(list(rows), RECORD)


def responses(spark, rows):
    """rows: (case_id, arm, target, raw_value, evidence[, shape_valid])"""
    return spark.createDataFrame([(*r[:5], "high", None, r[5] if len(r) > 5 else True) for r in rows], RESPONSE)


def reports(spark, rows):
    return spark.createDataFrame(list(rows), REPORT)


def column(spark, values, fn, schema="v string"):
    """Results of a one-column expression over literal rows, in order."""
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(fn.alias("r")).collect()]


def col(name):
    return F.col(name)

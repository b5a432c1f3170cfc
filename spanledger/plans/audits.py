"""Audit jobs: write a blinded bundle, later score the filled-in reviewer sheet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spanledger import constants as K
from spanledger.operators import audit
from spanledger.session import materialize
from spanledger.sources import jsonl, tables


@dataclass(frozen=True)
class AuditScores:
    agreement: DataFrame
    source_sufficiency: DataFrame
    prior_predictions: DataFrame


def build(records: DataFrame, reports: DataFrame, target_counts: dict[str, int], seed: int, output: str,
          mode: str = K.AUDIT_MODES[0], **tiers) -> DataFrame:
    """Draw the sample, write the reviewer and the key sheet to separate folders; returns the report."""
    sample = materialize(audit.audit_sample(records, target_counts, seed, **tiers), "audit-sample")
    arms = {k: v for k, v in tiers.items() if k in ("priority", "comparison")}
    reviewer, key = audit.blinded_bundle(records, reports, sample, seed, mode, **arms)
    jsonl.write_lines(reviewer, f"{output}/reviewer")
    jsonl.write_lines(key, f"{output}/key")
    composition = audit.sampling_report(sample, target_counts)
    tables.write_parquet(composition, f"{output}/composition")
    return composition


def score(spark: SparkSession, reviewer_path: str, key_path: str, *, with_gold: bool = False,
          priority: str = K.ARM_CONSTRAINED, output: str | None = None) -> AuditScores:
    """Unblind a reviewed audit and score it; with ``output`` the scores are written there and read back."""
    reviewer = jsonl.read_audit(spark, reviewer_path, with_gold=with_gold)
    joined = audit.unblind(reviewer, jsonl.read_audit(spark, key_path, key=True), "row_no")
    scores = AuditScores(
        audit.review_scores(joined), audit.source_sufficiency(joined), audit.prior_predictions(joined, priority)
    )
    if output is None:
        return scores
    for name, df in vars(scores).items():
        tables.write_parquet(df, f"{output}/{name}")
    return AuditScores(*(spark.read.parquet(f"{output}/{name}") for name in vars(scores)))

"""Comparison of the arms with an external classifier on the cases both cover."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from spanledger.operators import classify, dataset, resample
from spanledger.session import materialize


@dataclass(frozen=True)
class BaselineComparison:
    rows: DataFrame
    completeness: DataFrame
    system_metrics: DataFrame
    class_metrics: DataFrame
    confusion: DataFrame
    truncation: DataFrame
    paired: DataFrame


def compare(records: DataFrame, overlap: DataFrame, baseline: DataFrame, arms: list[str], *,
            name: str = "baseline", seed: int = 42, n_boot: int = 5000) -> BaselineComparison:
    """Every table of the comparison from one materialised long table.

    A gold mismatch or a missing (case, system) row fails the job.
    """
    arm_rows = classify.arm_rows_for_baseline(records, overlap)
    rows = materialize(arm_rows.unionByName(baseline.select(*arm_rows.columns)), "baseline-rows")
    confusion = classify.confusion_counts(rows, classify.GROUP)
    return BaselineComparison(
        rows, dataset.require_complete(dataset.completeness(rows, overlap, [*arms, name])),
        classify.system_metrics(rows), classify.class_metrics(confusion), classify.confusion_matrix(confusion),
        classify.truncation_strata(baseline), resample.baseline_comparison(rows, name, seed=seed, n_boot=n_boot),
    )

"""Jobs beside the main evaluation: analysis tables, first-generation scoring, rescoring, pilot against main."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spanledger.operators import classify, compare, metrics
from spanledger.operators.records import boundary_rows, rescore
from spanledger.sources import documents, tables


def _written(df: DataFrame, path: str) -> DataFrame:
    tables.write_parquet(df, path)
    return df.sparkSession.read.parquet(path)


def analysis_tables(records: DataFrame, bundle: DataFrame, output: str) -> dict[str, DataFrame]:
    """Error rates, the M0 deep dive, gold and predicted distributions, coverage against accuracy."""
    found = {
        "error_rates": metrics.error_rates(records), "m0_deep_dive": metrics.value_deep_dive(records),
        "gold_distribution": metrics.gold_distribution(records),
        "predicted_distribution": metrics.predicted_distribution(records),
        "coverage_vs_accuracy": metrics.coverage_vs_accuracy(bundle),
    }
    return {name: _written(df, f"{output}/{name}") for name, df in found.items()}


def first_generation(reports: DataFrame, responses: DataFrame, output: str) -> DataFrame:
    """Score answers by the first generation's rules; writes rows, scorecard and case documents, returns the scorecard."""
    rows = _written(boundary_rows(reports, responses), f"{output}/rows")
    documents.write_documents(documents.case_documents(reports, rows), f"{output}/cases")
    return _written(classify.scorecard(rows), f"{output}/scorecard")


def rescored(records: DataFrame, output: str) -> DataFrame:
    """Judge the support of every record anew; writes the records and the metrics before and after, returns the latter."""
    new = _written(rescore(records), f"{output}/records")
    before, after = metrics.metrics(records), metrics.metrics(new)
    return _written(compare.metric_differences(before, after, names=("before", "after")), f"{output}/before_after")


def pilot_against_main(pilot: DataFrame, main: DataFrame, output: str, *, rescored_pilot: DataFrame | None = None) -> DataFrame:
    """Metric differences of two runs; the pilot's rescored records are preferred where they exist."""
    runs = metrics.metrics(pilot if rescored_pilot is None else rescored_pilot), metrics.metrics(main)
    return _written(compare.metric_differences(*runs), f"{output}/pilot_vs_main")

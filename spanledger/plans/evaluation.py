"""End-to-end evaluation: pool, sample, answers, records, metrics, comparisons, tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.operators import dataset, metrics, resample, sampling
from spanledger.operators.records import build_records
from spanledger.plans import comparison
from spanledger.sources import documents, jsonl, tables
from spanledger.streaming import resume


@dataclass(frozen=True)
class Settings:
    arms: tuple[str, ...] = K.STUDY_ARMS
    sample_size: int = 1000
    seed: int = 42
    pool: str = "all-three"
    n_boot: int = 2000
    allow_short: bool = False  # take what there is when the pool holds fewer cases than asked for


@dataclass(frozen=True)
class Evaluation:
    """Tables of one run; ``records`` is a written table, the rest are small."""

    records: DataFrame
    summary: DataFrame
    bundle: DataFrame
    errors: DataFrame
    error_rates: DataFrame
    comparisons: DataFrame


def draw_cases(reports: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(pool, sample) of cases.  Only ids and gold are shuffled; texts join the sample afterwards."""
    golds = reports.select("case_id", *(f"gold_{t}" for t in K.TARGETS))
    pool = dataset.pool(golds, settings.pool)
    return pool, sampling.stratified_sample(pool, settings.sample_size, settings.seed)


def evaluate(reports: DataFrame, responses: DataFrame, settings: Settings, output: str) -> Evaluation:
    """Score given answers for a sample of the reports and write the result folder.

    The record table is written first and everything else reads it back: the texts are touched by
    exactly one job.
    """
    spark = reports.sparkSession
    pool, sample = draw_cases(reports, settings)
    chosen = sample.select("case_id")
    wanted = responses.filter(F.col("arm").isin(*settings.arms)).join(chosen, "case_id", "left_semi")
    records = build_records(reports.join(chosen, "case_id", "left_semi"), wanted)
    tables.write_parquet(records, f"{output}/records")
    return report(spark.read.parquet(f"{output}/records"), sampling.sampling_summary(pool, sample, settings.seed),
                  settings, output)


def evaluate_with(reports: DataFrame, scorer: Callable[[str, str], str], settings: Settings, output: str,
                  checkpoint: str, **rounds) -> Evaluation:
    """As :func:`evaluate`, asking ``scorer`` for the answers in resumable rounds.

    A pool that is smaller than the sample is refused before anything is asked.
    """
    dataset.preflight(reports, sample_size=settings.sample_size, arms=settings.arms, mode=settings.pool,
                      strict=not settings.allow_short).collect()
    _, sample = draw_cases(reports, settings)
    chosen = sample.select("case_id")
    texts = reports.join(chosen, "case_id", "left_semi").select("case_id", "text")
    results = resume.run_rounds(texts, settings.arms, checkpoint, scorer, **rounds)
    wanted = dataset.cases_by_arms(sample.select("case_id"), settings.arms)
    every = dataset.lookup_join(wanted, results, ["case_id", "arm"], "checkpointed result")
    return evaluate(reports, resume.checkpoint_responses(every), settings, output)


def report(records: DataFrame, summary: DataFrame, settings: Settings, output: str) -> Evaluation:
    """Metric documents, error counts, comparisons and CSV tables of a record table."""
    bundle = metrics.metrics(records)
    errors = metrics.error_breakdown(records)
    comparisons = resample.comparison_grid(records, seed=settings.seed, n_boot=settings.n_boot)
    tables.write_parquet(bundle, f"{output}/metrics")
    tables.write_parquet(errors, f"{output}/errors")
    tables.write_parquet(comparisons, f"{output}/comparisons")
    spark = records.sparkSession
    bundle, errors, comparisons = (spark.read.parquet(f"{output}/{n}") for n in ("metrics", "errors", "comparisons"))
    documents.write_documents(documents.metrics_document(bundle, by_target=False), f"{output}/metrics_json")
    documents.write_documents(documents.metrics_document(bundle, by_target=True), f"{output}/metrics_by_target_json")
    documents.write_documents(documents.error_document(errors), f"{output}/error_breakdown_json")
    documents.write_documents(documents.bootstrap_document(comparisons), f"{output}/bootstrap_json")
    tables.write_csv(metrics.comparison_table(bundle).orderBy("target", "arm"), f"{output}/tables_csv", single_file=True)
    jsonl.write_lines(records, f"{output}/predictions_jsonl")
    tables.write_parquet(summary, f"{output}/sampling_summary")
    analysis = comparison.analysis_tables(records, bundle, f"{output}/analysis")
    return Evaluation(records, spark.read.parquet(f"{output}/sampling_summary"), bundle, errors, analysis["error_rates"], comparisons)

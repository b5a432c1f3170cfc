"""Metrics over the record table.

Every table here comes from one pass that counts per (arm, target) with partial aggregation; the
pooled rows are sums of that small result, not a second pass over the records.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions.formats import ratio
from spanledger.functions.labels import has_explicit_token

OVERALL = "overall"


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


_DOMAIN_LIST = ", ".join(f"'{v}'" for v in K.DOMAIN)
_EVALUABLE = "ground_truth is not null"
_ASSERTED = f"{_EVALUABLE} and not abstained"
_SPAN, _SUPPORT = "evidence_span_found", "evidence_semantically_supports_prediction"
# counted both over evaluable and over asserted records; count_if ignores NULL conditions
_OUTCOMES = {
    "n_correct": "correct",
    "n_no_span": f"not {_SPAN}",
    "n_unsupported": f"(not {_SPAN} or not {_SUPPORT})",
    "n_correct_span": f"correct and {_SPAN}",
    "n_correct_support": f"correct and {_SPAN} and {_SUPPORT}",
}
_COUNTED = {
    "n_evaluable": _EVALUABLE,
    "n_asserted": _ASSERTED,
    "n_abstained": f"{_EVALUABLE} and abstained",
    "n_compliant": f"{_EVALUABLE} and raw_model_output['value'] in ({_DOMAIN_LIST})",
    "n_span": f"{_ASSERTED} and {_SPAN}",
    "n_support": f"{_ASSERTED} and {_SUPPORT}",
    **{name: f"{_EVALUABLE} and {c}" for name, c in _OUTCOMES.items()},
    **{f"{name}_asserted": f"{_ASSERTED} and {c}" for name, c in _OUTCOMES.items()},
}
_RATES = {  # metric, numerator and denominator
    "accuracy": ("n_correct", "n_evaluable"),
    "accuracy_over_asserted": ("n_correct_asserted", "n_asserted"),
    "abstention_rate": ("n_abstained", "n_evaluable"),
    "coverage": ("n_evaluable - n_abstained", "n_evaluable"),
    "span_unsupported_rate_over_evaluable": ("n_no_span", "n_evaluable"),
    "span_unsupported_rate_over_asserted": ("n_no_span_asserted", "n_asserted"),
    "semantic_unsupported_rate_over_evaluable": ("n_unsupported", "n_evaluable"),
    "semantic_unsupported_rate_over_asserted": ("n_unsupported_asserted", "n_asserted"),
    "span_grounded_accuracy_over_evaluable": ("n_correct_span", "n_evaluable"),
    "span_grounded_accuracy_over_asserted": ("n_correct_span_asserted", "n_asserted"),
    "semantic_supported_accuracy_over_evaluable": ("n_correct_support", "n_evaluable"),
    "semantic_supported_accuracy_over_asserted": ("n_correct_support_asserted", "n_asserted"),
    "allowed_value_compliance": ("n_compliant", "n_evaluable"),
    "evidence_span_found_rate": ("n_span", "n_asserted"),
    "evidence_semantic_support_rate": ("n_support", "n_asserted"),
}
_OLD_NAMES = {  # deprecated names of span metrics
    "unsupported_rate_over_evaluable": "span_unsupported_rate_over_evaluable",
    "unsupported_rate_over_asserted": "span_unsupported_rate_over_asserted",
    "supported_accuracy_over_evaluable": "span_grounded_accuracy_over_evaluable",
    "supported_accuracy_over_asserted": "span_grounded_accuracy_over_asserted",
}


def metric_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """All counts that the metrics need, in one aggregation."""
    return records.groupBy(*by).agg(
        F.expr("count(*) as n_total"), *(F.expr(f"count_if({c}) as {name}") for name, c in _COUNTED.items())
    )


def roll_up(counts: DataFrame, keys: list[str], numbers: list[str], *, scope: str = "target") -> DataFrame:
    """Add the pooled scope to per-target counts, and zero rows for targets without records."""
    scopes = [f"struct('{OVERALL}' as scope, 1 as weight)", f"struct({scope} as scope, 1 as weight)",
              *(f"struct('{t}' as scope, 0 as weight)" for t in K.TARGETS)]
    weighted = counts.selectExpr("*", f"explode(array({', '.join(scopes)})) as s").drop(scope)
    return weighted.groupBy(*keys, F.expr(f"s.scope as {scope}")).agg(
        *(F.expr(f"sum({c} * s.weight) as {c}") for c in numbers)
    )


def add_metrics(counts: DataFrame) -> DataFrame:
    """Turn counts into the metric bundle; a zero denominator gives NULL."""
    populations = ("n_total", "n_evaluable", "n_asserted")
    keep = [c for c in counts.columns if not c.startswith("n_") or c in populations]
    rates = {name: f"try_divide(cast({a} as double), {b})" for name, (a, b) in _RATES.items()}
    rates |= {old: rates[new] for old, new in _OLD_NAMES.items()}
    return counts.selectExpr(*keep, *(f"{rate} as {name}" for name, rate in rates.items()))


def metrics(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Metric bundle per arm for ``overall`` and every target (column ``target``)."""
    keys = keys or ["arm"]
    counts = metric_counts(records, [*keys, "target"])
    numbers = [c for c in counts.columns if c.startswith("n_")]
    return add_metrics(roll_up(counts, keys, numbers))


def case_splits(reports: DataFrame, cancer_type: str) -> DataFrame:
    """(case_id, target, difficulty, cancer_type): ``easy`` where the report names some stage of the target, else ``hard``.

    One row per case and target; the text is read once and goes no further.  A NULL text has no difficulty.
    """
    tags = F.explode(F.array(*(F.struct(
        F.lit(t).alias("target"),
        F.when(has_explicit_token(F.col("text"), t), "easy").when(F.col("text").isNotNull(), "hard").alias("difficulty"),
    ) for t in K.TARGETS))).alias("t")
    return reports.select("case_id", F.col(cancer_type).alias("cancer_type"), tags).select("case_id", "t.*", "cancer_type")


def split_metrics(records: DataFrame, splits: list[str], keys: list[str] | None = None) -> DataFrame:
    """Metric bundle per arm for every combination of target and ``splits``, with all subtotals.

    The records are counted once, by the finest combination; one CUBE sums these counts.  ``pooled_*`` says which columns
    a row sums over, so a value that is missing in the data and a subtotal stay apart, though both are NULL.
    """
    keys, axes = keys or ["arm"], ["target", *splits]
    counts = metric_counts(records, [*keys, *axes])
    numbers = [c for c in counts.columns if c.startswith("n_")]
    sets = [[*keys, *chosen] for n in range(len(axes) + 1) for chosen in combinations(axes, n)]
    cube = counts.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in (*keys, *axes)))
    summed = cube.agg(*(F.sum(c).alias(c) for c in numbers), *((F.grouping(c) == 1).alias(f"pooled_{c}") for c in axes))
    return add_metrics(summed)


def comparison_table(bundle: DataFrame, target: str | None = None) -> DataFrame:
    """Headline columns per arm for one scope, or for all scopes."""
    rows = bundle if target is None else bundle.filter(F.col("target") == target)
    return rows.select(
        "arm", "target", "n_evaluable", "accuracy",
        F.col("semantic_supported_accuracy_over_evaluable").alias("semantic_supported_accuracy"),
        F.col("span_unsupported_rate_over_evaluable").alias("span_unsupported_rate"),
        F.col("semantic_unsupported_rate_over_evaluable").alias("semantic_unsupported_rate"),
        "abstention_rate", "coverage",
    )


def coverage_vs_accuracy(bundle: DataFrame) -> DataFrame:
    return bundle.select(
        "arm", "target", "coverage", "accuracy_over_asserted",
        "semantic_supported_accuracy_over_asserted",
    )


def _flag_counts(records: DataFrame, condition: Column) -> DataFrame:
    """Counts of every error flag per (arm, target), one row per flag."""
    counted = records.groupBy("arm", "target").agg(
        F.count_if(F.col("ground_truth").isNotNull()).alias("n_evaluable"),
        *(F.count_if(condition & F.array_contains("errors", f)).alias(f) for f in K.ERROR_FLAGS),
    )
    return counted.unpivot(["arm", "target", "n_evaluable"], list(K.ERROR_FLAGS), "error_category", "count")


def error_breakdown(records: DataFrame) -> DataFrame:
    """Flags per arm and target over all records; only flags that occur."""
    return _flag_counts(records, F.lit(True)).filter("count > 0").select(
        "arm", "target", "error_category", "count"
    )


def error_rates(records: DataFrame) -> DataFrame:
    """Flags per arm over evaluable records, for overall and each target, zeros included."""
    counts = _flag_counts(records, F.col("ground_truth").isNotNull())
    rolled = roll_up(counts, ["arm", "error_category"], ["n_evaluable", "count"])
    return rolled.withColumn("rate_over_evaluable", ratio(F.col("count"), F.col("n_evaluable")))


def value_deep_dive(records: DataFrame, target: str = "M", value: str = "M0") -> DataFrame:
    """How one asserted value behaves per arm: count, accuracy, share, support and span rates."""
    rows = records.filter(F.col("target") == target)
    said = ~F.col("abstained")
    hit = said & (F.col("prediction") == value)
    evaluable = hit & F.col("ground_truth").isNotNull()
    counts = rows.groupBy("arm").agg(
        F.count_if(said).alias("n_asserted"),
        F.count_if(hit).alias("n_predictions"),
        F.count_if(evaluable).alias("n_evaluable"),
        F.count_if(evaluable & _true("correct")).alias("n_correct"),
        F.count_if(hit & _true("evidence_semantically_supports_prediction")).alias("n_support"),
        F.count_if(hit & _true("evidence_span_found")).alias("n_span"),
    )
    return counts.select(
        "arm", "n_predictions", "n_evaluable",
        ratio(F.col("n_correct"), F.col("n_evaluable")).alias("accuracy"),
        ratio(F.col("n_predictions"), F.col("n_asserted")).alias("proportion_of_asserted"),
        ratio(F.col("n_support"), F.col("n_predictions")).alias("semantic_supported_rate"),
        ratio(F.col("n_span"), F.col("n_predictions")).alias("span_grounded_rate"),
    )


def _with_fraction(counts: DataFrame, by: list[str]) -> DataFrame:
    totals = counts.groupBy(*by).agg(F.sum("count").alias("total"))
    return counts.join(totals, by).withColumn("fraction", ratio(F.col("count"), F.col("total"))).drop("total")


def gold_distribution(records: DataFrame) -> DataFrame:
    """Gold values per target, each case once (gold does not vary by arm)."""
    cases = records.filter(F.col("ground_truth").isNotNull()).groupBy("case_id", "target").agg(
        F.min("ground_truth").alias("value")
    )
    return _with_fraction(cases.groupBy("target", "value").count(), ["target"])


def predicted_distribution(records: DataFrame) -> DataFrame:
    """Predicted values per target and arm, unknown and INVALID included."""
    counts = records.groupBy("target", "arm", F.col("prediction").alias("value")).count()
    return _with_fraction(counts, ["target", "arm"])


def boundary_table(rows: DataFrame) -> DataFrame:
    """Boundary tags per arm and stage, with the share of mismatches that are principled abstentions."""
    tagged = rows.filter(F.col("gold").isNotNull())
    counts = tagged.groupBy("arm", F.col("target").alias("stage")).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(F.col("boundary_tag") == t).alias(t) for t in K.BOUNDARY_TAGS),
    )
    return counts.withColumn(
        "source_boundary_success_rate",
        ratio(F.col("source_boundary_abstention"), F.col("n") - F.col("correct")),
    )


def figure_points(bundle: DataFrame) -> DataFrame:
    """Data of the scatter and bar figures in long form: figure, arm, target, x, y, n_evaluable, enough.

    All rows are given; ``enough`` says whether the run has the evaluable M records that the M figure
    asks for (true for the other figures).
    """
    m_total = bundle.filter(F.col("target") == "M").agg(F.sum("n_evaluable")).scalar()
    overall, m = F.col("target") == OVERALL, F.col("target") == "M"
    figures = [
        ("accuracy_vs_span_unsupported", overall, "span_unsupported_rate_over_evaluable", "accuracy"),
        ("accuracy_vs_semantic_unsupported", overall, "semantic_unsupported_rate_over_evaluable", "accuracy"),
        ("coverage_vs_semantic_supported_accuracy", overall, "coverage",
         "semantic_supported_accuracy_over_evaluable"),
        ("semantic_unsupported_by_target", ~overall, None, "semantic_unsupported_rate_over_evaluable"),
        ("m_accuracy_vs_semantic_supported", m, "semantic_supported_accuracy_over_evaluable", "accuracy"),
    ]
    points = F.array_compact(F.array(*(
        F.when(rows, F.struct(
            F.lit(name).alias("figure"),
            (F.col(x) if x else F.lit(None).cast("double")).alias("x"),
            F.col(y).alias("y"),
        )) for name, rows, x, y in figures
    )))
    rows = bundle.select("arm", "target", "n_evaluable", F.explode(points).alias("p"))
    enough = ~F.col("p.figure").startswith("m_") | F.coalesce(m_total >= K.MIN_EVALUABLE_FOR_M_FIGURE, F.lit(False))
    return rows.select("p.figure", "arm", "target", "p.x", "p.y", "n_evaluable", enough.alias("enough"))


def error_figure(records: DataFrame) -> DataFrame:
    """Bars of the error figures: every flag per arm, pooled and for M, with n_evaluable and enough.

    ``enough`` says whether the whole run has the evaluable M records that the M figure asks for
    (true for the pooled rows).
    """
    counts = _flag_counts(records, F.lit(True))
    rolled = roll_up(counts, ["arm", "error_category"], ["n_evaluable", "count"]).filter(
        F.col("target").isin(OVERALL, "M")
    )
    m_rows = rolled.filter((F.col("target") == "M") & (F.col("error_category") == K.ERROR_FLAGS[0]))
    m_total = m_rows.agg(F.sum("n_evaluable")).scalar()
    enough = (F.col("target") == OVERALL) | F.coalesce(m_total >= K.MIN_EVALUABLE_FOR_M_FIGURE, F.lit(False))
    return rolled.select("arm", "target", "error_category", "count", "n_evaluable", enough.alias("enough"))

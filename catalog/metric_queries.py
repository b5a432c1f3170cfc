"""Aggregations over the record table, classifier metrics and experiment comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.oracle_base import lit, with_boundary, with_records
from catalog.registry import query
from catalog.scalar_queries import stale_records
from spanledger import constants as K
from spanledger.operators import classify, compare, metrics, records as R, sampling
from spanledger.session import materialize

# ------------------------------------------------------------------ the metric bundle
_EV = "ground_truth IS NOT NULL"
_AS = f"{_EV} AND NOT abstained"
_BOTH = {"correct": "correct", "no_span": "NOT span", "unsupported": "(NOT span OR NOT sem)",
         "correct_span": "(correct AND span)", "correct_support": "(correct AND span AND sem)"}
_COUNTS = {
    "n_total": "true", "n_evaluable": _EV, "n_asserted": _AS, "n_abstained": f"{_EV} AND abstained",
    "n_compliant": f"{_EV} AND shape_valid AND raw_value IN ({', '.join(lit(v) for v in K.DOMAIN)})",
    "n_span": f"{_AS} AND span", "n_support": f"{_AS} AND sem",
    **{f"n_{k}": f"{_EV} AND {v}" for k, v in _BOTH.items()},
    **{f"n_{k}_asserted": f"{_AS} AND {v}" for k, v in _BOTH.items()},
}


def _over(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"


def four(x: str) -> str:
    return f"(round_even(CAST({x} AS DOUBLE) * 10000, 0) / 10000)"


BUNDLE = {
    "accuracy": _over("n_correct", "n_evaluable"),
    "accuracy_over_asserted": _over("n_correct_asserted", "n_asserted"),
    "abstention_rate": _over("n_abstained", "n_evaluable"),
    "coverage": f"1 - {_over('n_abstained', 'n_evaluable')}",
    "span_unsupported_rate_over_evaluable": _over("n_no_span", "n_evaluable"),
    "span_unsupported_rate_over_asserted": _over("n_no_span_asserted", "n_asserted"),
    "semantic_unsupported_rate_over_evaluable": _over("n_unsupported", "n_evaluable"),
    "semantic_unsupported_rate_over_asserted": _over("n_unsupported_asserted", "n_asserted"),
    "span_grounded_accuracy_over_evaluable": _over("n_correct_span", "n_evaluable"),
    "span_grounded_accuracy_over_asserted": _over("n_correct_span_asserted", "n_asserted"),
    "semantic_supported_accuracy_over_evaluable": _over("n_correct_support", "n_evaluable"),
    "semantic_supported_accuracy_over_asserted": _over("n_correct_support_asserted", "n_asserted"),
    "allowed_value_compliance": _over("n_compliant", "n_evaluable"),
    "evidence_span_found_rate": _over("n_span", "n_asserted"),
    "evidence_semantic_support_rate": _over("n_support", "n_asserted"),
    "unsupported_rate_over_evaluable": _over("n_no_span", "n_evaluable"),
    "unsupported_rate_over_asserted": _over("n_no_span_asserted", "n_asserted"),
    "supported_accuracy_over_evaluable": _over("n_correct_span", "n_evaluable"),
    "supported_accuracy_over_asserted": _over("n_correct_span_asserted", "n_asserted"),
}


def bundle_cte(name: str, source: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _COUNTS.items())
    return f"""
{name} AS MATERIALIZED (
  SELECT arm, target, n_total, n_evaluable, n_asserted, {', '.join(f'{e} AS {m}' for m, e in BUNDLE.items())}
  FROM (SELECT arm, coalesce(target, 'overall') AS target, {counts} FROM {source}
        GROUP BY GROUPING SETS ((arm), (arm, target)))
)"""


_BUNDLE = bundle_cte("bundle", "records")
_DOUBLES = " ".join(BUNDLE)


def bundle(spark, d):
    return metrics.metrics(V.records(spark, d))


@query("a0_populations", with_records("SELECT arm, target, n_total, n_evaluable, n_asserted FROM bundle", _BUNDLE))
def _(spark, d):
    return bundle(spark, d).select("arm", "target", "n_total", "n_evaluable", "n_asserted")


@query("a17_metrics_by_arm_target", with_records("SELECT * FROM bundle", _BUNDLE), doubles=_DOUBLES)
def _(spark, d):
    return bundle(spark, d)


_TYPE = "CASE WHEN source <> 'src3' THEN 'P-' || source END"
_SPLIT_COUNTS = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _COUNTS.items())


@query("a17_metric_splits", with_records(f"""
    SELECT arm, target, difficulty, cancer_type, pooled_target, pooled_difficulty, pooled_cancer_type, n_total, n_evaluable, n_asserted,
      {', '.join(f'{e} AS {m}' for m, e in BUNDLE.items())}
    FROM (SELECT arm, target, difficulty, cancer_type, grouping(target) = 1 AS pooled_target, grouping(difficulty) = 1 AS pooled_difficulty,
            grouping(cancer_type) = 1 AS pooled_cancer_type, {_SPLIT_COUNTS}
          FROM (SELECT r.*, CASE WHEN CASE r.target WHEN 'T' THEN easy_T WHEN 'N' THEN easy_N ELSE easy_M END THEN 'easy' ELSE 'hard' END AS difficulty,
                  {_TYPE} AS cancer_type
                FROM records r JOIN feat f ON f.case_id = r.case_id JOIN (SELECT case_id, source FROM rep) p ON p.case_id = r.case_id)
          GROUP BY arm, CUBE (target, difficulty, cancer_type))"""),
       bools="pooled_target pooled_difficulty pooled_cancer_type", doubles=_DOUBLES)
def _(spark, d):
    """Easy and hard reports and types of cancer; some reports have no type, which is no subtotal."""
    reports = V.reports(spark, d).withColumn("type", F.when(F.col("source") != "src3", F.concat(F.lit("P-"), F.col("source"))))
    rows = V.records(spark, d).join(metrics.case_splits(reports, "type"), ["case_id", "target"])
    return metrics.split_metrics(rows, ["difficulty", "cancer_type"])


_TABLE = """SELECT arm, target, n_evaluable, accuracy, semantic_supported_accuracy_over_evaluable AS semantic_supported_accuracy,
  span_unsupported_rate_over_evaluable AS span_unsupported_rate,
  semantic_unsupported_rate_over_evaluable AS semantic_unsupported_rate, abstention_rate, coverage FROM bundle"""


@query("a18_comparison_table", with_records(_TABLE, _BUNDLE),
       doubles="accuracy semantic_supported_accuracy span_unsupported_rate semantic_unsupported_rate abstention_rate coverage")
def _(spark, d):
    return metrics.comparison_table(bundle(spark, d))


@query("a19_error_breakdown", with_records(
    "SELECT arm, target, e AS error_category, count(*) AS count FROM (SELECT arm, target, unnest(errors) AS e FROM records) GROUP BY ALL"))
def _(spark, d):
    return metrics.error_breakdown(V.records(spark, d))


_FLAGS = ", ".join(lit(f) for f in K.ERROR_FLAGS)


@query("a20_error_rates", with_records(f"""
    SELECT arm, coalesce(target, 'overall') AS target, error_category, count(*) FILTER (WHERE {_EV} AND list_contains(errors, error_category)) AS count,
      count(*) FILTER (WHERE {_EV}) AS n_evaluable,
      {_over(f"count(*) FILTER (WHERE {_EV} AND list_contains(errors, error_category))", f"count(*) FILTER (WHERE {_EV})")} AS rate_over_evaluable
    FROM records, (SELECT unnest([{_FLAGS}]) AS error_category)
    GROUP BY GROUPING SETS ((arm, error_category), (arm, target, error_category))"""), doubles="rate_over_evaluable")
def _(spark, d):
    return metrics.error_rates(V.records(spark, d))


_M0 = "NOT abstained AND prediction = 'M0'"


@query("a21_m0_deep_dive", with_records(f"""
    SELECT arm, count(*) FILTER (WHERE {_M0}) AS n_predictions, count(*) FILTER (WHERE {_M0} AND {_EV}) AS n_evaluable,
      {_over(f"count(*) FILTER (WHERE {_M0} AND correct)", f"count(*) FILTER (WHERE {_M0} AND {_EV})")} AS accuracy,
      {_over(f"count(*) FILTER (WHERE {_M0})", "count(*) FILTER (WHERE NOT abstained)")} AS proportion_of_asserted,
      {_over(f"count(*) FILTER (WHERE {_M0} AND sem)", f"count(*) FILTER (WHERE {_M0})")} AS semantic_supported_rate,
      {_over(f"count(*) FILTER (WHERE {_M0} AND span)", f"count(*) FILTER (WHERE {_M0})")} AS span_grounded_rate
    FROM records WHERE target = 'M' GROUP BY arm"""),
    doubles="accuracy proportion_of_asserted semantic_supported_rate span_grounded_rate")
def _(spark, d):
    return metrics.value_deep_dive(V.records(spark, d))


@query("a22_gold_distribution", with_records("""
    SELECT target, value, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY target) AS fraction
    FROM (SELECT DISTINCT case_id, target, ground_truth AS value FROM records WHERE ground_truth IS NOT NULL) GROUP BY target, value"""),
    doubles="fraction")
def _(spark, d):
    return metrics.gold_distribution(V.records(spark, d))


@query("a23_predicted_distribution", with_records("""
    SELECT target, arm, prediction AS value, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY target, arm) AS fraction
    FROM records GROUP BY target, arm, prediction"""), doubles="fraction")
def _(spark, d):
    return metrics.predicted_distribution(V.records(spark, d))


@query("a24_coverage_vs_accuracy", with_records(
    "SELECT arm, target, coverage, accuracy_over_asserted, semantic_supported_accuracy_over_asserted FROM bundle", _BUNDLE),
    doubles="coverage accuracy_over_asserted semantic_supported_accuracy_over_asserted")
def _(spark, d):
    return metrics.coverage_vs_accuracy(bundle(spark, d))


# ------------------------------------------------------------------ first-generation scorecard
_OPEN_F1 = """
open_cls AS (
  SELECT arm, target, cls, count(*) FILTER (WHERE gold = cls AND value_norm = cls) AS tp,
         count(*) FILTER (WHERE gold = cls) AS support, count(*) FILTER (WHERE value_norm = cls) AS predicted
  FROM (SELECT arm, target, gold, value_norm, unnest(list_distinct([gold, value_norm])) AS cls FROM bnd WHERE gold IS NOT NULL)
  GROUP BY arm, target, cls
),
open_f1 AS (
  SELECT arm, target, avg(coalesce(2.0 * tp / nullif(support + predicted, 0), 0)) AS macro_f1 FROM open_cls GROUP BY arm, target
)"""
_STAGE = ("accuracy", "macro_f1", "allowed_value_rate", "abstention_rate", "evidence_grounding_rate",
          "unsupported_assertion_rate", "hard_abstention_rate")
_DOMAIN = ", ".join(lit(v) for v in K.DOMAIN)
_SAID = "value_norm <> 'unknown'"
_CARD = f"""
card AS (
  SELECT arm, target, count(*) AS n, {_over("count(*) FILTER (WHERE invalid)", "count(*)")} AS invalid_output_rate,
    {_over("count(*) FILTER (WHERE value_norm = gold)", "count(gold)")} AS accuracy,
    {_over(f"count(*) FILTER (WHERE gold IS NOT NULL AND value IN ({_DOMAIN}))", "count(gold)")} AS allowed_value_rate,
    {_over(f"count(*) FILTER (WHERE NOT {_SAID})", "count(*)")} AS abstention_rate,
    {_over(f"count(*) FILTER (WHERE {_SAID} AND grounded)", f"count(*) FILTER (WHERE {_SAID})")} AS evidence_grounding_rate,
    {_over(f"count(*) FILTER (WHERE {_SAID} AND NOT grounded)", "count(*)")} AS unsupported_assertion_rate,
    {_over("count(*) FILTER (WHERE value_norm = 'unknown' AND NOT easy)", "count(*) FILTER (WHERE NOT easy)")} AS hard_abstention_rate
  FROM bnd GROUP BY arm, target
)"""


@query("a25_scorecard", with_boundary(
    "SELECT arm, max(n) AS n, max(invalid_output_rate) AS invalid_output_rate, "
    + ", ".join(f"max(CASE WHEN target = '{t}' THEN {c} END) AS {t}_{c}" for t in K.TARGETS for c in _STAGE)
    + " FROM card JOIN open_f1 USING (arm, target) GROUP BY arm", _OPEN_F1, _CARD),
    doubles="invalid_output_rate " + " ".join(f"{t}_{c}" for t in K.TARGETS for c in _STAGE))
def _(spark, d):
    return classify.scorecard(V.boundary(spark, d))


@query("a26_macro_f1_open_labels", with_boundary("SELECT * FROM open_f1", _OPEN_F1), doubles="macro_f1")
def _(spark, d):
    rows = V.boundary(spark, d).withColumn("prediction", F.col("value_norm"))
    return classify.macro_f1_open(classify.confusion_counts(rows, ["arm", "target"]), ["arm", "target"])


# ------------------------------------------------------------------ baseline comparison
_GUESSES = " ".join(
    f"WHEN '{t}' THEN [{', '.join(lit(c) for c in cs)}][(doc_id * {3 + i}) % {len(cs)} + 1]"
    for i, (t, cs) in enumerate(K.CLASS_SPACE.items()))
_SPACES = "MAP {" + ", ".join(f"'{t}': [{', '.join(lit(c) for c in cs)}]" for t, cs in K.CLASS_SPACE.items()) + "}"
BASE = f"""
base AS MATERIALIZED (
  SELECT case_id, target, gold, CASE WHEN doc_id % 3 = 0 THEN CASE target {_GUESSES} END ELSE gold END AS baseline_prediction,
         (doc_id % 10) / CAST(10 AS DOUBLE) AS baseline_confidence,
         CAST(least(n_chars // 4, 512) AS INTEGER) AS input_token_count, n_chars // 4 > 512 AS was_truncated
  FROM (SELECT DISTINCT doc_id, case_id, target, gold FROM resp WHERE gold IS NOT NULL) JOIN (SELECT case_id, n_chars FROM rep) USING (case_id)
),
systems AS MATERIALIZED (
  SELECT case_id, target, arm AS system, ground_truth AS gold,
    CASE WHEN list_contains({_SPACES}[target], prediction) THEN prediction ELSE 'ABSTAIN_OR_INVALID' END AS prediction,
    prediction AS prediction_raw, prediction = ground_truth AS correct, abstained
  FROM records WHERE ground_truth IS NOT NULL
  UNION ALL
  SELECT case_id, target, 'baseline', gold, baseline_prediction, baseline_prediction, baseline_prediction = gold, false FROM base
)"""
CLASSES = f"""
cls AS (
  SELECT g.target, g.system, g.class, count(*) FILTER (WHERE s.gold = class AND s.prediction = class) AS tp,
    count(*) FILTER (WHERE s.gold = class) AS support, count(*) FILTER (WHERE s.prediction = class) AS predicted
  FROM (SELECT target, system, unnest({_SPACES}[target]) AS class FROM (SELECT DISTINCT target, system FROM systems)) g
  JOIN systems s USING (target, system) GROUP BY ALL
)"""


@query("a27_macro_f1_fixed_classes", with_records(
    "SELECT target, system, avg(coalesce(2.0 * tp / nullif(support + predicted, 0), 0)) AS macro_f1 FROM cls GROUP BY ALL", BASE, CLASSES),
    doubles="macro_f1")
def _(spark, d):
    return classify.macro_f1_fixed(classify.confusion_counts(V.system_rows(spark, d), classify.GROUP))


@query("a28_balanced_accuracy", with_records("""SELECT target, system, avg(recall) AS balanced_accuracy FROM (
      SELECT target, system, gold, avg(CAST(prediction = gold AS INTEGER)) AS recall FROM systems GROUP BY ALL) GROUP BY ALL""", BASE),
    doubles="balanced_accuracy")
def _(spark, d):
    return classify.balanced_accuracy(classify.confusion_counts(V.system_rows(spark, d), classify.GROUP))


@query("a29_system_metrics", with_records(f"""SELECT target, system, n, {four('accuracy')} AS accuracy, {four('coverage')} AS coverage,
      {four('b.balanced_accuracy')} AS balanced_accuracy, {four('f.macro_f1')} AS macro_f1
    FROM (SELECT target, system, count(*) AS n, avg(CAST(correct AS INTEGER)) AS accuracy, 1 - avg(CAST(abstained AS INTEGER)) AS coverage
          FROM systems GROUP BY ALL)
    JOIN (SELECT target, system, avg(recall) AS balanced_accuracy FROM (SELECT target, system, gold,
          avg(CAST(prediction = gold AS INTEGER)) AS recall FROM systems GROUP BY ALL) GROUP BY ALL) b USING (target, system)
    JOIN (SELECT target, system, avg(coalesce(2.0 * tp / nullif(support + predicted, 0), 0)) AS macro_f1 FROM cls GROUP BY ALL) f
      USING (target, system)""", BASE, CLASSES), doubles="accuracy coverage balanced_accuracy macro_f1")
def _(spark, d):
    return classify.system_metrics(V.system_rows(spark, d))


@query("a30_class_metrics", with_records(f"""SELECT target, system, class, {four('coalesce(tp / nullif(support, 0), 0)')} AS recall,
      {four('coalesce(tp / nullif(predicted, 0), 0)')} AS precision, support FROM cls""", BASE, CLASSES), doubles="recall precision")
def _(spark, d):
    return classify.class_metrics(classify.confusion_counts(V.system_rows(spark, d), classify.GROUP))


@query("a31_confusion_matrix", with_records(f"""
    SELECT l.target, l.system, l.gold, l.prediction, count(s.case_id) AS n FROM (
      SELECT target, system, gold, unnest(labels) AS prediction FROM (
        SELECT target, system, labels, unnest(labels) AS gold FROM (
          SELECT target, system, CASE WHEN bool_or(prediction = 'ABSTAIN_OR_INVALID')
            THEN list_append({_SPACES}[target], 'ABSTAIN_OR_INVALID') ELSE {_SPACES}[target] END AS labels
          FROM systems GROUP BY target, system))) l
    LEFT JOIN systems s ON s.target = l.target AND s.system = l.system AND s.gold = l.gold AND s.prediction = l.prediction
    GROUP BY ALL""", BASE))
def _(spark, d):
    return classify.confusion_matrix(classify.confusion_counts(V.system_rows(spark, d), classify.GROUP))


@query("a32_truncation_strata", with_records(f"""
    SELECT target, was_truncated AS truncated, count(*) AS n, {four('avg(CAST(baseline_prediction = gold AS INTEGER))')} AS accuracy,
      CASE WHEN target = 'M' THEN count(*) FILTER (WHERE gold = 'M1') END AS n_m1,
      CASE WHEN target = 'M' THEN {four("avg(CAST(baseline_prediction = gold AS INTEGER)) FILTER (WHERE gold = 'M1')")} END AS m1_recall,
      CASE WHEN target = 'M' AND count(*) FILTER (WHERE gold = 'M1') < 5 THEN 'n<5, too small to interpret' END AS m1_recall_note
    FROM base GROUP BY target, was_truncated""", BASE), bools="truncated", doubles="accuracy m1_recall")
def _(spark, d):
    from spanledger.sources.tables import baseline_long

    return classify.truncation_strata(baseline_long(V.baseline_rows(spark, d)))


@query("a33_source_boundary_table", with_boundary(
    "SELECT arm, target AS stage, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE boundary_tag = '{t}') AS {t}" for t in K.BOUNDARY_TAGS)
    + ", CAST(count(*) FILTER (WHERE boundary_tag = 'source_boundary_abstention') AS DOUBLE) / nullif(count(*) FILTER (WHERE boundary_tag <> 'correct'), 0)"
    " AS source_boundary_success_rate FROM bnd WHERE boundary_tag IS NOT NULL GROUP BY arm, target"), doubles="source_boundary_success_rate")
def _(spark, d):
    return metrics.boundary_table(V.boundary(spark, d))


# ------------------------------------------------------------------ comparing experiments
PILOT_CASES, PILOT_SEED = 200, 42


def pilot_records(spark, d, recs):
    """Records of the pilot: a stratified sample of the cases."""
    sample = sampling.stratified_sample(V.reports(spark, d).select("case_id", *(f"gold_{t}" for t in K.TARGETS)), PILOT_CASES, PILOT_SEED)
    return recs.join(sample.select("case_id"), "case_id", "left_semi")


def stratified_sql(n: int, seed: int, name: str = "picked") -> str:
    return f"""
{name} AS MATERIALIZED (
  WITH keyed AS (SELECT case_id, gold_T, gold_N, gold_M, md5('{seed}|' || case_id) AS sample_key,
      CASE WHEN gold_T IS NULL THEN '0' ELSE '1' END || CASE WHEN gold_N IS NULL THEN '0' ELSE '1' END
      || CASE WHEN gold_M IS NULL THEN '0' ELSE '1' END AS stratum FROM rep),
  sizes AS (SELECT stratum, count(*) AS size, sum(count(*)) OVER () AS total FROM keyed GROUP BY stratum),
  based AS (SELECT *, (size * {n}) // total AS base, (size * {n}) % total AS rest FROM sizes),
  alloc AS (SELECT stratum, CASE WHEN total <= {n} THEN size ELSE base + CASE WHEN
      row_number() OVER (ORDER BY rest DESC, size DESC, stratum) <= {n} - sum(base) OVER () THEN 1 ELSE 0 END END AS alloc FROM based)
  SELECT * EXCLUDE (place, alloc, stratum) FROM (SELECT k.*, a.alloc, row_number() OVER (PARTITION BY k.stratum ORDER BY sample_key) AS place
    FROM keyed k JOIN alloc a USING (stratum)) WHERE place <= alloc
)"""


_PILOT = stratified_sql(PILOT_CASES, PILOT_SEED)
_PILOT_RECORDS = "(SELECT * FROM records WHERE case_id IN (SELECT case_id FROM picked))"
_TWO = (_PILOT, bundle_cte("main_bundle", "records"), bundle_cte("pilot_bundle", _PILOT_RECORDS))


def _unpivot_sql(name: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT arm, target, '{m}' AS metric, {m} AS {value} FROM {name}" for m in K.REPLICATION_METRICS)


@query("j7_pilot_vs_main", with_records(f"""SELECT arm, target, metric, pilot, main, main - pilot AS diff
    FROM ({_unpivot_sql('pilot_bundle', 'pilot')}) JOIN ({_unpivot_sql('main_bundle', 'main')}) USING (arm, target, metric)""", *_TWO),
    doubles="pilot main diff")
def _(spark, d):
    recs = materialize(V.records(spark, d), "records")
    return compare.metric_differences(metrics.metrics(pilot_records(spark, d, recs)), metrics.metrics(recs))


_STALE = """
stale AS MATERIALIZED (
  SELECT r.* REPLACE (CASE WHEN NOT r.abstained THEN r.span AND coalesce(list_contains(e.tokens, r.prediction), false) END AS sem)
  FROM records r LEFT JOIN ev e ON r.evidence = e.evidence
)"""


@query("j15_before_after_rescoring", with_records(f"""SELECT arm, target, metric, before, after, after - before AS diff
    FROM ({_unpivot_sql('old_bundle', 'before')}) JOIN ({_unpivot_sql('bundle', 'after')}) USING (arm, target, metric)""",
    _STALE, bundle_cte("old_bundle", "stale"), _BUNDLE), doubles="before after diff")
def _(spark, d):
    stale = materialize(stale_records(spark, d), "stale")
    return compare.metric_differences(metrics.metrics(stale), metrics.metrics(R.rescore(stale)), names=("before", "after"))


@query("a45_best_arm", with_records("""SELECT target, max_arm AS best_arm, max_value AS best_value FROM (
    SELECT target, first(arm ORDER BY accuracy DESC, arm) AS max_arm, max(accuracy) AS max_value FROM bundle GROUP BY target)""", _BUNDLE),
    doubles="best_value")
def _(spark, d):
    return compare.best_arm(bundle(spark, d), "accuracy", by=["target"])


_CLAIM_FACTS = """
facts AS (
  SELECT experiment,
    max(accuracy) FILTER (WHERE o AND arm = 'C_constrained') AS c_acc, max(accuracy) FILTER (WHERE o) AS top_acc,
    first(arm ORDER BY accuracy DESC, arm) FILTER (WHERE o AND accuracy IS NOT NULL) AS top_arm,
    first(arm ORDER BY semantic_supported_accuracy_over_evaluable DESC, arm)
      FILTER (WHERE o AND semantic_supported_accuracy_over_evaluable IS NOT NULL) AS best,
    max(semantic_unsupported_rate_over_evaluable) FILTER (WHERE o AND arm = 'C_constrained') AS c_rate,
    max(semantic_unsupported_rate_over_evaluable) FILTER (WHERE o AND arm = 'C_plus_unknown') AS p_rate,
    max(semantic_unsupported_rate_over_evaluable) FILTER (WHERE o AND arm = 'D_grounded') AS d_rate,
    min(accuracy - semantic_supported_accuracy_over_evaluable) FILTER (WHERE target = 'M') AS gap
  FROM (SELECT *, target = 'overall' AS o FROM both_runs) GROUP BY experiment
)"""
_CLAIMS = """
SELECT experiment, 'C_highest_or_near_highest_accuracy' AS claim, top_arm = 'C_constrained' OR top_acc - c_acc <= CAST(0.02 AS DOUBLE) AS holds,
  top_arm AS arm, c_acc AS value, top_acc AS against FROM facts
UNION ALL SELECT experiment, 'C_relatively_poor_grounding', c_rate > p_rate AND c_rate > d_rate, NULL, c_rate, greatest(p_rate, d_rate) FROM facts
UNION ALL SELECT experiment, 'C_plus_lower_unsupported_than_C', p_rate < c_rate, NULL, p_rate, c_rate FROM facts
UNION ALL SELECT experiment, 'D_strongest_grounded_reliability', best = 'D_grounded', best, NULL, NULL FROM facts
UNION ALL SELECT experiment, 'M_accuracy_much_higher_than_semantic_supported_accuracy', gap > CAST(0.1 AS DOUBLE), NULL, gap, CAST(0.1 AS DOUBLE) FROM facts"""


def _both(left: str, right: str) -> str:
    return f"""
both_runs AS (SELECT 'pilot' AS experiment, * FROM {left} UNION ALL SELECT 'main', * FROM {right})"""


@query("a46_replication_claims", with_records(_CLAIMS, *_TWO, _both("pilot_bundle", "main_bundle"), _CLAIM_FACTS),
       bools="holds", doubles="value against")
def _(spark, d):
    recs = materialize(V.records(spark, d), "records")
    runs = metrics.metrics(pilot_records(spark, d, recs)).withColumn("experiment", F.lit("pilot")).unionByName(
        metrics.metrics(recs).withColumn("experiment", F.lit("main")))
    return compare.replication_claims(runs)


@query("b18_rescored_pilot_vs_main", with_records(f"""SELECT arm, target, metric, pilot, main, main - pilot AS diff
    FROM ({_unpivot_sql('pilot_bundle', 'pilot')}) JOIN ({_unpivot_sql('main_bundle', 'main')}) USING (arm, target, metric)""", *_TWO),
    doubles="pilot main diff")
def _(spark, d):
    stale = pilot_records(spark, d, stale_records(spark, d))
    return compare.metric_differences(metrics.metrics(R.rescore(stale)), metrics.metrics(V.records(spark, d)))


_M_TOTAL = f"(SELECT count(*) FROM records WHERE target = 'M' AND {_EV}) >= 10"


@query("a47_figure_points", with_records(f"""SELECT *, figure NOT LIKE 'm\\_%' ESCAPE '\\' OR {_M_TOTAL} AS enough FROM (
    SELECT 'accuracy_vs_span_unsupported' AS figure, arm, target, span_unsupported_rate_over_evaluable AS x, accuracy AS y, n_evaluable FROM bundle WHERE target = 'overall'
    UNION ALL SELECT 'accuracy_vs_semantic_unsupported', arm, target, semantic_unsupported_rate_over_evaluable, accuracy, n_evaluable FROM bundle WHERE target = 'overall'
    UNION ALL SELECT 'coverage_vs_semantic_supported_accuracy', arm, target, coverage, semantic_supported_accuracy_over_evaluable, n_evaluable FROM bundle WHERE target = 'overall'
    UNION ALL SELECT 'semantic_unsupported_by_target', arm, target, NULL, semantic_unsupported_rate_over_evaluable, n_evaluable FROM bundle WHERE target <> 'overall'
    UNION ALL SELECT 'm_accuracy_vs_semantic_supported', arm, target, semantic_supported_accuracy_over_evaluable, accuracy, n_evaluable FROM bundle WHERE target = 'M')""",
    _BUNDLE), doubles="x y", bools="enough", longs="n_evaluable")
def _(spark, d):
    return metrics.figure_points(bundle(spark, d))


@query("a47_error_figure", with_records(f"""
    SELECT arm, t AS target, error_category, count(*) FILTER (WHERE list_contains(errors, error_category)) AS count,
      count(*) FILTER (WHERE {_EV}) AS n_evaluable, t = 'overall' OR {_M_TOTAL} AS enough
    FROM (SELECT arm, errors, target, ground_truth, prediction, unnest(CASE WHEN target = 'M' THEN ['overall', 'M'] ELSE ['overall'] END) AS t FROM records),
         (SELECT unnest([{_FLAGS}]) AS error_category)
    GROUP BY arm, t, error_category"""), bools="enough", longs="n_evaluable")
def _(spark, d):
    return metrics.error_figure(V.records(spark, d))

"""Bootstrap, samples, audits and curated examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.join_queries import pairs_cte
from catalog.metric_queries import BASE, stratified_sql
from catalog.oracle_base import has, lit, pattern, with_boundary, with_records, with_views
from catalog.registry import query
from catalog.scalar_queries import AUDIT_EXCERPT_SQL, AUDIT_TRUNCATED_SQL, _M_CLASS, _M_EXCERPT, _head_sql
from spanledger import constants as K
from spanledger.functions.formats import p_value_display
from spanledger.functions.labels import has_explicit_token, legacy_from_arm
from spanledger.operators import audit, dataset, examples, resample, sampling
from spanledger.operators.records import case_indicators
from spanledger.plans import audits
from spanledger.session import materialize, scratch_path
from spanledger.sources import jsonl

SEED, N_BOOT = 42, 200


# ------------------------------------------------------------------ bootstrap
def means_cte(source: str, keys: str, n_boot: int = N_BOOT) -> str:
    m = resample.MODULUS
    return f"""
means AS MATERIALIZED (
  SELECT {keys}, n, n_pos, n_neg, b, CAST(count(*) FILTER (WHERE pos < n_pos) - count(*) FILTER (WHERE pos >= n - n_neg) AS DOUBLE) / n AS mean
  FROM (SELECT *, (x1 * {m} + (x1 * x1 + 69621 * x1 + 54321) % {m}) % n AS pos FROM (
    SELECT *, (x0 * x0 + 48271 * x0 + 12345) % {m} AS x1 FROM (
      SELECT *, (b * 1000003 + k * 7919 + {SEED * 104729}) % {m} AS x0 FROM (
        SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, unnest(range(0, {n_boot})) AS b FROM {source})))))
  GROUP BY {keys}, n, n_pos, n_neg, b
)"""


def _index(p: float, n_boot: int) -> int:
    return int(p * (n_boot - 1)) + 1


def grid_cte(n_boot: int = N_BOOT) -> str:
    low = (1 - 0.95) / 2
    return f"""
grid AS (
  SELECT scope, metric, arm_a, arm_b, diff, s[{_index(low, n_boot)}] AS ci_low, s[{_index(1 - low, n_boot)}] AS ci_high,
    least(1.0, 2.0 * opposite / {n_boot}) AS p_value, {n_boot} AS n_boot, {SEED} AS seed, n AS n_paired_cases
  FROM (SELECT scope, metric, arm_a, arm_b, n, CAST(n_pos - n_neg AS DOUBLE) / n AS diff, list_sort(list(mean)) AS s,
          count(*) FILTER (WHERE n_pos > n_neg AND mean <= 0 OR n_pos < n_neg AND mean >= 0 OR n_pos = n_neg) AS opposite
        FROM means GROUP BY scope, metric, arm_a, arm_b, n, n_pos, n_neg)
)"""


_GRID = (pairs_cte(), means_cte("pair_counts", "scope, metric, arm_a, arm_b"), grid_cte())


def grid(spark, d):
    return resample.comparison_grid(V.records(spark, d), seed=SEED, n_boot=N_BOOT)


@query("b2_b3_paired_bootstrap_grid", with_records("SELECT * FROM grid", *_GRID), doubles="diff ci_low ci_high p_value", longs="n_boot seed")
def _(spark, d):
    return grid(spark, d)


@query("p29_p_value_display", with_records(f"""SELECT scope, metric, arm_a, arm_b,
    CASE WHEN p_value IS NULL THEN 'n/a' WHEN p_value = 0 THEN '< 0.0050' ELSE printf('%.4f', CAST(p_value AS DOUBLE)) END AS shown,
    CASE WHEN p_value IS NULL THEN 'n/a' WHEN p_value <= 1.0 / {N_BOOT} THEN '< 0.0050' ELSE printf('%.4f', CAST(p_value AS DOUBLE)) END AS shown_baseline
    FROM grid""", *_GRID))
def _(spark, d):
    n = F.lit(N_BOOT)
    return grid(spark, d).select(
        "scope", "metric", "arm_a", "arm_b", p_value_display(F.col("p_value"), n).alias("shown"),
        p_value_display(F.col("p_value"), n, at_most_one_draw=True).alias("shown_baseline"))


@query("b17_arm_pair_table", with_records("""
    SELECT metric, scope, arm_a, arm_b, diff, ci_low, ci_high,
      CASE WHEN p_value = 0 THEN '< 0.0050' ELSE printf('%.4f', CAST(p_value AS DOUBLE)) END AS p_display,
      CASE WHEN ci_low <= 0 AND ci_high >= 0 THEN '' ELSE '**' END AS marker FROM grid""", *_GRID), doubles="diff ci_low ci_high")
def _(spark, d):
    return resample.arm_pair_table(grid(spark, d)).select(
        "metric", "scope", "arm_a", "arm_b", "diff", "ci_low", "ci_high", "p_display", "marker")


@query("b4_baseline_bootstrap", with_records(f"""
    SELECT target, system, diff, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high,
      least(1.0, 2.0 * least(count(*) FILTER (WHERE mean <= 0), count(*) FILTER (WHERE mean >= 0)) / {N_BOOT}) AS p_value,
      NOT (quantile_cont(mean, 0.025) <= 0 AND quantile_cont(mean, 0.975) >= 0) AS significant, n AS n_paired_cases
    FROM (SELECT *, CAST(n_pos - n_neg AS DOUBLE) / n AS diff FROM means) GROUP BY target, system, diff, n""",
    BASE, """
base_pairs AS (
  SELECT a.target, b.system, count(*) AS n, count(*) FILTER (WHERE a.correct AND NOT b.correct) AS n_pos,
         count(*) FILTER (WHERE NOT a.correct AND b.correct) AS n_neg
  FROM systems a JOIN systems b USING (case_id, target) WHERE a.system = 'baseline' AND b.system <> 'baseline' GROUP BY ALL
)""", means_cte("base_pairs", "target, system")), doubles="diff ci_low ci_high p_value", bools="significant")
def _(spark, d):
    return resample.baseline_comparison(V.system_rows(spark, d), V.BASELINE, seed=SEED, n_boot=N_BOOT).drop("p_display")


_M = resample.MODULUS


@query("b1_bootstrap_mean", with_records(f"""
    SELECT arm, target, n, point AS point_estimate, s[{_index(0.025, N_BOOT)}] AS ci_low, s[{_index(0.975, N_BOOT)}] AS ci_high, {N_BOOT} AS n_boot, {SEED} AS seed
    FROM (SELECT arm, target, n, CAST(yes AS DOUBLE) / n AS point, list_sort(list(mean)) AS s FROM (
      SELECT arm, target, n, yes, b, CAST(count(*) FILTER (WHERE pos >= n - yes) AS DOUBLE) / n AS mean
      FROM (SELECT *, (x1 * {_M} + (x1 * x1 + 69621 * x1 + 54321) % {_M}) % n AS pos FROM (
        SELECT *, (x0 * x0 + 48271 * x0 + 12345) % {_M} AS x1 FROM (
          SELECT *, (b * 1000003 + k * 7919 + {SEED * 104729}) % {_M} AS x0 FROM (
            SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, unnest(range(0, {N_BOOT})) AS b FROM (
              SELECT arm, target, count(*) AS n, count(*) FILTER (WHERE correct) AS yes FROM records WHERE ground_truth IS NOT NULL GROUP BY ALL))))))
      GROUP BY arm, target, n, yes, b) GROUP BY arm, target, n, yes)"""), doubles="point_estimate ci_low ci_high", longs="n_boot seed")
def _(spark, d):
    rows = case_indicators(V.records(spark, d))
    return resample.bootstrap_mean(rows, ["arm", "target"], "accuracy", seed=SEED, n_boot=N_BOOT)


def drawn_positions(source: str, n_boot: int = N_BOOT) -> str:
    """Rows of ``source`` (with a size n) for each replicate b and draw, with the drawn position pos."""
    return f"""(SELECT *, (x1 * {_M} + (x1 * x1 + 69621 * x1 + 54321) % {_M}) % n AS pos FROM (
      SELECT *, (x0 * x0 + 48271 * x0 + 12345) % {_M} AS x1 FROM (
        SELECT *, (b * 1000003 + k * 7919 + {SEED * 104729}) % {_M} AS x0 FROM (
          SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, unnest(range(0, {n_boot})) AS b FROM {source})))))"""


_REAL_BOOT = 40


def _real_values_sql(table: str, group: str, value: str) -> str:
    drawn = drawn_positions("sizes", _REAL_BOOT)
    return f"""
    WITH units AS MATERIALIZED (
      SELECT {group} AS grp, CAST({value} AS DOUBLE) AS value, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS pos
      FROM {table} WHERE {group} IS NOT NULL AND {value} IS NOT NULL),
    sizes AS (SELECT grp, count(*) AS n, avg(value) AS point FROM units GROUP BY grp),
    drawn AS (SELECT grp, b, n, point, pos FROM {drawn}),
    means AS (SELECT d.grp, d.n, d.point, d.b, avg(u.value) AS mean FROM drawn d JOIN units u ON u.grp = d.grp AND u.pos = d.pos GROUP BY d.grp, d.n, d.point, d.b)
    SELECT grp, n, round(point, 3) AS point_estimate, round(s[{_index(0.025, _REAL_BOOT)}], 3) AS ci_low,
      round(s[{_index(0.975, _REAL_BOOT)}], 3) AS ci_high
    FROM (SELECT grp, n, point, list_sort(list(mean)) AS s FROM means GROUP BY ALL)"""


@query("b1_bootstrap_mean_of_values", _real_values_sql("lineitem", "l_returnflag", "l_extendedprice"))
def _(spark, d):
    """Prices of all lines: nearly all values differ, so each group is cut into blocks of ranks."""
    rows = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").cast("double").alias("price"))
    found = resample.bootstrap_mean(rows, ["grp"], "price", seed=SEED, n_boot=_REAL_BOOT, block=4096)
    return found.select("grp", "n", *(F.round(c, 3).alias(c) for c in ("point_estimate", "ci_low", "ci_high")))


_CLUSTER_KEYS = "scope, metric, arm_a, arm_b"
_CLUSTERS = (pairs_cte(), f"""
clusters AS MATERIALIZED (
  SELECT {_CLUSTER_KEYS}, case_id, count(*) AS size, CAST(sum(d) AS BIGINT) AS total
  FROM (SELECT case_id, arm_a, arm_b, v.metric AS metric, v.d AS d, unnest(['overall', target]) AS scope FROM paired) GROUP BY ALL
),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {_CLUSTER_KEYS} ORDER BY total DESC, size) - 1 AS pos FROM clusters
),
cluster_sizes AS MATERIALIZED (
  SELECT {_CLUSTER_KEYS}, count(*) AS n, sum(size) AS units, CAST(sum(total) AS DOUBLE) / sum(size) AS diff FROM clusters GROUP BY ALL
),
cluster_means AS MATERIALIZED (
  SELECT {_CLUSTER_KEYS}, units, diff, b, CAST(sum(total) AS DOUBLE) / sum(size) AS mean
  FROM {drawn_positions("cluster_sizes")} d JOIN placed USING ({_CLUSTER_KEYS}, pos) GROUP BY ALL
),
cluster_grid AS (
  SELECT {_CLUSTER_KEYS}, diff, s[{_index((1 - 0.95) / 2, N_BOOT)}] AS ci_low, s[{_index(1 - (1 - 0.95) / 2, N_BOOT)}] AS ci_high,
    least(1.0, 2.0 * opposite / {N_BOOT}) AS p_value, {N_BOOT} AS n_boot, {SEED} AS seed, CAST(units AS BIGINT) AS n_paired_cases
  FROM (SELECT {_CLUSTER_KEYS}, units, diff, list_sort(list(mean)) AS s,
          count(*) FILTER (WHERE diff > 0 AND mean <= 0 OR diff < 0 AND mean >= 0 OR diff = 0) AS opposite
        FROM cluster_means GROUP BY ALL)
)""")


@query("b3_clustered_bootstrap_grid", with_records("SELECT * FROM cluster_grid", *_CLUSTERS), doubles="diff ci_low ci_high p_value", longs="n_boot seed")
def _(spark, d):
    """The grid with whole cases drawn: their targets stay together."""
    return resample.comparison_grid(V.records(spark, d), cluster="case_id", seed=SEED, n_boot=N_BOOT)


@query("b2_large_sample_bootstrap", with_records("SELECT * FROM grid", *_GRID), doubles="diff ci_low ci_high p_value", longs="n_boot seed")
def _(spark, d):
    """The draws of each replicate cut into many pieces, as for large samples; the rows are the same."""
    return resample.comparison_grid(V.records(spark, d), seed=SEED, n_boot=N_BOOT, piece=97)


# ------------------------------------------------------------------ samples
def _gold_reports(spark, d):
    return V.reports(spark, d).select("case_id", *(f"gold_{t}" for t in K.TARGETS))


@query("b5_stratified_sample", with_views("SELECT case_id, gold_T, gold_N, gold_M, sample_key FROM picked", stratified_sql(150, SEED)))
def _(spark, d):
    return sampling.stratified_sample(_gold_reports(spark, d), 150, SEED).select(
        "case_id", "gold_T", "gold_N", "gold_M", "sample_key")


@query("b5_stratified_sample_by_buckets", with_views("SELECT case_id, gold_T, gold_N, gold_M, sample_key FROM picked", stratified_sql(400, SEED)))
def _(spark, d):
    """The same operator on the path that large samples take."""
    return sampling.stratified_sample(_gold_reports(spark, d), 400, SEED).select(
        "case_id", "gold_T", "gold_N", "gold_M", "sample_key")


@query("a41_sampling_summary", with_views(f"""SELECT (SELECT count(*) FROM rep) AS total_reports, count(*) AS n_sampled, count(gold_T) AS n_with_T,
    count(gold_N) AS n_with_N, count(gold_M) AS n_with_M, count(*) FILTER (WHERE gold_T IS NOT NULL AND gold_N IS NOT NULL AND gold_M IS NOT NULL)
    AS n_with_all_TNM, {SEED} AS seed FROM picked""", stratified_sql(150, SEED)), longs="seed")
def _(spark, d):
    pool = _gold_reports(spark, d)
    return sampling.sampling_summary(pool, sampling.stratified_sample(pool, 150, SEED), SEED)


@query("b6_per_class_sample", with_views(f"""
    SELECT case_id, easy_M FROM (SELECT *, row_number() OVER (PARTITION BY easy_M ORDER BY md5('{SEED}|' || case_id)) AS place,
        (SELECT count(DISTINCT easy_M) FROM labelled) AS k FROM labelled) WHERE place <= 60 // k""", f"""
labelled AS MATERIALIZED (SELECT case_id, {has('text', '<L>p?M[01X]')} AS easy_M FROM rep
  WHERE gold_T IS NOT NULL AND gold_N IS NOT NULL AND gold_M IS NOT NULL)"""), bools="easy_M")
def _(spark, d):
    labelled = dataset.pool(V.reports(spark, d)).select("case_id", has_explicit_token(F.col("text"), "M").alias("easy_M"))
    return sampling.per_class_sample(labelled, "easy_M", 60, SEED).select("case_id", "easy_M")


_QUOTA_CASE = " ".join(f"WHEN boundary_tag = '{t}' AND letter = '{a}' THEN {n}" for t, a, n in K.BLIND_QUOTAS)
_LETTER = "CASE arm WHEN 'A_zero_shot' THEN 'A' WHEN 'C_constrained' THEN 'C' WHEN 'D_grounded' THEN 'D' END"
_CELLS = f"""
cells AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY boundary_tag, letter ORDER BY md5('7|' || case_id || '|' || arm)) AS place
    FROM (SELECT *, CASE {_QUOTA_CASE} END AS quota FROM (SELECT *, {_LETTER} AS letter FROM bnd WHERE target = 'M' AND gold IS NOT NULL))
    WHERE quota > 0) WHERE place <= quota
)"""


@query("b7_quota_cell_sample", with_boundary("SELECT case_id, arm, letter, boundary_tag FROM cells", _CELLS))
def _(spark, d):
    pool = V.boundary(spark, d).filter("target = 'M' and gold is not null").withColumn("letter", legacy_from_arm(F.col("arm")))
    return sampling.cell_sample(pool, ["boundary_tag", "letter"], K.BLIND_QUOTAS, 7, ids=["case_id", "arm"]).select(
        "case_id", "arm", "letter", "boundary_tag")


_RID = "md5('{seed}|' || case_id || '|' || arm || '|' || target)"


@query("b8_uniform_sample", with_records(f"""SELECT case_id, arm, target, prediction FROM records
    ORDER BY {_RID.format(seed=SEED)} LIMIT 3000"""))
def _(spark, d):
    return sampling.uniform_sample(V.records(spark, d), 3000, SEED, ids=audit.RECORD_IDS).select(
        "case_id", "arm", "target", "prediction")


COUNTS = {"T": 20, "N": 20, "M": 40}
_PATTERNS = """
patterns AS MATERIALIZED (
  SELECT case_id, target, CASE WHEN p IS NULL OR c IS NULL THEN 'pattern_unknown' WHEN NOT p AND NOT c THEN 'both_predict'
    WHEN NOT p THEN 'priority_predicts_comparison_abstains' WHEN NOT c THEN 'priority_abstains_comparison_predicts' ELSE 'both_abstain' END AS arm_pattern
  FROM (SELECT case_id, target, bool_or(abstained) FILTER (WHERE arm = 'C_constrained') AS p,
               bool_or(abstained) FILTER (WHERE arm = 'D_grounded') AS c FROM records GROUP BY ALL)
)"""
_SAMPLE = f"""
keyed AS MATERIALIZED (SELECT r.*, p.arm_pattern, {_RID.format(seed=SEED)} AS sample_key FROM records r JOIN patterns p USING (case_id, target)),
tier1 AS MATERIALIZED (SELECT sample_key FROM keyed WHERE target = 'M' AND arm = 'C_constrained' AND arm_pattern = 'priority_predicts_comparison_abstains'
  ORDER BY sample_key LIMIT 20),
each_n AS MATERIALIZED (SELECT CAST(floor((40 - (SELECT count(*) FROM tier1)) * 0.3) AS BIGINT) AS e),
tier2 AS MATERIALIZED (SELECT sample_key FROM (SELECT sample_key, row_number() OVER (PARTITION BY sem ORDER BY sample_key) AS place FROM keyed
  WHERE target = 'M' AND sem IS NOT NULL AND sample_key NOT IN (SELECT sample_key FROM tier1)) WHERE place <= (SELECT e FROM each_n)),
tier3 AS MATERIALIZED (SELECT sample_key FROM (SELECT sample_key, row_number() OVER (ORDER BY sample_key) AS place FROM keyed WHERE target = 'M'
  AND sample_key NOT IN (SELECT sample_key FROM tier1 UNION ALL SELECT sample_key FROM tier2))
  WHERE place <= 40 - (SELECT count(*) FROM tier1) - (SELECT count(*) FROM tier2)),
sampled AS MATERIALIZED (
  SELECT keyed.*, 'uniform' AS tier FROM keyed WHERE sample_key IN (SELECT sample_key FROM (
    SELECT sample_key, row_number() OVER (PARTITION BY target ORDER BY sample_key) AS place FROM keyed WHERE target <> 'M') WHERE place <= 20)
  UNION ALL SELECT keyed.*, 'priority' FROM keyed WHERE sample_key IN (SELECT sample_key FROM tier1)
  UNION ALL SELECT keyed.*, 'semantic_balance' FROM keyed WHERE sample_key IN (SELECT sample_key FROM tier2)
  UNION ALL SELECT keyed.*, 'random_fill' FROM keyed WHERE sample_key IN (SELECT sample_key FROM tier3)
)"""


def sampled(spark, d):
    recs = materialize(V.records(spark, d), "records")
    return recs, audit.audit_sample(recs, COUNTS, SEED)


@query("b9_tiered_audit_sample", with_records("SELECT case_id, arm, target, tier FROM sampled", _PATTERNS, _SAMPLE))
def _(spark, d):
    return sampled(spark, d)[1].select("case_id", "arm", "target", "tier")


@query("b9_sampling_report", with_records("""SELECT target, CASE target WHEN 'M' THEN 40 ELSE 20 END AS requested, count(*) AS selected,
    count(*) FILTER (WHERE tier = 'priority') AS priority_selected, count(*) FILTER (WHERE tier = 'semantic_balance') AS semantic_balance_selected,
    count(*) FILTER (WHERE tier = 'random_fill') AS random_fill_selected FROM sampled GROUP BY target""", _PATTERNS, _SAMPLE), longs="requested")
def _(spark, d):
    return audit.sampling_report(sampled(spark, d)[1], COUNTS)


@query("b10_arm_patterns", with_records("SELECT case_id, target, arm_pattern FROM patterns", _PATTERNS))
def _(spark, d):
    return audit.arm_patterns(V.records(spark, d))


_NAMED = f"""
named AS MATERIALIZED (SELECT *, printf('A%04d', row_number() OVER (ORDER BY {_RID.format(seed=SEED + 1)})) AS audit_id FROM sampled)"""


@query("b11_reviewer_sheet", with_records(f"""SELECT audit_id, target, md5({AUDIT_EXCERPT_SQL}) AS excerpt_md5, {AUDIT_TRUNCATED_SQL} AS report_truncated,
    prediction, evidence, ground_truth FROM named n JOIN (SELECT case_id, text FROM rep) USING (case_id)""", _PATTERNS, _SAMPLE, _NAMED), bools="report_truncated")
def _(spark, d):
    recs, sample = sampled(spark, d)
    reviewer, _key = audit.blinded_bundle(recs, V.reports(spark, d), sample, SEED, "with-gold")
    return reviewer.select("audit_id", "target", F.md5("report_excerpt").alias("excerpt_md5"), "report_truncated",
                           "prediction", "evidence", "ground_truth")


@query("b11_key_sheet", with_records("""SELECT audit_id, case_id, arm, target, ground_truth, prediction, span AS automated_evidence_span_found,
    sem AS automated_semantic_support, errors AS automated_errors, CASE WHEN target = 'M' THEN arm_pattern END AS arm_pattern FROM named""",
    _PATTERNS, _SAMPLE, _NAMED), bools="automated_evidence_span_found automated_semantic_support", arrays="automated_errors")
def _(spark, d):
    recs, sample = sampled(spark, d)
    return audit.blinded_bundle(recs, V.reports(spark, d), sample, SEED)[1]


@query("b13_audit_sheet", with_records(f"""SELECT case_id, arm, target, md5({_head_sql(4000)}) AS excerpt_md5, ground_truth, prediction, evidence,
    span AS automated_evidence_span_found, sem AS automated_semantic_support, errors AS automated_errors
    FROM (SELECT * FROM records ORDER BY {_RID.format(seed=SEED)} LIMIT 25) JOIN (SELECT case_id, text FROM rep) USING (case_id)"""),
    bools="automated_evidence_span_found automated_semantic_support", arrays="automated_errors")
def _(spark, d):
    sheet = audit.audit_sheet(V.records(spark, d), V.reports(spark, d), 25, SEED)
    return sheet.select("case_id", "arm", "target", F.md5("report_excerpt").alias("excerpt_md5"), "ground_truth", "prediction",
                        "evidence", "automated_evidence_span_found", "automated_semantic_support", "automated_errors")


@query("b14_m_annotation_sheet", with_records(f"""SELECT case_id, arm, md5(x) AS excerpt_md5, m_class AS automated_category, prediction, ground_truth,
    span AS evidence_span_found, sem AS evidence_semantically_supports_prediction
    FROM records JOIN (SELECT case_id, {_M_EXCERPT} AS x, {_M_CLASS} AS m_class FROM rep) USING (case_id) WHERE target = 'M'"""),
    bools="evidence_span_found evidence_semantically_supports_prediction")
def _(spark, d):
    sheet = audit.m_annotation_sheet(V.records(spark, d), V.reports(spark, d))
    return sheet.select("case_id", "arm", F.md5("report_excerpt").alias("excerpt_md5"), "automated_category", "prediction",
                        "ground_truth", "evidence_span_found", "evidence_semantically_supports_prediction")


_SHEET = """
numbered AS MATERIALIZED (SELECT *, printf('case_%02d', row_number() OVER (ORDER BY md5('11|' || case_id || '|' || arm))) AS sheet_id FROM cells)"""


@query("b15_blind_tag_sheet", with_boundary(f"""SELECT sheet_id AS case_id, md5({_head_sql(6000)}) AS text_md5, length(text) > 6000 AS truncated,
    gold AS gold_M, value_norm AS predicted_M_value, value AS predicted_M_raw, evidence AS submitted_evidence
    FROM numbered n JOIN (SELECT case_id, text FROM rep) r USING (case_id)""", _CELLS, _SHEET), bools="truncated")
def _(spark, d):
    sheet, _key = audit.tag_sheet(V.boundary(spark, d), V.reports(spark, d))
    return sheet.withColumn("text_md5", F.md5("report_text")).drop("report_text")


@query("b15_answer_key", with_boundary(
    "SELECT sheet_id AS case_id, letter AS arm, case_id AS patient_id, boundary_tag AS pipeline_tag FROM numbered", _CELLS, _SHEET))
def _(spark, d):
    return audit.tag_sheet(V.boundary(spark, d), V.reports(spark, d))[1]


# ------------------------------------------------------------------ audit scores
REVIEWS = """
reviews AS MATERIALIZED (
  SELECT r.case_id || '|' || r.arm || '|' || r.target AS audit_id, r.*, CASE WHEN r.target = 'M' THEN p.arm_pattern END AS arm_pattern,
    l.quality = 1 AS h_span, l.quality = 1 AND l.toxic = 0 AS h_sem, l.toxic = 0 AS h_ok,
    CASE WHEN l.doc_id % 2 = 0 THEN l.toxic = 0 END AS h_inf
  FROM records r LEFT JOIN labels l ON l.doc_id = r.doc_id LEFT JOIN patterns p ON p.case_id = r.case_id AND p.target = r.target
)"""


def agreement_sql(a: str, h: str, source: str, keys: str) -> str:
    return f"""SELECT {keys}, n, (tp + tn) / nullif(CAST(n AS DOUBLE), 0) AS percent_agreement,
      CASE WHEN n >= 2 AND tp < n AND tn < n THEN ((tp + tn) / CAST(n AS DOUBLE) - pe) / nullif(1 - pe, 0) END AS cohens_kappa, tp, fp, tn, fn,
      tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS precision, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall,
      tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS specificity
    FROM (SELECT *, (CAST(tp + fp AS DOUBLE) * (tp + fn) + CAST(fn + tn AS DOUBLE) * (fp + tn)) / nullif(CAST(n AS DOUBLE) * n, 0) AS pe FROM (
      SELECT {keys}, count(*) FILTER (WHERE {a} IS NOT NULL AND {h} IS NOT NULL) AS n, count(*) FILTER (WHERE {a} AND {h}) AS tp,
        count(*) FILTER (WHERE {a} AND NOT {h}) AS fp, count(*) FILTER (WHERE NOT {a} AND NOT {h}) AS tn,
        count(*) FILTER (WHERE NOT {a} AND {h}) AS fn FROM {source} GROUP BY {keys}))"""


_AGREE_DOUBLES = "percent_agreement cohens_kappa precision recall specificity"
_PAIRS = """(SELECT unnest(['overall', target]) AS scope, 'evidence_span_found' AS field, span AS a, h_span AS h FROM reviews
  UNION ALL SELECT unnest(['overall', target]), 'semantic_support', sem, h_sem FROM reviews)"""


_SHEET_PAIRS = """(SELECT unnest(['overall', target]) AS scope, field, a, h FROM (
  SELECT target, 'evidence_span_found' AS field, span AS a, CASE WHEN evidence IS NOT NULL THEN length(evidence) % 3 <> 0 END AS h FROM named
  UNION ALL SELECT target, 'semantic_support', sem, CASE WHEN evidence IS NOT NULL THEN prediction <> 'INVALID' AND length(evidence) % 2 = 0 END FROM named))"""


@query("b12_audit_job", with_records(agreement_sql("a", "h", _SHEET_PAIRS, "scope, field"), _PATTERNS, _SAMPLE, _NAMED), doubles=_AGREE_DOUBLES)
def _(spark, d):
    """The job draws the sample and writes the bundle; the sheet is filled in by what a reviewer sees; the job scores it."""
    output = scratch_path(spark, "audit-job")
    audits.build(materialize(V.records(spark, d), "records"), V.reports(spark, d), COUNTS, SEED, output)
    sheet = jsonl.read_audit(spark, f"{output}/reviewer")
    seen = F.col("evidence").isNotNull()
    filled = sheet.withColumns({
        "human_evidence_span_found": F.when(seen, F.length("evidence") % 3 != 0),
        "human_semantic_support": F.when(seen, (F.col("prediction") != "INVALID") & (F.length("evidence") % 2 == 0)),
    })
    jsonl.write_lines(filled, f"{output}/filled")
    return audits.score(spark, f"{output}/filled", f"{output}/key", output=f"{output}/scores").agreement


@query("a36_review_scores", with_records(agreement_sql("a", "h", _PAIRS, "scope, field"), _PATTERNS, REVIEWS), doubles=_AGREE_DOUBLES)
def _(spark, d):
    return audit.review_scores(V.reviews(spark, d))


@query("a34_a35_agreement_and_kappa", with_records(agreement_sql("span", "h_span", "reviews", "arm, target"), _PATTERNS, REVIEWS), doubles=_AGREE_DOUBLES)
def _(spark, d):
    return audit.agreement(V.reviews(spark, d), ["arm", "target"], "automated_evidence_span_found", "human_evidence_span_found")


@query("a37_sheet_scores", with_records(
    "SELECT judgment, n AS n_scored, percent_agreement, cohens_kappa FROM ("
    + agreement_sql("a", "h", "(SELECT 'supported' AS judgment, span AS a, h_span AS h FROM reviews UNION ALL SELECT 'prediction_correct', correct, h_ok FROM reviews)", "judgment")
    + ")", _PATTERNS, REVIEWS), doubles="percent_agreement cohens_kappa")
def _(spark, d):
    return audit.sheet_scores(V.reviews(spark, d).withColumn("human_supported", F.col("human_evidence_span_found")))


def _shares(pairs) -> str:
    return ", ".join(f"avg(CAST({h} AS INTEGER)) AS pct_{n}, count({h}) AS n_{n.removesuffix('_present')}_scored" for n, h in pairs)


_SHARE_NAMES = (("source_sufficient", "h_ok"), ("explicit_stage", "h_span"), ("inferential_evidence", "h_inf"))


@query("a38_source_sufficiency", with_records(f"""SELECT scope, count(*) AS n_reviewed, {_shares(_SHARE_NAMES)}
    FROM (SELECT *, unnest(CASE WHEN target = 'M' THEN ['overall', target, 'M:' || arm_pattern] ELSE ['overall', target] END) AS scope FROM reviews)
    GROUP BY scope""", _PATTERNS, REVIEWS), doubles=" ".join(f"pct_{n}" for n, _ in _SHARE_NAMES))
def _(spark, d):
    return audit.source_sufficiency(V.reviews(spark, d))


_PRIOR = (("source_sufficient", "h_ok"), ("semantic_support", "h_sem"), ("explicit_m_token_present", "h_span"))


@query("a39_prior_predictions", with_records(f"""SELECT count(*) AS n, avg(CAST(coalesce(ground_truth = 'M0', false) AS INTEGER)) AS accuracy, {_shares(_PRIOR)}
    FROM reviews WHERE arm = 'C_constrained' AND target = 'M' AND prediction = 'M0'""", _PATTERNS, REVIEWS),
    doubles="accuracy " + " ".join(f"pct_{n}" for n, _ in _PRIOR))
def _(spark, d):
    return audit.prior_predictions(V.reviews(spark, d))


@query("j5_reviewer_with_key", with_records("""SELECT audit_id, case_id, arm, target, prediction, h_span AS human_evidence_span_found,
    span AS automated_evidence_span_found, arm_pattern FROM reviews""", _PATTERNS, REVIEWS), bools="human_evidence_span_found automated_evidence_span_found")
def _(spark, d):
    joined = V.reviews(spark, d)
    reviewer = joined.select("audit_id", "target", "prediction", "evidence", "human_evidence_span_found")
    key = joined.select("audit_id", "case_id", "arm", "target", "prediction", "automated_evidence_span_found", "arm_pattern")
    # every key row comes twice, the first time with a wrong target; the later one counts
    twice = key.withColumn("row_no", F.lit(1)).unionByName(
        key.withColumn("arm_pattern", F.lit("stale")).withColumn("row_no", F.lit(0)))
    return audit.unblind(reviewer, twice, "row_no").select(
        "audit_id", "case_id", "arm", "target", "prediction", "human_evidence_span_found", "automated_evidence_span_found", "arm_pattern")


@query("j14_rescored_key", with_records("SELECT audit_id, span AS automated_evidence_span_found, sem AS automated_semantic_support FROM reviews", _PATTERNS, REVIEWS),
       bools="automated_evidence_span_found automated_semantic_support")
def _(spark, d):
    joined = V.reviews(spark, d)
    stale = F.when(F.col("automated_evidence_span_found").isNotNull(), False)
    key = joined.select("audit_id", "target", "prediction", "automated_evidence_span_found", stale.alias("automated_semantic_support"))
    return audit.rescore_key(key, joined.select("audit_id", "evidence")).select(
        "audit_id", "automated_evidence_span_found", "automated_semantic_support")


_JUDGED = """
judged AS MATERIALIZED (
  SELECT case_id || '|' || arm AS case_id, arm, boundary_tag AS pipeline_tag,
    CASE WHEN doc_id % 7 <> 0 THEN boundary_tag WHEN boundary_tag = 'correct' THEN 'unsupported_error' ELSE 'correct' END AS judge_tag,
    CASE WHEN doc_id % 5 = 0 THEN 'scan is hard to read' END AS caveat
  FROM bnd WHERE target = 'M' AND boundary_tag IS NOT NULL
)"""


def judged(spark, d):
    return audit.judge_rows(*V.judgments(spark, d))


@query("j13_judge_with_answers", with_boundary(
    "SELECT case_id, arm, pipeline_tag, judge_tag, judge_tag = pipeline_tag AS agree, caveat FROM judged", _JUDGED), bools="agree")
def _(spark, d):
    return judged(spark, d)


@query("a40_tag_agreement", with_boundary("""SELECT tag, count(*) AS n, count(*) FILTER (WHERE judge_tag = pipeline_tag) AS n_agree,
    avg(CAST(judge_tag = pipeline_tag AS INTEGER)) AS agreement, count(caveat) AS n_caveats
    FROM (SELECT *, unnest(['overall', pipeline_tag]) AS tag FROM judged) GROUP BY tag""", _JUDGED), doubles="agreement")
def _(spark, d):
    return audit.tag_agreement(judged(spark, d))


@query("a40_disagreements", with_boundary("SELECT case_id, arm, pipeline_tag, judge_tag, caveat FROM judged WHERE judge_tag <> pipeline_tag", _JUDGED))
def _(spark, d):
    return audit.disagreements(judged(spark, d))


# ------------------------------------------------------------------ single cases
@query("p20_triage_view", with_boundary("SELECT case_id, max(gold) AS gold_M, " + ", ".join(
    f"max(value_norm) FILTER (WHERE letter = '{a}') AS {a}_M, max(boundary_tag) FILTER (WHERE letter = '{a}') AS {a}_tag" for a in K.LEGACY_ARMS)
    + f" FROM (SELECT *, {_LETTER} AS letter FROM bnd WHERE target = 'M') GROUP BY case_id"))
def _(spark, d):
    return examples.triage_view(V.boundary(spark, d))


def _arm_tags(a: str) -> str:
    c, s = f"coalesce({a}.correct, false)", f"coalesce({a}.sem, false)"
    return f"""CASE WHEN {a}.abstained THEN ['abstained'] ELSE list_filter([
      CASE WHEN {c} AND {a}.span AND {s} THEN 'correct_grounded' END, CASE WHEN {c} AND {a}.span AND NOT {s} THEN 'correct_unsupported' END,
      CASE WHEN NOT {c} AND {s} THEN 'wrong_grounded' END, CASE WHEN {a}.span AND NOT {s} THEN 'span_not_supporting' END,
      CASE WHEN {a}.target = 'M' AND {a}.ground_truth = 'M0' AND {a}.prediction = 'M0' AND {c} AND NOT {s} THEN 'm0_unsupported' END], lambda x: x IS NOT NULL) END"""


_TITLE = "CASE " + " ".join(f"WHEN list_contains(tags, '{t}') THEN {lit(title)}" for t, title in K.EXAMPLE_TITLES) + f" ELSE {lit(K.EXAMPLE_FALLBACK_TITLE)} END"
_TAGGED = f"""
tagged AS MATERIALIZED (
  SELECT *, {_TITLE} AS title FROM (
    SELECT a.case_id, a.target, a.ground_truth AS gold, list_sort(list_distinct(flatten([{', '.join(_arm_tags(x) for x in 'acpd')}, list_filter([
      CASE WHEN d.abstained <> p.abstained OR (NOT d.abstained AND NOT p.abstained AND (d.sem IS DISTINCT FROM p.sem OR d.prediction <> p.prediction))
        THEN 'evidence_binding_change' END, CASE WHEN NOT c.abstained AND d.abstained THEN 'c_asserts_d_abstains' END], lambda x: x IS NOT NULL)]))) AS tags
    FROM records a JOIN records c USING (case_id, target) JOIN records p USING (case_id, target) JOIN records d USING (case_id, target)
    WHERE a.arm = 'A_zero_shot' AND c.arm = 'C_constrained' AND p.arm = 'C_plus_unknown' AND d.arm = 'D_grounded')
)"""


@query("p27_p28_category_tags_and_titles", with_records("SELECT case_id, target, gold, tags, title FROM tagged", _TAGGED), arrays="tags")
def _(spark, d):
    return examples.tagged_cases(V.records(spark, d)).select("case_id", "target", "gold", "tags", "title")


def _greedy_sql() -> str:
    """The curated choice, one step per tag over everything."""
    steps = ["pick0 AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS ord, case_id, target FROM tagged "
             "WHERE case_id = 'D000000000000' AND target = 'M')"]
    for i, (tag, quota) in enumerate(K.EXAMPLE_QUOTAS, start=1):
        before = " UNION ALL ".join(f"SELECT * FROM pick{j}" for j in range(i))
        steps.append(f"""pick{i} AS MATERIALIZED (
  WITH pool AS (SELECT case_id, target, count(*) OVER () AS size, row_number() OVER (PARTITION BY target ORDER BY case_id) AS turn
    FROM tagged t WHERE list_contains(tags, '{tag}') AND NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.case_id = t.case_id AND b.target = t.target))
  SELECT CAST({i} AS BIGINT) AS step, ord, case_id, target FROM (SELECT *, row_number() OVER (ORDER BY size > {quota} AND turn > 1, target, case_id) AS ord FROM pool)
  WHERE ord <= {quota})""")
    every = " UNION ALL ".join(f"SELECT * FROM pick{j}" for j in range(len(K.EXAMPLE_QUOTAS) + 1))
    steps.append(f"chosen AS (SELECT row_number() OVER (ORDER BY step, ord) - 1 AS position, case_id, target FROM ({every}))")
    return ",\n".join(steps)


@query("b16_curated_examples", with_records(f"""SELECT position, printf('case-%02d', position) AS id, printf('Case %02d', position + 1) AS display_id,
    title, case_id, target, gold, tags AS categories, md5(regexp_replace(text, {pattern(K.PERSONAL_DATA)}, '[redacted]', 'g')) AS report_md5
    FROM chosen JOIN tagged USING (case_id, target) JOIN (SELECT case_id, text FROM rep) USING (case_id)""", _TAGGED, _greedy_sql()), arrays="categories")
def _(spark, d):
    tagged = materialize(examples.tagged_cases(V.records(spark, d)), "tagged")
    chosen = examples.curated_examples(tagged, ("D000000000000", "M"), reports=V.reports(spark, d))
    return chosen.withColumn("report_md5", F.md5("report")).drop("report", *K.STUDY_ARMS)

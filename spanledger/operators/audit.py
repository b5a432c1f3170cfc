"""Blinded audits: tiered samples, reviewer and key sheets, agreement scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions import taxonomy
from spanledger.functions.formats import ratio
from spanledger.functions.labels import legacy_from_arm
from spanledger.functions.support import semantic_support
from spanledger.functions.text import audit_excerpt, head_with_mark, m_evidence_class, m_excerpt
from spanledger.operators.dataset import last_row_per_key, lookup_join, with_text
from spanledger.operators.sampling import cell_sample, draw_key, numbered, take_first, uniform_sample

RECORD_IDS = ["case_id", "arm", "target"]
HUMAN_FLAGS = (
    "human_evidence_span_found", "human_semantic_support", "human_prediction_correct",
    "human_source_has_explicit_stage", "human_source_has_inferential_evidence",
    "human_source_sufficient_for_stage",
)
SCOPES = ("overall", *K.TARGETS)


# ------------------------------------------------------------------ patterns and samples
def arm_patterns(records: DataFrame, priority: str = K.ARM_CONSTRAINED, comparison: str = K.ARM_GROUNDED) -> DataFrame:
    """Abstention pattern of two arms per (case, target)."""
    def abstained(arm: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col("abstained")))

    return records.groupBy("case_id", "target").agg(
        abstained(priority).alias("p"), abstained(comparison).alias("c")
    ).select("case_id", "target", taxonomy.arm_pattern(F.col("p"), F.col("c")).alias("arm_pattern"))


def audit_sample(
    records: DataFrame, target_counts: dict[str, int], seed: int, *,
    priority: str = K.ARM_CONSTRAINED, comparison: str = K.ARM_GROUNDED,
    priority_fraction: float = 0.5, balance_fraction: float = 0.3,
) -> DataFrame:
    """Rows per target; for M in tiers: diagnostic cases, both support classes, then anything.

    Adds ``tier`` and ``sample_key``.  A tier takes the first rows of its pool in hash order that no
    earlier tier took, and tiers together take at most the quota, so twice the quota of rows per
    pool hold every possible choice; the tier logic runs on those rows only.
    """
    keyed = records.withColumn("sample_key", draw_key(seed, *RECORD_IDS))
    plain = {t: n for t, n in target_counts.items() if t != "M"}
    parts = []
    if plain:
        quota = F.coalesce(*(F.when(F.col("target") == t, n) for t, n in plain.items()))
        parts.append(take_first(
            keyed.filter(F.col("target").isin(*plain)), ["target"], quota,
            key="sample_key",
        ).withColumn("tier", F.lit("uniform")))
    if "M" in target_counts:
        parts.append(_tiered(keyed.filter(F.col("target") == "M"), target_counts["M"], priority, comparison,
                             priority_fraction, balance_fraction))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _tiered(m_records: DataFrame, quota: int, priority: str, comparison: str,
            priority_fraction: float, balance_fraction: float) -> DataFrame:
    support = F.col("evidence_semantically_supports_prediction")
    diagnostic = (F.col("arm") == priority) & (F.col("arm_pattern") == K.ARM_PATTERNS[1])
    patterned = m_records.join(arm_patterns(m_records, priority, comparison), ["case_id", "target"])
    pools = F.array_compact(F.array(
        F.when(diagnostic, "priority"), F.when(~support, "unsupported"), F.when(support, "supported"),
        F.lit("any"),
    ))
    columns = [c for c in m_records.columns]
    pooled = patterned.select(*columns, F.explode(pools).alias("pool"))
    first = take_first(pooled, ["pool"], 2 * quota, key="sample_key")
    # from here on at most four pools of 2 * quota rows
    everything = Window.partitionBy()
    rows = first.groupBy(*RECORD_IDS, "sample_key").agg(F.collect_set("pool").alias("pools"))

    def in_pool(name: str) -> Column:
        return F.array_contains("pools", name)

    def pick(df: DataFrame, name: str, eligible: Column, limit: Column) -> DataFrame:
        free = eligible & F.col("tier").isNull()
        place = F.row_number().over(Window.partitionBy(free).orderBy("sample_key"))
        return df.withColumn("_limit", limit).withColumn("_place", place).withColumn(
            "tier", F.when(free & (F.col("_place") <= F.col("_limit")), name).otherwise(F.col("tier"))
        ).drop("_limit", "_place")

    taken = F.sum(F.col("tier").isNotNull().cast("int")).over(everything)
    rows = rows.withColumn("tier", F.lit(None).cast("string"))
    rows = pick(rows, "priority", in_pool("priority"), F.lit(math.ceil(quota * priority_fraction)))
    rows = rows.withColumn("_each", F.floor((F.lit(quota) - taken) * F.lit(balance_fraction)))
    rows = pick(rows, "semantic_balance", in_pool("unsupported"), F.col("_each"))
    rows = pick(rows, "semantic_balance", in_pool("supported"), F.col("_each"))
    rows = pick(rows, "random_fill", in_pool("any"), F.lit(quota) - taken)
    chosen = rows.filter(F.col("tier").isNotNull()).select(*RECORD_IDS, "tier")
    return m_records.join(F.broadcast(chosen), RECORD_IDS)  # at most the quota


def sampling_report(sample: DataFrame, target_counts: dict[str, int]) -> DataFrame:
    """Requested and achieved rows per target and tier."""
    requested = F.coalesce(*(F.when(F.col("target") == t, n) for t, n in target_counts.items()))
    return sample.groupBy("target").agg(
        F.count(F.lit(1)).alias("selected"),
        *(F.count_if(F.col("tier") == t).alias(f"{t}_selected")
          for t in ("priority", "semantic_balance", "random_fill")),
    ).select("target", requested.cast("long").alias("requested"), "selected", "priority_selected",
             "semantic_balance_selected", "random_fill_selected")


# ------------------------------------------------------------------ sheets
def blinded_bundle(
    records: DataFrame, reports: DataFrame, sample: DataFrame, seed: int, mode: str = K.AUDIT_MODES[0], *,
    priority: str = K.ARM_CONSTRAINED, comparison: str = K.ARM_GROUNDED,
) -> tuple[DataFrame, DataFrame]:
    """(reviewer, key) sheets of a sample, joined only by the audit id.

    The reviewer sheet has no arm, no case id and no automated judgment, and gold only in the mode
    ``with-gold``.  Ids follow a second hash order, so they do not give away the sampling tier.
    """
    if mode not in K.AUDIT_MODES:
        raise ValueError(f"unknown audit mode: {mode!r}, expected one of {K.AUDIT_MODES}")
    shuffled = numbered(sample.withColumn("_order", draw_key(seed + 1, *RECORD_IDS)), "_order", "number")
    # an audit's quota is what people can read, so its case ids go to the reports and records and not these to them
    cases = sample.select("case_id").distinct()
    texts = reports.join(F.broadcast(cases), "case_id", "left_semi")
    rows = with_text(shuffled.withColumn("audit_id", F.format_string("A%04d", "number")), texts)
    blank = [F.lit(None).cast("boolean").alias(h) for h in HUMAN_FLAGS]
    reviewer = rows.withColumn("excerpt", audit_excerpt(F.col("text"), F.col("evidence"))).select(
        "audit_id", "target", "excerpt.report_excerpt", "excerpt.report_truncated", "prediction", "evidence",
        *blank, F.lit("").alias("human_confidence"), F.lit("").alias("human_error_type"),
        F.lit("").alias("reviewer_notes"), *(["ground_truth"] if mode == "with-gold" else []),
    )
    m_cases = records.filter(F.col("target") == "M").join(
        F.broadcast(sample.filter(F.col("target") == "M").select("case_id").distinct()), "case_id", "left_semi"
    )
    patterns = arm_patterns(m_cases, priority, comparison)
    key = shuffled.withColumn("audit_id", F.format_string("A%04d", "number")).join(
        patterns, ["case_id", "target"], "left"
    ).select(
        "audit_id", "case_id", "arm", "target", "ground_truth", "prediction",
        F.col("evidence_span_found").alias("automated_evidence_span_found"),
        F.col("evidence_semantically_supports_prediction").alias("automated_semantic_support"),
        F.col("errors").alias("automated_errors"), "arm_pattern",
    )
    return reviewer, key


def audit_sheet(records: DataFrame, reports: DataFrame, n: int, seed: int) -> DataFrame:
    """Single-file sheet of the first audit format, arm visible, blank human columns."""
    rows = with_text(uniform_sample(records, n, seed, ids=RECORD_IDS), reports)
    return rows.select(
        *RECORD_IDS, head_with_mark(F.col("text"), K.LEGACY_SHEET_MAX).alias("report_excerpt"),
        "ground_truth", "prediction", "evidence",
        F.col("evidence_span_found").alias("automated_evidence_span_found"),
        F.col("evidence_semantically_supports_prediction").alias("automated_semantic_support"),
        F.col("errors").alias("automated_errors"),
        *(F.lit(None).cast("boolean").alias(h)
          for h in ("human_supported", "human_evidence_correct", "human_prediction_correct")),
        F.lit("").alias("human_error_type"), F.lit("").alias("reviewer_notes"),
    )


def m_annotation_sheet(records: DataFrame, reports: DataFrame, target: str = "M") -> DataFrame:
    """Every record of the target with an excerpt, its evidence class and blank human columns.

    Excerpt and class depend on the report alone and are computed before the join.
    """
    views = reports.select("case_id", m_excerpt(F.col("text")).alias("x"), m_evidence_class(F.col("text")).alias("c"))
    return records.filter(F.col("target") == target).join(views, "case_id", "left").select(
        "case_id", "arm", F.coalesce("x", F.lit("")).alias("report_excerpt"),
        F.coalesce("c", F.lit(K.M_CLASSES[2])).alias("automated_category"), "prediction", "ground_truth",
        "evidence_span_found", "evidence_semantically_supports_prediction",
        F.lit("").alias("human_category"), F.lit("").alias("notes"),
    )


def tag_sheet(rows: DataFrame, reports: DataFrame, *, seed: int = 7, shuffle_seed: int = 11,
              quotas=K.BLIND_QUOTAS, target: str = "M") -> tuple[DataFrame, DataFrame]:
    """(blinded sheet, answer key) of a (boundary tag, arm) quota sample of first-generation rows."""
    pool = rows.filter((F.col("target") == target) & F.col("gold").isNotNull()).withColumn(
        "letter", legacy_from_arm(F.col("arm"))
    )
    picked = cell_sample(pool, ["boundary_tag", "letter"], quotas, seed, ids=["case_id", "arm"])
    shuffled = numbered(picked.withColumn("_order", draw_key(shuffle_seed, "case_id", "arm")), "_order", "number")
    named = shuffled.withColumnRenamed("case_id", "patient_id").withColumn(
        "case_id", F.format_string("case_%02d", "number")
    )
    text = reports.select(F.col("case_id").alias("patient_id"), "text")
    sheet = named.join(text, "patient_id", "left").select(
        "case_id", head_with_mark(F.col("text"), K.BLIND_SHEET_MAX).alias("report_text"),
        (F.length("text") > K.BLIND_SHEET_MAX).alias("truncated"), F.col("gold").alias(f"gold_{target}"),
        F.col("value_norm").alias(f"predicted_{target}_value"), F.col("value").alias(f"predicted_{target}_raw"),
        F.col("evidence").alias("submitted_evidence"),
    )
    key = named.select("case_id", F.col("letter").alias("arm"), "patient_id", F.col("boundary_tag").alias("pipeline_tag"))
    return sheet, key


# ------------------------------------------------------------------ agreement
def unblind(reviewer: DataFrame, key: DataFrame, order: str | None = None) -> DataFrame:
    """Reviewer rows with their key; the reviewer's columns win, the last of repeated keys counts."""
    unique = last_row_per_key(key, ["audit_id"], order) if order else key
    shared = [c for c in unique.columns if c in reviewer.columns and c != "audit_id"]
    return reviewer.join(unique.drop(*shared), "audit_id")


def agreement(pairs: DataFrame, by: list[str], automated: str, human: str) -> DataFrame:
    """2x2 counts, agreement, kappa, precision, recall and specificity of two boolean columns.

    Pairs with a NULL side do not count.  Kappa is the closed form over the four counts; it is NULL
    for fewer than two pairs or when only one label occurs.
    """
    a, h = F.col(automated), F.col(human)
    counts = pairs.groupBy(*by).agg(
        F.count_if(a & h).alias("tp"), F.count_if(a & ~h).alias("fp"),
        F.count_if(~a & ~h).alias("tn"), F.count_if(~a & h).alias("fn"),
    )
    return _with_rates(counts, by)


def _with_rates(counts: DataFrame, by: list[str]) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    observed = F.try_divide(tp + tn, n)
    expected = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    two_labels = (n >= 2) & (tp < n) & (tn < n)
    return counts.select(
        *by, n.cast("long").alias("n"), observed.alias("percent_agreement"),
        F.when(two_labels, F.try_divide(observed - expected, 1 - expected)).alias("cohens_kappa"),
        "tp", "fp", "tn", "fn",
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(tn, tn + fp).alias("specificity"),
    )


def _scoped(df: DataFrame) -> DataFrame:
    return df.withColumn("scope", F.explode(F.array(F.lit("overall"), F.col("target"))))


def _all_scopes(df: DataFrame, scopes: list[str], extra: str | None = None, values=()) -> DataFrame:
    """Left join to the fixed scopes, so that an empty scope has a row."""
    wanted = df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(s) for s in scopes))).alias("scope"))
    keys = ["scope"]
    if extra:
        wanted = wanted.withColumn(extra, F.explode(F.array(*(F.lit(v) for v in values))))
        keys.append(extra)
    return wanted.join(df, keys, "left")


def review_scores(joined: DataFrame) -> DataFrame:
    """Agreement of both automated judgments with the reviewer, overall and per target."""
    fields = ("evidence_span_found", "semantic_support")
    pairs = _scoped(joined).select("scope", F.explode(F.array(*(
        F.struct(F.lit(f).alias("field"), F.col(f"automated_{f}").alias("a"), F.col(f"human_{f}").alias("h"))
        for f in fields
    ))).alias("p")).select("scope", "p.*")
    counts = pairs.groupBy("scope", "field").agg(
        F.count_if(F.col("a") & F.col("h")).alias("tp"), F.count_if(F.col("a") & ~F.col("h")).alias("fp"),
        F.count_if(~F.col("a") & ~F.col("h")).alias("tn"), F.count_if(~F.col("a") & F.col("h")).alias("fn"),
    )
    filled = _all_scopes(counts, list(SCOPES), "field", fields).fillna(0, ["tp", "fp", "tn", "fn"])
    return _with_rates(filled, ["scope", "field"])


def sheet_scores(sheet: DataFrame) -> DataFrame:
    """Agreement for the first audit format: human_supported, human_prediction_correct."""
    correct = F.col("prediction") == F.col("ground_truth")
    pairs = sheet.select(F.explode(F.array(
        F.struct(F.lit("supported").alias("judgment"), F.col("automated_evidence_span_found").alias("a"),
                 F.col("human_supported").alias("h")),
        F.struct(F.lit("prediction_correct").alias("judgment"), correct.alias("a"),
                 F.col("human_prediction_correct").alias("h")),
    )).alias("p")).select("p.*")
    return agreement(pairs, ["judgment"], "a", "h").select(
        "judgment", F.col("n").alias("n_scored"), "percent_agreement", "cohens_kappa"
    )


def _share(flag: str, name: str) -> list[Column]:
    return [F.avg(F.col(flag).cast("double")).alias(f"pct_{name}"), F.count(flag).alias(f"n_{name}_scored")]


def source_sufficiency(joined: DataFrame) -> DataFrame:
    """Share of true human source judgments over those filled in: overall, per target, M by pattern."""
    pattern = F.when((F.col("target") == "M") & F.col("arm_pattern").isNotNull(),
                     F.concat(F.lit("M:"), F.col("arm_pattern")))
    scoped = joined.withColumn("scope", F.explode(F.array_compact(F.array(F.lit("overall"), F.col("target"), pattern))))
    stats = scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_reviewed"),
        *_share("human_source_sufficient_for_stage", "source_sufficient"),
        *_share("human_source_has_explicit_stage", "explicit_stage"),
        *_share("human_source_has_inferential_evidence", "inferential_evidence"),
    )
    counts = [c for c in stats.columns if c.startswith("n_")]
    fixed = _all_scopes(stats.filter(F.col("scope").isin(*SCOPES)), list(SCOPES)).fillna(0, counts)
    return fixed.unionByName(stats.filter(~F.col("scope").isin(*SCOPES)))


def prior_predictions(joined: DataFrame, priority: str = K.ARM_CONSTRAINED, value: str = "M0") -> DataFrame:
    """Accuracy and source support among one arm's predictions of one value."""
    rows = joined.filter(
        (F.col("arm") == priority) & (F.col("target") == value[0]) & (F.col("prediction") == value)
    )
    hits = F.count_if(F.coalesce(F.col("ground_truth") == value, F.lit(False)))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), ratio(hits, F.count(F.lit(1))).alias("accuracy"),
        *_share("human_source_sufficient_for_stage", "source_sufficient"),
        *_share("human_semantic_support", "semantic_support"),
        *_share("human_source_has_explicit_stage", "explicit_m_token"),
    ).withColumnRenamed("pct_explicit_m_token", "pct_explicit_m_token_present")


def rescore_key(key: DataFrame, reviewer: DataFrame) -> DataFrame:
    """Key rows with semantic support recomputed from the reviewer's copy of the evidence."""
    span = F.col("automated_evidence_span_found")
    fresh = semantic_support(F.col("prediction"), F.col("evidence"), F.col("target"))
    rows = key.join(reviewer.select("audit_id", "evidence"), "audit_id", "left")
    return rows.withColumn(
        "automated_semantic_support",
        F.when(span.isNull(), F.col("automated_semantic_support")).when(span, fresh).otherwise(False),
    ).drop("evidence")


def judge_rows(judgments: DataFrame, answers: DataFrame) -> DataFrame:
    """Judge tags beside the tags they were given; a judgment without an answer fails the job."""
    return lookup_join(judgments, answers, ["case_id"], "answer").select(
        "case_id", "arm", "pipeline_tag", F.col("reconstructed_tag").alias("judge_tag"),
        (F.col("reconstructed_tag") == F.col("pipeline_tag")).alias("agree"), "caveat",
    )


def tag_agreement(judged: DataFrame) -> DataFrame:
    """Agreement overall and per pipeline tag, with the number of rows that carry a caveat."""
    return judged.withColumn("tag", F.explode(F.array(F.lit("overall"), F.col("pipeline_tag")))).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("agree").alias("n_agree"),
        ratio(F.count_if("agree"), F.count(F.lit(1))).alias("agreement"),
        F.count_if(F.coalesce(F.col("caveat"), F.lit("")) != "").alias("n_caveats"),
    )


def disagreements(judged: DataFrame) -> DataFrame:
    """The rows whose tags differ, for reading."""
    return judged.filter(~F.col("agree")).select("case_id", "arm", "pipeline_tag", "judge_tag", "caveat")

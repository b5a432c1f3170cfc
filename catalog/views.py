"""Views that the queries derive from the given tables: reports, responses, registries, judgments.

The documents are invented prose without stage tokens, so a phrase chosen by the document number is
appended to every whole text, and answers of four arms are derived from report and gold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.operators import records as R
from spanledger.session import apply_recommended, spread

PHRASES = (
    "pT2N0M0 glued.",
    "Stage pT3a, pN1 and M0.",
    "0/14 lymph nodes involved.",
    "Tumor invades muscularis. propria.",
    "No distant metastasis identified.",
    "Metastatic carcinoma in one of three sentinel lymph nodes.",
    "TX NX MX, tumor size 3.1 cm.",
    "",
)
TOKENS_PER_INPUT = 512
BASELINE = "baseline"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_recommended(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


CASE_ID = "concat('D', lpad(cast(doc_id as string), 12, '0'))"
_PHRASE = "element_at(array(" + ", ".join(f"'{p}'" for p in PHRASES) + "), cast(doc_id % 8 + 1 as int))"


def _case_id() -> Column:
    return F.expr(CASE_ID)


def reports_with_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{CASE_ID} as case_id", "source", "n_chars",
        f"concat({CASE_ID}, '.', source) as patient_filename",
        f"{_PHRASE} as phrase", f"concat(text, ' ', {_PHRASE}) as text",
        "case when doc_id % 5 <> 0 then concat('T', cast(doc_id % 4 + 1 as string)) end as gold_T",
        "case when doc_id % 3 <> 0 then concat('N', cast(doc_id % 4 as string)) end as gold_N",
        "case when doc_id % 20 = 0 then 'M1' when doc_id % 4 = 0 then 'M0' end as gold_M",
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports_with_number(spark, sf_dir).select(
        "case_id", "patient_filename", "source", "n_chars", "text", *(f"gold_{t}" for t in K.TARGETS)
    )


# one answer, in terms of sel, target, gold, phrase and text
ANSWER = {
    "raw_value": """case when sel <= 3 then coalesce(gold, concat(target, '0'))
        when sel = 4 then concat('p', target, '2b') when sel = 5 then concat(target, '1')
        when sel = 6 then concat(target, '3') when sel = 8 then 'Unknown ' when sel = 9 then 'junk'
        when sel = 10 then concat('yp', target, '2') end""",
    "evidence": """case when sel <= 3 or sel = 9 then phrase when sel = 4 then upper(phrase)
        when sel = 5 then substring(text, greatest(1, cast(length(text) div 2 as int)), 40)
        when sel = 6 then 'fabricated quote' end""",
    "confidence": "case when sel <= 3 then 'high' when sel <= 6 then 'medium' else 'low' end",
    "reason": "case when sel = 8 then 'not stated' end",
}


def _arms() -> Column:
    return F.expr("explode(array(" + ", ".join(
        f"named_struct('arm_no', {i}, 'arm', '{a}')" for i, a in enumerate(K.STUDY_ARMS)) + ")) as a")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of four arms to every report, one row per (case, arm, target)."""
    targets = F.expr("explode(array(" + ", ".join(
        f"named_struct('target_no', {i}, 'target', '{t}', 'gold', gold_{t})" for i, t in enumerate(K.TARGETS)
    ) + ")) as t")
    rows = reports_with_number(spark, sf_dir).select("doc_id", "case_id", "phrase", "text",
                                                     *(f"gold_{t}" for t in K.TARGETS), _arms())
    numbered = rows.select("doc_id", "case_id", "phrase", "text", "a.*", targets).selectExpr(
        "*", "t.target", "t.target_no", "t.gold", "(doc_id * 7 + arm_no * 3 + t.target_no * 5) % 11 as sel"
    )
    return numbered.selectExpr(
        "doc_id", "case_id", "arm_no", "arm", "target_no", "target", *(f"{e} as {k}" for k, e in ANSWER.items()),
        "(doc_id * 7 + arm_no * 3) % 13 <> 10 as shape_valid",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long answers of four arms."""
    return _answers(spark, sf_dir).drop("doc_id", "arm_no", "target_no")


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON answers (case_id, arm, raw), some damaged in one of several ways."""
    fields = _answers(spark, sf_dir).groupBy("doc_id", "case_id", "arm_no", "arm").agg(*(
        F.expr(f"max(case when target = '{t}' then struct(raw_value as value, evidence, confidence, reason) end)")
        .alias(f"{t}_stage") for t in K.TARGETS
    ))
    options = "map('ignoreNullFields', 'false')"
    whole = fields.selectExpr(
        "case_id", "arm", "(doc_id * 5 + arm_no) % 17 as damage",
        f"to_json(struct(T_stage, N_stage, M_stage), {options}) as whole",
        f"to_json(struct(T_stage, N_stage), {options}) as partial",
    )
    return whole.selectExpr("case_id", "arm", """case damage
        when 0 then concat('sorry: ', whole)
        when 1 then partial
        when 2 then replace(whole, '"confidence":"low"', '"confidence":"maybe"')
        when 3 then replace(whole, '"reason":null', '"reason":7')
        when 4 then replace(whole, '"evidence":null', '"other":null')
        when 5 then concat(substring(whole, 1, length(whole) - 1), ',"pathologic_stage":null}')
        when 6 then concat(substring(whole, 1, length(whole) - 1), ',"pathologic_stage":{"value":"II"}}')
        else whole end as raw""")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.build_records(reports(spark, sf_dir), responses(spark, sf_dir))


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.boundary_rows(reports(spark, sf_dir), responses(spark, sf_dir))


def registry(spark: SparkSession, sf_dir: str, target: str) -> DataFrame:
    """Registry rows with raw sub-types; every submitter appears twice, the first row is the right one."""
    gold = F.col(f"gold_{target}")
    rows = reports_with_number(spark, sf_dir).filter(gold.isNotNull()).select(
        "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    )
    first = F.when(F.col("doc_id") % 2 == 0, gold).otherwise(F.concat(gold, F.lit("a")))
    return rows.select(
        F.col("case_id").alias("case_submitter_id"),
        F.when(F.col("copy") == 0, first).otherwise(F.lit(f"{target}0")).alias(f"ajcc_pathologic_{target.lower()}"),
        F.concat(F.lit("P-"), F.col("source")).alias("project_id"),
        (F.col("doc_id") * 2 + F.col("copy")).alias("row_no"),
    )


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("patient_filename", "text")


def baseline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier's answers for every (case, target) with gold, in its file form."""
    r = reports_with_number(spark, sf_dir)
    targets = F.explode(F.array(*(
        F.struct(
            F.lit(t).alias("target"), F.col(f"gold_{t}").alias("gold"),
            F.element_at(F.array(*(F.lit(c) for c in K.CLASS_SPACE[t])),
                         ((F.col("doc_id") * (3 + i)) % len(K.CLASS_SPACE[t]) + 1).cast("int")).alias("guess"),
        ) for i, t in enumerate(K.TARGETS)
    ))).alias("t")
    prediction = F.when(F.col("doc_id") % 3 == 0, F.col("t.guess")).otherwise(F.col("t.gold"))
    return r.select("*", targets).filter("t.gold is not null").select(
        "case_id", "t.target", "t.gold", prediction.alias("baseline_prediction"),
        ((F.col("doc_id") % 10) / 10.0).alias("baseline_confidence"),
        (prediction == F.col("t.gold")).alias("baseline_correct"),
        F.least(F.floor(F.col("n_chars") / 4), F.lit(TOKENS_PER_INPUT)).cast("int").alias("input_token_count"),
        (F.floor(F.col("n_chars") / 4) > TOKENS_PER_INPUT).alias("was_truncated"),
    )


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_rows(spark, sf_dir).select("case_id", "target", "gold")


def system_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms and baseline in the common long form."""
    from spanledger.operators.classify import arm_rows_for_baseline
    from spanledger.sources.tables import baseline_long

    arms = arm_rows_for_baseline(records(spark, sf_dir), overlap(spark, sf_dir))
    other = baseline_long(baseline_rows(spark, sf_dir), BASELINE).select(*arms.columns)
    return arms.unionByName(other)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unblinded audit of every record; the human judgments come from the label table."""
    from spanledger.operators.audit import arm_patterns

    recs = records(spark, sf_dir)
    human = table(spark, sf_dir, "labels").select(
        _case_id().alias("case_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 0).alias("clean"),
        (F.col("doc_id") % 2 == 0).alias("even"),
    )
    patterns = arm_patterns(recs.filter(F.col("target") == "M"))
    joined = recs.join(human, "case_id", "left").join(patterns, ["case_id", "target"], "left")
    return joined.select(
        F.concat_ws("|", "case_id", "arm", "target").alias("audit_id"), "case_id", "arm", "target",
        "ground_truth", "prediction", "evidence", "arm_pattern",
        F.col("evidence_span_found").alias("automated_evidence_span_found"),
        F.col("evidence_semantically_supports_prediction").alias("automated_semantic_support"),
        F.col("q").alias("human_evidence_span_found"), (F.col("q") & F.col("clean")).alias("human_semantic_support"),
        F.col("clean").alias("human_prediction_correct"), F.col("q").alias("human_source_has_explicit_stage"),
        F.when(F.col("even"), F.col("clean")).alias("human_source_has_inferential_evidence"),
        F.col("clean").alias("human_source_sufficient_for_stage"),
    )


def judgments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(judgments, answers) for every tagged M row of the boundary table."""
    rows = boundary(spark, sf_dir).filter("target = 'M' and gold is not null").withColumn(
        "number", F.substring("case_id", 2, 12).cast("long")
    )
    key = F.concat_ws("|", "case_id", "arm").alias("case_id")
    other = F.when(F.col("boundary_tag") == "correct", "unsupported_error").otherwise("correct")
    judged = rows.select(
        key, F.when(F.col("number") % 7 == 0, other).otherwise(F.col("boundary_tag")).alias("reconstructed_tag"),
        F.when(F.col("number") % 5 == 0, "scan is hard to read").alias("caveat"),
    )
    answers = rows.select(key, "arm", F.col("case_id").alias("patient_id"), F.col("boundary_tag").alias("pipeline_tag"))
    return judged, answers

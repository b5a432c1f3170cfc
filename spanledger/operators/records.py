"""The record table: one scored row per (case, arm, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions import labels as L
from spanledger.functions import taxonomy
from spanledger.functions.shape import parse_document, shape_valid, stage_field
from spanledger.functions.support import semantic_support
from spanledger.functions.text import around_span, grounded_in, least_start, matching_form, span_between, span_sides
from spanledger.operators.resample import indicator

RECORD_COLUMNS = (
    "case_id", "arm", "target", "ground_truth", "prediction", "evidence", "correct", "abstained",
    "evidence_span_found", "evidence_semantically_supports_prediction", "errors",
    "raw_model_output",
)


def by_target(columns: dict[str, Column], target: Column) -> Column:
    """The column that belongs to the row's target."""
    return F.coalesce(*(F.when(target == t, c) for t, c in columns.items()))


def report_features(reports: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """What depends on the report alone, computed once per report: matching form, gold, ``flags``.

    The text is normalised and searched here, before any arm or target multiplies the rows; the
    raw text itself does not travel further.
    """
    text = F.col("text")
    per_target = {
        "gold_in_text": lambda t: L.value_supported_by_text(F.col(f"gold_{t}"), text),
        "gold_in_report": lambda t: L.text_supports_gold(F.col(f"gold_{t}"), text),
        "easy": lambda t: L.has_explicit_token(text, t),
    }
    return reports.select(
        "case_id", matching_form(text).alias("text_form"), *(f"gold_{t}" for t in K.TARGETS),
        *(per_target[f](t).alias(f"{f}_{t}") for f in flags for t in K.TARGETS),
    )


def _target_column(name: str) -> Column:
    return by_target({t: F.col(f"{name}_{t}") for t in K.TARGETS}, F.col("target"))


def build_records(reports: DataFrame, responses: DataFrame) -> DataFrame:
    """Score long responses against their reports.

    ``responses``: case_id, arm, target, raw_value, evidence, confidence, reason, shape_valid.
    One join on case_id brings the normalised text to the quotes; it is dropped right after the
    grounding test, so every later operator runs on narrow rows.
    """
    valid = F.col("shape_valid")
    quoted = responses.withColumn("evidence_form", F.when(valid, matching_form(F.col("evidence"))))
    joined = quoted.join(report_features(reports, ("gold_in_text",)), "case_id", "left").select(
        "case_id", "arm", "target", "raw_value", "confidence", "reason", "shape_valid",
        F.when(valid, F.col("evidence")).alias("evidence"),
        F.when(valid, L.norm_pred(F.col("raw_value"))).otherwise(K.INVALID).alias("prediction"),
        _target_column("gold").alias("ground_truth"),
        F.coalesce(_target_column("gold_in_text"), F.lit(False)).alias("gold_in_text"),
        grounded_in(F.col("evidence_form"), F.col("text_form")).alias("quote_in_text"),
    )
    spans = joined.withColumn("abstained", L.is_abstention(F.col("prediction"))).withColumn(
        "evidence_span_found", F.when(~F.col("abstained"), F.col("quote_in_text"))
    )
    scored = spans.withColumn(
        "evidence_semantically_supports_prediction", _support_given_span()
    )
    raw = F.when(F.col("shape_valid"), F.create_map(
        F.lit("value"), F.col("raw_value"), F.lit("evidence"), F.col("evidence"),
        F.lit("confidence"), F.col("confidence"), F.lit("reason"), F.col("reason"),
    )).otherwise(F.create_map().cast("map<string,string>"))
    return scored.select(
        "case_id", "arm", "target", "ground_truth", "prediction", "evidence",
        (F.col("prediction") == F.col("ground_truth")).alias("correct"),
        "abstained", "evidence_span_found", "evidence_semantically_supports_prediction",
        taxonomy.error_flags(
            shape_valid=F.col("shape_valid"), prediction=F.col("prediction"),
            ground_truth=F.col("ground_truth"), span_found=F.col("evidence_span_found"),
            supported=F.col("evidence_semantically_supports_prediction"),
            gold_in_text=F.col("gold_in_text"),
        ).alias("errors"),
        raw.alias("raw_model_output"),
    )


def _support_given_span() -> Column:
    support = semantic_support(F.col("prediction"), F.col("evidence"), F.col("target"))
    return F.when(~F.col("abstained"), F.when(F.col("evidence_span_found"), support).otherwise(False))


def rescore(records: DataFrame) -> DataFrame:
    """Recompute semantic support on stored records; nothing else changes."""
    name = "evidence_semantically_supports_prediction"
    return records.withColumn(name, F.when(F.col("abstained"), F.col(name)).otherwise(_support_given_span()))


def parse_raw(raw: DataFrame) -> DataFrame:
    """Raw JSON answers (case_id, arm, raw) to case_id, arm, raw, invalid and one struct per target."""
    parsed = raw.withColumn("doc", parse_document(F.col("raw")))
    return parsed.select(
        "case_id", "arm", "raw",
        (~shape_valid(F.col("doc"))).alias("invalid"),
        *(stage_field(F.col("doc"), t).alias(f"field_{t}") for t in K.TARGETS),
    ).select(
        "case_id", "arm", "raw", "invalid",
        *(F.when(~F.col("invalid"), F.col(f"field_{t}")).alias(f"{t}_stage") for t in K.TARGETS),
    )


def long_responses(parsed: DataFrame) -> DataFrame:
    """One row per target from answers with one struct per target."""
    field = F.explode(F.array(*(
        F.struct(
            F.lit(t).alias("target"),
            *(F.col(f"{t}_stage")[k].alias("raw_value" if k == "value" else k)
              for k in ("value", "evidence", "confidence", "reason")),
        ) for t in K.TARGETS
    ))).alias("f")
    return parsed.select("case_id", "arm", (~F.col("invalid")).alias("shape_valid"), field).select(
        "case_id", "arm", "f.*", "shape_valid"
    )


def wide_predictions(responses: DataFrame) -> DataFrame:
    """Long responses to one row per (case, arm) with pred_{T,N,M}_{value,evidence,...}.

    Invalid answers carry NULL fields, so downstream they read as abstentions.
    """
    kept = {"value": "raw_value", "evidence": "evidence", "confidence": "confidence", "reason": "reason"}
    return responses.groupBy("case_id", "arm").agg(
        F.bool_or(~F.col("shape_valid")).alias("invalid"),
        *(
            F.max(F.when((F.col("target") == t) & F.col("shape_valid"), F.col(c))).alias(f"pred_{t}_{k}")
            for t in K.TARGETS for k, c in kept.items()
        ),
    )


def boundary_rows(reports: DataFrame, responses: DataFrame) -> DataFrame:
    """First-generation scoring: normalised value, grounding of the quote and boundary tag.

    Here an invalid answer has no value and counts as an abstention, and grounding is judged for
    every row, whatever was predicted.
    """
    valid = F.col("shape_valid")
    features = report_features(reports, ("gold_in_report", "easy"))
    quoted = responses.withColumn("evidence_form", F.when(valid, matching_form(F.col("evidence"))))
    rows = quoted.join(features, "case_id", "left").select(
        "case_id", "arm", "target", "confidence", "reason",
        F.when(valid, F.col("raw_value")).alias("value"),
        F.when(valid, F.col("evidence")).alias("evidence"),
        (~valid).alias("invalid"),
        _target_column("gold").alias("gold"),
        F.coalesce(_target_column("gold_in_report"), F.lit(False)).alias("gold_in_report"),
        F.coalesce(_target_column("easy"), F.lit(False)).alias("easy"),
        grounded_in(F.col("evidence_form"), F.col("text_form")).alias("grounded"),
    ).withColumn("value_norm", L.norm_pred(F.col("value")))
    return rows.withColumn(
        "boundary_tag",
        taxonomy.boundary_tag(F.col("gold"), F.col("value_norm"), F.col("grounded"), F.col("gold_in_report")),
    ).drop("gold_in_report")


def locate_spans(reports: DataFrame, responses: DataFrame) -> DataFrame:
    """Grounded quotes with the struct(before, match, after) of their place in the report.

    A plain substring test over forms made once per report decides which rows need the position, and its place in the
    form where the pattern begins to look in the text.  Answers with the same quote from a report, at most one for each
    arm and target, are looked up together.
    """
    growth = F.length(F.lower("text")) - F.length("text")
    texts = reports.select("case_id", "text", matching_form(F.col("text")).alias("text_form"), growth.alias("growth"))
    words = responses.select("case_id", "arm", "target", matching_form(F.col("evidence")).alias("words"))
    quotes = words.filter(F.col("words") != "").groupBy("case_id", "words").agg(F.collect_list(F.struct("arm", "target")).alias("answers"))
    # grounded_in is never NULL, so that no test for NULL makes the form of every text a second time
    grounded = quotes.join(texts, "case_id").filter(grounded_in(F.col("words"), F.col("text_form")))
    # each step is a projection of its own, as what several expressions use is else computed in each of them
    placed = grounded.select("case_id", "answers", "text", "words",
                             least_start(F.col("text_form"), F.col("words"), F.col("growth")).alias("skip"))
    parted = placed.select("case_id", "answers", "text", "skip", span_sides(F.col("text"), F.col("words"), F.col("skip")).alias("sides"))
    spans = parted.select("case_id", "answers", "text", span_between(F.col("text"), F.col("sides"), F.col("skip")).alias("span"))
    found = spans.select("case_id", "answers", around_span(F.col("text"), F.col("span")).alias("s"))
    return found.select("case_id", F.explode("answers").alias("a"), "s").select("case_id", "a.arm", "a.target", "s")


def case_indicators(records: DataFrame) -> DataFrame:
    """Per-record 0/1 indicators of the six compared metrics; NULL where there is no gold."""
    return records.select(
        "case_id", "arm", "target",
        *(F.when(F.col("ground_truth").isNotNull(), indicator(m).cast("double")).alias(m)
          for m in K.COMPARISON_METRICS),
    )


def requests(reports: DataFrame, arms: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """Request table: one (system, user) text pair per report and arm.

    The arms are a literal list, so the multiplication is an explode without any shuffle.
    """
    arms = tuple(arms) if arms is not None else tuple(K.SYSTEM_TEXT)
    options = F.explode(F.array(*(
        F.struct(F.lit(a).alias("arm"), F.lit(K.SYSTEM_TEXT[a]).alias("system")) for a in arms
    ))).alias("a")
    user = F.concat(F.lit(K.USER_TEXT_PREFIX), F.col("text"))
    return reports.select("case_id", user.alias("user"), options).select(
        "case_id", "a.arm", "a.system", "user"
    )

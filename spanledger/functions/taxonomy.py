"""Error flags, source-boundary tags, arm patterns and example tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanledger import constants as K


def error_flags(
    *, shape_valid: Column, prediction: Column, ground_truth: Column,
    span_found: Column, supported: Column, gold_in_text: Column,
) -> Column:
    """Array of error flags in a fixed order.

    A shape error or an unreadable value stands alone.  An abstention is an error only when the
    report names the gold value.  An asserted value can have a grounding flag and a wrongness flag.
    """
    wrong = ground_truth.isNotNull() & (prediction != ground_truth)
    asserted = F.array_compact(F.array(
        F.when(~span_found, "evidence_span_not_found")
        .when(~supported, "evidence_does_not_support_prediction"),
        F.when(wrong & ~span_found, "hallucinated_stage")
        .when(wrong, "wrong_stage_with_supporting_evidence"),
    ))
    missed = F.coalesce(ground_truth.isNotNull() & gold_in_text, F.lit(False))
    return (
        F.when(~shape_valid, F.array(F.lit("invalid_schema_output")))
        .when(prediction == K.INVALID, F.array(F.lit("invalid_normalization")))
        .when((prediction == K.UNKNOWN) & missed,
              F.array(F.lit("over_abstention"), F.lit("missed_explicit_stage")))
        .when(prediction == K.UNKNOWN, F.array().cast("array<string>"))
        .otherwise(asserted)
    )


def boundary_tag(gold: Column, prediction: Column, is_grounded: Column, text_has_gold: Column) -> Column:
    """Why a prediction agrees or disagrees with gold; NULL where there is no gold."""
    return F.when(
        gold.isNotNull(),
        F.when(prediction == gold, "correct")
        .when((prediction == K.UNKNOWN) & text_has_gold, "over_abstention")
        .when(prediction == K.UNKNOWN, "source_boundary_abstention")
        .when(is_grounded, "report_gold_discordance")
        .otherwise("unsupported_error"),
    )


def arm_pattern(priority_abstained: Column, comparison_abstained: Column) -> Column:
    """Abstention pattern of two arms on one case; a missing arm (NULL) gives pattern_unknown."""
    both, only_priority, only_comparison, neither, missing = K.ARM_PATTERNS
    return (
        F.when(priority_abstained.isNull() | comparison_abstained.isNull(), missing)
        .when(~priority_abstained & ~comparison_abstained, both)
        .when(~priority_abstained, only_priority)
        .when(~comparison_abstained, only_comparison)
        .otherwise(neither)
    )


def example_tags(target: Column, gold: Column, arms: dict[str, Column]) -> Column:
    """Sorted array of example tags for one (case, target).

    ``arms`` gives for every study arm a struct with prediction, correct, abstained, span, support.
    """
    def arm_tags(r: Column) -> Column:
        correct = F.coalesce(r["correct"], F.lit(False))
        support = F.coalesce(r["support"], F.lit(False))
        span = F.coalesce(r["span"], F.lit(False))
        m0 = (target == "M") & (gold == "M0") & (r["prediction"] == "M0")
        said = ~r["abstained"]
        return F.array(
            F.when(r["abstained"], "abstained"),
            F.when(said & correct & span & support, "correct_grounded"),
            F.when(said & correct & span & ~support, "correct_unsupported"),
            F.when(said & ~correct & support, "wrong_grounded"),
            F.when(said & span & ~support, "span_not_supporting"),
            F.when(said & m0 & correct & ~support, "m0_unsupported"),
        )

    c, plus, d = (arms[a] for a in (K.ARM_CONSTRAINED, K.ARM_CONSTRAINED_UNKNOWN, K.ARM_GROUNDED))
    differs = ~d["support"].eqNullSafe(plus["support"]) | (d["prediction"] != plus["prediction"])
    binding = (d["abstained"] != plus["abstained"]) | (~d["abstained"] & ~plus["abstained"] & differs)
    pair_tags = F.array(
        F.when(binding, "evidence_binding_change"),
        F.when(~c["abstained"] & d["abstained"], "c_asserts_d_abstains"),
    )
    every = F.concat(*(arm_tags(r) for r in arms.values()), pair_tags)
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def example_title(tags: Column) -> Column:
    """Title of the first tag in priority order."""
    options = [F.when(F.array_contains(tags, tag), title) for tag, title in K.EXAMPLE_TITLES]
    return F.coalesce(*options, F.lit(K.EXAMPLE_FALLBACK_TITLE))

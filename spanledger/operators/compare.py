"""Comparing two scorings: pilot against main run, before against after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger import constants as K


def _long(bundle: DataFrame, metrics, value: str) -> DataFrame:
    keys = [c for c in ("arm", "target") if c in bundle.columns]
    return bundle.unpivot(keys, list(metrics), "metric", value)


def metric_differences(left: DataFrame, right: DataFrame, *, names=("pilot", "main"), metrics=K.REPLICATION_METRICS) -> DataFrame:
    """One row per arm, scope and metric that both bundles have, with right minus left."""
    a, b = _long(left, metrics, names[0]), _long(right, metrics, names[1])
    return a.join(b, ["arm", "target", "metric"]).withColumn("diff", F.col(names[1]) - F.col(names[0]))


def best_arm(bundle: DataFrame, metric: str, *, highest: bool = True, by: list[str] | None = None) -> DataFrame:
    """Arm with the best value of a metric; equal values go to the first arm name."""
    value = F.col(metric)
    order = F.struct((-value if highest else value).alias("v"), F.col("arm"))
    return bundle.filter(value.isNotNull()).groupBy(*(by or [])).agg(
        F.min_by("arm", order).alias("best_arm"), F.min_by(metric, order).alias("best_value")
    )


def replication_claims(bundles: DataFrame) -> DataFrame:
    """Whether each of five qualitative claims holds in each experiment.

    ``bundles``: metric bundles with columns experiment, arm, target.  A claim without the arms it
    needs gives no row, except that a missing value makes it fail.
    """
    overall, m = F.col("target") == "overall", F.col("target") == "M"

    def at(arm: str, metric: str) -> Column:
        return F.max(F.when(overall & (F.col("arm") == arm), F.col(metric)))

    def present(arm: str) -> Column:
        return F.bool_or(overall & (F.col("arm") == arm))

    def top(metric: str) -> Column:
        order = F.when(overall & F.col(metric).isNotNull(), F.struct((-F.col(metric)).alias("v"), F.col("arm")))
        return F.min(order)["arm"]

    unsupported, supported = (
        "semantic_unsupported_rate_over_evaluable", "semantic_supported_accuracy_over_evaluable")
    gap = F.when(m, F.col("accuracy") - F.col(supported))
    facts = bundles.groupBy("experiment").agg(
        present(K.ARM_CONSTRAINED).alias("has_c"), present(K.ARM_CONSTRAINED_UNKNOWN).alias("has_plus"),
        present(K.ARM_GROUNDED).alias("has_d"), F.bool_or(m).alias("has_m"),
        at(K.ARM_CONSTRAINED, "accuracy").alias("c_accuracy"),
        F.max(F.when(overall, F.col("accuracy"))).alias("top_accuracy"),
        top("accuracy").alias("top_arm"), top(supported).alias("most_supported_arm"),
        at(K.ARM_CONSTRAINED, unsupported).alias("c_rate"),
        at(K.ARM_CONSTRAINED_UNKNOWN, unsupported).alias("plus_rate"),
        at(K.ARM_GROUNDED, unsupported).alias("d_rate"),
        F.min(gap).alias("smallest_gap"),
    )
    c_rate, plus_rate, d_rate = F.col("c_rate"), F.col("plus_rate"), F.col("d_rate")
    rivals = F.greatest(plus_rate, d_rate)  # greatest skips NULL: compare with the rivals that exist
    claims = [
        ("C_highest_or_near_highest_accuracy", F.col("has_c"),
         (F.col("top_arm") == K.ARM_CONSTRAINED)
         | (F.col("top_accuracy") - F.col("c_accuracy") <= K.NEAR_HIGHEST_MARGIN),
         F.col("top_arm"), F.col("c_accuracy"), F.col("top_accuracy")),
        ("C_relatively_poor_grounding", F.col("has_c"), c_rate > rivals,
         F.lit(None).cast("string"), c_rate, rivals),
        ("C_plus_lower_unsupported_than_C", F.col("has_c") & F.col("has_plus"), plus_rate < c_rate,
         F.lit(None).cast("string"), plus_rate, c_rate),
        ("D_strongest_grounded_reliability", F.col("has_c") & F.col("has_d"),
         F.col("most_supported_arm") == K.ARM_GROUNDED, F.col("most_supported_arm"),
         F.lit(None).cast("double"), F.lit(None).cast("double")),
        ("M_accuracy_much_higher_than_semantic_supported_accuracy", F.col("has_m"),
         F.col("smallest_gap") > K.LARGE_GAP, F.lit(None).cast("string"), F.col("smallest_gap"),
         F.lit(K.LARGE_GAP)),
    ]
    rows = F.explode(F.array_compact(F.array(*(
        F.when(known, F.struct(
            F.lit(name).alias("claim"), F.coalesce(holds, F.lit(False)).alias("holds"),
            arm.alias("arm"), value.alias("value"), against.alias("against"),
        )) for name, known, holds, arm, value, against in claims
    )))).alias("c")
    return facts.select("experiment", rows).select("experiment", "c.*")

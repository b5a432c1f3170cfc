"""Classifier metrics from small confusion counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions.formats import four_decimals, ratio
from spanledger.functions.labels import prediction_bucket

GROUP = ["target", "system"]


def confusion_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts per (group, gold, prediction): the only pass over the rows."""
    return rows.filter(F.col("gold").isNotNull()).groupBy(*by, "gold", "prediction").agg(
        F.count(F.lit(1)).alias("n")
    )


def class_counts(confusion: DataFrame, by: list[str]) -> DataFrame:
    """Per class label seen in gold or prediction: true positives, support, predicted count."""
    sides = F.explode(F.array(
        F.struct(F.col("gold").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("gold") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )).alias("s")
    return confusion.select(*by, sides).groupBy(*by, "s.class").agg(
        *(F.sum(f"s.{c}").alias(c) for c in ("tp", "support", "predicted"))
    )


def _class_scaffold(per_class: DataFrame) -> DataFrame:
    """Every class of the target's space for every group that occurs; other labels drop out."""
    spaces = F.create_map(*[
        x for t, cs in K.CLASS_SPACE.items() for x in (F.lit(t), F.array(*(F.lit(c) for c in cs)))
    ])
    wanted = per_class.select(*GROUP).distinct().select(
        *GROUP, F.explode(spaces[F.col("target")]).alias("class")
    )
    return wanted.join(per_class, [*GROUP, "class"], "left").fillna(0, ["tp", "support", "predicted"])


def f1_column():
    """F1 of a class from its counts; zero where it is undefined."""
    return F.coalesce(ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))


def macro_f1_open(confusion: DataFrame, by: list[str]) -> DataFrame:
    """Macro F1 over the labels seen in gold or prediction."""
    return class_counts(confusion, by).groupBy(*by).agg(F.avg(f1_column()).alias("macro_f1"))


def macro_f1_fixed(confusion: DataFrame) -> DataFrame:
    """Macro F1 over the fixed classes of each target; an absent class counts as zero."""
    scaffold = _class_scaffold(class_counts(confusion, GROUP))
    return scaffold.groupBy(*GROUP).agg(F.avg(f1_column()).alias("macro_f1"))


def balanced_accuracy(confusion: DataFrame) -> DataFrame:
    """Mean recall over the classes that occur in gold."""
    seen = class_counts(confusion, GROUP).filter("support > 0")
    return seen.groupBy(*GROUP).agg(F.avg(ratio(F.col("tp"), F.col("support"))).alias("balanced_accuracy"))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """Recall, precision and support per fixed class, zeros kept, four decimals."""
    def rate(a: str, b: str):
        return four_decimals(F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0)))

    return _class_scaffold(class_counts(confusion, GROUP)).select(
        *GROUP, "class", rate("tp", "support").alias("recall"), rate("tp", "predicted").alias("precision"),
        "support",
    )


def _count_where(cells: Column, condition: Callable[[Column], Column]) -> Column:
    """Sum of n over the cells (struct of gold, prediction, n) that meet a condition."""
    return F.aggregate(F.filter(cells, condition), F.lit(0).cast("long"), lambda a, x: a + x["n"])


def _f1(cells: Column, label: Column) -> Column:
    both = _count_where(cells, lambda x: (x["gold"] == label) & (x["prediction"] == label))
    sides = _count_where(cells, lambda x: x["gold"] == label) + _count_where(cells, lambda x: x["prediction"] == label)
    return F.coalesce(ratio(2 * both, sides), F.lit(0.0))


def _recall(cells: Column, label: Column) -> Column:
    both = _count_where(cells, lambda x: (x["gold"] == label) & (x["prediction"] == label))
    return ratio(both, _count_where(cells, lambda x: x["gold"] == label))


def _mean(values: Column) -> Column:
    return ratio(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _cells() -> Column:
    """The cells with a gold label, gathered from counts per (gold, prediction): as many as labels squared."""
    return F.collect_list(F.when(F.col("gold").isNotNull(), F.struct("gold", "prediction", "n")))


def system_metrics(rows: DataFrame) -> DataFrame:
    """n, accuracy, coverage, balanced accuracy and macro F1 per target and system, from one pass over the rows."""
    counts = rows.groupBy(*GROUP, "gold", "prediction").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("correct").alias("judged"), F.count_if("correct").alias("correct"),
        F.count("abstained").alias("answered"), F.count_if("abstained").alias("abstained"),
    )
    table = counts.groupBy(*GROUP).agg(
        F.sum("n").alias("n"), ratio(F.sum("correct"), F.sum("judged")).alias("accuracy"),
        (1 - ratio(F.sum("abstained"), F.sum("answered"))).alias("coverage"), _cells().alias("cells"),
    ).filter(F.size("cells") > 0)
    spaces = F.create_map(*[
        x for t, cs in K.CLASS_SPACE.items() for x in (F.lit(t), F.array(*(F.lit(c) for c in cs)))
    ])
    cells, golds = F.col("cells"), F.array_distinct(F.col("cells.gold"))
    return table.select(
        *GROUP, "n", four_decimals(F.col("accuracy")).alias("accuracy"), four_decimals(F.col("coverage")).alias("coverage"),
        four_decimals(_mean(F.transform(golds, lambda c: _recall(cells, c)))).alias("balanced_accuracy"),
        four_decimals(_mean(F.transform(spaces[F.col("target")], lambda c: _f1(cells, c)))).alias("macro_f1"),
    )


def confusion_matrix(confusion: DataFrame) -> DataFrame:
    """Long confusion matrix with zeros; the abstain label only where a system abstained."""
    spaces = F.create_map(*[
        x for t, cs in K.CLASS_SPACE.items() for x in (F.lit(t), F.array(*(F.lit(c) for c in cs)))
    ])
    labels = confusion.groupBy(*GROUP).agg(
        F.bool_or(F.col("prediction") == K.ABSTAIN_BUCKET).alias("abstains")
    ).withColumn("labels", F.when(
        F.col("abstains"), F.concat(spaces[F.col("target")], F.array(F.lit(K.ABSTAIN_BUCKET)))
    ).otherwise(spaces[F.col("target")]))
    cells = labels.select(*GROUP, "labels", F.explode("labels").alias("gold")).select(
        *GROUP, "gold", F.explode("labels").alias("prediction")
    )
    return cells.join(confusion, [*GROUP, "gold", "prediction"], "left").fillna(0, ["n"])


def truncation_strata(baseline: DataFrame) -> DataFrame:
    """Baseline accuracy by truncated input; M also gets M1 recall and a note for tiny groups."""
    m1 = (F.col("target") == "M") & (F.col("gold") == "M1")
    counts = baseline.groupBy("target", F.col("was_truncated").alias("truncated")).agg(
        F.count(F.lit(1)).alias("n"),
        four_decimals(F.avg(F.col("correct").cast("double"))).alias("accuracy"),
        F.count_if(m1).alias("m1"),
        F.count_if(m1 & F.col("correct")).alias("m1_correct"),
    )
    is_m = F.col("target") == "M"
    return counts.select(
        "target", "truncated", "n", "accuracy",
        F.when(is_m, F.col("m1")).alias("n_m1"),
        F.when(is_m, four_decimals(ratio(F.col("m1_correct"), F.col("m1")))).alias("m1_recall"),
        F.when(is_m & (F.col("m1") < 5), "n<5, too small to interpret").alias("m1_recall_note"),
    )


def scorecard(rows: DataFrame) -> DataFrame:
    """Wide accuracy and grounding scorecard per arm from first-generation rows, read once.

    Rows are first counted by everything that the figures ask for; all figures come from these counts.
    """
    counts = rows.withColumn("prediction", F.col("value_norm")).groupBy(
        "arm", "target", "gold", "prediction", "invalid", "grounded", "easy",
        F.coalesce(F.col("value").isin(*K.DOMAIN), F.lit(False)).alias("legal"),
    ).agg(F.count(F.lit(1)).alias("n"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    said, gold = F.col("prediction") != K.UNKNOWN, F.col("gold").isNotNull()
    grounded, easy, every = F.col("grounded"), F.col("easy"), F.lit(True)
    table = counts.groupBy("arm", "target").agg(
        F.sum("n").alias("n"),
        ratio(total(F.col("invalid")), total(every)).alias("invalid_output_rate"),
        ratio(total(gold & (F.col("prediction") == F.col("gold"))), total(gold)).alias("accuracy"),
        ratio(total(gold & F.col("legal")), total(gold)).alias("allowed_value_rate"),
        ratio(total(~said), total(every)).alias("abstention_rate"),
        ratio(total(said & grounded), total(said)).alias("evidence_grounding_rate"),
        ratio(total(said & ~grounded), total(every)).alias("unsupported_assertion_rate"),
        ratio(total(~said & ~easy), total(~easy)).alias("hard_abstention_rate"),
        _cells().alias("cells"),
    )
    labels = F.array_distinct(F.concat(F.col("cells.gold"), F.col("cells.prediction")))
    table = table.withColumn("macro_f1", _mean(F.transform(labels, lambda c: _f1(F.col("cells"), c)))).drop("cells")
    per_stage = ("accuracy", "macro_f1", "allowed_value_rate", "abstention_rate",
                 "evidence_grounding_rate", "unsupported_assertion_rate", "hard_abstention_rate")
    return table.groupBy("arm").agg(
        F.max("n").alias("n"), F.max("invalid_output_rate").alias("invalid_output_rate"),
        *(F.max(F.when(F.col("target") == t, F.col(c))).alias(f"{t}_{c}") for t in K.TARGETS for c in per_stage),
    )


def arm_rows_for_baseline(records: DataFrame, overlap: DataFrame) -> DataFrame:
    """Records of the overlap cases in the common long form; a gold mismatch fails the job."""
    checked = F.when(
        ~F.col("ground_truth").eqNullSafe(F.col("overlap_gold")),
        F.raise_error(F.concat(F.lit("gold mismatch for "), F.col("case_id"), F.lit("/"), F.col("target"))).cast("string"),
    ).otherwise(F.col("ground_truth"))
    keep = overlap.select("case_id", "target", F.col("gold").alias("overlap_gold"))
    return records.join(keep, ["case_id", "target"]).withColumn("gold", checked).select(
        "case_id", "target", F.col("arm").alias("system"), "gold",
        prediction_bucket(F.col("target"), F.col("prediction")).alias("prediction"),
        F.col("prediction").alias("prediction_raw"),
        (F.col("prediction") == F.col("gold")).alias("correct"), "abstained",
    )

"""Nested JSON documents: one per case, one per metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions.labels import legacy_from_arm

_PREDICTION = (
    "struct<value:string,value_norm:string,evidence:string,confidence:string,reason:string,"
    "grounded:boolean,boundary_tag:string>"
)
CASE = (
    "patient_id string, text string, gold map<string,string>, "
    f"predictions map<string,map<string,{_PREDICTION}>>"
)


def case_documents(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """(case_id, document): report, gold and every arm's predictions per stage as one JSON object.

    The rows of a case are bounded by arms and targets and carry no text; the report text joins
    once, after they are grouped.
    """
    prediction = F.struct("value", "value_norm", "evidence", "confidence", "reason", "grounded", "boundary_tag")
    letter = F.coalesce(legacy_from_arm(F.col("arm")), F.col("arm"))
    per_arm = rows.groupBy("case_id", letter.alias("arm")).agg(
        *(F.max(F.when(F.col("target") == t, prediction)).alias(t) for t in K.TARGETS)
    ).select("case_id", "arm", F.create_map(*[x for t in K.TARGETS for x in (F.lit(t), F.col(t))]).alias("stages"))
    per_case = per_arm.groupBy("case_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("arm", F.map_entries("stages").alias("e"))))
                           ).alias("m")
    ).select("case_id", F.transform_values("m", lambda _, e: F.map_from_entries(e)).alias("predictions"))
    gold = F.create_map(*[x for t in K.TARGETS for x in (F.lit(t), F.col(f"gold_{t}"))])
    joined = reports.join(per_case, "case_id")
    document = F.struct(F.col("case_id").alias("patient_id"), "text", gold.alias("gold"), "predictions")
    return joined.select("case_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One document per line in one dataset, not one file per case."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).json(path)


def case_ids(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("patient_id").alias("id"))


def get_case(cases: DataFrame, case_id: str) -> DataFrame:
    return cases.filter(F.col("patient_id") == case_id)


def write_case_store(cases: DataFrame, path: str, buckets: int = 256) -> None:
    """Cases laid out for lookups by id: a folder per hash bucket, parquet with Bloom filters on the id.

    The number of buckets stands in the path, so a reader needs no parameter.
    """
    bucket = F.pmod(F.xxhash64("patient_id"), F.lit(buckets)).cast("int")
    laid = cases.withColumns({"buckets": F.lit(buckets), "bucket": bucket}).repartition("bucket").sortWithinPartitions("bucket", "patient_id")
    laid.write.mode("overwrite").partitionBy("buckets", "bucket").option("parquet.bloom.filter.enabled#patient_id", "true").option(
        "parquet.bloom.filter.expected.ndv#patient_id", "100000").parquet(path)


def read_case_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def look_up_case(store: DataFrame, case_id: str) -> DataFrame:
    """One case out of a store: the condition on the bucket prunes all other folders before a file is opened."""
    at = F.pmod(F.xxhash64(F.lit(case_id)), F.col("buckets")).cast("int")
    return store.filter((F.col("bucket") == at) & (F.col("patient_id") == case_id)).drop("buckets", "bucket")


def look_up_cases(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Many cases (ids: patient_id): joined on the bucket too, so few ids prune folders while the job runs."""
    first = store.select("buckets").first()
    at = F.pmod(F.xxhash64("patient_id"), F.lit(first["buckets"] if first else 1)).cast("int")
    wanted = ids.select("patient_id", at.alias("bucket")).distinct()
    return store.join(wanted, ["bucket", "patient_id"], "left_semi").drop("buckets", "bucket")


def case_summaries(cases: DataFrame, target: str = "M") -> DataFrame:
    """Triage rows out of case documents."""
    def at(arm: str, name: str) -> Column:
        return F.col("predictions")[arm][target][name]

    return cases.select(
        F.col("patient_id").alias("id"), F.col("gold")[target].alias(f"gold_{target}"),
        *(c for a in K.LEGACY_ARMS
          for c in (at(a, "value_norm").alias(f"{a}_{target}"), at(a, "boundary_tag").alias(f"{a}_tag"))),
    )


def case_predictions(cases: DataFrame) -> DataFrame:
    """Flat rows (case, arm, target, ...) out of case documents."""
    arms = cases.select("patient_id", "gold", F.explode("predictions").alias("arm", "stages"))
    flat = arms.select("patient_id", "gold", "arm", F.explode("stages").alias("target", "p"))
    return flat.select(F.col("patient_id").alias("case_id"), "arm", "target",
                       F.col("gold")[F.col("target")].alias("gold"), "p.*")


def metrics_document(bundle: DataFrame, *, by_target: bool) -> DataFrame:
    """One JSON object: arm -> metrics, or arm -> target -> metrics; a missing metric is null."""
    names = [c for c in bundle.columns if c != "arm"]
    body = F.struct(*names)
    if not by_target:
        pooled = bundle.filter(F.col("target") == "overall").select("arm", body.alias("v"))
        return _as_document(pooled)
    nested = bundle.filter(F.col("target") != "overall").groupBy("arm").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("target", body.alias("v"))))).alias("v")
    )
    return _as_document(nested)


def _as_document(entries: DataFrame) -> DataFrame:
    entries = entries.select("arm", F.to_json("v", {"ignoreNullFields": "false"}).alias("v"))
    text = F.concat_ws(":", F.concat(F.lit('"'), F.col("arm"), F.lit('"')), F.col("v"))
    return entries.agg(
        F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(text)), ","), F.lit("}")).alias("document")
    )


def error_document(breakdown: DataFrame) -> DataFrame:
    """One JSON object: arm -> target -> flag -> count."""
    per_target = breakdown.groupBy("arm", "target").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_category", "count")))).alias("c"))
    per_arm = per_target.groupBy("arm").agg(
        F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("target", F.to_json("c").alias("c"))))).alias("m")
    )
    inner = F.array_join(F.transform(
        F.map_entries("m"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    return _as_text(per_arm.select("arm", F.concat(F.lit("{"), inner, F.lit("}")).alias("v")))


def _as_text(entries: DataFrame) -> DataFrame:
    text = F.concat(F.lit('"'), F.col("arm"), F.lit('":'), F.col("v"))
    return entries.agg(
        F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(text)), ","), F.lit("}")).alias("document")
    )


def bootstrap_document(grid: DataFrame) -> DataFrame:
    """One JSON object: scope -> metric -> list of comparisons."""
    row = F.struct(F.col("metric").alias("metric_name"), "arm_a", "arm_b", "diff", "ci_low", "ci_high",
                   "p_value", "n_boot", "seed", "n_paired_cases")
    lists = grid.groupBy("scope", "metric").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    scopes = lists.groupBy("scope").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "rows")))).alias("m"))
    return _as_text(scopes.select(F.col("scope").alias("arm"), F.to_json("m").alias("v")))

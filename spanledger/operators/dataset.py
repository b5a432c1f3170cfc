"""Building the evaluation dataset: registry joins, gold labels, pools, lookups and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions import labels as L


def first_row_per_key(df: DataFrame, key: str, order: str, keep: list[str]) -> DataFrame:
    """The earliest row of every key.  An aggregation, so a hot key is reduced inside every task."""
    return df.groupBy(key).agg(F.min_by(F.struct(*keep), order).alias("r")).select(key, "r.*")


def last_row_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of every key, as when rows are replayed into a map."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def build_dataset(reports: DataFrame, registries: dict[str, DataFrame], *, strict: bool = True) -> DataFrame:
    """Reports joined to one registry per target.

    ``reports``: patient_filename, text.  A registry: case_submitter_id, ajcc_pathologic_{t,n,m},
    project_id and an order column ``row_no``; its first row per id counts.
    """
    # the registries meet first, so the texts take part in one join
    rows = reduce(DataFrame.unionByName, (
        registry.select(F.col("case_submitter_id").alias("submitter_id"), F.lit(t).alias("target"),
                        F.col(f"ajcc_pathologic_{t.lower()}").alias("raw"), "project_id", "row_no")
        for t, registry in registries.items()))
    first = rows.groupBy("submitter_id").agg(*(
        F.min_by(F.struct("raw", "project_id"), F.when(F.col("target") == t, F.col("row_no"))).alias(t) for t in registries))
    df = reports.withColumn("submitter_id", L.submitter_id(F.col("patient_filename"))).join(
        first.select("submitter_id", *(F.col(f"{t}.raw").alias(f"raw_{t}") for t in registries),
                     *(F.col(f"{t}.project_id").alias(f"project_{t}") for t in registries)), "submitter_id", "left")
    targets = list(registries)
    return df.select(
        "patient_filename", "submitter_id", "text",
        *(L.canonical_gold(F.col(f"raw_{t}"), strict=strict).alias(f"gold_{t}") for t in targets),
        *([] if strict else [F.array_compact(F.array(*(L.bad_gold(F.col(f"raw_{t}")) for t in targets))).alias("bad_gold")]),
        F.coalesce(*(F.col(f"project_{t}") for t in targets)).alias("cancer_type"),
        *(L.has_explicit_token(F.col("text"), t).alias(f"easy_{t}") for t in targets),
    )


def pool(df: DataFrame, mode: str = "all-three") -> DataFrame:
    """Rows with gold for all targets, or for any of them."""
    golds = [F.col(f"gold_{t}").isNotNull() for t in K.TARGETS]
    if mode not in ("all-three", "any"):
        raise ValueError(f"unknown pool: {mode!r}")
    return df.filter(reduce((lambda a, b: a & b) if mode == "all-three" else (lambda a, b: a | b), golds))


def long_gold(reports: DataFrame) -> DataFrame:
    """case_id, target, gold: one row per target of every case."""
    golds = F.explode(F.array(*(
        F.struct(F.lit(t).alias("target"), F.col(f"gold_{t}").alias("gold")) for t in K.TARGETS))).alias("g")
    return reports.select("case_id", golds).select("case_id", "g.*")


def predictions_with_gold(reports: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers beside the gold of their case and target; one of an invalid shape has no value, one without a case no gold."""
    rows = responses.select(
        "case_id", "arm", "target", F.when(F.col("shape_valid"), F.col("raw_value")).alias("value"))
    return rows.join(long_gold(reports), ["case_id", "target"], "left").select("case_id", "arm", "target", "value", "gold")


def dataset_counts(df: DataFrame) -> DataFrame:
    """Rows, gold coverage per target, and rows with gold for all targets and for any."""
    golds = [F.col(f"gold_{t}").isNotNull() for t in K.TARGETS]
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(g).alias(f"n_gold_{t}") for t, g in zip(K.TARGETS, golds)),
        F.count_if(golds[0] & golds[1] & golds[2]).alias("n_all_three"),
        F.count_if(golds[0] | golds[1] | golds[2]).alias("n_any"),
    )


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Inner join in which a left row without a partner fails the job."""
    marked = left.join(right.withColumn("_found", F.lit(True)), keys, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {what} for "), F.concat_ws("/", *keys))).cast("boolean")
    return marked.withColumn("_found", F.coalesce(F.col("_found"), missing)).filter("_found").drop("_found")


def with_text(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Left join to the report text; a case without a report gets the empty text."""
    return rows.join(reports.select("case_id", "text"), "case_id", "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )


def overlap_leaks(overlap: DataFrame, train: DataFrame) -> DataFrame:
    """The ids of ``overlap`` that ``train`` holds too.

    Train ids are first met by 8-byte keys; whole ids are compared only where a key agrees.
    """
    keys = overlap.select(F.xxhash64("case_id").alias("_key")).distinct()
    alike = train.select("case_id", F.xxhash64("case_id").alias("_key")).join(keys, "_key", "left_semi")
    return overlap.join(alike, "case_id", "left_semi").select("case_id").distinct()


def overlap_lists(sampled: DataFrame, held_out: DataFrame, train: DataFrame) -> DataFrame:
    """Sampled rows (case_id and any columns) whose case is held out; a case that is in ``train`` fails the job."""
    overlap = sampled.join(held_out.select("case_id").distinct(), "case_id", "left_semi")
    leaks = overlap_leaks(overlap, train).withColumn("_leak", F.lit(True))
    failed = F.raise_error(F.concat(F.lit("a train case is in the overlap: "), F.col("case_id"))).cast("boolean")
    marked = overlap.join(leaks, "case_id", "left").withColumn("_leak", F.when(F.col("_leak"), failed).otherwise(False))
    return marked.filter(~F.col("_leak")).drop("_leak")


def cases_by_arms(cases: DataFrame, arms: tuple[str, ...]) -> DataFrame:
    """All (case, arm) requests; the arms are a literal list, so nothing is shuffled."""
    return cases.withColumn("arm", F.explode(F.array(*(F.lit(a) for a in arms))))


def todo(requests: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Requests that the checkpoint does not hold yet."""
    return requests.join(checkpoint, ["case_id", "arm"], "left_anti")


def completeness(rows: DataFrame, cases: DataFrame, systems: list[str]) -> DataFrame:
    """Per target: cases, expected and actual rows, and the (case, system) pairs absent from rows.

    ``rows``: case_id, target, system.  ``cases``: case_id, target.
    """
    expected = cases.select("case_id", "target").withColumn(
        "system", F.explode(F.array(*(F.lit(s) for s in systems)))
    )
    keys = ["case_id", "target", "system"]
    # the label pairs each side in one grouping: rows seen against rows expected
    both = expected.select(*keys, F.lit(1).alias("want"), F.lit(0).alias("have")).unionByName(
        rows.select(*keys, F.lit(0).alias("want"), F.lit(1).alias("have"))
    ).groupBy(*keys).agg(F.max("want").alias("want"), F.sum("have").alias("have"))
    return both.groupBy("target").agg(
        F.sum("want").alias("n_expected"), F.sum("have").alias("n_rows"),
        F.count_if((F.col("want") == 1) & (F.col("have") == 0)).alias("n_missing"),
        F.count_if(F.col("want") == 0).alias("n_unexpected"),
        F.count_if(F.col("have") > 1).alias("n_repeated"),
    ).withColumn("complete", (F.col("n_missing") + F.col("n_unexpected") + F.col("n_repeated")) == 0)


def require_complete(table: DataFrame) -> DataFrame:
    """The completeness table; fails the job when a target is not complete."""
    failed = F.raise_error(F.concat(F.lit("incomplete rows for target "), F.col("target"))).cast("boolean")
    return table.withColumn("complete", F.when(F.col("complete"), True).otherwise(failed))


def preflight(df: DataFrame, *, sample_size: int, arms: tuple[str, ...], retries: int = 3,
              mode: str = "all-three", strict: bool = False) -> DataFrame:
    """Pool size against the request, and the work a run would be; refuses a pool that is short."""
    short: Column = F.col("eligible") < sample_size
    refusal = F.raise_error(F.concat(
        F.lit(f"asked for {sample_size} cases, eligible: "), F.col("eligible").cast("string"))).cast("boolean")
    n_requests = sample_size * len(arms)
    return pool(df, mode).agg(F.count(F.lit(1)).alias("eligible")).select(
        "eligible", F.lit(sample_size).cast("long").alias("requested"),
        F.lit(n_requests).cast("long").alias("n_requests"),
        F.lit(n_requests * len(K.TARGETS)).cast("long").alias("n_records"),
        F.lit(n_requests * retries).cast("long").alias("worst_case_attempts"),
        (F.when(short, refusal).otherwise(True) if strict else ~short).alias("accepted"),
    )


def invalid_by_arm(results: DataFrame) -> DataFrame:
    """Results and invalid results per arm."""
    return results.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("invalid").alias("n_invalid")
    )

"""Views for reading single cases: triage table, category tags, curated examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions import taxonomy
from spanledger.functions.labels import legacy_from_arm
from spanledger.functions.text import scrub_personal_data


def triage_view(rows: DataFrame, target: str = "M") -> DataFrame:
    """One row per case: gold and, for every legacy arm, the value and boundary tag of one target."""
    letter = legacy_from_arm(F.col("arm"))
    return rows.filter(F.col("target") == target).groupBy("case_id").agg(
        F.max("gold").alias(f"gold_{target}"),
        *(
            F.max(F.when(letter == a, F.col(c))).alias(f"{a}_{name}")
            for a in K.LEGACY_ARMS
            for c, name in (("value_norm", target), ("boundary_tag", "tag"))
        ),
    )


def tagged_cases(records: DataFrame) -> DataFrame:
    """(case, target) groups that have all study arms, with their sorted tags and title."""
    row = F.struct(
        "prediction", "correct", "abstained", F.col("evidence_span_found").alias("span"),
        F.col("evidence_semantically_supports_prediction").alias("support"), "evidence",
    )
    groups = records.groupBy("case_id", "target").agg(
        F.max("ground_truth").alias("gold"),
        *(F.max(F.when(F.col("arm") == a, row)).alias(a) for a in K.STUDY_ARMS),
    ).dropna(subset=list(K.STUDY_ARMS))
    tags = taxonomy.example_tags(F.col("target"), F.col("gold"), {a: F.col(a) for a in K.STUDY_ARMS})
    return groups.withColumn("tags", tags).withColumn("title", taxonomy.example_title(F.col("tags")))


def curated_examples(
    tagged: DataFrame, default_case: tuple[str, str] | None = None, quotas=K.EXAMPLE_QUOTAS,
    reports: DataFrame | None = None,
) -> DataFrame:
    """A few cases per tag, diverse over targets, each case once, the default case first.

    With ``reports`` (case_id, text) only cases that have a report are chosen, and the chosen ones carry its
    text with personal data replaced (column report).

    A pick can displace only as many candidates as there are picks in all, so that many first cases
    per (tag, target) suffice.  The ranked filter bounds the candidates by the quotas inside every
    task, and only this bounded set (quotas, not data, decide its size) goes through the choice.
    """
    if reports is not None:
        texts = reports.filter(F.col("text").isNotNull()).select("case_id", "text")
        tagged = tagged.join(texts.select("case_id"), "case_id", "left_semi")
    depth = sum(q for _, q in quotas) + 1
    names = [t for t, _ in quotas]
    memberships = tagged.select("case_id", "target", "tags", F.explode("tags").alias("tag")).filter(
        F.col("tag").isin(*names)
    )
    pool = memberships.groupBy("tag").agg(F.count(F.lit(1)).alias("pool"))
    rank = F.row_number().over(Window.partitionBy("tag", "target").orderBy("case_id"))
    ranked = memberships.withColumn("rank", rank).filter(F.col("rank") <= depth).drop("rank")
    candidates = ranked.join(pool, "tag").select("case_id", "target", "tags", "tag", "pool")
    if default_case is not None:
        first = tagged.filter((F.col("case_id") == default_case[0]) & (F.col("target") == default_case[1]))
        candidates = candidates.unionByName(
            first.select("case_id", "target", "tags", F.lit("").alias("tag"), F.lit(1).cast("long").alias("pool"))
        )

    chosen = _choose(candidates, quotas)
    out = chosen.join(tagged, ["case_id", "target"])
    report = []
    if reports is not None:
        out = out.join(texts, "case_id")
        report = [scrub_personal_data(F.col("text")).alias("report")]
    return out.select(
        "position",
        F.format_string("case-%02d", "position").alias("id"),
        F.format_string("Case %02d", F.col("position") + 1).alias("display_id"),
        "title", "case_id", "target", "gold", F.col("tags").alias("categories"),
        *(F.col(a) for a in K.STUDY_ARMS), *report,
    )


def _choose(candidates: DataFrame, quotas) -> DataFrame:
    """(position, case_id, target): the quotas filled in order, one ranked round for each tag.

    A round ranks the cases of its tag that no earlier round took: first one case of every target, then the rest, by target and
    case; a scarce tag (no more cases than its quota) goes straight through.  Only the bounded candidates are ranked.
    """
    state = candidates.groupBy("case_id", "target").agg(
        F.first("tags").alias("tags"), F.collect_set("tag").alias("candidate_for"),
        F.map_from_entries(F.collect_list(F.struct("tag", "pool"))).alias("pools"))
    given = F.array_contains("candidate_for", "")
    state = state.select("*", F.when(given, 0).alias("round"), F.when(given, 1).alias("place"))
    everyone = Window.partitionBy()
    for number, (tag, quota) in enumerate(quotas, 1):
        taken = F.count_if(F.col("round").isNotNull() & F.array_contains("tags", tag)).over(everyone)
        pool = F.coalesce(F.max(F.try_element_at("pools", F.lit(tag))).over(everyone), F.lit(0))
        state = state.select("*", (F.col("round").isNull() & F.array_contains("candidate_for", tag)).alias("open"),
                             (pool - taken <= quota).alias("scarce"))
        turn = F.row_number().over(Window.partitionBy("open", "target").orderBy("case_id"))
        state = state.withColumn("later", ~F.col("scarce") & (turn > 1))
        rank = F.row_number().over(Window.partitionBy("open").orderBy("later", "target", "case_id"))
        state = state.withColumn("rank", rank)
        picked = F.col("open") & (F.col("rank") <= quota)
        state = state.select("case_id", "target", "tags", "candidate_for", "pools",
                             F.when(picked, number).otherwise(F.col("round")).alias("round"),
                             F.when(picked, F.col("rank")).otherwise(F.col("place")).alias("place"))
    order = Window.orderBy("round", "place")
    return state.filter("round is not null").select(
        (F.row_number().over(order) - 1).cast("long").alias("position"), "case_id", "target")

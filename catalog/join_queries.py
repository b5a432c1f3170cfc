"""Joins, dataset building, completeness checks and resumable scoring."""

from __future__ import annotations

import contextlib

import json
import re

from pyspark.sql import functions as F

from catalog import views as V
from catalog.metric_queries import BASE
from catalog.oracle_base import REPORT_FEATURES, canon, lit, with_boundary, with_records, with_views
from catalog.registry import query
from catalog.scalar_queries import raw_sql
from spanledger import constants as K
from spanledger.operators import classify, dataset, records as R, resample
from spanledger.session import scratch_path
from spanledger.streaming import requests, resume


def registry_sql(target: str) -> str:
    return f"""(SELECT case_id AS case_submitter_id, CASE WHEN copy = 1 THEN '{target}0' WHEN doc_id % 2 = 0 THEN gold_{target}
      ELSE gold_{target} || 'a' END AS raw, 'P-' || source AS project_id, doc_id * 2 + copy AS row_no
    FROM rep, (VALUES (0), (1)) c(copy) WHERE gold_{target} IS NOT NULL)"""


_FIRST = ", ".join(f"""
reg_{t} AS (SELECT case_submitter_id, arg_min(raw, row_no) AS raw, arg_min(project_id, row_no) AS project_id
  FROM {registry_sql(t)} GROUP BY case_submitter_id)""" for t in K.TARGETS)
_DATASET = f"""
dataset AS MATERIALIZED (
  SELECT r.patient_filename, r.case_id AS submitter_id, r.text, {', '.join(f"{canon(f'reg_{t}.raw')} AS gold_{t}" for t in K.TARGETS)},
    coalesce(reg_T.project_id, reg_N.project_id, reg_M.project_id) AS cancer_type, easy_T, easy_N, easy_M
  FROM rep r JOIN feat USING (case_id) {' '.join(f'LEFT JOIN reg_{t} ON r.case_id = reg_{t}.case_submitter_id' for t in K.TARGETS)}
)"""


def built(spark, d):
    return dataset.build_dataset(V.raw_reports(spark, d), {t: V.registry(spark, d, t) for t in K.TARGETS})


@query("j1_dataset_build", with_views(
    "SELECT patient_filename, submitter_id, md5(text) AS text_md5, gold_T, gold_N, gold_M, cancer_type, easy_T, easy_N, easy_M FROM dataset",
    REPORT_FEATURES, _FIRST, _DATASET), bools="easy_T easy_N easy_M")
def _(spark, d):
    return built(spark, d).select("patient_filename", "submitter_id", F.md5("text").alias("text_md5"),
                                  "gold_T", "gold_N", "gold_M", "cancer_type", "easy_T", "easy_N", "easy_M")


@query("a42_dataset_counts", with_views("""SELECT count(*) AS n, count(gold_T) AS n_gold_T, count(gold_N) AS n_gold_N, count(gold_M) AS n_gold_M,
    count(*) FILTER (WHERE gold_T IS NOT NULL AND gold_N IS NOT NULL AND gold_M IS NOT NULL) AS n_all_three,
    count(*) FILTER (WHERE coalesce(gold_T, gold_N, gold_M) IS NOT NULL) AS n_any FROM dataset""", REPORT_FEATURES, _FIRST, _DATASET))
def _(spark, d):
    return dataset.dataset_counts(built(spark, d))


@query("j2_predictions_to_dataset", with_boundary(
    "SELECT case_id, arm, target, value, gold FROM bnd"))
def _(spark, d):
    return dataset.predictions_with_gold(V.reports(spark, d), V.responses(spark, d))


_WIDE = ", ".join(
    f"max(CASE WHEN target = '{t}' AND shape_valid THEN {c} END) AS pred_{t}_{k}" for t in K.TARGETS
    for k, c in (("value", "raw_value"), ("evidence", "md5(evidence)"), ("confidence", "confidence"), ("reason", "reason")))


@query("j3_checked_lookup", with_views(
    f"SELECT case_id, arm, bool_or(NOT shape_valid) AS invalid, {_WIDE} FROM resp GROUP BY case_id, arm"), bools="invalid")
def _(spark, d):
    wide = R.wide_predictions(V.responses(spark, d))
    cases = dataset.cases_by_arms(V.reports(spark, d).select("case_id"), K.STUDY_ARMS)
    found = dataset.lookup_join(cases, wide, ["case_id", "arm"], "prediction")
    return found.select(*(F.md5(c).alias(c) if c.endswith("_evidence") else F.col(c) for c in found.columns))


@query("j4_text_with_default", with_records(
    "SELECT r.case_id, r.arm, r.target, md5(coalesce(t.text, '')) AS text_md5 FROM records r LEFT JOIN (SELECT case_id, text FROM rep WHERE gold_M IS NOT NULL) t USING (case_id)"))
def _(spark, d):
    some = V.reports(spark, d).filter("gold_M is not null")
    return dataset.with_text(V.records(spark, d).select("case_id", "arm", "target"), some).select(
        "case_id", "arm", "target", F.md5("text").alias("text_md5"))


def pairs_cte() -> str:
    from catalog.scalar_queries import INDICATORS_SQL

    pairs = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in K.COMPARISON_PAIRS)
    values = "[" + ", ".join(
        f"{{'metric': '{m}', 'd': CAST({_side(c, 'a')} AS INTEGER) - CAST({_side(c, 'b')} AS INTEGER)}}" for m, c in INDICATORS_SQL.items()) + "]"
    return f"""
paired AS MATERIALIZED (
  SELECT a.case_id, a.target, p.arm_a, p.arm_b, unnest({values}) AS v
  FROM (VALUES {pairs}) p(arm_a, arm_b) JOIN records a ON a.arm = p.arm_a
  JOIN records b ON b.arm = p.arm_b AND b.case_id = a.case_id AND b.target = a.target WHERE a.ground_truth IS NOT NULL
),
pair_counts AS MATERIALIZED (
  SELECT scope, metric, arm_a, arm_b, count(*) AS n, count(*) FILTER (WHERE d > 0) AS n_pos, count(*) FILTER (WHERE d < 0) AS n_neg
  FROM (SELECT arm_a, arm_b, v.metric AS metric, v.d AS d, unnest(['overall', target]) AS scope FROM paired) GROUP BY ALL
)"""


def _side(condition: str, alias: str) -> str:
    qualified = re.sub(r"\b(correct|span|sem|abstained)\b", rf"{alias}.\1", condition)
    return f"coalesce({qualified}, false)"


@query("j6_paired_arm_outcomes", with_records("SELECT * FROM pair_counts", pairs_cte()))
def _(spark, d):
    return resample.paired_counts(resample.paired_outcomes(V.records(spark, d)))


@query("j8_overlap_with_gold_check", with_records("SELECT case_id, target, system, gold, prediction, correct, abstained FROM systems WHERE system <> 'baseline'", BASE),
       bools="correct abstained")
def _(spark, d):
    return classify.arm_rows_for_baseline(V.records(spark, d), V.overlap(spark, d)).drop("prediction_raw")


@query("j9_cases_by_arms_by_targets", with_views("SELECT case_id, arm, target FROM resp"))
def _(spark, d):
    pairs = dataset.cases_by_arms(V.reports(spark, d).select("case_id"), K.STUDY_ARMS)
    return pairs.withColumn("target", F.explode(F.array(*(F.lit(t) for t in K.TARGETS))))


@query("j10_completeness", with_records("""
    SELECT target, 5 * count(DISTINCT case_id) AS n_expected, count(*) AS n_rows, 0 AS n_missing, 0 AS n_unexpected, 0 AS n_repeated,
      count(*) = 5 * count(DISTINCT case_id) AS complete FROM systems GROUP BY target""", BASE), bools="complete",
    longs="n_missing n_unexpected n_repeated")
def _(spark, d):
    table = dataset.completeness(V.system_rows(spark, d), V.overlap(spark, d), [*K.STUDY_ARMS, V.BASELINE])
    return dataset.require_complete(table)


def first_arms(spark, d):
    """Results of two arms, as an interrupted run leaves them."""
    done = R.parse_raw(V.raw_answers(spark, d)).filter(F.col("arm").isin(K.STUDY_ARMS[0], K.STUDY_ARMS[1]))
    return done.select("case_id", "arm", "invalid", "raw")


@query("j11_todo_anti_join", with_views(
    "SELECT case_id, arm FROM rep, (VALUES ('C_plus_unknown'), ('D_grounded')) a(arm)"))
def _(spark, d):
    requests = dataset.cases_by_arms(V.reports(spark, d).select("case_id"), K.STUDY_ARMS)
    return dataset.todo(requests, first_arms(spark, d))


@query("j12_checkpoint_to_cases", with_views("SELECT case_id, arm, invalid FROM shaped", raw_sql()), bools="invalid")
def _(spark, d):
    results = R.parse_raw(V.raw_answers(spark, d)).select("case_id", "arm", "invalid")
    wanted = dataset.cases_by_arms(V.reports(spark, d).select("case_id"), K.STUDY_ARMS)
    return dataset.lookup_join(wanted, results, ["case_id", "arm"], "checkpointed result")


@query("a43_preflight", with_views("""SELECT count(*) AS eligible, 100 AS requested, 400 AS n_requests, 1200 AS n_records,
    1200 AS worst_case_attempts, count(*) >= 100 AS accepted FROM rep WHERE gold_T IS NOT NULL AND gold_N IS NOT NULL AND gold_M IS NOT NULL"""),
    bools="accepted", longs="requested n_requests n_records worst_case_attempts")
def _(spark, d):
    return dataset.preflight(V.reports(spark, d), sample_size=100, arms=K.STUDY_ARMS)


@query("a44_invalid_by_arm", with_views("SELECT arm, count(*) AS n, count(*) FILTER (WHERE invalid) AS n_invalid FROM shaped GROUP BY arm", raw_sql()))
def _(spark, d):
    return dataset.invalid_by_arm(R.parse_raw(V.raw_answers(spark, d)))


# ------------------------------------------------------------------ resumable scoring
# a token's last character is far rarer than its letter, so it is looked for first, and what stands before it afterwards
_LETTERS = "".join(K.TARGETS) + "".join(K.TARGETS).lower()
_TOKEN = re.compile(rf"[{''.join(sorted(set(''.join(K.TOKEN_SUFFIXES.values()))))}x](?:(?<=(?<!\w)([{_LETTERS}].))|(?<=(?<!\w)([Pp][{_LETTERS}].)))")


def first_tokens(report: str) -> dict[str, str]:
    """The first stage token of each target, in one pass over the text."""
    found: dict[str, str] = {}
    for hit in _TOKEN.finditer(report):
        token = hit[hit.lastindex]
        target, suffix = token[-2:].upper()
        if suffix in K.TOKEN_SUFFIXES[target] and target not in found:
            found[target] = token
            if len(found) == len(K.TARGETS):
                break
    return found


def token_scorer(arm: str, report: str) -> str:
    """Stand-in for a model: the first stage token of the text, or an abstention."""
    out = {}
    found = first_tokens(report)
    for t in K.TARGETS:
        value = found.get(t)
        out[f"{t}_stage"] = {"value": value, "evidence": value, "confidence": "high" if value else "low", "reason": None}
    return json.dumps(out)


def _requests(spark, d, arms):
    return dataset.cases_by_arms(V.reports(spark, d).select("case_id", "text"), arms)


def _token_sql(t: str) -> str:
    token = r"(?i)(?:^|[^\p{L}\p{N}_])(p?" + t + f"[{K.TOKEN_SUFFIXES[t]}])"
    return f"nullif(regexp_extract(text, {lit(token)}, 1), '') AS {t}_value"


_SCORED = f"SELECT case_id, arm, false AS invalid, {', '.join(_token_sql(t) for t in K.TARGETS)} FROM rep, (VALUES {{arms}}) a(arm)"


def _values(frame):
    return frame.select("case_id", "arm", "invalid", *(F.col(f"extraction.{t}_stage.value").alias(f"{t}_value") for t in K.TARGETS))


@query("k1_resumable_rounds", with_views(_SCORED.replace("{arms}", ", ".join(f"({lit(a)})" for a in K.STUDY_ARMS))), bools="invalid")
def _(spark, d):
    """Two arms first, with requests that are throttled in their only round; then all arms."""
    def throttled(arm: str, report: str) -> str:
        if len(report) % 3 == 0:
            raise resume.RetryLater("slow down")
        return token_scorer(arm, report)

    path = scratch_path(spark, "checkpoint")
    texts = V.reports(spark, d).select("case_id", "text")
    with contextlib.suppress(resume.Unfinished):
        resume.run_rounds(texts, K.STUDY_ARMS[:2], path, throttled, max_rounds=1)
    return _values(resume.run_rounds(texts, K.STUDY_ARMS, path, token_scorer))


@query("k1_compacted_checkpoint", with_views(_SCORED.replace("{arms}", ", ".join(f"({lit(a)})" for a in K.STUDY_ARMS))), bools="invalid")
def _(spark, d):
    """The arms one after the other, each round followed by a merge of its batch; merged batches are then removed."""
    path = scratch_path(spark, "compacted")
    texts = V.reports(spark, d).select("case_id", "text")
    for n in range(1, len(K.STUDY_ARMS) + 1):
        resume.run_rounds(texts, K.STUDY_ARMS[:n], path, token_scorer, compact_every=1)
    resume.drop_merged(spark, path)
    return _values(resume.read_checkpoint(spark, path))


@query("k1_request_stream", with_views(_SCORED.replace("{arms}", ", ".join(f"({lit(a)})" for a in K.STUDY_ARMS))), bools="invalid")
def _(spark, d):
    """Requests of all arms as files of a stream; every ninth text is throttled in the first round and queued again."""
    queue, path, state = (scratch_path(spark, name) for name in ("queue", "stream-results", "stream-state"))
    requests.add_requests(V.reports(spark, d).select("case_id", "text"), K.STUDY_ARMS, queue)

    def throttled(arm: str, report: str) -> str:
        if len(report) % 9 == 0:
            raise resume.RetryLater("slow down")
        return token_scorer(arm, report)

    with contextlib.suppress(resume.Unfinished):
        requests.score_stream(spark, queue, path, state, throttled, max_rounds=1)
    return _values(requests.score_stream(spark, queue, path, state, token_scorer))


_HELD_OUT = "held AS (SELECT case_id, gold_T, gold_N, gold_M FROM rep WHERE doc_id % 10 >= 7 AND doc_id % 2 = 0)"


@query("s3_leak_free_overlap", with_views("""SELECT 'T' AS target, case_id, gold_T AS gold FROM held WHERE gold_T IS NOT NULL
    UNION ALL SELECT 'N', case_id, gold_N FROM held WHERE gold_N IS NOT NULL
    UNION ALL SELECT 'M', case_id, gold_M FROM held WHERE gold_M IS NOT NULL""", _HELD_OUT))
def _(spark, d):
    """Overlap lists of all targets: sampled cases that the classifier held out, none of which it was trained on."""
    ids = V.reports_with_number(spark, d).select("case_id", (F.col("doc_id") % 10).alias("part"), (F.col("doc_id") % 2).alias("odd"))
    golds = dataset.long_gold(V.reports(spark, d)).filter("gold is not null")
    sampled = golds.join(ids.filter("odd = 0").select("case_id"), "case_id", "left_semi")
    return dataset.overlap_lists(sampled, ids.filter("part >= 7"), ids.filter("part < 7")).select("target", "case_id", "gold")


@query("s3_overlap_leaks", with_views("SELECT case_id FROM rep WHERE doc_id % 10 >= 7 AND doc_id % 7 < 3"))
def _(spark, d):
    """The held-out cases that a careless split left in the train list."""
    ids = V.reports_with_number(spark, d).select("case_id", (F.col("doc_id") % 10).alias("part"), (F.col("doc_id") % 7).alias("seventh"))
    return dataset.overlap_leaks(ids.filter("part >= 7"), ids.filter("seventh < 3"))


def _outcome_scorer(arm: str, report: str) -> str:
    size = len(report) % 10
    if size == 0:
        raise resume.RetryLater("slow down")
    if size == 1:
        raise ValueError("no answer")
    return "not json" if size == 2 else token_scorer(arm, report)


@query("k2_outcome_split", with_views("""SELECT arm, CASE WHEN length(text) % 10 = 0 THEN 'retry' ELSE 'done' END AS outcome,
    length(text) % 10 IN (0, 1, 2) AS invalid, count(*) AS n FROM rep, (VALUES ('C_constrained')) a(arm) GROUP BY ALL"""), bools="invalid")
def _(spark, d):
    scored = resume.score_with(_requests(spark, d, (K.ARM_CONSTRAINED,)), _outcome_scorer)
    return resume.to_results(scored).groupBy("arm", "outcome", "invalid").agg(F.count(F.lit(1)).alias("n"))


@query("u1_score_with", with_views(_SCORED.replace("{arms}", "('D_grounded')")), bools="invalid")
def _(spark, d):
    return _values(resume.to_results(resume.score_with(_requests(spark, d, (K.ARM_GROUNDED,)), token_scorer)))

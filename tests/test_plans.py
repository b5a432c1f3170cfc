import json
import re
import sys

import pytest
from helpers import responses
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.operators import compare, dataset, metrics, records as R
from spanledger.plans import baseline, comparison, evaluation
from spanledger.session import scratch_path
from spanledger.sources import documents, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _dataset(spark, n):
    rows = []
    for i in range(n):
        t, m = None if i % 5 == 0 else f"T{i % 4 + 1}", (f"M{i % 2}" if i % 4 == 0 else None)
        nn = None if i % 3 == 0 else f"N{i % 4}"
        tokens = " ".join(v for v in (t, nn, m) if v)
        rows.append((f"case{i:03d}", f"Report {i}. Stage {tokens} noted.", t, nn, m))
    return spark.createDataFrame(rows, "case_id string, text string, gold_T string, gold_N string, gold_M string")


def first_token_scorer(arm, text):
    out = {}
    for t in "TNM":
        hit = re.search(rf"\b{t}[0-4X]", text)
        value = hit.group(0) if hit else None
        out[f"{t}_stage"] = {"value": value, "evidence": value, "confidence": "high", "reason": None}
    return json.dumps(out) if arm != K.ARM_ZERO_SHOT else "broken"


def test_end_to_end(spark):
    reports, out = _dataset(spark, 60), scratch_path(spark, "run")
    settings = evaluation.Settings(sample_size=20, pool="any", n_boot=100)
    run = evaluation.evaluate_with(reports, first_token_scorer, settings, out, scratch_path(spark, "checkpoint"))
    assert run.records.count() == 20 * 4 * 3
    by = {(r["arm"], r["target"]): r for r in run.bundle.collect()}
    assert by[(K.ARM_GROUNDED, "overall")]["accuracy"] == 1.0 and by[(K.ARM_ZERO_SHOT, "overall")]["accuracy"] == 0.0
    assert {r["error_category"] for r in run.errors.collect()} == {"invalid_schema_output"}
    assert run.comparisons.filter("diff <> 0").count() == 0 and run.summary.first()["n_sampled"] == 20
    doc = json.loads(spark.read.text(f"{out}/metrics_json").first()[0])
    assert doc[K.ARM_GROUNDED]["accuracy"] == 1.0 and set(doc) == set(K.STUDY_ARMS)
    nested = json.loads(spark.read.text(f"{out}/metrics_by_target_json").first()[0])
    assert set(nested[K.ARM_GROUNDED]) == {"T", "N", "M"}
    grid = json.loads(spark.read.text(f"{out}/bootstrap_json").first()[0])
    assert set(grid) == {"overall", "T", "N", "M"} and len(grid["overall"]["accuracy"]) == 3
    again = evaluation.evaluate_with(reports, first_token_scorer, settings, scratch_path(spark, "run"), scratch_path(spark, "checkpoint"))
    assert {r["case_id"] for r in again.records.collect()} == {r["case_id"] for r in run.records.collect()}


def test_short_pool_is_refused_before_anything_is_asked(spark):
    def never(arm, text):
        raise AssertionError("asked")

    settings = evaluation.Settings(sample_size=20, n_boot=10)
    with pytest.raises(Exception, match="asked for 20 cases"):
        evaluation.evaluate_with(_dataset(spark, 6), never, settings, scratch_path(spark, "run"), scratch_path(spark, "checkpoint"))


def test_written_analysis_and_comparison_tables(spark):
    reports, out = _dataset(spark, 24), scratch_path(spark, "jobs")
    answers = [(r["case_id"], a, t, r[f"gold_{t}"], r[f"gold_{t}"]) for r in reports.collect() for a in K.STUDY_ARMS for t in "TNM"]
    recs = R.build_records(reports, responses(spark, answers))
    comparison.analysis_tables(recs, metrics.metrics(recs), out)
    assert spark.read.parquet(f"{out}/error_rates").columns == metrics.error_rates(recs).columns
    assert spark.read.parquet(f"{out}/gold_distribution").count() == metrics.gold_distribution(recs).count()
    card = comparison.first_generation(reports, responses(spark, answers), f"{out}/first")
    assert {r["arm"] for r in card.collect()} == set(K.STUDY_ARMS) and documents.read_cases(spark, f"{out}/first/cases").count() > 0
    stale = recs.withColumn("evidence_semantically_supports_prediction", F.lit(False))
    changes = comparison.rescored(stale, f"{out}/again").filter("metric = 'semantic_supported_accuracy_over_evaluable' and target = 'overall'")
    assert all(r["before"] == 0 and r["diff"] == r["after"] for r in changes.collect())
    pair = comparison.pilot_against_main(stale, recs, f"{out}/pair", rescored_pilot=spark.read.parquet(f"{out}/again/records"))
    assert pair.filter("diff <> 0").count() == 0


def test_registry_join_and_file_order(spark):
    path = {}
    for t in "TNM":
        path[t] = scratch_path(spark, f"reg{t}")
        rows = [(f"S-{i}", f"{t}1a" if t != "M" or i % 2 else None, f"P-{t}") for i in range(40)] + [(f"S-{i}", f"{t}0", "P-late") for i in range(40)]
        df = spark.createDataFrame(rows, f"case_submitter_id string, ajcc_pathologic_{t.lower()} string, project_id string").coalesce(1)
        tables.write_csv(df, path[t])
    reports = spark.createDataFrame([(f"S-{i}.uuid.more", f"text pT{i % 3}") for i in range(42)], "patient_filename string, text string")
    built = dataset.build_dataset(reports, {t: tables.read_registry(spark, path[t], t) for t in "TNM"})
    rows = {r["submitter_id"]: r for r in built.collect()}
    assert len(rows) == 42 and rows["S-3"]["gold_T"] == "T1" and rows["S-3"]["cancer_type"] == "P-T" and rows["S-3"]["easy_T"]
    assert rows["S-2"]["gold_M"] is None and rows["S-3"]["gold_M"] == "M1"
    assert rows["S-41"]["gold_N"] is None and rows["S-41"]["cancer_type"] is None
    counts = dataset.dataset_counts(built).first()
    assert (counts["n"], counts["n_gold_T"], counts["n_gold_M"], counts["n_all_three"]) == (42, 40, 20, 20)


def test_lookup_and_completeness_checks(spark):
    cases = spark.createDataFrame([("a", "T"), ("b", "T")], "case_id string, target string")
    rows = spark.createDataFrame([("a", "T", "x"), ("b", "T", "x"), ("a", "T", "y")], "case_id string, target string, system string")
    table = dataset.completeness(rows, cases, ["x", "y"]).first()
    assert (table["n_expected"], table["n_missing"], table["complete"]) == (4, 1, False)
    with pytest.raises(Exception, match="incomplete rows"):
        dataset.require_complete(dataset.completeness(rows, cases, ["x", "y"])).collect()
    with pytest.raises(Exception, match="no thing for b"):
        dataset.lookup_join(cases.select("case_id"), rows.filter("case_id = 'a'").select("case_id").distinct(), ["case_id"], "thing").collect()
    with pytest.raises(Exception, match="asked for 9 cases"):
        golds = _dataset(spark, 60)
        dataset.preflight(golds, sample_size=9, arms=("A",), strict=True).collect()


def test_baseline_comparison_job(spark):
    reports = _dataset(spark, 24)
    answers = []
    for r in reports.collect():
        for t in "TNM":
            gold = r[f"gold_{t}"]
            answers.append((r["case_id"], "A_zero_shot", t, gold if r["case_id"] < "case012" else None, None))
    recs = R.build_records(reports, responses(spark, answers))
    base = recs.filter("ground_truth is not null").selectExpr(
        "case_id", "target", "'baseline' as system", "ground_truth as gold", "ground_truth as prediction", "ground_truth as prediction_raw",
        "true as correct", "false as abstained", "case_id < 'case005' as was_truncated")
    out = baseline.compare(recs, base.select("case_id", "target", "gold"), base, ["A_zero_shot"], n_boot=50)
    assert all(r["complete"] for r in out.completeness.collect())
    m = {(r["target"], r["system"]): r for r in out.system_metrics.collect()}
    assert m[("T", "baseline")]["accuracy"] == 1.0 and m[("T", "A_zero_shot")]["coverage"] < 1
    assert out.paired.filter("diff > 0").count() == 3
    abstain = out.confusion.filter("prediction = 'ABSTAIN_OR_INVALID' and gold = 'ABSTAIN_OR_INVALID'").collect()
    assert {r["system"] for r in abstain} == {"A_zero_shot"} and all(r["n"] == 0 for r in abstain)
    assert {r["m1_recall_note"] for r in out.truncation.filter("target = 'M'").collect()} == {"n<5, too small to interpret"}
    wrong = base.select("case_id", "target", "gold").replace("T2", "T3", "gold")
    with pytest.raises(Exception, match="gold mismatch"):
        baseline.compare(recs, wrong, base, ["A_zero_shot"], n_boot=10)


def test_case_documents_round_trip(spark):
    reports = _dataset(spark, 6)
    rows = [(r["case_id"], a, t, r[f"gold_{t}"], r[f"gold_{t}"]) for r in reports.collect() for a in (K.ARM_ZERO_SHOT, K.ARM_GROUNDED) for t in "TNM"]
    path = scratch_path(spark, "cases")
    documents.write_documents(documents.case_documents(reports, R.boundary_rows(reports, responses(spark, rows))), path)
    cases = documents.read_cases(spark, path)
    assert {r["id"] for r in documents.case_ids(cases).collect()} == {f"case{i:03d}" for i in range(6)}
    one = documents.get_case(cases, "case004").first()
    assert one["gold"]["M"] == "M0" and one["predictions"]["A"]["M"]["boundary_tag"] == "correct" and set(one["predictions"]) == {"A", "D"}
    summary = {r["id"]: r for r in documents.case_summaries(cases).collect()}
    assert summary["case004"]["A_M"] == "M0" and summary["case004"]["B_M"] is None and summary["case001"]["D_tag"] is None


def _bundle(spark, experiment, values):
    names = ["accuracy", "semantic_unsupported_rate_over_evaluable", "semantic_supported_accuracy_over_evaluable"]
    rows = [(experiment, arm, t, *map(float, v)) for (arm, t), v in values.items()]
    return spark.createDataFrame(rows, "experiment string, arm string, target string, " + ", ".join(f"{n} double" for n in names))


def test_replication_claims(spark):
    a, c, p, d = K.STUDY_ARMS
    holds = {(a, "overall"): (.68, .59, .27), (c, "overall"): (.70, .51, .29), (p, "overall"): (.63, .44, .27), (d, "overall"): (.62, .40, .31),
             (a, "M"): (.45, 0, .03), (c, "M"): (.47, 0, .04)}
    fails = {(a, "overall"): (.80, .59, .37), (c, "overall"): (.70, .41, .29), (p, "overall"): (.63, .44, .27), (d, "overall"): (.62, .40, .31),
             (a, "M"): (.45, 0, .40)}
    partial = {(c, "overall"): (.70, .41, .29)}
    runs = _bundle(spark, "good", holds).unionByName(_bundle(spark, "bad", fails)).unionByName(_bundle(spark, "part", partial))
    got = {}
    for r in compare.replication_claims(runs).collect():
        got.setdefault(r["experiment"], {})[r["claim"]] = r["holds"]
    assert list(got["good"].values()).count(True) == 5 and len(got["good"]) == 5
    assert list(got["bad"].values()).count(False) == 5
    assert got["part"] == {"C_highest_or_near_highest_accuracy": True, "C_relatively_poor_grounding": False}


def test_best_arm_ties_go_to_the_first_name(spark):
    b = _bundle(spark, "x", {("B", "overall"): (.5, 0, 0), ("A", "overall"): (.5, 0, 0), ("C", "overall"): (.1, 0, 0)})
    assert compare.best_arm(b, "accuracy").first()["best_arm"] == "A"
    assert compare.best_arm(b, "accuracy", highest=False).first()["best_arm"] == "C"
    assert metrics.OVERALL == "overall"

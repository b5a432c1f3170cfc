import json

import pytest
from helpers import col, column, records, record, reports, responses
from pyspark.sql import functions as F

from spanledger.functions import formats
from spanledger.operators import metrics as M
from spanledger.operators import records as R
from spanledger.session import scratch_path
from spanledger.sources import jsonl

REPORT = "Sigmoid resection, 14 cm. The growth is staged pT2 and reaches the muscle coat; margins clear. Two of nine nodes hold tumour. Scan: M0."
CASES = [  # raw, evidence, target, gold, shape_valid -> prediction, correct, abstained, span, support, errors
    ("M0", None, "M", "M0", True, ("M0", True, False, False, False, ["evidence_span_not_found"])),
    ("T2", "staged pT2 and reaches the muscle coat", "T", "T2", True, ("T2", True, False, True, True, [])),
    ("T2", "margins clear", "T", "T2", True, ("T2", True, False, True, False, ["evidence_does_not_support_prediction"])),
    ("N3", None, "N", None, True, ("N3", None, False, False, False, ["evidence_span_not_found"])),
    (None, None, "N", "N1", True, ("unknown", False, True, None, None, [])),
    ("T2", "staged pT2", "T", "T2", False, ("INVALID", False, False, False, False, ["invalid_schema_output"])),
    ("bulky", "staged pT2", "T", "T2", True, ("INVALID", False, False, True, False, ["invalid_normalization"])),
    ("unknown", None, "M", "M0", True, ("unknown", False, True, None, None, ["over_abstention", "missed_explicit_stage"])),
    ("M1", "Scan: M0", "M", "M0", True, ("M1", False, False, True, False, ["evidence_does_not_support_prediction", "wrong_stage_with_supporting_evidence"])),
    ("M1", "nodules all over the liver", "M", "M0", True, ("M1", False, False, False, False, ["evidence_span_not_found", "hallucinated_stage"])),
]


def _built(spark):
    golds = {t: i for i, t in enumerate("TNM")}
    rows, answers = [], []
    for i, (raw, evidence, target, gold, valid, _) in enumerate(CASES):
        g = [None, None, None]
        g[golds[target]] = gold
        rows.append((f"c{i}", REPORT, *g))
        answers.append((f"c{i}", "D_grounded", target, raw, evidence, valid))
    return R.build_records(reports(spark, rows), responses(spark, answers))


def test_build_record_rules(spark):
    got = {r["case_id"]: r for r in _built(spark).collect()}
    for i, case in enumerate(CASES):
        r = got[f"c{i}"]
        assert (r["prediction"], r["correct"], r["abstained"], r["evidence_span_found"],
                r["evidence_semantically_supports_prediction"], r["errors"]) == case[-1], case
    assert got["c5"]["raw_model_output"] == {} and got["c5"]["evidence"] is None
    assert got["c2"]["raw_model_output"] == {"value": "T2", "evidence": "margins clear", "confidence": "high", "reason": None}


def test_rescore_touches_one_column(spark):
    built = _built(spark)
    stale = built.withColumn("evidence_semantically_supports_prediction", F.when(~F.col("abstained"), False))
    assert sorted(map(str, R.rescore(stale).collect())) == sorted(map(str, built.collect()))


def test_lines_round_trip_with_blank_lines_and_legacy_key(spark, tmp_path):
    built = _built(spark)
    path = scratch_path(spark, "lines")
    jsonl.write_lines(built, path)
    assert sorted(map(str, jsonl.read_records(spark, path).collect())) == sorted(map(str, built.collect()))
    base = {"case_id": "a", "arm": "X", "target": "T", "ground_truth": None, "prediction": "T1", "evidence": None,
            "correct": None, "abstained": False, "errors": [], "raw_model_output": {}}
    lines = [json.dumps(base | {"supported": True, "surprise": 1}), "", "   ",
             json.dumps(base | {"case_id": "b", "evidence_span_found": None, "supported": True})]
    (tmp_path / "old.jsonl").write_text("\n".join(lines))
    rows = {r["case_id"]: r for r in jsonl.read_records(spark, str(tmp_path / "old.jsonl")).collect()}
    assert rows["a"]["evidence_span_found"] is True and rows["a"]["evidence_semantically_supports_prediction"] is None
    assert rows["b"]["evidence_span_found"] is None


def _answer(**changes):
    field = {"value": "T2", "evidence": None, "confidence": "high", "reason": None}
    return {f"{t}_stage": dict(field) for t in "TNM"} | changes


def test_json_shape(spark):
    field = {"value": "T2", "evidence": None, "confidence": "high"}
    docs = [
        (json.dumps(_answer()), False), (json.dumps(_answer(extra=1)), False), ("not json", True), (None, True), ("[]", True),
        (json.dumps(_answer(T_stage=field)), False),                                  # reason may be absent
        (json.dumps(_answer(T_stage=field | {"value": None})), False),                # null value is an abstention
        (json.dumps(_answer(T_stage=field | {"value": 2})), True), (json.dumps(_answer(T_stage=field | {"value": True})), True),
        (json.dumps(_answer(T_stage=field | {"confidence": "sure"})), True), (json.dumps(_answer(T_stage=field | {"reason": 3})), True),
        (json.dumps(_answer(T_stage={"value": "T2", "confidence": "high"})), True),   # evidence missing
        (json.dumps(_answer(T_stage=None)), True), (json.dumps({k: v for k, v in _answer().items() if k != "M_stage"}), True),
        (json.dumps(_answer(pathologic_stage=None)), False), (json.dumps(_answer(pathologic_stage=field)), False),
        (json.dumps(_answer(pathologic_stage={"value": "II"})), True),
        (json.dumps(_answer())[:-1] + ', "T_stage": null}', True), ('{"M_stage": 1, ' + json.dumps(_answer())[1:], False),
    ]
    df = spark.createDataFrame([(f"{i:02d}", "A", d) for i, (d, _) in enumerate(docs)], "case_id string, arm string, raw string")
    got = R.parse_raw(df).orderBy("case_id").collect()
    assert [r["invalid"] for r in got] == [e for _, e in docs]
    assert got[0]["T_stage"]["value"] == "T2" and got[2]["T_stage"] is None


def test_mixed_metrics(spark):
    rows = [record("c1", gold="T2", pred="T2"), record("c2", gold="T3", pred="T1"), record("c3", gold="T1", pred="T1", span=False, sem=False),
            record("c4", gold="T4", pred="unknown"), record("c5", pred="T2")]
    df = records(spark, rows).withColumn("raw_model_output", F.when(F.col("case_id") == "c4", F.create_map(F.lit("value"), F.lit(None).cast("string")))
                                         .otherwise(F.col("raw_model_output")))
    m = {r["target"]: r.asDict() for r in M.metrics(df).collect()}
    t = m["T"]
    assert (t["n_total"], t["n_evaluable"], t["n_asserted"]) == (5, 4, 3)
    expected = {
        "accuracy": 2 / 4, "accuracy_over_asserted": 2 / 3, "abstention_rate": 1 / 4, "coverage": 3 / 4,
        "span_unsupported_rate_over_evaluable": 1 / 4, "span_unsupported_rate_over_asserted": 1 / 3,
        "span_grounded_accuracy_over_evaluable": 1 / 4, "span_grounded_accuracy_over_asserted": 1 / 3,
        "semantic_unsupported_rate_over_evaluable": 1 / 4, "semantic_unsupported_rate_over_asserted": 1 / 3,
        "semantic_supported_accuracy_over_evaluable": 1 / 4, "semantic_supported_accuracy_over_asserted": 1 / 3,
        "allowed_value_compliance": 3 / 4, "evidence_span_found_rate": 2 / 3, "evidence_semantic_support_rate": 2 / 3,
        "unsupported_rate_over_evaluable": 1 / 4, "supported_accuracy_over_asserted": 1 / 3,
    }
    for name, value in expected.items():
        assert t[name] == pytest.approx(value), name
    assert {k: v for k, v in m["overall"].items() if k != "target"} == {k: v for k, v in t.items() if k != "target"}
    assert m["N"]["n_total"] == 0 and m["N"]["accuracy"] is None and m["N"]["coverage"] is None


def test_value_deep_dive(spark):
    rows = [record("c1", "X", "M", "M0", "M0"), record("c2", "X", "M", "M1", "M0", span=False, sem=False),
            record("c3", "X", "M", "M1", "M1"), record("c4", "X", "M", "M0", "unknown"), record("c1", "Y", "M", "M1", "M1")]
    got = {r["arm"]: r for r in M.value_deep_dive(records(spark, rows)).collect()}
    x = got["X"]
    assert (x["n_predictions"], x["n_evaluable"], x["accuracy"]) == (2, 2, 0.5)
    assert x["proportion_of_asserted"] == pytest.approx(2 / 3)
    assert (x["semantic_supported_rate"], x["span_grounded_rate"]) == (0.5, 0.5)
    assert got["Y"]["n_predictions"] == 0 and got["Y"]["accuracy"] is None


def test_error_figure_needs_enough_m_records(spark):
    few = [record(f"c{i}", "X", "M", "M0", "M1", errors=["hallucinated_stage"]) for i in range(9)]
    assert {(r["target"], r["enough"]) for r in M.error_figure(records(spark, few)).collect()} == {("overall", True), ("M", False)}
    enough = few + [record("c9", "X", "M", "M0", "M0")]
    assert {(r["target"], r["enough"]) for r in M.error_figure(records(spark, enough)).collect()} == {("overall", True), ("M", True)}


def test_p_value_display(spark):
    shown = column(spark, [None, 0.0, 0.0002, 0.05, 1.0], formats.p_value_display(col("p"), F.lit(5000)), "p double")
    assert shown == ["n/a", "< 0.0002", "0.0002", "0.0500", "1.0000"]
    shown = column(spark, [0.0002, 0.0004], formats.p_value_display(col("p"), F.lit(5000), at_most_one_draw=True), "p double")
    assert shown == ["< 0.0002", "0.0004"]


def test_request_table_arms_differ_as_designed(spark):
    rows = {r["arm"]: r for r in R.requests(reports(spark, [("c", "TEXT", None, None, None)])).collect()}
    assert len(rows) == 5 and all(r["user"] == "Pathology report:\n\nTEXT" for r in rows.values())
    assert "Allowed values" not in rows["A_zero_shot"]["system"] and "Allowed values" in rows["C_constrained"]["system"]
    assert "Rules:" in rows["D_grounded"]["system"] and "rather than guess" in rows["C_plus_unknown"]["system"]
    assert all('"reason" may be null.' in r["system"] for r in rows.values())


def test_json_arrays(spark, tmp_path):
    (tmp_path / "judgments.json").write_text(json.dumps(
        [{"case_id": "a", "reconstructed_tag": "correct"}, {"case_id": "b", "reconstructed_tag": "x", "caveat": "blurred"}], indent=2))
    rows = jsonl.read_array(spark, str(tmp_path / "judgments.json"), jsonl.JUDGMENT).collect()
    assert {(r["case_id"], r["caveat"]) for r in rows} == {("a", None), ("b", "blurred")}
    path = scratch_path(spark, "arrays")
    many = spark.range(2500).selectExpr("cast(id as string) as case_id", "'t' as reconstructed_tag", "cast(null as string) as caveat")
    jsonl.write_arrays(many, path, rows_per_array=100)
    back = jsonl.read_array(spark, path, jsonl.JUDGMENT, multi_line=False)
    assert back.count() == 2500 and back.select("case_id").distinct().count() == 2500
    assert spark.read.text(path).count() >= 25


def test_one_case_with_most_rows(spark):
    """A hot case must not change any row (the join may split it)."""
    texts = reports(spark, [("hot", REPORT, "T2", None, "M0"), ("cold", "nothing here", "T2", None, None)])
    hot = [("hot", f"arm{i}", "T", "T2", "staged pT2") for i in range(3000)]
    rows = R.build_records(texts, responses(spark, hot + [("cold", "arm0", "T", "T2", "pT2")]))
    assert rows.count() == 3001
    assert rows.filter("case_id = 'hot' and evidence_span_found and correct").count() == 3000
    assert rows.filter("case_id = 'cold' and not evidence_span_found and array_contains(errors, 'evidence_span_not_found')").count() == 1


def test_predictions_meet_their_gold(spark):
    from spanledger.operators import dataset

    cases = reports(spark, [("a", "t", "T1", None, "M0")])
    rows = [("a", "A", "T", "T1", None), ("a", "A", "N", "N0", None), ("a", "B", "M", "M1", None, False), ("z", "A", "T", "T2", None)]
    got = {(r["case_id"], r["arm"], r["target"]): (r["value"], r["gold"]) for r in dataset.predictions_with_gold(cases, responses(spark, rows)).collect()}
    assert got == {("a", "A", "T"): ("T1", "T1"), ("a", "A", "N"): ("N0", None), ("a", "B", "M"): (None, "M0"), ("z", "A", "T"): ("T2", None)}


def test_spans_are_found_from_the_place_in_the_form(spark):
    from spanledger.functions.text import locate_span

    texts = ["İİ a.,. b\nİ c. Tumor  invades. it; tumor invades, İx", "a a a. b", "..  a b", "Straße pT2", "", None, "x.\n.\ny x y", "İİi̇ q Q"]
    quotes = ["tumor invades", "a b", "A. B", "b i̇ c", "i̇x", "x y", "PT2.", "q", "nothing", "", None, "(a", "y x"]
    reps = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "case_id string, text string")
    rows = [(f"c{i}", arm, f"{k}", q) for i in range(len(texts)) for k, q in enumerate(quotes) for arm in ("A", "B")]
    answers = spark.createDataFrame(rows, "case_id string, arm string, target string, evidence string")
    plain = answers.join(reps, "case_id").select("case_id", "arm", "target", locate_span(F.col("text"), F.col("evidence")).alias("s")).filter("s is not null")
    placed = R.locate_spans(reps, answers)
    assert sorted(map(str, placed.collect())) == sorted(map(str, plain.collect())) and plain.count() >= 20
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(lower(text") == 1  # one form of every text

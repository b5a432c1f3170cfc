import pytest
from helpers import record, records, reports

from spanledger.operators import metrics


def _rows(spark):
    recs = records(spark, [
        record("c1", target="T", gold="T1", pred="T1"), record("c2", target="T", gold="T1", pred="T2"), record("c3", target="T", gold="T1", pred="T1"),
        record("c1", target="N", gold="N0", pred="N0"), record("c2", target="N", gold=None, pred="N0"), record("c3", target="N", gold="N1", pred="unknown"),
    ])
    texts = [("c1", "pT1 was seen", None, None, None), ("c2", "nothing named", None, None, None), ("c3", "pN1 there", None, None, None)]
    typed = reports(spark, texts).selectExpr("*", "case case_id when 'c1' then 'lung' when 'c2' then 'colon' end as type")
    return recs.join(metrics.case_splits(typed, "type"), ["case_id", "target"])


def test_every_combination_and_every_subtotal(spark):
    got = metrics.split_metrics(_rows(spark), ["difficulty", "cancer_type"])
    rows = {(r["target"], r["difficulty"], r["cancer_type"], r["pooled_target"], r["pooled_difficulty"], r["pooled_cancer_type"]): r for r in got.collect()}
    assert len(rows) == got.count()
    whole = rows[(None, None, None, True, True, True)]
    assert (whole["n_total"], whole["n_evaluable"], whole["accuracy"]) == (6, 5, pytest.approx(3 / 5))
    easy_t = rows[("T", "easy", None, False, False, True)]
    assert (easy_t["n_total"], easy_t["accuracy"]) == (1, 1.0)
    assert rows[("T", "hard", None, False, False, True)]["accuracy"] == pytest.approx(1 / 2)
    assert rows[("N", "hard", "colon", False, False, False)]["accuracy"] is None  # nothing to evaluate


def test_a_missing_type_is_no_subtotal(spark):
    got = [r for r in metrics.split_metrics(_rows(spark), ["cancer_type"]).collect() if r["pooled_target"] and r["cancer_type"] is None]
    assert {r["pooled_cancer_type"]: r["n_total"] for r in got} == {True: 6, False: 2}


def test_pooled_rows_are_those_of_the_plain_bundle(spark):
    rows = _rows(spark)
    plain = {r["target"]: r["accuracy"] for r in metrics.metrics(rows).collect() if r["n_total"]}
    split = {r["target"] or "overall": r["accuracy"] for r in metrics.split_metrics(rows, ["difficulty"]).collect() if r["pooled_difficulty"]}
    assert split == plain


def test_one_aggregation_reads_the_records(spark):
    plan = metrics.split_metrics(_rows(spark), ["difficulty"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") >= 1 and plan.count("Union") == 0

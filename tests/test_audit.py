import math

import pytest
from helpers import record, records, reports

from spanledger import constants as K
from spanledger.operators import audit as A
from spanledger.plans import audits
from spanledger.session import scratch_path

C, D = K.ARM_CONSTRAINED, K.ARM_GROUNDED


def _pool(priority=8, true=6, false=6, both=10, plain=20):
    rows = [record(f"t{i}", C, "T", "T1", "T1") for i in range(plain)] + [record(f"n{i}", C, "N", "N1", "N1") for i in range(plain)]
    for i in range(priority):
        rows += [record(f"mp{i}", C, "M", "M0", "M0", sem=i % 2 == 0), record(f"mp{i}", D, "M", "M0", "unknown")]
    for name, count, sem in (("mt", true, True), ("mf", false, False)):
        for i in range(count):
            rows += [record(f"{name}{i}", a, "M", "M0", "M0", sem=sem) for a in (C, D)]
    for i in range(both):
        rows += [record(f"mb{i}", a, "M", "M0", "unknown") for a in (C, D)]
    return rows


def _ids(df):
    return {(r["case_id"], r["arm"], r["target"]) for r in df.collect()}


def test_patterns_per_target(spark):
    rows = [record("c1", C, "T", pred="unknown"), record("c1", D, "T"), record("c1", C, "M"), record("c1", D, "M", pred="unknown"),
            record("c2", C, "M"), record("c3", C, "M"), record("c3", D, "M"), record("c4", C, "M", pred="unknown"), record("c4", D, "M", pred="unknown")]
    got = {(r["case_id"], r["target"]): r["arm_pattern"] for r in A.arm_patterns(records(spark, rows)).collect()}
    assert got == {("c1", "T"): "priority_abstains_comparison_predicts", ("c1", "M"): "priority_predicts_comparison_abstains",
                   ("c2", "M"): "pattern_unknown", ("c3", "M"): "both_predict", ("c4", "M"): "both_abstain"}


@pytest.mark.parametrize("quota", [0, 1, 4, 10, 40, 500])
def test_tiers(spark, quota):
    rows = _pool()
    sample = A.audit_sample(records(spark, rows), {"T": 3, "N": 0, "M": quota}, 7)
    got = sample.collect()
    m = [r for r in got if r["target"] == "M"]
    available = sum(r[2] == "M" for r in rows)
    assert len([r for r in got if r["target"] == "T"]) == 3 and not [r for r in got if r["target"] == "N"]
    assert len(m) == min(quota, available) and len(_ids(sample)) == len(got)
    tier1 = [r for r in m if r["tier"] == "priority"]
    assert len(tier1) == min(math.ceil(quota * 0.5), 8)
    assert all(r["arm"] == C and r["case_id"].startswith("mp") for r in tier1)
    each = math.floor((quota - len(tier1)) * 0.3)
    balance = [r["evidence_semantically_supports_prediction"] for r in m if r["tier"] == "semantic_balance"]
    taken = {r["case_id"] for r in tier1}
    left = {s: sum(r[2] == "M" and r[9] is s and not (r[1] == C and r[0] in taken and r[0].startswith("mp")) for r in rows) for s in (True, False)}
    assert balance.count(False) == min(each, left[False]) and balance.count(True) == min(each, left[True])


def test_sample_is_order_independent(spark):
    rows = _pool()
    a = A.audit_sample(records(spark, rows), {"T": 5, "N": 5, "M": 10}, 42)
    b = A.audit_sample(records(spark, reversed(rows)).repartition(5), {"T": 5, "N": 5, "M": 10}, 42)
    assert _ids(a) == _ids(b)


def test_blinding(spark):
    rows = _pool()
    recs = records(spark, rows)
    texts = reports(spark, [(c, f"text of {c}", None, None, None) for c in sorted({r[0] for r in rows})])
    sample = A.audit_sample(recs, {"T": 4, "M": 9}, 3)
    reviewer, key = A.blinded_bundle(recs, texts, sample, 3)
    forbidden = {"arm", "case_id", "ground_truth", "arm_pattern", "tier", "sample_key", "errors"}
    assert not forbidden & set(reviewer.columns) and not [c for c in reviewer.columns if c.startswith("automated")]
    with_gold, _ = A.blinded_bundle(recs, texts, sample, 3, "with-gold")
    assert set(with_gold.columns) - set(reviewer.columns) == {"ground_truth"}
    with pytest.raises(ValueError):
        A.blinded_bundle(recs, texts, sample, 3, "open")
    r, k = reviewer.collect(), {x["audit_id"]: x for x in key.collect()}
    assert sorted(x["audit_id"] for x in r) == sorted(k) == [f"A{i:04d}" for i in range(1, 14)]
    assert all(x["report_excerpt"] == f"text of {k[x['audit_id']]['case_id']}" for x in r)
    assert all((x["arm_pattern"] is not None) == (x["target"] == "M") for x in k.values())
    assert {(x["case_id"], x["arm"], x["target"]) for x in k.values()} == _ids(sample)


def _kappa(tp, fp, tn, fn):
    n = tp + fp + tn + fn
    if n < 2 or tp == n or tn == n:
        return None
    po, pe = (tp + tn) / n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / n ** 2
    return (po - pe) / (1 - pe)


@pytest.mark.parametrize("cells", [(1, 1, 1, 1), (5, 0, 0, 0), (0, 0, 3, 0), (4, 3, 2, 1), (0, 5, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0), (40, 2, 30, 8)])
def test_agreement(spark, cells):
    tp, fp, tn, fn = cells
    pairs = [(True, True)] * tp + [(True, False)] * fp + [(False, False)] * tn + [(False, True)] * fn + [(None, True), (True, None)]
    row = A.agreement(spark.createDataFrame([("g", *p) for p in pairs], "g string, a boolean, h boolean"), ["g"], "a", "h").first()
    n = sum(cells)
    assert (row["tp"], row["fp"], row["tn"], row["fn"], row["n"]) == (*cells, n)
    assert row["percent_agreement"] == (None if n == 0 else pytest.approx((tp + tn) / n))
    assert row["cohens_kappa"] == (None if _kappa(*cells) is None else pytest.approx(_kappa(*cells)))
    for name, a, b in (("precision", tp, fp), ("recall", tp, fn), ("specificity", tn, fp)):
        assert row[name] == (None if a + b == 0 else pytest.approx(a / (a + b)))


def test_build_and_score_jobs(spark):
    rows = _pool()
    recs = records(spark, rows)
    texts = reports(spark, [(c, f"text of {c}", None, None, None) for c in sorted({r[0] for r in rows})])
    out = scratch_path(spark, "bundle")
    report = {r["target"]: r for r in audits.build(recs, texts, {"T": 4, "N": 2, "M": 9}, 11, out).collect()}
    assert (report["M"]["requested"], report["M"]["selected"], report["M"]["priority_selected"]) == (9, 9, 5)
    scores = audits.score(spark, f"{out}/reviewer", f"{out}/key")
    rows = {(r["scope"], r["field"]): r for r in scores.agreement.collect()}
    assert len(rows) == 8 and all(r["n"] == 0 and r["cohens_kappa"] is None for r in rows.values())
    sufficiency = {r["scope"]: r for r in scores.source_sufficiency.collect()}
    assert sufficiency["overall"]["n_reviewed"] == 15 and sufficiency["T"]["pct_source_sufficient"] is None
    assert sum(r["n_reviewed"] for s, r in sufficiency.items() if s.startswith("M:")) == 9
    assert scores.prior_predictions.first()["n"] >= 5


def test_last_duplicate_key_wins(spark):
    reviewer = spark.createDataFrame([("A1", "T", "T1")], "audit_id string, target string, prediction string")
    key = spark.createDataFrame([("A1", "N", "x", 1), ("A1", "M", "y", 2), ("A2", "M", "z", 3)], "audit_id string, target string, arm string, row_no int")
    assert [tuple(r) for r in A.unblind(reviewer, key, "row_no").select("audit_id", "target", "arm").collect()] == [("A1", "T", "y")]

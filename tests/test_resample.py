import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import record, records

from spanledger import constants as K
from spanledger.operators import resample as B

D, C, P = K.ARM_GROUNDED, K.ARM_CONSTRAINED, K.ARM_CONSTRAINED_UNKNOWN


def _counts(spark, n, pos, neg, label="x"):
    return spark.createDataFrame([(label, n, pos, neg)], "label string, n long, n_pos long, n_neg long").withColumnRenamed("label", "k")


def _brute(n, pos, neg, seed, n_boot):
    d = np.array([1] * pos + [0] * (n - pos - neg) + [-1] * neg)
    return np.sort([d[B.draw_indexes(b, n, seed)].mean() for b in range(n_boot)])


def test_paired_comparison_against_brute_force(spark):
    n, pos, neg, seed, n_boot = 97, 30, 11, 7, 300
    means = _brute(n, pos, neg, seed, n_boot)
    row = B.compare_pairs(_counts(spark, n, pos, neg), ["k"], seed=seed, n_boot=n_boot).first()
    assert row["diff"] == pytest.approx((pos - neg) / n)
    assert row["ci_low"] == pytest.approx(means[int(0.025 * (n_boot - 1))])
    assert row["ci_high"] == pytest.approx(means[int(0.975 * (n_boot - 1))])
    assert row["p_value"] == pytest.approx(min(1, 2 * (means <= 0).sum() / n_boot))
    assert row["n_paired_cases"] == n


def test_identical_arms_have_p_one(spark):
    row = B.compare_pairs(_counts(spark, 30, 0, 0), ["k"], seed=6, n_boot=200).first()
    assert (row["diff"], row["ci_low"], row["ci_high"], row["p_value"]) == (0.0, 0.0, 0.0, 1.0)


def test_large_consistent_difference(spark):
    row = B.compare_pairs(_counts(spark, 40, 40, 0), ["k"], seed=7, n_boot=200).first()
    assert (row["diff"], row["ci_low"], row["p_value"]) == (1.0, 1.0, 0.0)


def test_pieces_do_not_change_the_result(spark):
    counts = _counts(spark, 2000, 500, 350)
    whole = B.compare_pairs(counts, ["k"], seed=3, n_boot=300).first()
    assert whole == B.compare_pairs(counts, ["k"], seed=3, n_boot=300, piece=123).first()
    means = _brute(2000, 500, 350, 3, 300)
    assert whole["ci_low"] == pytest.approx(means[int(0.025 * 299)])


def test_ten_and_ten_million_units_take_the_same_path(spark):
    n, pos, neg = 10_000_000, 3_000_000, 2_000_000
    row = B.compare_pairs(_counts(spark, n, pos, neg), ["k"], seed=3, n_boot=20).first()
    means = _brute(n, pos, neg, 3, 20)
    assert (row["ci_low"], row["ci_high"]) == (pytest.approx(means[0]), pytest.approx(means[int(0.975 * 19)]))
    sd = math.sqrt((0.5 - 0.1**2) / n)
    assert np.abs(means - 0.1).max() < 5 * sd and means.std() > sd / 3


def test_pairs_use_shared_evaluable_cases_only(spark):
    rows = [record("c1", D, gold="T1", pred="T1"), record("c1", C, gold="T1", pred="T2"),
            record("c2", D, gold="T1", pred="T1"),                                   # no partner
            record("c3", D, gold=None, pred="T1"), record("c3", C, gold=None, pred="T1"),   # no gold
            record("c1", D, "N", gold="N0", pred="unknown"), record("c1", C, "N", gold="N0", pred="N0", span=False, sem=False)]
    got = {(r["scope"], r["metric"]): (r["n"], r["n_pos"], r["n_neg"]) for r in B.paired_counts(B.paired_outcomes(records(spark, rows))).collect()}
    assert got[("T", "accuracy")] == (1, 1, 0)
    assert got[("N", "abstention_rate")] == (1, 1, 0) and got[("N", "coverage")] == (1, 0, 1)
    assert got[("N", "span_unsupported_rate_over_evaluable")] == (1, 0, 1)
    assert got[("overall", "accuracy")] == (2, 1, 1)
    assert not [k for k in got if k[0] == "M"]


def test_report_table_keeps_missing_pairs(spark):
    rows = [record(f"c{i}", a, gold="T1", pred="T1") for i in range(5) for a in (D, C)]
    table = B.arm_pair_table(B.comparison_grid(records(spark, rows), seed=1, n_boot=50)).collect()
    assert len(table) == 4 * 6 * 3
    filled = [r for r in table if r["diff"] is not None]
    assert {(r["arm_a"], r["arm_b"]) for r in filled} == {(D, C)} and {r["scope"] for r in filled} == {"overall", "T"}
    assert all(r["p_display"] == "1.0000" and r["marker"] == "" for r in filled)


def test_mean_interval(spark):
    groups = {"same": [1.0] * 50, "mixed": [0.0, 1.0] * 50, "one": [1.0], "none": [None, float("nan")],
              "holes": [1.0, 1.0, float("nan"), 1.0], "real": [0.5, 2.25, -1.0, 7.5, 3.125, 0.5]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: r for r in B.bootstrap_mean(df, ["g"], "v", seed=2, n_boot=500).collect()}
    assert (got["same"]["ci_low"], got["same"]["ci_high"]) == (1.0, 1.0)
    assert 0.3 < got["mixed"]["ci_low"] < 0.5 < got["mixed"]["ci_high"] < 0.7
    assert (got["one"]["point_estimate"], got["one"]["ci_low"]) == (1.0, 1.0)
    assert got["none"]["point_estimate"] is None and got["none"]["n"] == 0
    assert got["holes"]["point_estimate"] == 1.0 and got["holes"]["n"] == 3
    values = np.sort(groups["real"])
    means = np.sort([values[B.draw_indexes(b, 6, 2)].mean() for b in range(500)])
    assert got["real"]["ci_low"] == pytest.approx(means[int(0.025 * 499)])
    assert got["real"]["ci_high"] == pytest.approx(means[int(0.975 * 499)])


def test_mean_interval_of_many_values_in_blocks(spark):
    df = spark.range(2000).selectExpr("'g' as g", "cast(id * id % 977 as double) as v")
    values = np.sort([float(i * i % 977) for i in range(2000)])
    means = np.sort([values[B.draw_indexes(b, 2000, 4)].mean() for b in range(200)])
    for piece in (B.PIECE, 300):
        row = B.bootstrap_mean(df, ["g"], "v", seed=4, n_boot=200, piece=piece).first()
        assert row["ci_low"] == pytest.approx(means[int(0.025 * 199)]) and row["ci_high"] == pytest.approx(means[int(0.975 * 199)])
    with pytest.raises(ValueError):
        B.bootstrap_mean(df, [], "v")


def test_baseline_comparison(spark):
    rows = [(f"c{i}", "T", s, ok) for i in range(60) for s, ok in (("baseline", i % 4 != 0), ("A", i % 3 != 0))]
    df = spark.createDataFrame(rows, "case_id string, target string, system string, correct boolean")
    row = B.baseline_comparison(df, "baseline", seed=5, n_boot=400).first()
    pos = sum(i % 4 != 0 and i % 3 == 0 for i in range(60))
    neg = sum(i % 4 == 0 and i % 3 != 0 for i in range(60))
    means = _brute(60, pos, neg, 5, 400)
    low, high = np.percentile(means, [2.5, 97.5])
    assert (row["ci_low"], row["ci_high"]) == (pytest.approx(low), pytest.approx(high))
    assert row["p_value"] == pytest.approx(min(1, 2 * min((means <= 0).sum(), (means >= 0).sum()) / 400))
    assert row["significant"] == (not low <= 0 <= high)


def _values(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double")


def test_real_values_in_blocks_of_ranks_against_brute_force(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=1500), "b": np.round(rng.normal(size=900), 1), "c": [*rng.normal(size=40), *[0.5] * 700], "one": [3.0], "two": [1.0, 2.0]}
    rows = {}
    for block in (1 << 16, 64, 7):
        got = B.bootstrap_mean(_values(spark, groups), ["g"], "v", seed=9, n_boot=120, block=block, piece=333)
        rows[block] = {r["g"]: r for r in got.collect()}
    for g, values in groups.items():
        v = np.sort(values)
        means = np.sort([v[B.draw_indexes(b, len(v), 9)].mean() for b in range(120)]) if len(v) > 1 else [v[0]] * 120
        for block, found in rows.items():
            assert found[g]["n"] == len(v) and found[g]["point_estimate"] == pytest.approx(v.mean())
            assert found[g]["ci_low"] == pytest.approx(means[int(0.025 * 119)]), (g, block)
            assert found[g]["ci_high"] == pytest.approx(means[int(0.975 * 119)]), (g, block)


def test_no_block_of_ranks_holds_more_than_its_size(spark):
    values = _values(spark, {"a": np.arange(5000) % 3700, "b": np.arange(900)})
    held = values.groupBy("g", "v").count().selectExpr("g", "v as value", "count as times", "case g when 'a' then 5000 else 900 end as n")
    blocks = B.rank_blocks(held, ["g"], 256).collect()
    assert sorted((r["g"], r["rank_block"]) for r in blocks) == [*(("a", k) for k in range(20)), *(("b", k) for k in range(4))]
    assert all(len(r["values"]) <= 256 and r["starts"][0] == 0 for r in blocks)
    expected = np.sort(np.arange(5000) % 3700)
    for r in blocks:
        if r["g"] == "a":
            assert r["values"][0] == expected[256 * r["rank_block"]]


def test_ten_million_different_values_in_one_group(spark):
    n = 10_000_000
    values = spark.range(n).selectExpr("'x' as g", "cast(id as double) as v")
    row = B.bootstrap_mean(values, ["g"], "v", seed=3, n_boot=3).first()
    means = np.sort([B.draw_indexes(b, n, 3).mean() for b in range(3)])
    assert row["n"] == n and row["point_estimate"] == pytest.approx((n - 1) / 2)
    assert (row["ci_low"], row["ci_high"]) == (pytest.approx(means[0]), pytest.approx(means[int(0.975 * 2)]))


def _case_records(spark, outcomes):
    """outcomes: per case, whether each target is right under D and under C."""
    rows = []
    for k, targets in enumerate(outcomes):
        for t, (d, c) in zip("TNM", targets, strict=False):
            rows += [record(f"c{k}", arm, t, gold=f"{t}1", pred=f"{t}1" if right else f"{t}2") for arm, right in ((D, d), (C, c))]
    return records(spark, rows)


def _clustered(outcomes, seed, n_boot):
    totals = sorted(((-sum(d - c for d, c in case), len(case)) for case in outcomes))
    total, size = -np.array([t for t, _ in totals]), np.array([s for _, s in totals])
    drawn = [B.draw_indexes(b, len(totals), seed) for b in range(n_boot)]
    return np.sort([total[x].sum() / size[x].sum() for x in drawn])


def test_clusters_carry_all_their_units(spark):
    rng = np.random.default_rng(2)
    outcomes = [[(bool(a), bool(b)) for a, b in rng.integers(0, 2, (rng.integers(1, 4), 2))] for _ in range(60)]
    recs = _case_records(spark, outcomes)
    got = {(r["scope"], r["metric"]): r for r in B.comparison_grid(recs, pairs=[(D, C)], cluster="case_id", seed=4, n_boot=150, piece=17).collect()}
    row, means = got[("overall", "accuracy")], _clustered(outcomes, 4, 150)
    assert row["n_paired_cases"] == sum(map(len, outcomes))
    assert (row["ci_low"], row["ci_high"]) == (pytest.approx(means[int(0.025 * 149)]), pytest.approx(means[int(0.975 * 149)]))


def test_clusters_of_one_unit_draw_as_units_do_and_correlated_targets_widen_the_interval(spark):
    outcomes = [[(k % 3 != 0, k % 2 == 0)] * 3 for k in range(80)]  # all targets of a case agree
    recs = _case_records(spark, outcomes)
    options = {"pairs": [(D, C)], "seed": 4, "n_boot": 300}
    units = {(r["scope"], r["metric"]): r for r in B.comparison_grid(recs, **options).collect()}
    cases = {(r["scope"], r["metric"]): r for r in B.comparison_grid(recs, cluster="case_id", **options).collect()}
    assert set(units) == set(cases) and all(units[k] == cases[k] for k in units if k[0] != "overall")
    wide, narrow = (r[("overall", "accuracy")] for r in (cases, units))
    assert wide["diff"] == narrow["diff"]
    assert wide["ci_high"] - wide["ci_low"] > 1.3 * (narrow["ci_high"] - narrow["ci_low"])


def test_draws_of_many_values_are_never_broadcast(spark):
    """The planner's size of the draws is that of the list of groups; the join with the blocks of values moves them by key."""
    held = spark.range(2000).selectExpr("'g' as g", "cast(id as double) as value", "1L as times", "2000L as n", "2000L as n_values")
    sums = B._means_of_many(held, ["g"], 3, 60, 500, 256)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    values = np.arange(2000.0)
    got = {r["replicate"]: r["s"] for r in sums.groupBy("replicate").agg(F.sum("part_sum").alias("s")).collect()}
    assert got == {b: values[B.draw_indexes(b, 2000, 3)].sum() for b in range(60)}

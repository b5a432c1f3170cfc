import hashlib
import math
import random
from collections import Counter

import pytest

from spanledger.operators import sampling as S


def _pool(spark, n=500, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((f"c{i:05d}", *("x" if rng.random() < p else None for p in (0.9, 0.7, 0.4))))
    return rows, spark.createDataFrame(rows, "case_id string, gold_T string, gold_N string, gold_M string")


def _key(seed, *ids):
    return hashlib.md5("|".join([str(seed), *ids]).encode()).hexdigest()


def _expected(rows, n, seed):
    """Largest remainder over patterns, then the first rows of every pattern in hash order."""
    pattern = {r[0]: "".join("0" if v is None else "1" for v in r[1:]) for r in rows}
    sizes = Counter(pattern.values())
    if n >= len(rows):
        return set(pattern)
    base = {s: size * n // len(rows) for s, size in sizes.items()}
    order = sorted(sizes, key=lambda s: (-(sizes[s] * n % len(rows)), -sizes[s], s))
    for s in order[:n - sum(base.values())]:
        base[s] += 1
    return {c for s in sizes for c in sorted((c for c in pattern if pattern[c] == s), key=lambda c: _key(seed, c))[:base[s]]}


@pytest.mark.parametrize("n", [1, 37, 200, 499, 500, 900])
def test_stratified_sample_against_brute_force(spark, n):
    rows, df = _pool(spark)
    got = [r["case_id"] for r in S.stratified_sample(df, n, 42).collect()]
    assert len(got) == len(set(got)) == min(n, 500)
    assert set(got) == _expected(rows, n, 42)


def test_sample_does_not_depend_on_order_or_partitions(spark):
    _, df = _pool(spark)
    a = {r["case_id"] for r in S.stratified_sample(df, 80, 1).collect()}
    b = {r["case_id"] for r in S.stratified_sample(df.orderBy("gold_M", "case_id").repartition(7), 80, 1).collect()}
    c = {r["case_id"] for r in S.stratified_sample(df, 80, 2).collect()}
    assert a == b != c


def test_one_stratum_that_holds_nearly_all_rows(spark):
    df = spark.range(6000).selectExpr("concat('c', id) as case_id", "if(id < 5900, 'x', null) as gold_T",
                                      "cast(null as string) as gold_N", "cast(null as string) as gold_M")
    for n, small in ((700, 12), (3000, 50)):
        got = {r["case_id"] for r in S.stratified_sample(df, n, 3).collect()}
        want = set(sorted((f"c{i}" for i in range(5900)), key=lambda c: _key(3, c))[:n - small])
        assert len(got) == n and want <= got


def test_summary(spark):
    rows, df = _pool(spark)
    row = S.sampling_summary(df, S.stratified_sample(df, 100, 42), 42).first()
    chosen = _expected(rows, 100, 42)
    picked = [r for r in rows if r[0] in chosen]
    assert row["total_reports"] == 500 and row["n_sampled"] == 100 and row["seed"] == 42
    assert row["n_with_M"] == sum(r[3] is not None for r in picked)
    assert row["n_with_all_TNM"] == sum(None not in r for r in picked)


def test_per_class_cells_and_uniform(spark):
    df = spark.range(300).selectExpr("concat('c', id) as case_id", "if(id < 10, 'rare', 'common') as kind")
    counts = Counter(r["kind"] for r in S.per_class_sample(df, "kind", 60, 5).collect())
    assert counts == {"rare": 10, "common": 30}
    quotas = (("rare", 4), ("common", 7), ("absent", 3))
    counts = Counter(r["kind"] for r in S.cell_sample(df, ["kind"], quotas, 5, ids=["case_id"]).collect())
    assert counts == {"rare": 4, "common": 7}
    ids = [r["case_id"] for r in df.collect()]
    for n in (25, 150, 400):
        got = {r["case_id"] for r in S.take_first(df.withColumn("k", S.draw_key(5, "case_id")), [], n, key="k").collect()}
        assert got == set(sorted(ids, key=lambda c: _key(5, c))[:n])
        assert got == {r["case_id"] for r in S.uniform_sample(df, n, 5, ids=["case_id"]).collect()}


def test_numbering_follows_the_key(spark):
    df = spark.range(500).selectExpr("cast(id as string) as id").withColumn("k", S.draw_key(1, "id"))
    rows = S.numbered(df, "k", "no").collect()
    assert sorted(r["no"] for r in rows) == list(range(1, 501))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["no"])] == [r["id"] for r in sorted(rows, key=lambda r: r["k"])]


def test_draw_keys_are_spread(spark):
    heads = Counter(r["h"] for r in spark.range(16000).select(S.draw_key(9, "id").substr(1, 1).alias("h")).collect())
    assert len(heads) == 16 and max(abs(c - 1000) for c in heads.values()) < 6 * math.sqrt(1000)


def test_rows_are_not_dealt_by_the_few_groups_of_a_sample(spark):
    """Dealt by group, all rows of a group would be read by one task; only narrow counts and one bucket's keys may move."""
    rows = spark.range(4000).selectExpr("id", "cast(id % 2 as string) as g", "md5(cast(id as string)) as k", "repeat('x', 500) as wide")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        taken = S.take_first(rows, ["g"], 30, key="k")
        plan = taken._jdf.queryExecution().executedPlan().toString()
        got = {(r["g"], r["id"]) for r in taken.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan
    first = {g: sorted((r["k"], r["id"]) for r in rows.filter(f"g = '{g}'").select("k", "id").collect())[:30] for g in "01"}
    assert got == {(g, i) for g, keys in first.items() for _, i in keys}

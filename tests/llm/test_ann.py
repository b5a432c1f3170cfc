import numpy as np

from llm import ann


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, cell int, score double")


def _exact(rows, queries, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in ok:
        if q in queries:
            scores = sorted((-float(np.dot(x, y)), i) for i, y in ok if i != q)
            out += [(q, n + 1, i) for n, (_, i) in enumerate(scores[:k])]
    return sorted(out)


def test_small_tables_are_exact_with_ties_and_odd_rows(llm_spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-4, 5, 6)]) for k in range(120)]
    rows = [(i, v if any(v) else [1.0] * 6) for i, v in rows]
    rows += [(200 + k, [3.0, 1.0, 0.0, 2.0, -1.0, 1.0]) for k in range(40)]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (320, [float("nan")] + [1.0] * 5),
             (340, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = _vectors(llm_spark, rows)
    got = ann.neighbours(df, df.where("vec_id % 20 = 0"), k=20, block=32)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == _exact(
        rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20)


def test_recall_without_clusters(llm_spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((6000, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = _vectors(llm_spark, [(k, x.tolist()) for k, x in enumerate(v)])
    got = ann.neighbours(df, df.where("vec_id % 40 = 0"), least=100, block=500).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert abs(r["score"] - float(v[r["query_id"]].astype(float) @ v[r["vec_id"]].astype(float))) < 1e-12
    hit = 0
    for q, ids in found.items():
        s = v[q].astype(float) @ v.T.astype(float)
        s[q] = -9
        assert len(ids) == 20
        hit += len(ids & set(np.argsort(-s)[:20].tolist()))
    assert len(found) == 150 and hit / (20 * 150) >= 0.9


def test_traversal_takes_the_nearest_cells_first():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random(5), rng.random(7)
        sizes = rng.integers(0, 4, (5, 7))
        reach, cells = ann.traverse(a, b, sizes, 20)
        total = (a[:, None] + b[None, :]).ravel()
        want = {int(c) for c in np.flatnonzero((total <= reach) & (sizes.ravel() > 0))}
        assert cells == want and sizes.ravel()[sorted(cells)].sum() >= min(20, sizes.sum())
    group, parts = ann.grouped(np.array([3, 0, 9, 2, 2, 30, 1]), 5)
    assert parts.tolist() == [1, 1, 2, 1, 1, 6, 1] and group.tolist()[0] != group.tolist()[2]


def test_few_or_no_vectors(llm_spark):
    df = _vectors(llm_spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])])
    assert [tuple(r)[:3] for r in ann.neighbours(df, df).orderBy("query_id").collect()] == [(0, 1, 1), (1, 1, 0)]
    assert ann.neighbours(df.limit(0), df.limit(0)).count() == 0
    assert ann.neighbours(_vectors(llm_spark, [(1, None)]), df).count() == 0

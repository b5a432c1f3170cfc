import random

from helpers import record, records

from spanledger import constants as K
from spanledger.operators import examples as X

ARMS = K.STUDY_ARMS


def _records(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        for t in "TNM":
            for a in ARMS:
                pred = rng.choice([f"{t}0", f"{t}1", "unknown"])
                span = rng.random() < 0.7
                rows.append(record(f"c{i:03d}", a, t, rng.choice([f"{t}0", f"{t}0", None]) if a == ARMS[0] else None, pred, span, span and rng.random() < 0.5))
    gold = {(r[0], r[2]): r[3] for r in rows if r[1] == ARMS[0]}
    return [record(r[0], r[1], r[2], gold[(r[0], r[2])], r[4], r[8] if r[8] is not None else True, r[9] if r[9] is not None else True) for r in rows]


def _tags(arms, target, gold):
    tags = set()
    for r in arms.values():
        correct, abstained, span, sem = r[6], r[7], r[8], r[9]
        if abstained:
            tags.add("abstained")
            continue
        if correct and span:
            tags.add("correct_grounded" if sem else "correct_unsupported")
        if not correct and sem:
            tags.add("wrong_grounded")
        if span and not sem:
            tags.add("span_not_supporting")
        if target == "M" and gold == "M0" and r[4] == "M0" and correct and not sem:
            tags.add("m0_unsupported")
    c, plus, d = (arms[a] for a in ARMS[1:])
    if d[7] != plus[7] or (not d[7] and (d[9] != plus[9] or d[4] != plus[4])):
        tags.add("evidence_binding_change")
    if not c[7] and d[7]:
        tags.add("c_asserts_d_abstains")
    return sorted(tags)


def _choose(tagged, default):
    """Greedy choice over all cases, tag by tag."""
    chosen = [default]
    for tag, quota in K.EXAMPLE_QUOTAS:
        pool = sorted((k for k, tags in tagged.items() if tag in tags and k not in chosen), key=lambda k: (k[1], k[0]))
        picked, seen = [], set()
        for k in pool:
            if len(picked) < quota and (k[1] not in seen or len(pool) <= quota):
                picked.append(k)
                seen.add(k[1])
        picked += [k for k in pool if k not in picked][:quota - len(picked)]
        chosen += picked
    return chosen


def test_tags_titles_and_greedy_choice(spark):
    titles = dict(K.EXAMPLE_TITLES)
    for n, seed in ((4, 1), (60, 2), (9, 3)):
        rows = _records(n, seed)
        groups = {}
        for r in rows:
            groups.setdefault((r[0], r[2]), {})[r[1]] = r
        expected = {k: _tags(v, k[1], v[ARMS[0]][3]) for k, v in groups.items()}
        tagged = X.tagged_cases(records(spark, rows + [record("incomplete", ARMS[0], "T")]))
        got = {(r["case_id"], r["target"]): r for r in tagged.collect()}
        assert {k: r["tags"] for k, r in got.items()} == expected
        for k, r in got.items():
            assert r["title"] == next((titles[t] for t, _ in K.EXAMPLE_TITLES if t in expected[k]), "Ablation example")
        chosen = X.curated_examples(tagged, ("c001", "M")).orderBy("position").collect()
        assert [(r["case_id"], r["target"]) for r in chosen] == _choose(expected, ("c001", "M"))
        assert chosen[0]["id"] == "case-00" and chosen[1]["display_id"] == "Case 02"


def test_examples_carry_scrubbed_reports_and_need_one(spark):
    rows = _records(40, 3)  # more cases than the candidates kept per tag and target
    cases = sorted({r[0] for r in rows})
    reports = spark.createDataFrame([(c, f"{c} seen by Dr. Brown" if i % 3 else None) for i, c in enumerate(cases)], "case_id string, text string")
    tagged = X.tagged_cases(records(spark, rows))
    got = X.curated_examples(tagged, reports=reports).collect()
    assert got and all(r["report"] == f"{r['case_id']} seen by [redacted]" for r in got)
    with_text = {c for i, c in enumerate(cases) if i % 3}
    same = X.curated_examples(tagged.filter(tagged["case_id"].isin(*with_text))).collect()
    assert {(r["position"], r["case_id"], r["target"]) for r in got} == {(r["position"], r["case_id"], r["target"]) for r in same}

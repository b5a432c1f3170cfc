import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _plain(docs, items, top=20):
    """docs, items: (id, text)."""
    read = [(i, Counter(_terms(t))) for i, t in docs]
    read = [(i, c, sum(c.values())) for i, c in read if c]
    n, total = len(read), sum(x for _, _, x in read)
    df = Counter(t for _, c, _ in read for t in c)
    found = []
    for item, text in items:
        asked = Counter(_terms(text))
        rows = []
        for i, c, length in read:
            m = 100 - 25 + 25 * length * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, times in asked.items() if t in c)
            if score > 0:
                rows.append((-score, (i is not None, i or 0), i))
        found += [(item, k + 1, i, -score) for k, (score, _, i) in enumerate(sorted(rows)[:top])]
    return found


def _docs(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)] + ["É", "é", "straße", "ſ", "ABC", "x1"]
    rows = []
    for i in range(n):
        text = rng.choice([" ", ", ", "-", "_"]).join(rng.choices(words, k=rng.choice([0, 1, 5, 30, 200])))
        rows.append((i * 3, text))
    rows += [(7, None), (8, ""), (9, "... --- "), (10, "w1 " * 30_000 + "tail"), (11, rows[0][1]), (11, rows[0][1]), (None, "w2 w3 w2 straße")]
    return rows


def _listed(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(("seeds", "items_in_block"), [(20, 1024), (64, 7)])
def test_ranks_are_those_of_brute_force(llm_spark, make_docs, monkeypatch, seeds, items_in_block):
    monkeypatch.setattr(ranked_search, "ITEMS", items_in_block)
    rows = _docs(300)
    asked = [(k, text) for k, (_, text) in enumerate(_docs(25, seed=2))] + [(1000, "w1 w1 w2 straße É"), (1001, None), (1002, "nowhere"), (1002, "w5 x1")]
    items = llm_spark.createDataFrame([(i, t, 5, 9) for i, t in asked], "item_id long, text string, key int, part int")
    docs = make_docs(rows)
    got = _listed(ranked_search.search(docs, ranked_search.build(docs), items, seeds=seeds))
    assert got == sorted(_plain(rows, asked), key=str)


def test_bounds_are_never_below_the_scores(llm_spark, make_docs, monkeypatch):
    monkeypatch.setattr(ranked_search, "WIDEST", 256)  # signatures of long documents overflow: bounds get loose, not wrong
    rows = [r for r in _docs(120) if _terms(r[1])]
    blocks = [b for b in ranked_search._built(iter([__import__("pyarrow").record_batch(
        {"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})])) for b in b.to_pylist() if b["kind"] == "block"]
    assert sum(len(b["doc_ids"]) for b in blocks) == len(rows)
    words = sorted({w.encode() for _, t in rows for w in _terms(t)})[:80]
    parts = [(np.arange(k, k + 20), np.arange(20) + 1) for k in range(0, 60, 20)]
    items = ranked_search._Items(len(rows), sum(len(_terms(t)) for _, t in rows), [0, 1, 2], words, np.ones(len(words)), parts)
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    for block in blocks:
        for k, bound in items.bounds(block):
            for d, most in zip(block["doc_ids"], bound.tolist(), strict=True):
                assert dict(items.scores(text[d], [k])).get(k, 0) <= most


def test_empty_tables_and_ties(llm_spark, make_docs):
    items = llm_spark.createDataFrame([(1, "same words")], "item_id long, text string")
    none = make_docs([])
    assert ranked_search.search(none, ranked_search.build(none), items).count() == 0
    docs = make_docs([(k, "same words here") for k in range(40)] + [(99, "other")])
    index = ranked_search.build(docs)
    assert [r["doc_id"] for r in ranked_search.search(docs, index, items).orderBy("rank").collect()] == list(range(20))
    assert ranked_search.search(docs, index, items.where("item_id > 1")).count() == 0

import random

import numpy as np
import pytest

from llm import minhash, near, simhash


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def plain_links(rows):
    """rows: {doc_id: text}; the linked ids of each."""
    sets = {i: plain_set(t) for i, t in rows.items()}
    return {i: {j: v for j in sets if j != i and (v := plain_jaccard(sets[i], sets[j])) >= 0.8} for i in sets}


def plain_classes(links):
    out = {}
    for i in sorted(links):
        if i not in out:
            front = [i]
            out[i] = i
            while front:
                for j in links[front.pop()]:
                    if j not in out:
                        out[j] = i
                        front.append(j)
    return out


def words_of(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**6)}"
    return words


def check(got, rows):
    links = plain_links(rows)
    classes = plain_classes(links)
    assert set(got) == set(rows)
    for i, r in got.items():
        before = min((j for j in links[i] if j < i), default=None)
        assert (r["class_id"], r["n_links"], r["copy_of"]) == (classes[i], len(links[i]), before), i
        assert r["jaccard"] is None if before is None else abs(r["jaccard"] - links[i][before]) < 1e-9


def test_near_copies_match_all_pairs(make_docs):
    rng = random.Random(5)
    rows = []
    for _ in range(25):
        base = words_of(rng, 120)
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows) * 3 % 1000, " ".join(changed(rng, base, rng.choice([0, 0, 1, 2, 3])))))
    rows += [(2900, None), (2901, " \n"), (2902, "one two"), (2903, "ONE two"), (2904, "alone it is"), (2905, "one two three")]
    extra = [(None, "one two"), (None, None)]
    got = {r["doc_id"]: r for r in near.near_copies(make_docs(rows + extra).repartition(5)).collect()}
    check(got, dict(rows))


def test_pairs_in_a_crowd_of_less_similar_ones(make_docs):
    """Twenty pairs of likeness 0.9 and more, each behind forty earlier documents that share much with it."""
    rng = random.Random(8)
    rows = []
    for _ in range(20):
        base = words_of(rng, 200)
        rows += [(len(rows) + k, " ".join(changed(rng, base, 8))) for k in range(40)]
        pair = changed(rng, base, 6)
        rows += [(len(rows), " ".join(pair))]
        rows += [(len(rows), " ".join(changed(rng, pair, 1)))]
    got = {r["doc_id"]: r for r in near.near_copies(make_docs(rows)).collect()}
    check(got, dict(rows))


def test_large_families_are_dealt_in_blocks(make_docs):
    """Blocks of seven texts give the same links as all pairs at once, each counted once."""
    rng = random.Random(9)
    base = words_of(rng, 150)
    rows = [(k, " ".join(changed(rng, base, rng.randint(0, 5)))) for k in range(60)]
    docs = make_docs(rows)
    links = plain_links(dict(rows))
    _, nodes = near.classes(docs, members=7)
    for r in nodes.collect():
        assert r["links"] + r["weight"] - 1 == len(links[r["least"]])


def test_large_buckets_are_dealt_in_blocks(llm_spark, make_docs):
    rng = random.Random(10)
    base = words_of(rng, 200)
    docs = make_docs([(k, " ".join(changed(rng, base, 1))) for k in range(90)])
    nodes = near.prints(docs).dropDuplicates(["node"]).cache()
    links = near.band_links(nodes, block=11).collect()
    left = {r["node"]: r["node"] for r in nodes.collect()}

    def root(n):
        while left[n] != n:
            n = left[n]
        return n

    for a, b in links:
        left[root(a)] = root(b)
    assert len(left) > 80 and len({root(n) for n in left}) == 1


@pytest.mark.parametrize("changes", [6, 4, 2, 1])
def test_recall_by_likeness(make_docs, changes):
    """One of each pair goes if, and only if, the likeness is 0.8 or more: 300 words with some of them changed."""
    rng = random.Random(changes)
    rows = []
    for k in range(150):
        base = words_of(rng, 300)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed(rng, base, changes)))]
    texts = dict(rows)
    kept = {r["doc_id"] for r in near.keep_one(make_docs(rows)).collect()}
    for k in range(150):
        alike = plain_jaccard(plain_set(texts[2 * k]), plain_set(texts[2 * k + 1])) >= 0.8
        assert 2 * k in kept and (2 * k + 1 in kept) == (not alike)


def test_keep_one_keeps_columns_and_rows_without_id(make_docs):
    rng = random.Random(3)
    long = " ".join(words_of(rng, 30_000))
    text = " ".join(words_of(rng, 80))
    rows = [(None, text), (None, "nobody knows it"), (None, "nobody knows it"), (4, text), (4, text), (9, text.upper()), (5, None), (6, ""),
            (10, long), (11, long + " end"), (12, " ".join(words_of(rng, 80)))]
    docs = make_docs(rows)
    out = near.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 4, 5, 10, 12]
    assert near.keep_one(make_docs([])).count() == 0
    assert near.near_copies(make_docs([])).count() == 0


def test_lower_thresholds_are_refused(make_docs):
    with pytest.raises(ValueError):
        near.classes(make_docs([]), 0.7)


def test_fingerprint_and_compare():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**64, 7, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > 7)
    assert near.majority(hashes) == want and near.majority(hashes[:0]) == 0
    sets = [np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    links, first, likeness, label = near.compare(sets, np.array([1, 5, 1, 1]), np.full(4, -1), 0.8)
    assert links.tolist() == [6, 1, 1, 0]
    assert first.tolist()[0] == -1 and label.tolist() == [0, 0, 0, 3] and likeness[1] == 9 / 11
    links, *_ = near.compare(sets, np.ones(4, np.int64), np.zeros(4, np.int64), 0.8)
    assert not links.any()
    assert simhash.fingerprint("") == 0 and len(minhash.signature("")) == minhash.LANES

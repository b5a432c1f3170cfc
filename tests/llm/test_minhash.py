import hashlib
import random

import numpy as np

from llm import minhash


def _plain_jaccard(a, b):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_follow_the_next_document(llm_spark, make_docs):
    rng = random.Random(1)
    atoms = ["a", "bc", "Dé", " ", " ", "\n", "xyz", " . ", "　", "word "]
    rows = [(k * 7 % 1009 - 300, "".join(rng.choice(atoms) for _ in range(rng.choice([0, 5, 60, 400])))) for k in range(150)]
    rows += [(5000, None), (5001, ""), (5002, "x " * 40_000)]
    got = {r["doc_id"]: r for r in minhash.edit_fingerprints(make_docs(rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    order = sorted((i, t or "") for i, t in rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t)
        edited = t[:n - n // 2] + following[:n // 2]
        own, changed, after = (minhash.signature(x) for x in (t, edited, following))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (minhash._hex(own), minhash._hex(changed))
        assert r["near_edited"] == minhash.likeness(own, changed) and r["near_next"] == minhash.likeness(own, after)


def test_rows_without_id_and_repeated_rows(make_docs):
    rows = [(None, "first of all"), (3, "b b b"), (3, "b b b"), (9, "last one")]
    got = sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in minhash.edit_fingerprints(make_docs(rows)).collect())
    texts = ["first of all", "b b b", "b b b", "last one"]
    want = []
    for k, (i, t) in enumerate(rows):
        following = texts[(k + 1) % 4]
        want.append((i or -1, len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + following[:len(t) // 2]).encode()).hexdigest()))
    assert got == sorted(want)


def test_one_document_follows_itself_and_empty_table(make_docs):
    got = minhash.edit_fingerprints(make_docs([(1, "abcd")])).collect()
    assert len(got) == 1 and got[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and got[0]["near_next"] == 1.0
    assert minhash.edit_fingerprints(make_docs([])).count() == 0


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(5000)]
    errors = []
    for _ in range(60):
        a = [rng.choice(words) for _ in range(300)]
        b = a[:rng.randint(0, 300)]
        b += [rng.choice(words) for _ in range(300 - len(b))]
        x, y = " ".join(a), " ".join(b)
        errors.append(minhash.likeness(minhash.signature(x), minhash.signature(y)) - _plain_jaccard(x, y))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.2

import random

import numpy as np
import xxhash

from llm import simhash
from llm.components import components


def _plain(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    runs = [words[i:i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(rows, bits=4):
    prints = [_plain(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [i for n, (i, _) in enumerate(rows) if root(n) == root(k) and i is not None]
        out.append((doc_id, f"{prints[k]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def _texts(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 200]))]
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    rng.shuffle(rows)
    out = [(k * 3, " ".join(r)) for k, r in enumerate(rows)]
    return out + [(5000, ""), (4000, None), (4001, " \t\n"), (4002, "One"), (4003, "oNE"), (4003, "oNE"), (None, "one"),
                  (None, "quite alone here it is"), (6000, "É é A"), (6001, "É é a"), (6002, "x " * 30_000)]


def test_components_match_all_pairs(llm_spark, make_docs):
    rows = _texts()
    got = simhash.near_duplicates(make_docs(rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == _classes(rows)


def test_groups_above_the_block_lose_no_link(llm_spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**63))
    prints = {centre}
    while len(prints) < 300:  # a dense ball, and a chain that leaves it
        prints.add(centre ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    chain = centre
    for b in range(0, 48, 4):
        chain ^= 0b1111 << b
        prints.add(chain)
    prints |= {int(x) for x in rng.integers(0, 2**63, 300)}
    prints = np.array(sorted(prints), np.uint64)
    df = llm_spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "simhash long")
    links = simhash.links(df, 4, block=16)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4):
            parent[root(i)] = root(int(j))
    want = {}
    for k, x in enumerate(prints.view(np.int64).tolist()):
        want.setdefault(root(k), set()).add(x)
    got = {}
    for x in prints.view(np.int64).tolist():
        got.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_keys_meet_for_every_pattern_of_four_bits():
    golay, rng = simhash.Golay(), np.random.default_rng(5)
    base = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    other = base.copy()
    for k in range(len(other)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            other[k] ^= np.uint64(1) << np.uint64(b)
    sets = []
    for prints in (base, other):
        keys, rows = simhash.keyed(prints, golay)
        sets.append([set() for _ in prints])
        for k, r in zip(keys.tolist(), rows.tolist(), strict=True):
            sets[-1][r].add(k)
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_one_row_of_each_component_stays(llm_spark, make_docs):
    rows = _texts(2, 20)
    docs = make_docs(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want, seen = [], set()
    for (doc_id, _), (_, _, component) in zip(sorted(rows, key=str), sorted(_classes(rows), key=str), strict=True):
        if doc_id is not None and doc_id == component and doc_id not in seen:
            want.append(doc_id)
            seen.add(doc_id)
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want)
    assert got.count(None) == 1  # the one that no row with an id is near to


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.keep_one(make_docs([])).count() == 0

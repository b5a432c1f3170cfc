import random
import re
from collections import Counter

import pytest

from llm import collocations

LOWER = {k: k + 32 for k in range(65, 91)}


def _plain(rows, least=10, top=2000):
    """rows: (lang, text)."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        longer = Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        rows = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and 100 * longer[p] < 50 * a:
                score, cut = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[p[:cut]], f[p[cut:]]))
        found += [(lang, k + 1, p, a, left, right, totals[lang], -score)
                  for k, (score, _, _, p, a, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(found)


def _rows():
    rng = random.Random(4)
    words = ["the", "The", "of", "ÉT", "ét", "a\x1cb", "\x01", "-", "#x", *(f"w{k}" for k in range(12))]
    rows = []
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice([" "] * 8 + ["\t ", ", ", ".", "\n", "\x0b", "!?"]) for _ in range(rng.choice([0, 1, 3, 40])))
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return [*rows, ("en", None), (None, ""), ("xx", "one two three"), ("en", "new york city " * 3000), ("en", "new york city " * 3000)]


@pytest.mark.parametrize("chunk", [1 << 24, 1 << 9])
def test_phrases_are_those_of_brute_force(llm_spark, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "_CHUNK", chunk)
    rows = _rows()
    schema = "lang string, text string, phrase int, f int, part int, w1 string"
    docs = llm_spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], schema).repartition(3)
    got = sorted(map(tuple, collocations.collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == _plain(rows)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_windows_of_more_words_than_fit_a_number(monkeypatch):
    text = " ".join(f"{a}x {b}y." for a in range(60) for b in range(60))
    whole = [b.to_pylist() for b in collocations.window_counts("en", collocations._prepared(text), [b"30x", b"30x 5y"])]
    monkeypatch.setattr(collocations, "_KINDS", 0)
    again = [b.to_pylist() for b in collocations.window_counts("en", collocations._prepared(text), [b"30x", b"30x 5y"])]
    assert again == whole and sum(r["f"] for b in whole for r in b) == 7200


def test_counts_of_all_lengths_come_from_the_longest_windows(llm_spark):
    docs = llm_spark.createDataFrame([("en", "a b a b. a b, c"), ("en", "a b")], "lang string, text string")
    got = {(r["words"], r["phrase"]): r["f"] for r in collocations.phrase_counts(docs, 1).collect()}
    assert got == {(0, ""): 9, (1, "a"): 4, (1, "b"): 4, (1, "c"): 1, (2, "a b"): 4, (2, "b a"): 1, (3, "a b a"): 1, (3, "b a b"): 1}


def test_scores_beyond_64_bits(llm_spark):
    exact = llm_spark.sql("SELECT (cast(1000000 AS decimal(7, 0)) * (cast(a AS decimal(19, 0)) * cast(a AS decimal(19, 0)))) div "
                          "(cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0))) AS s FROM VALUES (900000000000L, 1000000000001L, 950000000003L) t(a, l, r)")
    assert exact.first()["s"] == 10**6 * 900000000000**2 // (1000000000001 * 950000000003)


def test_rare_pairs_that_no_border_cuts_stay_in_their_range(llm_spark):
    rng = random.Random(5)
    text = "".join(f"{rng.choice('abcd')} w{rng.randrange(400)} z. " for _ in range(4000))
    docs = llm_spark.createDataFrame([("en", text), ("de", text)], "lang string, text string").repartition(2)
    limits = [b"a w5 z", b"a w7", b"b", b"w1 z"]
    dealt = docs.mapInArrow(lambda batches: collocations._counted(batches, limits), collocations.WINDOWS).repartition("part")
    found = collocations.leads(dealt, limits, 10).collect()
    pairs = {(r["lang"], r["w1"], r["w2"]) for r in found if r["w2"] is not None}
    counts = Counter(re.findall(r"[abcd] w\d+", text)) + Counter(re.findall(r"w\d+ z", text))
    wanted = {p for p, f in counts.items() if f >= 10} | {"a w5", "a w7", "w1 z"} & set(counts)
    assert pairs == {(lang, *p.split()) for lang in ("en", "de") for p in wanted} and len(wanted) < len(counts) / 2
    words = Counter()
    for r in found:
        words[r["lang"], r["w1"]] += r["f"]
    assert words == Counter({(lang, w): n for lang in ("en", "de") for w, n in Counter(text.replace(".", "").split()).items()})

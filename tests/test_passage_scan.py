import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from spanledger.functions import search
from spanledger.operators import passages
from spanledger.operators.passages import find_passages


def _found(*args, **kw):
    return sorted(map(tuple, find_passages(*args, **kw).collect()), key=str)


def _tables(spark):
    rng = random.Random(5)
    words = ["an", "banana", "cab", "é", "tumor", "tumors", "of", "x"]
    reports = [(f"c{k}", " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(60)]
    reports += [("twice", "an an. tumor"), ("twice", "an an. tumor"), ("none", None), (None, "cab of x")]
    cuts = []
    for k in range(200):
        text = rng.choice(reports[:60])[1]
        a = rng.randint(0, len(text))
        cuts.append((k, text[a:a + rng.choice([1, 2, 5, 9, 20, 60, 150])]))
    return (spark.createDataFrame(cuts, "passage_id long, text string"),
            spark.createDataFrame(reports, "case_id string, text string"))


def test_passages_that_a_task_holds_move_no_text_and_no_word(spark):
    """Before, all words of the reports, and the reports of every candidate, were shuffled, and their forms written."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    found = find_passages(*_tables(spark))
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["passages"]


@pytest.mark.parametrize("rows", [100_000, 1])
def test_one_pass_finds_what_the_words_find(spark, monkeypatch, rows):
    monkeypatch.setattr(passages, "ROWS", rows)
    asked, reports = _tables(spark)
    found = _found(asked, reports)
    assert len(found) > 500 and found == _found(asked, reports, scanned=0) == _found(asked, reports, scanned=0, part=7)


def test_repeated_and_null_passages_as_by_words(spark):
    reports = spark.createDataFrame([("a", "an an banana of"), ("b", "of an x"), (None, "an of")], "case_id string, text string")
    asked = spark.createDataFrame([(1, "an"), (1, "an"), (1, "x"), (2, "of an"), (2, "of an"), (3, "n o"), (None, "of"), (None, "an of"),
                                   (4, " ."), (5, None)], "passage_id long, text string")
    found = _found(asked, reports)
    assert found == _found(asked, reports, scanned=0)
    assert found.count((1, "b")) == 1 and found.count((2, "b")) == 2 and found.count((None, None)) == 1


def test_only_sets_that_fit_are_scanned(spark):
    asked, reports = _tables(spark)
    one = asked.limit(1)
    assert "MapInArrow" in find_passages(one, reports)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in find_passages(one, reports, scanned=passages.EACH)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", [1, 13, 1 << 16])
def test_search_as_brute_force(monkeypatch, piece):
    """Strings of all widths, also with the same beginning, NUL bytes, and texts that end inside a string."""
    monkeypatch.setattr(search, "PIECE", piece)
    rng = random.Random(piece)
    for letters in (b"a", b"ab", b"a\0\xff", bytes(range(256))):
        texts = [bytes(rng.choices(letters, k=k)) for k in (0, 1, 7, 0, 40, 700, 0)]
        strings = {bytes(rng.choices(letters, k=rng.randint(1, 3))) for _ in range(20)}
        for k in (1, 2, 7, 8, 9, 15, 16, 17, 40, 300, 600):
            at = rng.randint(0, 100)
            strings |= {texts[5][at:at + k], texts[5][at:at + k] + b"a", texts[4][-k:] + b"a"}
        strings = sorted(strings)
        found = search.Sought(*search.packed(pa.array(strings))).find(*search.packed(pa.array(texts)))
        assert list(zip(*map(np.ndarray.tolist, found), strict=True)) == [(i, j) for i, t in enumerate(texts) for j, s in enumerate(strings) if s in t]


def test_search_for_nothing_and_in_nothing():
    none = search.packed(pa.array([], pa.binary()))
    some = search.packed(pa.array([b"", b"of", b"an"])[1:])
    assert [len(x) for x in search.Sought(*none).find(*some)] == [len(x) for x in search.Sought(*some).find(*none)] == [0, 0]
    assert [x.tolist() for x in search.Sought(*some).find(*some)] == [[0, 1], [0, 1]]

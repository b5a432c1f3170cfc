import random

import pytest

from spanledger.operators import passages
from spanledger.operators.passages import find_passages

WORDS = ["tumor", "tumors", "of", "the", "node", "nodes", "pT2", "margin", "a", "free", "É", "x.y"]


def _form(text):
    for c in "., \t\n":
        text = text.replace(c, " ")
    return " ".join(text.lower().split())


def _plain(passages, reports):
    return sorted((p, c) for p, t in passages if t and _form(t) for c, r in reports if r and _form(t) in _form(r))


@pytest.mark.parametrize("part", [10_000, 7])
def test_all_pairs_that_brute_force_finds(spark, part):
    rng = random.Random(11)
    reports = [(f"c{k}", rng.choice([" ", ", ", ".\n"]).join(rng.choices(WORDS, k=rng.randint(0, 12)))) for k in range(120)]
    reports += [("same", "the node"), ("same", "the node"), ("none", None)]
    cuts = []
    for k in range(150):
        text = rng.choice(reports[:120])[1]
        a = rng.randint(0, max(0, len(text) - 1))
        cuts.append((k, text[a:a + rng.randint(1, 25)]))
    cuts += [(900, None), (901, " .,"), (902, "nowhere in any of it"), (903, "the unknownword node"), (904, "umo"), (905, "e n")]
    got = find_passages(spark.createDataFrame(cuts, "passage_id long, text string"),
                        spark.createDataFrame(reports, "case_id string, text string"), part=part)
    assert sorted(map(tuple, got.collect())) == _plain(cuts, reports)


def test_no_join_without_a_key(spark):
    one = spark.createDataFrame([(1, "one two three four")], "passage_id long, text string")
    plan = find_passages(one, spark.createDataFrame([("c", "one two three four")], "case_id string, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_empty_tables(spark):
    none = spark.createDataFrame([], "passage_id long, text string")
    reports = spark.createDataFrame([("c", "some text")], "case_id string, text string")
    assert find_passages(none, reports).count() == 0
    one = spark.createDataFrame([(1, "some text")], "passage_id long, text string")
    assert find_passages(one, reports.limit(0)).count() == 0


def test_affixes_of_words_are_not_dealt_and_one_word_needs_no_text(spark):
    """All letters of a word come from its own row; words of the vocabulary with all their affixes never move to be made distinct."""
    counts = spark.createDataFrame([("banana", 3), ("an", 2), ("cab", 1)], "word string, n_reports long")
    asked = spark.createDataFrame([(1, ["an"]), (2, ["nana", "x"]), (3, ["q"])], "passage_id long, words array<string>")
    around = passages._words_around(asked, counts)
    assert sorted(map(tuple, around.collect())) == [(1, "an", 2, True), (1, "banana", 3, True), (2, "banana", 3, False)]
    assert "hashpartitioning(word" not in around._jdf.queryExecution().executedPlan().toString()


def test_reports_that_share_a_case_are_searched_apart_for_one_word_too(spark):
    reports = spark.createDataFrame([("a", "bananas x"), ("a", "an an anb"), ("a", "none"), ("b", "ban")], "case_id string, text string")
    asked = spark.createDataFrame([(1, "an"), (2, "s x")], "passage_id long, text string")
    found = sorted(map(tuple, passages.find_passages(asked, reports).collect()))
    assert found == [(1, "a"), (1, "a"), (1, "b"), (2, "a")]

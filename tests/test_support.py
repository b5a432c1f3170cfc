"""Evidence rules: own sentences, one rule each, with hand-worked expectations."""

from helpers import col, column

from spanledger.functions import support as S


def _support(spark, rows):
    return column(spark, rows, S.semantic_support(col("p"), col("e"), col("t")), "p string, e string, t string")


def test_named_stage_decides_first(spark):
    rows = [("T4", "staged pT4 on review", "T"), ("N3", "call it n3", "N"), ("M0", "PM0 as before", "M"),
            ("T4", "staged pT3 on review", "T"), ("N2", "T2N2 without a gap", "N"), ("T2", "T2N2 without a gap", "T"),
            ("N1", "the quote names N1", "T"), ("T3", "attempt3", "T")]
    assert _support(spark, rows) == [True, True, True, False, False, True, True, False]


def test_lymph_nodes_by_count_and_word(spark):
    texts = ["sentinel node: 0 out of 5", "lymph nodes 00/19", "lymphnode 4 of 9", "3/8 in the lymph nodes, none elsewhere",
             "lymph node: nothing, none at all", "the sentinel lymph node is positive", "lymph nodes sampled", "nodules 2/3", None]
    assert column(spark, texts, S.node_status(col("v"))) == [
        "negative", "negative", "positive", "positive", "negative", "positive", None, None, None]
    rows = [("N0", texts[0], "N"), ("N1", texts[0], "N"), ("N1", texts[2], "N"), ("N2", texts[2], "N"), ("N1", texts[2], "T"),
            ("M1", texts[5], "M"), ("N0", texts[6], "N")]
    assert _support(spark, rows) == [True, False, True, False, False, False, False]


def test_count_must_lie_in_the_window_whole(spark):
    # "lymph nodes" ends at 11 and the window at 61: what is left of the count there must still be one, as 5/1 is
    texts = ["lymph nodes" + "." * gap + "5/12" for gap in (45, 46, 47, 48, 49, 50)]
    assert column(spark, texts, S.node_status(col("v"))) == ["positive"] * 3 + [None] * 3
    # before the anchor 50 characters count: "0/33" and the gap must be within them
    texts = ["0/33" + "." * gap + "lymph node" for gap in (45, 46, 47, 49)]
    assert column(spark, texts, S.node_status(col("v"))) == ["negative", "negative", None, None]
    # the letters é are characters, not bytes
    assert column(spark, ["lymph node" + "é" * 40 + " positive", "lymph node" + "é" * 43 + " positive"], S.node_status(col("v"))) == ["positive", None]


def test_local_invasion_needs_a_verb_a_structure_and_no_negation(spark):
    texts = ["it invades the serosa", "it invades the lumen", "the serosa is intact", "never invades; not so: invades serosa",
             "does not invade, later invades serosa", "", None]
    assert column(spark, texts, S.local_invasion(col("v"))) == [True, False, False, True, False, False, None]
    # a negation counts within 20 characters before the verb: "without" takes 7 of them
    texts = ["without" + "." * gap + "invades serosa" for gap in (1, 12, 13, 14, 30)]
    assert column(spark, texts, S.local_invasion(col("v"))) == [False, False, False, True, True]
    rows = [(p, "it invades the serosa", t) for p, t in (("T1", "T"), ("T2", "T"), ("T4", "T"), ("T0", "T"), ("N1", "N"), ("T2", "N"))]
    assert _support(spark, rows) == [False, True, True, False, False, False]


def test_distant_metastasis(spark):
    texts = ["a distant metastasis in the spine", "none seen: distant metastases", "metastasis nearby", None]
    assert column(spark, texts, S.distant_metastasis(col("v"))) == ["positive", "negative", None, None]
    # "none" counts within 30 characters before the phrase
    texts = ["none" + "." * gap + "distant metastasis" for gap in (5, 26, 27, 40)]
    assert column(spark, texts, S.distant_metastasis(col("v"))) == ["negative", "negative", "positive", "positive"]
    rows = [("M1", "a distant metastasis in the spine", "M"), ("M0", "none seen: distant metastases", "M"), ("M0", "metastasis nearby", "M"),
            ("M1", "a distant metastasis in the spine", "N")]
    assert _support(spark, rows) == [True, True, False, False]


def test_nothing_supports_no_answer_or_no_quote(spark):
    rows = [("unknown", "0 of 4 lymph nodes", "N"), ("INVALID", "0 of 4 lymph nodes", "N"), ("N0", None, "N"), ("N0", "", "N"),
            (None, "pT2", "T"), ("T2", "weighs 31 g", "T"), ("M0", "sections are clean", "M")]
    assert _support(spark, rows) == [False] * 7


def test_categories(spark):
    rows = [("T3", "grows to 4.5 cm"), ("T3", "T3; 0/6 lymph nodes; invades serosa"), ("N1", "6/6 lymph nodes"), ("M1", "distant metastasis"),
            ("M0", "no distant metastasis"), ("M0", "a plain remark"), ("M0", ""), ("M0", None)]
    assert column(spark, rows, S.evidence_categories(col("e"), col("p")), "p string, e string") == [
        ["tumor_size"], ["explicit_stage_token", "local_invasion", "regional_node_negative"], ["regional_node_positive"],
        ["distant_metastasis_positive"], ["distant_metastasis_negative"], ["unknown"], [], []]

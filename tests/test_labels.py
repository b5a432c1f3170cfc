import random
import re

import pytest
from helpers import col, column
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions import labels as L
from spanledger.functions import text as X

def test_canonical_form_is_the_letter_and_what_decides(spark):
    """P, white space and everything behind the first digit go; X stands alone; the rest is no stage."""
    same = [f"{t}{c}" for t in "TNM" for c in "01234X"]
    assert column(spark, same, L.canonicalize(col("v"))) == same
    folded = {"n3c": "N3", "  PM1\t": "M1", "p T1": None, "T10": "T1", "m0(i-)": "M0", "tx": "TX", "pNx": "NX", "T1-2": "T1",
              "NXx": None, "MX0": None, "ppN1": None, "cT3": None, "Q2": None, "T": None, " ": None, "T1\nN0": None, "2T": None}
    assert column(spark, list(folded), L.canonicalize(col("v"))) == list(folded.values())


def test_norm_pred(spark):
    raw = [None, "unknown", " Unknown ", "UNKNOWN\n", "pT3", "garbage", "", "nx"]
    assert column(spark, raw, L.norm_pred(col("v"))) == [
        "unknown", "unknown", "unknown", "unknown", "T3", "INVALID", "INVALID", "NX"]


def test_bad_gold_fails_in_strict_mode_and_is_quarantined_otherwise(spark):
    with pytest.raises(Exception, match="not a stage"):
        column(spark, ["T2", "Tis"], L.canonical_gold(col("v")))
    assert column(spark, ["T2", "Tis", None], L.canonical_gold(col("v"), strict=False)) == ["T2", None, None]
    assert column(spark, ["T2", "Tis", None], L.bad_gold(col("v"))) == [None, "Tis", None]


def test_value_supported_by_text(spark):
    """A token of the value's letter, at the start of a word; what follows the deciding character is free."""
    yes = [("T2", "pT2"), ("T2", "see t2c."), ("N1", "(n1)"), ("M0", "M0, later"), ("TX", "TX"), ("NX", "pNX."), ("T2", "pT2N0M0"), ("T1", "-T1"),
           ("T4", "T4bN2"), ("N0", "é N0"), ("M1", "M1_a")]
    no = [("N0", "pT2N0M0"), ("M0", "pT2N0M0"), ("TX", "TXN0"), ("T2", "aT2"), ("T2", "éT2"), ("T2", "_T2"), ("T2", "ppT2"), ("T2", "T 2"),
          ("T3", "T2 T1"), ("T1", ""), ("T1", None), ("unknown", "unknown"), ("INVALID", "INVALID T1"), ("T9", "T9"), ("NX", "NX1")]
    got = column(spark, yes + no, L.value_supported_by_text(col("v"), col("t")), "v string, t string")
    assert got == [True] * len(yes) + [False] * len(no)


def test_text_supports_gold_knows_the_same_suffixes_for_all_letters(spark):
    rows = [(f"{t}{c}", f"as {t}{c} says") for t in "TNM" for c in "01234X"] + [("M3", "as M4 says"), ("T2", "at2"), ("N4", None)]
    got = column(spark, rows, L.text_supports_gold(col("v"), col("t")), "v string, t string")
    assert got == [True] * 18 + [False] * 3


def _form(s):
    return re.sub(r"\s+", " ", re.sub(r"[.,]", " ", s.lower())).strip()


def test_grounding(spark):
    text = "Section A, grey-white.\n  Cut surface:  firm; \tno cyst."
    cases = {"grey-white": True, "section a grey-WHITE": True, "White. Cut, surface:": True, "firm; no": True, "firm no": False, "cysts": False,
             "": False, " .,\n": False, None: False}
    assert column(spark, list(cases), X.grounded(col("v"), F.lit(text))) == list(cases.values())
    assert column(spark, [text], X.matching_form(col("v"))) == ["section a grey-white cut surface: firm; no cyst"]


def test_span_location_matches_normalised_search(spark):
    rng = random.Random(9)
    alphabet = ["ab", "b.c", " ", ",", "\n", "Q(", "*", "é", "\U0001f600", "ab "]
    rows = []
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))
        at = rng.randrange(len(text))
        rows.append((text, text[at:at + rng.randint(1, 6)].upper() if rng.random() < 0.8 else "zz top"))
    got = column(spark, rows, X.locate_span(col("t"), col("e")), "t string, e string")
    for (text, quote), span in zip(rows, got):
        if _form(quote) == "" or _form(quote) not in _form(text):
            assert span is None, (text, quote)
        else:
            assert span["before"] + span["match"] + span["after"] == text
            assert _form(span["match"]) == _form(quote)
            assert _form(quote) not in _form(span["before"] + span["match"][:-1])


def test_span_offsets_are_those_of_the_original_text(spark):
    rows = [("\u0130\u0130 Foo BAR baz", "foo bar"), ("x \u0130zmir, y", "\u0130ZMIR y"), ("\u0130\u0130 end", "END"), ("\u03a3\u03a3 a", "\u03c3\u03c2 A")]
    got = column(spark, rows, X.locate_span(col("t"), col("e")), "t string, e string")
    assert [g["match"] for g in got] == ["Foo BAR", "\u0130zmir, y", "end", "\u03a3\u03a3 a"]
    assert all(g["before"] + g["match"] + g["after"] == t for g, (t, _) in zip(got, rows, strict=True))


def test_excerpts(spark):
    long = "x" * 2000 + " Evidence HERE " + "y" * 3000
    cut = column(spark, [("short", "short"), (long, "evidence here"), (long, "absent"), (long, None)],
                 X.audit_excerpt(col("t"), col("e")), "t string, e string")
    assert tuple(cut[0]) == ("short", False)
    assert cut[1]["report_truncated"] and cut[1]["report_excerpt"].startswith("...\n") and cut[1]["report_excerpt"].endswith("\n...")
    assert len(cut[1]["report_excerpt"]) == 8 + 3000 + len("evidence here")
    assert tuple(cut[2]) == (long, False) and tuple(cut[3]) == (long, False)
    text = "a" * 200 + " pM0 " + "b" * 500
    assert column(spark, [text], X.m_excerpt(col("v"))) == ["...\n" + text[51:354] + "\n..."]
    assert column(spark, ["z" * 1200], X.m_excerpt(col("v"))) == ["z" * 1000]


def test_m_evidence_class(spark):
    cases = {"closing line: M1": "explicit_m_token", "a metastasis is described": "metastatic_described_no_token",
             "the sample weighs 12 g": "no_m_evidence", "": "no_m_evidence", None: "no_m_evidence"}
    assert column(spark, list(cases), X.m_evidence_class(col("v"))) == list(cases.values())


def test_scrub(spark):
    assert column(spark, ["MRN: 12345 seen by Dr. Smith, phone 555-1234 ok"], X.scrub_personal_data(col("v"))) == [
        "[redacted] seen by [redacted], [redacted] ok"]

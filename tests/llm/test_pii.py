import hashlib
import random
import re
import time

import pytest

from llm import pii

BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def _passes(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return 12 <= len(digits) <= 19 and sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def _plain(text):
    found = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = (True, kind != 1 or all(int(x) <= 255 for x in m[0].split(".")), kind != 2 or _passes(digits), 9 <= len(digits) <= 15)
            if fits[kind]:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def _listed(found):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)


def _texts():
    rng = random.Random(5)
    atoms = [*"0123456789", " ", "-", ".", "+", "(", ")", "@", "a", "B", "%", "_", "é", "४", "4111 1111 1111 1111", "1.2.3.4", "255", "256",
             "a@b.c", "+1 (555) 555-0123", "::", "://", "[at]", "%40", "IBAN", "tel: ", "account ", "5500-0000-0000-0004"]
    return ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(3000)]


def test_base_spans_are_those_of_the_patterns(make_docs):
    rows = [*enumerate(_texts()), (9000, None), (9001, ""), (9002, "tame words " * 20_000 + "jo@host.example.org"), (9003, "1.2.3.4"), (9003, "1.2.3.4"),
            (None, "a@b.c")]
    got = sorted(map(tuple, pii.personal_spans(make_docs(rows)).drop("spans").collect()), key=str)
    want = []
    for i, t in rows:
        found = _plain(t or "")
        want.append((i, *(sum(k == x for _, k, _ in found) for x in range(4)), hashlib.sha256(_listed(found).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    for t in _texts():
        base, spans = pii.scan(t)
        assert set(base) <= set(spans) and spans == sorted(spans)


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("write jo.doe [at] host [dot] org now", "email", "jo.doe [at] host [dot] org"),
    ("jo＠host.org!", "email", "jo＠host.org"),
    ("jo@münster.de.", "email", "jo@münster.de"),
    ("IBAN: DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
    ("Account no. 12345678,", "account", "12345678"),
    ("see https://joe:pw@10.0.0.1/x?y=1 z", "url", "https://joe:pw@10.0.0.1/x?y=1"),
    ("Tel: 030/1234567, ok", "phone", "030/1234567"),
    ("1 4111 1111 1111 1111 2", "card", "4111 1111 1111 1111"),
])
def test_spans_beyond_the_base(text, kind, span):
    assert (text.index(span), pii.KINDS.index(kind), text.index(span) + len(span)) in pii.scan(text)[1]
    assert span not in pii.redacted(text)


@pytest.mark.parametrize("text", [
    "IBAN: DE88 3704 0044 0532 0130 00.", "an account of 12 things", "taccount 12345678", "the hotel: 1234567", "a (at) b", "https://host.org/x",
    "in 1999 2000 2001 2002 2003", "x@y", "version 1.2.3", "1 4111 1111 1111 1112 2"])
def test_clean_texts_stay_clean(text):
    assert pii.scan(text)[1] == [] and pii.redacted(text) == text


def test_time_is_linear_in_the_text():
    for part in ("1", "1.1", "+1", "a@", "(at)", "a%40", "a://", "+1 ", "1-", "account 1 ", "a://b@c/", "IBAN DE", "4111 1111 1111 1111 "):
        begin = time.perf_counter()
        pii.scan(part * (400_000 // len(part)))
        assert time.perf_counter() - begin < 8, part


def test_redact_keeps_rows_and_other_columns(llm_spark, make_docs):
    rows = [(1, "mail jo@host.org or +1 (555) 555-0123."), (2, None), (3, ""), (3, "")]
    got = pii.redact(make_docs(rows))
    assert got.columns == make_docs(rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(
        [(1, "mail [private] or [private]."), (2, None), (3, ""), (3, "")], key=str)
    assert pii.redact(make_docs([])).count() == 0 and pii.personal_spans(make_docs([])).count() == 0

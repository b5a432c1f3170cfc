"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, the ``://`` of schemes, a plus or a dot before a digit, two digits in
a row, and cue words such as ``IBAN`` or ``account``.  A small parser for the anchor's kind then expands it to the left and to
the right and validates what it has read.  Every parser starts behind the place where the last one of its kind ended, so a
text is read a bounded number of times however many anchors it holds.

* ``email`` grows from an at-sign: the local part to the left, labels with dots between them to the right;
* ``ip`` grows from a dot before a digit to the whole chain of numbers, which is read four by four;
* ``card`` grows from two digits, which one blank or hyphen may part, to the whole chain; 12 to 19 digits that pass Luhn's test;
* ``phone`` grows from a plus before a digit; 9 to 15 digits.

These are the base kinds.  What goes beyond them is listed in ``spans`` alone: spelled at-signs (``name [at] host [dot] org``) and
hosts with letters beyond ASCII (``email``), numbers behind a telephone cue (``phone``), card numbers in four groups of four
inside longer chains (``card``), ``iban`` (mod 97), ``account`` (six digits or more behind an account cue) and ``url`` (an address that
carries a user's name or a password).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import batch_rows, once, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "url")
EMAIL, IP, CARD, PHONE, IBAN, ACCOUNT, URL = range(7)
MARK = "[private]"
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[int, int, int]  # start, kind's number, end

# The cue words of each kind, matched in lower case, with a capital, and in capitals.
CUES = {
    IBAN: ("iban",),
    ACCOUNT: ("account", "acct", "konto", "kontonummer", "cuenta", "compte", "passport", "ssn", "social security"),
    PHONE: ("tel", "phone", "telephone", "mobile", "fax", "telefon", "telefono", "teléfono", "téléphone"),
}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_SCHEME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-."
_DIGITS = "0123456789"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_FOURS = re.compile(r"(?<![0-9])[3-6][0-9]{3}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LONGEST = 64  # characters before a spelled at-sign, as mail allows
_SPELLED = re.compile(r"[\[(]\x20?at\x20?[\])]\x20?([A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]+)+)", re.IGNORECASE)
_AFTER = r"(?:\x20?(?:no|nr|n[°º]|num|number|nummer|numero|número)\b\.?)?\x20?[:#=]?\x20?"
_IBAN = re.compile(_AFTER + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.IGNORECASE)
_ACCOUNT = re.compile(_AFTER + r"([A-Z]{0,3}[0-9](?:[\x20-]?[0-9]){5,23})(?![A-Za-z0-9])", re.IGNORECASE)
_NUMBER = re.compile(r"\.?\x20?[:#=]\x20?(\(?[0-9][\x20()./0-9-]{4,20}[0-9])(?![A-Za-z0-9])")
_AUTHORITY = re.compile(r"[^\s/?#@<>\"']+@[^\s/?#@<>\"']+(?:[/?#][^\s<>\"']*)?")


def _automaton():
    import ahocorasick

    found: dict[str, list[tuple[int, int]]] = {}

    def add(word: str, kind: int) -> None:
        if (kind, len(word)) not in found.setdefault(word, []):
            found[word].append((kind, len(word)))

    for sign in ("@", "\uff20", "%40"):
        add(sign, EMAIL)
    for bracket in "[(":
        for word in ("at", "At", "AT"):
            add(bracket + word, EMAIL)
            add(f"{bracket} {word}", EMAIL)
    add("://", URL)
    for a in _DIGITS:
        add("." + a, IP)
        add("+" + a, PHONE)
        for b in _DIGITS:
            for between in ("", " ", "-"):
                add(a + between + b, CARD)
    for kind, words in CUES.items():
        for word in words:
            for form in (word, word.capitalize(), word.upper()):
                add(form, kind)
    machine = ahocorasick.Automaton()
    for word, kinds in found.items():
        machine.add_word(word, (word, kinds))
    machine.make_automaton()
    return machine


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts double, less nine if beyond nine."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d += d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and luhn(digits)


def _ip(text: str) -> bool:
    return all(len(part := x.lstrip("0")) <= 3 and int(part or 0) <= 255 for x in text.split("."))


def _n_digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def _iban(text: str) -> bool:
    letters = text.replace(" ", "").upper()
    return 15 <= len(letters) <= 34 and int("".join(str(int(c, 36)) for c in letters[4:] + letters[:4])) % 97 == 1


class _Reader:
    """What the parsers have found in one text, and where the last of each kind ended."""

    def __init__(self, text: str):
        self.text = text
        self.base: list[Span] = []
        self.more: list[Span] = []
        self.end = [0] * len(KINDS)
        self.sign = 0  # behind the last at-sign or bracket, which no local part goes across

    def email(self, start: int, word: str) -> None:
        text = self.text
        floor = max(self.end[EMAIL], self.sign)
        if word != "@":
            floor = max(floor, start - _LONGEST)
        before = start - (word[0] in "[(" and start > floor and text[start - 1] == " ")
        first = floor + len(text[floor:before].rstrip(_LOCAL))
        if word != "%40":
            self.sign = start + 1
        if first == before:
            return
        if word == "@" and (m := _DOMAIN.match(text, start + 1)):
            self.base.append((first, EMAIL, m.end()))
            self.end[EMAIL] = m.end()
        elif m := _SPELLED.match(text, start) if word[0] in "[(" else _WIDE_DOMAIN.match(text, start + len(word)):
            self.more.append((first, EMAIL, m.end()))

    def ip(self, at: int) -> None:
        text = self.text
        if at < self.end[IP] or not at or not "0" <= text[at - 1] <= "9":
            return
        first = self.end[IP] + len(text[self.end[IP]:at].rstrip(_DIGITS))
        end = _CHAIN.match(text, first).end()
        for m in _IP.finditer(text, first, end):
            if _ip(m[0]):
                self.base.append((m.start(), IP, m.end()))
        self.end[IP] = end

    def card(self, at: int) -> None:
        if at < self.end[CARD]:
            return
        m = _CARD.match(self.text, at)
        self.end[CARD] = m.end()
        if m.end() - at < 12:
            return
        if _card(m[0]):
            self.base.append((at, CARD, m.end()))
        else:
            self.more += [(x.start(), CARD, x.end()) for x in _FOURS.finditer(self.text, at, m.end()) if _card(x[0])]

    def phone(self, at: int) -> None:
        if at >= self.end[PHONE] and (m := _PHONE.match(self.text, at)):
            self.end[PHONE] = m.end()
            if 9 <= _n_digits(m[0]) <= 15:
                self.base.append((at, PHONE, m.end()))

    def url(self, at: int) -> None:
        text = self.text
        if at < self.end[URL]:
            return
        body = text[max(self.end[URL], at - 20):at]
        first = at - len(body) + len(body.rstrip(_SCHEME))
        if first < at and (m := _AUTHORITY.match(text, at + 3)):
            self.more.append((first, URL, m.end()))
            self.end[URL] = m.end()

    def cue(self, kind: int, start: int, end: int) -> None:
        text = self.text
        if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
            return
        pattern = (_IBAN, _ACCOUNT, _NUMBER)[(IBAN, ACCOUNT, PHONE).index(kind)]
        if not (m := pattern.match(text, end)):
            return
        if kind == IBAN and _iban(m[1]) or kind == ACCOUNT or kind == PHONE and 7 <= _n_digits(m[1]) <= 15:
            self.more.append((m.start(1), kind, m.end(1)))


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(spans of the base kinds, all spans), each sorted by start and kind."""
    reader = _Reader(text)
    for last, (word, kinds) in once("pii anchors", _automaton).iter(text):
        start = last + 1 - len(word)
        for kind, _ in kinds:
            if kind == CARD:
                reader.card(start)
            elif kind == IP:
                reader.ip(start)
            elif kind == EMAIL:
                reader.email(start, word)
            elif kind == PHONE and word[0] == "+":
                reader.phone(start)
            elif kind == URL:
                reader.url(start)
            else:
                reader.cue(kind, start, last + 1)
    base = sorted(reader.base)
    return base, sorted({*base, *reader.more}) if reader.more else base


def _listed(found: list[Span]) -> str:
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found])


def personal_spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: numbers of base spans of each kind, SHA-256 of their list, and the list of all spans.

    Spans count code points.  A null text is empty and has none; repeated rows are scanned each on its own, a null doc_id
    stays null; an empty table gives no rows; other columns are ignored.
    """
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(batches, 512):
            rows = []
            for text in batch["text"].to_pylist():
                base, spans = scan(text)
                kinds = [kind for _, kind, _ in base]
                rows.append((*(kinds.count(k) for k in range(len(BASE))), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)))
            types = [pa.int64()] * len(BASE) + [pa.string()] * 2
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=[f.split()[0] for f in SCHEMA.split(", ")])

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(scanned, SCHEMA)


def redacted(text: str) -> str:
    """The text with all spans, overlapping ones together, replaced by MARK."""
    out, at, k, spans = [], 0, 0, scan(text)[1]
    while k < len(spans):
        start, _, end = spans[k]
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], MARK]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by MARK; null texts and all other columns stay as they are."""
    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_rows(batches, 512):
            at = batch.schema.get_field_index("text")
            new = [None if t is None else redacted(t) for t in batch["text"].to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(cleaned, docs.schema)

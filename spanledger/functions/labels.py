"""Label values: canonical form, predictions, explicit tokens in text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions.patterns import SPACE, java


def literal_map(pairs: Iterable[tuple[str, str]]) -> Column:
    """A constant string map."""
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


_EDGE_SPACE = rf"\A{SPACE}+|{SPACE}+\z"
_CANONICAL = r"\AP?([TNM](?:X(?=\z)|\p{Nd}(?=[^\n]*\z)))"


def strip(value: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.regexp_replace(value, _EDGE_SPACE, "")


def submitter_id(filename: Column) -> Column:
    """The part of a file name before its first dot."""
    return F.substring_index(filename, ".", 1)


def canonicalize(raw: Column) -> Column:
    """Fold a raw stage value to its major category; NULL when it is not one.

    One leading P is dropped, the letter must be T, N or M, and the rest is either exactly X or
    starts with a digit, which decides the category.
    """
    return F.nullif(F.regexp_extract(F.upper(strip(raw)), _CANONICAL, 1), F.lit(""))


def canonical_gold(raw: Column, *, strict: bool = True) -> Column:
    """Canonical gold value.  NULL passes; a bad value fails the job, or gives NULL if not strict."""
    value = canonicalize(raw)
    if not strict:
        return value
    return F.when(
        raw.isNotNull() & value.isNull(),
        F.raise_error(F.concat(F.lit("gold value is not a stage: "), raw)).cast("string"),
    ).otherwise(value)


def bad_gold(raw: Column) -> Column:
    """The raw gold value when it cannot be canonicalised, else NULL (for a quarantine column)."""
    return F.when(raw.isNotNull() & canonicalize(raw).isNull(), raw)


def norm_pred(raw: Column) -> Column:
    """Prediction in the scoring domain: canonical value, ``unknown`` or ``INVALID``."""
    says_unknown = raw.isNull() | (F.lower(strip(raw)) == K.UNKNOWN)
    return F.when(says_unknown, K.UNKNOWN).otherwise(F.coalesce(canonicalize(raw), F.lit(K.INVALID)))


def is_abstention(prediction: Column) -> Column:
    return prediction == K.UNKNOWN


def in_domain(raw: Column) -> Column:
    """True when the raw value is already a legal value, word for word; NULL counts as not legal."""
    return F.coalesce(raw.isin(*K.DOMAIN), F.lit(False))


def _token(letter: str, suffix: str) -> str:
    tail = "(?![a-z0-9])" if suffix == "X" else ""
    return java(f"<L>p?{letter.lower()}{suffix.lower()}{tail}", ignore_case=False)


def _supported(value: Column, text: Column, suffixes: dict[str, str]) -> Column:
    """Look for the token pattern of the row's value in the lower-cased text.

    A plain substring test comes first: it rejects most texts without starting a regular expression.
    """
    patterns = literal_map((f"{t}{s}", _token(t, s)) for t in suffixes for s in suffixes[t])
    low = F.lower(text)
    return F.coalesce(F.contains(low, F.lower(value)) & F.rlike(low, patterns[value]), F.lit(False))


def value_supported_by_text(value: Column, text: Column) -> Column:
    """True when some stage token in ``text`` canonicalises to ``value``.

    The token class is chosen by the letter of the value, and a token starts at a word boundary:
    ``pT2N0M0`` supports T2 only.
    """
    return _supported(value, text, K.TOKEN_SUFFIXES)


def text_supports_gold(gold: Column, text: Column) -> Column:
    """As :func:`value_supported_by_text`, with suffixes 0-4 and X for every letter."""
    return _supported(gold, text, {t: K.BOUNDARY_SUFFIXES for t in K.TARGETS})


def has_explicit_token(text: Column, target: str) -> Column:
    """Easy/hard tag: the text names some stage of ``target``."""
    return text.rlike(java(rf"<L>p?{target}[{K.TOKEN_SUFFIXES[target]}]"))


def prediction_bucket(target: Column, prediction: Column) -> Column:
    """The prediction when it lies in the class space of its target, else the abstain bucket."""
    inside = reduce(
        lambda a, b: a | b,
        [(target == t) & prediction.isin(*classes) for t, classes in K.CLASS_SPACE.items()],
    )
    return F.when(inside, prediction).otherwise(K.ABSTAIN_BUCKET)


def domain_violations(target: str, field: Column) -> Column:
    """Array of the closed-domain rules that a field struct breaks, in a fixed order."""
    value = field["value"]
    allowed = [v for v in K.ALLOWED_VALUES if v[0] == target] + [K.UNKNOWN]
    reason = F.coalesce(field["reason"], F.lit(""))
    return F.array_compact(F.array(
        F.when(~F.coalesce(value.isin(*allowed), F.lit(False)), f"{target}:value_outside_domain"),
        F.when(~F.coalesce(field["confidence"].isin(*K.CONFIDENCE_LEVELS), F.lit(False)),
               f"{target}:confidence_outside_domain"),
        F.when((value == K.UNKNOWN) & (reason == ""), f"{target}:reason_required"),
    ))


def arm_from_legacy(letter: Column) -> Column:
    """Long arm name of a legacy letter; other names pass through."""
    return F.coalesce(literal_map((r[1], r[0]) for r in K.ARM_TABLE if r[1])[letter], letter)


def legacy_from_arm(arm: Column) -> Column:
    """Legacy letter of an arm name, NULL for an arm that never had one."""
    return literal_map((r[0], r[1]) for r in K.ARM_TABLE if r[1])[arm]

"""Turn the pattern templates of ``spanledger.constants`` into Java regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode letters, numbers and underscore; spelled out because the short-hand classes of the
# regex dialects disagree about accented letters, marks and superscript digits.
WORD = r"[\p{L}\p{N}_]"
SPACE_CHARS = r"\t-\r\x1c-\x1f\x85\p{Z}"
SPACE = f"[{SPACE_CHARS}]"
NOT_SPACE = f"[^{SPACE_CHARS}]"

_MARKS = {
    "<L>": rf"(?<!{WORD})",
    "<R>": rf"(?!{WORD})",
    "<S>": SPACE,
    "<N>": NOT_SPACE,
    "<D>": r"\p{Nd}",
    "<W>": WORD,
}


def java(template: str, *, ignore_case: bool = True) -> str:
    """Java form of a template, case-insensitive by default."""
    for mark, text in _MARKS.items():
        template = template.replace(mark, text)
    return ("(?iu)" if ignore_case else "") + template


def found(text: Column, template: str) -> Column:
    """True when the template occurs in ``text``."""
    return text.rlike(java(template))


def first_hit(text: Column, template: str) -> tuple[Column, Column, Column]:
    """(found, start, end) of the first occurrence; offsets count characters from 0.

    Splitting once at the first hit gives both sides of it in one pass over the text.
    """
    sides = F.split(text, java(template), 2)
    after = F.get(sides, F.lit(1))
    return after.isNotNull(), F.length(sides[0]), F.length(text) - F.length(after)


def cut(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) with both ends clipped to the text."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(F.least(end, F.length(text)) - low, F.lit(0)))

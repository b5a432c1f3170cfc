"""Report text: matching form, evidence grounding, excerpts, scrubbing, span location."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions.patterns import SPACE_CHARS, cut, first_hit, found, java


def matching_form(text: Column) -> Column:
    """Lower case, full stops and commas as blanks, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), f"[.,{SPACE_CHARS}]+", " "))


def grounded_in(evidence_form: Column, text_form: Column) -> Column:
    """Evidence grounding over two matching forms; NULL or blank evidence is not grounded."""
    return F.coalesce((evidence_form != "") & F.contains(text_form, evidence_form), F.lit(False))


def grounded(evidence: Column, text: Column) -> Column:
    """True when the evidence occurs in the text, up to case, stops, commas and line breaks."""
    return grounded_in(matching_form(evidence), matching_form(text))


def m_evidence_class(text: Column) -> Column:
    """What the report says about distant disease: token, prose, neither, or a hedged mix."""
    token, prose = found(text, K.M_TOKEN), found(text, K.METASTATIC_WORD)
    explicit, described, nothing, mixed = K.M_CLASSES
    return (
        F.when(token & prose & found(text, K.HEDGE), mixed)
        .when(token, explicit)
        .when(prose, described)
        .otherwise(nothing)
    )


def _with_ellipses(text: Column, start: Column, end: Column) -> Column:
    return F.concat(
        F.when(start > 0, K.ELLIPSIS_BEFORE).otherwise(""),
        cut(text, start, end),
        F.when(end < F.length(text), K.ELLIPSIS_AFTER).otherwise(""),
    )


def m_excerpt(text: Column, *, pad: int = K.M_EXCERPT_WINDOW, head: int = K.M_EXCERPT_HEAD) -> Column:
    """Context around the first M token, else around the first metastasis word, else the head."""
    token, t_start, t_end = first_hit(text, K.M_TOKEN)
    prose, p_start, p_end = first_hit(text, K.METASTATIC_WORD)
    return (
        F.when(token, _with_ellipses(text, t_start - pad, t_end + pad))
        .when(prose, _with_ellipses(text, p_start - pad, p_end + pad))
        .otherwise(F.substring(text, 1, head))
    )


def audit_excerpt(text: Column, evidence: Column, *, longest: int = K.AUDIT_EXCERPT_MAX,
                  pad: int = K.AUDIT_EXCERPT_WINDOW) -> Column:
    """Struct(report_excerpt, report_truncated) for a reviewer.

    A short report is shown whole; a long one as a window around the evidence when that can be
    located, otherwise whole, so that nothing a reviewer needs is hidden.
    """
    at = F.instr(F.lower(text), F.lower(evidence))
    windowed = (F.length(text) > longest) & (evidence != "") & (at > 0)
    start = at - 1 - pad
    end = at - 1 + F.length(evidence) + pad
    return F.struct(
        F.when(windowed, _with_ellipses(text, start, end)).otherwise(text).alias("report_excerpt"),
        F.coalesce(windowed, F.lit(False)).alias("report_truncated"),
    )


def head_with_mark(text: Column, limit: int) -> Column:
    """The first ``limit`` characters and a mark when the text is longer, else the text."""
    head = F.concat(F.substring(text, 1, limit), F.lit(K.TRUNCATION_MARK))
    return F.when(F.length(text) > limit, head).otherwise(text)


def scrub_personal_data(text: Column) -> Column:
    """Replace record numbers, birth dates, phone numbers and titled names by a mark."""
    return F.regexp_replace(text, java(K.PERSONAL_DATA), K.PERSONAL_DATA_MARK)


def least_start(text_form: Column, words: Column, growth: Column) -> Column:
    """A number of characters that lie before the first grounded occurrence in the original text.

    The matching form drops characters; it adds none but for those letters that grow in lower case, by ``growth`` in
    all.  So the text's place is the form's or a later one, and a search need not begin earlier.
    """
    return F.greatest(F.instr(text_form, words) - 1 - growth, F.lit(0))


def span_sides(text: Column, words: Column, skip: Column | int = 0) -> Column:
    """The text before and after the first grounded occurrence, one element alone where there is none; ``words`` is the
    matching form of the quote.  The first ``skip`` characters are neither searched nor returned.

    The quote becomes a pattern, in any case, whose words may be apart by any run of stops, commas
    and white space, so the offsets are those of the text itself and no position map is needed.  A
    dotted capital I is one letter, its lower-case form two; the pattern takes either.
    """
    escaped = F.regexp_replace(words, r"([^\p{L}\p{N}\p{M} ])", r"\\$1")
    dotted = F.replace(escaped, F.lit("i\u0307"), F.lit("(?:i\u0307|\u0130)"))
    pattern = F.concat(F.lit("(?iu)"), F.replace(dotted, F.lit(" "), F.lit(f"[.,{SPACE_CHARS}]+")))
    skip = F.lit(skip) if isinstance(skip, int) else skip
    return F.split(F.substring(text, skip + 1, F.length(text)), pattern, 2)


def span_between(text: Column, sides: Column, skip: Column | int = 0) -> Column:
    """Struct(start, size) in the original text of what lies between the two sides; NULL without a second one."""
    after = F.get(sides, F.lit(1))
    start = F.length(sides[0]) + skip
    span = F.struct(start.alias("start"), (F.length(text) - start - F.length(after)).alias("size"))
    return F.when(after.isNotNull(), span)


def span_in(text: Column, words: Column) -> Column:
    """Struct(start, size) of the first grounded occurrence in the original text."""
    return span_between(text, span_sides(text, words))


def locate_span(text: Column, evidence: Column) -> Column:
    """Struct(before, match, after) of the first grounded occurrence in the original text; NULL when
    the quote is blank or not there."""
    words = matching_form(evidence)
    return around_span(text, F.when(words != "", span_in(text, words)))


def around_span(text: Column, span: Column) -> Column:
    """The text before, in and after a span."""
    start, size = span["start"], span["size"]
    return F.when(span.isNotNull(), F.struct(
        F.substring(text, F.lit(1), start).alias("before"),
        F.substring(text, start + 1, size).alias("match"),
        F.substring(text, start + size + 1, F.length(text)).alias("after"),
    ))

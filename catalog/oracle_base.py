"""Shared common table expressions of the oracle SQL: views, evidence features, records."""

from __future__ import annotations

from catalog.views import PHRASES
from spanledger import constants as K

# White space, words and boundaries in the dialect of the checking engine (no look-around there).
WS = r"\t-\r\x1c-\x1f\x85\p{Z}"
LEFT = r"(?:^|[^\p{L}\p{N}_])"
RIGHT = r"(?:$|[^\p{L}\p{N}_])"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pattern(template: str, flags: str = "i") -> str:
    marks = {"<L>": LEFT, "<R>": RIGHT, "<S>": f"[{WS}]", "<N>": f"[^{WS}]", "<D>": r"\p{Nd}", "<W>": r"[\p{L}\p{N}_]"}
    for mark, text in marks.items():
        template = template.replace(mark, text)
    return lit(f"(?{flags}){template}")


def has(text: str, template: str) -> str:
    return f"regexp_matches({text}, {pattern(template)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(rf'\A[{WS}]+|[{WS}]+\z')}, '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), {lit(f'[.,{WS}]+')}, ' ', 'g'))"


def canon(x: str) -> str:
    v = f"upper({strip(x)})"
    shape = lit(r"\AP?[TNM](?:X\z|\p{Nd}[^\n]*\z)")
    return f"(CASE WHEN regexp_matches({v}, {shape}) THEN regexp_extract({v}, {lit(r'\AP?([TNM](?:X|\p{Nd}))')}, 1) END)"


def norm_pred(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR lower({strip(x)}) = 'unknown' THEN 'unknown' "
            f"ELSE coalesce({canon(x)}, 'INVALID') END)")


def token_values(text: str, suffix_class: dict[str, str]) -> str:
    """List of the values that the stage tokens of a text canonicalise to (by definition, token by token)."""
    parts = []
    for t, cls in suffix_class.items():
        tokens = f"regexp_extract_all({text}, {pattern(rf'<L>(p?{t}[{cls}][A-Za-z0-9]*)')}, 1)"
        parts.append(f"[{canon('w')} for w in {tokens}]")
    return "list_concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def supported(value: str, tokens: str) -> str:
    return f"coalesce(list_contains({tokens}, {value}), false)"


_PHRASES = " ".join(f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(PHRASES))
_ARMS = ", ".join(f"({i}, {lit(a)})" for i, a in enumerate(K.STUDY_ARMS))

VIEWS = f"""
doc AS MATERIALIZED (
  SELECT doc_id, 'D' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS case_id, source, n_chars, text AS body,
         CASE doc_id % 8 {_PHRASES} END AS phrase FROM documents
),
rep AS MATERIALIZED (
  SELECT doc_id, case_id, source, n_chars, case_id || '.' || source AS patient_filename, phrase,
         body || ' ' || phrase AS text,
         CASE WHEN doc_id % 5 <> 0 THEN 'T' || CAST(doc_id % 4 + 1 AS VARCHAR) END AS gold_T,
         CASE WHEN doc_id % 3 <> 0 THEN 'N' || CAST(doc_id % 4 AS VARCHAR) END AS gold_N,
         CASE WHEN doc_id % 20 = 0 THEN 'M1' WHEN doc_id % 4 = 0 THEN 'M0' END AS gold_M
  FROM doc
),
resp0 AS (
  SELECT r.*, a.arm_no, a.arm, t.target_no, t.target,
         CASE t.target WHEN 'T' THEN gold_T WHEN 'N' THEN gold_N ELSE gold_M END AS gold,
         (doc_id * 7 + arm_no * 3 + target_no * 5) % 11 AS sel,
         (doc_id * 7 + arm_no * 3) % 13 <> 10 AS shape_valid
  FROM rep r, (VALUES {_ARMS}) a(arm_no, arm), (VALUES (0, 'T'), (1, 'N'), (2, 'M')) t(target_no, target)
),
resp AS MATERIALIZED (
  SELECT doc_id, case_id, arm_no, arm, target_no, target, gold, shape_valid, sel,
    CASE WHEN sel <= 3 THEN coalesce(gold, target || '0') WHEN sel = 4 THEN 'p' || target || '2b'
         WHEN sel = 5 THEN target || '1' WHEN sel = 6 THEN target || '3' WHEN sel = 8 THEN 'Unknown '
         WHEN sel = 9 THEN 'junk' WHEN sel = 10 THEN 'yp' || target || '2' END AS raw_value,
    CASE WHEN sel <= 3 OR sel = 9 THEN phrase WHEN sel = 4 THEN upper(phrase)
         WHEN sel = 5 THEN substr(text, greatest(1, length(text) // 2), 40)
         WHEN sel = 6 THEN 'fabricated quote' END AS evidence,
    CASE WHEN sel <= 3 THEN 'high' WHEN sel <= 6 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN sel = 8 THEN 'not stated' END AS reason
  FROM resp0
)"""


def _before(x: str, template: str, lead: str = "") -> str:
    return f"regexp_extract({x}, {pattern(f'^(.*?{lead})(?:{template})', 'is')}, 1)"


def _hit(x: str, template: str, lead: str = "") -> str:
    return f"regexp_extract({x}, {pattern(f'^.*?{lead}({template})', 'is')}, 1)"


_VERB = K.INVASION_VERB.removeprefix("<L>").removesuffix("<R>")


def _window(pre: str, hit: str, w: int) -> str:
    return (f"substr(evidence, greatest(length({pre}) - {w}, 0) + 1, "
            f"length({pre}) + length({hit}) + {w} - greatest(length({pre}) - {w}, 0))")


def _cut_before(pre: str, w: int) -> str:
    return f"right({pre}, {w})"


EVIDENCE = f"""
ev1 AS MATERIALIZED (
  SELECT evidence,
    {_before('evidence', K.LYMPH_NODE)} AS n_pre, {_hit('evidence', K.LYMPH_NODE)} AS n_hit,
    {_before('evidence', _VERB + RIGHT, LEFT)} AS v_pre,
    regexp_extract(evidence, {pattern('^.*?<L>(' + _VERB + ')<R>', 'is')}, 1) AS v_hit,
    {_before('evidence', K.DISTANT_METASTASIS)} AS d_pre, {_hit('evidence', K.DISTANT_METASTASIS)} AS d_hit,
    {token_values('evidence', {'T': '0-4X', 'N': '0-3X', 'M': '01X'})} AS tokens
  FROM (SELECT DISTINCT evidence FROM resp WHERE evidence IS NOT NULL)
),
ev AS MATERIALIZED (
  SELECT evidence, tokens,
    CASE WHEN n_hit <> '' THEN
      CASE WHEN {has(_window('n_pre', 'n_hit', 50), K.NODE_COUNT)} THEN
             CASE WHEN CAST(regexp_extract({_window('n_pre', 'n_hit', 50)}, {pattern(K.NODE_COUNT)}, 1) AS BIGINT) = 0
                  THEN 'negative' ELSE 'positive' END
           WHEN {has(_window('n_pre', 'n_hit', 50), K.NEGATIVE_WORD)} THEN 'negative'
           WHEN {has(_window('n_pre', 'n_hit', 50), K.POSITIVE_NODE_WORD)} THEN 'positive' END END AS nodes,
    v_hit <> '' AND NOT {has(_cut_before('v_pre', 20), K.NEGATION_BEFORE)}
      AND {has(_window('v_pre', 'v_hit', 50), K.DEEP_STRUCTURE)} AS invasion,
    {has('evidence', K.TUMOR_SIZE)} AS size,
    CASE WHEN d_hit <> '' THEN CASE WHEN {has(_cut_before('d_pre', 30), K.NEGATIVE_WORD)} THEN 'negative'
         ELSE 'positive' END END AS spread
  FROM ev1
)"""

REPORT_FEATURES = f"""
feat AS MATERIALIZED (
  SELECT case_id, {norm('text')} AS text_form,
    {token_values('text', {'T': '0-4X', 'N': '0-3X', 'M': '01X'})} AS tokens,
    {token_values('text', {'T': '0-4X', 'N': '0-4X', 'M': '0-4X'})} AS wide_tokens,
    {has('text', '<L>p?T[0-4X]')} AS easy_T, {has('text', '<L>p?N[0-3X]')} AS easy_N, {has('text', '<L>p?M[01X]')} AS easy_M
  FROM rep
)"""


def semantic(prediction: str, target: str, e: str) -> str:
    """Support of a prediction by an evidence row (alias e of ev)."""
    return f"""coalesce(CASE WHEN {e}.evidence IS NULL OR {e}.evidence = '' OR {prediction} IN ('unknown', 'INVALID') THEN false
      WHEN list_contains({e}.tokens, {prediction}) THEN true
      WHEN {target} = 'N' AND {prediction} = 'N0' THEN {e}.nodes = 'negative'
      WHEN {target} = 'N' AND {prediction} = 'N1' THEN {e}.nodes = 'positive'
      WHEN {target} = 'T' AND {prediction} IN ('T2', 'T3', 'T4') THEN {e}.invasion
      WHEN {target} = 'M' AND {prediction} = 'M0' THEN {e}.spread = 'negative'
      WHEN {target} = 'M' AND {prediction} = 'M1' THEN {e}.spread = 'positive' ELSE false END, false)"""


RECORDS = f"""
rec0 AS (
  SELECT p.case_id, p.doc_id, p.arm, p.target, p.gold AS ground_truth, p.raw_value, p.confidence, p.reason, p.shape_valid,
    CASE WHEN p.shape_valid THEN p.evidence END AS evidence,
    CASE WHEN p.shape_valid THEN {norm_pred('p.raw_value')} ELSE 'INVALID' END AS prediction,
    coalesce(p.shape_valid AND {norm('p.evidence')} <> '' AND contains(f.text_form, {norm('p.evidence')}), false) AS quoted,
    {supported('p.gold', 'f.tokens')} AS gold_in_text
  FROM resp p JOIN feat f USING (case_id)
),
rec AS MATERIALIZED (
  SELECT r.*, r.prediction = r.ground_truth AS correct, r.prediction = 'unknown' AS abstained,
    CASE WHEN r.prediction <> 'unknown' THEN r.quoted END AS span,
    CASE WHEN r.prediction <> 'unknown' THEN r.quoted AND {semantic('r.prediction', 'r.target', 'e')} END AS sem
  FROM rec0 r LEFT JOIN ev e ON r.evidence = e.evidence
),
records AS MATERIALIZED (
  SELECT *,
    CASE WHEN NOT shape_valid THEN ['invalid_schema_output']
         WHEN prediction = 'INVALID' THEN ['invalid_normalization']
         WHEN prediction = 'unknown' AND ground_truth IS NOT NULL AND gold_in_text THEN ['over_abstention', 'missed_explicit_stage']
         WHEN prediction = 'unknown' THEN []
         ELSE list_filter([CASE WHEN NOT span THEN 'evidence_span_not_found' WHEN NOT sem THEN 'evidence_does_not_support_prediction' END,
              CASE WHEN ground_truth <> prediction AND NOT span THEN 'hallucinated_stage'
                   WHEN ground_truth <> prediction THEN 'wrong_stage_with_supporting_evidence' END], lambda x: x IS NOT NULL) END AS errors
  FROM rec
)"""

BOUNDARY = f"""
bnd0 AS (
  SELECT p.case_id, p.doc_id, p.arm, p.target, p.gold, NOT p.shape_valid AS invalid, p.confidence, p.reason,
    CASE WHEN p.shape_valid THEN p.raw_value END AS value, CASE WHEN p.shape_valid THEN p.evidence END AS evidence,
    CASE WHEN p.shape_valid THEN {norm_pred('p.raw_value')} ELSE 'unknown' END AS value_norm,
    coalesce(p.shape_valid AND {norm('p.evidence')} <> '' AND contains(f.text_form, {norm('p.evidence')}), false) AS grounded,
    {supported('p.gold', 'f.wide_tokens')} AS gold_in_report,
    CASE p.target WHEN 'T' THEN f.easy_T WHEN 'N' THEN f.easy_N ELSE f.easy_M END AS easy
  FROM resp p JOIN feat f USING (case_id)
),
bnd AS MATERIALIZED (
  SELECT *, CASE WHEN gold IS NULL THEN NULL WHEN value_norm = gold THEN 'correct'
    WHEN value_norm = 'unknown' AND gold_in_report THEN 'over_abstention'
    WHEN value_norm = 'unknown' THEN 'source_boundary_abstention'
    WHEN grounded THEN 'report_gold_discordance' ELSE 'unsupported_error' END AS boundary_tag
  FROM bnd0
)"""


def with_views(body: str, *ctes: str) -> str:
    return "WITH " + ",".join((VIEWS, *ctes)) + "\n" + body


def with_records(body: str, *ctes: str) -> str:
    return with_views(body, EVIDENCE, REPORT_FEATURES, RECORDS, *ctes)


def with_boundary(body: str, *ctes: str) -> str:
    return with_views(body, REPORT_FEATURES, BOUNDARY, *ctes)

"""Projections, scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.oracle_base import (
    EVIDENCE, REPORT_FEATURES, WS, canon, has, lit, norm, norm_pred, pattern, semantic, supported, with_boundary,
    with_records, with_views,
)
from catalog.registry import query
from spanledger import constants as K
from spanledger.functions import labels, support, text
from spanledger.operators import dataset, records as R

RAW_VARIANTS = (
    "CASE doc_id % 6 WHEN 0 THEN ' ' || lower(raw_value) || ' ' WHEN 1 THEN raw_value || '(i+)' "
    "WHEN 2 THEN 'p' || raw_value WHEN 3 THEN upper(raw_value) WHEN 4 THEN target || 'x' ELSE target || 'is' END"
)


def _numbered_responses(spark, d):
    return V._answers(spark, d).select("doc_id", "case_id", "arm", "target", "raw_value", "evidence")


@query("p1_submitter_id", with_views("SELECT patient_filename, case_id AS submitter_id FROM rep"))
def _(spark, d):
    return V.raw_reports(spark, d).select(
        "patient_filename", labels.submitter_id(F.col("patient_filename")).alias("submitter_id"))


@query("p2_canonicalize", with_views(
    f"SELECT case_id, arm, target, variant, {canon('variant')} AS value "
    f"FROM (SELECT *, {RAW_VARIANTS} AS variant FROM resp)"))
def _(spark, d):
    rows = _numbered_responses(spark, d).withColumn("variant", F.expr(RAW_VARIANTS))
    return rows.select("case_id", "arm", "target", "variant", labels.canonicalize(F.col("variant")).alias("value"))


@query("p3_gold_with_quarantine", with_views(
    f"SELECT case_id, arm, target, {canon('variant')} AS gold, "
    f"CASE WHEN variant IS NOT NULL AND {canon('variant')} IS NULL THEN variant END AS bad_gold "
    f"FROM (SELECT *, {RAW_VARIANTS} AS variant FROM resp)"))
def _(spark, d):
    raw = F.col("variant")
    rows = _numbered_responses(spark, d).withColumn("variant", F.expr(RAW_VARIANTS))
    return rows.select("case_id", "arm", "target", labels.canonical_gold(raw, strict=False).alias("gold"),
                       labels.bad_gold(raw).alias("bad_gold"))


@query("p4_norm_pred", with_views(f"SELECT case_id, arm, target, raw_value, {norm_pred('raw_value')} AS prediction FROM resp"))
def _(spark, d):
    return V.responses(spark, d).select(
        "case_id", "arm", "target", "raw_value", labels.norm_pred(F.col("raw_value")).alias("prediction"))


@query("p5_matching_form", with_views(
    f"SELECT case_id, length(form) AS form_length, md5(form) AS form_md5 FROM (SELECT case_id, {norm('text')} AS form FROM rep)"))
def _(spark, d):
    forms = V.reports(spark, d).select("case_id", text.matching_form(F.col("text")).alias("form"))
    return forms.select("case_id", F.length("form").alias("form_length"), F.md5("form").alias("form_md5"))


@query("p6_grounded", with_views(
    f"""SELECT case_id, arm, target, coalesce({norm('evidence')} <> '' AND contains(text_form, {norm('evidence')}), false) AS grounded
    FROM resp JOIN feat USING (case_id)""", REPORT_FEATURES), bools="grounded")
def _(spark, d):
    forms = V.reports(spark, d).select("case_id", text.matching_form(F.col("text")).alias("text_form"))
    joined = V.responses(spark, d).join(forms, "case_id")
    return joined.select("case_id", "arm", "target", text.grounded_in(
        text.matching_form(F.col("evidence")), F.col("text_form")).alias("grounded"))


_VALUES = ", ".join(lit(v) for v in K.ALLOWED_VALUES)


@query("p7_value_supported_by_text", with_views(
    f"SELECT case_id, v AS value, {supported('v', 'tokens')} AS supported FROM feat, (SELECT unnest([{_VALUES}]) AS v)",
    REPORT_FEATURES), bools="supported")
def _(spark, d):
    rows = V.reports(spark, d).select("case_id", "text", F.explode(F.array(*(F.lit(v) for v in K.ALLOWED_VALUES))).alias("value"))
    return rows.select("case_id", "value", labels.value_supported_by_text(F.col("value"), F.col("text")).alias("supported"))


@query("p8_text_supports_gold", with_views(
    "SELECT r.case_id, " + ", ".join(f"{supported(f'r.gold_{t}', 'f.wide_tokens')} AS supported_{t}" for t in K.TARGETS)
    + " FROM rep r JOIN feat f USING (case_id)", REPORT_FEATURES), bools="supported_T supported_N supported_M")
def _(spark, d):
    return V.reports(spark, d).select("case_id", *(
        labels.text_supports_gold(F.col(f"gold_{t}"), F.col("text")).alias(f"supported_{t}") for t in K.TARGETS))


@query("p9_easy_hard_tag", with_views("SELECT case_id, easy_T, easy_N, easy_M FROM feat", REPORT_FEATURES),
       bools="easy_T easy_N easy_M")
def _(spark, d):
    return V.reports(spark, d).select("case_id", *(
        labels.has_explicit_token(F.col("text"), t).alias(f"easy_{t}") for t in K.TARGETS))


def _evidence(spark, d):
    return V.responses(spark, d).select("case_id", "arm", "target", "raw_value", "evidence")


_EV = "FROM resp p LEFT JOIN ev e ON p.evidence = e.evidence"


@query("p10_node_status", with_views(f"SELECT case_id, arm, target, nodes AS status {_EV}", EVIDENCE))
def _(spark, d):
    return _evidence(spark, d).select("case_id", "arm", "target", support.node_status(F.col("evidence")).alias("status"))


@query("p11_local_invasion", with_views(f"SELECT case_id, arm, target, invasion {_EV}", EVIDENCE), bools="invasion")
def _(spark, d):
    return _evidence(spark, d).select("case_id", "arm", "target", support.local_invasion(F.col("evidence")).alias("invasion"))


@query("p12_tumor_size", with_views(f"SELECT case_id, arm, target, size AS tumor_size {_EV}", EVIDENCE), bools="tumor_size")
def _(spark, d):
    return _evidence(spark, d).select("case_id", "arm", "target", support.tumor_size(F.col("evidence")).alias("tumor_size"))


@query("p13_distant_metastasis", with_views(f"SELECT case_id, arm, target, spread AS status {_EV}", EVIDENCE))
def _(spark, d):
    return _evidence(spark, d).select("case_id", "arm", "target", support.distant_metastasis(F.col("evidence")).alias("status"))


_CATEGORIES = f"""list_sort(list_filter([CASE WHEN {supported('prediction', 'tokens')} THEN 'explicit_stage_token' END,
  CASE WHEN nodes = 'negative' THEN 'regional_node_negative' WHEN nodes = 'positive' THEN 'regional_node_positive' END,
  CASE WHEN invasion THEN 'local_invasion' END, CASE WHEN size THEN 'tumor_size' END,
  CASE WHEN spread = 'positive' THEN 'distant_metastasis_positive' WHEN spread = 'negative' THEN 'distant_metastasis_negative' END
  ], lambda x: x IS NOT NULL))"""


@query("p14_evidence_categories", with_views(f"""SELECT case_id, arm, target,
    CASE WHEN evidence IS NULL OR evidence = '' THEN [] WHEN len(tags) = 0 THEN ['unknown'] ELSE tags END AS categories
    FROM (SELECT case_id, arm, target, p.evidence, {_CATEGORIES} AS tags
          FROM (SELECT *, {norm_pred('raw_value')} AS prediction FROM resp) p LEFT JOIN ev e ON p.evidence = e.evidence)""",
    EVIDENCE), arrays="categories")
def _(spark, d):
    return V.responses(spark, d).select("case_id", "arm", "target", support.evidence_categories(
        F.col("evidence"), labels.norm_pred(F.col("raw_value"))).alias("categories"))


@query("p15_semantic_support", with_records(
    f"SELECT case_id, arm, target, coalesce({semantic('r.prediction', 'r.target', 'e')}, FALSE) AS supported"
    " FROM records r LEFT JOIN ev e ON r.evidence = e.evidence"), bools="supported")
def _(spark, d):
    return V.records(spark, d).select("case_id", "arm", "target", support.semantic_support(
        F.col("prediction"), F.col("evidence"), F.col("target")).alias("supported"))


@query("p16_prediction_records", with_records(
    """SELECT case_id, arm, target, ground_truth, prediction, md5(evidence) AS evidence_md5, correct, abstained,
    span AS evidence_span_found, sem AS evidence_semantically_supports_prediction, errors,
    CASE WHEN shape_valid THEN raw_value END AS raw_value FROM records"""),
    bools="correct abstained evidence_span_found evidence_semantically_supports_prediction", arrays="errors")
def _(spark, d):
    return V.records(spark, d).select(
        "case_id", "arm", "target", "ground_truth", "prediction", F.md5("evidence").alias("evidence_md5"), "correct",
        "abstained", "evidence_span_found", "evidence_semantically_supports_prediction", "errors",
        F.col("raw_model_output")["value"].alias("raw_value"))


def stale_records(spark, d):
    """Records as the token-only heuristic scored them."""
    name = "evidence_semantically_supports_prediction"
    token = labels.value_supported_by_text(F.col("prediction"), F.coalesce("evidence", F.lit("")))
    return V.records(spark, d).withColumn(
        name, F.when(~F.col("abstained"), F.col("evidence_span_found") & token))


@query("p17_rescored_records", with_records(
    "SELECT case_id, arm, target, span AS evidence_span_found, sem AS evidence_semantically_supports_prediction FROM records"),
    bools="evidence_span_found evidence_semantically_supports_prediction")
def _(spark, d):
    return R.rescore(stale_records(spark, d)).select(
        "case_id", "arm", "target", "evidence_span_found", "evidence_semantically_supports_prediction")


@query("p18_error_taxonomy", with_records("SELECT case_id, arm, target, errors FROM records"), arrays="errors")
def _(spark, d):
    return V.records(spark, d).select("case_id", "arm", "target", "errors")


@query("p19_source_boundary_tag", with_boundary(
    "SELECT case_id, arm, target, value_norm, grounded, boundary_tag FROM bnd"), bools="grounded")
def _(spark, d):
    return V.boundary(spark, d).select("case_id", "arm", "target", "value_norm", "grounded", "boundary_tag")


_M_CLASS = f"""CASE WHEN {has('text', K.M_TOKEN)} AND {has('text', K.METASTATIC_WORD)} AND {has('text', K.HEDGE)} THEN 'ambiguous_insufficient'
  WHEN {has('text', K.M_TOKEN)} THEN 'explicit_m_token' WHEN {has('text', K.METASTATIC_WORD)} THEN 'metastatic_described_no_token'
  ELSE 'no_m_evidence' END"""


@query("p21_m_evidence_class", with_views(f"SELECT case_id, {_M_CLASS} AS m_class FROM rep"))
def _(spark, d):
    return V.reports(spark, d).select("case_id", text.m_evidence_class(F.col("text")).alias("m_class"))


_L, _R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _around(template: str) -> str:
    """Excerpt around the first hit of a template that is bounded by <L> and <R>."""
    core = template.removeprefix("<L>").removesuffix("<R>")
    pre = f"regexp_extract(text, {pattern(f'^(.*?<L>)(?:{core})<R>', 'is')}, 1)"
    hit = f"regexp_extract(text, {pattern(f'^.*?<L>({core})<R>', 'is')}, 1)"
    low = f"greatest(length({pre}) - 150, 0)"
    high = f"least(length({pre}) + length({hit}) + 150, length(text))"
    return (f"(CASE WHEN {low} > 0 THEN '...' || chr(10) ELSE '' END || substr(text, {low} + 1, {high} - {low}) || "
            f"CASE WHEN {high} < length(text) THEN chr(10) || '...' ELSE '' END)")


_M_EXCERPT = f"""CASE WHEN {has('text', K.M_TOKEN)} THEN {_around(K.M_TOKEN)}
  WHEN {has('text', K.METASTATIC_WORD)} THEN {_around(K.METASTATIC_WORD)} ELSE substr(text, 1, 1000) END"""


@query("p22_m_excerpt", with_views(f"SELECT case_id, length(x) AS excerpt_length, md5(x) AS excerpt_md5 FROM (SELECT case_id, {_M_EXCERPT} AS x FROM rep)"))
def _(spark, d):
    x = V.reports(spark, d).select("case_id", text.m_excerpt(F.col("text")).alias("x"))
    return x.select("case_id", F.length("x").alias("excerpt_length"), F.md5("x").alias("excerpt_md5"))


AUDIT_EXCERPT_SQL = """CASE WHEN length(text) > 4000 AND evidence <> '' AND instr(lower(text), lower(evidence)) > 0 THEN
    (CASE WHEN instr(lower(text), lower(evidence)) - 1 - 1500 > 0 THEN '...' || chr(10) ELSE '' END
     || substr(text, greatest(instr(lower(text), lower(evidence)) - 1501, 0) + 1,
               least(instr(lower(text), lower(evidence)) - 1 + length(evidence) + 1500, length(text))
               - greatest(instr(lower(text), lower(evidence)) - 1501, 0))
     || CASE WHEN instr(lower(text), lower(evidence)) - 1 + length(evidence) + 1500 < length(text) THEN chr(10) || '...' ELSE '' END)
  ELSE text END"""
AUDIT_TRUNCATED_SQL = "coalesce(length(text) > 4000 AND evidence <> '' AND instr(lower(text), lower(evidence)) > 0, false)"


@query("p23_audit_excerpt", with_views(
    f"""SELECT case_id, arm, target, md5({AUDIT_EXCERPT_SQL}) AS excerpt_md5, {AUDIT_TRUNCATED_SQL} AS truncated
    FROM resp p JOIN (SELECT case_id, text FROM rep) r USING (case_id)"""), bools="truncated")
def _(spark, d):
    joined = V.responses(spark, d).join(V.reports(spark, d).select("case_id", "text"), "case_id")
    cut = joined.select("case_id", "arm", "target", text.audit_excerpt(F.col("text"), F.col("evidence")).alias("x"))
    return cut.select("case_id", "arm", "target", F.md5("x.report_excerpt").alias("excerpt_md5"),
                      F.col("x.report_truncated").alias("truncated"))


def _head_sql(limit: int) -> str:
    return (f"CASE WHEN length(text) > {limit} THEN substr(text, 1, {limit}) || chr(10) || chr(10) || "
            f"'[... truncated for audit sheet length ...]' ELSE text END")


@query("p24_sheet_truncation", with_views(
    f"SELECT case_id, md5({_head_sql(4000)}) AS head_4000_md5, md5({_head_sql(6000)}) AS head_6000_md5 FROM rep"))
def _(spark, d):
    return V.reports(spark, d).select("case_id", *(
        F.md5(text.head_with_mark(F.col("text"), n)).alias(f"head_{n}_md5") for n in (K.LEGACY_SHEET_MAX, K.BLIND_SHEET_MAX)))


@query("p25_personal_data_scrub", f"""SELECT doc_id, md5(clean) AS scrubbed_md5, clean <> text AS changed FROM (
    SELECT doc_id, text, regexp_replace(text, {pattern(K.PERSONAL_DATA)}, '[redacted]', 'g') AS clean FROM documents)""", bools="changed")
def _(spark, d):
    clean = V.table(spark, d, "documents").select("doc_id", "text", text.scrub_personal_data(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.md5("clean").alias("scrubbed_md5"), (F.col("clean") != F.col("text")).alias("changed"))


_SPAN_PATTERN = f"array_to_string([regexp_escape(w) for w in string_split({norm('evidence')}, ' ')], {lit(f'[.,{WS}]+')})"


@query("p26_span_location", with_views(f"""
    SELECT case_id, arm, target, length(pre) AS before_length, substr(text, length(pre) + 1, length(hit)) AS match,
           length(text) - length(pre) - length(hit) AS after_length
    FROM (SELECT case_id, arm, target, text, words,
            regexp_extract(lower(text), '(?s)^(.*?)(?:' || pat || ')', 1) AS pre, regexp_extract(lower(text), pat) AS hit
          FROM (SELECT case_id, arm, target, r.text, {norm('evidence')} AS words, {_SPAN_PATTERN} AS pat
                FROM resp p JOIN (SELECT case_id, text FROM rep) r USING (case_id)
                WHERE p.evidence IS NOT NULL AND {norm('evidence')} <> ''))
    WHERE hit <> ''"""))
def _(spark, d):
    return R.locate_spans(V.reports(spark, d), V.responses(spark, d)).select(
        "case_id", "arm", "target", F.length("s.before").alias("before_length"), F.col("s.match").alias("match"),
        F.length("s.after").alias("after_length"))


_SYSTEM_MAP = "MAP {" + ", ".join(f"{lit(a)}: {lit(t)}" for a, t in K.SYSTEM_TEXT.items()) + "}"


@query("p33_request_table", with_views(f"""SELECT case_id, arm, md5({_SYSTEM_MAP}[arm]) AS system_md5,
    md5('Pathology report:' || chr(10) || chr(10) || text) AS user_md5
    FROM rep, (SELECT unnest([{', '.join(lit(a) for a in K.SYSTEM_TEXT)}]) AS arm)"""))
def _(spark, d):
    return R.requests(V.reports(spark, d)).select(
        "case_id", "arm", F.md5("system").alias("system_md5"), F.md5("user").alias("user_md5"))


def raw_sql() -> str:
    """Raw answers of the damaged-JSON view, and their shape check by type names."""
    def field(t):
        return (f"max(CASE WHEN target = '{t}' THEN json_object('value', raw_value, 'evidence', evidence, "
                f"'confidence', confidence, 'reason', reason) END)")

    def ok(k):
        def kind(f):
            return f"json_type(raw, '$.{k}.{f}')"
        return (f"coalesce({kind('value')} IN ('VARCHAR', 'NULL') AND {kind('evidence')} IN ('VARCHAR', 'NULL') "
                f"AND {kind('confidence')} = 'VARCHAR' AND json_extract_string(raw, '$.{k}.confidence') IN ('high', 'medium', 'low') "
                f"AND coalesce({kind('reason')} IN ('VARCHAR', 'NULL'), true), false)")

    return f"""
ans AS (
  SELECT doc_id, case_id, arm_no, arm, (doc_id * 5 + arm_no) % 17 AS damage,
    '{{"T_stage":' || {field('T')} || ',"N_stage":' || {field('N')} AS partial, ',"M_stage":' || {field('M')} AS rest
  FROM resp GROUP BY ALL
),
raws AS MATERIALIZED (
  SELECT case_id, arm, CASE damage WHEN 0 THEN 'sorry: ' || partial || rest || '}}' WHEN 1 THEN partial || '}}'
    WHEN 2 THEN replace(partial || rest, '"confidence":"low"', '"confidence":"maybe"') || '}}'
    WHEN 3 THEN replace(partial || rest, '"reason":null', '"reason":7') || '}}'
    WHEN 4 THEN replace(partial || rest, '"evidence":null', '"other":null') || '}}'
    WHEN 5 THEN partial || rest || ',"pathologic_stage":null}}'
    WHEN 6 THEN partial || rest || ',"pathologic_stage":{{"value":"II"}}}}' ELSE partial || rest || '}}' END AS raw
  FROM ans
),
shaped AS MATERIALIZED (
  SELECT case_id, arm, raw, CASE WHEN NOT json_valid(raw) THEN true ELSE NOT ({ok('T_stage')} AND {ok('N_stage')} AND {ok('M_stage')}
    AND (json_type(raw, '$.pathologic_stage') IS NULL OR json_type(raw, '$.pathologic_stage') = 'NULL' OR {ok('pathologic_stage')})) END AS invalid
  FROM raws
)"""


_FIELDS_SQL = ", ".join(
    f"CASE WHEN NOT invalid THEN json_extract_string(raw, '$.{t}_stage.value') END AS {t}_value, "
    f"CASE WHEN NOT invalid THEN md5(json_extract_string(raw, '$.{t}_stage.evidence')) END AS {t}_evidence_md5" for t in K.TARGETS)


@query("p34_json_shape", with_views(f"SELECT case_id, arm, invalid, {_FIELDS_SQL} FROM shaped", raw_sql()), bools="invalid")
def _(spark, d):
    parsed = R.parse_raw(V.raw_answers(spark, d))
    return parsed.select("case_id", "arm", "invalid", *(
        c for t in K.TARGETS for c in (F.col(f"{t}_stage.value").alias(f"{t}_value"),
                                       F.md5(f"{t}_stage.evidence").alias(f"{t}_evidence_md5"))))


_DOMAIN = {t: ", ".join(lit(v) for v in K.ALLOWED_VALUES if v[0] == t) + ", 'unknown'" for t in K.TARGETS}


@query("p35_domain_violations", with_views("SELECT case_id, arm, target, list_filter([" + ", ".join((
    "CASE WHEN NOT coalesce(CASE target " + " ".join(f"WHEN '{t}' THEN raw_value IN ({_DOMAIN[t]})" for t in K.TARGETS)
    + " END, false) THEN target || ':value_outside_domain' END",
    "CASE WHEN NOT coalesce(confidence IN ('high', 'medium'), false) AND confidence <> 'low' THEN target || ':confidence_outside_domain' END",
    "CASE WHEN raw_value = 'unknown' AND coalesce(reason, '') = '' THEN target || ':reason_required' END",
)) + "], lambda x: x IS NOT NULL) AS violations FROM (SELECT * REPLACE (CASE WHEN sel = 7 THEN 'unknown' ELSE raw_value END AS raw_value) FROM resp)"),
    arrays="violations")
def _(spark, d):
    rows = V.responses(spark, d).withColumn("raw_value", F.when(
        F.col("raw_value").isNull(), "unknown").otherwise(F.col("raw_value")))
    field = F.struct(F.col("raw_value").alias("value"), "evidence", "confidence", "reason")
    by_target = R.by_target({t: labels.domain_violations(t, field) for t in K.TARGETS}, F.col("target"))
    return rows.select("case_id", "arm", "target", by_target.alias("violations"))


@query("p37_pool_predicate", with_views("""
    SELECT 'all-three' AS pool, case_id FROM rep WHERE gold_T IS NOT NULL AND gold_N IS NOT NULL AND gold_M IS NOT NULL
    UNION ALL SELECT 'any', case_id FROM rep WHERE coalesce(gold_T, gold_N, gold_M) IS NOT NULL"""))
def _(spark, d):
    parts = [dataset.pool(V.reports(spark, d), m).select(F.lit(m).alias("pool"), "case_id") for m in ("all-three", "any")]
    return parts[0].unionByName(parts[1])


INDICATORS_SQL = {
    "accuracy": "correct",
    "semantic_supported_accuracy_over_evaluable": "correct AND span AND sem",
    "span_unsupported_rate_over_evaluable": "NOT span",
    "semantic_unsupported_rate_over_evaluable": "(NOT span OR NOT sem)",
    "abstention_rate": "abstained",
    "coverage": "NOT abstained",
}


@query("p39_case_indicators", with_records("SELECT case_id, arm, target, " + ", ".join(
    f"CASE WHEN ground_truth IS NOT NULL THEN CASE WHEN {c} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS {m}" for m, c in INDICATORS_SQL.items())
    + " FROM records"), doubles=" ".join(INDICATORS_SQL))
def _(spark, d):
    return R.case_indicators(V.records(spark, d))


@query("p40_prediction_bucket", with_views(f"""SELECT case_id, arm, target, CASE
    WHEN target = 'T' AND prediction IN ('T1', 'T2', 'T3', 'T4') OR target = 'N' AND prediction IN ('N0', 'N1', 'N2', 'N3')
      OR target = 'M' AND prediction IN ('M0', 'M1') THEN prediction ELSE 'ABSTAIN_OR_INVALID' END AS bucket
    FROM (SELECT *, {norm_pred('raw_value')} AS prediction FROM resp)"""))
def _(spark, d):
    return V.responses(spark, d).select("case_id", "arm", "target", labels.prediction_bucket(
        F.col("target"), labels.norm_pred(F.col("raw_value"))).alias("bucket"))


@query("p41_legacy_arm_names", with_views("""SELECT case_id, arm, target,
    CASE arm WHEN 'A_zero_shot' THEN 'A' WHEN 'C_constrained' THEN 'C' WHEN 'D_grounded' THEN 'D' END AS letter,
    CASE arm WHEN 'C_plus_unknown' THEN NULL ELSE arm END AS back FROM resp"""))
def _(spark, d):
    letter = labels.legacy_from_arm(F.col("arm"))
    return V.responses(spark, d).select("case_id", "arm", "target", letter.alias("letter"),
                                        labels.arm_from_legacy(letter).alias("back"))

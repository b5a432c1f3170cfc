"""Label domains, word patterns, arm names, request texts and display formats.

Everything in this module is a value that results depend on, so it is stated as plain text and
kept in one place.  Patterns are templates shared by every caller; the angle-bracket marks stand for

    <L>  not preceded by a word character        <R>  not followed by a word character
    <S>  one white-space character               <D>  one decimal digit
    <W>  one word character (letter, number or underscore)

``spanledger.functions.patterns`` turns a template into a Java regular expression.
"""

from __future__ import annotations

# --------------------------------------------------------------------------- label domains
TARGETS = ("T", "N", "M")

ALLOWED_VALUES = (
    "T0", "T1", "T2", "T3", "T4", "TX",
    "N0", "N1", "N2", "N3", "NX",
    "M0", "M1", "MX",
)
UNKNOWN = "unknown"
INVALID = "INVALID"
DOMAIN = ALLOWED_VALUES + (UNKNOWN,)

# First character after the letter, per target, in a token that can support a value.
TOKEN_SUFFIXES = {"T": "01234X", "N": "0123X", "M": "01X"}
# The source-boundary check accepts the same suffixes for every letter.
BOUNDARY_SUFFIXES = "01234X"

CLASS_SPACE = {
    "T": ("T1", "T2", "T3", "T4"),
    "N": ("N0", "N1", "N2", "N3"),
    "M": ("M0", "M1"),
}
ABSTAIN_BUCKET = "ABSTAIN_OR_INVALID"

CONFIDENCE_LEVELS = ("high", "medium", "low")

# --------------------------------------------------------------------------- arms
ARM_ZERO_SHOT = "A_zero_shot"
ARM_FEW_SHOT = "B_few_shot"
ARM_CONSTRAINED = "C_constrained"
ARM_CONSTRAINED_UNKNOWN = "C_plus_unknown"
ARM_GROUNDED = "D_grounded"

# arm, legacy letter, unknown allowed, evidence required, unknown encouraged
ARM_TABLE = (
    (ARM_ZERO_SHOT, "A", True, False, False),
    (ARM_FEW_SHOT, "B", True, False, False),
    (ARM_CONSTRAINED, "C", True, False, False),
    (ARM_CONSTRAINED_UNKNOWN, None, True, False, True),
    (ARM_GROUNDED, "D", True, True, True),
)
STUDY_ARMS = (ARM_ZERO_SHOT, ARM_CONSTRAINED, ARM_CONSTRAINED_UNKNOWN, ARM_GROUNDED)
LEGACY_ARMS = ("A", "B", "C", "D")

# arm pairs (a, b) compared as metric(a) - metric(b)
COMPARISON_PAIRS = (
    (ARM_GROUNDED, ARM_CONSTRAINED),
    (ARM_CONSTRAINED_UNKNOWN, ARM_CONSTRAINED),
    (ARM_GROUNDED, ARM_CONSTRAINED_UNKNOWN),
)

# --------------------------------------------------------------------------- metrics
COMPARISON_METRICS = (
    "accuracy",
    "semantic_supported_accuracy_over_evaluable",
    "span_unsupported_rate_over_evaluable",
    "semantic_unsupported_rate_over_evaluable",
    "abstention_rate",
    "coverage",
)
METRIC_LABELS = {
    "accuracy": "Accuracy",
    "semantic_supported_accuracy_over_evaluable": "Semantic Supported Accuracy",
    "span_unsupported_rate_over_evaluable": "Span Unsupported Rate",
    "semantic_unsupported_rate_over_evaluable": "Semantic Unsupported Rate",
    "abstention_rate": "Abstention Rate",
    "coverage": "Coverage",
}
REPLICATION_METRICS = (
    "accuracy",
    "coverage",
    "abstention_rate",
    "span_unsupported_rate_over_evaluable",
    "semantic_unsupported_rate_over_evaluable",
    "semantic_supported_accuracy_over_evaluable",
)
NEAR_HIGHEST_MARGIN = 0.02
LARGE_GAP = 0.1
MIN_EVALUABLE_FOR_M_FIGURE = 10

# --------------------------------------------------------------------------- error flags and tags
ERROR_FLAGS = (
    "hallucinated_stage",
    "wrong_stage_with_supporting_evidence",
    "evidence_span_not_found",
    "evidence_does_not_support_prediction",
    "missed_explicit_stage",
    "over_abstention",
    "invalid_normalization",
    "invalid_schema_output",
    "other",
)
BOUNDARY_TAGS = (
    "correct",
    "source_boundary_abstention",
    "over_abstention",
    "unsupported_error",
    "report_gold_discordance",
)
ARM_PATTERNS = (
    "both_predict",
    "priority_predicts_comparison_abstains",
    "priority_abstains_comparison_predicts",
    "both_abstain",
    "pattern_unknown",
)

# --------------------------------------------------------------------------- evidence patterns
EVIDENCE_WINDOW = 50
NEGATION_BEFORE_VERB = 20
NEGATION_BEFORE_METASTASIS = 30

LYMPH_NODE = r"lymph<S>*nodes?|sentinel<S>*(?:lymph<S>*)?nodes?"
NODE_COUNT = r"<L>(<D>+)<S>*(?:/|out of|of)<S>*(<D>+)<R>"
NEGATIVE_WORD = r"<L>(?:no|none|negative|free of|without evidence of|not<S>+identified)<R>"
POSITIVE_NODE_WORD = r"metastat|positive|involve"
INVASION_VERB = (
    r"<L>(?:invad(?:e[sd]?|ing)|invasion|extend(?:s|ed|ing)?|extension|penetrat(?:e[sd]?|ing|ion))<R>"
)
DEEP_STRUCTURE = (
    r"muscularis<S>+propria|perivesical|pericolonic|pericolic|serosa|"
    r"adipose|diaphragm<W>*|parenchyma|pleura<W>*|renal<S>+sinus|"
    r"extrathyroidal|capsul<W>*|adjacent<S>+(?:organ|structure)"
)
NEGATION_BEFORE = r"<L>(?:no|not|without|free of|absent|negative for)<R>"
TUMOR_SIZE = r"<L>tumor<S>+size<R>|<L><D>+(?:\.<D>+)?<S>*cm<R>"
DISTANT_METASTASIS = r"distant<S>+metastas<W>*"

EVIDENCE_CATEGORIES = (
    "explicit_stage_token",
    "regional_node_negative",
    "regional_node_positive",
    "local_invasion",
    "tumor_size",
    "distant_metastasis_positive",
    "distant_metastasis_negative",
    "unknown",
)

M_TOKEN = r"<L>p?M[01X][A-Za-z0-9]*<R>"
METASTATIC_WORD = r"<L>metasta(?:sis|tic|ses)<R>"
HEDGE = (
    r"<L>(?:cannot be (?:assessed|determined)|indeterminate|rule out|"
    r"suspicious for|possible metasta<W>*|pending(?: further)?|equivocal)<R>"
)
M_CLASSES = (
    "explicit_m_token",
    "metastatic_described_no_token",
    "no_m_evidence",
    "ambiguous_insufficient",
)
M_EXCERPT_WINDOW = 150
M_EXCERPT_HEAD = 1000

AUDIT_EXCERPT_MAX = 4000
AUDIT_EXCERPT_WINDOW = 1500
ELLIPSIS_BEFORE = "...\n"
ELLIPSIS_AFTER = "\n..."
LEGACY_SHEET_MAX = 4000
BLIND_SHEET_MAX = 6000
TRUNCATION_MARK = "\n\n[... truncated for audit sheet length ...]"

PERSONAL_DATA = (
    r"(MRN<S>*[:#]?<S>*<N>+|DOB<S>*[:#]?<S>*<N>+|Date of Birth<S>*[:#]?<S>*<N>+|"
    r"SSN<S>*[:#]?<S>*<N>+|Social Security<S>*<N>*|Phone<S>*[:#]?<S>*<N>+|"
    r"<L>Dr\.<S>+[A-Z][a-z]+|Mr\.<S>+[A-Z][a-z]+|Mrs\.<S>+[A-Z][a-z]+|Ms\.<S>+[A-Z][a-z]+)"
)
PERSONAL_DATA_MARK = "[redacted]"

# --------------------------------------------------------------------------- curated examples
EXAMPLE_TITLES = (  # tag, title; in order of priority
    ("c_asserts_d_abstains", "Constrained asserts, grounded abstains"),
    ("evidence_binding_change", "Evidence binding changes behavior"),
    ("m0_unsupported", "M0 base-rate pattern"),
    ("wrong_grounded", "Grounded but incorrect"),
    ("span_not_supporting", "Real span, unsupported claim"),
    ("correct_unsupported", "Correct but unsupported"),
    ("abstained", "Abstains rather than guess"),
    ("correct_grounded", "Correct and grounded"),
)
EXAMPLE_FALLBACK_TITLE = "Ablation example"
EXAMPLE_QUOTAS = (  # tag, quota; in order of selection
    ("correct_grounded", 2),
    ("correct_unsupported", 2),
    ("wrong_grounded", 2),
    ("abstained", 1),
    ("m0_unsupported", 2),
    ("span_not_supporting", 1),
    ("evidence_binding_change", 2),
    ("c_asserts_d_abstains", 2),
)

# --------------------------------------------------------------------------- audits
BLIND_QUOTAS = (  # boundary tag, legacy arm, rows
    ("source_boundary_abstention", "A", 2),
    ("source_boundary_abstention", "B", 3),
    ("source_boundary_abstention", "C", 2),
    ("source_boundary_abstention", "D", 2),
    ("unsupported_error", "A", 3),
    ("unsupported_error", "B", 1),
    ("unsupported_error", "C", 4),
    ("report_gold_discordance", "A", 2),
    ("report_gold_discordance", "B", 2),
    ("report_gold_discordance", "C", 2),
    ("report_gold_discordance", "D", 2),
)
AUDIT_MODES = ("grounding-blind", "with-gold")

# --------------------------------------------------------------------------- request texts
REQUEST_SHAPE = """Return ONLY a JSON object with this shape:
{
  "T_stage": {"value": ..., "evidence": ..., "confidence": "high|medium|low", "reason": ...},
  "N_stage": {...},
  "M_stage": {...}
}
"evidence" is a verbatim span copied from the report, or null.
"reason" may be null."""

REQUEST_TASK = "You extract TNM pathologic staging from pathology reports."

REQUEST_EXAMPLES = """Examples:

Report: "Primary tumor pT2 invades muscularis. Nodes: 0/9 negative. No distant metastasis identified (pM0)."
{"T_stage":{"value":"T2","evidence":"Primary tumor pT2 invades muscularis","confidence":"high","reason":null},
 "N_stage":{"value":"N0","evidence":"Nodes: 0/9 negative","confidence":"high","reason":null},
 "M_stage":{"value":"M0","evidence":"No distant metastasis identified (pM0)","confidence":"high","reason":null}}

Report: "Invasive carcinoma, pT3. 2 of 14 regional lymph nodes involved."
{"T_stage":{"value":"T3","evidence":"Invasive carcinoma, pT3","confidence":"high","reason":null},
 "N_stage":{"value":"N1","evidence":"2 of 14 regional lymph nodes involved","confidence":"high","reason":null},
 "M_stage":{"value":"unknown","evidence":null,"confidence":"low","reason":"report does not mention distant metastasis"}}
"""

REQUEST_DOMAIN = """Allowed values (use EXACTLY one per field):
  T: T0 T1 T2 T3 T4 TX unknown
  N: N0 N1 N2 N3 NX unknown
  M: M0 M1 MX unknown
"""

REQUEST_PREFER_UNKNOWN = (
    "If the report does not clearly support a specific stage value, you "
    "should output \"unknown\" rather than guess. 'unknown' is a normal, "
    "encouraged answer when the evidence is not there -- it is not a failure.\n"
)

REQUEST_RULES = """Rules:
- 'evidence' MUST be a verbatim substring copied from the report. Do not paraphrase or invent it.
- If the report contains NO basis for a value, output "unknown" with a non-null 'reason'. Do NOT guess.
- TX/NX/MX mean the report explicitly says the stage was assessed but indeterminate. This is different from 'unknown'.
"""

SYSTEM_TEXT = {
    ARM_ZERO_SHOT: f"{REQUEST_TASK} {REQUEST_SHAPE}",
    ARM_FEW_SHOT: f"{REQUEST_TASK} {REQUEST_SHAPE}\n\n{REQUEST_EXAMPLES}",
    ARM_CONSTRAINED: f"{REQUEST_TASK}\n{REQUEST_DOMAIN}{REQUEST_SHAPE}",
    ARM_CONSTRAINED_UNKNOWN: f"{REQUEST_TASK}\n{REQUEST_DOMAIN}{REQUEST_PREFER_UNKNOWN}{REQUEST_SHAPE}",
    ARM_GROUNDED: f"{REQUEST_TASK}\n{REQUEST_DOMAIN}{REQUEST_RULES}{REQUEST_SHAPE}",
}
USER_TEXT_PREFIX = "Pathology report:\n\n"

"""Does a quoted piece of evidence say what was predicted?  Native column expressions only.

Every signal looks at the first anchor phrase and at a window of characters around it.  The
window is cut out first and searched afterwards, so a phrase split by its edge is not seen whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanledger import constants as K
from spanledger.functions.labels import value_supported_by_text
from spanledger.functions.patterns import cut, first_hit, found, java

NEGATIVE, POSITIVE = "negative", "positive"


def node_status(text: Column) -> Column:
    """'negative', 'positive' or NULL from the first mention of lymph nodes; counts beat words."""
    hit, start, end = first_hit(text, K.LYMPH_NODE)
    window = cut(text, start - K.EVIDENCE_WINDOW, end + K.EVIDENCE_WINDOW)
    positive_nodes = F.regexp_extract(window, java(K.NODE_COUNT), 1)
    return F.when(
        hit,
        F.when(positive_nodes != "", F.when(positive_nodes.rlike("^0+$"), NEGATIVE).otherwise(POSITIVE))
        .when(found(window, K.NEGATIVE_WORD), NEGATIVE)
        .when(found(window, K.POSITIVE_NODE_WORD), POSITIVE),
    )


def local_invasion(text: Column) -> Column:
    """True when the first invasion verb is not negated and stands near a deep structure."""
    hit, start, end = first_hit(text, K.INVASION_VERB)
    before = cut(text, start - K.NEGATION_BEFORE_VERB, start)
    around = cut(text, start - K.EVIDENCE_WINDOW, end + K.EVIDENCE_WINDOW)
    deep = hit & ~found(before, K.NEGATION_BEFORE) & found(around, K.DEEP_STRUCTURE)
    return F.when(text.isNotNull(), F.coalesce(deep, F.lit(False)))


def tumor_size(text: Column) -> Column:
    return found(text, K.TUMOR_SIZE)


def distant_metastasis(text: Column) -> Column:
    """'negative', 'positive' or NULL from the first mention of distant metastasis."""
    hit, start, _ = first_hit(text, K.DISTANT_METASTASIS)
    before = cut(text, start - K.NEGATION_BEFORE_METASTASIS, start)
    return F.when(hit, F.when(found(before, K.NEGATIVE_WORD), NEGATIVE).otherwise(POSITIVE))


def evidence_categories(evidence: Column, prediction: Column) -> Column:
    """Sorted array of the kinds of evidence in a quote; ['unknown'] if none, [] for no quote."""
    nodes, spread = node_status(evidence), distant_metastasis(evidence)
    tags = F.array_sort(F.array_compact(F.array(
        F.when(value_supported_by_text(prediction, evidence), "explicit_stage_token"),
        F.when(nodes == NEGATIVE, "regional_node_negative"),
        F.when(nodes == POSITIVE, "regional_node_positive"),
        F.when(local_invasion(evidence), "local_invasion"),
        F.when(tumor_size(evidence), "tumor_size"),
        F.when(spread == POSITIVE, "distant_metastasis_positive"),
        F.when(spread == NEGATIVE, "distant_metastasis_negative"),
    )))
    nothing = F.array().cast("array<string>")
    return F.when(evidence.isNull() | (evidence == ""), nothing).otherwise(
        F.when(F.size(tags) == 0, F.array(F.lit("unknown"))).otherwise(tags)
    )


def semantic_support(prediction: Column, evidence: Column, target: Column) -> Column:
    """True when the quote supports the prediction for this target; false whenever unclear.

    An explicit token decides first.  Prose then supports N0/N1 by node status, T2-T4 by local
    invasion, and M0/M1 by distant metastasis; nothing else.
    """
    wanted = F.when(prediction.isin("N0", "M0"), NEGATIVE).when(prediction.isin("N1", "M1"), POSITIVE)
    by_prose = (
        F.when(F.substring(prediction, 1, 1) != target, False)
        .when(target == "N", node_status(evidence) == wanted)
        .when(target == "M", distant_metastasis(evidence) == wanted)
        .when(prediction.isin("T2", "T3", "T4"), local_invasion(evidence))
    )
    usable = (evidence != "") & ~prediction.isin(K.UNKNOWN, K.INVALID)
    return F.when(
        F.coalesce(usable, F.lit(False)),
        F.when(value_supported_by_text(prediction, evidence), True)
        .otherwise(F.coalesce(by_prose, F.lit(False))),
    ).otherwise(False)

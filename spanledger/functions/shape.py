"""Shape check of raw JSON answers: keys and types, never the value domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanledger import constants as K

_NULL_OR_TEXT = ("VOID", "STRING")


def _type_at(doc: Column, path: str) -> Column:
    """Type name at a path: NULL when the key is absent, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def _field_ok(doc: Column, key: str) -> Column:
    confidence = F.try_variant_get(doc, f"$.{key}.confidence", "string")
    ok = (
        _type_at(doc, f"$.{key}.value").isin(*_NULL_OR_TEXT)
        & _type_at(doc, f"$.{key}.evidence").isin(*_NULL_OR_TEXT)
        & (_type_at(doc, f"$.{key}.confidence") == "STRING")
        & confidence.isin(*K.CONFIDENCE_LEVELS)
        & F.coalesce(_type_at(doc, f"$.{key}.reason").isin(*_NULL_OR_TEXT), F.lit(True))
    )
    return F.coalesce(ok, F.lit(False))


def parse_document(raw: Column) -> Column:
    """Variant of the raw answer, NULL when it is not JSON."""
    return F.try_parse_json(raw)


def shape_valid(doc: Column) -> Column:
    """True when the three stage fields are complete and the optional group stage is absent,
    null or complete.  A missing key is an error, a null value is not, a number is."""
    fields = reduce(lambda a, b: a & b, [_field_ok(doc, f"{t}_stage") for t in K.TARGETS])
    group_type = _type_at(doc, "$.pathologic_stage")
    group_ok = group_type.isNull() | (group_type == "VOID") | _field_ok(doc, "pathologic_stage")
    return F.coalesce(doc.isNotNull() & fields & group_ok, F.lit(False))


def stage_field(doc: Column, target: str) -> Column:
    """Struct(value, evidence, confidence, reason) of one target."""
    return F.struct(*(
        F.try_variant_get(doc, f"$.{target}_stage.{k}", "string").alias(k)
        for k in ("value", "evidence", "confidence", "reason")
    ))

"""The passages of the benchmark, searched in all reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.oracle_base import norm, with_views
from catalog.registry import query
from spanledger.functions.text import matching_form
from spanledger.operators import passages

_FORMS = f"report_forms AS MATERIALIZED (SELECT case_id, {norm('text')} AS form FROM rep)"
_PASSAGES = f"passage_forms AS MATERIALIZED (SELECT item_id, {norm('text')} AS passage FROM benchmark)"


@query("p6_passages_in_reports", with_views(
    "SELECT item_id, case_id FROM passage_forms, report_forms WHERE passage <> '' AND contains(form, passage)", _FORMS, _PASSAGES))
def _(spark, d):
    asked = V.table(spark, d, "benchmark").select(F.col("item_id").alias("passage_id"), "text")
    return passages.find_passages(asked, V.reports(spark, d)).withColumnRenamed("passage_id", "item_id")


@query("p6_short_passages_in_reports", with_views("""
    SELECT item_id, part, count(*) AS n_reports, min(case_id) AS first_case, max(case_id) AS last_case
    FROM (SELECT item_id, 'two' AS part, split_part(passage, ' ', 1) || ' ' || split_part(passage, ' ', 2) AS words FROM passage_forms
          UNION ALL SELECT item_id, 'one', split_part(passage, ' ', 3) FROM passage_forms
          UNION ALL SELECT item_id, 'cut', substr(passage, 2, 14) FROM passage_forms) p, report_forms
    WHERE trim(words) <> '' AND contains(form, trim(words)) GROUP BY item_id, part""", _FORMS, _PASSAGES))
def _(spark, d):
    """Beginnings of the passages: two words, the third word alone, and a cut that starts and ends inside words."""
    form = matching_form(F.col("text"))
    word = F.split(form, " ")
    parts = F.explode(F.array(
        F.struct(F.lit("two").alias("part"), F.concat(F.get(word, F.lit(0)), F.lit(" "), F.get(word, F.lit(1))).alias("text")),
        F.struct(F.lit("one").alias("part"), F.get(word, F.lit(2)).alias("text")),
        F.struct(F.lit("cut").alias("part"), F.substring(form, 2, 14).alias("text"))))
    asked = V.table(spark, d, "benchmark").select("item_id", parts.alias("p")).select(
        F.concat_ws("|", "item_id", "p.part").alias("passage_id"), "p.text")
    found = passages.find_passages(asked, V.reports(spark, d)).groupBy("passage_id").agg(
        F.count(F.lit(1)).alias("n_reports"), F.min("case_id").alias("first_case"), F.max("case_id").alias("last_case"))
    return found.select(F.split("passage_id", r"\|")[0].cast("long").alias("item_id"), F.split("passage_id", r"\|")[1].alias("part"),
                        "n_reports", "first_case", "last_case")

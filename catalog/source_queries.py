"""Sources and sinks: derived tables are written with a sink, read back with a source and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.join_queries import registry_sql
from catalog.metric_queries import _BUNDLE, BASE, bundle
from catalog.oracle_base import with_boundary, with_records, with_views
from catalog.registry import query
from catalog.sample_queries import _GRID, _JUDGED, _PATTERNS, REVIEWS, agreement_sql, grid
from catalog.scalar_queries import raw_sql
from spanledger import constants as K
from spanledger.operators import metrics
from spanledger.plans import audits
from spanledger.session import materialize, scratch_path
from spanledger.sources import documents, jsonl, tables
from spanledger.streaming import resume


@query("s1_csv_reports", with_views("SELECT patient_filename, md5(text) AS text_md5, length(text) AS text_length FROM rep"))
def _(spark, d):
    path = scratch_path(spark, "reports-csv")
    tables.write_csv(V.raw_reports(spark, d), path)
    return tables.read_reports(spark, path).select(
        "patient_filename", F.md5("text").alias("text_md5"), F.length("text").alias("text_length"))


@query("s2_registry_csv_first_row", with_views(" UNION ALL ".join(
    f"SELECT '{t}' AS target, case_submitter_id, arg_min(raw, row_no) AS raw, arg_min(project_id, row_no) AS project_id FROM {registry_sql(t)} GROUP BY ALL"
    for t in K.TARGETS)))
def _(spark, d):
    from spanledger.operators.dataset import first_row_per_key

    out = None
    for t in K.TARGETS:
        path, raw = scratch_path(spark, f"registry-{t}"), f"ajcc_pathologic_{t.lower()}"
        ordered = V.registry(spark, d, t).orderBy("row_no").select("case_submitter_id", raw, "project_id")
        tables.write_csv(ordered, path)
        first = first_row_per_key(tables.read_registry(spark, path, t), "case_submitter_id", "row_no", [raw, "project_id"])
        part = first.select(F.lit(t).alias("target"), "case_submitter_id", F.col(raw).alias("raw"), "project_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("s3_overlap_and_baseline_csv", with_views(
    """SELECT case_id, target, 'baseline' AS system, gold, baseline_prediction AS prediction, baseline_prediction = gold AS correct,
    baseline_confidence, input_token_count, was_truncated FROM base""", BASE.split("),\nsystems AS")[0] + ")"),
    bools="correct was_truncated", doubles="baseline_confidence", longs="input_token_count")
def _(spark, d):
    rows = V.baseline_rows(spark, d)
    path, lists = scratch_path(spark, "baseline-csv"), {}
    tables.write_csv(rows, path)
    for t in K.TARGETS:
        lists[t] = scratch_path(spark, f"overlap-{t}")
        tables.write_csv(V.overlap(spark, d).filter(F.col("target") == t).select("case_id", "gold"), lists[t])
    overlap = tables.read_overlap(spark, lists)
    return tables.read_baseline(spark, path).join(overlap.drop("gold"), ["case_id", "target"], "left_semi").select(
        "case_id", "target", "system", "gold", "prediction", "correct", "baseline_confidence", "input_token_count", "was_truncated")


@query("s4_s5_parquet_columns", with_views("SELECT case_id, gold_T, gold_N, gold_M FROM rep"))
def _(spark, d):
    path = scratch_path(spark, "dataset")
    tables.write_parquet(V.reports(spark, d), path)
    return tables.read_parquet(spark, path, ["case_id", "gold_T", "gold_N", "gold_M"])


_RECORD_SQL = """SELECT case_id, arm, target, ground_truth, prediction, md5(evidence) AS evidence_md5, correct, abstained, span AS evidence_span_found,
  {sem} AS evidence_semantically_supports_prediction, errors, CASE WHEN shape_valid THEN raw_value END AS raw_value FROM records"""
_RECORD_BOOLS = "correct abstained evidence_span_found evidence_semantically_supports_prediction"


def _record_view(df):
    return df.select("case_id", "arm", "target", "ground_truth", "prediction", F.md5("evidence").alias("evidence_md5"), "correct", "abstained",
                     "evidence_span_found", "evidence_semantically_supports_prediction", "errors", F.col("raw_model_output")["value"].alias("raw_value"))


@query("s6_s7_record_lines", with_records(_RECORD_SQL.format(sem="sem")), bools=_RECORD_BOOLS, arrays="errors")
def _(spark, d):
    path = scratch_path(spark, "records")
    jsonl.write_lines(V.records(spark, d), path)
    return _record_view(jsonl.read_records(spark, path))


@query("s6_legacy_record_lines", with_records(_RECORD_SQL.format(sem="CAST(NULL AS BOOLEAN)")), bools=_RECORD_BOOLS, arrays="errors")
def _(spark, d):
    path = scratch_path(spark, "old-records")
    old = V.records(spark, d).withColumnRenamed("evidence_span_found", "supported").drop("evidence_semantically_supports_prediction")
    jsonl.write_lines(old.withColumn("extra_key", F.lit("ignored")), path)
    return _record_view(jsonl.read_records(spark, path))


@query("s8_audit_lines", with_records("SELECT audit_id, case_id, prediction, span AS automated_evidence_span_found, errors AS automated_errors FROM reviews",
       _PATTERNS, REVIEWS), bools="automated_evidence_span_found", arrays="automated_errors")
def _(spark, d):
    path = scratch_path(spark, "key")
    key = V.records(spark, d).select(
        F.concat_ws("|", "case_id", "arm", "target").alias("audit_id"), "case_id", "arm", "target", "ground_truth", "prediction",
        F.col("evidence_span_found").alias("automated_evidence_span_found"),
        F.col("evidence_semantically_supports_prediction").alias("automated_semantic_support"),
        F.col("errors").alias("automated_errors"), F.lit(None).cast("string").alias("arm_pattern"))
    jsonl.write_lines(key, path)
    return jsonl.read_audit(spark, path, key=True).select(
        "audit_id", "case_id", "prediction", "automated_evidence_span_found", "automated_errors")


@query("s9_plain_checkpoint", with_views("SELECT case_id, arm, invalid, md5(raw) AS raw_md5 FROM shaped", raw_sql()), bools="invalid")
def _(spark, d):
    """A plain folder of lines with every key twice, in the order of its files; the later line counts."""
    path = scratch_path(spark, "plain-checkpoint")
    scored = V.raw_answers(spark, d).withColumn("failed", F.lit(False)).withColumn("outcome", F.lit(resume.DONE))
    good = resume.to_results(scored).withColumn("turn", F.lit(1))
    old = good.withColumns({"raw": F.lit("old"), "invalid": ~F.col("invalid"), "turn": F.lit(0)})
    lines = old.unionByName(good).orderBy("turn", "case_id", "arm").drop("turn", "outcome")
    lines.write.option("ignoreNullFields", False).json(path)
    return resume.read_checkpoint(spark, path).select("case_id", "arm", "invalid", F.md5("raw").alias("raw_md5"))


@query("s9_s10_checkpoint_last_wins", with_views("SELECT case_id, arm, invalid, md5(raw) AS raw_md5 FROM shaped", raw_sql()), bools="invalid")
def _(spark, d):
    path = scratch_path(spark, "checkpoint")
    scored = V.raw_answers(spark, d).withColumn("failed", F.lit(False)).withColumn("outcome", F.lit(resume.DONE))
    stale = scored.withColumn("raw", F.lit("ERROR: replaced by the second batch"))
    for batch, rows in enumerate((stale, scored)):
        resume.append_results(resume.to_results(rows), path, batch)
    return resume.read_checkpoint(spark, path).select("case_id", "arm", "invalid", F.md5("raw").alias("raw_md5"))


@query("s11_json_array", with_boundary("SELECT case_id, judge_tag AS reconstructed_tag, caveat FROM judged", _JUDGED))
def _(spark, d):
    path = scratch_path(spark, "judgments")
    jsonl.write_arrays(V.judgments(spark, d)[0], path)
    return jsonl.read_array(spark, path, jsonl.JUDGMENT, multi_line=False)


@query("s11_json_array_files", with_boundary("SELECT case_id, judge_tag AS reconstructed_tag, caveat FROM judged", _JUDGED))
def _(spark, d):
    """One array per file, over many lines each."""
    path = scratch_path(spark, "judgment-files")
    jsonl.write_arrays(V.judgments(spark, d)[0], path, rows_per_array=200, one_per_file=True)
    return jsonl.read_array(spark, path, jsonl.JUDGMENT)


def _case_dataset(spark, d):
    path = scratch_path(spark, "cases")
    documents.write_documents(documents.case_documents(V.reports(spark, d), V.boundary(spark, d)), path)
    return documents.read_cases(spark, path)


_LETTER_OR_ARM = "CASE arm WHEN 'A_zero_shot' THEN 'A' WHEN 'C_constrained' THEN 'C' WHEN 'D_grounded' THEN 'D' ELSE arm END"


@query("s12_case_documents", with_boundary(
    f"SELECT case_id, {_LETTER_OR_ARM} AS arm, target, gold, value, value_norm, md5(evidence) AS evidence_md5, confidence, grounded, boundary_tag FROM bnd"),
    bools="grounded")
def _(spark, d):
    flat = documents.case_predictions(_case_dataset(spark, d))
    return flat.select("case_id", "arm", "target", "gold", "value", "value_norm", F.md5("evidence").alias("evidence_md5"), "confidence",
                       "grounded", "boundary_tag")


@query("s17_case_summaries", with_boundary(f"""SELECT case_id AS id, max(gold) AS gold_M, """ + ", ".join(
    f"max(value_norm) FILTER (WHERE letter = '{a}') AS {a}_M, max(boundary_tag) FILTER (WHERE letter = '{a}') AS {a}_tag" for a in K.LEGACY_ARMS)
    + f" FROM (SELECT *, {_LETTER_OR_ARM} AS letter FROM bnd WHERE target = 'M') GROUP BY case_id"))
def _(spark, d):
    return documents.case_summaries(_case_dataset(spark, d))


@query("s17_case_lookup", with_boundary(f"""SELECT case_id AS id, max(gold) AS gold_M, """ + ", ".join(
    f"max(value_norm) FILTER (WHERE letter = '{a}') AS {a}_M, max(boundary_tag) FILTER (WHERE letter = '{a}') AS {a}_tag" for a in K.LEGACY_ARMS)
    + f""" FROM (SELECT *, {_LETTER_OR_ARM} AS letter FROM bnd WHERE target = 'M')
    WHERE case_id IN (SELECT 'D' || lpad(CAST(doc_id AS VARCHAR), 12, '0') FROM labels WHERE toxic = 1) GROUP BY case_id"""))
def _(spark, d):
    """Cases of labelled documents, looked up in a store that is laid out by the hash of the id."""
    path = scratch_path(spark, "case-store")
    documents.write_case_store(_case_dataset(spark, d), path, buckets=64)
    ids = V.table(spark, d, "labels").filter("toxic = 1").select(F.expr(V.CASE_ID).alias("patient_id"))
    return documents.case_summaries(documents.look_up_cases(documents.read_case_store(spark, path), ids))


@query("s13_csv_table", with_records("SELECT arm, target, n_evaluable, accuracy, coverage FROM bundle", _BUNDLE), doubles="accuracy coverage")
def _(spark, d):
    path = scratch_path(spark, "table-csv")
    tables.write_csv(metrics.comparison_table(bundle(spark, d)), path, single_file=True)
    return spark.read.option("header", True).schema(
        "arm string, target string, n_evaluable long, accuracy double, semantic_supported_accuracy double, span_unsupported_rate double, "
        "semantic_unsupported_rate double, abstention_rate double, coverage double").csv(path).select(
        "arm", "target", "n_evaluable", "accuracy", "coverage")


_METRIC = "struct<n_total:long,n_evaluable:long,accuracy:double,coverage:double,evidence_span_found_rate:double>"


@query("s14_metrics_document", with_records(
    "SELECT arm, target, n_total, n_evaluable, accuracy, coverage, evidence_span_found_rate FROM bundle WHERE target <> 'overall'", _BUNDLE),
    doubles="accuracy coverage evidence_span_found_rate")
def _(spark, d):
    path = scratch_path(spark, "metrics-json")
    documents.write_documents(documents.metrics_document(bundle(spark, d), by_target=True), path)
    doc = spark.read.text(path).select(F.from_json("value", f"map<string,map<string,{_METRIC}>>").alias("m"))
    per_arm = doc.select(F.explode("m").alias("arm", "t")).select("arm", F.explode("t").alias("target", "v"))
    return per_arm.select("arm", "target", "v.*")


@query("s14_error_document", with_records(
    "SELECT arm, target, e AS flag, count(*) AS count FROM (SELECT arm, target, unnest(errors) AS e FROM records) GROUP BY ALL"))
def _(spark, d):
    path = scratch_path(spark, "errors-json")
    documents.write_documents(documents.error_document(metrics.error_breakdown(V.records(spark, d))), path)
    doc = spark.read.text(path).select(F.from_json("value", "map<string,map<string,map<string,long>>>").alias("m"))
    return doc.select(F.explode("m").alias("arm", "t")).select("arm", F.explode("t").alias("target", "c")).select(
        "arm", "target", F.explode("c").alias("flag", "count"))


@query("s14_bootstrap_document", with_records(
    "SELECT scope, metric, arm_a, arm_b, diff, ci_low, ci_high, CAST(p_value AS DOUBLE) AS p_value, n_paired_cases FROM grid", *_GRID),
    doubles="diff ci_low ci_high p_value")
def _(spark, d):
    path = scratch_path(spark, "bootstrap-json")
    documents.write_documents(documents.bootstrap_document(grid(spark, d)), path)
    row = "array<struct<metric_name:string,arm_a:string,arm_b:string,diff:double,ci_low:double,ci_high:double,p_value:double,n_paired_cases:long>>"
    doc = spark.read.text(path).select(F.from_json("value", f"map<string,map<string,{row}>>").alias("m"))
    return doc.select(F.explode("m").alias("scope", "t")).select("scope", F.explode("t").alias("metric", "rows")).select(
        "scope", "metric", F.explode("rows").alias("r")).select(
        "scope", "metric", "r.arm_a", "r.arm_b", "r.diff", "r.ci_low", "r.ci_high", "r.p_value", "r.n_paired_cases")


@query("s18_metrics_without_nan", with_records(
    "SELECT arm, target, accuracy, accuracy_over_asserted FROM bundle", _BUNDLE), doubles="accuracy accuracy_over_asserted")
def _(spark, d):
    path = scratch_path(spark, "metrics")
    nan = F.lit(float("nan"))
    full = bundle(spark, d).select("arm", "target", *(F.coalesce(c, nan).alias(c) for c in ("accuracy", "accuracy_over_asserted")))
    tables.write_parquet(full, path)
    return jsonl.read_metrics(spark, path)


_FULL_PAIRS = """(SELECT unnest(['overall', target]) AS scope, 'evidence_span_found' AS field, span AS a, h_span AS h FROM reviews
  UNION ALL SELECT unnest(['overall', target]), 'semantic_support', sem, h_sem FROM reviews)"""


@query("b12_bundle_write_and_score", with_records(agreement_sql("a", "h", _FULL_PAIRS, "scope, field"), _PATTERNS, REVIEWS),
       doubles="percent_agreement cohens_kappa precision recall specificity")
def _(spark, d):
    """Both sheets of an audit of every record are written apart, read back, joined and scored."""
    rows = materialize(V.reviews(spark, d), "reviews")
    reviewer_path, key_path = scratch_path(spark, "reviewer"), scratch_path(spark, "key")
    hidden = ["case_id", "arm", "ground_truth", "automated_evidence_span_found", "automated_semantic_support", "arm_pattern"]
    jsonl.write_lines(rows.drop(*hidden), reviewer_path)
    jsonl.write_lines(rows.select("audit_id", "target", "prediction", *hidden), key_path)
    return audits.score(spark, reviewer_path, key_path).agreement

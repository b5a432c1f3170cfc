import json

from spanledger.session import scratch_path
from spanledger.sources import documents


def _store(spark, n=400, buckets=32):
    rows = [(json.dumps({"patient_id": f"p{k}", "text": f"report {k}", "gold": {"M": "M0"}, "predictions": {}}),) for k in range(n)]
    lines, path = scratch_path(spark, "lines"), scratch_path(spark, "store")
    documents.write_documents(spark.createDataFrame(rows, "document string"), lines)
    documents.write_case_store(documents.read_cases(spark, lines), path, buckets)
    return documents.read_case_store(spark, path)


def _files_read(df):
    """(rows, files that the scan opened)."""
    rows = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return rows, leaves.head().metrics().apply("numFiles").value()


def test_a_lookup_opens_one_bucket(spark):
    store = _store(spark)
    assert store.select("bucket").distinct().count() == 32
    whole = _files_read(store)[1]
    rows, files = _files_read(documents.look_up_case(store, "p123"))
    assert [(r["patient_id"], r["text"], r["gold"]) for r in rows] == [("p123", "report 123", {"M": "M0"})]
    assert files == 1 < whole
    rows, files = _files_read(documents.look_up_case(store, "nobody"))
    assert rows == [] and files <= 1


def test_many_lookups(spark):
    store = _store(spark)
    ids = spark.createDataFrame([("p1",), ("p399",), ("p1",), ("nobody",), (None,)], "patient_id string")
    got = documents.look_up_cases(store, ids)
    assert sorted(r["patient_id"] for r in got.collect()) == ["p1", "p399"]
    assert documents.case_summaries(got).count() == 2

import os

import public_tokenizers
import pytest

import corpus_pipeline
from llm import packing, secrets, toxicity
from llm.common import scratch_path
from llm.queries import ORACLES, QUERIES

from test_near import plain_classes, plain_links

SF = os.environ.get("SPANLEDGER_TEST_SF", "/root/testdata/sf0.001")


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_oracles(llm_spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](llm_spark, SF)
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages_match_brute_force(llm_spark):
    """Every stage's rows against a plain Python version over the same input."""
    docs = llm_spark.read.parquet(f"{SF}/documents.parquet")
    labels = llm_spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(docs, labels)
    scorer = toxicity.Scorer(model)
    stay = {i for i, r in rows.items() if model.probability(scorer.margins([r["text"] or ""])[0]) < 0.5}
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(llm_spark, f"test-{name}")
        stage(llm_spark, docs, SF).write.parquet(path)
        docs = llm_spark.read.parquet(path)
        outs.append(docs)
    assert all(o.columns == ["doc_id", "text", "lang", "source", "n_chars"] for o in outs[:-1])
    assert {r["doc_id"] for r in outs[0].collect()} == stay
    links = plain_links({i: rows[i]["text"] for i in stay})
    kept = {i for i, c in plain_classes(links).items() if i == c}
    assert {r["doc_id"] for r in outs[1].collect()} == kept
    clean = {i: secrets.redacted(rows[i]["text"]) for i in kept}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in outs[2].collect()} == {i: (t, len(t)) for i, t in clean.items()}
    encode = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for r in outs[3].collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {i: len(encode(t)) // 4 + 1 for i, t in clean.items()}
    run = corpus_pipeline.run(llm_spark, SF)
    assert sorted(map(tuple, run.select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        map(tuple, outs[3].select("doc_id", "piece", "ids_crc32").collect()))

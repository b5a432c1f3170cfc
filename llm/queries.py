"""One query for each operator, over the whole of the table that it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from llm import ann, byte_bpe, collocations, lm_score, minhash, packing, pii, ranked_search, secrets, simhash, token_counts, toxicity, warc
from llm.common import prepare, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return run

    return register


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query("op2_minhash")
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edit_fingerprints(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op8_warc")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op8_warc"] = """
WITH p AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM f
"""


@query("op9_neighbours")
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 20 = 0"))


@query("op4_lm_score")
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.fit(docs))


@query("op13_pii")
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(table(spark, sf_dir, "documents"))


@query("op12_collocations")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), s AS (
    SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS MATERIALIZED (
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM s, (VALUES (1), (2), (3)) AS sizes(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), c AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2 AND f >= 10
), h AS (
    SELECT *, unnest(range(1, k)) AS cut FROM c
), y AS MATERIALIZED (
    SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:k], ' ') AS rest FROM h
), x AS (
    SELECT y.lang, y.phrase, a, cut, l.f AS l, r.f AS r,
           CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM y JOIN g l ON l.lang = y.lang AND l.phrase = head JOIN g r ON r.lang = y.lang AND r.phrase = rest
), b AS (
    SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), q AS (
    SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3
), d AS (
    SELECT lang, phrase, max(a) AS longer FROM q GROUP BY ALL
), n AS (
    SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b LEFT JOIN d USING (lang, phrase) JOIN n ON n.lang = b.lang
WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000
"""


@query("op11_ranked_search")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ranked_search.search(docs, ranked_search.build(docs), table(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_search"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
    FROM documents
), l AS (
    SELECT r, doc_id, len(ws) AS n, ws FROM d WHERE len(ws) > 0
), c AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM l
), u AS (
    SELECT r, unnest(ws) AS term FROM l
), tf AS MATERIALIZED (
    SELECT r, term, count(*) AS tf FROM u GROUP BY r, term
), df AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term
), i AS (
    SELECT row_number() OVER () AS k, item_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
    FROM benchmark
), q AS (
    SELECT k, any_value(item_id) AS item_id, term, count(*) AS times FROM (SELECT k, item_id, unnest(ws) AS term FROM i) GROUP BY k, term
), m AS (
    SELECT r, doc_id, 100 - 25 + (25 * n * docs) // total AS m FROM l, c
), s AS (
    SELECT k, r, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
           CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY k, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""

"""The queries of the operators: each applies its operator to its whole table and returns what its contract names."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chroma, exact, jaccard, licenses, mixing, packing, periodic, quality, secrets, topk, toxicity, whitening
from .common import documents, labels, save, scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir)).drop("redacted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def op3_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(chat.conversation_pairs(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, labels(spark, sf_dir)))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alignment of each query, and a row of nulls for a query without any."""
    prints = save(chroma.fingerprints(chroma.sonified(spark, sf_dir)))
    queries = prints.where(F.col("vec_id") % 100 == 0)
    found = save(chroma.align(prints, queries))
    alone = queries.select(F.col("vec_id").alias("query_id")).join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(documents(spark, sf_dir))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the places of each document's copies in the training order of the whole mix."""
    return mixing.schedule(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position", "positions", "places")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as the first batch of a new index."""
    return exact.deduplicated(documents(spark, sf_dir), f"{scratch_dir(spark)}/kinfolk-index-{uuid.uuid4().hex}")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.scan(documents(spark, sf_dir), planted=True))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_chat_preferences": op3_chat_preferences,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_topk_search": op6_topk_search,
    "op7_license_scan": op7_license_scan,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_source_mixing": op9_source_mixing,
    "op10_chroma_fingerprints": op10_chroma_fingerprints,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    # turns side by side up to the first that differs; what follows, rendered and with running lengths
    "op3_chat_preferences": r"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT p.pair_id, coalesce(min(CASE WHEN a.role = b.role AND a.text = b.text THEN NULL ELSE p.k END) - 1, count(*)) AS n
  FROM (SELECT DISTINCT pair_id, k FROM t) p LEFT JOIN t a ON a.pair_id = p.pair_id AND a.k = p.k AND a.c LEFT JOIN t b ON b.pair_id = p.pair_id AND b.k = p.k AND NOT b.c GROUP BY 1),
r AS (SELECT t.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM t JOIN n USING (pair_id)),
s AS (SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, c ORDER BY k) AS stop FROM r WHERE k > n)
SELECT n.pair_id, CAST(n.n AS INT) AS n_prompt,
  CAST((SELECT count(*) FROM s WHERE s.pair_id = n.pair_id AND c) AS INT) AS n_chosen, CAST((SELECT count(*) FROM s WHERE s.pair_id = n.pair_id AND NOT c) AS INT) AS n_rejected,
  coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM r WHERE r.pair_id = n.pair_id AND c AND k <= r.n), '') AS prompt,
  coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM s WHERE s.pair_id = n.pair_id AND c), '') AS chosen,
  coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM s WHERE s.pair_id = n.pair_id AND NOT c), '') AS rejected,
  coalesce((SELECT string_agg(CAST(stop - length(text) - 8 AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY k) FROM s WHERE s.pair_id = n.pair_id AND c AND role = 'assistant'), '') AS chosen_spans,
  coalesce((SELECT string_agg(CAST(stop - length(text) - 8 AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY k) FROM s WHERE s.pair_id = n.pair_id AND NOT c AND role = 'assistant'), '') AS rejected_spans
FROM n""",
    "op6_topk_search": """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    # links from shared shingles, then every document's smallest reachable id; the two extra columns from equal sets
    "op8_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS t, len(g) AS n FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
key AS (SELECT doc_id, len(g) AS n, array_to_string(list_sort(g), chr(10)) AS k FROM s),
class AS (SELECT k, min(doc_id) AS class_id, count(*) AS n_copies FROM key WHERE n > 0 GROUP BY k)
SELECT key.doc_id, n AS n_shingles, m AS component_id, coalesce(class_id, key.doc_id) AS class_id, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies
FROM key JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = key.doc_id LEFT JOIN class USING (k)""",
    "op11_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r""",
    # crc32 bit by bit; every pair of equal words at a distance of at most a quarter of the text; matches in a row as islands; periods that a divisor does not explain
    "op13_periodic_runs": r"""
WITH RECURSIVE raw AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, CAST(doc_id AS VARCHAR) AS id FROM documents),
bits AS (SELECT *, list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(id) + 1), lambda i: [ascii(id[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS inverse FROM raw),
hashed AS (SELECT doc_id, ws, len(ws) AS n, xor(inverse, 4294967295) AS h FROM bits),
tails AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a, h % 10 = 0 AND n > 0 AS planted FROM hashed),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM tails),
d AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE ws END AS ws FROM periods),
w AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(ws) AS word FROM d),
m AS (SELECT x.doc_id, x.i - y.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
islands AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM islands b WHERE NOT EXISTS (SELECT 1 FROM islands s WHERE s.doc_id = b.doc_id AND s.q < b.q AND s.start <= b.start AND s.start + s.length >= b.start + b.length)),
listed AS (SELECT doc_id, count(*) AS n_runs, min(struct_pack(l := -length, s := start, p := q)) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS shown FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
rest AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.p AS period, (1000 * -best.l) // best.p AS exponent_milli,
  sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN rest USING (doc_id)""",
}

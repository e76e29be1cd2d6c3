"""The corpus operators as queries over the tables of one folder, and the SQL that states some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontam, html_text, infill, jaccard, languages, mixing, preference, quality, substrings, tokenids, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(_table(spark, sf_dir, "embeddings"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(_table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.format_pairs(preference.neighbours_as_pairs(_table(spark, sf_dir, "conversations")))
    spans = {c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))) for c in ("chosen_loss", "rejected_loss")}
    return pairs.select("pair_id", "n_common", "prompt", "chosen", "rejected", *[F.when(F.col(c).isNotNull(), v).alias(c) for c, v in spans.items()])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenids.token_digest(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return languages.identify(docs, languages.train(docs))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(centroids.cluster(_table(spark, sf_dir, "embeddings"))).drop("n_exact")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_vectors, op3_ngram_join, op4_main_text, op5_preference, op6_toxicity, op7_decontamination, op8_mixing, op9_substrings, op10_token_ids, op11_language, op12_centroids, op13_infill)
}


def _rounds(n: int) -> str:
    """SQL of the rounds of op12: a<k> assigns all vectors to the centroids c<k - 1>, c<k> are their new centroids."""
    parts = []
    for k in range(1, n + 2):
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, arg_min(cluster, d * 64 + cluster) AS cluster, min(d) AS distance FROM (SELECT r, cluster, sum((q - c) * (q - c))::BIGINT AS d FROM x JOIN c{k - 1} USING (j) GROUP BY r, cluster) GROUP BY r)")
        if k <= n:
            mean = "(s - ((s % n) + n) % n) // n"
            parts.append(f"c{k} AS MATERIALIZED (SELECT o.cluster, o.j, coalesce({mean}, o.c)::BIGINT AS c FROM c{k - 1} o LEFT JOIN (SELECT cluster, j, sum(q)::BIGINT AS s, count(*) AS n FROM x JOIN a{k} USING (r) GROUP BY cluster, j) USING (cluster, j))")
    return ", ".join(parts)


ORACLE_SQL = {
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('17:' || doc_id) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(k % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, cap / weight AS fill, (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, max(level) FILTER (fill >= level) OVER () AS open FROM l),
t AS (SELECT source, source_size, CASE WHEN open IS NULL OR fill < open THEN cap ELSE weight * open END AS target FROM o),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place) - d.size / 2 AS middle FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN size > 0 AND middle < target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM x""",
    "op5_preference": """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS i FROM t),
n AS (SELECT pair_id, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM k GROUP BY 1),
m AS (SELECT n.*, CASE WHEN n0 = 0 OR n1 = 0 THEN 0 ELSE coalesce((SELECT min(a.i) FROM k a LEFT JOIN k b ON b.pair_id = a.pair_id AND b.side = 1 AND b.i = a.i WHERE a.pair_id = n.pair_id AND a.side = 0 AND (b.i IS NULL OR a.role <> b.role OR a.text <> b.text)) - 1, n0) END AS n_common FROM n),
h AS (SELECT k.*, n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, length('<|' || role || '|>') + 1 AS head FROM k JOIN m USING (pair_id)),
o AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side, i > n_common ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + head AS start FROM h),
g AS (SELECT pair_id, coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i <= n_common), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i > n_common), '') AS c, coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 1 AND i > n_common), '') AS r,
  coalesce(string_agg(start || '-' || (start + length(text)), ',' ORDER BY i) FILTER (side = 0 AND i > n_common AND role = 'assistant'), '') AS cl, coalesce(string_agg(start || '-' || (start + length(text)), ',' ORDER BY i) FILTER (side = 1 AND i > n_common AND role = 'assistant'), '') AS rl FROM o GROUP BY 1)
SELECT pair_id, n_common::INT AS n_common, prompt, CASE WHEN n0 > 0 THEN c END AS chosen, CASE WHEN n1 > 0 THEN r END AS rejected, CASE WHEN n0 > 0 THEN cl END AS chosen_loss, CASE WHEN n1 > 0 THEN rl END AS rejected_loss FROM m JOIN g USING (pair_id)""",
    "op12_centroids": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
x AS MATERIALIZED (SELECT r, unnest(range(64)) AS j, unnest(q) AS q FROM v),
b AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS cluster FROM v WHERE vec_id IS NOT NULL ORDER BY cluster LIMIT 40),
c0 AS MATERIALIZED (SELECT cluster, j, q AS c FROM b JOIN x USING (r)), {_rounds(5)},
h AS (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c5 GROUP BY 1)
SELECT vec_id, a6.cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY a6.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a6 JOIN v USING (r) JOIN h ON h.cluster = a6.cluster""",
    "op13_infill": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
g AS (SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
  CASE WHEN n = 0 OR h1 IS NULL OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || text[1:a] || '<S>' || text[b + 1:] || '<M>' || text[a + 1:b] ELSE '<S>' || text[b + 1:] || '<P>' || text[1:a] || '<M>' || text[a + 1:b] END AS output FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o""",
}

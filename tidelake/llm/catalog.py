"""The queries of this subpackage over whole tables, thin calls of the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents
from .chat import recover_roles
from .clustering import CLUSTERS, DIMENSIONS, ROUNDS, cluster
from .exact_dedup import dedup_groups
from .filter_audit import audit
from .fingerprints import edited_fingerprints
from .licenses import license_labels
from .minhash import near_duplicates
from .mixing import curriculum
from .ngram_join import similarity_components
from .pii import personal_data
from .quality import classify
from .sentencepiece_bpe import encoding_digests
from .training_order import write_training_order

MODEL = "piece_bpe_32k.model"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(documents(spark, sf_dir))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical turns of ``conversations``."""
    out = recover_roles(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "turn", "part", "place", "n_lines", "role", "label", "rendered", F.sha2("rendered", 256).alias("rendered_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir)).select("doc_id", "score", "posterior", "keep")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position", "position_2")


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(documents(spark, sf_dir), public_tokenizers.path(MODEL))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_training_order(documents(spark, sf_dir), public_tokenizers.path(MODEL))
    return out.select("shard", "slot", "doc_id", "n_tokens", (F.col("place") * F.col("stride")).alias("offset"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP4_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

OP8_SQL = r"""
WITH thin AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
s0 AS (SELECT source, sum(size) AS source_size FROM thin GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS i FROM s0),
s2 AS (SELECT source, source_size, 2 * source_size AS cap, [3, 1, 2][i + 1] AS weight, [0.5, 0.0, -0.5][i + 1]::DOUBLE AS drift FROM s1),
s3 AS (SELECT *, cap * (6 // weight) AS level FROM s2),
s4 AS (SELECT *, sum(cap) OVER (ORDER BY level RANGE UNBOUNDED PRECEDING) AS under, sum(weight) OVER (ORDER BY level RANGE UNBOUNDED PRECEDING) AS w_under,
              sum(weight) OVER () AS w_all, sum(source_size) OVER () AS total FROM s3),
s5 AS (SELECT *, 2 * (under * weight + cap * (w_all - w_under)) <= 3 * total * weight AS capped FROM s4),
s6 AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS cap_sum, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS w_rest FROM s5),
targets AS (SELECT source, source_size, drift,
                   CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * (3 * total - 2 * cap_sum) AS DOUBLE) / CAST(2 * greatest(w_rest, 1) AS DOUBLE) END AS target FROM s6),
placed AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS c FROM thin),
joined AS (SELECT p.doc_id, p.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, t.drift, CAST(p.c AS BIGINT) AS c0, CAST(p.c + t.source_size AS BIGINT) AS c1,
                  CAST(floor(t.target + 0.5) AS BIGINT) AS goal
           FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
timed AS (SELECT *, c0::DOUBLE / target AS u0, c1::DOUBLE / target AS u1, 1 - drift AS b FROM joined)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, goal - c0)) + greatest(0, least(size, goal - c1)) AS BIGINT) AS taken,
       CASE WHEN size > 0 AND c0 < goal THEN CASE WHEN drift = 0 THEN u0 ELSE (sqrt(b * b + 4 * drift * u0) - b) / (2 * drift) END END AS position,
       CASE WHEN size > 0 AND c1 < goal THEN CASE WHEN drift = 0 THEN u1 ELSE (sqrt(b * b + 4 * drift * u1) - b) / (2 * drift) END END AS position_2
FROM timed
"""

OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS words FROM t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
             100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) AS c, regexp_matches(x, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN marks USING (doc_id)),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
      FROM l p, l q, l r, l s, l t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (SELECT filter_order, k::INT AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) g(k)),
counted AS (
  SELECT part, filter_order, step, bit,
         CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM m, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted
"""


def _clusters_sql(clusters: int, rounds: int, dimensions: int) -> str:
    """Plain search in each round: distances are exact, being integers below 2 ** 53."""
    near = """a{r} AS MATERIALIZED (
  SELECT n, any_value(vec_id) AS vec_id, any_value(x) AS x, CAST(arg_min(j, d * 64 + j) AS INTEGER) AS cluster, CAST(min(d) AS BIGINT) AS distance
  FROM (SELECT n, vec_id, v.x, j, list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS d FROM v, c{r} c) GROUP BY n)"""
    mean = """s{r} AS (SELECT cluster, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS k FROM (SELECT cluster, unnest(x) AS y, unnest(range({dims})) AS i FROM a{r}) GROUP BY 1, 2),
m{r} AS (SELECT cluster, list(CAST((s - ((s % k) + k) % k) // k AS DOUBLE) ORDER BY i) AS x FROM s{r} GROUP BY 1),
c{q} AS MATERIALIZED (SELECT j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON j = cluster)"""
    steps = [near.format(r=r) + (",\n" + mean.format(r=r, q=r + 1, dims=dimensions) if r < rounds else "") for r in range(rounds + 1)]
    return (
        f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda y: floor(256 * CAST(y AS DOUBLE))) AS x
  FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {dimensions}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {clusters})),
"""
        + ",\n".join(steps)
        + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(list_aggregate(list_transform(c.x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON j = cluster
"""
    )


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_document_fingerprints, op3_personal_data, op4_exact_dedup, op5_chat_formatting, op6_license_scan, op7_quality_classifier, op8_source_mixing, op9_sentencepiece_codec, op10_training_order, op11_filter_audit, op12_centroid_clustering, op13_minhash_near_dedup)}

ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op8_source_mixing": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_centroid_clustering": _clusters_sql(CLUSTERS, ROUNDS, DIMENSIONS)}

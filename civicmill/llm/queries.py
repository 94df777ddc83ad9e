"""The operators of this subpackage applied to the given tables: thin queries and, where SQL can state them, oracle texts."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.llm import bpe, centroids, decontamination, html, licenses, lm_score, packing, quality, sharding, simhash, topk, urls, whitening

RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    if named := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(named, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.interleaved_shards(table(spark, sf_dir, "documents"), 40)
    return shards.select(F.col("row_id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id", "lang"])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.withColumnRenamed("row_id", "doc_id")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("row_id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("f")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), 8).withColumnRenamed("row_id", "vec_id")
    # a row's deviation is exact at any size; only what fits a long can be given as one
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_text=True)
    return coded.select(
        F.col("row_id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64)
    digest = [hashlib.sha256(",".join(map(str, c.components)).encode()).hexdigest() for c in centres]
    of = lambda values, kind: F.get(F.lit(values).cast(f"array<{kind}>"), F.col("cluster"))
    return rows.select(
        F.col("row_id").alias("vec_id"),
        "cluster",
        "distance",
        of([c.inertia for c in centres], "bigint").alias("cluster_inertia"),
        F.lit(sum(c.inertia for c in centres)).cast("bigint").alias("inertia"),
        of(digest, "string").alias("centroid_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_topk, op3_urls, op4_decontamination, op5_quality, op6_packing, op7_lm_score, op8_html, op9_licenses, op10_simhash, op11_whitening, op12_bpe, op13_centroids)
}


def lloyd_sql(k: int, rounds: int, dims: int) -> str:
    """Full scans of every round as SQL."""
    nearest = "(SELECT i, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM n, c{})"
    steps = [
        f"""a{r} AS (SELECT i, min_by(j, (d, j)) AS j FROM {nearest.format(r)} GROUP BY i),
 s{r} AS (SELECT j, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM (SELECT j, unnest(v) AS x, unnest(range({dims})) AS pos FROM n JOIN a{r} USING (i)) GROUP BY j, pos),
 m{r} AS (SELECT j, list(CAST(CASE WHEN s >= 0 THEN s // m ELSE -((m - 1 - s) // m) END AS BIGINT) ORDER BY pos) AS c FROM s{r} GROUP BY j),
 c{r + 1} AS (SELECT j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))"""
        for r in range(rounds)
    ]
    hashed = "sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v"
    return f"""WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 n AS (SELECT row_number() OVER () AS i, vec_id, v FROM kept),
 c0 AS (SELECT row_number() OVER (ORDER BY {hashed}) - 1 AS j, v AS c FROM kept ORDER BY {hashed} LIMIT {k}),
 {",".join(steps)},
 f AS (SELECT i, min_by(j, (d, j)) AS j, CAST(min(d) AS BIGINT) AS d FROM {nearest.format(rounds)} GROUP BY i)
 SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM n JOIN f USING (i) JOIN c{rounds} USING (j)"""


# The other queries need checksums, fingerprints, tokens, trained models, eigenvectors or document trees.
ORACLES: dict[str, str] = {
    "op2_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS f FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.f, c.f) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.f) = len(c.f) WHERE q.vec_id % 20 = 0),
 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 20""",
    # of the links that pages declare, absolute ones: no page given has any
    "op3_urls": """WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')) r(verdict, host, path)),
 p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url,'(?s)^.*?://([^/?#]*)',1),''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url,'(?s)^.*?://[^/?#]*([^?#]*)',1),'') AS path,
  regexp_extract(url,'(?s)^.*?://[^/?#]*([^#]*)',1) AS tail, regexp_replace(html,'(?s)<!--.*?-->','','g') AS body FROM pages),
 l AS (SELECT host||tail AS src, unnest([regexp_extract(regexp_extract(body,'(?is)<link\\b[^>]*\\srel\\s*=\\s*["'']?canonical\\b[^>]*>'),'(?is)\\shref\\s*=\\s*["'']?([^\\s"''>]+)',1), regexp_extract(regexp_extract(body,'(?is)<meta\\b[^>]*\\shttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'),'(?is)url\\s*=\\s*([^\\s"''>]+)',1)]) AS href FROM p WHERE contains(url,'://')),
 e AS (SELECT src, translate(regexp_extract(href,'(?s)^.*?://([^/?#]*)',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')||regexp_extract(href,'(?s)^.*?://[^/?#]*([^#]*)',1) AS dst FROM l WHERE contains(href,'://')),
 two AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), nodes AS (SELECT DISTINCT src AS node FROM two),
 nr AS (SELECT node, arg_max(r.verdict, length(r.host||r.path)) AS verdict FROM nodes JOIN rules r ON (regexp_extract(node,'^[^/?]*')=r.host OR ends_with(regexp_extract(node,'^[^/?]*'),'.'||r.host)) AND starts_with(regexp_extract(node,'(?s)^[^/?]*([^?]*)',1), r.path) GROUP BY 1),
 reach AS (SELECT node FROM nr WHERE verdict='block' UNION SELECT two.dst FROM reach JOIN two ON two.src=reach.node),
 keyed AS (SELECT DISTINCT host, path FROM p), ru AS (SELECT k.host, k.path, arg_max(r.host||r.path, length(r.host||r.path)) AS rule, arg_max(r.verdict, length(r.host||r.path)) AS verdict FROM keyed k JOIN rules r ON (k.host=r.host OR ends_with(k.host,'.'||r.host)) AND starts_with(k.path, r.path) GROUP BY 1,2)
 SELECT p.page_id, p.host, p.path, ru.rule, CASE WHEN ru.rule IS NOT NULL THEN ru.verdict WHEN contains(p.url,'://') AND p.host||p.tail IN (SELECT node FROM reach) THEN 'block' ELSE 'allow' END AS verdict,
 CASE WHEN ru.rule IS NOT NULL THEN 'rule' WHEN contains(p.url,'://') AND p.host||p.tail IN (SELECT node FROM reach) THEN 'alias' ELSE 'default' END AS reason FROM p LEFT JOIN ru ON ru.host=p.host AND ru.path=p.path""",
    "op4_decontamination": """WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text),'[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
 i AS (SELECT item_id, least(5, len(w)) AS k, list_sort(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda j: array_to_string(w[j:j + least(5, len(w)) - 1], ' ')))) AS s FROM b WHERE len(w) > 0),
 c AS (SELECT s, min(item_id) AS item_id, any_value(k) AS k FROM i GROUP BY 1), sh AS (SELECT item_id, k, len(s) AS n, unnest(s) AS g FROM c),
 d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text),'[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
 dg AS (SELECT DISTINCT doc_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS j FROM d, (SELECT DISTINCT k FROM c)))
 SELECT doc_id, item_id, CAST(any_value(n) AS INTEGER) AS n_shingles, count(*) AS n_found, count(*) / any_value(n) AS containment FROM dg JOIN sh USING (k, g) GROUP BY 1, 2 HAVING count(*) >= ceil(any_value(n) * 0.8 - 1e-9)""",
    "op13_centroids": lloyd_sql(16, 3, 64),
}

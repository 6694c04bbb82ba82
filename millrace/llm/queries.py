"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, extraction, lines, media, mixing, negatives, packing, pii, quality, simhash, substring, token_files, topk
from .common import table


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows by integer inner product for every vec_id divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").filter(topk.valid(F.col("embedding")))
    return topk.top_k(rows.select("vec_id", topk.quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, those dropped because their template recurs, and what is left."""
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weights 1, 2, 3 takes of each document; targets by source."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and the smallest doc_id reachable over links of 2 bits at most."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page by the recurrent block labeller."""
    return extraction.extract(table(spark, sf_dir, "pages"))


def op6_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums and features of each document's text, stored as lossless WebP and read back."""
    return media.read_media(media.with_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, count and checksum of each document's ids, from the written Re-Pair shards."""
    found = token_files.read_shards(token_files.write_shards(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each document, the limits of its language, and whether it stays."""
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "trusted", "chars", F.round("perplexity", 6).alias("perplexity"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "keep")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of each document in sequences of 4096 tokens."""
    found = packing.pack(packing.pieces(table(spark, sf_dir, "documents")))
    return found.withColumn("piece", F.col("piece").cast("int"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of each document once 50-word passages of earlier documents are gone."""
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document: counts and digest of base spans, and all spans as kind:start:end."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.sha2("masked", 256).alias("masked_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (vec_id divisible by 100) and each of its 5 positives; labels of every seventh id are shifted."""
    rows = negatives.usable(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), topk.quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 100 == 0)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of each vector after 5 rounds from 40 hashed seeds."""
    found = clusters.cluster(clusters.kept_vectors(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_line_dedup, op3_source_mixing, op4_simhash_near_dedup, op5_html_extraction, op6_webp_media, op7_repair_token_ids, op8_quality_classifier, op9_best_fit_packing, op10_substring_dedup, op11_pii, op12_hard_negatives, op13_centroid_clustering)}

def _rounds(k: int = 40, rounds: int = 5) -> str:
    """The SQL of op13, a pair of steps a round."""
    steps = [f"""
WITH kept AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id, embedding) AS rid, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), v) - 1 AS cluster, v FROM kept ORDER BY cluster LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, min([list_dot_product(k.v, k.v) - 2 * list_dot_product(k.v, c.v) + list_dot_product(c.v, c.v), CAST(cluster AS DOUBLE)]) AS best FROM kept k, c{i} c GROUP BY rid)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT cluster, list(value ORDER BY p) AS v FROM (
    SELECT CAST(best[2] AS BIGINT) AS cluster, p, floor(sum(k.v[p]) / count(*)) AS value FROM a{i} JOIN kept k USING (rid), unnest(range(1, 65)) AS u(p) GROUP BY ALL)
  GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance,
  CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (rid) JOIN c{rounds} c ON c.cluster = CAST(best[2] AS BIGINT)"""


SQL = {
    "op1_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5""",
    "op2_line_dedup": r"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS body, pos, string_split(text, chr(10))[pos] AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(pos)),
tok AS (
  SELECT *, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM raw),
long_lines AS (SELECT *, tokens[1:3] AS head, len(tokens) AS n FROM tok WHERE len(tokens) >= 3),
leaves AS (SELECT n, head FROM long_lines GROUP BY n, head HAVING count(*) >= 6),
l AS (SELECT x.* FROM long_lines x JOIN leaves USING (n, head)),
kinds AS (SELECT n, head, tokens, count(*) AS c FROM l GROUP BY ALL),
places AS (SELECT n, head, tokens, c, p, tokens[p] AS token FROM kinds, unnest(range(1, n + 1)) AS u(p)),
fixed AS (SELECT n, head, p, token FROM places WHERE token <> '<*>' GROUP BY n, head, p, token HAVING sum(c) >= 6),
templates AS (
  SELECT a.n, a.head, a.tokens, string_agg(CASE WHEN f.token IS NOT NULL THEN a.token ELSE '<*>' END, ' ' ORDER BY a.p) AS template
  FROM places a LEFT JOIN fixed f ON a.n = f.n AND a.head = f.head AND a.p = f.p AND a.token = f.token
  GROUP BY a.n, a.head, a.tokens HAVING avg(CASE WHEN f.token IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.6),
found AS (SELECT l.doc_id, l.body, l.pos, t.template FROM l JOIN templates t ON l.n = t.n AND l.head = t.head AND l.tokens = t.tokens),
held AS (SELECT template, min(doc_id) AS keeper FROM found GROUP BY template HAVING count(DISTINCT body) >= 6),
gone AS (SELECT DISTINCT f.doc_id, f.body, f.pos FROM found f JOIN held h ON f.template = h.template WHERE f.doc_id <> h.keeper),
kept AS (
  SELECT r.doc_id, r.body, count(*) FILTER (regexp_matches(r.line, '[^\x20\x09-\x0D]')) AS n_lines, count(g.pos) AS n_dropped,
         coalesce(string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (g.pos IS NULL), '') AS kept
  FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.body = g.body AND r.pos = g.pos GROUP BY r.doc_id, r.body)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept""",
    "op3_source_mixing": r"""
WITH rows AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), '')) AS k
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
  FROM rows GROUP BY source),
caps AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM by_source),
steps AS (
  SELECT *,
         sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight
  FROM caps),
level AS (SELECT max(left_over / open_weight) AS l FROM steps WHERE left_over <= ratio * open_weight),
targets AS (
  SELECT source, source_size, CASE WHEN l IS NULL THEN cap ELSE least(cap, weight * l) END AS target FROM steps, level),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k ROWS UNBOUNDED PRECEDING) AS BIGINT) - r.size AS first_word
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size * size
              + least(size, greatest(0, budget - budget // source_size * source_size - first_word)) ELSE 0 END AS BIGINT) AS taken
FROM placed""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
firsts AS (SELECT s, min(doc_id) AS lo FROM windows GROUP BY s),
hits AS (SELECT x.doc_id, x.i FROM windows x JOIN firsts f ON x.s = f.s WHERE x.doc_id > f.lo),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
marked AS (
  SELECT x.doc_id, x.p, x.word,
         coalesce(max(h.i) OVER (PARTITION BY x.doc_id ORDER BY x.p ROWS UNBOUNDED PRECEDING) >= x.p - 49, false) AS gone
  FROM words x LEFT JOIN hits h ON h.doc_id = x.doc_id AND h.i = x.p),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, CAST(list_dot_product(a.v, d.v) AS BIGINT) AS score
  FROM v a JOIN v d ON a.vec_id <> d.vec_id AND len(a.v) = len(d.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
QUALIFY rank <= 5""",
    "op13_centroid_clustering": _rounds(),
}

"""Queries over whole tables, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import (alignment, hard_negatives, kneser_ney, mixing, packing, quality, rollups, sanitisation, secret_scan,
                        sharding, simhash, urls, vectors)
from murmur.llm.store import new_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return add


@query("op1_packed_documents")
def op1_packed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """SQL has no tokenizer: tested by an exact round trip of all ids."""
    pieces = packing.packed(table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query("op2_near_vectors", r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (
  SELECT v.r, least(v.vec_id, min(w.vec_id)) AS component_id
  FROM v LEFT JOIN reach ON reach.a = v.r LEFT JOIN v w ON w.r = reach.b GROUP BY v.r, v.vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id,
  coalesce(v.vec_id = c.component_id, false) AS kept
FROM v JOIN c ON c.r = v.r LEFT JOIN n ON n.a = v.r
""")
def op2_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.grouped(table(spark, folder, "embeddings"))


@query("op3_token_rollup")
def op3_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents come in with an estimate, a quarter of their bytes; the estimate is revised to the exact count, and
    documents labelled toxic are deleted. The second batch is committed twice. Tested against sums by hand."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    counts = written(docs.select(
        "doc_id", "source", "lang", F.lit("byte_bpe_50k").alias("tokenizer"),
        F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).alias("old_tokens"),
        rollups.bpe_tokens(F.col("text")).alias("tokens")), "token-counts")
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    rollup = rollups.Rollup(spark, new_folder(spark, "rollup"))
    rollup.commit("insert", rollups.inserted(counts.select(*rollups.KEYS, F.col("old_tokens").alias("tokens"))))
    for _ in range(2):
        rollup.commit("revise", rollups.revised(counts))
    rollup.commit("delete", rollups.deleted(counts.join(toxic, "doc_id", "left_semi")))
    return rollup.totals()


@query("op4_kneser_ney")
def op4_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Trained on nine tenths of the documents. Tested against counts by hand, sums of probabilities and the held-out
    tenth."""
    docs = table(spark, folder, "documents")
    out = kneser_ney.held_out(F.col("doc_id"))
    model = kneser_ney.trained(docs.filter(~out))
    return (kneser_ney.scored(docs.withColumn("held_out", out), model, ("doc_id", "held_out"))
            .withColumn("train_tokens", F.lit(model.totals["tokens"]).cast("long"))
            .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"))


@query("op5_quality_rules", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c >= 2),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS o(k) GROUP BY r),
f AS (
  SELECT w.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))
      AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(regexp_extract_all(t, '\p{Lu}')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN covered ON covered.r = w.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
m AS (
  SELECT r, lang, source, base_failed, unnest([
    {'name': 'symbols', 'v': n_symbols * 1000 // greatest(n_words, 1), 'spread': 30, 'low': false},
    {'name': 'word_length', 'v': word_chars * 100 // greatest(n_words, 1), 'spread': 200, 'low': true},
    {'name': 'dup_lines', 'v': n_dup_lines * 1000 // greatest(n_words, 1), 'spread': 30, 'low': false},
    {'name': 'capitals', 'v': n_capitals * 1000 // greatest(word_chars, 1), 'spread': 60, 'low': false}]) AS x
  FROM b),
s AS (
  SELECT r, lang, source, base_failed, x.name AS name, x.v AS v, x.spread AS spread, x.low AS low,
    (x.v >> greatest(length(bin(x.v)) - 7, 0)) << greatest(length(bin(x.v)) - 7, 0) AS step
  FROM m),
levels AS (
  SELECT 0 AS level, lang AS a, source AS c, name, spread, low, step FROM s WHERE NOT base_failed
  UNION ALL SELECT 1, lang, NULL, name, spread, low, step FROM s WHERE NOT base_failed
  UNION ALL SELECT 2, NULL, NULL, name, spread, low, step FROM s WHERE NOT base_failed),
q AS (
  SELECT level, a, c, name, any_value(spread) AS spread, any_value(low) AS low, count(*) AS docs,
    quantile_disc(step, 0.25) AS q1, quantile_disc(step, 0.75) AS q3
  FROM levels GROUP BY level, a, c, name),
fence AS (
  SELECT level, a, c, name, docs, CASE WHEN low THEN greatest(q1 - 3 * greatest(q3 - q1, spread), q1 * 50 // 100) ELSE -1 END AS lo,
    q3 + 3 * greatest(q3 - q1, spread) AS hi FROM q),
beyond AS (
  SELECT s.r, bool_or(s.v < CASE WHEN f0.docs >= 50 THEN f0.lo WHEN f1.docs >= 50 THEN f1.lo ELSE f2.lo END
      OR s.v > CASE WHEN f0.docs >= 50 THEN f0.hi WHEN f1.docs >= 50 THEN f1.hi ELSE f2.hi END) AS out
  FROM s JOIN fence f0 ON f0.level = 0 AND f0.name = s.name
      AND f0.a IS NOT DISTINCT FROM s.lang AND f0.c IS NOT DISTINCT FROM s.source
    JOIN fence f1 ON f1.level = 1 AND f1.name = s.name AND f1.a IS NOT DISTINCT FROM s.lang
    JOIN fence f2 ON f2.level = 2 AND f2.name = s.name
  GROUP BY s.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(beyond.out, false) AS kept
FROM b LEFT JOIN beyond ON beyond.r = b.r
""")
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents")).select("doc_id", *quality.BASE, "base_failed", "kept")


@query("op6_simhash_groups")
def op6_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    """SQL has no XXH64: tested against all pairs."""
    found = simhash.grouped(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_balanced_shards")
def op7_balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    """SQL has no best fit: tested against a plain best-fit-decreasing loop."""
    placed = sharding.assigned(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op8_url_verdicts")
def op8_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """SQL has no regression: rules are tested against a plain loop, the model by held-out accuracy."""
    return urls.judged(table(spark, folder, "pages"))


@query("op9_secret_spans")
def op9_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    """SQL gives no places of matches: tested against a plain loop."""
    found = secret_scan.scanned(table(spark, folder, "documents").select("doc_id", "text"))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select("doc_id", *[number(k) for k in secret_scan.BASE_KINDS],
                        F.sha2(secret_scan.written_spans(base), 256).alias("base_sha256"),
                        secret_scan.written_spans(F.col("spans")).alias("spans"))


@query("op10_mixed_sources", r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat('murmur:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM d GROUP BY source),
w AS (
  SELECT *, [3e0, 1e0, 2e0][(place - 1) % 3 + 1] AS weight, source_size * 2e0 AS lim,
    sum(source_size) OVER () * 1.5e0 AS total FROM s),
l AS (SELECT *, lim / weight AS level FROM w),
p AS (
  SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY level, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM l),
t AS (
  SELECT source, source_size, least(lim, coalesce((SELECT arg_min(water, (level, place)) FROM p
    WHERE lim > water * weight), 1e300) * weight) AS target FROM p),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
r AS (SELECT *, CAST(round(target) AS BIGINT) - whole * source_size AS rest FROM g),
k AS (
  SELECT d.doc_id, d.source, d.size, d.h, source_size, target, whole, rest,
    count(*) OVER (PARTITION BY d.source, h, size) AS copies,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST(size * whole
  + floor(least(greatest(rest - (upto - size * copies), 0), size * copies) / copies) AS BIGINT) AS taken FROM k
""")
def op10_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents")).select("doc_id", *mixing.RESULT)


@query("op11_hard_negatives", r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
p AS (
  SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) AS place FROM s WHERE same),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, place ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INT) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
  WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""")
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    items = table(spark, folder, "embeddings").select(
        "vec_id", moved.alias("label"), hard_negatives.quantised(F.col("embedding")).alias("vector"),
        (F.col("vec_id") % 100 == 0).alias("anchor"))
    return hard_negatives.mined(items).drop("positive_rank")


@query("op12_aligned_tokens")
def op12_aligned_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """SQL has no tokenizer: tested byte by byte."""
    return alignment.compared(table(spark, folder, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_disclosing_terms")
def op13_disclosing_terms(spark: SparkSession, folder: str) -> DataFrame:
    """SQL gives no places of matches: tested against plain loops."""
    found = sanitisation.scanned(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *[number(k) for k in sanitisation.BASE_KINDS],
                        F.sha2(sanitisation.written_spans(base), 256).alias("base_sha256"),
                        sanitisation.written_spans(F.col("spans")).alias("spans"), number("term"))

"""Registered queries of the numbered operators over the given tables.

Each maps a table to the operator's records (a document is an alert message, a page a scene
response, an embedding a tile signature) and its result back to the documents' names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landpulse.llm import (archives, boundaries, katz, merkle, mixing, multi_index, near_messages, packing, ranked_search, repeated_passages,
                           resampling, storage, target_draw, token_counts)
from landpulse.llm.tokens import public_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def alerts_of(documents: DataFrame) -> DataFrame:
    """Documents as alerts: doc_id -> alert_id, text -> message_body, source -> aoi_name; columns that
    have these names already give way."""
    names = {"doc_id": "alert_id", "text": "message_body", "source": "aoi_name"}
    return documents.drop(*names.values()).withColumnsRenamed(names)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("alert_id"), "quality")


@_query
def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample_by_quality(_alerts(spark, sf_dir).select("alert_id", "message_body"), labels_of(spark, sf_dir))
    return drawn.select(F.col("alert_id").alias("doc_id"), "log_ratio", "n_grams", "gumbel_key", "kept")


@_query
def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("alert_id").cast("string")), F.lit(10)) == 0
    return katz.katz_scores(_alerts(spark, sf_dir), held_out).withColumnRenamed("alert_id", "doc_id")


@_query
def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scenes = pages.select(F.col("page_id").alias("scene_id"), F.col("url").alias("href"), F.col("html").alias("content"))
    written = archives.write_archives(scenes, storage.new_folder(spark, "warc"))
    read = archives.read_archives(written)
    return read.select(F.col("scene_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    tiles = vectors.select(F.col("vec_id").alias("tile_id"), F.col("embedding").alias("signature"))
    found = multi_index.nearest_signatures(tiles, F.col("tile_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("tile_id").alias("vec_id"), "score")


@_query
def op5_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.message_pieces(_alerts(spark, sf_dir), public_path("word_bpe_49k.json"))
    return packing.pack_pieces(pieces).withColumnRenamed("alert_id", "doc_id")


@_query
def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = merkle.compare_with_successor(_alerts(spark, sf_dir))
    return compared.withColumnRenamed("alert_id", "doc_id")


MIX = {"smoothing": 0.5, "epochs": 1.0, "seed": "mix-1"}


@_query
def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate_to_weights(_alerts(spark, sf_dir), **MIX)
    return mixed.select(F.col("alert_id").alias("doc_id"), F.col("message_body").alias("text"), F.col("aoi_name").alias("source"),
                        "mix_copy", "mix_copies", "mix_order")


ORACLES["op7_poisson_mix"] = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () * (sum(n) OVER ())::DOUBLE / n AS rate FROM sizes),
steps AS (SELECT source, rate, k, sum(k * ln(rate) - rate - lgamma(k + 1)) OVER (PARTITION BY source, k) AS lp
          FROM rates, range(0, 200) AS r(k)),
cdf AS (SELECT source, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS p FROM steps),
draws AS (SELECT *, ('0x' || substr(md5('mix-1|count|' || doc_id || '|' || coalesce(source, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
counts AS (SELECT d.doc_id, d.text, d.source, d.u, count(c.k) FILTER (c.p <= d.u) AS copies
           FROM draws d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, text, source, c.copy::INTEGER AS mix_copy, copies::INTEGER AS mix_copies,
       ('0x' || substr(md5('mix-1|order|' || doc_id || '|' || c.copy), 1, 13))::BIGINT / 4503599627370496.0 AS mix_order
FROM counts, range(0, 200) AS c(copy) WHERE c.copy < copies
"""


@_query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = near_messages.near_messages(_alerts(spark, sf_dir))
    return linked.select(F.col("alert_id").alias("doc_id"), "text_id", "class_id", "n_links")


@_query
def op9_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = boundaries.write_message_ids(_alerts(spark, sf_dir), storage.new_folder(spark, "ids"), public_path("byte_bpe_50k.json"))
    return boundaries.read_message_ids(files).select(F.col("alert_id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_message_tokens(_alerts(spark, sf_dir), public_path("byte_bpe_50k.json"))
    return counted.withColumnRenamed("alert_id", "doc_id")


@_query
def op11_target_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("text").alias("message_body"))
    drawn = target_draw.draw_like_target(_alerts(spark, sf_dir), target)
    return drawn.withColumnRenamed("alert_id", "doc_id")


ORACLES["op11_target_draw"] = """
WITH RECURSIVE steps AS (
  SELECT n AS byte, 0 AS round, n::BIGINT AS c FROM range(256) AS r(n)
  UNION ALL SELECT byte, round + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM steps WHERE round < 8),
crc_byte AS (SELECT byte, c FROM steps WHERE round = 8),
words AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 't', NULL, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
occurrences AS (
  SELECT side, doc_id, f, count(*) AS n FROM (
    SELECT side, doc_id, unnest(w) AS f FROM words
    UNION ALL SELECT side, doc_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM words) GROUP BY ALL),
features AS (SELECT f, hex(encode(f)) AS h, length(hex(encode(f))) // 2 AS size FROM (SELECT DISTINCT f FROM occurrences)),
longest AS (SELECT max(size) AS size FROM features),
behind AS (  -- what a byte adds to the crc when k bytes follow it
  SELECT byte, 0 AS k, c FROM crc_byte
  UNION ALL SELECT b.byte, b.k + 1, xor(b.c // 256, t.c) FROM behind b JOIN crc_byte t ON t.byte = b.c % 256 JOIN longest ON b.k < longest.size),
start AS (
  SELECT 0 AS size, 4294967295 AS c
  UNION ALL SELECT s.size + 1, xor(s.c // 256, t.c) FROM start s JOIN crc_byte t ON t.byte = s.c % 256 JOIN longest ON s.size < longest.size),
bytes AS (SELECT f, size, i, ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT AS byte FROM features, unnest(range(size)) AS r(i)),
buckets AS (
  SELECT f, xor(xor(bit_xor(behind.c), any_value(start.c)), 4294967295) % 10000 AS bucket
  FROM bytes JOIN behind ON behind.byte = bytes.byte AND behind.k = bytes.size - 1 - bytes.i JOIN start ON start.size = bytes.size GROUP BY f),
held AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
  FROM occurrences JOIN buckets USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM held),
gains AS (SELECT bucket, floor(1000 * ln((held.t + 1) * (totals.s + 10000) / ((held.s + 1) * (totals.t + 10000)))) AS gain FROM held, totals),
sums AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
         FROM occurrences JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words d LEFT JOIN sums USING (doc_id) WHERE d.side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""


@_query
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_passages.remove_repeated_passages(_alerts(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cut.select(F.col("alert_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept_body", 256).alias("kept_sha256"))


ORACLES["op12_suffix_dedup"] = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
windows AS (SELECT doc_id, p, substr(h, (2 * p + 1)::BIGINT, 200) AS s FROM docs, unnest(range(n - 99)) AS r(p)),
numbered AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS place FROM windows),
steps AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100 AS apart FROM numbered WHERE place > 1),
runs AS (SELECT doc_id, p, coalesce(count_if(apart) OVER (PARTITION BY doc_id ORDER BY p), 0) AS run FROM steps),
spans AS (SELECT doc_id, min(p) AS b, max(p) + 100 AS e FROM runs GROUP BY doc_id, run),
around AS (  -- what is kept before each span, and after the last
  SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS from_byte, b AS to_byte FROM spans
  UNION ALL SELECT doc_id, max(e), NULL, max(e), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, (2 * from_byte + 1)::BIGINT, (2 * (coalesce(to_byte, n) - from_byte))::BIGINT), '' ORDER BY from_byte) AS body,
         sum(e - b)::BIGINT AS n_removed, count(e) AS n_spans
  FROM around JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(body, h))) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""


@_query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("alert_id"), F.col("text").alias("message_title"))
    ranked = ranked_search.rank_alerts(_alerts(spark, sf_dir), titles)
    return ranked.withColumnsRenamed({"title_id": "item_id", "alert_id": "doc_id"})


ORACLES["op13_ranked_search"] = """
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
item_terms AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, totals GROUP BY term, docs),
scores AS (
  SELECT i.item_id, t.doc_id, sum(i.repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM item_terms i JOIN tfs t USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

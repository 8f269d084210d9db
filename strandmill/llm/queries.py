"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm import mixing

    return mixing.mix(_read(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm import quality

    return quality.line_quality(_read(spark, sf_dir, "documents")).drop("cleaned")


def op3_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm import toxicity

    docs = _read(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm import audio, common

    stored = common.staged(audio.store(_read(spark, sf_dir, "documents")), "audio")
    return audio.expand(stored, keep_pcm=False).drop("pcm", "codec")


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm import langid

    docs = _read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op6_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm import setjoin

    return setjoin.components(_read(spark, sf_dir, "documents"), 4, 85, 100)


def op7_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm import urlfilter

    return urlfilter.judge(_read(spark, sf_dir, "pages"))


def op8_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandmill.llm import common, sst

    manifest = sst.write_shards(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), common.staging(spark, "sst"))
    return sst.read_shards(manifest)


def op9_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandmill.llm import packing

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op10_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmill.llm import htmltext

    return htmltext.extract(_read(spark, sf_dir, "pages"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op1, which SQL can say; what is taken is drawn."""
    from pyspark.sql import functions as F

    rows = op1_mixing(spark, sf_dir)
    return rows.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("within"))


def line_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: its counts and base limits."""
    return op2_line_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and, where a rule fits, the verdict of op7."""
    from pyspark.sql import functions as F

    return op7_link_graph(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruling"))


def telephony_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: sizes and digest of the payload."""
    return op4_telephony(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: op8 covers every document once, and starts are the running sums of lengths."""
    from pyspark.sql import functions as F

    rows = op8_sst_shards(spark, sf_dir)
    return rows.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("ids"), (F.max(F.col("start") + F.col("n_tokens")) == F.sum("n_tokens")).alias("gapless"))


def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: op9 covers every document, no sequence holds more than 4096 ids, and one at most is not full."""
    from pyspark.sql import functions as F

    rows = op9_concat_cut(spark, sf_dir)
    full = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"))
    short = full.agg(F.count_if(F.col("n") < 4096).alias("short"), F.count_if((F.col("n") > 4096) | (F.col("n") != F.col("top"))).alias("bad"))
    ids = rows.agg(F.count_distinct("doc_id").alias("ids"))
    return ids.crossJoin(F.broadcast(short)).select("ids", (F.col("short") <= 1).alias("packed"), (F.col("bad") == 0).alias("sound"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_line_rules": op2_line_rules,
    "op3_noisy_channel": op3_noisy_channel,
    "op4_telephony": op4_telephony,
    "op5_byte_cnn": op5_byte_cnn,
    "op6_pigeonhole": op6_pigeonhole,
    "op7_link_graph": op7_link_graph,
    "op8_sst_shards": op8_sst_shards,
    "op9_concat_cut": op9_concat_cut,
    "op10_tag_paths": op10_tag_paths,
}
QUERIES |= {f.__name__: f for f in (mixing_targets, line_rules_base, url_rules, telephony_payloads, token_rows, packed_rows)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Shares the total by weight, stops sources at twice their size and shares the excess again, round by round.
TARGETS = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM d GROUP BY source),
t AS (
  SELECT 0 AS k, source, source_size, CAST(weight AS DOUBLE) AS weight, false AS capped, CAST(0 AS DOUBLE) AS target FROM s
  UNION ALL
  SELECT k + 1, source, source_size, weight, capped OR share >= 2 * source_size, CASE WHEN capped OR share >= 2 * source_size THEN 2.0 * source_size ELSE share END
  FROM (
    SELECT *, weight * (1.5 * sum(source_size) OVER () - sum(CASE WHEN capped THEN 2.0 * source_size ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS share FROM t
  ) WHERE k < 12
)
SELECT doc_id, size, source_size, round(target, 3) AS target, true AS within FROM d JOIN (SELECT * FROM t WHERE k = 12) u ON d.source IS NOT DISTINCT FROM u.source
"""
BASE = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
w AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
h AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
r AS (SELECT id, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) v(k) GROUP BY id),
l AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS base_failed
FROM d LEFT JOIN r USING (id) LEFT JOIN u USING (id)
"""
RULED = """
WITH x AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT k, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM x),
rules AS (SELECT * FROM (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')) v(ruling, rule, name, start))
SELECT page_id, host, path, rule, ruling FROM p LEFT JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC) = 1
"""
PAYLOADS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT *, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM d),
p AS (SELECT *, greatest(192, (n_bytes + 191) // 192 * 192) AS payload_bytes FROM n)
SELECT doc_id, n_bytes, payload_bytes, sha256(text || repeat(' ', payload_bytes - n_bytes)) AS payload_sha256 FROM p
"""
ORACLES: dict[str, str] = {
    "mixing_targets": TARGETS,
    "line_rules_base": BASE,
    "url_rules": RULED,
    "telephony_payloads": PAYLOADS,
    "token_rows": "SELECT count(doc_id) AS n, count(DISTINCT doc_id) AS ids, true AS gapless FROM documents",
    "packed_rows": "SELECT count(DISTINCT doc_id) AS ids, true AS packed, true AS sound FROM documents",
}

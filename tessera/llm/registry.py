"""The ``opN_*`` queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import disclosure, exact_dedup, mixing, oracles, quality_rules, quality_zstd, repair, sharding, simhash, spelling, spm, store, token_orc, toxicity_fm, warc

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), digest_all=True)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spm.round_trips(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return rows.withColumnRenamed("id", "doc_id")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.scratch_path(spark, "tokens")
    token_orc.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return token_orc.token_layout(spark, path)


def page_records(pages: DataFrame) -> DataFrame:
    """The pages as a crawl's records: each page is a full response and has one later visit.

    The response of page p is at second 100 p, its revisit 100 seconds per 997 pages later, or, for every tenth page,
    50 seconds earlier. The revisit carries the page's ETag; for every seventh page it has only a Last-Modified, for
    every eleventh neither. Page ids identify pages; rows without one are no records.
    """
    p, digest = F.col("page_id"), F.md5(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    base = pages.where(p.isNotNull()).select(p, F.col("url"), digest.alias("tag"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))
    tag, date = F.struct(F.lit("etag").alias("k"), F.col("tag").alias("v")), F.struct(F.lit("last-modified").alias("k"), (p * 100).cast("string").alias("v"))
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    full = base.select(
        F.concat(F.lit("r"), p).alias("record_id"), F.lit("response").alias("kind"), "url", (p * 100).cast("long").alias("ts"), F.lit(200).alias("status"),
        F.map_from_entries(F.array(tag, date, pair("content-type", F.lit("text/html")), pair("content-length", F.octet_length("body")), pair("age", F.lit(0)))).alias("headers"), F.col("body").alias("payload"),
    )
    validators = F.when(p % 11 == 0, F.array(pair("age", p % 60))).when(p % 7 == 0, F.array(date, pair("age", p % 60))).otherwise(F.array(tag, pair("age", p % 60)))
    again = base.select(
        F.concat(F.lit("v"), p).alias("record_id"), F.lit("revisit").alias("kind"), "url", F.when(p % 10 == 0, p * 100 - 50).otherwise(p * 100 + 99750).cast("long").alias("ts"), F.lit(304).alias("status"),
        F.map_from_entries(F.concat(validators, F.array(pair("content-length", F.lit(0))))).alias("headers"), F.lit(None).cast("binary").alias("payload"),
    )
    return full.unionByName(again)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve_revisits(page_records(_table(spark, sf_dir, "pages")))
    page = F.substring("record_id", 2, 30).cast("long")
    return done.select(
        page.alias("page_id"), "url_key", F.coalesce(F.substring("response_id", 2, 30).cast("long"), F.lit(-1)).alias("response_page"), "status",
        F.element_at("headers", "age").alias("age"), F.element_at("headers", "content-type").alias("content_type"), F.element_at("headers", "content-length").alias("content_length"), F.md5("payload").alias("payload_md5"),
    )


def op5_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_zstd.train(docs, _table(spark, sf_dir, "labels"))
    return quality_zstd.scored(docs, model).withColumnRenamed("id", "doc_id")


def op6_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity_fm.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity_fm.scored(docs, model).withColumnRenamed("id", "doc_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(_table(spark, sf_dir, "documents"), 8)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents")).drop("th").withColumnRenamed("id", "doc_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(_table(spark, sf_dir, "conversations"))


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.found(_table(spark, sf_dir, "documents")).drop("th").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, octet_length(encode(coalesce(html, ''))) AS bytes,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1)), '^.*@', ''), '^www\.', ''), ':(?:80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_extract(trim(url), '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*(.*)$', 1), '(?s)#.*$', ''),
      '([?&])(?:utm_[A-Za-z_]*|fbclid|gclid|sessionid|phpsessid|jsessionid)=[^&]*', '\1', 'g'), '[?&]+$', ''), '\?&+', '?', 'g'), '&&+', '&', 'g'),
      '/(?:index|default)\.(?:html?|php|aspx?)(\?|$)', '/\1', 'g'), '/(\?|$)', '\1', 'g') AS url_key
  FROM pages WHERE page_id IS NOT NULL
), r AS (
  SELECT page_id, url_key, tag, bytes, page_id * 100 AS ts FROM p
), v AS (
  SELECT page_id, url_key, tag, CASE WHEN page_id % 10 = 0 THEN page_id * 100 - 50 ELSE page_id * 100 + 99750 END AS ts FROM p
), m AS (
  SELECT v.page_id, v.url_key, v.tag, r.page_id AS response_page, r.tag AS r_tag, r.bytes
  FROM v ASOF LEFT JOIN r ON v.url_key = r.url_key AND v.ts > r.ts
), s AS (
  SELECT *, CASE WHEN response_page IS NULL THEN 'no earlier response' WHEN page_id % 11 = 0 THEN 'no validator'
    WHEN page_id % 7 = 0 AND page_id = response_page THEN 'resolved' WHEN page_id % 7 <> 0 AND tag = r_tag THEN 'resolved'
    ELSE 'validator mismatch' END AS status
  FROM m
)
SELECT page_id, url_key, coalesce(response_page, -1) AS response_page, status, CAST(page_id % 60 AS VARCHAR) AS age,
  CASE WHEN status = 'resolved' THEN 'text/html' END AS content_type,
  CASE WHEN status = 'resolved' THEN CAST(bytes AS VARCHAR) ELSE '0' END AS content_length,
  CASE WHEN status = 'resolved' THEN r_tag END AS payload_md5
FROM s
"""

def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op4_warc_revisits": OP4_SQL, "op11_spelling_variants": oracles.OP11_SQL, "op12_conversation_repair": oracles.OP12_SQL, "op13_disclosure": oracles.OP13_SQL}

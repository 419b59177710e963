"""The registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext, langid, media, mixing, mtree, ngrams, pieces, pii, sharding, warc
from .common import written

#: A public SentencePiece model; encode and decode take any other.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    held_out = F.coalesce(held_out, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep=["doc_id", "held_out"])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives, read back by the merged capture index, with its place in the captures' order."""
    index, folder = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(index, folder, payloads=False).drop("url")


OP2_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, trim(url) AS u FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS sha,
         regexp_replace(lower(regexp_extract(u, '^[^:/]+://([^/?#:]*)', 1)), '^www\\.', '') AS host,
         regexp_extract(u, '^[^:/]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) AS query FROM p
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY sha, n >= 1000) AS keeper,
         lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
               || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END) AS urlkey FROM d
), j AS (
  SELECT *, n >= 1000 AND keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper AS again FROM k
)
SELECT page_id, n AS payload_bytes, sha AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN keeper END AS refers_to,
       CAST(row_number() OVER (ORDER BY urlkey, page_id % 1000000000 NULLS FIRST, page_id NULLS FIRST) - 1 AS BIGINT) AS place
FROM j
"""


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: sources in code point order weigh 1, 2, 3, repeating."""
    return mixing.taken(mixing.sized(table(spark, sf_dir, "documents"), keep=["doc_id"]))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS alike FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS w FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, w, encode(source) NULLS LAST) AS k,
         CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS ws FROM w
), c AS (
  SELECT *, total - 3 * CAST(coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
         ws - CAST(coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_w FROM o
), f AS (
  SELECT *, min(CASE WHEN w * rest <= 3 * source_size * left_w THEN k END) OVER () AS k0 FROM c
), l AS (
  SELECT *, max(CASE WHEN k = k0 THEN rest END) OVER () AS r0, max(CASE WHEN k = k0 THEN left_w END) OVER () AS w0 FROM f
), t AS (
  SELECT source, source_size, CASE WHEN k0 IS NULL OR k < k0 THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * r0 AS DOUBLE) / w0 END AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('20:' || d.alike || ':' || row_number() OVER (PARTITION BY d.source, d.alike)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngrams.link(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)] END) AS s FROM w
), n AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s
), f AS (
  SELECT doc_id, md5_number(unnest(s)) AS h FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM f a JOIN f b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), l AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), c AS (
  SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, c.c FROM c JOIN l ON c.doc_id = l.a WHERE c.c < l.b
)
SELECT n.doc_id, n AS n_shingles, least(n.doc_id, min(c.c)) AS component_id FROM n JOIN c ON n.doc_id = c.doc_id GROUP BY n.doc_id, n.n
"""


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every 20th vector by integer inner product."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


OP5_SQL = """
WITH q AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and whether decoding gives the very text back."""
    vocabulary = pieces.load(PIECES)
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, keep=["doc_id"], check=True)
    return coded.select("doc_id", "n_tokens", "ids", "decoded_bytes", "round_trip")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in 40 shards whose counts differ by one at most and whose mixtures agree."""
    docs = table(spark, sf_dir, "documents")
    raw = F.encode("text", "UTF-8")
    narrow = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.encode(F.lit(""), "UTF-8"))).alias("text_crc32"))
    placed = sharding.assign(narrow, 40, stratum="source", order=["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc_table() -> list[int]:
    """What each byte does to a CRC-32."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        out.append(n)
    return out


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, coalesce(CAST(octet_length(encode(text)) AS BIGINT), 0) + 16 AS size,
         xor(4294967295, list_reduce(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda a, b: xor(a >> 8,
             list_extract(CAST({crc_table()} AS BIGINT[]), (xor(a, CAST('0x' || b AS BIGINT)) & 255) + 1)), 4294967295)) AS text_crc32 FROM documents
), h AS (
  SELECT *, CAST('0x' || substr(md5('5:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(text_crc32 AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM d
), r AS (
  SELECT *, CAST(2 * row_number() OVER (PARTITION BY g ORDER BY h, doc_id, text_crc32) - 1 AS DOUBLE) / (2 * count(*) OVER (PARTITION BY g)) AS f FROM h
), a AS (
  SELECT *, row_number() OVER (ORDER BY f, g, h, doc_id, text_crc32) - 1 AS place, count(*) OVER () AS total FROM r
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 40 // total AS INTEGER) AS shard,
       CAST(place - (place * 40 // total * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM a
"""


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document kept in a progressive JPEG, written and read back; digests, features and the RGB tensor of each image.

    The tensors are a column of the result and stored with it.
    """
    stored = written(media.store(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]), "media", "zstd")
    read = media.facts(stored, keep=["doc_id", "n_bytes"], tensor=True)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article's text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = htmltext.extract(pages, htmltext.train(pages), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def _said(spans):
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _is(value: str):
    return lambda x: x == value


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the plain spans, all spans, number of those added."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(_said(base), "UTF-8"), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_mix": op3_mix,
    "op4_ngram_join": op4_ngram_join,
    "op5_top_k": op5_top_k,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_shards": op7_shards,
    "op8_media": op8_media,
    "op9_main_text": op9_main_text,
    "op10_pii": op10_pii,
}

SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op3_mix": OP3_SQL, "op4_ngram_join": OP4_SQL, "op5_top_k": OP5_SQL, "op7_shards": OP7_SQL}

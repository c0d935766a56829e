"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, lines, media, mixing, ngram_join, pieces, secrets, token_counts, toxicity, urls
from .common import table


def piece_model() -> str:
    """The model's file; TOKENIZERS names another folder."""
    return f"{os.environ.get('TOKENIZERS', '/opt/tokenizers')}/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    return rows.select(F.col("id").alias("doc_id"), F.size("pieces").cast("long").alias("n_pieces"), "pieces", "score", "others", "lossless")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return rows.select("_row.doc_id", toxicity.held_out(F.col("_row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_join.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return rows.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


#: The query's rules: verdict, host/path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad where the label of its number has low quality or is toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    rows = urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, RULES)
    return rows.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != secrets.RANDOM)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in secrets.PATTERNS], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans")
    )


def vocabulary() -> str:
    """The vocabulary's file; TOKENIZERS names another folder."""
    return f"{os.environ.get('TOKENIZERS', '/opt/tokenizers')}/byte_bpe_50k.tiktoken"


def edits_of(docs: DataFrame) -> DataFrame:
    """Three edits of every document that follow from its id: a replacement, an insertion and a deletion."""
    size = F.coalesce(F.char_length("text"), F.lit(0))
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), size + 1).cast("int")
    each = [F.struct(at(k).alias("start"), F.lit(drop).alias("drop"), F.lit(put).alias("put")) for k, (drop, put) in enumerate(((5, "other words"), (0, " it's new"), (40, "")))]
    return docs.select("doc_id", "text", F.array(*each).alias("edits"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.counted(edits_of(table(spark, sf_dir, "documents").select("doc_id", "text")), vocabulary())
    return rows.withColumnRenamed("id", "doc_id")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's page is parsed, its one reference resolved by digest, and what the stored image holds returned."""
    rows = media.as_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sequences = rows.select("rid", "id", "n_bytes", media.sequence_of("html").alias("sequence"))
    resolved = media.resolve(sequences, media.features(rows), ["rid", "id", "n_bytes"])
    facts = resolved.select("id", "n_bytes", F.filter("elements", lambda e: e["kind"] == "media")[0].alias("m"))
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return facts.select(F.col("id").alias("doc_id"), "n_bytes", *[F.col(f"m.payload.{c}").alias(c) for c in columns], F.col("m.position").alias("position"), F.col("m.caption").alias("caption"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = lines.with_lines(docs, lines.bitmaps(docs))
    return both.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.curriculum(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "positions"
    )


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op2_toxicity": op2_toxicity, "op3_ngram_join": op3_ngram_join, "op4_embeddings": op4_embeddings, "op5_urls": op5_urls, "op6_secrets": op6_secrets, "op7_token_counts": op7_token_counts, "op8_media": op8_media, "op9_line_dedup": op9_line_dedup, "op10_mixing": op10_mixing}

SQL: dict[str, str] = {}

SQL["op9_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
firsts AS (SELECT k, min(doc_id) AS f FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT doc_id, i, l, coalesce(f <> doc_id, false) AS gone FROM lines LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL["op5_urls"] = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
rules(verdict, site, start) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT page_id, arg_max(site || start, length(site || start)) AS rule, arg_max(verdict, length(site || start)) AS verdict
        FROM h JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY page_id),
out AS (SELECT doc_id AS id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
named AS (SELECT *, string_split(host, '.') AS parts, array_to_string(string_split(host, '.')[-2:], '.') IN (TWO_LABELS) AS two FROM h),
hosts AS (SELECT host, any_value(array_to_string(parts[CASE WHEN two THEN -2 ELSE -1 END:], '.')) AS suffix,
                 any_value(array_to_string(parts[CASE WHEN two THEN -3 ELSE -2 END:], '.')) AS domain,
                 coalesce(sum(bad), 0)::DOUBLE AS bad, count(bad)::DOUBLE AS n FROM named LEFT JOIN out ON id = page_id GROUP BY host),
g0 AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS prior, greatest(sum(n), 1) AS w FROM hosts),
s0 AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY suffix),
s1 AS (SELECT *, greatest(least(prior, 0.999), 0.001) AS q FROM s0, g0),
sm AS (SELECT greatest(least((sum((bad - n * q) ** 2 / (n * q * (1 - q))) - count(*)) / nullif(sum(n - 1), 0), 0.5), 0.001) AS rho FROM s1 WHERE n > 0),
s2 AS (SELECT suffix, (prior * least(m, w) + bad) / (least(m, w) + n) AS mean, least(m, w) + n AS w FROM s1, (SELECT coalesce((1 - rho) / rho, 1) AS m FROM sm)),
d0 AS (SELECT suffix, domain, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY suffix, domain),
d1 AS (SELECT d0.*, w, mean AS prior, greatest(least(mean, 0.999), 0.001) AS q FROM d0 JOIN s2 USING (suffix)),
dm AS (SELECT greatest(least((sum((bad - n * q) ** 2 / (n * q * (1 - q))) - count(*)) / nullif(sum(n - 1), 0), 0.5), 0.001) AS rho FROM d1 WHERE n > 0),
d2 AS (SELECT suffix, domain, (prior * least(m, w) + bad) / (least(m, w) + n) AS mean, least(m, w) + n AS w FROM d1, (SELECT coalesce((1 - rho) / rho, 1) AS m FROM dm)),
h1 AS (SELECT hosts.*, w, mean AS prior, greatest(least(mean, 0.999), 0.001) AS q FROM hosts JOIN d2 USING (suffix, domain)),
hm AS (SELECT greatest(least((sum((bad - n * q) ** 2 / (n * q * (1 - q))) - count(*)) / nullif(sum(n - 1), 0), 0.5), 0.001) AS rho FROM h1 WHERE n > 0),
h2 AS (SELECT host, (prior * least(m, w) + bad) / (least(m, w) + n) AS mean, least(m, w) + n AS total FROM h1, (SELECT coalesce((1 - rho) / rho, 1) AS m FROM hm))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN mean - 2 * sqrt(mean * (1 - mean) / (total + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN fit USING (page_id) JOIN h2 USING (host)
""".replace("TWO_LABELS", ", ".join(f"'{s}'" for s in urls.TWO_LABELS))

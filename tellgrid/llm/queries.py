"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellgrid.llm.common import table
from tellgrid.llm.url_filter import SUFFIXES
from tellgrid.sources.readers import spread


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tellgrid.llm.bpe import load_ranks, round_trip

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    done = round_trip(spread(table(spark, sf_dir, "documents")), ranks, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellgrid.llm.substring_dedup import remove_repeats

    return remove_repeats(spread(table(spark, sf_dir, "documents"))).drop("kept")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellgrid.llm.topk import topk

    return topk(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellgrid.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellgrid.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("unit")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellgrid.llm.simhash import near_dedup

    return near_dedup(spread(table(spark, sf_dir, "documents")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellgrid.llm.language_id import identify

    return identify(spread(table(spark, sf_dir, "documents")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellgrid.llm.exact_dedup import content_sort

    return content_sort(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellgrid.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).drop("block_bound")


OP9_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), j AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM u
), v AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM j
), h AS (
  SELECT host,
         CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (SUFFIX_TABLE)
              THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
         CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (SUFFIX_TABLE)
              THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END AS suffix,
         count(ruled)::DOUBLE AS n, (count(*) FILTER (ruled = 'block'))::DOUBLE AS k
  FROM v GROUP BY host
), d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
units AS (SELECT 1 AS lvl, n, k FROM s UNION ALL SELECT 2, n, k FROM d UNION ALL SELECT 3, n, k FROM h),
moments AS (
  SELECT lvl, count(*) AS g, sum(n) AS nn, sum(k) / sum(n) AS p, sum(n * n) AS n2, sum(k * k / n) AS kk
  FROM units WHERE n > 0 GROUP BY lvl
), rho AS (
  SELECT lvl, p, CASE WHEN p * (1 - p) <= 0 OR nn - n2 / nn - (g - 1) <= 0 THEN 0.001
         ELSE ((kk - nn * p * p) / (p * (1 - p)) - (g - 1)) / (nn - n2 / nn - (g - 1)) END AS r
  FROM moments
), m AS (SELECT lvl, p, 1 / least(greatest(r, 0.001), 0.5) - 1 AS m FROM rho),
prior AS (
  SELECT coalesce((SELECT m FROM m WHERE lvl = 1), 999) AS m1, coalesce((SELECT m FROM m WHERE lvl = 2), 999) AS m2,
         coalesce((SELECT m FROM m WHERE lvl = 3), 999) AS m3, coalesce((SELECT p FROM m WHERE lvl = 1), 0) AS p0
), sp AS (SELECT suffix, (k + m1 * p0) / (n + m1) AS sp FROM s, prior),
dp AS (SELECT domain, (k + m2 * sp) / (n + m2) AS dp FROM d JOIN sp USING (suffix), prior),
ab AS (SELECT host, k + m3 * dp AS a, n - k + m3 * (1 - dp) AS b FROM h JOIN dp USING (domain), prior),
post AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab)
SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN post ON v.host = post.host
""".replace("SUFFIX_TABLE", ", ".join(f"'{s}'" for s in SUFFIXES))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tellgrid.llm.html_text import extract

    return extract(spread(table(spark, sf_dir, "pages")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_topk": op3_topk,
        "op4_pii": op4_pii,
        "op5_mixing": op5_mixing,
        "op6_simhash": op6_simhash,
        "op7_language": op7_language,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_url_filter": op9_url_filter,
        "op10_html": op10_html,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8_SQL, "op9_url_filter": OP9_SQL}

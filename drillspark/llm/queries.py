"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from . import (
    byte_bpe,
    decontaminate,
    lexical_search,
    license_scan,
    lm_score,
    ngram_join,
    quality_lines,
    secret_scan,
    suffix_dedup,
    token_alignment,
    toxicity,
    url_filter,
    warc,
)

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op9_quality_lines")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_lines.with_quality(documents(spark, sf_dir).select("doc_id", "text"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept kept_words".split()
    return judged.select("doc_id", *[f"quality.{n}" for n in names])


@query("op10_ngram_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(documents(spark, sf_dir))


@query("op6_decontaminate")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[secret_scan.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in secret_scan.SURE],
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
        secret_scan.written(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.tokenize(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.coalesce(lm_score.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels.select("doc_id", "toxic").where(~apart))
    return toxicity.score(docs, model).select("doc_id", apart.alias("held_out"), "score", "predicted")


@query("op7_lm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = documents(spark, sf_dir), lm_score.remainder(F.col("doc_id"), 7)
    scores = lm_score.learn_and_score(docs, rest != 2, rest == 3)
    return scores.select("doc_id", (rest == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


#: Pages with host and path, listed keys as a join, and the longest rule that fits.
URL_FILTER_SQL = r"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), given AS (
  SELECT page_id, coalesce(regexp_matches(html, '%%%|\*\*\*|###|\$\$\$|&&&'), false) AS garbled,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(kind, site, beginning) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT host, path, max_by(site || beginning, length(site || beginning)) AS rule, max_by(kind, length(site || beginning)) AS kind
  FROM given JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, beginning) GROUP BY host, path
), listed AS (SELECT DISTINCT host || path AS key FROM given WHERE garbled)
SELECT page_id, given.host, given.path, rule, coalesce(kind, CASE WHEN key IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM given LEFT JOIN fits ON fits.host = given.host AND fits.path = given.path LEFT JOIN listed ON key = given.host || given.path
"""


@query("op4_url_filter", URL_FILTER_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the addresses of pages with garbled text (words followed by runs of three marks)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.col("url")
    garbled = F.coalesce(F.col("html").rlike(r"%%%|\*\*\*|###|\$\$\$|&&&"), F.lit(False))
    listed = pages.where(garbled).select(F.concat(url_filter.host_of(url), url_filter.path_of(url)).alias("key"))
    return url_filter.judge(pages, listed).drop("listed")


@query("op8_warc_revisit")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    warc.write(pages, path)
    return warc.read(spark, path, pages.schema["page_id"].dataType.simpleString())


@query("op11_suffix_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_alignment.align(documents(spark, sf_dir), *files)


#: The given formulas, on all terms of all documents.
LEXICAL_SEARCH_SQL = r"""
WITH terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (
    SELECT row_number() OVER () AS row, doc_id,
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
  )
), counted AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM terms GROUP BY row, term
), lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM counted GROUP BY row
), totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), norms AS (SELECT row, 50 + (50 * n * n_docs) // n_terms AS m FROM lengths, totals
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, totals GROUP BY term, n_docs
), asked AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'
    )) AS term
    FROM benchmark
  )
), scored AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN norms USING (row) GROUP BY item_id, row
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


@query("op12_lexical_search", LEXICAL_SEARCH_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 50)

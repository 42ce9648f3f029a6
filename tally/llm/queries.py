"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from .embedding_dedup import embedding_components
from .exact_dedup import exact_groups
from .hard_negatives import mine_hard_negatives
from .language_id import identify_languages
from .lexical_search import rank_documents
from .mixing import mix_sources
from .packing import pack
from .pii import personal_data
from .quality import importance_weights
from .sharding import shard
from .simhash import simhash_components
from .token_counts import token_counts
from .urls import judge_urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: Target weights of the mixing query: unequal, one of nothing, and 1 for every source that is not named.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5, "src3": 0.0}
MIX_OTHER = 1.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": lambda spark, d: embedding_components(read_table(spark, d, "embeddings")),
    "op2_url_filter": lambda spark, d: judge_urls(read_table(spark, d, "pages")),
    "op3_mix_sources": lambda spark, d: mix_sources(_documents(spark, d), MIX_WEIGHTS, other=MIX_OTHER),
    "op4_pii": lambda spark, d: personal_data(_documents(spark, d)),
    "op5_sharding": lambda spark, d: shard(_documents(spark, d)),
    "op6_token_counts": lambda spark, d: token_counts(_documents(spark, d), tokenizer("byte_bpe_50k.json")),
    "op7_quality_classifier": lambda spark, d: importance_weights(_documents(spark, d), read_table(spark, d, "labels")),
    "op8_simhash_near_dedup": lambda spark, d: simhash_components(_documents(spark, d)),
    "op9_exact_dedup": lambda spark, d: exact_groups(_documents(spark, d)),
    "op10_best_fit_packing": lambda spark, d: pack(_documents(spark, d), tokenizer("word_bpe_49k.json")),
    "op11_hard_negatives": lambda spark, d: mine_hard_negatives(read_table(spark, d, "embeddings")),
    "op12_language_id": lambda spark, d: identify_languages(_documents(spark, d)),
    "op13_ranked_search": lambda spark, d: rank_documents(_documents(spark, d), read_table(spark, d, "benchmark")),
}

SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE numbered AS (
  SELECT row_number() OVER () AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT * FROM numbered
  WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.row AS a, b.row AS b FROM usable a JOIN usable b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.row <> b.row AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT row AS a, row AS b FROM numbered
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (
  SELECT r.a, min(n.vec_id) AS component_id FROM reach r JOIN numbered n ON n.row = r.b GROUP BY r.a
)
SELECT n.vec_id, (SELECT count(*) FROM links l WHERE l.a = n.row) AS n_links, c.component_id,
       n.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM numbered n JOIN component c ON c.a = n.row
""",
    "op2_url_filter": """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/'
              WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
         END AS rule
  FROM u
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
""",
    "op3_mix_sources": """
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(length(text), 0) + 1) AS volume,
         CAST(CASE source WHEN 'src0' THEN 4 WHEN 'src1' THEN 2 WHEN 'src2' THEN 0.5 WHEN 'src3' THEN 0 ELSE 1 END AS DOUBLE) AS weight
  FROM documents GROUP BY source
), rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(volume) FROM sizes) / volume AS rate FROM sizes
), parts AS (
  SELECT source, rate, greatest(1, CAST(ceil(rate / 16.0) AS INTEGER)) AS parts FROM rates WHERE rate > 0
), cdf AS (
  SELECT source, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS c FROM parts
  UNION ALL
  SELECT cdf.source, k + 1, p * (rate / parts) / (k + 1), c + p * (rate / parts) / (k + 1)
  FROM cdf JOIN parts ON parts.source IS NOT DISTINCT FROM cdf.source WHERE k < 96
), numbers AS (
  SELECT d.rowid AS row, d.doc_id, d.source, i AS part,
         CAST('0x' || substr(md5('5:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || i), 1, 13) AS BIGINT)
           / 4503599627370496.0 AS u
  FROM (SELECT row_number() OVER () AS rowid, doc_id, source FROM documents) d
  JOIN parts ON parts.source IS NOT DISTINCT FROM d.source, generate_series(1, parts.parts) AS g(i)
), copies AS (
  SELECT row, doc_id, count(c.k) AS copies
  FROM numbers n LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM n.source AND c.c <= n.u
  GROUP BY row, doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(g.i AS INTEGER) AS copy, CAST(n.copies AS INTEGER) AS copies, r.rate
FROM (SELECT row_number() OVER () AS row, * FROM documents) d
JOIN copies n ON n.row = d.row
JOIN rates r ON r.source IS NOT DISTINCT FROM d.source, generate_series(0, n.copies - 1) AS g(i)
WHERE n.copies > 0
""",
    "op9_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS row, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.e) = len(b.e) AND a.row <> b.row
), positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) <= 5
), negative AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id NULLS LAST, n.row) AS rank
  FROM positive p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
    AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negative WHERE rank <= 5
""",
    "op13_ranked_search": r"""
WITH doc AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms
  FROM documents
), totals AS (
  SELECT CAST(count(*) AS HUGEINT) AS n_docs, CAST(sum(len(terms)) AS HUGEINT) AS n_terms FROM doc WHERE len(terms) > 0
), posting AS (
  SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM doc
), counted AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM posting GROUP BY row, doc_id, n, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, totals GROUP BY term, n_docs
), item AS (
  SELECT row_number() OVER () AS item, item_id, text FROM benchmark
), asked AS (
  SELECT DISTINCT item, item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM item
), scored AS (
  SELECT item, item_id, row, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weight USING (term), totals
  GROUP BY item, item_id, row, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""",
}

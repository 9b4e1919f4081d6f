"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import (alignment, bpe_codec, lexical, line_dedup, lm, minhash, mixing, partenum, pii, quality, secret_scan,
                          token_counts, topk)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source dropped from all documents."""
    cut = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"), "source", "text")
    return cut.select("row.doc_id", "row.source", "n_lines", "n_dropped", "text")


OP1_SQL = f"""
WITH worded AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
once AS (
  SELECT source, unnest(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS line
  FROM worded),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
lists AS (
  SELECT source, list(line) AS dropped FROM (
    SELECT o.source, o.line FROM once o JOIN totals t ON o.source IS NOT DISTINCT FROM t.source
    GROUP BY o.source, o.line, t.pages
    HAVING count(*) >= {line_dedup.MIN_PAGES} AND count(*) > {line_dedup.MAX_RATIO} * t.pages)
  GROUP BY source),
cut AS (
  SELECT w.*, list_filter(lines, lambda x: NOT list_contains(coalesce(dropped, []), x)) AS rest
  FROM worded w LEFT JOIN lists l ON w.source IS NOT DISTINCT FROM l.source),
marked AS (
  SELECT *, coalesce(len(list_filter(rest, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) > 0, false) AS ok FROM cut)
SELECT doc_id, source, coalesce(len(lines), 0) AS n_lines,
  CASE WHEN ok THEN len(lines) - len(rest) ELSE 0 END AS n_dropped,
  CASE WHEN ok THEN array_to_string(rest, chr(10)) ELSE text END AS text
FROM marked"""


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and log-bilinear log10 probabilities of all documents."""
    scored = lm.score(_table(spark, sf_dir, "documents"))
    return scored.withColumnRenamed("id", "doc_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans and those that the boosted trees add."""
    return pii.find(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: base rules and further token formats."""
    rules, n_base = secret_scan.RULES, len(secret_scan.BASE_RULES)
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), rules=rules)
    of = lambda i: F.size(F.filter("found", lambda s: s["place"] == i)).cast("long")
    base = F.filter("found", lambda s: s["place"] < n_base)
    return found.select("row.doc_id", *[of(i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE_RULES)],
                        F.sha2(secret_scan.digest_text(base, rules).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.digest_text(F.col("found"), rules).alias("spans"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility measures and the verdict on every document."""
    judged = quality.judge(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                           keep=["doc_id", "lang"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", *quality.MEASURES)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents."""
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"),
                                        public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumnRenamed("id", "doc_id")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text of every document."""
    coded = bpe_codec.encode_and_decode(_table(spark, sf_dir, "documents"),
                                        public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return coded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix's target and taken words of every document."""
    mixed = mixing.mix_sizes(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS site, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT site, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY site, source),
weighed AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
    source_size * 2.0::DOUBLE AS cap FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
    row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS turn
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level AS lv FROM levels WHERE level * weight <= cap ORDER BY turn LIMIT 1),
targets AS (SELECT site, source_size, least(cap, coalesce((SELECT lv FROM final) * weight, cap)) AS target FROM levels),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.site ORDER BY
    CASE WHEN size > 0 THEN CAST(floor(log2(size::DOUBLE) * 4) AS INTEGER) ELSE -1 END, digest, size) AS place
  FROM sized s),
spread AS (
  SELECT doc_id, size, source_size, target, place,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
    CAST('0x' || substr(md5('{mixing.SEED}' || r.site), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM ranked r JOIN targets t USING (site))
SELECT doc_id, size, source_size, target,
  CAST(floor(place * e + u) - floor((place - 1) * e + u) AS BIGINT) * size AS taken
FROM spread"""


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of all embeddings for each query row."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


OP10_SQL = f"""
WITH usable AS (
  SELECT row_number() OVER () AS place, vec_id,
    list_transform(embedding, lambda c: floor(c::DOUBLE * {topk.SCALE})) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.place <> c.place AND len(q.v) = len(c.v) WHERE q.vec_id % {topk.EVERY} = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {topk.K}"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, for all documents."""
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by Jaccard similarity of their three-word shingles."""
    return partenum.jaccard_components(_table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS place, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
sets AS (
  SELECT place, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {partenum.SHINGLE} THEN [words]
    ELSE list_distinct(list_transform(generate_series(1, len(words) - {partenum.SHINGLE - 1}),
      lambda i: words[i:i + {partenum.SHINGLE - 1}])) END AS shingles FROM worded),
classes AS MATERIALIZED (
  SELECT min(place) AS node, list_sort(shingles) AS shingles FROM sets WHERE len(shingles) > 0 GROUP BY list_sort(shingles)),
named AS MATERIALIZED (
  SELECT s.place, s.doc_id, c.node, len(s.shingles) AS n_shingles
  FROM sets s LEFT JOIN classes c ON list_sort(s.shingles) = c.shingles),
postings AS MATERIALIZED (SELECT node, len(shingles) AS n, unnest(shingles) AS shingle FROM classes),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.node AS a, y.node AS b, any_value(x.n + y.n) AS total, count(*) AS shared
    FROM postings x JOIN postings y ON x.shingle = y.shingle AND x.node <> y.node GROUP BY ALL)
  WHERE 100 * shared >= {partenum.THRESHOLD_PCT} * (total - shared)),
reach(node, other) AS (
  SELECT node, node FROM classes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (
  SELECT r.node, min(n.doc_id) AS component_id FROM reach r JOIN named n ON n.node = r.other GROUP BY r.node)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles,
  CASE WHEN n.n_shingles = 0 THEN n.doc_id ELSE l.component_id END AS component_id
FROM named n LEFT JOIN least l USING (node)"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item, over all documents."""
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP13_SQL = f"""
WITH cut AS (SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
worded AS (SELECT place, doc_id, terms, len(terms) AS n FROM cut WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM worded),
counted AS MATERIALIZED (
  SELECT place, doc_id, n, term, count(*) AS tf
  FROM (SELECT place, doc_id, n, unnest(terms) AS term FROM worded) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, totals GROUP BY term),
items AS (
  SELECT item, item_id, unnest(list_distinct(terms)) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL)),
scored AS (
  SELECT item, item_id, place, doc_id, CAST(sum(w * ((1000000000 * tf)
    // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN counted USING (term), totals GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, place) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {lexical.K}"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_lm_scoring, op3_pii, op4_secret_scan, op5_minhash_near_dedup,
                            op6_quality_rules, op7_token_counts, op8_bpe_codec, op9_mixing, op10_topk_search,
                            op11_alignment, op12_ngram_join, op13_lexical_search, pipeline)}

ORACLE = {"op1_line_dedup": OP1_SQL, "op9_mixing": OP9_SQL, "op10_topk_search": OP10_SQL,
          "op12_ngram_join": OP12_SQL, "op13_lexical_search": OP13_SQL}

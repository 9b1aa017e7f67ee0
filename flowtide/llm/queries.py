"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fingerprints, jaccard, line_dedup, mixing, packing, quality, substrings, token_counts, token_store, toxicity, whitening, wrappers
from .common import documents, scratch_path, written


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = lambda key: F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    model, counts = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("key"))
    scored = toxicity.score(counts, model)
    return scored.select(F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "score", "predicted", F.col("evidence").cast("array<struct<example:bigint,label:int,cosine:double>>"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = fingerprints.edited_versions(documents(spark, sf_dir), longest=fingerprints.FINE)
    sketched = {f"{c}_sketch": fingerprints.sketch(F.col(c)) for c in ("keys", "edited_keys", "next_keys")}
    kept = written(versions.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited").withColumns(sketched), "versions")
    edited = fingerprints.compare(kept.select("doc_id", "keys", "edited_keys", "keys_sketch", "edited_keys_sketch"), "keys", "edited_keys", sketches=("keys_sketch", "edited_keys_sketch"))
    following = fingerprints.compare(kept.select("doc_id", "keys", "next_keys", "keys_sketch", "next_keys_sketch"), "keys", "next_keys", sketches=("keys_sketch", "next_keys_sketch"))
    prints = [fingerprints.as_text(F.col(f"{c}_sketch")).alias(name) for c, name in (("keys", "fingerprint"), ("edited_keys", "edited_fingerprint"))]
    near = edited.select("doc_id", F.col("likeness").alias("near_edited")).join(following.select("doc_id", F.col("likeness").alias("near_next")), "doc_id")
    return kept.select("doc_id", "n_chars", "edited_sha256", *prints).join(near, "doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = quality.fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(docs, field, keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), literal=False)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, s.owner IS NOT NULL AND s.owner <> k.doc_id AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three commits: all documents inserted; every count raised by the end id that training adds to each
    document, as a revision in one tokenizer version and as a delete and an insert in the other; and that batch
    committed again as after a lost answer."""
    versions = {name: public_tokenizers.path(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k")}
    counts = written(token_counts.count_tokens(documents(spark, sf_dir), versions, keep=["source", "lang"], literal=False), "token-counts")
    rollup = token_counts.Rollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("load", counts.select("*", F.lit("insert").alias("kind"), F.lit(0).alias("old_tokens")))
    new, old = F.col("n_tokens") + 1, F.col("n_tokens")
    change = lambda kind, n, before: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), before.cast("long").alias("old_tokens"))
    revision = F.array(change("revise", new, old))
    replaced = F.array(change("delete", F.lit(None), old), change("insert", new, F.lit(None)))
    changes = counts.select("source", "lang", "tokenizer", F.inline(F.when(F.col("tokenizer") == "byte_bpe_50k", revision).otherwise(replaced)))
    for _ in range(2):
        rollup.commit("end-ids", changes.withColumnRenamed("n", "n_tokens"))
    return rollup.totals()


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    taken = mixed.draws.groupBy("key1", "key2").agg(F.sum("n_words").alias("taken"))
    sources = F.broadcast(mixed.sources) if mixed.sources.count() <= mixing.BROADCAST_SOURCES else mixed.sources
    both = mixed.documents.join(taken, ["key1", "key2"], "left").alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return both.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), literal=False)
    return store.documents().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(documents(spark, sf_dir)).withColumnRenamed("key", "doc_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT row_number() OVER () AS doc, lang, source,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS whole FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), counted AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(whole)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM groups g LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * l.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.whole + 5)) // (l.total + 5 * l.v))::BIGINT AS q
  FROM totals t JOIN langs l ON l.lang = t.lang JOIN kept k ON k.lang = t.lang
  LEFT JOIN counted c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), both_parts AS (
  SELECT * FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM both_parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(vectors, keep=["vec_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_toxicity, op2_fingerprints, op3_quality_rules, op4_packing, op5_line_dedup, op6_token_counts, op7_substring_dedup,
    op8_mixing, op9_token_store, op10_jaccard_join, op11_source_divergence, op12_html_extraction, op13_embedding_whitening,
)}
ORACLE: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op11_source_divergence": OP11_SQL}

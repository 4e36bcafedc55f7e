"""One query per numbered operator, with production parameters over whole tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import (
    exact_dedup,
    fingerprint,
    katz,
    language_id,
    license_scan,
    line_dedup,
    minhash_dedup,
    mixing,
    periodic_runs,
    phrases,
    sentencepieces,
    token_blocks,
    warc,
)
from chronopanel.scale import new_path

Query = Callable[[SparkSession, str], DataFrame]
WARC_DATE = "2024-01-01T00:00:00Z"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf, "documents"), words=2, percent=80)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.license_matches(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.round_trips(table(spark, sf, "documents"), path, keep_ids=False).withColumnRenamed("id", "doc_id")


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.train(docs.where(~F.coalesce(held_out, F.lit(False))))
    found = language_id.predicted(docs, model, carry=[F.coalesce(held_out, F.lit(False)).alias("held_out")])
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return found.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__times")).alias("taken"),
    )


def op6_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as responses; their derivatives written as WARC files, read back and digested."""
    path = new_path(spark, "warc")
    warc.write_warc(warc.derivatives(warc.responses(table(spark, sf, "pages"), WARC_DATE)), path)
    return warc.read_warc(spark, path).withColumn("block_sha256", sha256(F.col("block"))).drop("block", "concurrent_to")


def op7_token_blocks(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_blocks.write_blocks(table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_blocks.read_blocks(spark, path, keep_ids=False)


def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    found = fingerprint.with_edits(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        sha256(F.col("edited")).alias("edited_sha256"),
        fingerprint.written(F.col("v")).alias("fingerprint"),
        fingerprint.written(F.col("ve")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("v"), F.col("ve")).alias("near_edited"),
        fingerprint.likeness(F.col("v"), F.col("vn")).alias("near_next"),
    )


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = exact_dedup.marked(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("__keep_id").alias("keep_id"),
        F.col("__group_size").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.col("__sha256").alias("text_sha256"),
    )


def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.without_repeats(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_deleted", "deleted_words", sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"))


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic_runs.periodic_runs(docs, edit=periodic_runs.looped, edit_by=crc)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
        sha256(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")).alias("runs_sha256"),
        sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op13_katz_scores(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return katz.scored(table(spark, sf, "documents"), train=~F.coalesce(held_out, F.lit(False))).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_license_scan,
        op3_sentencepiece,
        op4_language_id,
        op5_mixing,
        op6_warc_derivatives,
        op7_token_blocks,
        op8_fingerprints,
        op9_exact_dedup,
        op10_line_dedup,
        op11_periodic_runs,
        op12_phrases,
        op13_katz_scores,
    )
}

ORACLES = {
    "op5_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS chars
  FROM documents
), keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE)
            / CASE WHEN chars BETWEEN 3 * size AND 12 * size THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS key
  FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), walked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget,
         coalesce(sum(2.0::DOUBLE * source_size) OVER earlier, 0) AS used,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS open_weight
  FROM sources
  WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), settled AS (
  SELECT *, cap * open_weight <= (budget - used) * weight AS is_full FROM walked
), targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap
              ELSE weight * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target
  FROM settled
), rested AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets
), drawn AS (
  SELECT k.doc_id, k.size, r.source_size, r.target, r.epochs, r.target - r.epochs * r.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id) AS upto
  FROM keyed k JOIN rested r ON k.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
""",
    "op9_exact_dedup": r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM plain WINDOW w AS (PARTITION BY t)
""",
    "op12_phrases": r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), words AS (
  SELECT lang, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4
  FROM (SELECT piece, lang, unnest(w) AS w, unnest(range(len(w))) AS i FROM pieces)
  WINDOW p AS (PARTITION BY piece ORDER BY i)
), counted AS (
  SELECT lang, 1 AS k, w AS phrase, count(*) AS f FROM words GROUP BY ALL
  UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM words WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM words WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM words WHERE w4 IS NOT NULL GROUP BY ALL
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, h.f AS l, t.f AS r, (2000000::HUGEINT * c.a // (h.f + t.f))::BIGINT AS score
  FROM candidates c, (VALUES (1), (2), (3)) AS places(j), counted h, counted t
  WHERE j < c.k AND h.lang = c.lang AND h.k = j AND h.phrase = array_to_string(c.w[1 : j], ' ')
    AND t.lang = c.lang AND t.k = c.k - j AND t.phrase = array_to_string(c.w[j + 1 : c.k], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_ones AS (
  SELECT DISTINCT c.lang, c.phrase
  FROM candidates b, (VALUES (2), (3)) AS sizes(size), (VALUES (1), (2), (3)) AS places(i), candidates c
  WHERE size < b.k AND i + size - 1 <= b.k AND c.lang = b.lang AND c.phrase = array_to_string(b.w[i : i + size - 1], ' ') AND 100 * b.a >= 80 * c.a
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM lowest ANTI JOIN inner_ones USING (lang, phrase))
     JOIN (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang) USING (lang)
WHERE rank <= 2000
""",
}

"""From raw documents to token ids: language, exact copies, near copies, mixture, SentencePiece."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import exact_dedup, language_id, minhash_dedup, mixing, sentencepieces
from chronopanel.scale import stored

#: Code length per byte beyond which a text is in none of the learned languages.
MOST_BITS = 7.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: no letter, or bytes as costly as noise.

    If no row has both a text and a language nothing can be learned; then only texts without a letter are rejected.
    """
    model = language_id.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    others = [c for c in docs.columns if c != "text"]
    carried = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("__doc")]
    found = language_id.predicted(docs, model, carry=carried, keep_text=True)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("bits") <= MOST_BITS))
    return kept.select(*[F.col("text") if c == "text" else F.col("__doc").getField(c).alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return minhash_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources; a document taken twice is there twice."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, counted and digested, and the digest of the decoded text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.round_trips(docs, path, keep_ids=False).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("sentencepiece", tokens)]

#: Code lengths, MinHash and pieces have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to token ids: quality, line templates, near-duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on everything the one before it kept. All but the last return the
columns of ``documents``; the last returns a row of tokens for every document of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, line_templates, minhash_dedup, mixing, quality_crf
from tidewatch.llm.tables import read, whole


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the cut stay."""
    return quality_crf.accepted(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates leave every document but the first that has them; no document goes."""
    return line_templates.drop_templates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    return minhash_dedup.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per epoch in which the mix takes a document; the last epoch of a source is cut at its target."""
    return mixing.mix_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, for every row of the mix."""
    import public_tokenizers

    ranks = bpe.rank_file()
    texts = docs.select("doc_id", whole(docs["text"]).alias("text"))
    decoded = bpe.decode(bpe.encode(texts, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("bytes").cast("string").alias("decoded"))


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("source_mix", source_mix), ("byte_bpe", byte_bpe)]

# The classifier is trained, so SQL cannot state the rows; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

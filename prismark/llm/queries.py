"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.llm import bpe, embed_dedup, langid, minhash, packing, ppm, rollup, toxicity, warc, webp
from prismark.llm.common import fold

WORD_BPE, RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record: archives of one gzip stream, rewritten with a member per record, read by their index."""
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities of low quality and, given that, of toxicity; labels of one fold are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.of_documents(docs, table(spark, sf_dir, "labels"), hold_out=True)
    held_out = fold("doc_id", toxicity.HELD_OUT) == 1
    return toxicity.predicted(docs, chain).select("doc_id", held_out.alias("held_out"), "p_low_quality", "is_low_quality", "p_toxic", "is_toxic")


def op3_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a lossless WebP picture, read back and reduced to digests and a feature."""
    return webp.media_report(table(spark, sf_dir, "documents"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a byte-context trie of order 5 and its unigram base score."""
    return ppm.scored(table(spark, sf_dir, "documents"), ppm.held_out_by(7, 2))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens, 512 segments and 2048 loss-bearing tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on instruction data: turns of conversations, of which the assistant's bear loss; all limits bind."""
    limits = packing.Limits(tokens=2048, segments=16, loss=1700)
    turns = table(spark, sf_dir, "conversations")
    return packing.packed(turns, public_tokenizers.path(WORD_BPE), limits, key="conv_id", loss=F.col("role") == "assistant")


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the labels of two folds in three."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    model = langid.learned(langid.training(docs, ~held_out))
    return langid.predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_spherical_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in classes linked at a cosine of 0.93 or more within their label."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text, as counts and digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of the documents after inserts, deletes, recounts and a replay."""
    one, two = (public_tokenizers.path(n) for n in (WORD_BPE, RANKS))
    return rollup.document_totals(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), one, two, public_tokenizers.PATTERN)


def op10_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in classes linked at a Jaccard similarity of 0.85 or more on three-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, part=85, whole=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_normaliser, op2_toxicity_chain, op3_lossless_webp, op4_ppm, op5_vector_packing, instruction_packing, op6_cross_parsing, op7_spherical_kmeans, op8_bpe, op9_token_rollup, op10_minhash_hamming)}


def oracle_sql() -> dict[str, str]:
    """None of the ten can be told in SQL: their models, codes and tokenizers are beyond it; tests hold them against brute force."""
    return {}

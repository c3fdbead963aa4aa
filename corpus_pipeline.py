"""The corpus pipeline over ``documents``: language, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.llm import langid, minhash, packing, toxicity
from prismark.llm.common import MADE, clean, quoted, remove, shared_dir, unused, written
from prismark.llm.queries import WORD_BPE


#: A document goes if a smaller share of its letters occurs in what the labels teach.
KNOWN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labels teach; those with no text, no letter or mostly unknown letters go.

    With no label to learn from, all documents with a letter stay.
    """
    model = langid.learned(langid.training(docs, F.lit(True)))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score, known = (unused(docs, n) for n in ("lang_pred", "score", "known"))
    found = langid.predicted(docs, model, lang=lang, score=score, known=known)
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(known) >= KNOWN)).select(*quoted(docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the chain does not call toxic; low quality is an earlier link, not a reason to go.

    Every row is judged by its text alone: equal texts stay or go together, whatever their ids, and a null or empty text has
    each link's base rate, so it stays unless most of the labelled rows are toxic. Without labels all rows stay.
    """
    chain = toxicity.of_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    prefix = ""
    while any(unused(docs, f"{prefix}{kind}_{link.name}") != f"{prefix}{kind}_{link.name}" for link in chain.links for kind in ("p", "is")):
        prefix += "_"
    return toxicity.predicted(docs, chain, prefix=prefix).where(f"not {prefix}is_toxic").select(*quoted(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class linked at a Jaccard similarity of 0.8 on five-word shingles.

    Rows are told apart by a number of their own. Of a class the row with the lowest id stays, null ids last, then that with
    the lowest hash of the text; texts without a word are no near copies of anything.
    """
    return minhash.deduplicated(docs, words=5, part=80, whole=100)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens.

    Every row is packed, a null or empty text as its end id alone; rows that share an id or a text are packed each for
    themselves; other columns are not read. An empty table gives no sequences.
    """
    return packing.packed(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("language", language), ("toxicity", toxic), ("near duplicates", near_duplicates), ("packing", packed)]
#: Automata, classifiers, signatures and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote is deleted when the next one's documents are written."""
    path = shared_dir(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(MADE)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{path}/{k}")
        clean(spark, before)
        if k:
            remove(spark, f"{path}/{k - 1}")
    return docs

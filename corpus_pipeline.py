"""The corpus pipeline: stages over the documents kept so far.

Toxic documents go, then exact copies, then all but one document of each group of near copies; the mixture repeats documents
toward target weights and drops none (no rate is below one); last the texts are encoded and the ids decoded. Stages read what the stage before wrote, so
a lost executor costs no more than the stage it was in.
"""

from __future__ import annotations

import math

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.exact_dedup import drop_copies
from tributary.llm.mixing import mix
from tributary.llm.ngram_join import one_of_each_group
from tributary.llm.queries import DOMAIN
from tributary.llm.queries import WEIGHTS as ALL_WEIGHTS
from tributary.llm.sentencepiece_codec import encode_documents
from tributary.llm.toxicity import fit, scorer
from tributary.sources.staging import staged

#: What each domain is to have of the tokens, relative to the others: as in `op7_mixing`, without the toxic texts, which are gone.
WEIGHTS = {k: v for k, v in ALL_WEIGHTS.items() if k != "toxic"}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5, by a model of all labels."""
    score = scorer(fit(docs, _labels(spark, sf_dir)))
    return docs.where(score(F.col("text")) < 0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to the case of A-Z, the one with the largest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, 0.75), the one with the smallest id."""
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the mixture asks: at the least total at which no domain shrinks."""
    return mix(docs, _labels(spark, sf_dir), F.expr(DOMAIN), WEIGHTS, total=math.inf, least=1.0)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row: its ids, and the text decoded from them."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", near_dedup), ("mixing", mixing), ("sentencepiece", encoding)]

#: Learned scores, components and subword merges are not to be had from SQL; tests hold the rows of each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

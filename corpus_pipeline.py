"""A pipeline over documents: language, toxicity, near-duplicates, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.llm import langid, mixing, pieces, probminhash, toxicity
from ledgerwatch.llm.common import lean_workers, table
from ledgerwatch.workspace import written

TOXIC = 0.7

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; lang becomes the predicted one. Rejected texts go: null, letterless, undecided."""
    model = langid.fit(docs)
    names = docs.columns
    found = docs.withColumn("__found", langid.identify(model, "text"))
    kept = found.where(~F.col("__found.rejected")).withColumn("lang", F.col("__found.lang"))
    return kept.select(names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is under 0.7."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity(spark, model, "text") < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least doc_id."""
    return probminhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of the whole text, their number, and whether they give the text back."""
    model = pieces.Pieces.read()
    coded = pieces.encode(docs.select("doc_id", "source", "text"), model, decoded="decoded")
    same = F.col("decoded").eqNullSafe(F.col("text"))
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_ids"), same.alias("same"))


def _lean(stage: Stage) -> Stage:
    """``stage`` with lean Python workers, whoever calls it."""

    @wraps(stage)
    def running(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        lean_workers(spark)
        return stage(spark, docs, sf_dir)

    return running


STAGES = [
    ("language", _lean(identify_language)),
    ("toxicity", _lean(drop_toxic)),
    ("near_duplicates", _lean(drop_near_duplicates)),
    ("mix", _lean(mix)),
    ("pieces", _lean(encode_pieces)),
]

# counts by language model, first arrivals and compressed sizes have no SQL; tests compare stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Search over text: chunks, vectors, nearest passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.functions.text import PASSAGE_SEPARATOR, chunk_documents, passage
from ledgerwatch.operators.neighbors import FEW_QUERIES, is_few, knn
from ledgerwatch.sources.corpus import VECTOR_COLUMNS
from ledgerwatch.workspace import written

DIMENSIONS = 384
BROADCAST_HITS = 1_000_000
NO_DOCUMENTS = "No regulatory documents loaded."


def fit_encoder(texts: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> PipelineModel:
    """A hashing TF-IDF encoder; any fitted transformer that adds ``embedding`` can stand in."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_unit"),
        ]
    ).fit(texts)


Encoder = PipelineModel | Callable[[Column], Column]


def embed(texts: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """Add ``embedding``, an array of float of unit length (zero for a text without words).

    ``encoder`` is a pipeline from ``fit_encoder``, or any function from the text column to an
    array of numbers, such as a pandas UDF.
    """
    if not isinstance(encoder, PipelineModel):
        return texts.withColumn("embedding", encoder(F.col(text)).cast("array<float>"))
    encoded = encoder.transform(texts)
    return encoded.select(*texts.columns, vector_to_array("_unit", "float32").alias("embedding"))


def chunk_table(docs: DataFrame, key: str, **chunking) -> DataFrame:
    """``chunk_id, doc_id, paragraph, source, text`` of every chunk. ``key`` is the documents' key.

    A chunk is known by its document's key and its place there; ``chunk_id`` is a
    generated number for the search, good once the table is written.
    """
    return chunk_documents(docs, **chunking).select(
        F.monotonically_increasing_id().alias("chunk_id"),
        F.col(key).alias("doc_id"),
        "paragraph",
        "source",
        F.col("chunk").alias("text"),
    )


def written_chunks(docs: DataFrame, key: str, **chunking) -> DataFrame:
    """``chunk_table`` as a written table, then dealt out evenly: one document may hold any share of the chunks."""
    return written(written(chunk_table(docs, key, **chunking), "chunk_rows").repartition("chunk_id"), "chunks")


def build_vectors(docs: DataFrame, key: str, encoder: Encoder | None = None, **chunking) -> DataFrame:
    """Documents to the vector table, with an encoder fitted to them if none is given."""
    chunks = written_chunks(docs, key, **chunking)
    encoder = encoder or fit_encoder(chunks)
    return embed(chunks, encoder).select(*VECTOR_COLUMNS)


def chunk_lookup(hits: DataFrame, chunks: DataFrame, few: bool = False) -> DataFrame:
    """The text of every hit (``id``), by equi-join; a hit without a text keeps its row.

    ``few`` hits of a checked number travel to the chunks, which then need no shuffle.
    Otherwise both sides shuffle by id, and AQE splits a chunk that is hit very often.
    """
    hits = F.broadcast(hits) if few else hits
    return chunks.withColumnRenamed("chunk_id", "id").join(hits, "id", "right")


def retrieve(
    queries: DataFrame,
    vectors: DataFrame,
    top_k: int = 2,
    max_chars: int = S.MAX_PASSAGE_CHARS,
    empty_text: str = NO_DOCUMENTS,
    few_queries: int = FEW_QUERIES,
    **layout,
) -> DataFrame:
    """``query_id, passages``: the nearest chunks of each query, cut and joined.

    ``queries`` has ``id, vector``. Without any chunk every query gets ``empty_text``.
    """
    base = vectors.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
    few = is_few(queries, few_queries)
    hits = knn(queries, base, top_k, few=few, **layout)
    chunks = vectors.select("chunk_id", passage(F.col("text"), max_chars).alias("text"))
    texts = chunk_lookup(hits, chunks, few and top_k * few_queries <= BROADCAST_HITS)
    joined = texts.groupBy("query_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("rank", "text")))["text"], PASSAGE_SEPARATOR).alias(
            "passages"  # at most top_k entries
        )
    )
    return (
        queries.select(F.col("id").cast("long").alias("query_id"))
        .join(joined, "query_id", "left")
        .withColumn("passages", F.coalesce("passages", F.lit(empty_text)))
    )

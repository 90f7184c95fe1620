"""Language identification by compression: the language whose words compress a text best."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerwatch.llm.common import learned_from, seeded, small_batches

UNKNOWN = "und"
BLOCK = 4096  # bytes that are compressed at once, so that the dictionary counts in long texts too
SHORT = 256  # blocks under so many bytes are repeated, else zstandard stores them as they are
LEVEL = 6
MIN_MATCH = 3
DICTIONARY = 81_920  # bytes
LONGEST = 32  # bytes of a word in a dictionary
WORDS_AT_ONCE = 200_000  # that a task counts before it hands them on
FEW = 256  # rows of a language that are all counted: a fifth of fewer says little of a small share
PARTS = 100_000
_OTHER = re.compile(r"[\W\d_]+")

RESULT = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


@lru_cache(maxsize=1)
def _compressors(dictionaries: tuple[bytes, ...]) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in dictionaries:
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            source_size=BLOCK,
            dict_size=len(content),
            min_match=MIN_MATCH,
            write_checksum=False,
            write_content_size=False,
            write_dict_id=False,
        )
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params))
    return out


def letters(text: str) -> bytes:
    """The words of a text in lower case, a space between them."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageModel:
    """Languages with a dictionary of raw text each.

    ``min_margin``: least gain over the second language, as a share of the compressed size.
    """

    langs: tuple[str, ...]
    dictionaries: tuple[bytes, ...] = field(repr=False)
    min_margin: float = 0.0

    def sizes(self, text: str) -> np.ndarray:
        """Bytes of the compressed text per language."""
        data = letters(text)
        out = np.zeros(len(self.langs), dtype=np.int64)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        blocks = [4 * block if len(block) < SHORT else block for block in blocks]
        for i, compressor in enumerate(_compressors(self.dictionaries)):
            out[i] = sum(len(compressor.compress(block)) for block in blocks)
        return out

    def margin(self, sizes: np.ndarray) -> float:
        """What the second smallest size has more than the smallest, as a share of that."""
        first, second = np.sort(sizes)[:2]
        return float(second - first) / max(float(first), 1.0)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        gains = np.minimum(sizes - sizes[best], 200)
        score = 1.0 / float(np.sum(2.0**-gains))
        return self.langs[best], score, len(sizes) > 1 and self.margin(sizes) <= self.min_margin


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, word, n) with the number of texts that hold the word, parts of words beyond ``LONGEST`` bytes."""
    known: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.lang, batch.text, strict=True):
            words = set(letters(text).split())
            known.update((lang, x[i : i + LONGEST]) for x in words for i in range(0, len(x), LONGEST))
            if len(known) > WORDS_AT_ONCE:
                yield _counted(known)
                known.clear()
    if known:
        yield _counted(known)


def _counted(known: Counter) -> pd.DataFrame:
    return pd.DataFrame([(lang, word, n) for (lang, word), n in known.items()], columns=["lang", "word", "n"])


def _frequent(texts: DataFrame) -> list[tuple[str, bytes]]:
    """For each language its words by how many texts (lang, text) hold them, the most frequent last, ``DICTIONARY`` bytes."""
    counts = texts.mapInPandas(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64("word"), "word")
    chosen = counts.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= DICTIONARY // 2)
    place = F.sum(F.length("word") + 1).over(Window.partitionBy("lang").orderBy("nth"))
    chosen = chosen.withColumn("place", place).where(F.col("place") <= DICTIONARY)
    listed = chosen.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("nth", "word")), asc=False).alias("words")).collect()
    return sorted((r["lang"], b" ".join(bytes(x["word"]) for x in r["words"])) for r in listed)


def fit(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_lang: int | None = None,
    piece_chars: int = 320,
    calibrate: int | None = None,
    loss: float = 0.005,
) -> LanguageModel:
    """A dictionary per language of the words that most of its texts hold, the most frequent last.

    Only rows with a key outside the held-out fold, a language and a letter in the text are learned from. Four fifths of
    them, by a seeded hash, are counted (all where a language has fewer than ``FEW`` rows), the others calibrate. The
    driver receives ``DICTIONARY`` bytes a language. Ties in the language's order fall to the name.

    The margin under which texts are rejected is the one that ``loss`` of the calibrating texts do not pass that are told
    rightly, down to ``1 / PARTS``. Where there are none, only ties are rejected.

    With ``per_lang``, dictionaries are instead pieces of ``piece_chars`` characters of that many texts, chosen by a
    seeded hash, and all other rows calibrate, or about ``calibrate`` of each language.
    """
    learned = docs.where(
        learned_from(key) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (F.col(lang) != UNKNOWN)
    )
    small_batches(learned.sparkSession)
    h = seeded(9, F.col(key), F.col(text))
    rows = learned.select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h"), seeded(10, F.col(key), F.col(text)).alias("place"))
    sizes = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("n")))  # a row per language
    rows = rows.join(sizes, "lang")
    if per_lang is None:
        fifth = (F.pmod(F.shiftright("place", 20), F.lit(5)) == 0) & (F.col("n") >= FEW)
        found, unused = _frequent(rows.where(~fifth).select("lang", "text")), rows.where(fifth)
    else:
        found, last = _pieces(rows, per_lang, piece_chars)
        unused = rows.join(F.broadcast(last), "lang").where("h > last")
    # one length for all, so that none gains by size: shorter ones are repeated; under 8 bytes zstandard takes none
    size = max(16, max((len(x) for _, x in found), default=0))
    model = LanguageModel(tuple(x for x, _ in found), tuple(_repeated(x, size) for _, x in found))
    if len(found) < 2:
        return model
    if calibrate is not None:
        unused = unused.where(F.pmod("place", F.lit(1 << 20)) * F.col("n") < calibrate * (1 << 20))
    shared = learned.sparkSession.sparkContext.broadcast(model)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [shared.value.sizes(x) for x in batch.text]
            right = [shared.value.langs[int(np.argmin(x))] == y for x, y in zip(sizes, batch.lang, strict=True)]
            yield pd.DataFrame({"margin": [shared.value.margin(x) for x, told in zip(sizes, right, strict=True) if told]}, dtype=float)

    told = unused.select("lang", "text").mapInPandas(margins, "margin double")
    if per_lang is None:  # few different values, however many texts
        told = told.select((F.floor(F.col("margin") * PARTS) / PARTS).alias("margin"))
    counts = told.groupBy("margin").agg(F.count("*").alias("n"))
    narrow = counts.agg(F.percentile("margin", F.lit(loss), F.col("n"))).first()[0]
    return replace(model, min_margin=narrow or 0.0)


def _pieces(rows: DataFrame, per_lang: int, piece_chars: int) -> tuple[list[tuple[str, bytes]], DataFrame]:
    """Joined pieces of the first ``per_lang`` texts of each language by their hash, and the last hash of each."""
    offset = F.pmod("h", F.greatest(F.length("text") - piece_chars, F.lit(0)) + 1).cast("int")
    pieces = rows.select("lang", "h", F.substring("text", offset + 1, F.lit(piece_chars)).alias("piece"))
    first = Window.partitionBy("lang").orderBy("h", "piece")
    chosen = pieces.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_lang)
    texts = (
        chosen.groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "piece"))).alias("pieces"), F.max("h").alias("last"))
        .select("lang", F.array_join(F.col("pieces.piece"), "\n").alias("text"), "last")
        .collect()
    )
    last = rows.sparkSession.createDataFrame([(r["lang"], r["last"]) for r in texts], "lang string, last long")
    return sorted((r["lang"], letters(r["text"])) for r in texts), last


def _repeated(data: bytes, size: int) -> bytes:
    return (data * -(-size // max(len(data), 1)))[:size].ljust(size)


def identify(model: LanguageModel, text: str | Column) -> Column:
    """(lang, score, rejected) of each whole text.

    ``lang`` is ``und`` where the text is null or has no letter, or no language was learned. ``score`` is
    the share of the best language when each counts two to the minus its size in bytes. ``rejected`` marks
    those and texts whose margin is not above ``min_margin``; equal sizes go to the first language by name.
    """
    spark = SparkSession.active()
    small_batches(spark)
    spark_model = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = spark_model.value
        for texts in batches:
            yield pd.DataFrame([known.judge(x) for x in texts], columns=["lang", "score", "rejected"])

    return judge(F.col(text) if isinstance(text, str) else text)


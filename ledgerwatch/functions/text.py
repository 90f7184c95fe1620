"""Text expressions for chunks, passages and display snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch import schema as S

# The characters that count as white space at the ends of a chunk.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PASSAGE_SEPARATOR = "\n\n---\n\n"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def chunk_documents(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    separator: str = "\n\n",
    min_chars: int = S.MIN_CHUNK_CHARS,
) -> DataFrame:
    """One row per paragraph of at least ``min_chars`` stripped characters.

    Keeps every column of ``docs`` but the text, and adds ``paragraph`` (position
    in its document) and ``chunk``.
    """
    pieces = F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), _literal_regex(separator), -1)
    keep = [c for c in docs.columns if c != text]
    return (
        docs.select(*keep, F.posexplode(pieces).alias("paragraph", "_piece"))
        .withColumn("chunk", stripped(F.col("_piece")))
        .where(F.length("chunk") >= min_chars)
        .drop("_piece")
    )


def passage(text: Column, max_chars: int = S.MAX_PASSAGE_CHARS) -> Column:
    """A text cut back to its last whole word when longer than ``max_chars``."""
    cut = F.regexp_replace(F.substring(text, 1, max_chars), r" [^ ]*\z", "")
    return F.when(F.length(text) > max_chars, F.concat(cut, F.lit(" …"))).otherwise(text)


def snippet(text: Column, max_chars: int = 200) -> Column:
    """The start of a text for display, with a mark if something was left out."""
    head = F.substring(text, 1, max_chars)
    return F.when(F.length(text) > max_chars, F.concat(head, F.lit("…"))).otherwise(text)


def _literal_regex(separator: str) -> str:
    return "\\Q" + separator + "\\E"

"""Chat formatting by grammar round trip, in column expressions only.

Grammar: a conversation is a sequence of turns ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. The parser cuts
wherever one of the two control strings stands, takes the role up to the first line break and undoes one
level of escaping. A turn that the parser does not give back as it was gets escaped.

Escaping is one to one: in a text, ``<`` followed by any number of backslashes and ``|`` gets one more
backslash, so ``<|`` never occurs in escaped text; in a role, ``%``, ``<``, ``|`` and line breaks become
percent codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"

BLOCK = 4096  # code points of the blocks that spans are cut from

ROLE_CODES = (("<", "%3C"), ("|", "%7C"), ("\n", "%0A"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    role = F.replace(role, F.lit("%"), F.lit("%25"))
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(code), F.lit(plain))
    return F.replace(role, F.lit("%25"), F.lit("%"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END), F.lit("\n"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), escapes undone."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n?|(?=<\|im_start\|>)", -1), lambda p: p.startswith(START))

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(START) + 1, 2**31 - 1)
        role = F.substring_index(body, "\n", 1)
        return F.struct(
            unescape_role(role).alias("role"),
            unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"),
        )

    return F.transform(pieces, turn)


def format_turn(role: Column, text: Column) -> Column:
    """The rendered turn, escaped where the parser would misread it."""
    plain = render_turn(role, text)
    back = parse_turns(plain)
    same = (F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text)
    return F.when(same, plain).otherwise(render_turn(escape_role(role), escape(text)))


def cut_spans(text: Column, spans: Column) -> Column:
    """The texts under (start, length) spans, in their order.

    A text is dealt into blocks once and each span is cut from the blocks it touches, so the work grows with the
    text and not with its product with the spans.
    """

    def cut(blocks: Column, span: Column) -> Column:
        first = F.floor(span["start"] / BLOCK).cast("int")
        last = F.floor((span["start"] + F.greatest(span["length"], F.lit(1)) - 1) / BLOCK).cast("int")
        return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), span["start"] - first * BLOCK + 1, span["length"])

    dealt = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))  # bound, so that it is done once
    return F.transform(dealt, lambda blocks: F.transform(spans, lambda span: cut(blocks, span)))[0]


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans``.

    ``loss_spans`` holds (start, length) in code points of ``formatted``, one per assistant turn, covering
    its escaped text. Turns are ordered by turn, ties by role and text; null turns come first, null roles
    and texts count as empty; repeated rows are repeated turns; rows with a null conversation form one.
    No rows: no conversations. Other columns are ignored. A conversation is one value of the result, so
    its turns meet in one task; nothing else is gathered. The work grows with its length.
    """
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rendered = turns.withColumn("piece", format_turn(F.col("role"), F.col("text")))
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rendered.select("conv_id", "role", "piece", F.sum(F.length("piece")).over(so_far).cast("int").alias("end"))
    shown = len(START) + 1 + F.length(F.substring_index(F.substring("piece", len(START) + 1, 2**31 - 1), "\n", 1))
    placed = ends.select(
        "conv_id",
        F.struct(
            (F.col("end") - F.length("piece")).alias("at"),
            (F.col("end") - F.length("piece") + shown).alias("start"),
            (F.length("piece") - shown - len(END) - 1).alias("length"),
            (F.col("role") == "assistant").alias("lost"),
            "piece",
        ).alias("p"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p["lost"]), lambda p: F.struct(p["start"], p["length"]))
    return whole.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts say: turns as parsed, texts under the loss spans."""
    parsed = formatted.select(
        "conv_id",
        "formatted",
        parse_turns(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(cut_spans(F.col("formatted"), F.col("loss_spans")), unescape), "").alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

"""Chat formatting: exact round trip, spans, and the defined results of odd rows."""

import hashlib
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerwatch.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
PARTS = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "\n", "assistant", "%25", "%0A", "<\\|", "a", "é", "😀", " "]


def made(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def expected(rows):
    out = {}
    for conv, _turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def check(spark, rows):
    df = chat.format_conversations(made(spark, rows))
    shown = {r.conv_id: r for r in df.collect()}
    turns = {r.conv_id: [tuple(t) for t in r.t] for r in df.select("conv_id", chat.parse_turns(df.formatted).alias("t")).collect()}
    back = {r.conv_id: r for r in chat.read_back(df).collect()}
    want = expected(rows)
    assert set(shown) == set(want)
    for conv, said in want.items():
        assert turns[conv] == said
        loss = "".join(t for r, t in said if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert back[conv].asDict() == Row(
            conv_id=conv, n_turns=len(said), turns_sha256=digest, loss_chars=len(loss),
            loss_sha256=hashlib.sha256(loss.encode()).hexdigest(), formatted_chars=len(shown[conv].formatted),
        ).asDict()
        assert len(shown[conv].loss_spans) == sum(r == "assistant" for r, _ in said)
    return shown


def test_random_texts_come_back(spark):
    rng = random.Random(4)
    rows = [
        (c, t, rng.choice(["user", "assistant", "a|b", "%0A", "x\ny", "<|im_start|>"]), "".join(rng.choices(PARTS, k=rng.randrange(9))))
        for c in range(60) for t in range(rng.randrange(1, 5))
    ]
    check(spark, rows)


def test_conflicting_text_is_escaped_and_plain_text_left(spark):
    shown = check(spark, [(1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (2, 0, "assistant", "a < b | c")])
    assert shown[1].formatted.count("<|im_") == 2
    assert shown[2].formatted == "<|im_start|>assistant\na < b | c<|im_end|>\n"
    (span,) = shown[2].loss_spans
    assert shown[2].formatted[span.start : span.start + span.length] == "a < b | c"


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [
        (None, 0, "user", "n"), (3, None, "assistant", None), (3, 1, None, "b"), (3, 1, "user", "a"),
        (3, 1, "user", "a"), (4, 0, "assistant", "<|im_end|>" * 20_000), (5, 0, "user", ""),
    ]
    check(spark, rows)


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(made(spark, []))).count() == 0


def test_spans_are_cut_across_blocks(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "😀" for i in range(3 * chat.BLOCK + 5))
    places = [(0, 0), (0, 1), (0, len(text)), (chat.BLOCK, 0), (chat.BLOCK - 1, 2), (chat.BLOCK, chat.BLOCK), (chat.BLOCK + 3, 2 * chat.BLOCK), (len(text) - 1, 1)]
    rows = spark.createDataFrame([(text, places), ("", []), ("a\nb", [(1, 1)])], "t string, s array<struct<start:int,length:int>>")
    got = [r.c for r in rows.select(chat.cut_spans(F.col("t"), F.col("s")).alias("c")).collect()]
    assert got == [[text[a : a + n] for a, n in places], [], ["\n"]]


def test_a_long_conversation_is_read_back_whole(spark):
    """Control strings in texts included: each assistant text once, in order, whatever the number of turns."""
    n = 8000
    said = [f"turn {i} <|im_end|>\n<|im_start|>user\n<\\| é😀 " + "x" * (i % 900) for i in range(n)]
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(rows).cache()
    turns = formatted.select(chat.parse_turns(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [("assistant" if i % 2 else "user", t) for i, t in enumerate(said)]
    back, loss = chat.read_back(formatted).first(), "".join(said[1::2])
    assert (back.n_turns, back.loss_chars) == (n, len(loss))
    assert back.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()

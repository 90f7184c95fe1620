import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerwatch.functions import text
from ledgerwatch.operators import retrieval
from ledgerwatch.operators.trace import trace_pair
from ledgerwatch.registry import search_queries
from ledgerwatch.sources import corpus, trace


def chunks(spark, *docs, **options):
    df = spark.createDataFrame([(i, d, f"s{i}") for i, d in enumerate(docs)], "doc_id long, text string, source string")
    return [(r["source"], r["paragraph"], r["chunk"]) for r in text.chunk_documents(df, **options).collect()]


def test_chunks(spark):
    fifty, short = "x" * 50, "y" * 49
    assert chunks(spark, f"{fifty}\r\n\r\n{short}\n\n  {fifty}　\n\n\n\n") == [("s0", 0, fifty), ("s0", 2, fifty)]
    assert chunks(spark, "", short) == []
    assert chunks(spark, f"{short} \n\n\t{short}") == []
    assert chunks(spark, f"a|{fifty}", separator="|") == [("s0", 1, fifty)]


@pytest.mark.parametrize(
    ("value", "shown"),
    [
        ("short", "short"),
        ("x" * 500, "x" * 500),
        ("x" * 501, "x" * 500 + " …"),
        ("word " * 120, "word " * 99 + "word …"),
        ("a" * 499 + " b", "a" * 499 + " …"),
        ("a" * 250 + " " + "b\n" * 200, "a" * 250 + " …"),
        (" " * 600, " " * 499 + " …"),
    ],
)
def test_passage(spark, value, shown):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.passage(F.col("v"))).first()[0] == shown


def test_snippet(spark):
    df = spark.createDataFrame([("a" * 200,), ("a" * 201,)], "v string")
    assert [r[0] for r in df.select(text.snippet(F.col("v"))).collect()] == ["a" * 200, "a" * 200 + "…"]


def test_corpus_to_retrieval(spark, tmp_path):
    folder = tmp_path / "docs" / "deep"
    folder.mkdir(parents=True)
    (folder / "report.v2.txt").write_text(
        "Suspicious transfers must be reported within thirty days of detection.\n\n"
        "Accounts drained to zero balance require an escalation to the fraud team at once.\n\ntoo short",
        encoding="utf-8",
    )
    (tmp_path / "docs" / "skip.md").write_text("not a text file " * 10)
    docs = corpus.load_corpus(spark, str(tmp_path / "docs"))
    assert [r["source"] for r in docs.collect()] == ["report.v2"]
    table = retrieval.chunk_table(docs.withColumn("doc_id", F.lit(0)), "doc_id")
    encoder = retrieval.fit_encoder(table)
    corpus.save_vectors(retrieval.embed(table, encoder), str(tmp_path / "vectors"))
    vectors = corpus.load_vectors(spark, str(tmp_path / "vectors"))
    assert vectors.count() == 2
    asked = spark.createDataFrame([(7, "drained accounts escalation")], "id long, text string")
    queries = retrieval.embed(asked, encoder).select("id", F.col("embedding").alias("vector"))
    one = retrieval.retrieve(queries, vectors, top_k=1).first()
    assert one["query_id"] == 7 and one["passages"].startswith("Accounts drained")
    both = retrieval.retrieve(queries, vectors).first()["passages"]
    assert both.split(text.PASSAGE_SEPARATOR)[1].startswith("Suspicious")
    many = retrieval.retrieve(queries, vectors, few_queries=0, cells=2).first()["passages"]
    assert many == both


def test_empty_corpus(spark):
    queries = spark.createDataFrame([(1, [0.0, 1.0])], "id long, vector array<float>")
    empty = spark.createDataFrame([], "chunk_id long, doc_id long, paragraph int, source string, text string, embedding array<float>")
    assert retrieval.retrieve(queries, empty).first()["passages"] == retrieval.NO_DOCUMENTS


def test_embedding_is_unit_length(spark):
    table = spark.createDataFrame([("a b c",), ("b d",), ("...",)], "text string")
    rows = retrieval.embed(table, retrieval.fit_encoder(table)).collect()
    for r in rows:
        length = sum(x * x for x in r["embedding"])
        assert len(r["embedding"]) == 384
        assert length == pytest.approx(0.0 if r["text"] == "..." else 1.0, abs=1e-5)


def test_trace_lines(spark):
    good = {"type": "tool_call", "name": "x", "input": {"a": {"b": [1, "two"]}}}
    lines = ["", "data: ", "data: {broken", "event: x", f"data: {json.dumps(good)}", "data:" + json.dumps(good),
             "data: {\"type\": \"report\", \"content\": \"two\\nlines\"}  ", "data:    ", "data: not json", "data: [1]", "data: null", "data: 42"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [tuple(r) for r in trace.parse_trace(df).collect()]
    assert got == [("tool_call", "x", '{"a":{"b":[1,"two"]}}', None), ("report", None, None, "two\nlines")]


def test_trace_round_trip(spark, tmp_path):
    rows = [("tool_call", "a", "in", None), ("tool_call", "a", '{"t":{"q":"x \\"y\\" }"}}', None), ("tool_call", "b", "{no object}", None), ("tool_result", "a", None, "quote \" and\nline"), ("report", None, None, "é")]
    events = spark.createDataFrame(rows, trace.EVENT_FIELDS)
    trace.write_trace(events, str(tmp_path / "t"))
    again = trace.parse_trace(trace.read_trace_lines(spark, str(tmp_path / "t")))
    assert sorted(map(str, again.collect())) == sorted(map(str, events.collect()))


def test_last_result_serves_every_call(spark):
    rows = [(1, 0, "tool_call", "a", None), (1, 1, "tool_result", "a", "first"), (1, 2, "tool_call", "a", None),
            (1, 3, "tool_result", "a", "last"), (1, 4, "tool_call", "b", None), (2, 0, "tool_call", "a", None)]
    events = spark.createDataFrame(rows, "investigation_id long, seq int, type string, name string, content string")
    got = {(r["investigation_id"], r["seq"]): (r["result"], r["done"]) for r in trace_pair(events).collect()}
    assert got == {(1, 0): ("last", True), (1, 2): ("last", True), (1, 4): (None, False), (2, 0): (None, False)}


def test_any_key_and_any_number_of_paragraphs(spark):
    docs = spark.createDataFrame([(1 << 62, ("x" * 60 + "\n\n") * 3, "s"), (-5, "y" * 60, "t")], "doc_id long, text string, source string")
    table = retrieval.written_chunks(docs, "doc_id")
    assert {(r["doc_id"], r["paragraph"]) for r in table.collect()} == {(1 << 62, 0), (1 << 62, 1), (1 << 62, 2), (-5, 0)}
    assert table.select("chunk_id").distinct().count() == 4


def test_any_function_can_encode(spark):
    table = spark.createDataFrame([("abc",), ("",)], "text string")
    rows = retrieval.embed(table, lambda t: F.array(F.length(t), F.lit(1))).collect()
    assert [r["embedding"] for r in rows] == [[3.0, 1.0], [0.0, 1.0]]


@pytest.mark.parametrize(
    "raw",
    [
        '{"type": "a"}', '{"type": "a"} x', '{"type": "a"}{"b": 1}', "{'type': 'a'}", '{"type": NaN}', '{type: "a"}',
        '{"type": "a",}', '{"type": "a"', '{}', '{"type": "\\u00e9"}', '{"type": "a"},{"type": "b"}', '{"type": "a"}]',
        '\t{"type": "a"}\r', '{"type": "a" /* c */}', '{"name": "a b", "content": "x } y"}', '{"type": null}',
    ],
)
def test_only_whole_objects_are_events(spark, raw):
    """The lines a JSON parser accepts as one object, no others."""

    def refuse(name):
        raise ValueError(name)

    try:
        want = json.loads(raw.strip(), parse_constant=refuse)
    except ValueError:
        want = None
    got = trace.parse_trace(spark.createDataFrame([("data: " + raw,)], "value string")).collect()
    assert [r.asDict() for r in got] == (
        [] if want is None else [{k: want.get(k) for k in ("type", "name", "input", "content")}]
    )


def random_texts(n):
    import random

    rnd = random.Random(11)
    pieces = ["a", "word ", "\n\n", "\r\n", "\n", " ", "\xa0", "\u3000", "\t", "é", "x" * 30, "long word here ", "\r\n\r\n", "😀"]
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 90))) for _ in range(n)]


def test_random_texts_are_cut_at_spaces(spark):
    texts = random_texts(400)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    shown = [r[0] for r in df.orderBy("doc_id").select(text.passage(F.col("text"), 60)).collect()]
    for whole, cut in zip(texts, shown, strict=True):
        if len(whole) <= 60:
            assert cut == whole
            continue
        assert cut.endswith(" …")
        kept = cut.removesuffix(" …")
        assert whole.startswith(kept) and len(kept) <= 60
        if len(kept) < 60:  # it ends before a space, and no later word would have fitted
            assert whole[len(kept)] == " " and " " not in whole[len(kept) + 1 : 60]
        else:
            assert " " not in kept


def test_random_texts_keep_their_long_paragraphs_in_order(spark):
    texts = random_texts(400)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {}
    for r in sorted(text.chunk_documents(df).collect(), key=lambda r: (r["doc_id"], r["paragraph"])):
        found.setdefault(r["doc_id"], []).append(r["chunk"])
    assert sum(map(len, found.values())) > 100
    for i, whole in enumerate(texts):
        rest = whole.replace("\r\n", "\n")
        for chunk in found.get(i, []):
            assert len(chunk) >= 50 and "\n\n" not in chunk and chunk == chunk.strip()
            skipped, _, rest = rest.partition(chunk)
            # what was skipped holds no paragraph that is long enough
            assert max((len(p.strip()) for p in re.split("\n\n", skipped)), default=0) < 50
        assert max((len(p.strip()) for p in re.split("\n\n", rest)), default=0) < 50


def test_letter_counts_are_worked_out_once_a_chunk(spark):
    rows = spark.createDataFrame([("eat teas",), ("",), (None,)], "text string")
    found = rows.select(search_queries._unit_letters(F.col("text")).alias("v"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") == len(search_queries._LETTERS)
    first, empty, _ = (r["v"] for r in found.collect())
    size = (64 + 4 + 4 + 4 + 1) ** 0.5
    assert first == pytest.approx([x / size for x in (8, 2, 2, 2, 0, 0, 1, 0)])
    assert empty == [0.0] * 8


def test_many_small_files_are_few_tasks(spark, tmp_path):
    setting = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(setting)
    texts = spark.range(400).select(F.concat(F.lit("t"), "id").alias("name"), F.concat(F.lit("﻿ä\r\n"), "id").alias("text"))
    assert corpus.write_texts(texts, str(tmp_path / "texts"), F.col("name")) == 400
    assert len(list((tmp_path / "texts").iterdir())) > 32  # folders enough that tasks list them
    with corpus.many_files_a_task(spark):
        found = corpus.load_corpus(spark, str(tmp_path / "texts"))
        assert found.rdd.getNumPartitions() <= 8
        assert {(r["source"], r["text"]) for r in found.collect()} == {(f"t{i}", f"﻿ä\r\n{i}") for i in range(400)}
    assert spark.conf.get(setting) == before
    assert corpus.write_texts(texts.limit(0), str(tmp_path / "none"), F.col("name")) == 0
    assert corpus.load_corpus(spark, str(tmp_path / "none")).count() == 0


def test_tasks_list_and_read_a_corpus(spark, tmp_path):
    """The driver holds no entry of a file; rows are those that Spark's own reader gives."""
    named = ["a.txt", "_a.txt", ".b.txt", "_c=1.txt", "deep/er/a b%20#+.txt", "_hid/x.txt", "_metadata/y.txt", "_x=1/z.txt", ".d/u.txt",
             "UP.TXT", "v.txt._COPYING_", "w._COPYING_/w.txt", "dir.txt/no.md", "dir.txt/in.v2.txt", "same/a.txt", "bytes.txt", "plain"]
    for i, name in enumerate(named):
        (tmp_path / "c d%" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c d%" / name).write_bytes(f"text {i}\r\n".encode())
    (tmp_path / "c d%" / "bytes.txt").write_bytes(b"\xff\x00\xfe")
    (tmp_path / "c d%" / "empty.txt").write_bytes(b"")
    (tmp_path / "c d%" / "nothing").mkdir()

    def rows(df):
        return sorted((r["source"], bytes(r["text"])) for r in df.withColumn("text", F.col("text").cast("binary")).collect())

    for path in (str(tmp_path / "c d%"), f"{tmp_path}/c d%/deep", f"{tmp_path}/c d%/nothing"):
        found, plain = corpus.load_corpus(spark, path), corpus.load_corpus(spark, path, by_tasks=False)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "binaryFile" not in plan
        assert found.dtypes == plain.dtypes and rows(found) == rows(plain)
    assert [s for s, _ in rows(corpus.load_corpus(spark, str(tmp_path / "c d%")))].count("a") == 2
    every = "".join(map(chr, [*range(1, 47), *range(48, 0x180), 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000, 0x4E2D]))
    assert corpus._as_uri(every) == spark._jvm.org.apache.hadoop.fs.Path(f"/x/{every}").toUri().toString()[3:]
    for path in (f"{tmp_path}/c*/same", f"{tmp_path}/c d%/a.txt"):  # a pattern, a single file
        assert [s for s, _ in rows(corpus.load_corpus(spark, path))] == ["a"]


def test_files_are_read_in_bounded_tasks_and_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_FILES", 10)
    monkeypatch.setattr(corpus, "_HELD_BYTES", 20)
    texts = spark.range(100).select(F.concat(F.lit("t"), "id").alias("name"), F.repeat(F.lit("xy"), F.col("id").cast("int") + 1).alias("text"))
    corpus.write_texts(texts, str(tmp_path / "texts"), F.col("name"))
    found = corpus.load_corpus(spark, str(tmp_path / "texts"))
    assert found.rdd.getNumPartitions() == 10
    assert {(r["source"], r["text"]) for r in found.collect()} == {(f"t{i}", "xy" * (i + 1)) for i in range(100)}

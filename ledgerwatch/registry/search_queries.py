"""Queries over texts and vectors, and over traces of investigations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwatch.functions import text as text_functions
from ledgerwatch.operators import retrieval
from ledgerwatch.operators.neighbors import knn
from ledgerwatch.operators.trace import trace_pair
from ledgerwatch.registry import ORACLES, query
from ledgerwatch.registry.tables import table
from ledgerwatch.sources import corpus, trace
from ledgerwatch.sources.event_log import EPOCH_SECONDS
from ledgerwatch.streaming import traces
from ledgerwatch.workspace import new_dir, written


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in text_functions.WHITESPACE) + ")"

_CHUNKS = f"""pieces as (
  select doc_id, source, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as piece,
    generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 as paragraph
  from documents),
chunks as (
  select doc_id, source, paragraph, trim(piece, {_SPACES}) as chunk from pieces
  where length(trim(piece, {_SPACES})) >= 50)"""


@query(
    "chunk_documents",
    f"with {_CHUNKS} select doc_id, source, cast(paragraph as integer) as paragraph, chunk from chunks",
)
def chunk_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    return text_functions.chunk_documents(docs, separator="\n")


@query(
    "load_corpus",
    """select 'doc-' || doc_id as source, cast(length(text) as bigint) as chars, sha256(text) as digest,
    count(*) over () as files from documents where text <> '' and doc_id is not null""",
)
def load_corpus(spark, sf_dir):
    """Each document as a file of its own: name without its ending, length and content of every one."""
    path = new_dir(spark, "corpus")
    corpus.write_texts(_documents(spark, sf_dir).where("text <> '' and doc_id is not null"), path, F.concat(F.lit("doc-"), "doc_id"))
    with corpus.many_files_a_task(spark):  # read once, for both the rows and their number
        found = written(
            corpus.load_corpus(spark, path).select(
                "source", F.length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")
            ),
            "corpus_files",
        )
    return found.withColumn("files", F.lit(found.select("source").distinct().count()).cast("long"))


# An encoder that SQL can state as well: length and how often some letters occur.
_LETTERS = "eatnrsi"


def _letter_counts(text):
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _LETTERS]
    return F.array(*[c.cast("float") for c in (F.length(text), *counts)])


_LETTERS_SQL = "[" + ", ".join(["length({0})"] + [f"length({{0}}) - length(replace({{0}}, '{c}', ''))" for c in _LETTERS]) + "]::double[]"


_KNN = """near as (
  select q.vec_id as query_id, b.vec_id as id, list_distance(q.embedding::double[], b.embedding::double[]) ** 2 as distance,
    row_number() over (partition by q.vec_id
      order by list_distance(q.embedding::double[], b.embedding::double[]), b.vec_id) as "rank"
  from embeddings q, embeddings b)"""


@query(
    "knn_l2",
    f"""with {_KNN} select query_id, cast("rank" as integer) as "rank", id, round(distance, 6) + 0.0 as distance from near
    where "rank" <= 3""",
)
def knn_l2(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return knn(vectors, vectors, 3).withColumn("distance", F.round("distance", 6) + 0.0)


@query(
    "knn_topk",
    f"""with {_KNN} select query_id, max(round(distance, 6) + 0.0) as reach, count(*) as found from near
    where "rank" <= 10 group by 1""",
)
def knn_topk(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    near = knn(vectors, vectors, 10)
    return near.groupBy("query_id").agg(
        F.max(F.round("distance", 6) + 0.0).alias("reach"), F.count(F.lit(1)).alias("found")
    )


_DIMENSIONS = 64  # of the embeddings
_NEAR_SQL = """select query_id, cast("rank" as integer) as "rank", id, round(distance, 6) + 0.0 as distance from near where "rank" <= 3"""


@query("knn_cells", f"with {_KNN} {_NEAR_SQL}")
def knn_cells(spark, sf_dir):
    """The plan of cells and bins, made for few dimensions, on the whole vectors."""
    vectors = _vectors(spark, sf_dir)
    near = knn(vectors, vectors, 3, few_queries=0, cells=32, bin_dimensions=_DIMENSIONS)
    return near.withColumn("distance", F.round("distance", 6) + 0.0)


@query("knn_blocks", f"with {_KNN} {_NEAR_SQL}")
def knn_blocks(spark, sf_dir):
    """The plan for many queries of many dimensions: tasks read blocks of vectors from the shared folder."""
    vectors = _vectors(spark, sf_dir)
    return knn(vectors, vectors, 3, few_queries=0, grid_block=128).withColumn("distance", F.round("distance", 6) + 0.0)


@query("knn_grid", f"with {_KNN} {_NEAR_SQL}")
def knn_grid(spark, sf_dir):
    """The same where tasks cannot open the shared folder: blocks meet blocks."""
    vectors = _vectors(spark, sf_dir)
    near = knn(vectors, vectors, 3, few_queries=0, grid_block=256, read_shared=False)
    return near.withColumn("distance", F.round("distance", 6) + 0.0)


_PASSAGE = """case when length(text) > 500 then regexp_replace(substring(text, 1, 500), ' [^ ]*\\z', '') || ' …' else text end"""


@query(
    "chunk_lookup",
    f"""with {_KNN} select query_id, cast("rank" as integer) as "rank", id, {_PASSAGE} as passage
    from near left join documents on id = doc_id where "rank" <= 3""",
)
def chunk_lookup(spark, sf_dir):
    """Vectors without a document of their number keep their row."""
    vectors = _vectors(spark, sf_dir)
    hits = knn(vectors, vectors, 3).select("query_id", "rank", "id")
    passages = _documents(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"), text_functions.passage(F.col("text")).alias("passage")
    )
    return retrieval.chunk_lookup(hits, passages)


@query(
    "retrieve",
    f"""with {_CHUNKS},
    near as (
      select q.item_id as query_id, chunk as text, row_number() over (partition by q.item_id
        order by list_distance({_LETTERS_SQL.format("q.text")}, {_LETTERS_SQL.format("c.chunk")}), c.doc_id, c.paragraph) as "rank"
      from benchmark q, chunks c)
    select query_id, string_agg({_PASSAGE}, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by "rank") as passages
    from near where "rank" <= 2 group by 1""",
)
def retrieve(spark, sf_dir):
    """Benchmark items as questions to all paragraphs of all documents."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    chunks = retrieval.written_chunks(docs, "doc_id", separator="\n")
    in_order = chunks.drop("chunk_id").orderBy("doc_id", "paragraph")  # as SQL breaks ties
    placed = written(in_order.withColumn("chunk_id", F.monotonically_increasing_id()), "placed_chunks")
    vectors = retrieval.embed(placed, _letter_counts)
    queries = retrieval.embed(asked, _letter_counts).select("id", F.col("embedding").alias("vector"))
    return retrieval.retrieve(queries, vectors)


def _corpus_table(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    return retrieval.build_vectors(docs, "doc_id", separator="\n")


@query("embed_chunks")
def embed_chunks(spark, sf_dir):
    chunks = written(chunk_documents(spark, sf_dir).withColumnRenamed("chunk", "text"), "chunks")
    return retrieval.embed(chunks, retrieval.fit_encoder(chunks)).select("doc_id", "paragraph", "embedding")


def _once(value, use):
    """``use`` of a value that is worked out once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _unit_letters(text):
    def unit(counts):
        size = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        return _once(size, lambda s: F.transform(counts, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0))))

    return _once(text, lambda t: _once(_letter_counts(t), unit))


@query(
    "embed_letters",
    f"""with {_CHUNKS}, counted as (select *, {_LETTERS_SQL.format("chunk")} as v from chunks),
    sized as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as size from counted)
    select doc_id, cast(paragraph as integer) as paragraph, unnest(range(0, len(v)))::integer as at,
      round(unnest(list_transform(v, lambda x: cast(cast(case when size > 0 then x / size else 0 end as float) as double))), 6) as value from sized""",
)
def embed_letters(spark, sf_dir):
    """Unit vectors of an encoder that is a function of the text, value by value."""
    chunks = chunk_documents(spark, sf_dir).withColumnRenamed("chunk", "text")
    listed = F.posexplode("embedding").alias("at", "value")
    found = retrieval.embed(chunks, _unit_letters).select("doc_id", "paragraph", listed)
    return found.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(
    "embed_sizes",
    f"""with {_CHUNKS} select doc_id, cast(paragraph as integer) as paragraph, 384 as dimensions,
    case when regexp_matches(chunk, '[\\p{{L}}\\p{{N}}]') then 1.0 else 0.0 end as size from chunks""",
)
def embed_sizes(spark, sf_dir):
    """Every vector has 384 dimensions and length 1, or 0 for a chunk without words."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return embed_chunks(spark, sf_dir).select(
        "doc_id", "paragraph", F.size("embedding").alias("dimensions"), F.round(F.sqrt(square), 3).alias("size")
    )


@query(
    "build_vectors",
    f"""with {_CHUNKS} select doc_id, cast(paragraph as integer) as paragraph, source, chunk as text,
    384 as dimensions from chunks""",
)
def build_vectors(spark, sf_dir):
    vectors = _corpus_table(spark, sf_dir)
    return vectors.select("doc_id", "paragraph", "source", "text", F.size("embedding").alias("dimensions"))


@query(
    "vectors_save_load",
    f"""with {_CHUNKS} select source, count(*) as chunks, cast(sum(length(chunk)) as bigint) as chars from chunks group by 1""",
)
def vectors_save_load(spark, sf_dir):
    path = new_dir(spark, "vectors")
    corpus.save_vectors(_corpus_table(spark, sf_dir), path)
    loaded = corpus.load_vectors(spark, path)
    return loaded.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


# Traces. The conversations serve as investigations: what the user says is a call,
# the answer its result.

_EVENTS_SQL = """e as (
  select conv_id as investigation_id, turn as seq,
    case role when 'user' then 'tool_call' when 'assistant' then 'tool_result' else 'report' end as type,
    case turn // 2 % 4 when 0 then 'tool_run_fraud_model' when 1 then 'tool_explain_prediction'
      when 2 then 'tool_retrieve_regulations' else 'tool_search' end as name,
    text as content from conversations)"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("investigation_id"),
        F.col("turn").alias("seq"),
        F.expr("case role when 'user' then 'tool_call' when 'assistant' then 'tool_result' else 'report' end").alias("type"),
        F.expr(
            "case turn div 2 % 4 when 0 then 'tool_run_fraud_model' when 1 then 'tool_explain_prediction'"
            " when 2 then 'tool_retrieve_regulations' else 'tool_search' end"
        ).alias("name"),
        F.col("text").alias("content"),
    )


@query(
    "trace_pair",
    f"""with {_EVENTS_SQL},
    r as (select investigation_id, name, arg_max(content, seq) as result from e where type = 'tool_result' group by 1, 2)
    select investigation_id, seq, name, case name when 'tool_run_fraud_model' then 'Run Fraud Model'
      when 'tool_explain_prediction' then 'Explain Prediction' when 'tool_retrieve_regulations' then 'Retrieve Regulations'
      else name end as label, result, result is not null as done,
      case when length(result) > 200 then substring(result, 1, 200) || '…' else result end as snippet
    from e left join r using (investigation_id, name) where type = 'tool_call'""",
)
def trace_pair_query(spark, sf_dir):
    return trace_pair(_events(spark, sf_dir))


@query("trace_pair_stream", ORACLES["trace_pair"])
def trace_pair_stream(spark, sf_dir):
    """The events arrive in three parts, calls ahead of their results; lines are written, read and paired as streams."""
    source, lines, out = (new_dir(spark, name) for name in ("events", "trace", "pairs"))
    ts = F.timestamp_seconds(EPOCH_SECONDS + F.col("investigation_id") * 60 + F.col("seq"))  # a watermark begins at 1970
    events = written(_events(spark, sf_dir).select(F.col("investigation_id").cast("bigint").alias("investigation_id"), F.col("seq").cast("bigint").alias("seq"), ts.alias("ts"), "type", "name", "content"), "events")
    edges = events.agg(F.max("investigation_id")).first()[0]
    part = F.floor(F.col("investigation_id") * 3 / (edges + 1)) + F.when((F.col("type") == "tool_result") & (F.col("seq") % 4 == 1), 1).otherwise(0)
    last = traces.end_marker(spark)
    for i in range(4):
        rows = events.where(part == i)
        (rows.unionByName(last) if i == 3 else rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        traces.start_trace(stream, lines, "investigation_id", "seq", "ts", "type", "name", "content").awaitTermination()
        arriving = traces.stream_trace(spark, f"{lines}/table")
        # a whole part's investigations lie between a call and its result
        traces.start_pairs(arriving, out, wait="400 days", watermark="400 days").awaitTermination()
    found = traces.answered(spark.read.schema(traces.PAIRS).parquet(f"{out}/table"))
    kinds = dict(events.dtypes) | dict(_events(spark, sf_dir).dtypes)
    return found.withColumns({c: F.col(c).cast(kinds[c]) for c in ("investigation_id", "seq")})


@query(
    "trace_write",
    """select 'data: {"type":"tool_call","name":"' || event_type || '","input":' || case when event_id % 2 = 0
      then '{"transaction":{"id":' || event_id || ',"kind":"' || event_type || '"}}' else '"' || event_id || '"' end || '}' as value
    from events""",
)
def trace_write(spark, sf_dir):
    """The arguments of a call stand in the line as an object, other texts as a string."""
    path = new_dir(spark, "trace")
    asked = F.to_json(F.struct(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")).alias("transaction")))
    rows = table(spark, sf_dir, "events").select(
        F.lit("tool_call").alias("type"),
        F.col("event_type").alias("name"),
        F.when(F.col("event_id") % 2 == 0, asked).otherwise(F.col("event_id").cast("string")).alias("input"),
    )
    trace.write_trace(rows, path)
    return trace.read_trace_lines(spark, path)


@query(
    "trace_parse",
    f"""with {_EVENTS_SQL} select type, name, content,
      '{{"transaction":{{"id":' || investigation_id || ',"turn":' || seq || '}}}}' as input from e""",
)
def trace_parse(spark, sf_dir):
    path = new_dir(spark, "trace")
    noise = table(spark, sf_dir, "events").select(
        F.expr(
            "case event_type when 'view' then '' when 'signup' then 'data: ' when 'error' then concat('data: {\"type\": ', props)"
            " when 'click' then concat('event: ', props) else concat('data: not json ', event_id) end"
        ).alias("value")
    )
    asked = F.to_json(F.struct(F.struct(F.col("investigation_id").alias("id"), F.col("seq").alias("turn")).alias("transaction")))
    lines = _events(spark, sf_dir).withColumn("input", asked).select(trace.trace_line("type", "name", "content", "input").alias("value"))
    lines.unionByName(noise).write.text(path)
    return trace.parse_trace(trace.read_trace_lines(spark, path)).select("type", "name", "content", "input")

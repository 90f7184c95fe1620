"""The pipeline: each stage against a plain reading of its decision, on the given documents."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerwatch.llm import langid, probminhash, queries, toxicity
from ledgerwatch.llm.common import LEAN, table

SF = "/root/testdata/sf0.01"
CLASHING = ["score", "class", "found", "size", "rank", "ids", "toxic", "mark"]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def odd(docs):
    """Documents with null rows, repeated rows and columns of clashing names."""
    nothing = docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    df = docs.unionByName(docs.where("doc_id < 9")).unionByName(nothing)
    return df.withColumns({c: F.lit(1) for c in CLASHING})


def keys(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_names_and_schema(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mix", "pieces"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()


def test_language(spark, docs):
    model = langid.fit(docs)
    want = {r.doc_id: model.judge(r.text) for r in docs.collect()}
    out = corpus_pipeline.identify_language(spark, docs, SF).collect()
    assert {r.doc_id: r.lang for r in out} == {i: w[0] for i, w in want.items() if not w[2]}
    assert len(out) >= 0.99 * docs.count()


def test_toxicity(spark, docs):
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    rows = docs.select("doc_id", "text").collect()
    scores = model.probability(model.raw_scores([r.text for r in rows]))
    out = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert keys(out) == sorted((r.doc_id, r.text) for r, s in zip(rows, scores, strict=True) if s < 0.7)


def test_near_duplicates(spark, docs):
    named = probminhash.near_duplicates(docs).where("kept")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in named.collect())


def test_mix(spark, docs):
    out = corpus_pipeline.mix(spark, docs, SF)
    taken = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in queries.QUERIES["op2_source_mix"](spark, SF).collect():
        assert r.taken == taken.get(r.doc_id, 0) * r["size"]


def test_odd_documents_go_through_all_stages(spark, docs):
    df = odd(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
        assert set(CLASHING) <= set(df.columns)
    assert corpus_pipeline.encode_pieces(spark, df, SF).where(~F.col("same")).count() == 0


def test_empty_documents_go_through_all_stages(spark, docs):
    df = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        assert df.count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 300 and out.where(~F.col("same")).count() == 0


def test_registered():
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_every_stage_has_lean_workers(spark, docs, monkeypatch):
    """Also where the stages are called by themselves, without ``run``."""
    environment = dict(spark.sparkContext.environment)
    for _, stage in corpus_pipeline.STAGES:
        monkeypatch.setattr(spark.sparkContext, "environment", {k: v for k, v in environment.items() if k not in LEAN})
        stage(spark, docs.limit(0), SF)
        assert LEAN.items() <= spark.sparkContext.environment.items()

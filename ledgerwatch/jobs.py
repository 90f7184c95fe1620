"""The jobs as commands over paths.

    python -m ledgerwatch features --log log/ --out features/
    python -m ledgerwatch train --features features/ --out models/

A log is CSV (``--format csv``, the default) or Parquet. CSV rows get a generated key,
written out first so that it stays the same; a Parquet log names its key with ``--key``.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.functions import columns as C
from ledgerwatch.operators import attribution, curves, model as M, profiling, reports, retrieval, sampling
from ledgerwatch.operators.features import add_request_features, feature_table
from ledgerwatch.operators.validation import default_velocity, split_valid
from ledgerwatch.plans import investigation, training
from ledgerwatch.session import open_session
from ledgerwatch.sources import corpus as corpus_files
from ledgerwatch.sources import transactions as log_files
from ledgerwatch.sources.trace import write_trace
from ledgerwatch.sources.transactions import event_time
from ledgerwatch.sources.event_log import EPOCH_SECONDS
from ledgerwatch.streaming import scoring, velocity
from ledgerwatch.workspace import job_folder, written

KEY = "row_id"


def read_log(spark: SparkSession, args) -> DataFrame:
    if args.format == "csv":
        rows = log_files.scan_csv(spark, args.log).withColumn(KEY, F.monotonically_increasing_id())
        return written(rows, "log")
    return log_files.scan_parquet(spark, args.log).withColumnRenamed(args.key, KEY)


def ingest(spark: SparkSession, args) -> None:
    """Chunk profile and totals of a log."""
    log = log_files.require_columns(read_log(spark, args))
    chunks = written(profiling.chunk_profile(log, KEY, args.chunk_rows), "chunks")
    _save(chunks, args.out, "chunks")
    _save(profiling.ingest_totals(chunks), args.out, "totals")
    _save(log_files.column_types(log), args.out, "columns")
    _save(log_files.head(log, KEY, 5), args.out, "preview")


def profile(spark: SparkSession, args) -> None:
    """Class shares, fraud by type, anomalies, amounts; ``--sample`` thins legitimate rows for the amounts."""
    log = read_log(spark, args)
    sample = sampling.fraud_and_sample(log, KEY, S.LABEL, args.sample)
    for name, table in {
        "class_distribution": profiling.class_distribution(log),
        "fraud_by_type": profiling.fraud_by_type(log),
        "anomaly_precision": profiling.anomaly_precision(log),
        "amount_stats": profiling.amount_stats(sample),
        "amount_histogram": profiling.amount_histogram(sample),
    }.items():
        _save(table, args.out, name)


def features(spark: SparkSession, args) -> None:
    """The feature table of a log, and its check."""
    log_files.write_features(feature_table(read_log(spark, args), KEY), f"{args.out}/features", keep=[KEY])
    _save(log_files.features_sanity(spark.read.parquet(f"{args.out}/features").drop(KEY)), args.out, "sanity")


def train(spark: SparkSession, args) -> None:
    """Both models, their thresholds, the run log, and per run the confusion matrix and reports on the test rows."""
    runs = training.train_all(spark.read.parquet(args.features), KEY, args.out, args.trees, args.depth)
    for done in runs.values():
        for name, threshold in (("best", done.model.threshold), ("half", 0.5)):
            matrix = written(curves.confusion_matrix(done.scored_test, threshold, label=S.LABEL), "matrix")
            place = f"evaluation/model_{len(done.model.features)}/{name}"
            _save(matrix, args.out, f"{place}/confusion_matrix")
            _save(curves.classification_report(matrix), args.out, f"{place}/report")


def explain(spark: SparkSession, args) -> None:
    """Global importance over all rows (or a share of them by hash), and the drivers of sampled fraud cases."""
    model = M.load_model(spark, args.model)
    table = spark.read.parquet(args.features)
    rows = table if args.sample >= 1 else sampling.hash_sample(table, KEY, args.sample)
    _save(
        attribution.global_importance(attribution.explain_rows(rows, model, KEY), model.features), args.out, "importance"
    )
    cases = sampling.first_by_hash(
        reports.confident_fraud(M.score(table, model), model.threshold), KEY, args.cases
    )
    explained = attribution.explain_table(cases, model, [KEY, *model.features, "score"])
    _save(reports.top_drivers(explained, [KEY, "score", "amount"], 8, model.features), args.out, "cases")


def score(spark: SparkSession, args) -> None:
    """Score and explain a table of requests; rejected rows go beside them."""
    model = M.load_model(spark, args.model)
    valid, rejected = split_valid(default_velocity(spark.read.parquet(args.requests)))
    scored = M.score(add_request_features(valid), model)
    explained = written(attribution.explain_table(scored, model, [args.key, *model.features, "score"]), "explained")
    _save(reports.predict_report(explained, args.key, model.threshold, model.features), args.out, "predictions")
    _save(reports.explain_report(explained, args.key, model.features), args.out, "explanations")
    _save(rejected, args.out, "rejected")


def build_corpus(spark: SparkSession, args) -> None:
    """Text files to a vector table and its encoder."""
    with corpus_files.many_files_a_task(spark):
        docs = written(corpus_files.load_corpus(spark, args.docs).withColumn("doc_id", F.monotonically_increasing_id()), "documents")
    chunks = retrieval.written_chunks(docs, "doc_id")
    encoder = retrieval.fit_encoder(chunks)
    encoder.write().overwrite().save(f"{args.out}/encoder")
    corpus_files.save_vectors(retrieval.embed(chunks, encoder), f"{args.out}/vectors")


def _corpus(spark: SparkSession, path: str) -> investigation.Corpus:
    encoder = retrieval.PipelineModel.load(f"{path}/encoder")
    return investigation.Corpus(corpus_files.load_vectors(spark, f"{path}/vectors"), encoder)


def investigate(spark: SparkSession, args) -> None:
    """Findings and event traces of a table of requests."""
    valid, rejected = split_valid(default_velocity(spark.read.parquet(args.requests)))
    model = M.load_model(spark, args.model)
    found = investigation.investigate(add_request_features(valid), args.key, model, _corpus(spark, args.corpus))
    findings = written(found, "findings")
    _save(findings, args.out, "findings")
    _save(rejected, args.out, "rejected")
    events = investigation.trace_events(findings, args.key).unionByName(investigation.error_events(rejected, args.key))
    write_trace(events, f"{args.out}/trace")


def score_stream(spark: SparkSession, args) -> None:
    """Score requests as files arrive; ``--counters`` names the as-of table of ``velocity-stream``."""
    shape = spark.read.parquet(args.requests).schema
    stream = spark.readStream.schema(shape).parquet(args.requests)
    trigger = {"processingTime": args.every} if args.every else {"availableNow": True}
    model = M.load_model(spark, args.model)
    scoring.start_scoring(stream, model, args.out, args.counters or None, **trigger).awaitTermination()


def velocity_stream(spark: SparkSession, args) -> None:
    """Final counts per account and bucket, and counters per closed hour, as log files arrive.

    The log is read and counted once, by the hour; the rest goes on from the closed hours.
    """
    log = velocity.relevant_stream(log_files.stream_csv(spark, args.log), args.epoch)
    trigger = {"processingTime": args.every} if args.every else {"availableNow": True}
    hourly = velocity.start_append(velocity.closed_hours(log, args.epoch), f"{args.out}/counts_1h", **trigger)
    if args.every:
        while hourly.isActive and not hourly.lastProgress:  # its first batch creates the table
            time.sleep(1)
    else:
        hourly.awaitTermination()
    table = f"{args.out}/counts_1h/table"
    last = [velocity.start_asof(spark, table, f"{args.out}/asof", **trigger)]
    for length in (3, 24):
        closed = spark.readStream.schema(velocity.HOURS_SCHEMA).parquet(table)
        buckets = velocity.closed_buckets(closed, length, args.epoch)
        last.append(velocity.start_append(buckets, f"{args.out}/counts_{length}h", **trigger))
    if args.every:
        spark.streams.awaitAnyTermination()
    for query in last:
        query.awaitTermination()
    # the input has ended: what is still open is complete too
    closed = spark.read.schema(velocity.HOURS_SCHEMA).parquet(table)
    rows = log_files.scan_csv(spark, args.log).where(C.is_relevant()).select("nameOrig", "step")
    rest = written(velocity.open_hours(rows, closed), "open_hours")
    _save(rest, args.out, "counts_1h_open")
    for length in (3, 24):
        part = spark.read.schema("nameOrig string, bucket int, n int").parquet(f"{args.out}/counts_{length}h/table")
        _save(velocity.open_buckets(closed.unionByName(rest), part, length), args.out, f"counts_{length}h_open")


def velocity_rows(spark: SparkSession, args) -> None:
    """Each arriving transaction with its counters so far, once its hour closes; late ones are left out and counted.

    The log is Parquet with a unique key: arrivals are accepted first, and all counts start from what was accepted.
    """
    shape = spark.read.parquet(args.log).schema
    log = spark.readStream.schema(shape).parquet(args.log).where(C.is_relevant())
    log = log.select(args.key, "nameOrig", "step", event_time("step", args.epoch).alias("ts"))
    velocity.start_accept(log, f"{args.out}/accepted", args.key).awaitTermination()
    kind = shape[args.key].dataType.simpleString()
    accepted = spark.readStream.schema(f"{args.key} {kind}, nameOrig string, step int, ts timestamp, day int").parquet(f"{args.out}/accepted/table")
    velocity.start_append(velocity.closed_hours(accepted, args.epoch), f"{args.out}/hours").awaitTermination()
    velocity.start_asof(spark, f"{args.out}/hours/table", f"{args.out}/asof", args.idle).awaitTermination()
    velocity.start_asof_rows(
        spark, f"{args.out}/asof/table", f"{args.out}/accepted/table", args.out, args.key, args.epoch
    ).awaitTermination()
    seen = spark.read.parquet(args.log).where(C.is_relevant())
    _save(velocity.late_rows(seen, spark.read.parquet(f"{args.out}/accepted/table"), args.key).where("late").drop("late"), args.out, "late")


JOBS: dict[str, tuple[Callable, dict[str, object]]] = {
    "ingest": (ingest, {"log": None, "format": "csv", "key": KEY, "chunk_rows": S.CHUNK_ROWS}),
    "profile": (profile, {"log": None, "format": "csv", "key": KEY, "sample": 1.0}),
    "features": (features, {"log": None, "format": "csv", "key": KEY}),
    "train": (train, {"features": None, "trees": M.TRAIN_PARAMS["n_estimators"], "depth": M.TRAIN_PARAMS["max_depth"]}),
    "explain": (explain, {"features": None, "model": None, "sample": 1.0, "cases": 10}),
    "score": (score, {"requests": None, "model": None, "key": KEY}),
    "corpus": (build_corpus, {"docs": None}),
    "investigate": (investigate, {"requests": None, "model": None, "corpus": None, "key": KEY}),
    "velocity-stream": (velocity_stream, {"log": None, "epoch": EPOCH_SECONDS, "every": ""}),
    "velocity-rows": (velocity_rows, {"log": None, "key": KEY, "epoch": EPOCH_SECONDS, "idle": velocity.IDLE_HOURS}),
    "score-stream": (score_stream, {"requests": None, "model": None, "counters": "", "every": ""}),
}


def _save(table: DataFrame, out: str, name: str) -> None:
    table.write.mode("overwrite").parquet(f"{out}/{name}")


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerwatch", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="job", required=True)
    for name, (run, options) in JOBS.items():
        command = commands.add_parser(name, help=run.__doc__)
        for option, default in options.items():
            kind = str if default is None else type(default)
            command.add_argument(
                f"--{option.replace('_', '-')}", type=kind, default=default, required=default is None
            )
        command.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    spark = open_session(f"ledgerwatch {args.job}")
    with job_folder(spark, args.job):
        JOBS[args.job][0](spark, args)

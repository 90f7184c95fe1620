"""Investigations of a whole table of transactions, and their event traces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.functions import columns as C
from ledgerwatch.operators import attribution, model as M, reports
from ledgerwatch.operators.retrieval import Encoder, embed, retrieve
from ledgerwatch.workspace import written

@dataclass(frozen=True)
class Corpus:
    """A vector table and the encoder that made it."""

    vectors: DataFrame
    encoder: Encoder


def question(label: Column, kind: Column, risk_flag: Column, drivers: Column) -> Column:
    """What to look up for a finding, from its label, type, velocity flag and the names of its drivers."""
    return F.concat_ws(
        " ",
        F.lower(label),
        F.lit("risk"),
        F.lower(F.replace(kind, F.lit("_"), F.lit(" "))),
        F.when(risk_flag, F.lit("with many transactions in a day")),
        F.when(F.size(drivers) > 0, F.concat(F.lit("because of "), F.lower(F.array_join(drivers, " and ")))),
    )


def answers(corpus: Corpus, questions: DataFrame) -> DataFrame:
    """``query, passages`` for every different ``query``."""
    asked = questions.select("query").distinct()
    asked = written(asked.select(F.monotonically_increasing_id().alias("id"), F.col("query").alias("text")), "questions")
    vectors = embed(asked, corpus.encoder).select("id", F.col("embedding").alias("vector"))
    found = retrieve(vectors, corpus.vectors).withColumnRenamed("query_id", "id")
    return asked.join(found, "id").select(F.col("text").alias("query"), "passages")


def needs_explanation(score: str = "risk_score"):
    return F.col(score) >= F.lit(S.EXPLAIN_THRESHOLD)


def investigate(transactions: DataFrame, key: str, model: M.FraudModel, corpus: Corpus) -> DataFrame:
    """One finding per transaction: score, drivers where the score asks for them, velocity, passages.

    ``transactions`` carries the model features and the fields of a request.
    Scores, attributions and velocity are projections of the same rows; they are written
    once, the different questions are looked up, and the answers joined back.
    """
    carried = [c for c in transactions.columns if c != key]
    scored = M.score(transactions, model)
    attributed = attribution.explain_table(scored, model, [key, *carried, "score"])
    drivers = F.slice(reports.drivers(model.features), 1, 3)
    with_velocity = attributed.withColumns(
        {
            "risk_score": F.round("score", 4),
            "predicted_class": C.predicted_class("score", model.threshold),
            "risk_label": C.risk_label("score", model.threshold),
            "flagged_features": reports.flagged_features(model.features),
            "risk_flag": F.coalesce(F.col("velocity_24hr"), F.lit(0)) > S.VELOCITY_FLAG_ABOVE,
            "_top": drivers,
        }
    )
    explained = needs_explanation()
    findings = with_velocity.select(
        key,
        *carried,
        "risk_score",
        "predicted_class",
        "risk_label",
        "flagged_features",
        F.when(explained, F.col("_top")).alias("top_drivers"),
        F.when(explained, reports.driver_sentence(F.col("_top")[0], F.col("score"))).alias("summary"),
        "risk_flag",
        C.recommendation(F.col("risk_label"), F.col("risk_flag")).alias("recommendation"),
        question(
            F.col("risk_label"), F.col("type"), F.col("risk_flag"), F.when(explained, F.col("_top")["label"])
        ).alias("query"),
    )
    findings = written(findings, "findings")
    return findings.join(answers(corpus, findings), "query")


def error_events(rejected: DataFrame, key: str) -> DataFrame:
    """One ``error`` event per rejected transaction (with ``failed``), naming the rules it breaks."""
    said = F.concat(F.lit("invalid transaction: "), F.array_join("failed", ", "))
    return rejected.select(
        F.col(key).alias("investigation_id"), F.lit(0).alias("seq"), _event("error", None, F.lit(None), said).alias("e")
    ).select("investigation_id", "seq", "e.*")


def trace_events(findings: DataFrame, key: str) -> DataFrame:
    """The investigation of each transaction as ordered events, result texts cut to 500 characters."""
    transaction = F.to_json(F.struct(F.struct(*S.REQUEST_FIELDS).alias("transaction")))  # an object in the line
    question = F.to_json(F.struct("query"))
    scored = F.to_json(F.struct("risk_score", "predicted_class", "risk_label", "flagged_features"))
    top = F.transform(
        "top_drivers", lambda d: F.struct(d["label"].alias("feature"), d["shap_value"], d["direction"])
    )
    explained = F.to_json(
        F.struct(
            "risk_score", F.col("top_drivers")[0]["label"].alias("top_driver"), "summary", top.alias("top_features")
        )
    )
    velocity = F.to_json(
        F.struct(
            "velocity_1hr",
            "velocity_3hr",
            "velocity_24hr",
            "velocity_cumcount",
            "risk_flag",
            F.lit(reports.velocity_note()).alias("note"),
        )
    )
    report = F.concat_ws(
        "\n",
        F.lit("FRAUD INVESTIGATION REPORT"),  # fixed value
        F.concat(F.lit("Score: "), F.format_string("%.4f", "risk_score"), F.lit(" "), F.col("risk_label")),
        F.col("summary"),
        F.concat(F.lit("RECOMMENDATION: "), F.col("recommendation")),
    )
    gate = needs_explanation()
    steps = [
        (F.lit(True), transaction, scored),
        (gate, transaction, explained),
        (F.lit(True), transaction, velocity),
        (F.lit(True), question, F.col("passages")),
    ]
    events = []
    for tool, (wanted, asked, result) in zip(S.TOOL_LABELS, steps, strict=True):
        events.append(F.when(wanted, _event("tool_call", tool, asked, F.lit(None))))
        events.append(F.when(wanted, _event("tool_result", tool, F.lit(None), F.substring(result, 1, 500))))
    events.append(_event("report", None, F.lit(None), report))
    listed = F.array_compact(F.array(*events))
    return findings.select(F.col(key).alias("investigation_id"), F.posexplode(listed).alias("seq", "e")).select(
        "investigation_id", "seq", "e.*"
    )


def _event(kind, name, asked, content):
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(name).cast("string").alias("name"),
        asked.cast("string").alias("input"),
        content.cast("string").alias("content"),
    )

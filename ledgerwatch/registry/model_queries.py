"""Queries that train or use a model. One training per session and data folder serves them all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.functions import columns as C
from ledgerwatch.operators import attribution, model as M, reports, retrieval, sampling
from ledgerwatch.plans import investigation, training
from ledgerwatch.registry import query
from ledgerwatch.registry.tables import KEY, features, from_features, table
from ledgerwatch.sources import corpus, run_log
from ledgerwatch.workspace import new_dir, written

# Trees per model here; the training job's default is 300. A tree costs some ten Spark jobs whatever the
# size of the data, so 300 in every session that runs these queries would measure nothing else.
TREES = 20
DEPTH = 6
REALISTIC = "Realistic (no leakage)"


@dataclass(frozen=True)
class Trained:
    features: DataFrame
    runs: dict[str, training.TrainedRun]
    out: str

    @property
    def model(self) -> M.FraudModel:
        return self.runs[REALISTIC].model


_trained: dict[tuple[str, str], Trained] = {}


def trained(spark, sf_dir) -> Trained:
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _trained:
        out = new_dir(spark, "training")
        rows = written(features(spark, sf_dir, keep=("nameOrig", "type")), "features")
        _trained[place] = Trained(rows, training.train_all(rows, KEY, out, TREES, DEPTH), out)
    return _trained[place]


def _attributed(spark, sf_dir) -> DataFrame:
    job = trained(spark, sf_dir)
    scored = M.score(job.features, job.model)
    return attribution.explain_table(scored, job.model, [KEY, *S.FEATURE_TABLE, "score"])


@query("train_run")
def train_run(spark, sf_dir):
    job = trained(spark, sf_dir)
    return run_log.read_runs(spark, f"{job.out}/runs")


@query("train_model")
def train_model(spark, sf_dir):
    job = trained(spark, sf_dir)
    split = training.split_features(job.features, KEY)
    fitted = M.train(split.where(~F.col("is_test")), S.REALISTIC_FEATURES, trees=TREES, depth=DEPTH, order=(KEY,))
    return M.score(split.where("is_test"), fitted).select(KEY, F.col(S.LABEL).cast("int").alias(S.LABEL), "score")


@query("trained_score")
def trained_score(spark, sf_dir):
    job = trained(spark, sf_dir)
    return M.score(job.features, job.model).select(KEY, "score")


@query("trained_save_load")
def trained_save_load(spark, sf_dir):
    job = trained(spark, sf_dir)
    path = new_dir(spark, "model")
    M.save_model(job.model, path)
    loaded = M.load_model(spark, path)
    again = M.score(job.features, loaded, "loaded").select(KEY, "loaded")
    return M.score(job.features, job.model).select(KEY, "score").join(again, KEY)


@query("model_reload_gap", from_features("select event_id, 0.0::double as gap from feat"))
def model_reload_gap(spark, sf_dir):
    return trained_save_load(spark, sf_dir).select(KEY, F.abs(F.col("score") - F.col("loaded")).alias("gap"))


@query("run_log")
def run_log_query(spark, sf_dir):
    job = trained(spark, sf_dir)
    return run_log.read_runs(spark, f"{job.out}/runs").select("run", F.explode("params").alias("param", "value"))


@query("run_compare")
def run_compare(spark, sf_dir):
    job = trained(spark, sf_dir)
    return run_log.run_compare(run_log.read_runs(spark, f"{job.out}/runs"), list(training.RUNS))


@query("model_info")
def model_info(spark, sf_dir):
    job = trained(spark, sf_dir)
    metrics = run_log.read_runs(spark, f"{job.out}/runs").where(F.col("run") == REALISTIC).first()["metrics"]
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in metrics.items()])
    return M.model_info(job.model, row)


@query("trained_explain_rows")
def trained_explain_rows(spark, sf_dir):
    job = trained(spark, sf_dir)
    return attribution.explain_rows(job.features, job.model, KEY)


@query("explain_additivity", from_features("select event_id, 12 as features, 0.0::double as gap from feat"))
def explain_additivity(spark, sf_dir):
    """Base value plus attributions is the log-odds of the score, on every row."""
    total = F.aggregate("attributions", F.col("base_value"), lambda a, x: a + x)
    log_odds = F.log(F.col("score") / (1 - F.col("score")))
    return _attributed(spark, sf_dir).select(
        KEY, F.size("attributions").alias("features"), F.round(F.abs(total - log_odds), 6).alias("gap")
    )


@query("trained_predict_report")
def trained_predict_report(spark, sf_dir):
    return reports.predict_report(_attributed(spark, sf_dir), KEY, trained(spark, sf_dir).model.threshold)


@query("trained_explain_report")
def trained_explain_report(spark, sf_dir):
    return reports.explain_report(_attributed(spark, sf_dir), KEY)


@query(
    "explain_order",
    from_features("select event_id, 12 as features, true as in_order, true as class_matches_label from feat"),
)
def explain_order(spark, sf_dir):
    """Drivers come by falling absolute value, and a row is class 1 exactly if it is labelled HIGH."""
    threshold = trained(spark, sf_dir).model.threshold
    sizes = F.transform("features", lambda f: F.abs(f["shap_value"]))
    rows = _attributed(spark, sf_dir)
    listed = rows.select(KEY, "score", reports.drivers().alias("features")).withColumn("_sizes", sizes)
    return listed.select(
        KEY,
        F.size("features").alias("features"),
        (F.col("_sizes") == F.reverse(F.array_sort("_sizes"))).alias("in_order"),
        ((C.predicted_class("score", threshold) == 1) == (C.risk_label("score", threshold) == "HIGH")).alias(
            "class_matches_label"
        ),
    )


@query(
    "investigate_checks",
    from_features(
        """select event_id, true as explained_when_due, true as recommendation_follows, true as has_passages,
        velocity_24hr > 5 as risk_flag from feat"""
    ),
)
def investigate_checks(spark, sf_dir):
    """The gate on explanations and the recommendation rule, on every finding."""
    label, busy, due = F.col("risk_label"), F.col("risk_flag"), F.col("risk_score") >= 0.4
    points = F.when(label == "HIGH", 2).when(label == "MEDIUM", 1).otherwise(0) + busy.cast("int")
    follows = F.when(points >= 2, "ESCALATE").when(points == 1, "MONITOR").otherwise("CLEAR")
    return investigate(spark, sf_dir).select(
        KEY,
        ((F.size(F.coalesce("top_drivers", F.array())) == 3) == due).alias("explained_when_due"),
        (F.col("recommendation") == follows).alias("recommendation_follows"),
        (F.length("passages") > 0).alias("has_passages"),
        "risk_flag",
    )


@query("trained_importance")
def trained_importance(spark, sf_dir):
    return attribution.global_importance(_attributed(spark, sf_dir), S.REALISTIC_FEATURES)


@query("trained_cases")
def trained_cases(spark, sf_dir):
    job = trained(spark, sf_dir)
    scored = M.score(job.features, job.model)
    cases = sampling.first_by_hash(reports.confident_fraud(scored, job.model.threshold), KEY, 10)
    explained = attribution.explain_table(cases, job.model, [KEY, *S.REALISTIC_FEATURES, "score"])
    return reports.top_drivers(explained, [KEY, "score", "amount"], 8)


_corpora: dict[tuple[str, str], investigation.Corpus] = {}


def document_corpus(spark, sf_dir) -> investigation.Corpus:
    """The vector table of the documents, built and saved once per session and data folder."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _corpora:
        docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
        chunks = retrieval.written_chunks(docs, "doc_id", separator="\n")
        encoder, path = retrieval.fit_encoder(chunks), new_dir(spark, "vectors")
        corpus.save_vectors(retrieval.embed(chunks, encoder), path)
        _corpora[place] = investigation.Corpus(corpus.load_vectors(spark, path), encoder)
    return _corpora[place]


_found: dict[tuple[str, str], DataFrame] = {}


def _findings(spark, sf_dir) -> DataFrame:
    """The findings of all transactions, made and written once per session and data folder."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _found:
        job = trained(spark, sf_dir)
        rows = job.features.select(KEY, "type", *S.REALISTIC_FEATURES)
        _found[place] = written(investigation.investigate(rows, KEY, job.model, document_corpus(spark, sf_dir)), "all_findings")
    return _found[place]


@query("investigate")
def investigate(spark, sf_dir):
    return _findings(spark, sf_dir).select(
        KEY, "risk_score", "predicted_class", "risk_label", "flagged_features", "top_drivers", "summary", "risk_flag",
        "recommendation", "query", "passages",
    )


@query(
    "trace_shape",
    from_features("select event_id as investigation_id, 1 as reports, true as calls_answered, true as in_order from feat"),
)
def trace_shape(spark, sf_dir):
    """Every investigation ends in one report and answers each of its calls at once."""
    events = investigation.trace_events(_findings(spark, sf_dir), KEY)

    def count(kind):
        return F.count_if(F.col("type") == kind)

    return events.groupBy("investigation_id").agg(
        count("report").cast("int").alias("reports"),
        (count("tool_call") == count("tool_result")).alias("calls_answered"),
        (F.max("seq") == 2 * count("tool_call")).alias("in_order"),
    )


@query("trace_events")
def trace_events(spark, sf_dir):
    return investigation.trace_events(_findings(spark, sf_dir), KEY)

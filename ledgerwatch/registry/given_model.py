"""Queries of a model whose trees are given, so that SQL can say every score and attribution from the trees themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.operators import attribution, curves, model as M, reports, sampling, trees, validation
from ledgerwatch.operators.features import filter_types
from ledgerwatch.operators.trees import Ensemble, Node
from ledgerwatch.plans import investigation
from ledgerwatch.registry import ORACLES, metric_queries, query  # noqa: F401  (the SQL of evaluate)
from ledgerwatch.registry.model_queries import document_corpus
from ledgerwatch.registry.tables import DRIVERS, HASH_SQL, KEY, features, from_features, from_tx, test_score, transactions
from ledgerwatch.sources import run_log
from ledgerwatch.workspace import new_dir

FEATURES = S.REALISTIC_FEATURES


def _tree(spec, nodes: list | None = None) -> tuple[Node, ...]:
    """Nodes in preorder from (feature, threshold, left, right) and leaves (value, cover)."""
    nodes = [] if nodes is None else nodes
    at = len(nodes)
    nodes.append(None)
    if len(spec) == 2:
        nodes[at] = Node(cover=spec[1], value=spec[0])
        return tuple(nodes)
    feature, threshold, left, right = spec
    children = []
    for child in (left, right):
        children.append(len(nodes))
        _tree(child, nodes)
    cover = sum(nodes[c].cover for c in children)
    nodes[at] = Node(cover, 0.0, FEATURES.index(feature), float(threshold), *children)
    return tuple(nodes)


GIVEN = Ensemble(
    trees=(
        _tree(
            (
                "newbalanceOrig", 0.5,
                ("amount", 4000, (0.31, 90), ("oldbalanceDest", 1000, (1.7, 25), (0.93, 35))),
                ("log_amount", 8.1, (-1.3, 610), ("newbalanceOrig", 5200, (-0.41, 120), (0.17, 120))),
            )
        ),
        _tree(("velocity_24hr", 5, ("step", 300, (-0.7, 410), (-0.23, 390)), ("velocity_3hr", 2, (0.37, 120), (1.1, 80)))),
        _tree(("type_encoded", 1.5, ("amount", 2600.5, (-0.2, 300), (0.61, 200)), ("velocity_cumcount", 40, (0.05, 260), (-0.33, 240)))),
        _tree(("oldbalanceOrg", 9000, ("newbalanceDest", 7000, (0.41, 400), (-0.19, 300)), (-0.52, 300))),
    ),
    weights=(1.0, 0.6, 0.45, 0.3),
    features=FEATURES,
    threshold=0.55,
)

_models: dict[str, M.FraudModel] = {}


def given(spark) -> M.FraudModel:
    """The given trees as a stored and loaded model, once per session."""
    app = spark.sparkContext.applicationId
    if app not in _models:
        _models[app] = trees.to_model(spark, GIVEN)
    return _models[app]


def scored(spark, sf_dir) -> DataFrame:
    return M.score(features(spark, sf_dir), given(spark))


def attributed(spark, sf_dir) -> DataFrame:
    return attribution.explain_table(scored(spark, sf_dir), given(spark), [KEY, *S.FEATURE_TABLE, "score"])


PROBABILITY = trees.probability_sql(GIVEN, '"')
BASE = f"{trees.base_value(GIVEN)!r}::double"
# the same names as the linear stand-ins have, so that the SQL of reports serves both
ATTRIBUTED = (
    f"attr as (select * exclude (score), {PROBABILITY} as score, ["
    + ", ".join(f"round({trees.attribution_sql(GIVEN, i, chr(34))}, 6) + 0.0" for i in range(len(FEATURES)))
    + "] as attributions from feat)"
)
RANKED = "ranked as (select *, row_number() over (partition by event_id order by abs(shap_value) desc, i) as place from drv)"
LABEL = f"case when score >= {GIVEN.threshold} then 'HIGH' when score >= {GIVEN.threshold} * 0.6 then 'MEDIUM' else 'LOW' end"
SENTENCE = """'Primary driver: ''' || label || ''' ' || case when shap_value > 0 then 'increases' else 'decreases' end
  || ' fraud probability by ' || printf('%.4f', round(abs(shap_value), 4)) || ' SHAP units. Overall risk score: '
  || printf('%.4f', round(score, 4)) || '.'"""
FLAGGED = """flags as (select event_id, string_agg(label, ' | ' order by shap_value desc, i) as flagged from (
  select *, row_number() over (partition by event_id order by shap_value desc, i) as place from drv where shap_value > 0)
  where place <= 3 group by event_id)"""


def from_given(body: str) -> str:
    return from_features(body, ATTRIBUTED, DRIVERS, RANKED, FLAGGED)


@query("score", from_features(f"select event_id, round({PROBABILITY}, 9) as score from feat"))
def score(spark, sf_dir):
    return scored(spark, sf_dir).select(KEY, F.round("score", 9).alias("score"))


@query("score_columns", from_features(f"select event_id, round({PROBABILITY}, 9) as score from feat"))
def score_columns(spark, sf_dir):
    """The same trees as one column expression, in generated code."""
    return features(spark, sf_dir).select(KEY, F.round(F.expr(trees.probability_sql(GIVEN)), 9).alias("score"))


@query(
    "model_save_load",
    from_features(f"select event_id, round({PROBABILITY}, 9) as score, round({PROBABILITY}, 9) as loaded, 0.55::double as threshold from feat"),
)
def model_save_load(spark, sf_dir):
    path = new_dir(spark, "model")
    M.save_model(given(spark), path)
    loaded = M.load_model(spark, path)
    both = M.score(scored(spark, sf_dir), loaded, "loaded")
    return both.select(KEY, F.round("score", 9).alias("score"), F.round("loaded", 9).alias("loaded"), F.lit(loaded.threshold).alias("threshold"))


@query("explain_rows", from_given(f"select event_id, feature, shap_value, round({BASE}, 9) as base_value from drv"))
def explain_rows(spark, sf_dir):
    explained = attribution.explain_rows(features(spark, sf_dir), given(spark), KEY)
    named = F.array(*[F.struct(F.lit(f).alias("feature"), (F.round(F.col("attributions")[i], 6) + 0.0).alias("shap_value")) for i, f in enumerate(FEATURES)])
    return explained.select(KEY, F.inline(named), F.round("base_value", 9).alias("base_value"))


@query(
    "predict_report",
    from_given(
        f"""select event_id, round(score, 4) as risk_score, cast(score >= {GIVEN.threshold} as integer) as predicted_class,
        {LABEL} as risk_label, {GIVEN.threshold}::double as threshold_used, coalesce(flagged, '') as flagged_features
        from attr left join flags using (event_id)"""
    ),
)
def predict_report(spark, sf_dir):
    report = reports.predict_report(attributed(spark, sf_dir), KEY, GIVEN.threshold)
    return report.withColumn("flagged_features", F.array_join("flagged_features", " | "))


@query(
    "explain_report",
    from_given(
        f"""select event_id, round(score, 4) as risk_score, round({BASE}, 6) as base_value, cast(place as integer) as "rank", feature,
        label, shap_value, raw_value, case when shap_value > 0 then 'increases_fraud' else 'decreases_fraud' end as direction,
        first_value(label) over w as top_driver, first_value({SENTENCE}) over w as summary
        from ranked window w as (partition by event_id order by place)"""
    ),
)
def explain_report(spark, sf_dir):
    report = reports.explain_report(attributed(spark, sf_dir), KEY)
    listed = report.select("*", F.posexplode("features").alias("at", "f"))
    return listed.select(KEY, "risk_score", "base_value", (F.col("at") + 1).alias("rank"), "f.*", "top_driver", "summary")


@query(
    "global_importance",
    from_given(
        """select feature, round(mean_abs, 5) as mean_abs, mean_abs > median(mean_abs) over () as above_median
        from (select feature, avg(abs(shap_value)) as mean_abs from drv group by feature)"""
    ),
)
def global_importance(spark, sf_dir):
    """Five digits: the SQL adds attributions rounded to six."""
    found = attribution.global_importance(attributed(spark, sf_dir), FEATURES)
    return found.select("feature", F.round("mean_abs", 5).alias("mean_abs"), "above_median")


@query(
    "case_attribution",
    from_given(
        f"""select event_id, round(ranked.score, 9) as score, amount, cast(place as integer) as "rank", feature, label, shap_value, raw_value,
        case when shap_value > 0 then 'increases_fraud' else 'decreases_fraud' end as direction
        from ranked join (
          select event_id, amount from attr where "isFraud" = 1 and score >= {GIVEN.threshold} order by {HASH_SQL}, event_id limit 10)
        using (event_id) where place <= 8"""
    ),
)
def case_attribution(spark, sf_dir):
    cases = sampling.first_by_hash(reports.confident_fraud(scored(spark, sf_dir), GIVEN.threshold), KEY, 10)
    explained = attribution.explain_table(cases, given(spark), [KEY, *FEATURES, "score"])
    found = reports.top_drivers(explained, [KEY, "score", "amount"], 8)
    return found.withColumn("score", F.round("score", 9))


_QUESTION = """concat_ws(' ', lower(risk_label), 'risk', lower(replace(type, '_', ' ')),
  case when risk_flag then 'with many transactions in a day' end,
  case when risk_score >= 0.4 then 'because of ' || lower(three) end)"""


@query(
    "investigate_given",
    from_given(
        f"""select event_id, risk_score, predicted_class, risk_label, flagged_features, case when risk_score >= 0.4 then three end as top_drivers,
          case when risk_score >= 0.4 then summary end as summary, risk_flag,
          case when risk_label = 'HIGH' or (risk_label = 'MEDIUM' and risk_flag) then 'ESCALATE'
            when risk_label = 'MEDIUM' or risk_flag then 'MONITOR' else 'CLEAR' end as recommendation,
          {_QUESTION} as query, true as has_passages
        from (
          select event_id, type, round(score, 4) as risk_score, cast(score >= {GIVEN.threshold} as integer) as predicted_class,
            {LABEL} as risk_label, coalesce(flagged, '') as flagged_features, velocity_24hr > 5 as risk_flag
          from attr left join flags using (event_id))
        join (select event_id, string_agg(label, ' and ' order by place) as three, min({SENTENCE}) filter (place = 1) as summary
          from ranked where place <= 3 group by event_id) using (event_id)"""
    ),
)
def investigate_given(spark, sf_dir):
    """Findings of the given model, each with the passages that its question found."""
    rows = features(spark, sf_dir, keep=("type",)).select(KEY, "type", *FEATURES)
    found = investigation.investigate(rows, KEY, given(spark), document_corpus(spark, sf_dir))
    return found.select(
        KEY,
        "risk_score",
        "predicted_class",
        "risk_label",
        F.array_join("flagged_features", " | ").alias("flagged_features"),
        F.array_join(F.col("top_drivers")["label"], " and ").alias("top_drivers"),
        "summary",
        "risk_flag",
        "recommendation",
        "query",
        (F.length("passages") > 0).alias("has_passages"),
    )


_RULES = [("step", "step between 1 and 743"), ("type", "type in ('TRANSFER', 'CASH_OUT')"), ("amount", "amount > 0")]
_RULES += [(c, f'"{c}" >= 0') for c in ("oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")]
_BROKEN = "concat_ws(', ', " + ", ".join(f"case when not coalesce({ok}, false) then '{name}' end" for name, ok in _RULES) + ")"


@query(
    "error_events",
    from_tx(
        f"""select event_id as investigation_id, 0 as seq, 'error' as type, null::varchar as name, null::varchar as input,
        'invalid transaction: ' || {_BROKEN} as content from tx where {_BROKEN} <> ''"""
    ),
)
def error_events(spark, sf_dir):
    """What a trace says of the transactions that are not investigated."""
    _, rejected = validation.split_valid(validation.default_velocity(transactions(spark, sf_dir)))
    return investigation.error_events(rejected, KEY)


# Two runs over given scores, so that the run log has values that SQL can say.
_METRICS = ("roc_auc", "pr_auc", "best_threshold", "best_f1", "precision", "recall", "true_negatives", "false_positives",
            "false_negatives", "true_positives", "recall_at_0.5", "precision_at_0.5", "f1_at_0.5")
_FORMULA_SQL = 'round(0.5 * amount / (amount + 5000) + 0.5 * cast("newbalanceOrig" = 0 as integer), 4)'
_NAMES_SQL = ", ".join(f"'{m}'" for m in _METRICS)
_VALUES_SQL = ", ".join(f'cast("{m}" as double)' for m in _METRICS)


def _run_sql(score: str) -> str:
    sql = ORACLES["evaluate"].replace(_FORMULA_SQL, score)
    return f"(select unnest([{_NAMES_SQL}]) as metric, unnest([{_VALUES_SQL}]) as value from ({sql}))"


_AMOUNT_SQL = "round(amount / (amount + 3000), 4)"


def _given_runs(spark, sf_dir) -> DataFrame:
    rows = filter_types(transactions(spark, sf_dir))
    path = new_dir(spark, "runs")
    for run, score in (("Formula", test_score(rows)), ("Amount", rows.withColumn("score", F.round(F.col("amount") / (F.col("amount") + 3000), 4)))):
        metrics = curves.evaluate(score.select(KEY, "score", F.col(S.LABEL).cast("int").alias(S.LABEL)), "score", S.LABEL)
        run_log.append_run(spark, path, run, {"score": run.lower(), "rows": "all"}, metrics.first().asDict())
    return run_log.read_runs(spark, path)


@query(
    "run_log_given",
    f"""select run, metric, value, lower(run) as score from (
    select 'Formula' as run, * from {_run_sql(_FORMULA_SQL)} union all select 'Amount', * from {_run_sql(_AMOUNT_SQL)})""",
)
def run_log_given(spark, sf_dir):
    listed = _given_runs(spark, sf_dir).select("run", F.explode("metrics").alias("metric", "value"), F.col("params")["score"].alias("score"))
    return listed.withColumn("value", F.round("value", 9))


@query(
    "run_compare_given",
    f"""select metric, f.value as "Formula", a.value as "Amount" from {_run_sql(_FORMULA_SQL)} f join {_run_sql(_AMOUNT_SQL)} a using (metric)""",
)
def run_compare_given(spark, sf_dir):
    compared = run_log.run_compare(_given_runs(spark, sf_dir), ["Formula", "Amount"])
    return compared.select("metric", *[F.round(c, 9).alias(c) for c in ("Formula", "Amount")])

"""Queries over scored transactions: curves, thresholds, reports, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.functions import columns as C
from ledgerwatch.operators import curves, profiling, reports, sampling
from ledgerwatch.operators.smote import smote, smote_neighbors
from ledgerwatch.plans.investigation import needs_explanation
from ledgerwatch.registry import query
from ledgerwatch.registry.tables import (
    ATTRIBUTED,
    DRIVERS,
    HASH_SQL,
    KEY,
    SCORE_COUNTS,
    attributed,
    features,
    from_curve,
    from_features,
    from_tx,
    scored,
    table,
    transactions,
)
from ledgerwatch.workspace import written


def _counts(spark, sf_dir):
    return curves.score_counts(scored(spark, sf_dir), "score", S.LABEL)


_CURVE = """select score, cast(pos as bigint) as pos, n, cast(tp_before as bigint) as tp_before, cast(tp as bigint) as tp,
    cast(predicted as bigint) as predicted from curve"""


@query("running_curve", from_curve(_CURVE))
def running_curve(spark, sf_dir):
    return curves.running_curve(_counts(spark, sf_dir))


@query("running_curve_buckets", from_curve(_CURVE))
def running_curve_buckets(spark, sf_dir):
    """The plan for any number of distinct scores, on the same tables."""
    return curves.running_curve(_counts(spark, sf_dir), bucket_rows=50)


_ROC = 'sum((n - pos) * (tp_before + pos / 2)) / (max(p_all)::double * (max(n_all) - max(p_all)))'
_AP = 'sum(pos * (cast(tp as double) / predicted)) / max(p_all)'


@query("roc_auc", from_curve(f"select round({_ROC}, 9) as roc_auc from curve"))
def roc_auc(spark, sf_dir):
    return curves.roc_auc(_counts(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("pr_auc", from_curve(f"select round({_AP}, 9) as pr_auc from curve"))
def pr_auc(spark, sf_dir):
    return curves.pr_auc(_counts(spark, sf_dir)).select(F.round("pr_auc", 9).alias("pr_auc"))


@query(
    "pr_curve",
    from_curve(
        """select score, round("precision", 9) as "precision", round(recall, 9) as recall, round(f1, 9) as f1 from f1s
        union all select null, 1.0, 0.0, 0.0"""
    ),
)
def pr_curve(spark, sf_dir):
    curve = curves.with_end_point(curves.pr_curve(_counts(spark, sf_dir)))
    return curve.select("score", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


_BEST = "best as (select * from f1s order by f1 desc, score limit 1)"


@query(
    "best_threshold",
    from_features(
        """select score as best_threshold, round(f1, 9) as best_f1, round("precision", 9) as "precision",
        round(recall, 9) as recall from best""",
        SCORE_COUNTS,
        _BEST,
    ),
)
def best_threshold(spark, sf_dir):
    best = curves.best_threshold(_counts(spark, sf_dir))
    return best.select("best_threshold", *[F.round(c, 9).alias(c) for c in ("best_f1", "precision", "recall")])


def _matrix_sql(threshold, score="score", label='"isFraud"'):
    return f"""select count(*) filter ({score} < {threshold} and {label} = 0) as true_negatives,
      count(*) filter ({score} >= {threshold} and {label} = 0) as false_positives,
      count(*) filter ({score} < {threshold} and {label} = 1) as false_negatives,
      count(*) filter ({score} >= {threshold} and {label} = 1) as true_positives"""


@query("confusion_matrix", from_features(_matrix_sql(0.5) + " from feat"))
def confusion_matrix(spark, sf_dir):
    return curves.confusion_matrix(scored(spark, sf_dir), 0.5, "score", S.LABEL)


def _report_sql(name, threshold):
    return f"""
{name}_m as ({_matrix_sql(threshold)} from feat),
{name}_c as (
  select 'Legit' as class, true_negatives as hit, false_negatives as wrong, false_positives as missed from {name}_m
  union all select 'Fraud', true_positives, false_positives, false_negatives from {name}_m),
{name}_s as (
  select class, coalesce(hit / nullif(hit + wrong, 0), 0) as p, coalesce(hit / nullif(hit + missed, 0), 0) as r,
    coalesce(2 * hit / nullif(2 * hit + wrong + missed, 0), 0) as f, hit + missed as support, hit from {name}_c),
{name} as (
  select class, p, r, f, support from {name}_s
  union all select 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) from {name}_s
  union all select 'macro avg', avg(p), avg(r), avg(f), sum(support) from {name}_s
  union all select 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f * support) / sum(support), sum(support) from {name}_s)"""


@query(
    "classification_report",
    from_features(
        """select cast(t as double) as threshold, class, round(p, 6) as "precision", round(r, 6) as recall, round(f, 6) as f1,
        cast(support as bigint) as support from (select 0.5 as t, * from half union all select 0.7, * from high)""",
        _report_sql("half", 0.5),
        _report_sql("high", 0.7),
    ),
)
def classification_report(spark, sf_dir):
    parts = [
        curves.classification_report(curves.confusion_matrix(scored(spark, sf_dir), t, "score", S.LABEL)).withColumn(
            "threshold", F.lit(t)
        )
        for t in (0.5, 0.7)
    ]
    report = parts[0].unionByName(parts[1])
    return report.select("threshold", "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "evaluate",
    from_features(
        f"""select round({_ROC}, 9) as roc_auc, round({_AP}, 9) as pr_auc,
        (select score from best) as best_threshold, (select round(f1, 9) from best) as best_f1,
        (select round("precision", 9) from best) as "precision", (select round(recall, 9) from best) as recall,
        (select true_negatives from at_best) as true_negatives, (select false_positives from at_best) as false_positives,
        (select false_negatives from at_best) as false_negatives, (select true_positives from at_best) as true_positives,
        (select round(r, 9) from half where class = 'Fraud') as "recall_at_0.5",
        (select round(p, 9) from half where class = 'Fraud') as "precision_at_0.5",
        (select round(f, 9) from half where class = 'Fraud') as "f1_at_0.5" from curve""",
        SCORE_COUNTS,
        _BEST,
        "at_best as (" + _matrix_sql("(select score from best)") + " from feat)",
        _report_sql("half", 0.5),
    ),
)
def evaluate(spark, sf_dir):
    row = curves.evaluate(scored(spark, sf_dir), "score", S.LABEL)
    return row.select(
        *[F.round(f"`{f.name}`", 9).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`")
          for f in row.schema.fields]
    )


@query(
    "toxic_label_metrics",
    """with s as (select l.toxic, least(d.n_chars, 20000) / 20000.0::double as score from labels l join documents d using (doc_id)),
    c as (select score, sum(toxic) as pos, count(*) as n from s group by 1),
    w as (select *, sum(pos) over o as tp, sum(n) over o as predicted, sum(pos) over () as p, sum(n) over () as total
      from c window o as (order by score desc rows between unbounded preceding and current row))
    select round(sum((n - pos) * (tp - pos + pos / 2)) / (max(p)::double * (max(total) - max(p))), 9) as roc_auc,
      round(sum(pos * (cast(tp as double) / predicted)) / max(p), 9) as pr_auc from w""",
)
def toxic_label_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.least("n_chars", F.lit(20000)) / 20000).alias("score"))
    counts = curves.score_counts(table(spark, sf_dir, "labels").join(docs, "doc_id"), "score", "toxic")
    auc, ap = curves.roc_auc(counts), curves.pr_auc(counts)
    return counts.sparkSession.range(1).select(
        F.round(auc.scalar(), 9).alias("roc_auc"), F.round(ap.scalar(), 9).alias("pr_auc")
    )


# Samples, splits and resampling.

@query("sample_legit", from_tx(f"""select event_id, amount from tx where "isFraud" = 0 and {HASH_SQL} < {int(0.01 * (1 << C.HASH_BITS))}"""))
def sample_legit(spark, sf_dir):
    legit = transactions(spark, sf_dir).where(F.col(S.LABEL) == 0)
    return sampling.hash_sample(legit, KEY, 0.01).select(KEY, "amount")


_SPLIT = f"""
sizes as (select "isFraud", count(*) as n, sum(count(*)) over () as n_all from feat group by 1),
exact as (select *, ceil(0.2::double * n_all) as n_test, n * ceil(0.2::double * n_all) / n_all as x from sizes),
ranked as (select *, floor(x) as whole, n_test - sum(floor(x)) over () as spare,
  row_number() over (order by floor(x) - x, "isFraud") as place from exact),
need as (select "isFraud", whole + case when place <= spare then 1 else 0 end as need from ranked),
hashed as (select *, row_number() over (partition by "isFraud" order by {HASH_SQL}, event_id) as place from feat),
split as (select h.*, h.place <= need as is_test from hashed h join need using ("isFraud"))"""


@query("stratified_split", from_features('select event_id, "isFraud", is_test from split', _SPLIT))
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(scored(spark, sf_dir).select(KEY, S.LABEL), S.LABEL, KEY)


@query(
    "label_summary",
    from_features(
        """select is_test, count(*) as "rows", cast(sum("isFraud") as bigint) as positives,
        round(100.0::double * avg("isFraud"), 4) as positive_pct from split group by 1""",
        _SPLIT,
    ),
)
def label_summary(spark, sf_dir):
    return profiling.label_summary(stratified_split(spark, sf_dir), "is_test")


@query(
    "sample_cases",
    from_features(f"""select event_id, score from feat where "isFraud" = 1 and score >= 0.5 order by {HASH_SQL}, event_id limit 10"""),
)
def sample_cases(spark, sf_dir):
    return sampling.first_by_hash(reports.confident_fraud(scored(spark, sf_dir), 0.5), KEY, 10).select(KEY, "score")


def _gap(c):
    return f'(cast(cast(a."{c}" as float) as double) - cast(cast(b."{c}" as float) as double))'


_SMOTE_D2 = " + ".join(f"{_gap(c)} * {_gap(c)}" for c in S.REALISTIC_FEATURES)


@query(
    "smote_neighbors",
    from_features(
        f"""select query_id, cast("rank" as integer) as "rank", id, round(distance, 4) as distance from (
        select a.event_id as query_id, b.event_id as id, {_SMOTE_D2} as distance,
          row_number() over (partition by a.event_id order by {_SMOTE_D2}, b.event_id) as "rank"
        from fraud a join fraud b on a.event_id <> b.event_id) where "rank" <= 5""",
        'fraud as (select * from feat where "isFraud" = 1)',
    ),
)
def smote_neighbors_query(spark, sf_dir):
    near = smote_neighbors(features(spark, sf_dir), KEY, S.REALISTIC_FEATURES)
    return near.select("query_id", "rank", "id", F.round("distance", 4).alias("distance"))


def _balanced(spark, sf_dir):
    return smote(written(features(spark, sf_dir), "features"), KEY, S.REALISTIC_FEATURES)


def _hash_sql(seed, key):
    return f"cast('0x' || substr(md5('{seed}:' || {key}), 1, 12) as bigint)"


_VECTOR_SQL = "[" + ", ".join(f'cast(cast("{c}" as float) as double)' for c in S.REALISTIC_FEATURES) + "]"
_POINT_SQL = ", ".join(
    f'cast(mine[{i + 1}] + u * (near[{i + 1}] - mine[{i + 1}]) as float) as "{c}"' for i, c in enumerate(S.REALISTIC_FEATURES)
)


@query(
    "smote",
    from_features(
        f"""select event_id as base_key, 0::bigint as copy, {", ".join(f'cast("{c}" as float) as "{c}"' for c in S.REALISTIC_FEATURES)},
          cast("isFraud" as integer) as "isFraud", false as is_synthetic from feat
        union all select id, copy, {_POINT_SQL}, 1, true from placed""",
        'fraud as (select * from feat where "isFraud" = 1)',
        f"vectors as (select event_id as id, {_VECTOR_SQL} as v from fraud)",
        f"""near_rows as (select a.event_id as id, b.event_id as other,
          row_number() over (partition by a.event_id order by {_SMOTE_D2}, b.event_id) as place
          from fraud a join fraud b on a.event_id <> b.event_id)""",
        "near_sizes as (select id, least(count(*), 5) as found from near_rows group by id)",
        f"""shares as (select id, each + case when place <= rest then 1 else 0 end as copies from (
          select event_id as id, row_number() over (order by {HASH_SQL}, event_id) as place,
            (legit - fraud) // fraud as each, (legit - fraud) % fraud as rest
          from fraud, (select count(*) filter ("isFraud" = 0) as legit, count(*) filter ("isFraud" = 1) as fraud from feat)))""",
        "made as (select id, cast(unnest(range(1, copies + 1)) as bigint) as copy from shares)",
        f"""drawn as (select id, copy, {_hash_sql(42, "id || '/' || copy")} % found + 1 as pick,
          {_hash_sql(43, "id || '/' || copy")}::double / {1 << C.HASH_BITS} as u from made join near_sizes using (id))""",
        """placed as (select d.id, copy, u, m.v as mine, o.v as near from drawn d join near_rows n on n.id = d.id and n.place = d.pick
          join vectors m on m.id = d.id join vectors o on o.id = n.other)""",
    ),
)
def smote_query(spark, sf_dir):
    rows = _balanced(spark, sf_dir)
    return rows.select("base_key", "copy", *S.REALISTIC_FEATURES, F.col(S.LABEL).cast("int").alias(S.LABEL), "is_synthetic")


@query(
    "smote_copies",
    from_features(
        f"""select base_key, cast(each + case when place <= rest then 1 else 0 end as bigint) as copies from (
        select event_id as base_key, row_number() over (order by {HASH_SQL}, event_id) as place,
          (legit - fraud) // fraud as each, (legit - fraud) % fraud as rest
        from feat, (select count(*) filter ("isFraud" = 0) as legit, count(*) filter ("isFraud" = 1) as fraud from feat)
        where "isFraud" = 1) where each + case when place <= rest then 1 else 0 end > 0"""
    ),
)
def smote_copies(spark, sf_dir):
    """Synthetic rows made from each minority row."""
    made = _balanced(spark, sf_dir).where("is_synthetic")
    return made.groupBy("base_key").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "smote_union",
    from_features(
        """select "isFraud", false as is_synthetic, count(*) as "rows" from feat group by 1
        union all select 1, true, (select count(*) filter ("isFraud" = 0) - count(*) filter ("isFraud" = 1) from feat)"""
    ),
)
def smote_union(spark, sf_dir):
    return _balanced(spark, sf_dir).groupBy(F.col(S.LABEL).cast("int").alias(S.LABEL), "is_synthetic").agg(
        F.count(F.lit(1)).alias("rows")
    )


# Reports from given attributions.

_RANKED = """ranked as (select *, row_number() over (partition by event_id order by abs(shap_value) desc, i) as place from drv)"""


@query(
    "flagged_features",
    from_features(
        """select event_id, coalesce(string_agg(label, ' | ' order by shap_value desc, i), '') as flagged from (
        select event_id, i, label, shap_value, row_number() over (partition by event_id order by shap_value desc, i) as place
        from drv where shap_value > 0) where place <= 3 group by event_id""",
        ATTRIBUTED,
        DRIVERS,
    ),
)
def flagged_features(spark, sf_dir):
    rows = attributed(spark, sf_dir)
    flagged = rows.select(KEY, reports.flagged_features().alias("f"))
    return flagged.where(F.size("f") > 0).select(KEY, F.array_join("f", " | ").alias("flagged"))


@query(
    "top_drivers",
    from_features(
        """select event_id, cast(place as integer) as "rank", feature, label, shap_value, raw_value,
        case when shap_value > 0 then 'increases_fraud' else 'decreases_fraud' end as direction
        from ranked where place <= 8""",
        ATTRIBUTED,
        DRIVERS,
        _RANKED,
    ),
)
def top_drivers(spark, sf_dir):
    return reports.top_drivers(attributed(spark, sf_dir), [KEY], 8)


@query(
    "driver_sentence",
    from_features(
        """select event_id, 'Primary driver: ''' || label || ''' ' || case when shap_value > 0 then 'increases' else 'decreases' end
        || ' fraud probability by ' || printf('%.4f', round(abs(shap_value), 4)) || ' SHAP units. Overall risk score: '
        || printf('%.4f', score) || '.' as summary from ranked where place = 1""",
        ATTRIBUTED,
        DRIVERS,
        _RANKED,
    ),
)
def driver_sentence(spark, sf_dir):
    first = attributed(spark, sf_dir).withColumn("_top", reports.drivers()[0])
    return first.select(KEY, reports.driver_sentence(F.col("_top"), F.col("score")).alias("summary"))


@query(
    "feature_label",
    from_features(
        "select event_id, feature, label from ranked where place = 1",
        ATTRIBUTED,
        DRIVERS,
        _RANKED,
    ),
)
def feature_label(spark, sf_dir):
    first = attributed(spark, sf_dir).select(KEY, reports.drivers()[0]["feature"].alias("feature"))
    return first.withColumn("label", C.feature_label("feature"))


@query(
    "investigate_gate",
    from_features(
        """select event_id, risk_score, risk_label, risk_flag, summary from (
        select event_id, score as risk_score, velocity_24hr > 5 as risk_flag,
          case when score >= 0.5 then 'HIGH' when score >= 0.3 then 'MEDIUM' else 'LOW' end as risk_label from feat)
        left join (select event_id, label as summary from ranked join feat using (event_id)
          where place = 1 and feat.score >= 0.4) using (event_id)""",
        ATTRIBUTED,
        DRIVERS,
        _RANKED,
    ),
)
def investigate_gate(spark, sf_dir):
    rows = attributed(spark, sf_dir)
    return rows.select(
        KEY,
        F.col("score").alias("risk_score"),
        C.risk_label("score", 0.5).alias("risk_label"),
        (F.col("velocity_24hr") > S.VELOCITY_FLAG_ABOVE).alias("risk_flag"),
        F.when(needs_explanation("score"), reports.drivers()[0]["label"]).alias("summary"),
    )

"""The tables queries start from, and the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch import schema as S
from ledgerwatch.operators.features import feature_table
from ledgerwatch.sources.event_log import relevant_from_events, transactions_from_events

KEY = "event_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(table(spark, sf_dir, "events"))


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevant_from_events(table(spark, sf_dir, "events"))


def features(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = (), **layout) -> DataFrame:
    return feature_table(relevant(spark, sf_dir), KEY, keep, **layout)


def test_score(df: DataFrame) -> DataFrame:
    """A fixed formula in place of a model, so that metrics have an exact SQL counterpart."""
    score = 0.5 * F.col("amount") / (F.col("amount") + 5000) + 0.5 * (F.col("newbalanceOrig") == 0).cast("int")
    return df.withColumn("score", F.round(score, 4))


test_score.__test__ = False


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, score and label of the relevant transactions."""
    rows = test_score(relevant(spark, sf_dir))
    return rows.select(KEY, "amount", "score", F.col(S.LABEL).cast("int").alias(S.LABEL))


# Linear stand-ins for attributions: weight and centre per feature.
LINEAR_TERMS = {
    "step": (0.002, 360),
    "type_encoded": (0.3, 1.5),
    "amount": (0.0001, 2500),
    "log_amount": (0.05, 7),
    "oldbalanceOrg": (-0.00004, 7500),
    "newbalanceOrig": (-0.00003, 5000),
    "oldbalanceDest": (0.00002, 2500),
    "newbalanceDest": (-0.00001, 5000),
    "velocity_cumcount": (0.003, 50),
    "velocity_1hr": (0.25, 1),
    "velocity_3hr": (0.1, 1.5),
    "velocity_24hr": (0.07, 4),
}


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table with test scores and linear attributions."""
    terms = [F.round((F.col(c) - centre) * weight, 6) + 0.0 for c, (weight, centre) in LINEAR_TERMS.items()]
    return test_score(features(spark, sf_dir)).withColumn("attributions", F.array(*terms))


def plain(df: DataFrame) -> DataFrame:
    """Byte columns as integers, as the SQL side has them."""
    return df.select(
        *[F.col(f"`{f.name}`").cast("int").alias(f.name) if f.dataType == T.ByteType() else F.col(f"`{f.name}`")
          for f in df.schema.fields]
    )


HASH_SQL = "cast('0x' || substr(md5('42:' || event_id), 1, 12) as bigint)"

TX = """
tx0 as (
  select event_id, ts,
    cast(floor((epoch_us(ts) - 1704067200000000) / 3600000000) + 1 as integer) as step,
    case event_type when 'click' then 'TRANSFER' when 'purchase' then 'CASH_OUT' when 'view' then 'PAYMENT'
      when 'signup' then 'CASH_IN' when 'error' then 'DEBIT' end as type,
    round(value * 100, 2) as amount,
    'C' || (user_id // 4) as "nameOrig",
    'D' || (event_id * 7919 % 997) as "nameDest",
    cast(case when event_id % 3 = 0 then 0 else event_id * 104729 % 5003 end as double) as "oldbalanceDest"
  from events),
tx1 as (
  select *, case when event_id % 11 = 0 then amount else amount + event_id * 7919 % 10007 end as "oldbalanceOrg"
  from tx0),
tx as (
  select *,
    case when event_id % 11 = 0 then 0 else round("oldbalanceOrg" - amount, 2) end as "newbalanceOrig",
    case when event_id % 22 = 0 then "oldbalanceDest" else round("oldbalanceDest" + amount, 2) end as "newbalanceDest",
    cast(type in ('TRANSFER', 'CASH_OUT') and
      ((event_id % 22 = 0 and event_id % 7 <> 0) or event_id % 331 = 0) as integer) as "isFraud",
    cast(type = 'TRANSFER' and amount > 20000 as integer) as "isFlaggedFraud"
  from tx1)"""

FEATURES = (
    TX
    + """,
rel as (select * from tx where type in ('TRANSFER', 'CASH_OUT')),
feat as (
  select *,
    case type when 'TRANSFER' then 1 when 'CASH_OUT' then 2 end as type_encoded,
    ln(1 + amount) as log_amount,
    "oldbalanceOrg" - "newbalanceOrig" - amount as orig_balance_diff,
    "newbalanceDest" - "oldbalanceDest" - amount as dest_balance_diff,
    cast("newbalanceOrig" = 0 as integer) as orig_zero_after,
    cast("newbalanceDest" = "oldbalanceDest" as integer) as dest_unchanged,
    cast(row_number() over (partition by "nameOrig" order by step, event_id) - 1 as integer) as velocity_cumcount,
    cast(count(*) over (partition by "nameOrig", step) as integer) as velocity_1hr,
    cast(count(*) over (partition by "nameOrig", cast(floor(step / 3) as integer)) as integer) as velocity_3hr,
    cast(count(*) over (partition by "nameOrig", cast(floor(step / 24) as integer)) as integer) as velocity_24hr,
    round(0.5 * amount / (amount + 5000) + 0.5 * cast("newbalanceOrig" = 0 as integer), 4) as score
  from rel)"""
)


def from_tx(body: str) -> str:
    return f"with {TX}\n{body}"


def from_features(body: str, *more: str) -> str:
    return "with " + ",\n".join([FEATURES, *more]) + f"\n{body}"


ATTRIBUTED = (
    "attr as (select *, ["
    + ", ".join(
        f'round(("{c}" - {centre}) * ({weight:.5f}), 6) + 0.0' for c, (weight, centre) in LINEAR_TERMS.items()
    )
    + "] as attributions from feat)"
)

DRIVERS = (
    "drv as ("
    + " union all ".join(
        f"select event_id, score, {i} as i, '{c}' as feature, '{S.FEATURE_LABELS[c]}' as label,"
        f' attributions[{i + 1}] as shap_value, round(cast(cast("{c}" as float) as double), 4) as raw_value from attr'
        for i, c in enumerate(LINEAR_TERMS)
    )
    + ")"
)

SCORE_COUNTS = """
counts as (select score, sum("isFraud") as pos, count(*) as n from feat group by score),
curve as (
  select score, pos, n,
    sum(pos) over w - pos as tp_before, sum(pos) over w as tp, sum(n) over w as predicted,
    sum(pos) over () as p_all, sum(n) over () as n_all
  from counts window w as (order by score desc rows between unbounded preceding and current row)),
points as (
  select score, cast(tp as double) / predicted as "precision", cast(tp as double) / p_all as recall from curve),
f1s as (select *, 2 * "precision" * recall / ("precision" + recall + 1e-9) as f1 from points)"""


def from_curve(body: str) -> str:
    return from_features(body, SCORE_COUNTS)

"""Queries over the transaction log: scans, profiles, projections, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.functions import columns as C
from ledgerwatch.operators import features as feature_ops
from ledgerwatch.operators import increment, profiling, reports, sampling, validation
from ledgerwatch.registry import query
from ledgerwatch.registry.tables import (
    HASH_SQL,
    KEY,
    TX,
    features,
    from_features,
    from_tx,
    plain,
    scored,
    test_score,
    transactions,
)
from ledgerwatch.sources import account_table
from ledgerwatch.sources import transactions as log
from ledgerwatch.workspace import new_dir, written

MONEY = ("amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")
_LOG = ["step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest",
        "newbalanceDest", "isFraud", "isFlaggedFraud"]
_LOG_SQL = ", ".join(f'"{c}"' for c in _LOG)


@query("scan_transactions", from_tx(f"select {_LOG_SQL} from tx"))
def scan_transactions(spark, sf_dir):
    path = new_dir(spark, "log_csv")
    transactions(spark, sf_dir).select(*_LOG).write.option("header", True).csv(path)
    return plain(log.scan_csv(spark, path))


@query(
    "schema_preview",
    from_tx(
        f"select event_id, {_LOG_SQL} from tx order by event_id limit 5"
    ),
)
def schema_preview(spark, sf_dir):
    return plain(log.head(transactions(spark, sf_dir).select(KEY, *_LOG), KEY, 5))


_CHUNK = 1000


_CHUNKS_SQL = f"""select cast(floor(event_id / {_CHUNK}) + 1 as integer) as chunk, count(*) as "rows",
  cast(sum("isFraud") as bigint) as fraud_rows, round(100.0::double * avg("isFraud"), 4) as fraud_pct from tx group by 1"""


@query("ingest_chunk_profile", from_tx(_CHUNKS_SQL))
def ingest_chunk_profile(spark, sf_dir):
    return profiling.chunk_profile(log.require_columns(transactions(spark, sf_dir)), KEY, _CHUNK)


@query(
    "ingest_totals",
    from_tx(
        f"""select cast(sum("rows") as bigint) as total_rows, cast(sum(fraud_rows) as bigint) as total_fraud,
        round(100.0::double * sum(fraud_rows) / sum("rows"), 4) as fraud_rate_pct, count(*) as chunks
        from ({_CHUNKS_SQL})"""
    ),
)
def ingest_totals(spark, sf_dir):
    return profiling.ingest_totals(ingest_chunk_profile(spark, sf_dir))


@query(
    "require_columns",
    from_tx("""select count(*) as "rows", 0 as missing, 1 as missing_after_drop from tx"""),
)
def require_columns(spark, sf_dir):
    rows = log.require_columns(transactions(spark, sf_dir), S.TXN_SCHEMA.names)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(log.missing_columns(rows))).alias("missing"),
        F.lit(len(log.missing_columns(rows.drop(S.LABEL)))).alias("missing_after_drop"),
    )


_F32 = ", ".join(f'cast("{c}" as float) as "{c}"' for c in S.FULL_FEATURES if c != "log_amount")


@query(
    "scan_features",
    from_features(f'select event_id, {_F32}, round(cast(cast(log_amount as float) as double), 5) as log_amount, "isFraud" from feat'),
)
def scan_features(spark, sf_dir):
    path = new_dir(spark, "features")
    log.write_features(features(spark, sf_dir), path, keep=[KEY])
    matrix = log.scan_features(spark.read.parquet(path), S.FULL_FEATURES, keep=[KEY])
    return plain(matrix.withColumn("log_amount", F.round(F.col("log_amount").cast("double"), 5)))


_FEATURES_SQL = ", ".join(
    f'round("{c}", 6) + 0.0 as "{c}"' if c in (*MONEY, "log_amount", "orig_balance_diff", "dest_balance_diff") else f'"{c}"'
    for c in S.FEATURE_TABLE
)


def _rounded(df):
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return plain(df.withColumns({c: F.round(c, 6) + 0.0 for c in doubles}))


@query("velocity_features", from_features(f'select event_id, "nameOrig", {_FEATURES_SQL} from feat'))
def velocity_features(spark, sf_dir):
    return _rounded(features(spark, sf_dir, keep=("nameOrig",)))


@query("velocity_features_sliced", from_features(f'select event_id, "nameOrig", {_FEATURES_SQL} from feat'))
def velocity_features_sliced(spark, sf_dir):
    """The plan for logs of any size, on the same tables."""
    return _rounded(features(spark, sf_dir, keep=("nameOrig",), slice_rows=500))


@query("write_features", from_features(f"select event_id, {_FEATURES_SQL} from feat"))
def write_features(spark, sf_dir):
    path = new_dir(spark, "features")
    log.write_features(features(spark, sf_dir), path, keep=[KEY])
    return _rounded(spark.read.parquet(path))


@query(
    "features_sanity",
    from_features(
        """select count(*) as "rows", cast(sum("isFraud") as bigint) as fraud_rows,
        round(100.0::double * avg("isFraud"), 4) as fraud_rate_pct, 17 as "columns" from feat"""
    ),
)
def features_sanity(spark, sf_dir):
    path = new_dir(spark, "features")
    log.write_features(features(spark, sf_dir), path)
    return log.features_sanity(spark.read.parquet(path))


def _relevant(spark, sf_dir):
    return feature_ops.filter_types(transactions(spark, sf_dir))


@query("filter_types", from_features(f"select event_id, {_LOG_SQL} from rel"))
def filter_types(spark, sf_dir):
    return plain(_relevant(spark, sf_dir).select(KEY, *_LOG))


@query(
    "balance_features",
    from_features(
        """select event_id, round(orig_balance_diff, 6) + 0.0 as orig_balance_diff,
        round(dest_balance_diff, 6) + 0.0 as dest_balance_diff, orig_zero_after, dest_unchanged from feat"""
    ),
)
def balance_features(spark, sf_dir):
    return _rounded(feature_ops.add_balance_features(_relevant(spark, sf_dir)).select(KEY, *S.BALANCE_FEATURES))


@query("log_amount", from_tx("select event_id, round(ln(1 + amount), 6) as log_amount from tx"))
def log_amount(spark, sf_dir):
    return transactions(spark, sf_dir).select(KEY, F.round(C.log_amount(), 6).alias("log_amount"))


@query(
    "type_encoded",
    from_tx(
        "select event_id, cast(case type when 'TRANSFER' then 1 when 'CASH_OUT' then 2 end as double) as type_encoded from tx"
    ),
)
def type_encoded(spark, sf_dir):
    return transactions(spark, sf_dir).select(KEY, C.type_code().cast("double").alias("type_encoded"))


@query(
    "time_buckets",
    from_tx(
        "select event_id, cast(floor(step / 3) as integer) as bucket_3hr, cast(floor(step / 24) as integer) as bucket_24hr from tx"
    ),
)
def time_buckets(spark, sf_dir):
    return transactions(spark, sf_dir).select(
        KEY, C.bucket("step", 3).alias("bucket_3hr"), C.bucket("step", 24).alias("bucket_24hr")
    )


@query(
    "feature_select",
    from_features("select event_id, " + ", ".join(
        f'round("{c}", 6) + 0.0 as "{c}"' if c in (*MONEY, "log_amount") else f'"{c}"' for c in S.REALISTIC_FEATURES
    ) + " from feat"),
)
def feature_select(spark, sf_dir):
    return _rounded(features(spark, sf_dir).select(KEY, *S.REALISTIC_FEATURES))


_FAILED = " || ".join(
    f"case when coalesce({ok}, false) then '' else '{name},' end"
    for name, ok in [
        ("step", "step between 1 and 743"),
        ("type", "type in ('TRANSFER', 'CASH_OUT')"),
        ("amount", "amount > 0"),
        *[(c, f'"{c}" >= 0') for c in MONEY[1:]],
    ]
)


@query("validate_transactions", from_tx(f"select event_id, rtrim({_FAILED}, ',') as failed from tx"))
def validate_transactions(spark, sf_dir):
    checked = validation.validate(transactions(spark, sf_dir))
    return checked.select(KEY, F.array_join("failed", ",").alias("failed"))


_EDGE = {"amount": 3, "oldbalanceOrg": 5, "newbalanceOrig": 7, "oldbalanceDest": 11, "newbalanceDest": 13}
_EDGE_SQL = ", ".join(
    f"""case when event_id % {n} = 0 then case event_id % 4 when 0 then 'nan'::double when 1 then null
    when 2 then 'inf'::double else "{c}" end else "{c}" end as "{c}\""""
    for c, n in _EDGE.items()
)
_EDGE_FAILED = " || ".join(
    f"case when coalesce({ok}, false) then '' else '{name},' end"
    for name, ok in [
        ("step", "step between 1 and 743"),
        ("type", "type in ('TRANSFER', 'CASH_OUT')"),
        ("amount", "amount > 0 and isfinite(amount)"),
        *[(c, f'"{c}" >= 0 and isfinite("{c}")') for c in MONEY[1:]],
    ]
)


@query(
    "validate_edge",
    f"""with {TX}, edge as (select event_id, step, type, {_EDGE_SQL} from tx)
    select event_id, rtrim({_EDGE_FAILED}, ',') as failed from edge""",
)
def validate_edge(spark, sf_dir):
    """Amounts and balances that are NaN, NULL or infinite are rejected by name."""
    key = F.col(KEY)

    def odd(name, every):
        value = F.when(key % 4 == 0, float("nan")).when(key % 4 == 1, None).when(key % 4 == 2, float("inf")).otherwise(F.col(name))
        return F.when(key % every == 0, value).otherwise(F.col(name))

    edge = transactions(spark, sf_dir).withColumns({name: odd(name, every) for name, every in _EDGE.items()})
    return validation.validate(edge).select(KEY, F.array_join("failed", ",").alias("failed"))


@query(
    "default_velocity",
    from_features(
        """select event_id, 1 as velocity_cumcount, case when type = 'TRANSFER' then velocity_1hr else 1 end as velocity_1hr,
        case when type = 'CASH_OUT' then velocity_3hr else 1 end as velocity_3hr, velocity_24hr from feat"""
    ),
)
def default_velocity(spark, sf_dir):
    partial = features(spark, sf_dir, keep=("type",)).select(
        KEY,
        F.when(F.col("type") == "TRANSFER", F.col("velocity_1hr")).alias("velocity_1hr"),
        F.when(F.col("type") == "CASH_OUT", F.col("velocity_3hr")).alias("velocity_3hr"),
        "velocity_24hr",
    )
    return validation.default_velocity(partial).select(KEY, *S.VELOCITY_FEATURES)


@query(
    "feature_vector",
    from_features(
        "select event_id, cast(i as integer) as i, round(cast(v as double), 4) as v from ("
        + " union all ".join(
            f'select event_id, {i} as i, cast("{c}" as float) as v from feat' for i, c in enumerate(S.REALISTIC_FEATURES)
        )
        + ")"
    ),
)
def feature_vector(spark, sf_dir):
    rows = feature_ops.add_features_array(features(spark, sf_dir))
    return rows.select(KEY, F.posexplode("features").alias("i", "v")).withColumn("v", F.round(F.col("v").cast("double"), 4))


@query(
    "velocity_check",
    from_features(
        """select event_id, velocity_1hr, velocity_3hr, velocity_24hr, velocity_cumcount, velocity_24hr > 5 as risk_flag,
        'risk_flag=True when velocity_24hr > 5 (Customer Risk Rating Matrix).' as note from feat"""
    ),
)
def velocity_check(spark, sf_dir):
    return reports.velocity_check(features(spark, sf_dir), KEY)


@query(
    "balance_anomaly",
    from_tx(
        """select event_id, "isFraud" from tx where type in ('TRANSFER', 'CASH_OUT') and "newbalanceOrig" = 0
        and "oldbalanceOrg" > 0 and "newbalanceDest" = "oldbalanceDest" """
    ),
)
def balance_anomaly(spark, sf_dir):
    return plain(transactions(spark, sf_dir).where(C.balance_anomaly()).select(KEY, "isFraud"))


@query("clip_amount", from_tx(
    "select event_id, least(amount, 1000000.0::double) as amount, least(amount, 5000.0::double) as amount_5000 from tx"
))
def clip_amount(spark, sf_dir):
    return transactions(spark, sf_dir).select(
        KEY, C.clip_amount().alias("amount"), C.clip_amount(upper=5000.0).alias("amount_5000")
    )


def _velocity_query(name, expression, sql):
    @query(name, from_features(f"select event_id, {sql} from feat"))
    def run(spark, sf_dir):
        return features(spark, sf_dir).select(KEY, expression)

    return run


for _name in S.VELOCITY_FEATURES:
    _velocity_query(_name, _name, _name)


@query("class_distribution", from_tx("""select "isFraud", case when "isFraud" = 1 then 'Fraud' else 'Legitimate' end as name,
    count(*) as "rows", round(100.0::double * count(*) / sum(count(*)) over (), 4) as pct from tx group by "isFraud" """))
def class_distribution(spark, sf_dir):
    return profiling.class_distribution(transactions(spark, sf_dir))


_BY_TYPE = """select type, cast(sum("isFraud") as bigint) as fraud_count, count(*) as total,
    round(100.0::double * sum("isFraud") / count(*), 4) as fraud_rate_pct from tx group by type"""


@query("fraud_by_type", from_tx(_BY_TYPE))
def fraud_by_type(spark, sf_dir):
    return profiling.fraud_by_type(transactions(spark, sf_dir))


@query(
    "rank_types",
    from_tx(
        f"""select cast(row_number() over (order by fraud_count desc, type) as integer) as "rank", type, fraud_count
        from ({_BY_TYPE})"""
    ),
)
def rank_types(spark, sf_dir):
    return profiling.ranked_types(profiling.fraud_by_type(transactions(spark, sf_dir)))


@query(
    "anomaly_precision",
    from_tx(
        """select count(*) filter (type in ('TRANSFER', 'CASH_OUT')) as relevant_rows, count(*) filter (hit) as anomaly_rows,
        count(*) filter (hit and "isFraud" = 1) as anomaly_fraud,
        round(100.0::double * count(*) filter (hit and "isFraud" = 1) / nullif(count(*) filter (hit), 0), 2) as precision_pct
        from (select *, type in ('TRANSFER', 'CASH_OUT') and "newbalanceOrig" = 0 and "oldbalanceOrg" > 0
        and "newbalanceDest" = "oldbalanceDest" as hit from tx)"""
    ),
)
def anomaly_precision(spark, sf_dir):
    return profiling.anomaly_precision(transactions(spark, sf_dir))


_AMOUNTS = """select "isFraud", count(*) as "rows", round(avg(amount), 4) as mean, round(median(amount), 4) as median,
    max(amount) as max from tx group by "isFraud" """


@query("amount_stats", from_tx(_AMOUNTS))
def amount_stats(spark, sf_dir):
    return profiling.amount_stats(transactions(spark, sf_dir))


@query(
    "amount_stats_sampled",
    from_tx(
        f"""select "isFraud", count(*) as "rows", round(avg(amount), 4) as mean, round(median(amount), 4) as median,
        max(amount) as max from tx where "isFraud" = 1 or {HASH_SQL} < {int(0.01 * (1 << C.HASH_BITS))} group by "isFraud" """
    ),
)
def amount_stats_sampled(spark, sf_dir):
    """All fraud against a 1 % sample of the rest."""
    return profiling.amount_stats(sampling.fraud_and_sample(transactions(spark, sf_dir), KEY, S.LABEL, 0.01))


@query("amount_stats_buckets", from_tx(_AMOUNTS))
def amount_stats_buckets(spark, sf_dir):
    """The plan for any number of distinct amounts, on the same tables."""
    return profiling.amount_stats(transactions(spark, sf_dir), bucket_rows=50)


@query(
    "amount_histogram",
    from_tx(
        """, c as (select "isFraud", least(amount, 1000000.0::double) as a from tx),
        r as (select "isFraud", min(a) as lo, max(a) as hi from c group by 1)
        select "isFraud", cast(least(floor((a - lo) / (hi - lo) * 60), 59) as integer) as bin, count(*) as "rows"
        from c join r using ("isFraud") group by 1, 2"""
    ),
)
def amount_histogram(spark, sf_dir):
    return profiling.amount_histogram(transactions(spark, sf_dir))


@query("sort_account_step", from_features('select event_id, "nameOrig", step from rel'))
def sort_account_step(spark, sf_dir):
    return _relevant(spark, sf_dir).select(KEY, "nameOrig", "step").orderBy("nameOrig", "step", KEY)


@query("head_n", from_features(f'select event_id, {_FEATURES_SQL} from feat order by event_id limit 5000'))
def head_n(spark, sf_dir):
    return _rounded(log.head(features(spark, sf_dir), KEY, 5000))


@query(
    "risk_label",
    from_features(
        "select event_id, score, case when score >= 0.5 then 'HIGH' when score >= 0.3 then 'MEDIUM' else 'LOW' end as risk_label from feat"
    ),
)
def risk_label(spark, sf_dir):
    return scored(spark, sf_dir).select(KEY, "score", C.risk_label("score", 0.5).alias("risk_label"))


@query("predicted_class", from_features("select event_id, score, cast(score >= 0.5 as integer) as predicted_class from feat"))
def predicted_class(spark, sf_dir):
    return scored(spark, sf_dir).select(KEY, "score", C.predicted_class("score", 0.5).alias("predicted_class"))


@query("confident_fraud", from_features("""select event_id, score from feat where "isFraud" = 1 and score >= 0.5"""))
def confident_fraud(spark, sf_dir):
    return reports.confident_fraud(scored(spark, sf_dir), 0.5).select(KEY, "score")


@query(
    "recommend",
    from_features(
        """select event_id, risk_label, risk_flag, case when risk_label = 'HIGH' or (risk_label = 'MEDIUM' and risk_flag)
        then 'ESCALATE' when risk_label = 'MEDIUM' or risk_flag then 'MONITOR' else 'CLEAR' end as recommendation from (
        select event_id, case when score >= 0.5 then 'HIGH' when score >= 0.3 then 'MEDIUM' else 'LOW' end as risk_label,
        velocity_24hr > 5 as risk_flag from feat)"""
    ),
)
def recommend(spark, sf_dir):
    rows = test_score(features(spark, sf_dir)).select(
        KEY, C.risk_label("score", 0.5).alias("risk_label"), (F.col("velocity_24hr") > 5).alias("risk_flag")
    )
    return rows.withColumn("recommendation", C.recommendation(F.col("risk_label"), F.col("risk_flag")))


# A log with broken lines: every 13th line lacks its last two fields, every 17th has one more, every 19th a step that is no number.
_LINE_SQL = """, lines as (
  select event_id, case when event_id % 19 = 0 then 'x' || step else cast(step as varchar) end || ',' || type || ',' || cast(floor(amount) as bigint)
    || ',' || "nameOrig" || ',1,2,' || "nameDest" || ',3,4' || case when event_id % 13 = 0 then '' else ',0,0' end
    || case when event_id % 17 = 0 then ',more' else '' end as line, step, type, cast(cast(floor(amount) as bigint) as double) as amount from tx)"""


def _broken_log(spark, sf_dir) -> str:
    rows = transactions(spark, sf_dir)
    step = F.when(F.col(KEY) % 19 == 0, F.concat(F.lit("x"), F.col("step"))).otherwise(F.col("step").cast("string"))
    line = F.concat(
        step, F.lit(","), "type", F.lit(","), F.floor("amount").cast("string"),
        F.lit(","), "nameOrig", F.lit(",1,2,"), "nameDest", F.lit(",3,4"),
        F.when(F.col(KEY) % 13 == 0, "").otherwise(",0,0"), F.when(F.col(KEY) % 17 == 0, ",more").otherwise(""),
    )
    path = new_dir(spark, "broken_log")
    rows.select(line.alias("value")).write.text(path)
    return path


@query(
    "broken_lines",
    from_tx(f"""{_LINE_SQL}
    select line, count(*) as times from lines where event_id % 13 = 0 or event_id % 17 = 0 or event_id % 19 = 0 group by line"""),
)
def broken_lines(spark, sf_dir):
    """The table of lines that do not fit the log's schema."""
    _, broken = log.split_log(log.scan_csv_checked(spark, _broken_log(spark, sf_dir), header=False))
    return broken.groupBy("line").agg(F.count("*").alias("times"))


@query(
    "sound_lines",
    from_tx(f"""{_LINE_SQL}
    select type, count(*) as "rows", cast(sum(step) as bigint) as steps, sum(amount) as amounts from lines
    where event_id % 13 <> 0 and event_id % 17 <> 0 and event_id % 19 <> 0 group by type"""),
)
def sound_lines(spark, sf_dir):
    sound, _ = log.split_log(log.scan_csv_checked(spark, _broken_log(spark, sf_dir), header=False))
    return sound.groupBy("type").agg(F.count("*").alias("rows"), F.sum("step").alias("steps"), F.sum("amount").alias("amounts"))


_VELOCITY_SQL = ", ".join(f"velocity_{h}" for h in ("cumcount", "1hr", "3hr", "24hr"))


@query("velocity_increment", from_features(f'select event_id, "nameOrig", step, {_VELOCITY_SQL} from feat'))
def velocity_increment(spark, sf_dir):
    """A log in three parts, cut within a day: each adds its rows' counters and renews those of the open day."""
    rows = feature_ops.filter_types(transactions(spark, sf_dir)).select(KEY, "nameOrig", "step")
    kept = spark.createDataFrame([], increment.CARRY)
    have = rows.limit(0).select("*", *[F.lit(0).alias(c) for c in S.VELOCITY_FEATURES])
    for low, high in ((-1, 200), (200, 500), (500, 10**6)):
        part = rows.where((F.col("step") > low) & (F.col("step") <= high))
        added = increment.added_velocity(part, kept, KEY)
        renewed = increment.refreshed(have, part)
        untouched = have.join(renewed.select(KEY), KEY, "left_anti")
        have = written(untouched.unionByName(renewed).unionByName(added), "velocity")
        kept = written(increment.merged_carry(kept, increment.carry_of(part)), "carry")
    return have.select(KEY, "nameOrig", "step", *S.VELOCITY_FEATURES)


@query("velocity_by_account", from_features(f'select event_id, "nameOrig", step, {_VELOCITY_SQL} from feat'))
def velocity_by_account(spark, sf_dir):
    """From a table laid out by account: written with one shuffle, read with none."""
    rows = feature_ops.filter_types(transactions(spark, sf_dir)).select(KEY, "nameOrig", "step")
    path = new_dir(spark, "by_account")
    name = "log_" + path.rsplit("-", 1)[1]
    return account_table.velocity_by_account(account_table.write_by_account(rows, name, path, 8), KEY).select(
        KEY, "nameOrig", "step", *[F.col(c).cast("int").alias(c) for c in S.VELOCITY_FEATURES]
    )

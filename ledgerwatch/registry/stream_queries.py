"""Streaming queries: the event table read as a stream, run to its end, the sink returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwatch import schema as S
from ledgerwatch.operators.features import filter_types
from ledgerwatch.registry import query
from ledgerwatch.registry.model_queries import trained
from ledgerwatch.registry.tables import KEY, TX, from_features, from_tx, table
from ledgerwatch.sources.event_log import EPOCH_SECONDS, transactions_from_events
from ledgerwatch.streaming import scoring, velocity
from ledgerwatch.workspace import new_dir, written


_ACCEPTED = f"{KEY} long, nameOrig string, step int, ts timestamp, day int"
_REQUEST = (KEY, "step", "type", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")


def event_stream(spark, sf_dir):
    shape = table(spark, sf_dir, "events").schema
    return transactions_from_events(
        spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )


def _relevant(spark, sf_dir):
    return event_stream(spark, sf_dir).where(F.col("type").isin(*S.TYPE_CODES))


@query("score_stream")
def score_stream(spark, sf_dir):
    out = new_dir(spark, "score_stream")
    model = trained(spark, sf_dir).model
    scoring.start_scoring(event_stream(spark, sf_dir).select(*_REQUEST), model, out).awaitTermination()
    return spark.read.parquet(f"{out}/scored").drop("batch")


@query("score_stream_gap", from_features("select event_id, 0.0::double as gap from feat where amount > 0"))
def score_stream_gap(spark, sf_dir):
    """What the stream scored against a batch over the same requests."""
    log = transactions_from_events(table(spark, sf_dir, "events"))
    batch, _ = scoring.score_batch(log.select(*_REQUEST), trained(spark, sf_dir).model)
    both = score_stream(spark, sf_dir).join(batch.select(KEY, F.col("risk_score").alias("batch_score")), KEY)
    return both.select(KEY, F.abs(F.col("risk_score") - F.col("batch_score")).alias("gap"))


@query(
    "score_stream_rejected",
    from_tx("select event_id, type from tx where not (type in ('TRANSFER', 'CASH_OUT') and amount > 0)"),
)
def score_stream_rejected(spark, sf_dir):
    out = new_dir(spark, "score_stream")
    model = trained(spark, sf_dir).model
    scoring.start_scoring(event_stream(spark, sf_dir).select(*_REQUEST), model, out).awaitTermination()
    return spark.read.parquet(f"{out}/rejected").select(KEY, "type")


_CLOSED = """timestamp '2024-01-01' + to_hours(step) <=
  (select max(ts) from tx where type in ('TRANSFER', 'CASH_OUT')) - interval 1 hour"""


def _last_closed(hours, column):
    return f"""cast(case when floor(c.step / {hours}) = floor(tx.step / {hours}) then c.{column} else 0 end + 1 as integer)"""


@query(
    "score_stream_velocity",
    f"""with {TX},
    h as (
      select "nameOrig", step, count(*) as n from tx where type in ('TRANSFER', 'CASH_OUT') group by 1, 2
      having timestamp '2024-01-01' + to_hours(step) <=
        (select max(ts) from tx where type in ('TRANSFER', 'CASH_OUT')) - interval 1 hour),
    c as (
      select *, sum(n) over (partition by "nameOrig" order by step) as total,
        sum(n) over (partition by "nameOrig", floor(step / 3) order by step) as n3,
        sum(n) over (partition by "nameOrig", floor(step / 24) order by step) as n24 from h)
    select event_id, cast(coalesce(total, 0) as integer) as velocity_cumcount, {_last_closed(1, "n")} as velocity_1hr,
      {_last_closed(3, "n3")} as velocity_3hr, {_last_closed(24, "n24")} as velocity_24hr
    from tx asof left join c on tx."nameOrig" = c."nameOrig" and tx.step >= c.step
    where type in ('TRANSFER', 'CASH_OUT') and amount > 0""",
)
def score_stream_velocity(spark, sf_dir):
    """Requests scored with their accounts' counters as of the last closed hour."""
    counters, out = _closed_hours_asof(spark, sf_dir), new_dir(spark, "score_stream")
    requests = event_stream(spark, sf_dir).select(*_REQUEST, "nameOrig")
    scoring.start_scoring(requests, trained(spark, sf_dir).model, out, counters).awaitTermination()
    return spark.read.parquet(f"{out}/scored").select(KEY, *S.VELOCITY_FEATURES)


def _buckets_sql(hours):
    return f"""select "nameOrig", {hours} as hours, cast(floor(step / {hours}) as integer) as bucket, cast(sum(n) as integer) as n
    from h group by 1, 3"""


@query(
    "velocity_stream",
    f"""with {TX},
    h as (select "nameOrig", step, count(*) as n from tx where type in ('TRANSFER', 'CASH_OUT') group by 1, 2)
    """
    + " union all ".join(f"({_buckets_sql(h)})" for h in (1, 3, 24)),
)
def velocity_stream(spark, sf_dir):
    """Hours are counted once; longer buckets are sums of closed hours; what is open when the input ends comes last."""
    accepted, hours = new_dir(spark, "accepted"), new_dir(spark, "closed_hours")
    velocity.start_accept(_relevant(spark, sf_dir).select(KEY, "nameOrig", "step", "ts"), accepted, KEY).awaitTermination()
    rows = spark.readStream.schema(_ACCEPTED).parquet(f"{accepted}/table")
    velocity.start_append(velocity.closed_hours(rows, EPOCH_SECONDS), hours).awaitTermination()
    closed = spark.read.schema(velocity.HOURS_SCHEMA).parquet(f"{hours}/table")
    every = closed.unionByName(velocity.open_hours(spark.read.schema(_ACCEPTED).parquet(f"{accepted}/table"), closed))
    found = every.select("nameOrig", F.lit(1).alias("hours"), F.col("step").alias("bucket"), F.col("n").cast("int").alias("n"))
    for length in (3, 24):
        out = new_dir(spark, f"velocity_{length}h")
        stream = spark.readStream.schema(velocity.HOURS_SCHEMA).parquet(f"{hours}/table")
        velocity.start_append(velocity.closed_buckets(stream, length, EPOCH_SECONDS), out).awaitTermination()
        part = spark.read.schema("nameOrig string, bucket int, n int").parquet(f"{out}/table")
        part = part.unionByName(velocity.open_buckets(every, part, length))
        found = found.unionByName(part.select("nameOrig", F.lit(length).alias("hours"), "bucket", "n"))
    return found


def _closed_hours_asof(spark, sf_dir):
    """Tables of the closed hours with their counters, by two streams run to their end."""
    hours, out = new_dir(spark, "closed_hours"), new_dir(spark, "asof")
    velocity.start_append(velocity.closed_hours(_relevant(spark, sf_dir), EPOCH_SECONDS), hours).awaitTermination()
    velocity.start_asof(spark, f"{hours}/table", out).awaitTermination()
    return f"{out}/table"


@query(
    "velocity_asof_stream",
    f"""with {TX},
    h as (
      select "nameOrig", step, count(*) as n from tx where type in ('TRANSFER', 'CASH_OUT') group by 1, 2
      having {_CLOSED})
    select "nameOrig", step, n,
      cast(coalesce(sum(n) over (partition by "nameOrig" order by step rows between unbounded preceding and 1 preceding), 0)
        as bigint) as velocity_cumcount,
      n as velocity_1hr,
      cast(sum(n) over (partition by "nameOrig", floor(step / 3) order by step) as bigint) as velocity_3hr,
      cast(sum(n) over (partition by "nameOrig", floor(step / 24) order by step) as bigint) as velocity_24hr from h""",
)
def velocity_asof_stream(spark, sf_dir):
    return velocity.asof_table(spark, _closed_hours_asof(spark, sf_dir))


_HOURS_SQL = """h as (
      select 'A' || (user_id % 50) as "nameOrig", step, count(*) as n from tx join events using (event_id)
      where type in ('TRANSFER', 'CASH_OUT') and user_id % 5 < 2 + step // 150 group by 1, 2)"""


@query(
    "velocity_asof_expiry",
    f"""with {TX}, {_HOURS_SQL}
    select "nameOrig", step, n,
      cast(coalesce(sum(n) over (partition by "nameOrig" order by step rows between unbounded preceding and 1 preceding), 0)
        as bigint) as velocity_cumcount,
      n as velocity_1hr,
      cast(sum(n) over (partition by "nameOrig", floor(step / 3) order by step) as bigint) as velocity_3hr,
      cast(sum(n) over (partition by "nameOrig", floor(step / 24) order by step) as bigint) as velocity_24hr from h""",
)
def velocity_asof_expiry(spark, sf_dir):
    """Accounts of few transactions, in six arrivals: many fall silent for a day, leave the state and come back."""
    hours, out = new_dir(spark, "hours"), new_dir(spark, "asof")
    events = table(spark, sf_dir, "events")
    log = _relevant_batch(spark, sf_dir).join(events.select(KEY, "user_id"), KEY)
    busy = log.where(F.col("user_id") % 5 < 2 + F.floor(F.col("step") / 150))
    counted = busy.groupBy(F.concat(F.lit("A"), F.col("user_id") % 50).alias("nameOrig"), "step").agg(F.count("*").alias("n"))
    counted = written(counted, "counted")
    for part in range(6):
        counted.where(F.least(F.floor(F.col("step") / 120), F.lit(5)) == part).write.mode("append").parquet(f"{hours}/table")
        velocity.start_asof(spark, f"{hours}/table", out, idle=24).awaitTermination()
    return velocity.asof_table(spark, f"{out}/table")


def _relevant_batch(spark, sf_dir):
    return filter_types(transactions_from_events(table(spark, sf_dir, "events")))


def _so_far(hours):
    return f"""cast(count(*) over (partition by "nameOrig", floor(step / {hours}) order by step, event_id
      rows between unbounded preceding and current row) as integer) as velocity_{hours}hr"""


@query(
    "velocity_asof_rows",
    f"""with {TX}
    select event_id, "nameOrig", step,
      cast(row_number() over (partition by "nameOrig" order by step, event_id) - 1 as integer) as velocity_cumcount,
      {_so_far(1)}, {_so_far(3)}, {_so_far(24)}
    from tx where type in ('TRANSFER', 'CASH_OUT') and {_CLOSED}""",
)
def velocity_asof_rows(spark, sf_dir):
    accepted, hours, asof, out = (new_dir(spark, name) for name in ("accepted", "closed_hours", "asof", "asof_rows"))
    velocity.start_accept(_relevant(spark, sf_dir).select(KEY, "nameOrig", "step", "ts"), accepted, KEY).awaitTermination()
    rows = spark.readStream.schema(_ACCEPTED).parquet(f"{accepted}/table")
    velocity.start_append(velocity.closed_hours(rows, EPOCH_SECONDS), hours).awaitTermination()
    velocity.start_asof(spark, f"{hours}/table", asof).awaitTermination()
    velocity.start_asof_rows(spark, f"{asof}/table", f"{accepted}/table", out, KEY, EPOCH_SECONDS).awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


# Days of arrival per micro-batch of the lateness query.
_ARRIVAL_DAYS = 5
_ARRIVAL_SQL = f"least(floor((step - 1 + case when event_id % 97 = 0 then 36 else 0 end) / {24 * _ARRIVAL_DAYS}), 5)"


@query(
    "late_events",
    f"""with {TX},
    a as (select event_id, ts, cast({_ARRIVAL_SQL} as bigint) as batch from tx),
    seen as (select b.batch, max(e.ts) as latest from (select distinct batch from a) b left join a e on e.batch < b.batch group by 1)
    select a.event_id, a.batch, coalesce(ts <= latest - interval 1 hour, false) as late from a join seen using (batch)""",
)
def late_events(spark, sf_dir):
    """Every 97th event reaches the stream a day and a half late; the stream's own watermark leaves it out."""
    source, out = new_dir(spark, "arrivals"), new_dir(spark, "accepted")
    events = transactions_from_events(table(spark, sf_dir, "events"))
    rows = written(events.select("event_id", "ts", F.expr(f"cast({_ARRIVAL_SQL} as int)").alias("arrival")), "events")
    for arrival in range(6):
        rows.where(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(source)
        stream = spark.readStream.schema("event_id long, ts timestamp").parquet(source)
        velocity.start_accept(stream, out, "event_id").awaitTermination()
    accepted = spark.read.parquet(f"{out}/table")
    return velocity.late_rows(rows, accepted, "event_id").select("event_id", F.col("arrival").cast("long").alias("batch"), "late")

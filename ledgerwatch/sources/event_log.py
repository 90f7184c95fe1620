"""A transaction log derived from an event table (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch import schema as S

# 2024-01-01T00:00:00Z, where the hour of step 1 begins
EPOCH_SECONDS = 1704067200
_EPOCH_DAY = EPOCH_SECONDS // 86400


# which event stands for which transaction type
TYPES = {"click": "TRANSFER", "purchase": "CASH_OUT", "view": "PAYMENT", "signup": "CASH_IN", "error": "DEBIT"}


def relevant_from_events(events: DataFrame) -> DataFrame:
    """The transactions that can be fraudulent; the filter is on the stored column, so the scan applies it."""
    kinds = [event for event, kind in TYPES.items() if kind in S.TYPE_CODES]
    return transactions_from_events(events.where(F.col("event_type").isin(kinds)))


def transactions_from_events(events: DataFrame) -> DataFrame:
    """Eleven transaction columns plus the row key ``event_id`` and the time ``ts``.

    Pure projection: it streams as well as it batches. Event times without a zone
    are taken as UTC whatever the session's zone.
    """
    clock = events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    base = clock.select(
        "event_id",
        F.expr(
            "make_timestamp_ltz(year(ts), month(ts), day(ts), hour(ts), minute(ts), extract(SECOND FROM ts), 'UTC')"
        ).alias("ts"),
        F.expr(f"(unix_date(cast(ts as date)) - {_EPOCH_DAY}) * 24 + hour(ts) + 1").alias("step"),
        F.expr("case event_type " + " ".join(f"when '{e}' then '{t}'" for e, t in TYPES.items()) + " end").alias("type"),
        F.expr("round(value * 100, 2)").alias("amount"),
        F.expr("concat('C', user_id div 4)").alias("nameOrig"),
        F.expr("concat('D', event_id * 7919 % 997)").alias("nameDest"),
        F.expr("cast(if(event_id % 3 = 0, 0, event_id * 104729 % 5003) as double)").alias("oldbalanceDest"),
    )
    base = base.withColumn(
        "oldbalanceOrg", F.expr("if(event_id % 11 = 0, amount, amount + event_id * 7919 % 10007)")
    )
    return base.select(
        "event_id",
        "ts",
        "step",
        "type",
        "amount",
        "nameOrig",
        "oldbalanceOrg",
        F.expr("if(event_id % 11 = 0, 0D, round(oldbalanceOrg - amount, 2))").alias("newbalanceOrig"),
        "nameDest",
        "oldbalanceDest",
        F.expr("if(event_id % 22 = 0, oldbalanceDest, round(oldbalanceDest + amount, 2))").alias("newbalanceDest"),
        F.expr(
            "cast(type in ('TRANSFER', 'CASH_OUT') and"
            " ((event_id % 22 = 0 and event_id % 7 <> 0) or event_id % 331 = 0) as byte)"
        ).alias("isFraud"),
        F.expr("cast(type = 'TRANSFER' and amount > 20000 as byte)").alias("isFlaggedFraud"),
    )

"""Tables laid out by account, so that what is grouped or joined by account needs no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.operators.velocity import account_rank, bucket_count


def write_by_account(df: DataFrame, name: str, path: str, buckets: int, account: str = "nameOrig", step: str = "step") -> DataFrame:
    """Save ``df`` at ``path`` as table ``name``, in ``buckets`` hash buckets by account, each sorted by account and hour.

    The rows shuffle once, here. A bucket is read by one task, so ``buckets`` should follow the table's
    size (some 100 MB each); a log where one account holds a large share of all rows belongs in the
    sliced plan of ``add_velocity`` instead. Rows without an account share a bucket.
    """
    dealt = df.repartition(buckets, account)
    dealt.write.bucketBy(buckets, account).sortBy(account, step).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def velocity_by_account(table: DataFrame, key: str, account: str = "nameOrig", step: str = "step") -> DataFrame:
    """``add_velocity`` on a table laid out by account: four windows, no exchange."""
    return table.withColumn("velocity_cumcount", account_rank(key, account, step)).withColumns(
        {f"velocity_{h}hr": bucket_count(h, account, step) for h in (1, 3, 24)}
    )


def account_rows(spark: SparkSession, name: str, accounts: list, account: str = "nameOrig") -> DataFrame:
    """The rows of a few accounts; only their buckets are read."""
    return spark.table(name).where(F.col(account).isin(*accounts))

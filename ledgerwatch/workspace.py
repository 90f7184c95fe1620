"""Where jobs keep intermediate tables: the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_jobs: dict[str, list[str]] = {}  # the folders of running jobs, outermost first


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without it; a cluster without a shared folder
    is an error, since a machine-local path would not outlive its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="ledgerwatch-")
    return _local_dirs[app]


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    return "/".join([f"{shared_dir(spark)}/ledgerwatch/{app}", *_jobs.get(app, [])])


@contextmanager
def job_folder(spark: SparkSession, job: str) -> Iterator[str]:
    """A folder for the intermediate tables made in the block, removed with them when it ends, however it ends.

    What a job keeps belongs elsewhere. Tables made outside the block stay.
    """
    app = spark.sparkContext.applicationId
    inside = [*_jobs.get(app, []), f"{job}-{uuid.uuid4().hex[:12]}"]
    _jobs[app] = inside
    path = _folder(spark)
    try:
        yield path
    finally:
        _jobs[app] = inside[:-1]
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and pins the rows: later passes read the table, and a lost
    executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point iterative trainers at the shared folder if nothing has yet."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))

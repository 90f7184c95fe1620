"""Text files in, and the vector table they become."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote
from zlib import crc32

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.functions.text import file_stem
from ledgerwatch.workspace import written

VECTOR_COLUMNS = ("chunk_id", "doc_id", "paragraph", "source", "text", "embedding")
FOLDERS = 256  # that a corpus of files is dealt over
OPEN_COST = 1 << 16  # bytes that opening a small file is taken to cost
_OPEN_COST = "spark.sql.files.openCostInBytes"
TASK_FILES, TASK_BYTES = 8_192, 64 << 20  # that a task reads, about
TASK_FOLDERS = 256  # that a task lists, about
_HELD_ROWS, _HELD_BYTES = 10_000, 16 << 20  # that a task hands on at once
_LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
_READ = pa.schema([("name", pa.string()), ("content", pa.binary())])
# what a URI writes otherwise: beyond ASCII only control characters and spaces
_QUOTED = re.compile("[^A-Za-z0-9_\\-!.~'()*,;:$&+=@\x80-\U0010ffff]|[\x80-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def load_corpus(spark: SparkSession, path: str, by_tasks: bool | None = None) -> DataFrame:
    """Every ``*.txt`` below ``path`` as one row: its text, and its name without suffix.

    Tasks list the folders, level by level, into a table of the shared folder, and read the files; the driver holds
    no entry of a file. A folder by itself is listed by one task. ``by_tasks`` says whether tasks can do so, where that
    is known. Where Arrow has no file system for ``path``, or where it is a pattern or a single file, Spark
    lists and the driver keeps the status of every file. Both leave out empty files and hidden names, as Spark does,
    and write a name as a URI does (``a%20b`` for ``a b``).
    """
    found = _folder(spark, path)
    if found is None if by_tasks is None else not by_tasks:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
        files = files.select("content", F.col("_metadata.file_name").alias("name"))
    else:
        files = _files_by_tasks(spark, *found)
    return files.select(F.col("content").cast("string").alias("text"), file_stem(F.col("name")).alias("source"))


def _folder(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """(URI, path in its file system) of a folder that Arrow can list; else nothing."""
    if any(c in path for c in "{}[]*?\\"):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    try:
        folder = uri.getPath() if uri.getScheme() == "file" else pa.fs.FileSystem.from_uri(uri.toString())[1]
        there = _filesystem(uri.toString()).get_file_info(folder)
    except (pa.ArrowException, OSError):
        return None
    return (uri.toString(), folder) if there.type == pa.fs.FileType.Directory else None


def _filesystem(uri: str) -> pa.fs.FileSystem:
    return pa.fs.LocalFileSystem() if uri.startswith("file:") else pa.fs.FileSystem.from_uri(uri)[0]


def _files_by_tasks(spark: SparkSession, uri: str, folder: str) -> DataFrame:
    """(name, content) of the files below a folder."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem = _filesystem(uri)
        for batch in batches:
            for below in batch.column(0).to_pylist():
                found = filesystem.get_file_info(pa.fs.FileSelector(below))
                for i in range(0, len(found), _HELD_ROWS):
                    rows = [(f.path, f.size or 0, f.type == pa.fs.FileType.Directory) for f in found[i : i + _HELD_ROWS] if _counts(f)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 3, _LISTED.types)], schema=_LISTED)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, names, contents, held = _filesystem(uri), [], [], 0
        for batch in batches:
            for at in batch.column(0).to_pylist():
                with filesystem.open_input_stream(at, compression=None) as source:
                    content = source.read()
                if names and (held + len(content) > _HELD_BYTES or len(names) >= _HELD_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], schema=_READ)
                    names, contents, held = [], [], 0
                names.append(_as_uri(at.rsplit("/", 1)[-1]))
                contents.append(content)
                held += len(content)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], schema=_READ)

    cores = spark.sparkContext.defaultParallelism
    level, files = spark.range(0, 1, 1, 1).select(F.lit(folder).alias("path")), None
    while True:
        here = written(level.mapInArrow(listed, "path string, size long, folder boolean"), "listed")
        files = here if files is None else files.unionByName(here)
        below = here.where("folder").select("path")
        many = below.count()
        if not many:
            break
        level = below.repartition(max(math.ceil(many / TASK_FOLDERS), min(many, 4 * cores)), "path")
    files = files.where(~F.col("folder"))
    many, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, math.ceil(many / TASK_FILES), math.ceil(size / TASK_BYTES), min(2 * cores, math.ceil(many / 256)))
    return files.select("path").repartition(tasks, "path").mapInArrow(read, "name string, content binary")


def _as_uri(name: str) -> str:
    return _QUOTED.sub(lambda c: quote(c[0], safe=""), name)


def _counts(found: pa.fs.FileInfo) -> bool:
    """Folders and texts that Spark's readers would not leave out: by hidden names, or as empty."""
    name = found.base_name
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name)
    if found.type == pa.fs.FileType.Directory:
        return name.startswith(("_metadata", "_common_metadata")) or not (hidden or name.endswith("._COPYING_"))
    return found.type == pa.fs.FileType.File and name.endswith(".txt") and not hidden and bool(found.size)


@contextmanager
def many_files_a_task(spark: SparkSession) -> Iterator[None]:
    """What runs in the block reads small files by the thousand: Spark counts each as 4 MB otherwise, 32 to a task."""
    before = spark.conf.get(_OPEN_COST)
    spark.conf.set(_OPEN_COST, str(OPEN_COST))
    try:
        yield
    finally:
        spark.conf.set(_OPEN_COST, before)


def write_texts(docs: DataFrame, path: str, name: Column, text: str = "text") -> int:
    """Each text as a file ``<name>.txt`` in one of ``FOLDERS`` folders below ``path``, written by the tasks; the number of texts.

    For corpora of files that others read; names must be unique, as the later of two would win. The name decides
    the folder: many small ones are listed by the tasks, a single large one by the driver alone. A retried
    task writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = pa.fs.FileSystem.from_uri(path)
        made = set()
        for batch in batches:
            for stem, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = f"{folder}/{crc32(stem.encode('utf-8')) % FOLDERS:03}"
                if part not in made:
                    filesystem.create_dir(part, recursive=True)
                    made.add(part)
                with filesystem.open_output_stream(f"{part}/{stem}.txt") as out:
                    out.write(content.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = docs.select(name.alias("stem"), F.col(text).alias("content")).where(F.col("content").isNotNull())
    written = rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not written:  # an empty corpus is a folder without files
        filesystem, folder = pa.fs.FileSystem.from_uri(path)
        filesystem.create_dir(folder, recursive=True)
    return written


def save_vectors(df: DataFrame, path: str) -> None:
    df.select(*VECTOR_COLUMNS).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*VECTOR_COLUMNS)

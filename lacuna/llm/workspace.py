"""The folder that driver and executors share, and files written to it from tasks.

Every path is a URI.  Files are written under a temporary name and then moved, so a task that is retried
after an executor was lost replaces its own file and never leaves half of one.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more than 1/HOT of all rows, so there are fewer than HOT hot keys.
HOT = 4096

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _own:
            if spark.sparkContext.master.startswith("local["):
                _own[app] = tempfile.mkdtemp(prefix="lacuna-shared-")
                atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
            else:
                _own[app] = f"{spark.conf.get('spark.sql.warehouse.dir')}/_lacuna_shared"
        found = _own[app]
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", found):  # of the default file system, which tasks' file access can't know
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go when it ends, instead of when the driver's garbage is collected: what it wrote needs them no more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, an action hands so many rows at a time to Python at most: for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A table of its own in the shared folder; unlike a checkpoint's, its shuffles are dropped."""
    return to_table(df, new_folder(df.sparkSession, "cut"))


def to_table(df: DataFrame, folder: str, compression: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write as Parquet in the shared folder and read it back; group_bytes: what a writer holds, and a reader has at once of large rows (128 MB by default)."""
    with shuffles_dropped(df.sparkSession):
        out = df.write.mode("overwrite")
        (out if group_bytes is None else out.option("parquet.block.size", group_bytes)).parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_hot(rows: DataFrame, table: DataFrame, hot: DataFrame, key: str, by: Column) -> DataFrame:
    """rows left-joined with table (one row for each key), although few keys may hold most rows.

    hot: the part of table whose keys each have more than 1/HOT of the rows, HOT entries at most.  It is broadcast;
    rows of hot keys then need no partner, and are dealt out by a hash of `by` where the others go by their key.
    """
    named = [c for c in table.columns if c != key]
    sent = hot.select(F.col(key), F.struct(*named).alias("__hot"))
    marked = rows.join(F.broadcast(sent), key, "left").withColumn("__deal", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(1 << 20)) + 1).otherwise(F.lit(0)))
    cold = table.select(F.col(key), F.lit(0).cast("bigint").alias("__deal"), F.struct(*named).alias("__cold"))
    met = marked.join(cold.hint("merge"), [key, "__deal"], "left")
    return met.select(*rows.columns, *[F.coalesce(F.col("__hot")[c], F.col("__cold")[c]).alias(c) for c in named])


def release(*caches) -> None:
    """Empties a worker's caches and gives their memory back: workers go on to other stages."""
    import ctypes
    import gc

    import pyarrow as pa

    for c in caches:
        c.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def filesystem(uri: str):
    """The pyarrow file system of a URI or plain path, and the path within it."""
    from pyarrow import fs

    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


class Replacing:
    """Write handle whose file appears under its name only when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.draft)

    def write(self, data) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


def read_range(uri: str, start: int, length: int) -> bytes:
    files, path = filesystem(uri)
    with files.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)


def portions(column, rows: int, size: int = 4 << 20):
    """(start, length) of slices of a string, binary or list column: at most `rows` rows, and `size` bytes (or entries) unless a single row has more."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    measure = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    upto = np.cumsum(pc.fill_null(measure(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(upto):
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + size, "right"))))
        yield at, end - at
        at = end


def rows_of(batch, *names: str, at_once: int = 256):
    """The rows of an Arrow batch as tuples, with only a few (and no more bytes than `portions` allows) turned into Python objects at a time."""
    import pyarrow as pa

    wide = [c for n in names if pa.types.is_string((c := batch.column(n)).type) or pa.types.is_binary(c.type)]
    spans = portions(wide[-1], at_once) if wide else ((k, at_once) for k in range(0, batch.num_rows, at_once))
    for k, n in spans:
        part = batch.slice(k, n)
        yield from zip(*(part.column(c).to_pylist() for c in names), strict=True)


def arrow_schema(ddl: str):
    """pyarrow's schema of `name type, ...`; for use in tasks, which have no session to ask."""
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])

"""Folders that the driver and all executors see, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}


def base_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset and all runs on this machine, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return _qualified(spark, named.rstrip("/"))
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="almucantar-")
        atexit.register(shutil.rmtree, _OWN["dir"].removeprefix("file://"), ignore_errors=True)
    return _OWN["dir"]


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, so that Spark and pyarrow mean the same file system."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString()


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created."""
    return f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back. A lost executor cannot take it along.

    With a ``path`` whose table is complete, that table is read and ``df`` is not computed again.
    """
    spark = df.sparkSession
    if path is None or not complete(spark, path):
        path = path or new_dir(spark, name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return table(spark, path, df.schema)


def table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A table of ``written``."""
    out = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    out._written_at = path
    return out


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table of ``written`` is there as a whole."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)


def drop(*tables: DataFrame | str) -> None:
    """Deletes tables of ``written`` (or folders) that nothing will read again."""
    for t in tables:
        path = t if isinstance(t, str) else t._written_at
        fs, at = filesystem(path)
        try:
            fs.delete_dir(at)
        except FileNotFoundError:
            pass


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> str:
    """Creates a shared folder from the driver."""
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)
    return uri


def publish(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Moves a finished file to its name. An attempt that ran earlier wrote the same bytes, so its file stays."""
    if fs.get_file_info(final).type == pafs.FileType.NotFound:
        try:
            fs.move(temporary, final)
            return
        except OSError:  # another attempt was quicker
            if fs.get_file_info(final).type == pafs.FileType.NotFound:
                raise
    fs.delete_file(temporary)


def sweep(fs: pafs.FileSystem, folder: str) -> None:
    """Removes what attempts that failed have left under temporary names, once the manifest is written."""
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        if info.base_name.startswith(".") and info.base_name.endswith(".tmp"):
            try:
                fs.delete_file(info.path)
            except FileNotFoundError:
                pass


def spread(spark: SparkSession, values: list, kind: str = "string", column: str = "item") -> DataFrame:
    """A table with one partition for each value: file names and the like, never documents."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_at int, {column} {kind}")
    if not values:
        return rows.drop("_at")
    return rows.repartitionById(len(values), F.col("_at")).drop("_at")


def text_batches(batches, most_bytes: int = 8 << 20):
    """Splits record batches so that each holds about ``most_bytes`` at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, whatever the case of its letters."""
    own = {c.lower() for c in df.columns}
    out = []
    for name in names:
        k = 0
        while f"_{name}{k}".lower() in own:
            k += 1
        out.append(f"_{name}{k}")
    return out


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of columns given by name."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def small_arrow_batches(spark: SparkSession) -> None:
    """Lets Spark hand at most some MB to Python at once, however long the texts are; smaller settings stay as they are.

    Spark has no such setting for one query, so it holds for the session.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = int(re.sub(r"[bB]$", "", spark.conf.get(key)))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


_HELD: dict[str, Callable[[], None]] = {}
_LAST: list[str] = []


def held_by(owner: str, forget: Callable[[], None]) -> None:
    """Says how a worker drops what an operator keeps between tasks."""
    _HELD[owner] = forget


def begin(owner: str) -> None:
    """At the start of a task: a Python worker that served another operator drops what it kept for that; free memory goes back."""
    if _LAST[-1:] != [owner]:
        for other, forget in _HELD.items():
            if other != owner:
                forget()
        _LAST[:] = [owner]
    trim()


def trim() -> None:
    """Returns memory that is free to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _libc("malloc_trim", 0)


def _libc(name: str, *args: int) -> None:
    """A function of the C library, where it has it."""
    call = getattr(ctypes.CDLL(None), name, None) if sys.platform == "linux" else None
    if call is not None:
        call(*args)

"""Tables in the folder that the whole cluster shares, and how long they live."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written inside each open ``temporary_tables`` block of this thread; another thread sees its own blocks only.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_tables", default=())

#: Most bytes of an Arrow batch that goes to a Python worker while a table is written, and how much larger a written
#: table is taken to be in memory than its compressed files, when Spark weighs a broadcast.
BATCH_BYTES, FILE_COMPRESSION = 16 << 20, 2.0
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.sources.fileCompressionFactor": str(FILE_COMPRESSION)}

#: Jobs of each session that run under ``SETTINGS``, and what the session had before the first of them.
_USED: dict[str, tuple[int, dict[str, str]]] = {}
_LOCK = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session that names none gets a temporary one; on a cluster
    such a folder would lie on one machine's disk, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="rulewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/rulewright/{name}-{uuid.uuid4().hex}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@contextmanager
def temporary_tables():
    """Deletes the tables that ``written`` made inside the block when it ends, but for those it was told to keep."""
    mine: list[str] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in mine:
            try:
                store, name = file_system(path)
                store.delete_dir(name)
            except (OSError, ValueError):  # never written, or in a store that pyarrow can't reach: left to the folder's owner
                pass


def scratch_table(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path that the block of ``temporary_tables`` around it deletes; ``keep``: the block around that one."""
    path, blocks = scratch_path(spark, name), _OPEN.get()
    if blocks[keep:]:
        blocks[-1 - keep].append(path)
    return path


@contextmanager
def job_settings(spark: SparkSession):
    """Bounds the Arrow batches of a job, so that rows with long values don't add up in Python workers, and makes Spark compare
    the size in memory of a compressed table with its broadcast limit. The last of the jobs that overlap restores the session's own."""
    session = str(spark._jsparkSession.sessionUUID()) if hasattr(spark, "_jsparkSession") else str(id(spark))
    with _LOCK:
        n, before = _USED.get(session, (0, {}))
        if not n:
            before = {key: spark.conf.get(key) for key in SETTINGS}
            for key, value in SETTINGS.items():
                spark.conf.set(key, value)
        _USED[session] = n + 1, before
    try:
        yield
    finally:
        with _LOCK:
            n, before = _USED.pop(session)
            if n > 1:
                _USED[session] = n - 1, before
            else:
                for key, value in before.items():
                    spark.conf.set(key, value)


@contextmanager
def settings(spark: SparkSession, **wanted: str):
    """Session settings of one job: names with __ for dots."""
    ours = {key.replace("__", "."): value for key, value in wanted.items()}
    before = {key: spark.conf.get(key) for key in ours}
    for key, value in ours.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors, and tells
    Spark the real size, so that it broadcasts a side only below spark.sql.autoBroadcastJoinThreshold.

    ``keep``: the table outlives the block of ``temporary_tables`` that it is written in.
    """
    path = scratch_table(df.sparkSession, name, keep)
    with job_settings(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

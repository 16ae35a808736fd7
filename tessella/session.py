"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextvars import ContextVar, Token
from weakref import WeakKeyDictionary

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

_shipped: dict[str, bool] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_owner: ContextVar[Scratch | None] = ContextVar("scratch", default=None)
#: Rows of whole texts that a Python worker holds at once.
BATCH_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per application, and bounds their batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tessella")
    path = os.path.join(folder, "tessella_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for inner, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(inner, name)
                    out.write(full, os.path.join("tessella", os.path.relpath(full, top)))
    # Executors fetch it from the driver whenever they start.
    spark.sparkContext.addPyFile(path)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _shipped[app] = True


def lean(run: Callable) -> Callable:
    """The same mapInArrow function; its worker, which lives on, gives free memory back to the machine at the end of each task."""

    @functools.wraps(run)
    def trimmed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _trim()

    return trimmed


def _trim() -> None:
    """Collects this process's garbage and gives free memory back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset, a folder under
    /tmp is set in its place for a local master, and is an error for any other.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints/tessella"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """The scratch tables of one caller: those written while it is entered; ``clear`` deletes them and no others.

    Frames that still read them cannot be used after that.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []
        self._tokens: list[Token] = []

    def __enter__(self) -> Scratch:
        self._tokens.append(_owner.set(self))
        return self

    def __exit__(self, *_: object) -> None:
        _owner.reset(self._tokens.pop())

    def clear(self, spark: SparkSession) -> None:
        for path in self.paths:
            _delete(spark, path)
        self.paths.clear()
        tidy(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared folder: it goes with its ``Scratch``, at the latest when the application ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # Only what exists can be marked.
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    owner = _owner.get()
    if owner is not None:
        owner.paths.append(path)
    return path


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts lineage: a lost executor costs a re-read of files, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def tidy(spark: SparkSession) -> None:
    """Lets go of what frames that nobody holds any more have left behind.

    Spark drops their broadcasts and shuffle files on the executors, and the driver their
    plans and generated code, only when the driver collects garbage; a driver with memory
    to spare does so late. The driver's own Python gives back what it gathered. An
    executor's heap keeps the size that the busiest phase so far gave it, beside which
    the Python workers of the next phase need their own, until it is collected as a whole.
    """
    _trim()
    spark._jvm.System.gc()
    _trim_driver(spark)
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        _collect_executors(spark)


def _collect_executors(spark: SparkSession) -> None:
    """A task for each core, which collects its executor's garbage and so gives free heap back to the machine."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def _trim_driver(spark: SparkSession) -> None:
    """Gives free native memory of the driver's JVM back to the machine, where that JVM has such a command."""
    java, new = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    try:
        names = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
        types, arguments = new(java.Class, 4), new(java.Object, 4)
        for i, name in enumerate(names):
            types[i] = java.Class.forName(name)
        arguments[0] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        arguments[1], arguments[2], arguments[3] = "systemTrimNativeHeap", new(java.Object, 0), new(java.String, 0)
        # The server's own class is not open to reflection, the interface is.
        call = java.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", types)
        call.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JError:
        pass  # other JVMs


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of frames that ``materialise`` gave and nothing reads any more."""
    for frame in frames:
        path, owner = _paths.pop(frame), _owner.get()
        _delete(frame.sparkSession, path)
        if owner is not None and path in owner.paths:
            owner.paths.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

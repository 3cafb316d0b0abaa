"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def batches(spark: SparkSession, rows: int = 4000, size: int = 24 << 20) -> None:
    """Bound the Arrow batches that go to Python workers, in rows and in bytes, and let the workers import this library."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


_scopes: list[list[str]] = []


def table(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it again: its lineage is cut, and a lost executor loses nothing."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    trim(spark)
    for scope in _scopes:
        scope.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def trim(spark: SparkSession) -> str:
    """Have the driver's JVM and Python give freed native memory back to the system; what the JVM says of it.

    The C library keeps what the many threads that plan, compile and broadcast have freed, each in an arena of its own, and a driver of many queries grows
    by that. Where the JVM or the C library can't do it, nothing happens.
    """
    with suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # The interface's method by reflection: the server's own class isn't open to py4j.
        kinds, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values))
    except Py4JError:
        return ""


def drop(*tables: DataFrame) -> None:
    """Delete what table() wrote for frames that nothing reads any more."""
    for frame in tables:
        for folder in {os.path.dirname(file) for file in frame.inputFiles()}:
            _delete(frame.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the tables that were written meanwhile. A result that is to stay is written by kept()."""
    scope: list[str] = []
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes[:] = [x for x in _scopes if x is not scope]
        for path in scope:
            _delete(spark, path)


def kept(frame: DataFrame, name: str) -> DataFrame:
    """table() of a result that outlives the scratch() around it."""
    scopes, _scopes[:] = list(_scopes), []
    try:
        return table(frame, name)
    finally:
        _scopes[:] = scopes


BROADCAST_BYTES = 48 << 20  # the most that is marked for broadcast, by a measure of the data itself
HOT_ROWS = 200_000  # of one key, beyond which its rows are dealt over several tasks


def bounded(frame: DataFrame, name: str, weight: Column | int = 32, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written copy of the frame, marked for broadcast if its rows weigh at most `most` bytes together; otherwise joins shuffle it."""
    written = table(frame, name)
    return F.broadcast(written) if _weight(written, weight) <= most else written


def _weight(frame: DataFrame, weight: Column | int) -> int:
    return int(frame.agg(F.sum(F.lit(weight) if isinstance(weight, int) else weight)).first()[0] or 0)


def join_ones(rows: DataFrame, ones: DataFrame, key: str, weight: Column | int, how: str = "inner", count_as: str | None = None) -> DataFrame:
    """Join with a frame that has each key once. It is broadcast if its rows, of `weight` bytes each, are light enough; otherwise
    both are shuffled, with the rows of a hot key dealt over several tasks. With `count_as` the result is the number of rows of each key, counted before anything is shuffled by it.
    """
    ones = table(ones, "ones")
    light = _weight(ones, weight) <= BROADCAST_BYTES
    if count_as:
        counts = lambda x: x.groupBy(key).agg(F.count("*").alias(count_as))
        return counts(rows.join(F.broadcast(ones), key)) if light else counts(rows).join(ones, key)
    if light:
        return rows.join(F.broadcast(ones), key, how)
    return join_dealt(rows, ones, [key], rows.groupBy(key).agg(F.count("*").alias("_n")), how)


def join_dealt(rows: DataFrame, ones: DataFrame, keys: list[str], sizes: DataFrame, how: str = "inner") -> DataFrame:
    """Join with a frame that has each key once, both shuffled, with the rows of a hot key dealt over several tasks; sizes: the keys and _n, their numbers of rows."""
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    most = max(HOT_ROWS, total // 1_000_000)  # so at most a million keys are hot
    hot = table(sizes.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_salts")), "hot")
    if hot.isEmpty():
        return rows.join(ones, keys, how)
    mine = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if "map" not in t]), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    theirs = ones.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return mine.join(theirs, [*keys, "_salt"], how).drop("_salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

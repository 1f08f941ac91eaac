"""Session factory and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def get_session(app: str = "ledgerfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; *conf* overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; a folder of our own only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="ledgerfold-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/ledgerfold/{os.getpid()}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write *df* as a table in the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def first_rows(df: DataFrame, n: int, *order: str | Column) -> list[Row]:
    """The first *n* rows in an order. A task puts them together, so the driver gets no *n* rows of every task to choose from."""
    whole = df.orderBy(*order).limit(n).agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    return whole.first()["rows"]


def forget(spark: SparkSession) -> None:
    """Let the driver find what is no longer used: only then are shuffles and broadcasts of finished steps given up.

    A chain of many small jobs piles them up otherwise, on the disks of executors as well as in the driver. What planning,
    compiling and fetching have freed outside of the heap goes back to the system too.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Have the C library give back freed memory, in the JVM and here; where there is no way to ask for it, nothing is done."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        names = new(jvm.Class, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            names[i] = jvm.Class.forName(name)
        call = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", names)
        values = new(jvm.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # another JVM
        pass
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Delete what this process wrote to the shared folder; call it once results have been stored."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/ledgerfold/{os.getpid()}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

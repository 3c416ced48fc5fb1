"""Written tables that cut lineage, and joins whose broadcast side has a checked size."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; beyond it, the join is shuffled and adaptive execution splits hot keys.
BROADCAST_ROWS = 10_000
#: Rows of a file of a table whose number of rows is known before it is written.
FILE_ROWS = 250_000
#: Bytes of a file of a table whose size is known before it is written.
FILE_SIZE = 1 << 27

_own: dict[str, str] = {}
_written: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own on a single machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lumenfold-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def cut(df: DataFrame, name: str, rows: int | None = None, size: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; a lost executor costs at most the tasks after it.

    Where it is known to have about ``rows`` rows, or ``size`` bytes, it goes to as few files as hold ``FILE_ROWS`` or
    ``FILE_SIZE`` each; one of bytes to no fewer than there are cores.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / FILE_ROWS)))
    if size is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(size / FILE_SIZE)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; tables that :func:`cut` didn't write stay."""
    for df in tables:
        ref, path = _written.pop(id(df), (None, None))
        if ref is None or ref() is not df:
            continue
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are few enough, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def parts(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions for ``rows`` of about ``per_part`` each, at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_part), 1)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, where its scan has rows for fewer tasks; other scans stay as they are.

    Only a table of fewer files than cores is looked at, and of that only how many rows each task gets, which Parquet
    footers tell.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    busy = df.select(F.spark_partition_id().alias("part")).distinct().count()
    return df.repartition(cores) if busy < cores else df

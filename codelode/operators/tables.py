"""Tables computed once, in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shared(spark) -> str:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codelode-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in the folder of spark.checkpoint.dir (a temporary one only where it is unset and all runs in one process)."""
    _shared(df.sparkSession)
    return df.checkpoint()


def new_folder(spark) -> str:
    """A new path in the same place, for tables that are read in parts."""
    return f"{_shared(spark)}/{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """df computed once, as Parquet in the same place: for large tables, which `kept` would write uncompressed."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(df: DataFrame, size: int, *order: str) -> list[DataFrame]:
    """df in its order as tables of `size` rows, written once; each is read by itself."""
    rows = kept(df.orderBy(*order))
    part = F.spark_partition_id()
    counts = {r[0]: r[1] for r in rows.groupBy(part.alias("part")).count().collect()}
    before, n = [], 0
    for p in sorted(counts):
        before += [F.lit(p), F.lit(n)]
        n += counts[p]
    if not n:
        return []
    place = F.create_map(*before)[part] + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    path = new_folder(df.sparkSession)
    rows.withColumn("__slice", F.floor(place / size)).write.partitionBy("__slice").parquet(path)
    return [df.sparkSession.read.schema(df.schema).parquet(f"{path}/__slice={i}") for i in range(-(-n // size))]


def dealt(df: DataFrame, most: int = 4096) -> DataFrame:
    """df dealt over all cores, for steps whose cost lies in the rows: a small file of many rows would be one task. A task has at most about `most` rows."""
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(min(-(-n // 256), 4 * cores), -(-n // most), 1))

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local master gets a folder of its own, as in tests; a cluster's executors would each
    write to their own disk, so there it raises."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: What this process has written and not removed yet.
_written: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: a short lineage that survives lost executors."""
    spark = df.sparkSession
    _written.append(path := f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes what this process has written to the shared folder. Frames that were returned before can't be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        folder = jvm.org.apache.hadoop.fs.Path(_written.pop())
        folder.getFileSystem(conf).delete(folder, True)


def done_before(spark: SparkSession, folder: str, key: str) -> bool:
    """Whether a stage's result is there for this key: Spark marks what was written whole."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{key}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def content_key(*parts: object) -> str:
    """Twenty digits for a stage's name, version and settings."""
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:20]


def by_key(df: DataFrame, *keys: str) -> GroupedData:
    """df grouped by keys for a function of whole groups, dealt over as many partitions as the session shuffles into. Partitions whose
    number was asked for aren't merged by size afterwards: a group of few bytes can be much work."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).groupBy(*keys)


#: Pairs of rows that a task of in_blocks looks at.
PAIRS = 1 << 21


def in_blocks(left: DataFrame, right: DataFrame, key: str, item: str, run: Callable, schema: str, most: int = PAIRS, cost: Column | None = None) -> DataFrame:
    """run(key, left rows, right rows) over all rows of both that share a key, the left ones dealt by item into as many parts as keep a
    part at about `most` pairs, or at `most` of another cost of a key's _n left and _m right rows; every part meets all right rows of
    its key. Null keys of the left meet none."""
    sizes = left.groupBy(key).agg(F.count("*").alias("_n")).join(right.groupBy(key).agg(F.count("*").alias("_m")), key)
    parts = sizes.select(key, F.greatest(F.lit(1), F.ceil((F.col("_n") * F.col("_m") if cost is None else cost) / most)).cast("int").alias("_parts"))
    dealt = left.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(item), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    every = right.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts").withColumnRenamed(key, "_key")
    return by_key(dealt, key, "_part").cogroup(by_key(every, "_key", "_part")).applyInPandas(run, schema)

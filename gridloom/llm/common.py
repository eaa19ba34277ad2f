"""What the corpus operators share: the shared folder, written intermediate tables, word splitting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of UTF-8 text to words: A-Z become a-z, other ASCII that is neither letter nor digit becomes a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master gets a folder of
    its own, as in tests; on a cluster that would scatter the rows over the executors' disks, so it raises there."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: What this process has written to the shared folder and not removed yet.
_written: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; release() removes it."""
    _written.append(path := f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return path


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Removes what was written to the shared folder after the first `since` paths (see marked), but for `keep`. Frames that
    operators returned before can't be read any more, so call it once their rows are written or no longer needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _written[since:] if p != keep]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        _written.remove(path)


def marked() -> int:
    """How many paths are written by now."""
    return len(_written)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later failures recompute from there."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of text in a batch for a Python worker, in place of Spark's defaults: both sides hold some batches at once.
BATCH = {"maxRecordsPerBatch": ("10000", "1000"), "maxBytesPerBatch": ("67108864", "8m")}


#: Settings of the Python workers' allocators: what a batch has used goes back to the system and isn't kept for later ones.
FREED = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> None:
    """Python workers on this machine find the package where the driver found it; clusters ship it with --py-files. Batches
    are made small unless the session has chosen a size, and workers keep no freed memory."""
    for name, value in FREED.items():
        spark.sparkContext.environment.setdefault(name, value)
    for name, (default, small) in BATCH.items():
        if spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", small)
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; whatever Spark can read, local or remote."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that a worker keeps between batches, of one operator at a time.
_kept: dict[str, object] = {}


def kept(kind: str, key: str, make: Callable[[], T]) -> T:
    """The worker's table of this kind and key, made at first use. A worker serves several operators in turn; the tables of
    another kind give way, so that their memory doesn't add up."""
    name = f"{kind}:{key}"
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def replaced(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add (names compare without case, as Spark's do)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])

"""Session helpers shared by the whole library: shared scratch folders and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only while its measured rows stay under this many bytes.
BROADCAST_BYTES = 48 * 1024 * 1024
#: Row groups of intermediate tables: a writing task holds one in memory.
ROW_GROUP_BYTES = 32 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or a new local one where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stridemap-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_ROOTS: set[str] = set()
_THREAD = threading.local()


def _made() -> list[str]:
    """Paths of this thread's intermediate tables: streams run their batches in threads of their own."""
    if not hasattr(_THREAD, "made"):
        _THREAD.made = []
    return _THREAD.made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends, or by ``clear_scratch``."""
    root = f"{shared_dir(spark)}/stridemap/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(clear_scratch, spark)
    _made().append(f"{root}/{name}-{uuid.uuid4().hex[:12]}")
    return _made()[-1]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all in it, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Whether ``source`` was renamed, in one step; not if ``target`` exists."""
    fs = spark._jvm.org.apache.hadoop.fs
    old, new = fs.Path(source), fs.Path(target)
    context = fs.FileContext.getFileContext(old.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    strict = spark._jvm.java.lang.reflect.Array.newInstance(fs.Options.Rename.NONE.getClass(), 0)
    try:
        context.rename(old, new, strict)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them must have been written before."""
    with contextlib.suppress(Exception):  # at the end of a driver the session may be gone
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stridemap/{spark.sparkContext.applicationId}")
        root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


@contextlib.contextmanager
def written_once(spark: SparkSession) -> Iterator[None]:
    """Delete, at its end, the intermediate tables that this thread makes inside; what is needed of them must have been written by then, to an older path."""
    made = _made()
    first = len(made)
    yield
    mine, made[first:] = made[first:], []
    for path in mine:
        delete_path(spark, path)


def materialize(df: DataFrame, name: str, few: bool = False, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    With ``few`` the rows of a shuffle go into a few files for each core of the cluster instead of one for each shuffle partition.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    if few:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Columns that tell the rows of a table apart: its file (hashed) and the place in it.
KEY = ["row_file", "row_at"]


def keyed(df: DataFrame, *columns: Column | str, scan: bool = False) -> DataFrame:
    """``columns`` of ``df`` with KEY, by which the same row is found again when the table is read again.

    With ``scan`` the rows of ``df`` are promised to be those of its files, one each (a table just read), and Parquet's own row numbers
    are used: nothing is written. Otherwise, or if the source has no row numbers, the columns are written once with a number. Files are told
    apart by 64 bits of a hash of their path: for a million files two of them clash with a chance of 3e-8.
    """
    if scan:
        try:
            meta = df.metadataColumn("_metadata")
            return df.select(*columns, F.xxhash64(meta["file_path"]).alias(KEY[0]), meta["row_index"].alias(KEY[1]))
        except AnalysisException:  # not read from Parquet files
            pass
    numbered = df.select(*columns).withColumn(KEY[1], F.monotonically_increasing_id())
    return materialize(numbered, "numbered").withColumn(KEY[0], F.lit(0).cast("long"))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark must not broadcast by its own estimate, which is taken from compressed files before rows are exploded or aggregated."""
    return df.hint("merge")


def small_side(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows times ``row_bytes`` stay under ``limit`` (BROADCAST_BYTES), else as it is.

    ``df`` should be materialised: it is counted once and read again by the join.
    """
    return F.broadcast(df) if df.count() * row_bytes <= (BROADCAST_BYTES if limit is None else limit) else df


#: A key is hot if it has more than one in so many of all rows, so there are no more hot keys than that.
HOT_KEYS = 100_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, row_bytes: Column) -> DataFrame:
    """``rows`` left-joined with ``groups``, which has one row a ``key`` with its number of ``rows`` as ``size`` and takes ``row_bytes`` each.

    Small groups are broadcast after their bytes were summed. Otherwise the hot keys among them are, which are few, and the other rows are shuffled: no
    key's rows meet in one task. ``groups`` should be materialised.
    """
    measured = lambda g: g.agg(F.sum(row_bytes)).first()[0] or 0
    if measured(groups) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), key, "left")
    hot = F.col(size) * HOT_KEYS > rows.count()
    few = groups.where(hot)
    if measured(few) > BROADCAST_BYTES:
        return rows.join(groups, key, "left")
    marked = rows.join(F.broadcast(few.select(key, F.lit(True).alias("is_hot"))), key, "left")
    parts = (marked.where("is_hot").drop("is_hot").join(F.broadcast(few), key, "left"), marked.where("is_hot is null").drop("is_hot").join(groups.where(~hot), key, "left"))
    return parts[0].unionByName(parts[1])


#: Most bytes of an Arrow batch between the JVM and a Python worker; both hold a few of them at a time. Most rows that a scan holds at once.
ARROW_BYTES, SCAN_ROWS = 8 << 20, 1024
_SETTING, _SCAN = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


def bounded(df: DataFrame) -> DataFrame:
    """``df`` itself, after its session's batches are limited to ARROW_BYTES and SCAN_ROWS (less if they were): texts are long rows."""
    conf = df.sparkSession.conf
    now = conf.get(_SETTING, "64m").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    size = int(now.rstrip("kmg") or 0) * unit
    if size <= 0 or size > ARROW_BYTES:
        conf.set(_SETTING, str(ARROW_BYTES))
    if int(conf.get(_SCAN, "4096")) > SCAN_ROWS:
        conf.set(_SCAN, str(SCAN_ROWS))
    return df


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library, wherever the session was started from."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])

"""What the operators of this subpackage share: the shared folder, written tables, folds and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes, that are turned into Python objects at a time; they bound what one Arrow batch of long texts holds twice.
SLICE, SLICE_BYTES = 128, 1 << 20
#: Entries of a word cache, and the characters of the longest word that is kept: about 20 MB for each cache.
CACHE_WORDS, LONGEST_WORD = 100_000, 64
#: Folders of intermediate tables made by this process.
MADE: list[str] = []
#: What empties a worker's caches, and the stage that they were filled by.
CACHES: list[Callable[[], object]] = []
_filled_by: int | None = None


class Kept(dict):
    """word -> what ``make`` returns, for at most ``most`` words; long words are made anew each time.

    Words are kept in two generations: when the newer one has half of all it becomes the older one, whose words go unless
    they are asked for again. So words that occur once don't drive out frequent ones.
    """

    def __init__(self, make: Callable, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str):
        out = self.older.pop(key, None)
        if out is None:
            out = self.make(key)
        if len(key) <= LONGEST_WORD:
            if 2 * len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


def between_stages() -> None:
    """Python workers outlive a stage; what they kept for another one is given back to the system."""
    global _filled_by
    task = TaskContext.get()
    if task is None or task.stageId() == _filled_by:
        return
    if _filled_by is not None:
        for empty in CACHES:
            empty()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)
    _filled_by = task.stageId()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing on one machine (tests) a temporary folder is made and set for the session; on a cluster
    that is an error, as each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="prismark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    MADE.append(path := f"{base.rstrip('/')}/prismark-{uuid.uuid4().hex}")
    return path


def clean(spark: SparkSession, keep: int = 0) -> None:
    """Deletes the folders that this process has made, but for the first ``keep``, when no frame reads them any more."""
    while len(MADE) > keep:
        remove(spark, MADE.pop())


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Cuts the lineage: ``df`` as a Parquet table in the shared folder, read again.

    A lost executor costs at most the tasks that were running: every later stage starts from the files.
    """
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written.

    It does so when the driver collects its garbage, which by itself may come long after executors' disks are full.
    """
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this run through Hadoop's file system, wherever it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, whatever characters a name has."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as no column of the frame has; Spark's names don't tell cases apart."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def with_columns(df: DataFrame, run: Callable, added: list[T.StructField]) -> DataFrame:
    """``df`` and the columns that ``run`` adds to its Arrow batches, whose own columns come first.

    On the way columns have numbers for names: Spark's ``mapInArrow`` takes none with dots, and none twice.
    """
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    kinds = [T.StructField(f"a{k}", f.dataType) for k, f in enumerate(added)]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names)

    names = [*plain.columns, *(f.name for f in kinds)]
    return plain.mapInArrow(numbered, T.StructType([*plain.schema.fields, *kinds])).toDF(*df.columns, *(f.name for f in added))


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo ``n``; a null id is in fold 0."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and ``most`` bytes, or of one row."""
    between_stages()
    for b in batches:
        for i in range(0, b.num_rows, rows):
            todo = [b.slice(i, rows)]
            while todo:
                part = todo.pop()
                if part.num_rows > 1 and part.nbytes > most:
                    half = part.num_rows // 2
                    todo += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


def texts(column: pa.Array) -> list[str]:
    """A string column as Python strings, null as empty."""
    return [t or "" for t in column.to_pylist()]

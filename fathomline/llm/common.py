"""Helpers shared by the corpus operators: reading, durable intermediate tables, worker import path."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the normalising contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch where the session has Spark's defaults: whole texts are long rows, and a batch lies in
#: memory outside the heap. Workers that gain by larger batches join them (see joined).
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local session import this package, whatever the working directory, and bounds their batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def joined(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def lean(apply):
    """A mapInArrow function that gives its free memory back to the system when it ends, as workers live on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from apply(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master, a temporary one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.getCheckpointDir() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that driver and executors share")
        at = spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


#: Paths that this process has made in shared folders and not deleted yet.
MADE: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def swept(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes what was made since MADE had that length, but for the table to keep: call it when no result is still to be read."""
    kept = {os.path.dirname(x) for x in keep.inputFiles()} if keep is not None else set()
    for path in MADE[since:]:
        if not any(x.endswith(os.path.basename(path)) for x in kept):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            MADE.remove(path)


#: Tasks for each core that a table is dealt to, and bytes of its sources for each task where that makes more. Fewer tasks
#: than partitions write a stored table if these are small, as they would make as many small files.
TASKS_A_CORE, PART_BYTES = 4, 128 << 20


def parts(df: DataFrame) -> int:
    """Tasks for a table: by the size of the files that it is made from; sources of unknown size (Spark then says exabytes) count as small."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, sum(x for x in sizes if not x >> 50) // PART_BYTES)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: lineage is cut and lost executors lose nothing.

    rows: how many there may be, if that is known; a task writes 100,000 or more.
    """
    path = fresh(df.sparkSession, name)
    df.coalesce(parts(df) if rows is None else min(parts(df), 1 + rows // 100_000)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for file in {os.path.dirname(x) for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, only doc_id and text unless told otherwise."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def whole(text: str = "text") -> F.Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


#: Tables up to these bytes are broadcast.
FEW_BYTES = 32 << 20
#: A key is heavy with this share of all rows, so there are at most as many.
HEAVY_SHARE = 1024


def sized(df: DataFrame) -> int:
    """Bytes of a stored table's rows, about: what is in its columns and 32 more a row."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    fixed = 32 + 8 * len(df.columns)
    return df.agg(F.sum(sum(wide, F.lit(fixed)))).first()[0] or 0


def few(df: DataFrame, size: int | None = None) -> DataFrame:
    """df, broadcast if it is small (size: its bytes, measured if not given)."""
    return F.broadcast(df) if (sized(df) if size is None else size) <= FEW_BYTES else df


def split_join(rows: DataFrame, counted: DataFrame, keys: list[str], times: str, total: int | None = None) -> DataFrame:
    """rows joined with counted by keys; counted has each key once and in ``times`` how many of the rows have it.

    Keys with a share of 1 / HEAVY_SHARE of all rows or more, HEAVY_SHARE at most, are broadcast, the others shuffled.
    """
    total = (counted.agg(F.sum(times)).first()[0] or 0) if total is None else total
    least = max(2, -(-total // HEAVY_SHARE))
    heavy = F.broadcast(counted.filter(F.col(times) >= least))
    rest = rows.join(heavy.select(*keys), keys, "left_anti")
    return rows.join(heavy, keys).unionByName(rest.join(counted.filter(F.col(times) < least), keys))


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, F.Column]) -> DataFrame:
    """The rows of docs, all columns, whose keys (name in dropped: expression over docs; null equals null) aren't in dropped."""
    mark = "gone " + uuid.uuid4().hex  # no column of docs has such a name
    gone = few(stored(dropped.select(*[F.col(k).alias(f"{mark} {k}") for k in keys]).distinct(), "gone"))
    same = [x.eqNullSafe(F.col(f"`{mark} {k}`")) for k, x in keys.items()]
    condition = same[0]
    for x in same[1:]:
        condition = condition & x
    return docs.join(gone, condition, "left_anti")


def digest128(text: F.Column) -> F.Column:
    """The first 128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))

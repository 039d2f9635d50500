"""What the operators share: folds, stage tables in the shared folder, distributed prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only if it has at most so many (narrow) rows.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's decimal text modulo folds; a null id counts as the empty text (fold 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def hash63(key: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 1)


def threshold(part: int, whole: int) -> int:
    """The 63-bit hashes below it are part / whole of all."""
    return min((1 << 63) - 1, (part << 63) // max(whole, 1))


def hashed_below(key: Column | str, part: int, whole: int) -> Column:
    """Whether a row is among about `part` of `whole` rows chosen by the hash of a key, at any size."""
    return hash63(key) < F.lit(threshold(part, whole))


def one_label(labels: DataFrame, label: str, folds: int, held: int, worst: int) -> DataFrame:
    """(__id, y) of rows outside the held fold, one row per id; if its labels differ, y is `worst`."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("__id").isNotNull())
    y = F.max("y") if worst else F.min("y")
    return known.where(fold("__id", folds) != held).groupBy("__id").agg(y.alias("y"))


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session hands Python at most 1,000 rows at a time, unless a number was chosen."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, "1000")
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local test a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandwork-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def stored_so_far() -> int:
    return len(_made)


def drop_stored(spark: SparkSession, since: int, keep: Sequence[str] = ()) -> None:
    """Deletes what was stored since then, when nothing lazy reads it any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _made[since:] if p not in keep]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        _made.remove(path)


@atexit.register
def _sweep() -> None:
    """What this driver stored goes when it ends, if its session still runs."""
    spark = SparkSession.getActiveSession()
    if _made and spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the store may be gone already
            drop_stored(spark, 0)


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows (counted), else df as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slices(df: DataFrame, key: str, rows: int, per_slice: int = 4096) -> tuple[DataFrame, list[str]]:
    """df with columns slice_2, slice_4, ... of ever longer beginnings of a hexadecimal key, and their names.

    The last holds about per_slice rows at most for an even key; a slice has 256 at the next level, whatever the number of rows.
    """
    names = []
    digits = 2
    while True:
        names.append(f"slice_{digits}")
        df = df.withColumn(names[-1], F.substring(key, 1, digits))
        if rows >> (4 * digits) <= per_slice:
            return df, names
        digits += 2


def prefix_sums(df: DataFrame, levels: Sequence[Sequence[str]], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over all rows of the first level's group that come before the row.

    levels names ever longer key lists: the first is the group itself, the last a
    bucket that holds few rows.  Rows are ordered by the keys beyond the first
    list, then by order within the bucket.  Each level's sums are windowed within
    its parent only, so no task gets the whole of a large group.
    Keys must not be null.  The value column must be integral, so sums don't depend on their order.
    """
    finest = list(levels[-1])
    inner = Window.partitionBy(*finest).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn(out, F.sum(value).over(inner) - F.col(value))
    sums = df.groupBy(*finest).agg(F.sum(value).alias("__v"))
    before = None
    for upper, lower in zip(levels[:-1], levels[1:], strict=True):
        extra = [c for c in lower if c not in upper]
        w = Window.partitionBy(*upper).orderBy(*extra).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        level = sums.groupBy(*lower).agg(F.sum("__v").alias("__s")).withColumn("__b", F.sum("__s").over(w) - F.col("__s")).drop("__s")
        before = level if before is None else level.join(before.withColumnRenamed("__b", "__a"), list(upper)).withColumn("__b", F.col("__a") + F.col("__b")).drop("__a")
    return df.join(before, finest).withColumn(out, F.col(out) + F.col("__b")).drop("__b")

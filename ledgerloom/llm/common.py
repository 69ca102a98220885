"""Helpers shared by the corpus operators: shared work tables, running totals, Arrow maps.

Nothing here collects rows that grow with the input; what reaches the driver is one row per
partition (``running_totals``) or one row per learned label.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shipping import ship_package
from ..sources.tables import read_table

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the vectorised operators work on at once.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, by Spark's own readers, spread over all cores."""
    return read_table(spark, sf_dir, name)


def work_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    A session without that setting gets a local temporary folder if it is a local one (tests, a
    laptop); on a cluster, where a local folder is not shared, that is an error. The folder goes when
    the JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "ledgerloom-work")
    path = f"{base.rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared work folder and return a reader of what was written.

    Cuts lineage and fixes anything that a second evaluation could order differently; the files
    outlive any executor.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(
    df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow``; Spark's own limit of bytes (64 MB unless set) bounds a batch of long texts."""
    ship_package(df.sparkSession)
    return df.mapInArrow(f, schema)


def crc_of_id(c: Column | str) -> Column:
    """crc32 of a document id written as decimal text."""
    return F.crc32((F.col(c) if isinstance(c, str) else c).cast("string").cast("binary"))


def n_words(text: Column | str) -> Column:
    """Number of words of a text, null counting as empty."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def running_totals(df: DataFrame, order: list[Column], values: list[str], name: str = "running") -> DataFrame:
    """``df`` plus ``<value>_before``: the sum of each value over all rows earlier in ``order``.

    Range-partitions on the whole sort key, so a hot leading key is spread over many tasks; each
    task sums its own sorted run, and only one total per partition reaches the driver. Null values
    count as 0; rows equal in ``order`` come in any order. An empty table gives an empty table.
    """
    spark = df.sparkSession
    ship_package(spark)
    out = T.StructType(
        [*df.schema.fields, *[T.StructField(f"{v}_before", T.LongType()) for v in values], T.StructField("__pid", T.IntegerType())]
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        total = [0] * len(values)
        for b in batches:
            cols = list(b.columns)
            for k, v in enumerate(values):
                x = b.column(b.schema.get_field_index(v)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                run = np.cumsum(x)
                cols.append(pa.array(run - x + total[k]))
                total[k] += int(run[-1]) if len(run) else 0
            cols.append(pa.array(np.full(b.num_rows, pid, np.int32)))
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *[f"{v}_before" for v in values], "__pid"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(sums, out), name)
    totals = done.groupBy("__pid").agg(*[F.sum(v).alias(v) for v in values]).collect()
    offsets: list[dict[int, int]] = []
    for v in values:
        at, so_far = {}, 0
        for r in sorted(totals, key=lambda r: r["__pid"]):
            at[r["__pid"]] = so_far
            so_far += r[v] or 0
        offsets.append(at)
    if not totals:
        return done.drop("__pid")
    lookup = spark.createDataFrame(
        [(p, *[o[p] for o in offsets]) for p in offsets[0]], "__pid int, " + ", ".join(f"`__off_{v}` long" for v in values)
    )
    return done.join(F.broadcast(lookup), "__pid").select(
        *df.columns, *[(F.col(f"{v}_before") + F.col(f"__off_{v}")).alias(f"{v}_before") for v in values]
    )


def text_chunks(offsets, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (a longer text is a range of its own)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = lo + 1
        while hi < n and offsets[hi + 1] - offsets[lo] <= limit:
            hi += 1
        yield lo, hi
        lo = hi


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer while ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

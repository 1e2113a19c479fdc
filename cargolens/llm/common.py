"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Tables that :func:`written` made, by application.
_WRITTEN: dict[str, set[str]] = {}


#: Rows and bytes of text that a Python worker gets at once: texts are long, and a worker's memory is small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless they are smaller already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: What a worker process keeps between tasks: one thing at a time.
_KEPT: dict[str, object] = {}


def kept(name: str, make):
    """What ``make`` gives, kept in this process for tasks that ask for the same name; what another name kept is let go first,
    so that a worker which serves one stage after the other holds one stage's cache or model."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session (as in tests) may leave it unset: a temporary folder of this process is
    made and set as the session's checkpoint directory. On a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="cargolens-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again, so its lineage ends there and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` made and that no plan reads any more."""
    spark = df.sparkSession
    known = _WRITTEN.get(spark.sparkContext.applicationId, set())
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for path in [p for p in known if p.rsplit("/", 1)[-1] in names]:
        _delete(spark, path)
        known.discard(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this session's operators wrote; call it once their results are stored elsewhere."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, set()):
        _delete(spark, path)


#: Bits of a key filter: 16 for each key, 32 MB at most. A full filter only lets more rows through.
KEY_BITS, MOST_BITS = 16, 1 << 28


def key_bitmap(keys: DataFrame, most_bits: int = MOST_BITS):
    """A broadcast bitmap of the column ``_k`` (long), as a function of an array of such keys, for tasks."""
    bits = min(1 << max(KEY_BITS * keys.count(), 1 << 16).bit_length(), most_bits)
    at = f"(_k & {bits - 1}L)"
    words = keys.groupBy(F.expr(f"shiftright({at}, 6)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, int({at} & 63L)))").alias("b")).toArrow()
    bitmap = np.zeros(bits >> 6, np.int64)
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    def may_match(k: np.ndarray) -> np.ndarray:
        k = k & np.int64(bits - 1)
        return (shared.value[k >> 6] >> (k & 63)) & 1 == 1

    return may_match


def key_filter(keys: DataFrame):
    """The same as a function of a column: true for each of the keys and for few others. It spares rows
    that can't match the shuffle of a join."""
    test = key_bitmap(keys)

    @F.pandas_udf("boolean")
    def may_match(k: pd.Series) -> pd.Series:
        return pd.Series(test(k.to_numpy(np.int64)))

    return may_match


def file_system(uri: str):
    """pyarrow's file system for a URI or path of the shared folder, with the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def numbered(df: DataFrame, tree: str, order: list, name: str = "numbered") -> DataFrame:
    """``df`` with ``pos``, the place of a row among those of its ``tree`` (a column without nulls) in ``order`` from 0, and ``n``, how
    many they are. Rows are dealt out by range, so a tree of any size is many tasks; what is ordered by a window are the
    parts of a tree in the ranges, one for each range and tree."""
    from pyspark.sql import Window

    by = [F.col(tree).asc(), *order]
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(tree)
    parts = parts.select(tree, "_part", (F.sum("_size").over(whole.orderBy("_part")) - F.col("_size") - F.col("_first")).alias("_shift"), F.sum("_size").over(whole).alias("n"))
    return rows.join(parts, [tree, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")

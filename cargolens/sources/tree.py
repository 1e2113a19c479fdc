"""Artifact trees as a table: a Python data source that lists folders in tasks, and tasks that read what is asked.

Spark's ``binaryFile`` leaves out files whose names start with a dot or an underscore; an audit must
see them, so listing is done here: by rounds of folders, or root by root in order where the files of
a root are bounded. Roots are folders or single files that every executor can open. A
listing is a narrow table of paths, which is dealt out anew; each file's head is read where its row
lies, and what parsers need beyond it they read by ranges from ``uri``, the file's path as bytes."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.blob import Blob
from ..functions.content import base_name, suffix
from ..model import fixed

LISTING = "target_id string, path string, is_repo boolean, size long, uri binary"
SCHEMA = f"{LISTING}, content binary, error string"
#: Bytes of a file that an audit keeps in its row: enough to tell formats by.
HEAD_BYTES = 64 << 10


def walk(root: str, limit: int | None = None) -> Iterator[tuple[str, str, bool, int]]:
    """(absolute path, path below the root, whether the root is a folder, size) in order of path, without .git folders."""
    if os.path.isfile(root):
        yield root, os.path.basename(root), False, os.path.getsize(root)
        return
    n = 0
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f != ".git")
        for name in sorted(names):
            full = os.path.join(folder, name)
            if limit is not None and n >= limit:
                return
            n += 1
            try:
                yield full, os.path.relpath(full, root), True, os.path.getsize(full)
            except OSError:
                yield full, os.path.relpath(full, root), True, 0


def _shown(path: str) -> str:
    """A path as text: bytes that aren't UTF-8 are escaped."""
    return os.fsencode(path).decode("utf-8", "backslashreplace")


class _Roots(InputPartition):
    def __init__(self, roots: list[str]):
        self.roots = roots


class ArtifactTree(DataSource):
    """A row for each file below the roots. Options: roots (newline-separated), maxFiles (of each root)."""

    @classmethod
    def name(cls) -> str:
        return "artifact_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", "").split("\n") if r]
        self.files = int(options["maxFiles"]) if options.get("maxFiles") else None

    def partitions(self) -> list[InputPartition]:
        """A task walks a root, or some where there are very many."""
        step = max(1, len(self.roots) // 10_000)
        return [_Roots(self.roots[i : i + step]) for i in range(0, len(self.roots), step)] or [_Roots([])]

    def read(self, partition: _Roots) -> Iterator[pa.RecordBatch]:
        names, kinds = ["target_id", "path", "is_repo", "size", "uri"], [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows = []
        for root in partition.roots:
            for full, path, is_repo, size in walk(root, self.files):
                rows.append((_shown(root), _shown(path), is_repo, size, os.fsencode(full)))
                if len(rows) == 1000:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


#: Entries that a task lists before it hands the folders that are left to others, and folders that a task starts with.
SHARE, FOLDERS = 2000, 4


def _entries(root: bytes, start: bytes, share: int) -> Iterator[tuple]:
    """Files below a folder, and what is left of its folders once ``share`` entries were seen: (root, path, size or None of a folder)."""
    left, seen = [start], 0
    while left:
        folder = left.pop()
        if seen >= share and folder != start:
            yield root, folder, None
            continue
        try:
            with os.scandir(folder) as found:
                for e in found:
                    seen += 1
                    if e.is_dir():
                        if e.name != b".git" and not e.is_symlink():
                            left.append(e.path)
                    else:
                        try:
                            yield root, e.path, os.path.getsize(e.path)
                        except OSError:
                            yield root, e.path, 0
        except OSError:
            continue


def listing(spark: SparkSession, roots: list[str], share: int = SHARE) -> DataFrame:
    """A row for each file below the roots, as the data source gives them, listed in rounds: folders that a task leaves
    are rows that the next round deals out, so one root of any size and shape is listed by many tasks. What a round
    found is kept until the listing is read; rounds grow with the depth of what is left."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["root", "uri", "size", "is_repo"]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_())], names=names)

        for b in batches:
            for root, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if os.path.isfile(folder):
                    rows.append((root, folder, os.path.getsize(folder), False))
                    continue
                for r in _entries(root, folder, share):
                    rows.append((*r, True))
                    if len(rows) >= 1000:
                        yield batch()
                        rows = []
        if rows:
            yield batch()

    def described_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots, uris = b.column(0).to_pylist(), b.column(1).to_pylist()
            shown = [_shown(os.fsdecode(r)) for r in roots]
            paths = [_shown(os.fsdecode(os.path.relpath(u, r) if k else os.path.basename(u))) for r, u, k in zip(roots, uris, b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shown), pa.array(paths), b.column(3), b.column(2), b.column(1)], names=["target_id", "path", "is_repo", "size", "uri"])

    front = spark.createDataFrame(pa.table({"root": pa.array([os.fsencode(r) for r in roots], pa.binary()), "uri": pa.array([os.fsencode(r) for r in roots], pa.binary())}))
    n, files = len(roots), None
    while n:
        found = front.repartition(max(1, min(-(-n // FOLDERS), 10_000))).mapInArrow(expand, "root binary, uri binary, size long, is_repo boolean").persist(StorageLevel.MEMORY_AND_DISK)
        some = found.where("size is not null")
        files = some if files is None else files.unionByName(some)
        front = found.where("size is null").select("root", "uri")
        n = front.count()
    if files is None:
        return spark.createDataFrame([], LISTING)
    return files.mapInArrow(described_paths, LISTING)


def artifacts(spark: SparkSession, roots: list[str], max_file_mb: int = 4096, max_files: int | None = None, head_bytes: int = 0) -> DataFrame:
    """Artifact rows of local roots; content is a file's first ``head_bytes``, or all of it for 0. ``max_files``
    bounds the files taken from each root, as a feature; by default all are."""
    if max_files is None:
        listed = listing(spark, roots)
    else:
        spark.dataSource.register(ArtifactTree)
        listed = spark.read.format("artifact_tree").option("roots", "\n".join(roots)).option("maxFiles", max_files).load()
    most = max_file_mb << 20

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                content = error = None
                size = b.column(3)[i].as_py()
                if size > most:
                    error = f"{size} bytes: skipped"
                else:
                    try:
                        with open(b.column(4)[i].as_py(), "rb") as f:
                            content = f.read(head_bytes or -1)
                    except OSError as e:
                        error = _shown(str(e))
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*row.schema.names, "content", "error"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # where rows lie doesn't matter, so they are dealt out by name: a root with many files is many tasks
    return described(listed.repartition(tasks, "uri").mapInArrow(read, SCHEMA))


def described(rows: DataFrame) -> DataFrame:
    """Rows with target_id, path and content as artifact rows: with name, ext, and defaults for is_repo, size, error."""
    for column, value in (("is_repo", F.lit(True)), ("size", F.length("content").cast("long")), ("error", F.lit(None).cast("string")), ("uri", F.lit(None).cast("binary"))):
        if column not in rows.columns:
            rows = rows.withColumn(column, value)
    name = base_name(F.col("path"))
    return fixed(rows, name=name, ext=suffix(name))


#: Files from this size on aren't hashed.
HASHED = 512 << 20


def _sha256(content: pd.Series, uri: pd.Series, size: pd.Series) -> pd.Series:
    def one(c: bytes | None, u: bytes | None, n: float) -> str | None:
        if c is None:
            return None
        sha = hashlib.sha256()
        try:
            with Blob(bytes(c), None if u is None else bytes(u), int(n)).open() as f:
                while piece := f.read(1 << 20):
                    sha.update(piece)
        except OSError:
            return None
        return sha.hexdigest()

    return pd.Series([one(*x) for x in zip(content, uri, size, strict=True)], dtype=object)


def sha256_of_file() -> Column:
    """SHA-256 of an artifact's bytes: native where the row has them all, else read from the file piece by piece."""
    whole = F.col("uri").isNull() | (F.length("content") >= F.col("size"))
    rest = F.pandas_udf(_sha256, "string")(F.when(~whole & (F.col("size") < HASHED), F.col("content")), F.col("uri"), F.col("size"))
    return F.when(F.col("size") >= HASHED, F.lit(None)).when(whole, F.sha2("content", 256)).otherwise(rest)

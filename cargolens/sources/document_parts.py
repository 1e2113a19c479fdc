"""A sink for documents in lines: a file a target, written by many tasks at once.

:func:`write_lines` sorts lines over the cluster and stores them, counts what each stored part holds of each target,
and so knows at which byte of its target's file every part begins. Tasks then write their bytes there, in a folder
beside the result; when all have, the files take their places. A task that is run again writes the same bytes again.
The folder must be one that all executors share and write to at any place (no object store)."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SCHEMA = "target_id string, section int, element boolean, start long, first array<int>, size long, text string, _part long, _at long"


def file_name(target: str, suffix: str) -> str:
    name = quote(target, safe="")
    return (name if len(name) <= 150 else f"{name[:100]}-{hashlib.sha256(target.encode()).hexdigest()[:32]}") + suffix


@dataclass
class _Written(D.WriterCommitMessage):
    #: File, bytes written, and the whole file's size.
    files: list[tuple[str, int, int]] = field(default_factory=list)


class DocumentParts(D.DataSource):
    """Options: path, suffix. Rows in order: a row with ``start`` opens a target's part, and its lines follow."""

    @classmethod
    def name(cls) -> str:
        return "document_parts"

    def schema(self) -> str:
        return _SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> D.DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("suffix", ""))


class _Writer(D.DataSourceWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix, self.open = path, suffix, os.path.join(path, "_open")

    def write(self, iterator: Iterator[Row]) -> _Written:
        done, out, started, name, whole = _Written(), None, 0, "", 0
        seen: set[int] = set()

        def close() -> None:
            if out is not None:
                done.files.append((name, out.tell() - started, whole))
                out.close()

        os.makedirs(self.open, exist_ok=True)
        for row in iterator:
            if row.start is not None:
                close()
                name, started, whole, seen = file_name(row.target_id, self.suffix), row.start, row["size"], set(row["first"])
                out = os.fdopen(os.open(os.path.join(self.open, name), os.O_CREAT | os.O_WRONLY, 0o644), "wb", 1 << 20)
                out.seek(started)
                continue
            if row.element and row.section not in seen:
                out.write(b",")
            seen.discard(row.section)
            out.write(row.text.encode() + b"\n")
        close()
        return done

    def commit(self, messages: list[_Written]) -> None:
        sizes: dict[str, list[int]] = {}
        for m in messages:
            for name, n, whole in m.files if m else ():
                sizes.setdefault(name, [0, whole])[0] += n
        if odd := [n for n, (got, whole) in sizes.items() if got != whole]:
            raise ValueError(f"parts of {odd[:3]} are missing")
        for name in sizes:
            os.replace(os.path.join(self.open, name), os.path.join(self.path, name))
        shutil.rmtree(self.open, ignore_errors=True)

    def abort(self, messages: list[_Written]) -> None:
        shutil.rmtree(self.open, ignore_errors=True)


def write_lines(lines: DataFrame, path: str, suffix: str = ".txt") -> None:
    """lines: ``operators.report_lines``. One file of ``path`` for each target."""
    spark = lines.sparkSession
    spark.dataSource.register(DocumentParts)
    order = [F.col("target_id").asc(), F.col("section").asc(), F.col("r").desc(), F.col("rule").desc(), F.col("place").desc(), F.col("detail").desc(), F.col("text").desc()]
    stored = os.path.join(path, "_lines")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("target_id", "section", "element", "text", F.monotonically_increasing_id().alias("_at")).write.mode("overwrite").parquet(stored)
    rows = spark.read.parquet(stored).withColumn("_part", F.shiftright("_at", 33))
    pieces = rows.groupBy("target_id", "_part", "section", "element").agg(F.sum(F.octet_length("text") + 1).alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("_at").alias("_at"))
    leads = F.row_number().over(Window.partitionBy("target_id", "section", "element").orderBy("_part")) == 1
    commas = F.when(F.col("element"), F.col("n") - F.when(leads, 1).otherwise(0)).otherwise(0)
    of_part = pieces.withColumn("bytes", F.col("bytes") + commas).withColumn("lead", F.when(leads & F.col("element"), F.col("section")))
    of_part = of_part.groupBy("target_id", "_part").agg(F.sum("bytes").alias("bytes"), F.collect_list("lead").alias("first"), F.min("_at").alias("_at"))
    whole = Window.partitionBy("target_id")
    opens = of_part.select("target_id", F.lit(None).cast("int").alias("section"), F.lit(None).cast("boolean").alias("element"), (F.sum("bytes").over(whole.orderBy("_part")) - F.col("bytes")).alias("start"), "first", F.sum("bytes").over(whole).alias("size"), F.lit(None).cast("string").alias("text"), "_part", "_at")
    body = rows.select("target_id", "section", "element", F.lit(None).cast("long").alias("start"), F.lit(None).cast("array<int>").alias("first"), F.lit(None).cast("long").alias("size"), "text", "_part", "_at")
    parts = max(1, len(spark.read.parquet(stored).inputFiles()))
    ready = opens.unionByName(body).repartition(parts, "_part").sortWithinPartitions("_part", "_at", F.col("start").asc_nulls_last())
    ready.write.format("document_parts").option("path", path).option("suffix", suffix).mode("append").save()
    shutil.rmtree(stored, ignore_errors=True)

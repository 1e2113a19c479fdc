"""Tensor containers and graphs: safetensors, npy, HDF5, ONNX, TensorFlow, GGUF."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import knowledge as K
from ..functions.blob import Blob
from ..model import emit, rule

TENSORS = "size long, header_size decimal(20,0), problem string, ord int, name string, dtype string, shape array<decimal(38,0)>, b decimal(38,0), e decimal(38,0), bad_offsets boolean, long_texts array<string>"
_BIG = 100 << 20


#: Bytes of a header that are parsed; the format itself ends at 100 MB, and a longer header has a rule of its own.
_PARSED = 512 << 20


def tensor_rows(blob: Blob) -> Iterator[dict]:
    """Rows of a safetensors file: one of the header (``ord`` null), one for each tensor with offsets. Only the header is read."""
    from decimal import Decimal

    if blob.size < 8:
        yield {"problem": "short"}
        return
    n = int.from_bytes(blob.read(0, 8), "little")
    head = {"header_size": Decimal(n)}
    if not 0 < n <= blob.size:
        yield head | {"problem": "length"}
        return
    if n > _PARSED:
        yield head
        raise ValueError(f"a header of {n} bytes isn't parsed")
    try:
        header = json.loads(blob.read(8, n))
    except Exception:
        yield head | {"problem": "json"}
        return
    if not isinstance(header, dict):
        yield head
        return
    meta = header.pop("__metadata__", None)
    texts = [f"{k}: {len(v)} chars" for k, v in meta.items() if isinstance(v, str) and len(v) > 4096] if isinstance(meta, dict) else []
    yield head | {"long_texts": texts}
    whole = lambda x: isinstance(x, int) and abs(x) < 10**37
    for i, (name, spec) in enumerate(header.items()):
        offsets = spec.get("data_offsets") if isinstance(spec, dict) else None
        if not isinstance(offsets, list) or len(offsets) != 2:
            continue
        b, e = offsets
        row = head | {"ord": i, "name": name, "bad_offsets": not (whole(b) and whole(e) and 0 <= b <= e)}
        if not row["bad_offsets"]:
            shape = spec.get("shape")
            row |= {"b": Decimal(b), "e": Decimal(e), "dtype": spec.get("dtype") if isinstance(spec.get("dtype"), str) else None}
            if isinstance(shape, list) and all(whole(x) for x in shape):
                row["shape"] = [Decimal(x) for x in shape]
        yield row


def overlaps(spans: DataFrame, key: list[str]) -> DataFrame:
    """spans: key columns, name, b, e. The first pair of neighbours in order of (b, e, name) that overlap, for each key."""
    order = Window.partitionBy(*key).orderBy("b", "e", "name")
    pairs = spans.withColumn("prev_name", F.lag("name").over(order)).withColumn("prev_e", F.lag("e").over(order)).withColumn("at", F.row_number().over(order)).where("b < prev_e")
    return pairs.groupBy(*key).agg(F.min_by(F.struct("prev_name", "name", "prev_e", "b"), "at").alias("x")).select(*key, "x.*")


def mismatch() -> Column:
    """Whether a tensor of a known dtype takes other bytes by its shape than its span has."""
    width = F.create_map(*[F.lit(x) for kv in K.DTYPE_BYTES.items() for x in kv])[F.col("dtype")]
    cells = F.aggregate("shape", F.lit(1.0), lambda a, x: a * x.cast("double"))
    exact = F.aggregate("shape", F.lit(1).cast("decimal(38,0)"), lambda a, x: F.try_multiply(a, x).cast("decimal(38,0)"))
    need = F.when(F.abs(cells) < 1e35, exact * width)
    return F.coalesce(width.isNotNull() & F.col("shape").isNotNull() & (need.isNull() | (need != F.col("e") - F.col("b"))), F.lit(False))


def safetensors_findings(rows: DataFrame) -> list[DataFrame]:
    """STF-000 to 008."""
    at = rows.withColumn("location", F.col("path"))
    spans = at.where("ord is not null and not bad_offsets")
    said = lambda *c: F.concat_ws(" ", "name", *[F.col(x).cast("string") for x in c])
    return [
        emit(
            at,
            rule("STF-000", "problem = 'short'", "MEDIUM", "integrity"),
            rule("STF-001", "problem = 'length'", "HIGH", "integrity"),
            rule("STF-002", F.col("ord").isNull() & (F.col("header_size") > _BIG) & (F.coalesce("problem", F.lit("")) != "length"), "MEDIUM", "integrity", "medium"),
            rule("STF-003", "problem = 'json'", "HIGH", "integrity"),
            rule("STF-004", "bad_offsets", "HIGH", "integrity", detail=F.col("name")),
            rule("STF-005", F.coalesce(~F.col("bad_offsets") & (F.col("header_size") + 8 + F.col("e") > F.col("size")), F.lit(False)), "HIGH", "integrity", detail=said("e")),
            rule("STF-007", "size(long_texts) > 0", "LOW", "metadata", "low", evidence=F.slice("long_texts", 1, 5)),
            rule("STF-008", mismatch() & ~F.col("bad_offsets"), "HIGH", "integrity", detail=said("b", "e")),
        ),
        emit(overlaps(spans, ["target_id", "location"]), rule("STF-006", F.lit(True), "MEDIUM", "integrity", "medium", F.concat_ws(" ", "prev_name", "name"))),
    ]


NPY = "n_bytes long, problem string, has_object boolean, evidence string"
_NPY_SHOWN = 200


def npy_row(blob: Blob) -> dict:
    """What the rules ask of a npy file or member: its whole header is searched, none of it is passed on but the evidence."""
    row: dict = {"n_bytes": blob.size}
    if blob.size > K.MEMBER_LIMIT:
        return row
    data = blob.read(0, 12)
    if len(data) < 10 or data[:6] != b"\x93NUMPY":
        return row | {"problem": "no header"}
    first = data[6] == 1
    start = 10 if first else 12
    if len(data) < start:
        return row | {"problem": "header ends early"}
    head = blob.read(start, int.from_bytes(data[8:start], "little"))
    found = b"|O" in head
    return row | {"has_object": found, "evidence": head.decode("latin-1").strip()[:_NPY_SHOWN] if found else None}


def npy_findings(streams: DataFrame) -> list[DataFrame]:
    """NPY-000 and NPY-001. streams: target_id, location and the facts of npy files and members."""
    return [
        emit(
            streams,
            rule("NPY-000", F.col("n_bytes") > K.MEMBER_LIMIT, "MEDIUM", "integrity", "medium", "beyond the read limit"),
            rule("NPY-000", "problem = 'no header'", "LOW", "integrity", "medium", "no header"),
            rule("NPY-000", "problem = 'header ends early'", "MEDIUM", "integrity", "medium", "header ends early"),
            rule("NPY-001", F.coalesce("has_object", F.lit(False)), "HIGH", "serialization", evidence=F.array("evidence")),
        )
    ]


GRAPH = "format string, has_lambda boolean, markers array<string>, ops array<string>, odd array<string>, version long"
_RUN = re.compile(rb"[\x20-\x7e]{4,}")


def graph_row(fmt: str, blob: Blob) -> dict:
    """What the rules of graph files ask for, from a bounded head."""
    out: dict = {"format": fmt}
    if fmt == "hdf5":
        head = blob.read(0, 4 << 20)
        out["has_lambda"] = b'"class_name": "Lambda"' in head or b'"class_name":"Lambda"' in head
        out["markers"] = [m for m in K.HDF5_MARKERS if m.encode() in head]
    elif fmt == "gguf":
        out["version"] = int.from_bytes(blob.read(4, 4), "little") if blob.size >= 8 else None
    else:
        runs = {r.decode() for r in _RUN.findall(blob.read(0, 8 << 20))}
        out["ops"] = sorted(runs & set(K.ONNX_OPS if fmt == "onnx" else K.TF_OPS))
        if fmt == "onnx" and "location" in runs:
            out["odd"] = sorted(r for r in runs if (".." in r or r.startswith("/")) and len(r) < 200)[:5]
    return out


def graph_findings(facts: DataFrame) -> list[DataFrame]:
    """H5, ONX, TF and GGUF rules. facts: rows of ``graph_row``."""
    fmt, ops, version = F.col("format"), F.col("ops"), F.concat(F.lit("version "), F.col("version").cast("string"))
    return [
        emit(
            facts,
            rule("H5-001", "has_lambda", "HIGH", "execution"),
            *[rule("H5-002", F.array_contains("markers", m), "MEDIUM", "execution", "low", m) for m in K.HDF5_MARKERS],
            rule("ONX-001", (fmt == "onnx") & (F.size(ops) > 0), "MEDIUM", "execution", "medium", evidence=F.slice(ops, 1, 8)),
            rule("ONX-002", "size(odd) > 0", "MEDIUM", "file_anomaly", "low", evidence=F.slice("odd", 1, 5)),
            rule("TF-001", (fmt == "tf-protobuf") & (F.size(ops) > 0), F.when(F.arrays_overlap(ops, F.array(F.lit("PyFunc"), F.lit("WriteFile"))), "HIGH").otherwise("MEDIUM"), "execution", "medium", evidence=ops),
            rule("GGUF-001", "version is not null", "INFO", "serialization", detail=version),
            rule("GGUF-002", "version > 3 or version < 1", "LOW", "integrity", "low", version),
        )
    ]

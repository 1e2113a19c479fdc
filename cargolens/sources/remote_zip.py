"""Members of ZIP files that are read by byte ranges: the end record, the directory, then single members."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import web
from .web import Fetch

#: The longest end record with its comment; fixed by the format.
TAIL_BYTES = 65_557
MEMBER_BYTES = 32 << 20
HEAD_BYTES = 2 << 20


@dataclass(frozen=True)
class Entry:
    name: str
    method: int
    comp_size: int
    size: int
    offset: int
    external_attr: int


def http_fetch(url: str, token: str | None = None, attempts: int = 3, timeout: int = 60) -> tuple[int, Fetch]:
    """Length of a remote file and a function that reads a range of it, with retries that honour Retry-After."""
    return web.ranges(url, token, attempts, timeout)


def entries(size: int, fetch: Fetch) -> list[Entry]:
    """The central directory, ZIP64 included."""
    start = max(0, size - TAIL_BYTES)
    tail = fetch(start, size - start)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end record")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFFFFFF in (length, offset) or count == 0xFFFF:
        locator = tail.rfind(b"PK\x06\x07", 0, at)
        if locator < 0:
            raise ValueError("no ZIP64 locator")
        record = fetch(struct.unpack_from("<Q", tail, locator + 8)[0], 56)
        length, offset = struct.unpack_from("<QQ", record, 40)
    directory = tail[offset - start : offset - start + length] if offset >= start else fetch(offset, length)
    out, p = [], 0
    while p + 46 <= len(directory) and directory[p : p + 4] == b"PK\x01\x02":
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        comp, full, n, extra, note = struct.unpack_from("<IIHHH", directory, p + 20)
        attr, place = struct.unpack_from("<II", directory, p + 38)
        name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        q, end = p + 46 + n, p + 46 + n + extra
        while q + 4 <= end:
            tag, wide = struct.unpack_from("<HH", directory, q)
            if tag == 1:
                values = iter(struct.unpack_from(f"<{wide // 8}Q", directory, q + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                comp = next(values) if comp == 0xFFFFFFFF else comp
                place = next(values) if place == 0xFFFFFFFF else place
            q += 4 + wide
        out.append(Entry(name, method, comp, full, place, attr))
        p = end + note
    return out


def member(entry: Entry, fetch: Fetch) -> bytes:
    if entry.comp_size > MEMBER_BYTES:
        raise ValueError("member beyond the read limit")
    n, extra = struct.unpack_from("<HH", fetch(entry.offset, 30), 26)
    return inflated(entry, fetch(entry.offset + 30 + n + extra, entry.comp_size) if entry.comp_size else b"")


def inflated(entry: Entry, data: bytes) -> bytes:
    """A member's content from its stored bytes."""
    if entry.method == 0:
        return data
    if entry.method != 8:
        raise ValueError(f"method {entry.method}")
    inflate = zlib.decompressobj(-15)
    out = inflate.decompress(data, MEMBER_BYTES)
    if inflate.unconsumed_tail or not inflate.eof:
        raise ValueError("member beyond the read limit, or cut short")
    return out


def pickle_members(size: int, fetch: Fetch, most: int = 3) -> list[tuple[str, bytes]]:
    """Up to ``most`` pickled members; of a file that is no ZIP its head, if it is a pickle stream. A member that can't be read whole is an error."""
    try:
        named = [e for e in entries(size, fetch) if e.name.endswith((".pkl", ".pickle"))]
    except (ValueError, struct.error):
        head = fetch(0, min(size, HEAD_BYTES))
        return [("", head)] if head[:1] == b"\x80" else []
    return [(e.name, member(e, fetch)) for e in sorted(named, key=lambda e: e.name)[:most]]


def remote_pickles(files: DataFrame, opener: Callable[[str], tuple[int, Fetch]] = http_fetch, most: int = 3) -> DataFrame:
    """files: target_id, path, url. (target_id, location, content, error): a file a row of a task, so ranges are read in parallel."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for target, path, url in zip(b.target_id, b.path, b.url, strict=True):
                try:
                    found = pickle_members(*opener(url), most)
                    rows += [(target, f"{path}!{name}" if name else path, data, None) for name, data in found]
                except Exception as e:
                    rows.append((target, path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["target_id", "location", "content", "error"])

    return files.select("target_id", "path", F.col("url")).mapInPandas(read, "target_id string, location string, content binary, error string")


#: Bytes of a remote document that are read whole.
DOCUMENT_BYTES = 16 << 20


def remote_documents(files: DataFrame, opener: Callable[[str], tuple[int, Fetch]] = http_fetch) -> DataFrame:
    """files: target_id, path, url. (target_id, location, content, error) of small files that are read whole."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for target, path, url in zip(b.target_id, b.path, b.url, strict=True):
                try:
                    size, fetch = opener(url)
                    if size > DOCUMENT_BYTES:
                        raise ValueError(f"{size} bytes aren't read whole")
                    rows.append((target, path, fetch(0, size) if size else b"", None))
                except Exception as e:
                    rows.append((target, path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["target_id", "location", "content", "error"])

    return files.select("target_id", "path", "url").mapInPandas(read, "target_id string, location string, content binary, error string")

"""Columns over bytes and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def little_endian(data: Column, start: int, length: int) -> Column:
    """Unsigned integer of ``length`` bytes from the 0-based ``start``, as decimal(20, 0); null past the end."""
    piece = F.substring(data, start + 1, length)
    swapped = F.conv(F.concat(*[F.substring(F.hex(piece), 2 * i + 1, 2) for i in range(length - 1, -1, -1)]), 16, 10)
    return F.when(F.length(piece) == length, swapped.cast("decimal(20,0)"))


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def printable_runs(data: Column, least: int = 4) -> Column:
    """All runs of ``least`` or more characters from space to tilde."""
    return F.regexp_extract_all(latin1(data), F.lit(rf"[\x20-\x7e]{{{least},}}"), F.lit(0))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last dot of a name and what follows, lower-case; none if the name has no other dot but a leading one."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def path_parts_contain(path: Column, part: str) -> Column:
    return F.array_contains(F.split(path, "/"), part)


def outer_path(location: Column) -> Column:
    """Of ``file!member`` the file."""
    return F.substring_index(location, "!", 1)


def byte_size_text(n: Column) -> Column:
    """A size with one decimal and the largest fitting unit of 1024."""
    out = F.format_string("%.1fPB", n / 1024.0**5)
    for i in range(4, -1, -1):
        out = F.when(F.abs(n) < 1024.0 ** (i + 1), F.format_string(f"%.1f{('B', 'KB', 'MB', 'GB', 'TB')[i]}", n / 1024.0**i)).otherwise(out)
    return out

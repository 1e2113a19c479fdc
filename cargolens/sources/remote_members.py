"""Members of remote ZIP files as a table: filters and the schema asked for become byte ranges.

``spark.read.format("remote_zip")`` with the option ``files``, a line ``target, path, url`` (tab-separated) for
each file. What is known of a member from the archive's directory (all columns but ``content`` and ``error``) is
filtered before anything of it is read; without ``content`` in the reader's schema nothing but directories is.
Of the members that are left, those that lie near each other come with one range, and ranges are dealt to
tasks by their bytes.

Up to ``plannedFiles`` archives are planned by their directories, so one large archive is many tasks; of more
archives than that each task takes some and reads their directories itself. A file or member that can't be read
is a row with ``error``, or with the option ``errors`` = ``raise`` ends the query: a filter on ``member`` drops a
file's error row as any other, since its member is null.

Filters need ``spark.sql.python.filterPushdown.enabled``, which :func:`remote_members` sets."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from . import web
from .remote_zip import MEMBER_BYTES, Entry, entries, inflated

SCHEMA = "target_id string, path string, url string, member string, ord int, method int, comp_size long, size long, external_attr long, content binary, error string"
#: Columns that a directory tells.
_TOLD = ("target_id", "path", "url", "member", "ord", "method", "comp_size", "size", "external_attr")
#: Bytes that one range of several members may hold, and those between two members that are read along with them.
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
_LOCAL_HEADER, _SLACK = 30, 1024


def holds(f: D.Filter, row: dict) -> bool | None:
    """A filter's value for a row, with SQL's null; of filters that :func:`pushable` takes."""
    if isinstance(f, D.Not):
        x = holds(f.child, row)
        return None if x is None else not x
    value = row[f.attribute[0]]
    if isinstance(f, D.IsNull):
        return value is None
    if isinstance(f, D.IsNotNull):
        return value is not None
    if isinstance(f, D.EqualNullSafe):
        return value == f.value
    if value is None or (not isinstance(f, D.In) and f.value is None):
        return None
    match f:
        case D.EqualTo():
            return value == f.value
        case D.In():
            return True if value in f.value else None if None in f.value else False
        case D.GreaterThan():
            return value > f.value
        case D.GreaterThanOrEqual():
            return value >= f.value
        case D.LessThan():
            return value < f.value
        case D.LessThanOrEqual():
            return value <= f.value
        case D.StringStartsWith():
            return value.startswith(f.value)
        case D.StringEndsWith():
            return value.endswith(f.value)
        case D.StringContains():
            return f.value in value
    raise TypeError(type(f).__name__)


_KNOWN = (D.IsNull, D.IsNotNull, D.EqualNullSafe, D.EqualTo, D.In, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual, D.StringStartsWith, D.StringEndsWith, D.StringContains)


def pushable(f: D.Filter) -> bool:
    if isinstance(f, D.Not):
        return pushable(f.child)
    return isinstance(f, _KNOWN) and len(f.attribute) == 1 and f.attribute[0] in _TOLD


@dataclass
class _Part(D.InputPartition):
    """Archives to plan in the task, or a plan: of one archive ranges (start, bytes) with the members in them, and rows to return as they are."""

    files: list[tuple[str, str, str]] = field(default_factory=list)
    plan: list[tuple[int, int, list[tuple[int, Entry]]]] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    of_all: int = 1

    def __post_init__(self):
        super().__init__(None)


class RemoteZip(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return _Reader(self.options, schema.fieldNames())


class _Reader(D.DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        if unknown := set(columns) - {c.split(" ")[0] for c in SCHEMA.split(", ")}:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.files = [tuple(line.split("\t")) for line in options.get("files", "").split("\n") if line]
        if any(len(f) != 3 for f in self.files):
            raise ValueError("a line of files is: target, path, url")
        self.columns, self.filters = columns, []
        self.token, self.rate = options.get("token"), float(options.get("requestsPerSecond", 0))
        self.planned, self.part_bytes = int(options.get("plannedFiles", 64)), int(options.get("partitionBytes", RANGE_BYTES))
        self.raises = options.get("errors", "rows") == "raise"

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def _passes(self, row: dict, only: tuple[str, ...] | None = None) -> bool:
        """Whether a row passes the filters; with ``only``, those that name no other columns."""

        def named(f: D.Filter) -> str:
            return named(f.child) if isinstance(f, D.Not) else f.attribute[0]

        return all(holds(f, row) for f in self.filters if only is None or named(f) in only)

    def _base(self, file: tuple[str, str, str]) -> dict:
        return dict.fromkeys((*_TOLD, "content", "error")) | dict(zip(("target_id", "path", "url"), file, strict=True))

    def _row(self, file: tuple[str, str, str], k: int, e: Entry) -> dict:
        return self._base(file) | {"member": e.name, "ord": k, "method": e.method, "comp_size": e.comp_size, "size": e.size, "external_attr": e.external_attr}

    def _failed(self, row: dict, e: Exception) -> list[dict]:
        if self.raises:
            raise e
        row = row | {"error": f"{type(e).__name__}: {e}"[:500]}
        return [row] if self._passes(row) else []

    def _plan(self, file: tuple[str, str, str], budget: web.Budget) -> tuple[list[tuple[int, int, list[tuple[int, Entry]]]], list[dict]]:
        """Ranges of one archive with their members, and rows that need no range."""
        try:
            size, fetch = web.ranges(file[2], self.token, budget=budget)
            found = entries(size, fetch)
        except (OSError, ValueError, KeyError, struct.error) as e:
            return [], self._failed(self._base(file), e)
        asked = [(k, e) for k, e in enumerate(found) if self._passes(self._row(file, k, e))]
        if "content" not in self.columns:
            return [], [self._row(file, k, e) for k, e in asked]
        starts = sorted(e.offset for e in found)
        follows = dict(zip(starts, [*starts[1:], size], strict=True))
        ranges, rows = [], []
        for k, e in sorted(asked, key=lambda x: x[1].offset):
            if e.comp_size > MEMBER_BYTES:
                rows += self._failed(self._row(file, k, e), ValueError("member beyond the read limit"))
                continue
            end = min(follows[e.offset], e.offset + _LOCAL_HEADER + 4 * len(e.name) + _SLACK + e.comp_size, size)
            if ranges and 0 <= e.offset - sum(ranges[-1][:2]) <= GAP_BYTES and end - ranges[-1][0] <= RANGE_BYTES:
                first, _, some = ranges[-1]
                ranges[-1] = (first, end - first, [*some, (k, e)])
            else:
                ranges.append((e.offset, end - e.offset, [(k, e)]))
        return ranges, rows

    def partitions(self) -> list[D.InputPartition]:
        files = [f for f in self.files if self._passes(self._base(f), ("target_id", "path", "url"))]
        if len(files) > self.planned:
            step = max(1, len(files) // 10_000)
            parts = [_Part(files=files[i : i + step]) for i in range(0, len(files), step)]
        else:
            budget, parts = web.Budget(self.rate), []
            with ThreadPoolExecutor(1 if self.rate else 8) as pool:
                plans = list(pool.map(lambda f: self._plan(f, budget), files))
            for file, (ranges, rows) in zip(files, plans, strict=True):
                if rows:
                    parts.append(_Part([file], [], rows))
                share, held = [], 0
                for r in ranges:
                    share.append(r)
                    held += r[1]
                    if held >= self.part_bytes:
                        parts.append(_Part([file], share))
                        share, held = [], 0
                if share:
                    parts.append(_Part([file], share))
        for p in parts:
            p.of_all = len(parts)
        return parts or [_Part()]

    def read(self, partition: _Part) -> Iterator[tuple]:
        budget = web.Budget(self.rate / partition.of_all if self.rate else None)
        ready = bool(partition.plan or partition.rows)
        for file in partition.files:
            ranges, rows = (partition.plan, partition.rows) if ready else self._plan(file, budget)
            for row in rows:
                yield tuple(row[c] for c in self.columns)
            for start, n, members in ranges:
                for row in self._members(file, start, n, members, budget):
                    yield tuple(row[c] for c in self.columns)

    def _members(self, file: tuple[str, str, str], start: int, n: int, members: list[tuple[int, Entry]], budget: web.Budget) -> Iterator[dict]:
        fetch = web.reader(file[2], self.token, budget=budget)
        try:
            data = fetch(start, n)
        except OSError as e:
            for k, entry in members:
                yield from self._failed(self._row(file, k, entry), e)
            return
        for k, entry in members:
            try:
                at = entry.offset - start
                name, extra = struct.unpack_from("<HH", data, at + 26)
                body = at + _LOCAL_HEADER + name + extra
                stored = data[body : body + entry.comp_size]
                if len(stored) < entry.comp_size:
                    stored += fetch(start + body + len(stored), entry.comp_size - len(stored))
                yield self._row(file, k, entry) | {"content": inflated(entry, stored)}
            except Exception as e:
                yield from self._failed(self._row(file, k, entry), e)


def remote_members(spark: SparkSession, files: list[tuple[str, str, str]], columns: str = SCHEMA, **options) -> DataFrame:
    """Members of the archives ``files`` (target_id, path, url). ``columns`` is the schema to read: leave ``content`` out and only directories are read.

    Spark keeps what one query of a frame pushed down for a next one that pushes nothing. The frame's own filter on
    ``url``, which is never null, makes each query push its filters; read by the format's name, use a frame for one query."""
    spark.dataSource.register(RemoteZip)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("remote_zip").option("files", "\n".join("\t".join(f) for f in files))
    for name, value in options.items():
        reader = reader.option(name, value)
    names = StructType.fromDDL(columns).fieldNames()
    rows = reader.schema(columns if "url" in names else f"{columns}, url string").load()
    return rows.where(rows["url"].isNotNull()).select(*names)

"""Repository metadata from a hub's HTTP interface, as a table or as a stream of pages.

``spark.read.format("hub_repos")``: option ``ids`` (newline-separated) reads each repository's metadata, ``authors``
reads all that each author has, page by page; ids and authors are dealt to tasks. ``spark.readStream`` reads the whole
listing: a page's cursor is the stream's offset, so a page that was lost is asked for again by its cursor, and a restart
goes on where the last committed page ended. ``requestsPerSecond`` is one budget for all tasks.

A repository or author that can't be read is a row with ``error`` and the id or author; in a stream a page that fails
after all attempts ends the query, which then starts again from that page."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, urlencode, urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from ..operators.hub import REPOS
from . import web

SCHEMA = f"{REPOS}, error string"
_COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]
_NEXT = re.compile(r'<([^>]*)>\s*;\s*rel="?next"?')
DEFAULT = "https://huggingface.co"


def as_row(info: dict) -> tuple:
    """A repository's metadata in the columns of the table; what has another type than it should is left out."""

    def of(kind, x):
        return x if isinstance(x, kind) and not (kind is int and isinstance(x, bool)) else None

    siblings = [(of(str, s.get("rfilename")) or "", of(int, s.get("size")), bool(s.get("lfs"))) for s in info.get("siblings") or [] if isinstance(s, dict)]
    gated = info.get("gated")
    text = {k: of(str, info.get(k)) for k in ("id", "author", "createdAt", "lastModified")}
    tags = [t for t in info.get("tags") or [] if isinstance(t, str)]
    return (text["id"] or of(str, info.get("modelId")), text["author"], of(int, info.get("downloads")), of(int, info.get("likes")), text["createdAt"], text["lastModified"], None if gated is None else str(gated), of(bool, info.get("disabled")), tags, siblings, None)


def _failed(name: str, e: Exception, column: str = "id") -> tuple:
    row = dict.fromkeys(_COLUMNS) | {column: name, "error": f"{type(e).__name__}: {e}"[:500]}
    return tuple(row[c] for c in _COLUMNS)


@dataclass
class _Part(D.InputPartition):
    ids: list[str] = field(default_factory=list)
    authors: list[str] = field(default_factory=list)
    of_all: int = 1

    def __post_init__(self):
        super().__init__(None)


class HubRepos(D.DataSource):
    """Options: endpoint, kind (models), ids, authors, pageSize, token, requestsPerSecond, pagesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "hub_repos"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema: StructType) -> D.SimpleDataSourceStreamReader:
        return _Pages(self.options)


class _Client:
    def __init__(self, options: dict):
        self.root, self.kind = options.get("endpoint", DEFAULT).rstrip("/"), options.get("kind", "models")
        self.token, self.rate, self.page = options.get("token"), float(options.get("requestsPerSecond", 0)), int(options.get("pageSize", 100))

    def page_url(self, **query) -> str:
        return f"{self.root}/api/{self.kind}?{urlencode({**query, 'limit': self.page, 'full': 'true'})}"

    def get(self, url: str, budget: web.Budget) -> tuple[object, str | None]:
        """A parsed answer and the address of the next page."""
        headers, body = web.request(url, token=self.token, timeout=30, budget=budget)
        follows = _NEXT.search(headers.get("link") or "")
        return json.loads(body), urljoin(url, follows.group(1)) if follows else None


class _Reader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.client = _Client(options)
        self.ids, self.authors = ([x for x in options.get(k, "").split("\n") if x] for k in ("ids", "authors"))
        if not self.ids and not self.authors:
            raise ValueError("ids or authors; the whole listing is a stream")

    def partitions(self) -> list[D.InputPartition]:
        step = max(1, len(self.ids) // 1000)
        parts = [_Part(ids=self.ids[i : i + step]) for i in range(0, len(self.ids), step)] + [_Part(authors=[a]) for a in self.authors]
        for p in parts:
            p.of_all = len(parts)
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        rate = self.client.rate
        budget = web.Budget(rate / partition.of_all if rate else None)
        for name in partition.ids:
            try:
                info = self.client.get(f"{self.client.root}/api/{self.client.kind}/{quote(name)}", budget)[0]
                yield as_row({"id": name} | info)
            except Exception as e:
                yield _failed(name, e)
        for author in partition.authors:
            url = self.client.page_url(author=author)
            try:
                while url:
                    infos, url = self.client.get(url, budget)
                    yield from map(as_row, infos)
            except Exception as e:
                yield _failed(author, e, "author")


class _Pages(D.SimpleDataSourceStreamReader):
    """The offset is the address of the next page to read and how many were read; the last page's is empty."""

    def __init__(self, options: dict):
        self.client, self.most = _Client(options), int(options.get("pagesPerBatch", 10))
        self.budget = web.Budget(self.client.rate)

    def initialOffset(self) -> dict:
        return {"page": self.client.page_url(), "read": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        url, n, rows = start["page"], start["read"], []
        while url and n < start["read"] + self.most:
            infos, url = self.client.get(url, self.budget)
            rows += map(as_row, infos)
            n += 1
        return iter(rows), {"page": url or "", "read": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        url = start["page"]
        for _ in range(end["read"] - start["read"]):
            infos, url = self.client.get(url, self.budget)
            yield from map(as_row, infos)

    def commit(self, end: dict) -> None:
        pass


def _with(reader, options: dict):
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader


def repositories(spark: SparkSession, ids: list[str] = (), authors: list[str] = (), **options) -> DataFrame:
    """Metadata of repositories by id, and of all repositories of authors, with ``error`` where one can't be read."""
    spark.dataSource.register(HubRepos)
    return _with(spark.read.format("hub_repos").option("ids", "\n".join(ids)).option("authors", "\n".join(authors)), options).load()


def listing(spark: SparkSession, **options) -> DataFrame:
    """A stream of the hub's whole listing."""
    spark.dataSource.register(HubRepos)
    return _with(spark.readStream.format("hub_repos"), options).load()

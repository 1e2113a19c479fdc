"""All facts of artifacts in one pass: each file is read once, parsed where it lies, and forgotten.

No file ends the pass: what goes wrong in one file is a row of kind ``error`` of that file, beside the
facts that were found before. Names and texts with lone surrogates, which UTF-8 can't carry, are escaped."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import knowledge as K
from ..functions.blob import Blob
from . import containers, documents, pickles, source_code, tensors

#: Fields by kind of fact; a row holds one of them.
KINDS = {
    "pickle": pickles.STREAM,
    "import": pickles.IMPORTS,
    "member": "container string, ord int, member string, is_dir boolean, comp_size long, size long, external_attr long, mode int, kind string, error string",
    "stream": "format string, size long, raw_size long, error string, outcome string, inner string",
    "tensor": "size long, header_size decimal(20,0), problem string, ord int, name string, dtype string, shape array<decimal(38,0)>, b decimal(38,0), e decimal(38,0), bad_offsets boolean, long_texts array<string>",
    "npy": tensors.NPY,
    "graph": tensors.GRAPH,
    "keras": documents.KERAS,
    "config": documents.CONFIG,
    "template": documents.TEMPLATE,
    "notebook": documents.LINES,
    "source": f"facts {source_code.FACTS}",
    "index": "shards array<string>",
    "error": "message string",
}
#: Analyzers that ask for a kind.
ASKED_BY = {
    "pickle": ("pickle",), "import": ("pickle",), "member": ("archive",), "stream": ("archive",), "tensor": ("tensors",), "npy": ("tensors",), "graph": ("graph", "keras", "tensors"),
    "keras": ("keras",), "config": ("config", "repository", "provenance"), "index": ("repository",), "template": ("templates",), "notebook": ("code",), "source": ("code",),
}
_PACKED = ("gzip", "bzip2", "xz", "zstd")


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def _said(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"[:500]


#: Facts of equal files that a task keeps: so many files of so many characters of facts each at most.
SAME_FILES, SAME_CHARS = 256, 1 << 16


class Same:
    """Facts of the files that a task met last, by path, format and digest: repositories hold copies, and copies have equal facts."""

    def __init__(self):
        self.kept: OrderedDict[tuple, list] = OrderedDict()

    def rows(self, parser: Parser, path: str, name: str, fmt: str, repo: bool, blob: Blob) -> Iterator[tuple[str, str, dict]]:
        if not blob.at_hand:
            yield from parser.rows(path, name, fmt, repo, blob)
            return
        key = (path, name, fmt, repo, sha256(blob.content).digest())
        if (known := self.kept.get(key)) is not None:
            self.kept.move_to_end(key)
            blob.close()
            yield from known
            return
        found, left = [], SAME_CHARS
        for row in parser.rows(path, name, fmt, repo, blob):
            if left >= 0:
                found.append(row)
                left -= len(str(row[2])) + 100
            yield row
            if left < 0:
                found = []
        if left >= 0:
            self.kept[key] = found
            if len(self.kept) > SAME_FILES:
                self.kept.popitem(last=False)


class Parser:
    """Fact rows of one file: (location, kind, fact)."""

    def __init__(self, kinds: set[str], memo: bool = False, zstd: bool = False, strict: bool = False):
        self.kinds, self.memo, self.zstd, self.strict = kinds | {"error"}, memo, zstd, strict
        self.streams = 0

    def rows(self, path: str, name: str, fmt: str, is_repo: bool, blob: Blob) -> Iterator[tuple[str, str, dict]]:
        self.streams = 0
        try:
            for location, kind, fact in self._all(path, name, fmt, is_repo, blob):
                if kind in self.kinds:
                    yield location, kind, fact
        except Exception as e:
            yield path, "error", {"message": _said(e)}
        finally:
            blob.close()

    def _all(self, path: str, name: str, fmt: str, is_repo: bool, blob: Blob) -> Iterator[tuple[str, str, dict]]:
        if fmt in _PACKED:
            yield from self._stream(path, fmt, blob)
            return
        if fmt == "tar":
            yield from self._members(path, "tar", containers.tar_members(blob.open()))
            return
        if fmt in ("torch-zip", "zip", "keras-v3", "npz"):
            yield from self._members(path, "zip", containers.zip_members(blob.open(), fmt == "npz"))
        elif fmt == "pickle":
            yield from self._pickle(path, blob)
        elif fmt == "npy":
            yield from self._npy(path, blob)
        elif fmt == "safetensors":
            for r in tensors.tensor_rows(blob):
                yield path, "tensor", {"size": blob.size} | r
        elif fmt in ("hdf5", "onnx", "tf-protobuf", "gguf"):
            yield path, "graph", tensors.graph_row(fmt, blob)
        elif fmt == "python-source" and "source" in self.kinds:
            yield path, "source", {"facts": source_code.facts(_text(blob.whole()), self.strict)}
        elif fmt == "notebook":
            row = documents.json_row(documents.notebook_row, _text(blob.whole()))
            problem = row.pop("problem", None)
            yield path, "notebook", row
            if problem:
                raise ValueError(problem)
        if name == "config.json":
            yield path, "config", documents.json_row(documents.config_row, _text(blob.whole()))
        if is_repo and "index" in self.kinds and name.endswith(".index.json"):
            yield path, "index", documents.json_row(documents.index_row, _text(blob.whole()))
        if is_repo and "template" in self.kinds and documents.is_template(name):
            yield path, "template", documents.template_row(name, _text(blob.read(0, 16 << 20)))

    def _pickle(self, location: str, blob: Blob) -> Iterator[tuple[str, str, dict]]:
        if "pickle" in self.kinds:
            w, n = pickles.Walk(blob.open(), blob.size, memo=self.memo), self.streams
            self.streams += 1
            rows = w.import_rows()
            names, more = next(rows, []), next(rows, None)
            if more is not None:
                for part in chain((names, more), rows):
                    yield location, "import", {"stream": n, "names": part}
                names = None
            yield location, "pickle", {"stream": n, "names": names} | w.summary

    def _npy(self, location: str, blob: Blob) -> Iterator[tuple[str, str, dict]]:
        yield location, "npy", tensors.npy_row(blob)

    def _inner(self, location: str, kind: str | None, data: bytes) -> Iterator[tuple[str, str, dict]]:
        if kind == "pickle":
            yield from self._pickle(location, Blob(data))
        elif kind == "npy":
            yield from self._npy(location, Blob(data))
        elif kind == "config":
            yield location, "keras", documents.json_row(documents.keras_row, _text(data))

    def _members(self, path: str, container: str, members: Iterable[dict]) -> Iterator[tuple[str, str, dict]]:
        for m in members:
            data = m.pop("content", None)
            yield path, "member", {"container": container} | m
            if data is not None:
                yield from self._inner(f"{path}!{m['member']}", m["kind"], data)

    def _stream(self, path: str, fmt: str, blob: Blob) -> Iterator[tuple[str, str, dict]]:
        row, raw = containers.stream_row(fmt, blob.size, lambda: blob.read(0, blob.size), self.zstd)
        yield path, "stream", row
        if row["inner"] == "tar":
            yield from self._members(path, "tar", containers.tar_members(Blob(raw).open()))
        elif raw is not None:
            yield from self._inner(path, row["inner"], raw)


def _schema() -> T.StructType:
    facts = [T.StructField(k, T.StructType.fromDDL(v)) for k, v in KINDS.items()]
    return T.StructType([T.StructField(n, T.StringType()) for n in ("target_id", "path", "location", "kind")] + facts)


def _escaped(x):
    """``x`` with the lone surrogates of its texts escaped."""
    if isinstance(x, str):
        return x.encode("utf-8", "backslashreplace").decode("utf-8")
    if isinstance(x, dict):
        return {k: _escaped(v) for k, v in x.items()}
    return [_escaped(v) for v in x] if isinstance(x, list) else x


def as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as an Arrow batch; one that Arrow refuses even with its texts escaped becomes an error of its file."""
    try:
        return pa.RecordBatch.from_pylist(rows, schema=schema)
    except Exception:
        if len(rows) > 1:
            half = len(rows) // 2
            return pa.concat_batches([as_batch(rows[:half], schema), as_batch(rows[half:], schema)])
    row = _escaped(rows[0])
    try:
        return pa.RecordBatch.from_pylist([row], schema=schema)
    except Exception as e:
        return pa.RecordBatch.from_pylist([{c: row[c] for c in ("target_id", "path", "location")} | {"kind": "error", "error": {"message": _said(e)}}], schema=schema)


#: Facts of one Arrow batch, and rows of imports (as many names each as pickles.ROW_NAMES says) among them.
BATCH, BATCH_IMPORTS = 500, 4


def extract(known: DataFrame, kinds: set[str], memo: bool = False, zstd: bool = False, strict: bool = False) -> DataFrame:
    """known: identified artifacts. A row for each fact of the kinds, without any content; a file that
    no wanted kind can come from isn't handed to Python. Files with a ``uri`` are read here, by ranges."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _schema()
    arrow = to_arrow_schema(schema)
    parser = Parser(kinds, memo, zstd, strict)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        heavy, same = 0, Same()
        for batch in batches:
            columns = [batch.column(i) for i in range(8)]
            for i in range(batch.num_rows):
                target, path, name, fmt, repo, content, uri, size = (c[i].as_py() for c in columns)
                try:
                    blob = Blob(content, uri, size)
                except OSError as e:
                    out.append({"target_id": target, "path": path, "location": path, "kind": "error", "error": {"message": _said(e)}})
                    continue
                for location, kind, fact in same.rows(parser, path, name, fmt, repo, blob):
                    out.append({"target_id": target, "path": path, "location": location, "kind": kind, kind: fact})
                    heavy += kind == "import"
                    if len(out) >= BATCH or heavy >= BATCH_IMPORTS:
                        yield as_batch(out, arrow)
                        out, heavy = [], 0
        if out:
            yield as_batch(out, arrow)

    silent = ["native-executable", "code", "git-lfs-pointer", "msgpack"]
    lower = F.lower("name")
    named = lower.isin(*K.TEMPLATE_FILES) | lower.endswith(".jinja") | (F.col("name") == "config.json") | F.col("name").endswith(".index.json")
    asked = known.where(~F.col("format").isin("text", "unknown", *silent) | named | F.col("is_tar"))
    fmt = F.when(F.col("is_tar"), "tar").otherwise(F.col("format"))
    return asked.select("target_id", "path", "name", fmt.alias("format"), "is_repo", "content", "uri", "size").mapInArrow(read, schema)


def of(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind).select("target_id", "path", "location", F.col(kind).alias("_fact")).select("target_id", "path", "location", "_fact.*")

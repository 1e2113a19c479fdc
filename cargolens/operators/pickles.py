"""Pickle streams: facts by a walk over the opcodes (nothing is ever loaded), rules as joins."""

from __future__ import annotations

import io
import pickletools
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import knowledge as K
from ..model import emit, rule

_SUMMARY = "protocol int, n_opcodes long, n_calls long, n_imports long, calls array<string>, exts array<string>, strings array<string>, error string, stop_pos long, trailing long"
FACTS = f"{_SUMMARY}, imports array<struct<ord:long,module:string,attr:string,pos:long,first:boolean>>, ops array<struct<ord:int,opcode:string,arg:string,pos:long>>"
_NAMES = "names array<struct<module:string,attr:string,pos:long>>"
#: What an audit keeps of a stream: its summary with its imports, or those of a stream with very many in rows of their own.
STREAM, IMPORTS = f"stream int, {_SUMMARY}, {_NAMES}", f"stream int, {_NAMES}"
_EXT = ("EXT1", "EXT2", "EXT4")
UNRESOLVED = "<unresolved>"
#: Pushed strings that are kept, and their characters; names remembered as seen, and names and characters of one row of imports.
MOST_PUSHED, PUSHED_CHARS, MOST_SEEN, ROW_NAMES, ROW_CHARS = 1 << 19, 32 << 20, 100_000, 500, 1 << 20
#: Opcodes for extension registries that are kept for evidence.
KEPT_EXTS = 5
_PUTS, _GETS = ("PUT", "BINPUT", "LONG_BINPUT", "MEMOIZE"), ("GET", "BINGET", "LONG_BINGET")
_NAMED = frozenset([*K.STRING_OPCODES, *K.CALL_OPCODES, *_EXT, "GLOBAL", "INST", "STACK_GLOBAL", "PROTO", "STOP"])


class Walk:
    """One pass over the opcodes of a stream of ``size`` bytes, as far as it parses: imports as they come, then ``summary``.

    Two pushed strings name what STACK_GLOBAL imports and are used up by it. With ``memo``, strings that the
    stream fetches from its memo count as pushed; it is off for results that equal those of scanners which only
    see pushes. What is held doesn't grow with the stream: the newest pushed strings stay, and a stream that goes
    back beyond them ends in an error, which is a finding."""

    def __init__(self, stream: BinaryIO | bytes, size: int | None = None, keep_ops: int = 0, memo: bool = False):
        self.stream, self.size = (io.BytesIO(stream), len(stream)) if isinstance(stream, bytes) else (stream, size)
        self.keep_ops, self.memo = keep_ops, memo
        self.ops: list[dict] = []
        self.summary = {"protocol": None, "n_opcodes": 0, "n_calls": 0, "n_imports": 0, "calls": [], "exts": [], "strings": [], "error": None, "stop_pos": None, "trailing": 0}
        self.pushed: list[str] = []
        self.chars = self.dropped = 0

    def _push(self, text: str) -> None:
        self.pushed.append(text)
        self.chars += len(text)
        if len(self.pushed) > 2 * MOST_PUSHED or (self.chars > 2 * PUSHED_CHARS and len(self.pushed) > 8):
            gone = self.pushed[: len(self.pushed) // 2]
            self.dropped += len(gone)
            self.chars -= sum(map(len, gone))
            del self.pushed[: len(gone)]

    def _two(self) -> tuple[str, str]:
        if len(self.pushed) > 1:
            two = tuple(self.pushed[-2:])
            del self.pushed[-2:]
            self.chars -= len(two[0]) + len(two[1])
            return two
        if self.dropped:
            raise ValueError("more pushed strings are used than are kept")
        return UNRESOLVED, UNRESOLVED

    def imports(self) -> Iterator[tuple[str, str, int]]:
        out, cells, top, last, n = self.summary, {}, None, 0, 0
        try:
            for op, arg, pos in pickletools.genops(self.stream):
                last, name = pos, op.name
                n += 1
                if n <= self.keep_ops:
                    self.ops.append({"ord": n - 1, "opcode": name, "arg": None if arg is None else str(arg)[:200], "pos": pos})
                if self.memo:
                    if name in _PUTS:
                        if len(cells) > MOST_PUSHED:
                            raise ValueError("more memo cells than are kept")
                        cells[len(cells) if arg is None else int(arg)] = top
                        continue
                    top = cells.get(arg) if name in _GETS else None
                    if top is not None:
                        self._push(top)
                if name not in _NAMED:
                    continue
                if name in K.STRING_OPCODES:
                    top = arg.decode("utf-8", "replace") if isinstance(arg, bytes) else arg
                    self._push(top)
                    if len(out["strings"]) < K.MAX_STRINGS:
                        out["strings"].append(top)
                elif name in ("GLOBAL", "INST"):
                    out["n_imports"] += 1
                    module, _, attr = (arg or "").partition(" ")
                    yield module, attr, pos
                elif name == "STACK_GLOBAL":
                    out["n_imports"] += 1
                    yield *self._two(), pos
                elif name == "PROTO":
                    out["protocol"] = arg
                elif name in _EXT:
                    if len(out["exts"]) < KEPT_EXTS:
                        out["exts"].append(f"{name} at {pos}")
                elif name == "STOP":
                    out["stop_pos"], out["trailing"] = pos + 1, self.size - pos - 1
                if name in K.CALL_OPCODES:
                    out["n_calls"] += 1
                    if name not in out["calls"]:
                        out["calls"].append(name)
        except Exception as e:
            out["error"], out["trailing"] = f"{type(e).__name__}: {e}"[:500], max(0, self.size - last)
        out["n_opcodes"] = n

    def import_rows(self) -> Iterator[list[dict]]:
        """Imports in lists of bounded size. A name may come more than once where a stream has very many; the first has the least place."""
        seen: set[tuple[str, str]] = set()
        row, chars = [], 0
        for module, attr, pos in self.imports():
            if (module, attr) in seen:
                continue
            if len(seen) >= MOST_SEEN or len(module) + len(attr) > ROW_CHARS:
                seen.clear()
            seen.add((module, attr))
            row.append({"module": module, "attr": attr, "pos": pos})
            chars += len(module) + len(attr)
            if len(row) >= ROW_NAMES or chars >= ROW_CHARS:
                yield row
                row, chars = [], 0
        if row:
            yield row


def walk(stream: BinaryIO | bytes, size: int | None = None, keep_ops: int = 0, memo: bool = False) -> dict:
    """All facts of one stream: its summary, its first imports (all of them with ``keep_ops``, for a trace), and its first opcodes."""
    w = Walk(stream, size, keep_ops, memo)
    seen: set[tuple[str, str]] = set()
    imports = []
    for k, (module, attr, pos) in enumerate(w.imports()):
        first = (module, attr) not in seen
        if first or keep_ops:
            imports.append({"ord": k, "module": module, "attr": attr, "pos": pos, "first": first})
        seen.add((module, attr))
    return w.summary | {"imports": imports, "ops": w.ops}


def facts(streams: DataFrame, keep_ops: int = 0, memo: bool = False) -> DataFrame:
    """streams: target_id, location, content. The same with the facts in place of the content."""
    names = [f.split(" ")[0] for f in _SUMMARY.split(", ")] + ["imports", "ops"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [walk(bytes(c), keep_ops=keep_ops, memo=memo) for c in b.content]
            out = pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})
            for n in ("protocol", "n_opcodes", "n_calls", "n_imports", "stop_pos", "trailing"):
                out[n] = pd.array(out[n], "Int64")
            out.insert(0, "location", b.location.to_numpy())
            out.insert(0, "target_id", b.target_id.to_numpy())
            yield out

    return streams.select("target_id", "location", F.coalesce("content", F.lit(b"")).alias("content")).mapInPandas(read, f"target_id string, location string, {FACTS}")


def _pairs(spark, names: list[str], severity: str) -> list[tuple[str, str, str]]:
    return [(*n.split(":"), severity) for n in names]


def knowledge_base(spark) -> tuple[DataFrame, DataFrame]:
    """(module, attr, severity) of exact names, and (module, severity) of whole modules: 101 and 26 rows."""
    exact = [x for names, s in ((K.CRITICAL_GLOBALS, "CRITICAL"), (K.HIGH_GLOBALS, "HIGH"), (K.WATCH_GLOBALS, "MEDIUM")) for x in _pairs(spark, names, s)]
    modules = [(m, "CRITICAL") for m in K.CRITICAL_MODULES] + [(m, "HIGH") for m in K.HIGH_MODULES]
    return spark.createDataFrame(exact, "module string, attr string, exact_severity string"), spark.createDataFrame(modules, "module string, module_severity string")


def allowed(module: Column, attr: Column) -> Column:
    under = F.lit(False)
    for p in K.ALLOWED_PREFIXES:
        under = under | (module == p) | module.startswith(p + ".")
    return under | F.concat_ws(":", module, attr).isin(*K.ALLOWED_GLOBALS)


def judged(imports: DataFrame) -> DataFrame:
    """imports: rows with module and attr. Adds known_severity (exact names go before modules), allowed and bucket."""
    exact, modules = knowledge_base(imports.sparkSession)
    out = imports.join(F.broadcast(exact), ["module", "attr"], "left").join(F.broadcast(modules), "module", "left")
    out = out.withColumn("known_severity", F.coalesce("exact_severity", "module_severity")).drop("exact_severity", "module_severity")
    out = out.withColumn("allowed", allowed(F.col("module"), F.col("attr")))
    return out.withColumn("bucket", F.when(F.col("known_severity").isNotNull(), "deny").when(F.col("allowed"), "allow").otherwise("unknown"))


def first_imports(streams: DataFrame) -> DataFrame:
    """A row for each name that a stream imports, at its first place."""
    seen = F.col("names") if "names" in streams.columns else F.filter("imports", lambda x: x["first"])
    return streams.select("target_id", "location", (F.col("n_calls") > 0).alias("has_call"), F.explode(seen).alias("x")).select("target_id", "location", "has_call", "x.module", "x.attr", "x.pos")


def imports_of(streams: DataFrame, rows: DataFrame) -> DataFrame:
    """The same of streams with very many names, from an audit's rows of imports, which may repeat a name; one stream's are dealt to many tasks."""
    key = ["target_id", "location", "stream"]
    named = rows.select(*key, F.explode("names").alias("x")).groupBy(*key, "x.module", "x.attr").agg(F.min("x.pos").alias("pos"))
    return named.join(streams.where("names is null").select(*key, (F.col("n_calls") > 0).alias("has_call")), key).select("target_id", "location", "has_call", "module", "attr", "pos")


def findings(streams: DataFrame, imports: DataFrame | None = None) -> list[DataFrame]:
    """FMT-001 and PKL-001 to 005. streams: facts; imports: an audit's rows of imports, of streams whose facts don't hold them."""
    seen = first_imports(streams)
    names = judged(seen if imports is None else seen.unionByName(imports_of(streams, imports)))
    known = F.col("known_severity")
    armed = F.when(~F.col("has_call") & (known == "CRITICAL"), "HIGH").otherwise(known)
    where = F.array(F.concat(F.lit("offset "), F.col("pos").cast("string"), F.lit(": "), "module", F.lit("."), "attr"))
    name = F.concat_ws(".", "module", "attr")
    hits = streams.withColumn("_hits", F.slice(F.filter("strings", lambda s: _any_of(s, K.SHELL_MARKERS)), 1, 8))
    loud = F.exists("_hits", lambda s: _any_of(s, K.SHELL_MARKERS_HIGH))
    return [
        emit(
            names,
            rule("PKL-001", "known_severity is not null", armed, "execution", detail=name, evidence=where),
            rule("PKL-002", "known_severity is null and not allowed", F.when(F.col("has_call"), "MEDIUM").otherwise("LOW"), "execution", "medium", name, where),
        ),
        emit(
            hits,
            rule("FMT-001", F.lit(True), "LOW", "serialization", detail=F.concat(F.lit("opcodes: "), F.col("n_opcodes").cast("string"))),
            rule("PKL-003", "size(exts) > 0", "HIGH", "execution", evidence=F.slice("exts", 1, 5)),
            rule("PKL-004", "error is not null", "MEDIUM", "integrity", "medium", F.col("error"), F.array("error")),
            rule("PKL-005", "size(_hits) > 0", F.when(loud, "HIGH").otherwise("MEDIUM"), "execution", "medium", evidence=F.transform("_hits", lambda s: F.substring(s, 1, 200))),
        ),
    ]


def trailing_findings(streams: DataFrame) -> DataFrame:
    """PKL-006, an extension that is off by default: bytes behind the stream's end."""
    return emit(streams, rule("PKL-006", "error is null and trailing > 0", "MEDIUM", "integrity", "medium", F.concat(F.col("trailing").cast("string"), F.lit(" bytes after STOP"))))


def _any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def located(files: DataFrame, member: str | None = None) -> DataFrame:
    """The streams of files, for :func:`explain`: (target_id, location, content, error). files: target_id, path, content.

    Of an archive the streams of its pickled and npy members, or of the one named; of npy bytes what follows
    their header; else the file itself. What can't be opened is an error of its row."""
    from .containers import zip_members

    def behind_header(data: bytes) -> bytes:
        n = 2 if data[6] == 1 else 4
        return data[8 + n + int.from_bytes(data[8 : 8 + n], "little") :]

    def streams(data: bytes) -> Iterator[tuple[str, bytes]]:
        if data[:4] != b"PK\x03\x04":
            yield "", data
            return
        for m in zip_members(io.BytesIO(data)):
            if "member" not in m:
                raise ValueError(m["error"])
            if member in (None, m["member"]) and m.get("kind") in ("pickle", "npy"):
                yield f"!{m['member']}", m["content"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for target, path, content in zip(b.target_id, b.path, b.content, strict=True):
                try:
                    rows += [(target, path + at, behind_header(x) if x[:6] == b"\x93NUMPY" else x, None) for at, x in streams(bytes(content))]
                except Exception as e:
                    rows.append((target, path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["target_id", "location", "content", "error"])

    return files.select("target_id", "path", F.coalesce("content", F.lit(b"")).alias("content")).mapInPandas(read, "target_id string, location string, content binary, error string")


def explain(streams: DataFrame, max_ops: int = 200) -> tuple[DataFrame, DataFrame]:
    """(trace, summary): the first opcodes in order with the import each makes and its bucket; a row for each stream."""
    f = facts(streams, keep_ops=max_ops)
    imports = judged(f.select("target_id", "location", F.explode("imports").alias("x")).select("target_id", "location", "x.module", "x.attr", "x.pos"))
    trace = f.select("target_id", "location", F.explode("ops").alias("x")).select("target_id", "location", "x.*").join(imports, ["target_id", "location", "pos"], "left")
    summary = f.select("target_id", "location", "protocol", "n_opcodes", "n_imports", "n_calls", "stop_pos", "trailing", "error")
    tail = streams.select("target_id", "location", "content").join(summary, ["target_id", "location"]).withColumn("tail", F.when(F.col("stop_pos").isNotNull(), F.expr("substring(content, stop_pos + 1, 32)")))
    second = F.coalesce((F.length("tail") > 0) & F.hex(F.substring("tail", 1, 1)).isin("80", "28", "5D", "7D", "63"), F.lit(False))
    return trace, tail.select(*summary.columns, F.lower(F.hex("tail")).alias("tail_hex"), second.alias("second_stream"))

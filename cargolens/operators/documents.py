"""JSON documents: configuration, chat templates, notebooks and Keras configs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import knowledge as K
from ..functions.content import base_name
from ..model import emit, rule

LEAVES = "struct<ok:boolean,leaves:array<struct<path:string,value:string>>>"


def leaves(value: object) -> list[dict]:
    """String leaves in document order, as (path, value); a path is like a.b[0].c, that of a bare string <root>."""
    out, stack = [], [("", value)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, str):
            out.append({"path": path or "<root>", "value": x})
        elif isinstance(x, dict):
            stack += [(f"{path}.{k}" if path else str(k), v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            stack += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(x)))]
    return out


def _json_udf(kind: str, read):
    """A Pandas UDF over text that parses with the json module, whose dialect (NaN, repeated keys) the rules are defined on."""

    def parsed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([json_row_or_not(read, t) for t in texts])

    return lambda text: F.pandas_udf(parsed, kind)(text)


json_leaves = _json_udf(LEAVES, lambda x: {"ok": True, "leaves": leaves(x)})


def config_row(x: object) -> dict:
    d = x if isinstance(x, dict) else {}
    urls = [k for k in ("quantization_config", "auto_map", "architectures") if isinstance(d.get(k), str) and ("http://" in d[k] or "https://" in d[k])]
    custom = d.get("custom_pipeline") or d.get("custom_pipelines")
    return {"ok": True, "auto_map": json.dumps(d["auto_map"])[:400] if "auto_map" in d else None, "custom": str(custom)[:200] if custom else None, "urls": urls, "mentions_map": (isinstance(x, (dict, list, str)) and "auto_map" in x)}


config_facts = _json_udf("struct<ok:boolean,auto_map:string,custom:string,urls:array<string>,mentions_map:boolean>", config_row)


def notebook_row(x: object) -> dict:
    """Lines of code cells. Each cell is judged by itself: ``problem`` names the first that is none, and the lines of the others stay."""
    out, odd = [], []
    if x is not None and not isinstance(x, dict):
        odd.append(f"a notebook is no {type(x).__name__}")
    cells = x.get("cells", []) if isinstance(x, dict) else []
    if not isinstance(cells, list):
        odd.append(f"cells are no list but a {type(cells).__name__}")
        cells = cells.values() if isinstance(cells, dict) else []
    for i, cell in enumerate(cells):
        if not isinstance(cell, dict):
            odd.append(f"cell {i} is a {type(cell).__name__}")
        elif cell.get("cell_type") == "code":
            source = cell.get("source", [])
            parts = [source] if isinstance(source, str) else source if isinstance(source, list) else []
            if not isinstance(source, (str, list)) or not all(isinstance(p, str) for p in parts):
                odd.append(f"the source of cell {i} is no text")
            out += [{"cell": i, "line": s.strip()} for s in "".join(p for p in parts if isinstance(p, str)).splitlines()]
    return {"ok": True, "lines": out} | ({"problem": odd[0]} if odd else {})


def keras_row(x: object) -> dict:
    """Modules of objects outside Keras, in the order in which the last child is visited first; whether a Lambda or builtins is named."""
    modules: dict[str, str] = {}
    stack, words, builtins = [x], set(), False
    while stack:
        cur = stack.pop()
        if isinstance(cur, dict):
            words |= set(cur)
            m = cur.get("module")
            builtins = builtins or m == "builtins"
            if isinstance(m, str) and m and not any(m == p or m.startswith(p + ".") for p in K.KERAS_MODULES):
                modules.setdefault(m, str(cur.get("registered_name") or cur.get("class_name") or "?"))
            stack.extend(cur.values())
        elif isinstance(cur, list):
            stack.extend(cur)
        elif isinstance(cur, str):
            words.add(cur)
    return {"ok": True, "has_lambda": "Lambda" in words, "has_builtins": "registered_name" in words and builtins, "modules": [{"module": m, "name": n} for m, n in modules.items()]}


KERAS = "ok boolean, has_lambda boolean, has_builtins boolean, modules array<struct<module:string,name:string>>"
CONFIG = "ok boolean, auto_map string, custom string, urls array<string>, mentions_map boolean"
LINES = "ok boolean, lines array<struct<cell:int,line:string>>"
TEMPLATE = "ok boolean, leaves array<struct<path:string,value:string>>"


def json_row(read, text: str) -> dict:
    """``read`` of a parsed document; what isn't JSON is not ok. What ``read`` itself can't bear is raised."""
    try:
        x = json.loads(text)
    except (ValueError, RecursionError):
        return read(None) | {"ok": False}
    return read(x)


def json_row_or_not(read, text: str) -> dict:
    """The same for a column, where a document that ``read`` can't bear is not ok."""
    try:
        return json_row(read, text)
    except Exception:
        return read(None) | {"ok": False}


def as_text(data: Column) -> Column:
    """UTF-8 with replacement of what isn't."""
    return F.pandas_udf(_utf8, "string")(data)


def _utf8(data: pd.Series) -> pd.Series:
    return data.map(lambda b: bytes(b).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"), na_action="ignore")


def config_rules(at: DataFrame) -> list[DataFrame]:
    """at: location and ``x``, the facts of a config."""
    urls = [rule("CFG-003", F.array_contains("x.urls", k), "MEDIUM", "metadata", "medium", k) for k in ("quantization_config", "auto_map", "architectures")]
    return [
        emit(
            at,
            rule("CFG-000", "not x.ok", "LOW", "metadata"),
            rule("CFG-001", "x.auto_map is not null", "HIGH", "execution", evidence=F.array("x.auto_map")),
            rule("CFG-002", "x.custom is not null", "HIGH", "execution", evidence=F.array("x.custom")),
            *urls,
        )
    ]


def judged_templates(rows: DataFrame) -> DataFrame:
    """rows: path_in_file, value. Adds is_key, has_mark and token (the first hint found, or an empty string)."""
    key = F.lit(False)
    for k in K.TEMPLATE_KEYS:
        key = key | F.lower("path_in_file").contains(k)
    return rows.withColumn("is_key", key).withColumn("has_mark", F.col("value").rlike(K.TEMPLATE_MARK)).withColumn("token", F.regexp_extract("value", K.TEMPLATE_HINT, 0))


def is_template(name: str) -> bool:
    return name.lower() in K.TEMPLATE_FILES or name.lower().endswith(".jinja")


def template_row(name: str, text: str) -> dict:
    """ok and leaves of a template file; a Jinja file is one leaf."""
    text = text[: 4 << 20]
    if name.lower().endswith(".jinja"):
        return {"ok": True, "leaves": [{"path": "<file>", "value": text}]}
    return json_row(lambda x: {"ok": True, "leaves": leaves(x)}, text)


def template_findings(rows: DataFrame) -> list[DataFrame]:
    """TPL-001 to 003. rows: target_id, location, ok and leaves of template files."""
    bad = rows.select("target_id", "location", F.lit("").alias("path_in_file"), F.lit("").alias("value"), F.lit(True).alias("bad")).where(~F.col("ok"))
    inside = rows.select("target_id", "location", F.explode("leaves").alias("l")).select("target_id", "location", F.col("l.path").alias("path_in_file"), F.col("l.value").alias("value"), F.lit(False).alias("bad"))
    key = F.concat(F.lit("key="), F.col("path_in_file"))
    return [
        emit(
            judged_templates(inside.unionByName(bad)),
            rule("TPL-001", "(is_key or has_mark) and token <> ''", "CRITICAL", "execution", evidence=F.array(key, F.concat(F.lit("token="), F.col("token")), F.substring("value", 1, 300))),
            rule("TPL-002", "token = '' and is_key and has_mark", "INFO", "metadata", evidence=F.array(key, F.concat(F.lit("length="), F.length("value").cast("string")))),
            rule("TPL-003", "bad", "LOW", "metadata", "medium"),
        )
    ]


def line_flags(lines: DataFrame) -> DataFrame:
    """lines: line. Adds hit (shell escape or process call) and severe (a download piped to an interpreter, or decoded and evaluated)."""
    s = F.col("line")
    hit = s.startswith("!") | s.startswith("%%bash") | s.startswith("%sx") | s.contains("os.system") | s.contains("subprocess") | s.contains("curl ") | s.contains("wget ")
    piped = s.contains("| sh") | s.contains("|sh") | s.contains("| bash") | s.contains("|bash") | s.contains("| python")
    return lines.withColumn("hit", hit).withColumn("severe", ((s.contains("curl") | s.contains("wget")) & piped) | (s.contains("eval(") & s.contains("b64decode")))


def notebook_findings(at: DataFrame) -> list[DataFrame]:
    """NB-001: one for each notebook with a hit. at: target_id, location and ``lines``, of a code cell each."""
    flat = line_flags(at.select("target_id", "location", F.posexplode("lines").alias("at", "l")).select("target_id", "location", "at", "l.cell", "l.line"))
    shown = F.when(F.col("hit"), F.struct("at", F.concat(F.lit("cell "), F.col("cell").cast("string"), F.lit(": "), F.substring("line", 1, 120)).alias("text")))
    per = flat.groupBy("target_id", "location").agg(F.max("hit").alias("hit"), F.max("severe").alias("severe"), F.array_sort(F.collect_list(shown)).alias("shown")).where("hit")
    return [emit(per, rule("NB-001", F.lit(True), F.when(F.col("severe"), "HIGH").otherwise("MEDIUM"), "execution", F.when(F.col("severe"), "high").otherwise("medium"), evidence=F.slice(F.transform("shown", lambda x: x["text"]), 1, 6)))]


def keras_findings(at: DataFrame) -> list[DataFrame]:
    """KRS-001 to 003. at: target_id, location and ``x``, the facts of members named config.json."""
    at = at.where("x.ok")
    custom = at.select("target_id", "location", F.explode("x.modules").alias("m"))
    return [
        emit(at, rule("KRS-001", "x.has_lambda", "HIGH", "execution"), rule("KRS-002", "x.has_builtins", "HIGH", "execution", "medium")),
        emit(custom, rule("KRS-003", F.lit(True), "HIGH", "execution", detail=F.col("m.module"), evidence=F.array(F.concat(F.lit("module="), F.col("m.module")), F.concat(F.lit("name="), F.col("m.name"))))),
    ]


def index_row(x: object) -> dict:
    """Shards that an index names."""
    named = x.get("weight_map") if isinstance(x, dict) else None
    return {"shards": sorted({str(v) for v in named.values()}) if isinstance(named, dict) else []}


def index_drift(indexes: DataFrame, files: DataFrame) -> DataFrame:
    """REPO-007, an extension that is off by default: shards that an index file names and the directory lacks. indexes: facts; files: target_id, path."""
    named = indexes.select("target_id", "location", F.explode("shards").alias("shard"))
    here = files.select("target_id", base_name(F.col("path")).alias("shard")).distinct()
    return emit(named.join(here, ["target_id", "shard"], "left_anti"), rule("REPO-007", F.lit(True), "MEDIUM", "integrity", detail=F.col("shard")))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """docs: id, text of JSON documents. (id, path, value) of every string leaf; what isn't JSON gives none."""
    return docs.select("id", F.explode(json_leaves("text")["leaves"]).alias("l")).select("id", "l.path", "l.value")

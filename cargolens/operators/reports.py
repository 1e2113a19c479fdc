"""Reports: JSON, SARIF and CycloneDX as one document per target, built in the cluster; text and HTML of one target."""

from __future__ import annotations

import html
import textwrap

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.content import outer_path
from ..model import SEVERITIES, severity_rank

TOOL = "cargolens"
_LEVELS = {"CRITICAL": ("error", "9.5"), "HIGH": ("error", "7.5"), "MEDIUM": ("warning", "5.0"), "LOW": ("note", "3.0"), "INFO": ("note", "0.0")}


def titled(findings: DataFrame) -> DataFrame:
    return findings.join(F.broadcast(rules.catalogue(findings.sparkSession).select("rule_id", "title")), "rule_id", "left").withColumn("title", F.coalesce("title", "rule_id"))


def _level(i: int) -> Column:
    return F.create_map(*[F.lit(x) for s in SEVERITIES for x in (s, _LEVELS[s][i])])[F.col("severity")]


def _sorted(columns: list) -> Column:
    """A struct that sorts by severity, rule and location, all falling; its last field is the content."""
    return F.struct(severity_rank(F.col("severity")).alias("_r"), "rule_id", "location", "detail", *columns)


def _listed(findings: DataFrame, content: Column, name: str) -> DataFrame:
    per = findings.groupBy("target_id").agg(F.sort_array(F.collect_list(_sorted([content.alias("x")])), asc=False).alias("l"))
    return per.select("target_id", F.transform("l", lambda r: r["x"]).alias(name))


def first_of_rule(findings: DataFrame) -> DataFrame:
    """(target_id, rule_id, severity, category, title, detail) of the first finding of each rule in report order."""
    order = F.struct(severity_rank(F.col("severity")), "location", "detail")
    return titled(findings).groupBy("target_id", "rule_id").agg(*[F.max_by(c, order).alias(c) for c in ("severity", "category", "title", "detail")])


def json_report(findings: DataFrame, files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(target_id, document)."""
    shown = F.struct("rule_id", "title", "severity", "category", "confidence", "location", "detail", "evidence")
    f = _listed(titled(findings), shown, "findings")
    listed = files.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("path", "size", "format", "sha256"))).alias("files"))
    doc = verdicts.join(f, "target_id", "left").join(listed, "target_id", "left")
    empty = doc.withColumn("findings", F.coalesce("findings", F.array()))
    return empty.select("target_id", F.to_json(F.struct(F.lit(TOOL).alias("tool"), F.col("target_id").alias("target"), "verdict", "score", "max_severity", "exit_code", "findings", "files")).alias("document"))


SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def sarif_rule() -> Column:
    """Of the first finding of a rule."""
    return F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct("category", _level(1).alias("security-severity")).alias("properties"))


def sarif_result() -> Column:
    message = F.substring(F.concat_ws(": ", "title", F.when(F.col("detail") != "", F.col("detail"))), 1, 2000)
    place = F.array(F.struct(F.struct(F.struct(outer_path(F.col("location")).alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    return F.struct(F.col("rule_id").alias("ruleId"), _level(0).alias("level"), F.struct(message.alias("text")).alias("message"), place.alias("locations"), F.struct("severity", "confidence", "evidence").alias("properties"))


def sarif(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, document): SARIF 2.1.0; a rule is described by its first finding."""
    per_rule = first_of_rule(findings).groupBy("target_id").agg(F.array_sort(F.collect_list(sarif_rule())).alias("rules"))
    out = targets.select("target_id").distinct().join(per_rule, "target_id", "left").join(_listed(titled(findings), sarif_result(), "results"), "target_id", "left")
    out = out.withColumn("results", F.coalesce("results", F.array())).withColumn("rules", F.coalesce("rules", F.array()))
    run = F.struct(F.struct(F.struct(F.lit(TOOL).alias("name"), "rules").alias("driver")).alias("tool"), "results")
    return out.select("target_id", F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def cyclonedx_file() -> Column:
    hashes = F.when(F.col("sha256").isNotNull(), F.array(F.struct(F.lit("SHA-256").alias("alg"), F.col("sha256").alias("content"))))
    return F.struct(F.concat(F.lit("file:"), "path").alias("bom-ref"), F.lit("file").alias("type"), F.col("path").alias("name"), hashes.alias("hashes"))


def cyclonedx_flaw() -> Column:
    rating = F.array(F.struct(F.lower("severity").alias("severity"), F.lit("other").alias("method")))
    return F.struct(F.col("rule_id").alias("id"), F.concat_ws(":", F.lit("finding"), "rule_id", "location").alias("bom-ref"), F.col("title").alias("description"), rating.alias("ratings"), F.array(F.struct(F.concat(F.lit("file:"), outer_path(F.col("location"))).alias("ref"))).alias("affects"))


def cyclonedx(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(target_id, document): a CycloneDX 1.6 bill of the model and its files, findings as vulnerabilities."""
    parts = files.groupBy("target_id").agg(F.array_sort(F.collect_list(cyclonedx_file())).alias("files"))
    out = parts.join(_listed(titled(findings), cyclonedx_flaw(), "vulnerabilities"), "target_id", "left")
    model = F.struct(F.concat(F.lit("model:"), "target_id").alias("bom-ref"), F.lit("machine-learning-model").alias("type"), F.col("target_id").alias("name"))
    with_hashes = F.struct(model["bom-ref"].alias("bom-ref"), model["type"].alias("type"), model["name"].alias("name"), F.lit(None).cast("array<struct<alg:string,content:string>>").alias("hashes"))
    bom = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.lit(1).alias("version"), F.struct(model.alias("component")).alias("metadata"), F.concat(F.array(with_hashes), F.col("files")).alias("components"), F.coalesce("vulnerabilities", F.array()).alias("vulnerabilities"))
    return out.select("target_id", F.to_json(bom).alias("document"))


def format_histogram(files: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` commonest formats of all files."""
    return files.groupBy("format").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "format").limit(n)


def largest_files(files: DataFrame, n: int = 200) -> DataFrame:
    return files.orderBy(F.desc("size"), "path").limit(n)


def text_report(findings: DataFrame, verdicts: DataFrame, target: str, verbose: bool = False) -> str:
    """Of one target, for reading: all of its findings, put together on the driver."""
    v = verdicts.where(F.col("target_id") == target).first()
    rows = titled(findings.where(F.col("target_id") == target)).orderBy(severity_rank(F.col("severity")).desc(), F.desc("rule_id"), F.desc("location")).collect()
    lines = [f"{target}: {v.verdict}, score {v.score} of 100", ""]
    for s in reversed(SEVERITIES):
        group = [r for r in rows if r.severity == s]
        if group and s == "INFO" and not verbose:
            lines.append(f"{len(group)} informational findings are not shown")
            continue
        for r in group:
            lines.append(f"[{s}] {r.rule_id} {r.title}{' (new)' if r.asDict().get('is_new') else ''}")
            lines.append(f"    {r.location}")
            lines += [f"    {x}" for x in textwrap.wrap(r.detail or "", 66)]
            lines += [f"    - {e[:150]}" for e in (r.evidence or [])[:4]]
    return "\n".join(lines if rows else [*lines, "No findings."])


def html_report(findings: DataFrame, files: DataFrame, verdicts: DataFrame, target: str) -> str:
    """The same as a page, with the largest files."""
    v = verdicts.where(F.col("target_id") == target).first()
    rows = titled(findings.where(F.col("target_id") == target)).orderBy(severity_rank(F.col("severity")).desc(), F.desc("rule_id"), F.desc("location")).collect()
    esc = html.escape
    cards = "".join(f"<section class={r.severity.lower()!r}><h2>{esc(r.rule_id)} {esc(r.title)}</h2><p>{esc(r.location)}</p><p>{esc(r.detail or '')}</p><ul>{''.join(f'<li>{esc(e[:300])}</li>' for e in (r.evidence or [])[:6])}</ul></section>" for r in rows)
    table = "".join(f"<tr><td>{esc(f.path)}</td><td>{f.size}</td><td>{esc(f.format)}</td></tr>" for f in largest_files(files.where(F.col("target_id") == target)).collect())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(target)}</title></head><body><h1>{esc(target)}: {esc(v.verdict)} ({v.score})</h1>{cards}<table>{table}</table></body></html>"

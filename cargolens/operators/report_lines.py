"""Reports as lines: a document of any length is rows in order, so that no task holds a target's whole report.

A row is (target_id, section, element, r, rule, place, detail, text): within a target, lines stand by section, then
by ``r`` and by the three names, all falling. Elements of a section are those of a JSON list, between which the
writer puts commas. ``sources.document_parts`` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import outer_path
from ..model import SEVERITIES, severity_rank, union
from . import reports

COLUMNS = ("target_id", "section", "element", "r", "rule", "place", "detail", "text")


def _lines(df: DataFrame, section: int, text: Column, element: bool = False, r: Column | int = 0, rule: Column | str = "", place: Column | str = "", detail: Column | str = "") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("target_id", F.lit(section).alias("section"), F.lit(element).alias("element"), lit(r).cast("int").alias("r"), *[F.coalesce(lit(x), F.lit("")).alias(n) for n, x in (("rule", rule), ("place", place), ("detail", detail))], text.alias("text"))


def _found(findings: DataFrame, section: int, text: Column, element: bool = True) -> DataFrame:
    return _lines(findings, section, text, element, severity_rank(F.col("severity")), F.col("rule_id"), F.col("location"), F.col("detail"))


def _json(**fields: Column) -> Column:
    """An object's text without its closing brace."""
    return F.regexp_replace(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"}), r"\}$", "")


def json_lines(findings: DataFrame, files: DataFrame, verdicts: DataFrame) -> DataFrame:
    head = _json(tool=F.lit(reports.TOOL), target=F.col("target_id"), **{c: F.col(c) for c in ("verdict", "score", "max_severity", "exit_code")})
    shown = F.to_json(F.struct("rule_id", "title", "severity", "category", "confidence", "location", "detail", "evidence"))
    return union([
        _lines(verdicts, 0, F.concat(head, F.lit(',"findings":['))),
        _found(reports.titled(findings), 1, shown),
        _lines(verdicts, 2, F.lit('],"files":[')),
        _lines(files, 3, F.to_json(F.struct("path", "size", "format", "sha256")), True, place=F.col("path")),
        _lines(verdicts, 4, F.lit("]}")),
    ])


def sarif_lines(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    rules = reports.first_of_rule(findings)
    return union([
        _lines(verdicts, 0, F.lit(f'{{"$schema":"{reports.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{reports.TOOL}","rules":[')),
        _lines(rules, 1, F.to_json(reports.sarif_rule()), True, rule=F.col("rule_id")),
        _lines(verdicts, 2, F.lit(']}},"results":[')),
        _found(reports.titled(findings), 3, F.to_json(reports.sarif_result())),
        _lines(verdicts, 4, F.lit("]}]}")),
    ])


def cyclonedx_lines(findings: DataFrame, files: DataFrame, verdicts: DataFrame) -> DataFrame:
    model = F.struct(F.concat(F.lit("model:"), "target_id").alias("bom-ref"), F.lit("machine-learning-model").alias("type"), F.col("target_id").alias("name"))
    head = F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.6","version":1,"metadata":{"component":'), F.to_json(model), F.lit('},"components":['))
    return union([
        _lines(verdicts, 0, head),
        _lines(verdicts, 1, F.to_json(model), True, r=1),
        _lines(files, 1, F.to_json(reports.cyclonedx_file()), True, place=F.col("path")),
        _lines(verdicts, 2, F.lit('],"vulnerabilities":[')),
        _found(reports.titled(findings), 3, F.to_json(reports.cyclonedx_flaw())),
        _lines(verdicts, 4, F.lit("]}")),
    ])


def text_lines(findings: DataFrame, files: DataFrame, verdicts: DataFrame, errors: DataFrame | None = None, verbose: bool = False) -> DataFrame:
    """For reading: verdict, formats, findings by severity with where and why, errors."""
    f = reports.titled(findings)
    rank = severity_rank(F.col("severity"))
    per = files.groupBy("target_id", "format").agg(F.count(F.lit(1)).alias("n")).groupBy("target_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "format"))), 1, 10).alias("l"))
    formats = F.concat(F.lit("formats: "), F.array_join(F.transform("l", lambda x: F.concat(x["format"], F.lit(" "), (-x["n"]).cast("string"))), ", "))
    counts = F.concat_ws(", ", *[F.concat(F.col(f"n_{s.lower()}").cast("string"), F.lit(f" {s}")) for s in reversed(SEVERITIES)])
    # lines of up to 66 characters, broken at spaces where there are any
    wrapped = F.when(F.col("detail") != "", F.regexp_replace(F.concat(F.lit("    "), F.trim("detail")), r"(\S.{0,65})(?:\s+|$)(?=\S)", "$1\n    "))
    evidence = F.transform(F.slice(F.coalesce("evidence", F.array()), 1, 4), lambda e: F.concat(F.lit("    - "), F.substring(e, 1, 150)))
    block = F.array_join(F.concat(F.array(F.concat(F.lit("["), "severity", F.lit("] "), "rule_id", F.lit(" "), "title"), F.concat(F.lit("    "), "location"), wrapped), evidence, F.array(F.when(F.col("confidence") != "high", F.concat(F.lit("    confidence: "), "confidence")))), "\n")
    out = [
        _lines(verdicts, 0, F.concat(F.col("target_id"), F.lit(": "), "verdict", F.lit(", score "), F.col("score").cast("string"), F.lit(" of 100\n"), counts)),
        _lines(per, 1, formats),
        _lines(verdicts.where(sum(F.col(f"n_{s.lower()}") for s in SEVERITIES) == 0), 2, F.lit("No findings.")),
        _found(f if verbose else f.where("severity <> 'INFO'"), 3, block, False),
    ]
    if not verbose:
        out.append(_lines(verdicts.where("n_info > 0"), 4, F.concat(F.col("n_info").cast("string"), F.lit(" informational findings are not shown"))))
    if errors is not None:
        out.append(_lines(errors, 5, F.concat(F.lit("not read: "), "path", F.lit(": "), "error"), place=F.col("path")))
    return union(out)


def _escaped(c: Column | str) -> Column:
    out = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def html_lines(findings: DataFrame, files: DataFrame, verdicts: DataFrame, largest: int = 200) -> DataFrame:
    """The same as a page, with the largest files."""
    from pyspark.sql import Window

    by_size = Window.partitionBy("target_id").orderBy(F.desc("size"), "path")
    top = files.withColumn("_n", F.row_number().over(by_size)).where(F.col("_n") <= largest)
    items = F.array_join(F.transform(F.slice(F.coalesce("evidence", F.array()), 1, 6), lambda e: F.concat(F.lit("<li>"), _escaped(F.substring(e, 1, 300)), F.lit("</li>"))), "")
    card = F.concat(F.lit("<section class='"), F.lower("severity"), F.lit("'><h2>"), _escaped("rule_id"), F.lit(" "), _escaped("title"), F.lit("</h2><p>"), _escaped("location"), F.lit("</p><p>"), _escaped("detail"), F.lit("</p><ul>"), items, F.lit("</ul></section>"))
    name = _escaped("target_id")
    head = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), name, F.lit("</title></head><body><h1>"), name, F.lit(": "), _escaped("verdict"), F.lit(" ("), F.col("score").cast("string"), F.lit(")</h1>"))
    row = F.concat(F.lit("<tr><td>"), _escaped("path"), F.lit("</td><td>"), F.col("size").cast("string"), F.lit("</td><td>"), _escaped("format"), F.lit("</td></tr>"))
    return union([
        _lines(verdicts, 0, head),
        _found(reports.titled(findings), 1, card, False),
        _lines(verdicts, 2, F.lit("<table>")),
        _lines(top, 3, row, r=-F.col("_n")),
        _lines(verdicts, 4, F.lit("</table></body></html>")),
    ])

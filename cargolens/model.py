"""Relations that the operators exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARTIFACTS = "target_id string, path string, name string, ext string, size long, content binary"
FINDING_COLUMNS = ("target_id", "rule_id", "severity", "category", "confidence", "location", "detail", "evidence")

#: Severities, lowest first; a severity's rank is its place.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns, each computed once per row.

    They come out of a generator over one element. The optimizer copies a projection's expressions
    into every filter and rule that names them, and formats are named by dozens; it doesn't look
    through a generator."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_fixed")
    return df.select(*rest, one).select(*rest, *[F.col(f"_fixed.`{n}`").alias(n) for n in columns])


def rule(rule_id: str, when: str | Column, severity: str | Column, category: str, confidence: str | Column = "high", detail: str | Column = "", evidence: Column | None = None) -> Column:
    """What a rule finds in a row: a struct, or null where it doesn't apply. ``when`` is a condition, or SQL for one."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    found = F.struct(
        F.lit(rule_id).alias("rule_id"),
        as_column(severity).alias("severity"),
        F.lit(category).alias("category"),
        as_column(confidence).alias("confidence"),
        F.coalesce(as_column(detail).cast("string"), F.lit("")).alias("detail"),
        (evidence if evidence is not None else F.array()).cast("array<string>").alias("evidence"),
    )
    return F.when(F.expr(when) if isinstance(when, str) else when, found)


def emit(facts: DataFrame, *rules: Column, location: str = "location") -> DataFrame:
    """The findings of all ``rules`` over the same facts, in one pass over them."""
    found = facts.select("target_id", F.col(location).alias("location"), F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r"))
    return found.select("target_id", "r.rule_id", "r.severity", "r.category", "r.confidence", "location", "r.detail", "r.evidence")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

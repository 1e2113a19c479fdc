"""From findings to a verdict: analyzer choice, baseline, policy, score."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import knowledge as K
from ..functions.content import outer_path
from ..model import SEVERITIES, severity_rank

#: Analyzer by rule prefix.
ANALYZERS = {
    "pickle": ["FMT", "PKL"], "archive": ["ZIP", "ENG"], "keras": ["KRS", "H5"], "tensors": ["STF", "NPY", "GGUF"], "graph": ["ONX", "TF"], "code": ["PY", "NB"],
    "config": ["CFG"], "templates": ["TPL"], "repository": ["REPO", "FILE", "LFS"], "provenance": ["SIG"], "naming": ["SQT"], "hub": ["PRV"],
}


@dataclass(frozen=True)
class Policy:
    fail_on: str = "HIGH"
    block_score: int = 60
    review_score: int = 20
    allow_pickle: bool = False
    allow_remote_code: bool = False
    allowlist_repos: frozenset[str] = field(default_factory=frozenset)
    ignore_rules: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def from_dict(cls, d: dict) -> Policy:
        fail_on = str(d.get("fail_on", "HIGH")).upper()
        if fail_on not in SEVERITIES:
            raise ValueError(f"fail_on: {fail_on} is no severity")
        return cls(fail_on, int(d.get("block_score", 60)), int(d.get("review_score", 20)), bool(d.get("allow_pickle", False)), bool(d.get("allow_remote_code", False)), frozenset(d.get("allowlist_repos", ())), frozenset(d.get("ignore_rules", ())))

    @classmethod
    def from_json(cls, text: str) -> Policy:
        return cls.from_dict(json.loads(text))


def prefix(rule: Column) -> Column:
    return F.substring_index(rule, "-", 1)


def choose_analyzers(findings: DataFrame, only: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    wanted = [p for a, ps in ANALYZERS.items() for p in ps if (not only or a in only) and a not in (skip or ())]
    return findings.where(prefix(F.col("rule_id")).isin(*wanted))


def baseline_keys(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with ``_sha``: the hash of the file they are about, or an empty string. files: target_id, path, sha256."""
    hashes = files.where("sha256 is not null").select("target_id", F.col("path").alias("_file"), F.col("sha256").alias("_sha")).dropDuplicates(["target_id", "_file"])
    keyed = findings.withColumn("_file", outer_path(F.col("location"))).join(hashes, ["target_id", "_file"], "left").drop("_file")
    return keyed.withColumn("_sha", F.coalesce("_sha", F.lit("")))


def new_findings(findings: DataFrame, files: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose (rule, location, hash) the baseline lacks, marked ``is_new``. baseline: rule_id, location, sha256."""
    known = baseline.select("rule_id", "location", F.coalesce("sha256", F.lit("")).alias("_sha")).distinct()
    return baseline_keys(findings, files).join(known, ["rule_id", "location", "_sha"], "left_anti").select(*findings.columns, F.lit(True).alias("is_new"))


def as_baseline(findings: DataFrame, files: DataFrame) -> DataFrame:
    return baseline_keys(findings, files).select("rule_id", "location", F.col("_sha").alias("sha256")).distinct()


def apply_policy(findings: DataFrame, policy: Policy) -> DataFrame:
    """Findings that the policy leaves; a target on its allow list has none."""
    gone = set(policy.ignore_rules) | ({"FMT-001"} if policy.allow_pickle else set()) | ({"CFG-001", "PRV-005"} if policy.allow_remote_code else set())
    out = findings.where(~F.col("rule_id").isin(*gone)) if gone else findings
    return out.where(~F.col("target_id").isin(*policy.allowlist_repos)) if policy.allowlist_repos else out


def _lookup(table: dict, key: str) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(key)]


def scores(findings: DataFrame) -> DataFrame:
    """(target_id, score, max_rank, n_*): by severity the factors in falling order, each worth DECAY of the one before.

    Only the number of findings of each (severity, confidence) matters: of n equal ones that follow k
    others the sum is a geometric series, so findings are counted first and a target with any number
    of them is a few rows."""
    return scores_of(counted(findings))


def counted(findings: DataFrame) -> DataFrame:
    """(target_id, severity, confidence, n): all that a score needs of findings."""
    return findings.groupBy("target_id", "severity", "confidence").agg(F.count(F.lit(1)).alias("n"))


def scores_of(counts: DataFrame) -> DataFrame:
    """:func:`scores` from counts; a target's rows of one severity and confidence are added up."""
    counts = counts.groupBy("target_id", "severity", "confidence").agg(F.sum("n").alias("n"))
    factor = F.coalesce(_lookup(K.CONFIDENCE_FACTOR, "confidence"), F.lit(1.0))
    before = Window.partitionBy("target_id", "severity").orderBy(F.desc("factor"), "confidence").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("factor", factor).withColumn("k", F.coalesce(F.sum("n").over(before), F.lit(0)))
    series = F.pow(F.lit(K.DECAY), F.col("k")) * (1 - F.pow(F.lit(K.DECAY), F.col("n"))) / (1 - K.DECAY)
    ranked = ranked.withColumn("part", _lookup(K.SEVERITY_WEIGHT, "severity") * F.col("factor") * series).withColumn("rank", severity_rank(F.col("severity")))
    per = [F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(f"n_{s.lower()}") for s in reversed(SEVERITIES)]
    # a sum that differs from a half in its last bits is that half
    total = F.bround(F.round(F.sum("part"), 9), 0)
    return ranked.groupBy("target_id").agg(F.least(total, F.lit(100.0)).cast("int").alias("score"), F.max("rank").alias("max_rank"), *per)


def verdicts(findings: DataFrame, targets: DataFrame, policy: Policy = Policy(), errors: DataFrame | None = None) -> DataFrame:
    """A row for each target: score, max_severity, counts, verdict and exit_code. errors: target_id of files that couldn't be read."""
    return verdicts_of(scores(apply_policy(findings, policy)), targets, policy, errors)


def verdicts_of(s: DataFrame, targets: DataFrame, policy: Policy = Policy(), errors: DataFrame | None = None) -> DataFrame:
    """The same from ``scores``."""
    out = targets.select("target_id").distinct().join(s, "target_id", "left").fillna(0)
    listed = F.col("target_id").isin(*policy.allowlist_repos) if policy.allowlist_repos else F.lit(False)
    fail = SEVERITIES.index(policy.fail_on)
    block = (F.col("max_rank") == 4) | (F.col("score") >= policy.block_score)
    review = (F.col("max_rank") >= fail) | (F.col("score") >= policy.review_score)
    out = out.withColumn("max_severity", F.array(*[F.lit(x) for x in SEVERITIES])[F.col("max_rank")])
    out = out.withColumn("verdict", F.when(listed, "ALLOW (policy allowlist)").when(block, "BLOCK").when(review, "REVIEW").otherwise("ALLOW"))
    code = F.when(F.col("verdict") == "BLOCK", 2).when(F.col("verdict") == "REVIEW", 1).otherwise(0)
    if errors is not None:
        failed = errors.select("target_id").distinct().withColumn("_failed", F.lit(True))
        n = sum((F.col(f"n_{x.lower()}") for x in SEVERITIES), F.lit(0))
        out = out.join(failed, "target_id", "left")
        code = F.when(F.col("_failed") & (n == 0), 3).otherwise(code)
    return out.withColumn("exit_code", code).drop("_failed")


def admitted(verdict_rows: DataFrame) -> DataFrame:
    return verdict_rows.withColumn("admitted", F.col("verdict") != "BLOCK")


def in_order(findings: DataFrame) -> DataFrame:
    """Highest severity first, then rule, location and detail, all falling."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), F.desc("rule_id"), F.desc("location"), F.desc("detail"))

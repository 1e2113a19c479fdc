"""What an audit keeps between runs: reports, baselines, the corpus of names, and policies.

Reports are Parquet tables of (target_id, document), or text files of a document a line; a baseline is
read from the JSON reports of an earlier run. Corpus and policy are small files of their own."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import outer_path
from ..operators import naming
from ..operators.governance import Policy

_REPORT = "findings array<struct<rule_id:string,location:string>>, files array<struct<path:string,sha256:string>>"


def write_documents(documents: DataFrame, path: str, as_text: bool = False) -> None:
    """documents: target_id, document (JSON, SARIF or CycloneDX). With ``as_text`` a document is a line of a text file."""
    if as_text:
        documents.select("document").write.mode("overwrite").text(path)
    else:
        documents.write.mode("overwrite").parquet(path)


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc, d): parsed JSON reports of a table, of text files with one a line, or of ``.json`` files that hold one each."""
    if path.endswith(".json"):
        # one that can't be read must not pass as an empty baseline
        return spark.read.schema(_REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.monotonically_increasing_id().cast("string").alias("doc"), F.struct("findings", "files").alias("d"))
    if any(f.endswith(".parquet") for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).inputFiles()):
        return spark.read.parquet(path).select(F.col("target_id").alias("doc"), F.from_json("document", _REPORT).alias("d"))
    return spark.read.schema(_REPORT).option("mode", "FAILFAST").json(path).select(F.monotonically_increasing_id().cast("string").alias("doc"), F.struct("findings", "files").alias("d"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, location, sha256) of the findings in JSON reports: those that ``write_documents`` or ``document_parts`` wrote,
    and ``.json`` reports of other scanners with the same rules, whose ids may have a prefix of their own."""
    doc = _documents(spark, path)
    rule = F.regexp_extract(F.coalesce("f.rule_id", F.lit("")), r"([A-Z0-9]+-[0-9]+[a-z]?)?$", 1)
    found = doc.select("doc", F.explode("d.findings").alias("f")).select("doc", rule.alias("rule_id"), F.coalesce("f.location", F.lit("")).alias("location"))
    hashes = doc.select("doc", F.explode("d.files").alias("f")).where("f.sha256 is not null").select("doc", F.col("f.path").alias("_file"), F.col("f.sha256").alias("sha256")).dropDuplicates(["doc", "_file"])
    keyed = found.withColumn("_file", outer_path(F.col("location"))).join(hashes, ["doc", "_file"], "left")
    return keyed.select("rule_id", "location", F.coalesce("sha256", F.lit("")).alias("sha256")).distinct()


@dataclass(frozen=True)
class Corpus:
    #: kind, name.
    names: DataFrame
    age_days: int | None = None
    error: str | None = None


def write_corpus(names: DataFrame, path: str) -> None:
    """names: ``naming.refreshed_corpus``, some thousand rows; one JSON file with the time of writing."""
    by_kind = {r.kind: sorted(r.names) for r in names.groupBy("kind").agg(F.collect_set("name").alias("names")).collect()}
    Path(path).write_text(json.dumps({"refreshed_at": datetime.now(UTC).isoformat(), "orgs": by_kind.get("org", []), "models": by_kind.get("model", [])}, indent=1) + "\n")


def read_corpus(spark: SparkSession, path: str) -> Corpus:
    """The seed's names and those of a stored file with its age. Without a file the seed alone; with one that can't be read, the seed and an error."""
    seed = naming.seed_corpus(spark)
    if not Path(path).is_file():
        return Corpus(seed)
    try:
        stored = json.loads(Path(path).read_text())
        rows = [(kind, str(n)) for kind, key in (("org", "orgs"), ("model", "models")) for n in stored.get(key) or [] if n]
    except Exception as e:
        return Corpus(seed, error=f"corpus {path} can't be read: {type(e).__name__}: {e}")
    try:
        when = datetime.fromisoformat(str(stored.get("refreshed_at")))
        age = max(0, (datetime.now(UTC) - (when if when.tzinfo else when.replace(tzinfo=UTC))).days)
    except ValueError:
        age = None
    return Corpus(seed.unionByName(spark.createDataFrame(rows, "kind string, name string")).distinct(), age)


def read_policy(path: str | None) -> Policy:
    """A policy from a JSON file, or from YAML where that parser is there; the default one without a path."""
    if not path:
        return Policy()
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("a YAML policy needs PyYAML; use JSON") from e
        return Policy.from_dict(yaml.safe_load(text) or {})
    return Policy.from_json(text)

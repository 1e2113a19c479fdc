"""The whole audit of many targets at once: artifacts in, findings, files, errors and verdicts out."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import union
from ..operators import containers, documents, facts, governance, hub, identify, naming, pickles, repository, source_code, tensors
from ..sources import hub_listing, remote_zip, tree


@dataclass(frozen=True)
class Config:
    policy: governance.Policy = field(default_factory=governance.Policy)
    only: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    hash_files: bool = False
    #: Rules and readings beyond the common set: bytes after STOP, names from the memo, missing shards, zstd; an error for sources that the parser can't bear.
    extensions: bool = False


@dataclass(frozen=True)
class Audit:
    files: DataFrame
    findings: DataFrame
    verdicts: DataFrame
    errors: DataFrame
    #: Tables that the others share and the cluster keeps.
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give the kept tables' room back; results that are read afterwards are computed anew."""
        for df in self.kept:
            df.unpersist()


def wants(config: Config, *analyzers: str) -> bool:
    return any((not config.only or a in config.only) and a not in config.skip for a in analyzers)


def file_facts(known: DataFrame, config: Config = Config()) -> DataFrame:
    """One pass over the content of identified artifacts. Facts are small; they are kept, so that the rules
    of all families share the pass, and a lost part is parsed again from its files."""
    kinds = {k for k, analyzers in facts.ASKED_BY.items() if wants(config, *analyzers)} - (set() if config.extensions else {"index"})
    return facts.extract(known, kinds, config.extensions, config.extensions, config.extensions).persist(StorageLevel.MEMORY_AND_DISK)


def file_findings(known: DataFrame, found: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings of all rules that look into files. known: identified artifacts; found: their facts."""
    of = lambda kind: facts.of(found, kind)
    with_x = lambda kind: found.where(F.col("kind") == kind).select("target_id", "location", F.col(kind).alias("x"))
    out = identify.findings(known) if wants(config, "repository") else []
    if wants(config, "pickle"):
        streams = of("pickle")
        out += pickles.findings(streams, of("import")) + ([pickles.trailing_findings(streams)] if config.extensions else [])
    if wants(config, "archive"):
        out += containers.findings(of("member").drop("location")) + containers.stream_findings(of("stream"))
    if wants(config, "keras"):
        out += documents.keras_findings(with_x("keras"))
    if wants(config, "tensors"):
        out += tensors.safetensors_findings(of("tensor")) + tensors.npy_findings(of("npy"))
    if wants(config, "graph", "keras", "tensors"):
        out += tensors.graph_findings(of("graph"))
    if wants(config, "code"):
        out += source_code.findings(source_code.fact_rows(of("source"))) + documents.notebook_findings(of("notebook"))
    if wants(config, "config"):
        out += documents.config_rules(with_x("config"))
    if wants(config, "templates"):
        out += documents.template_findings(of("template"))
    if config.extensions and wants(config, "repository"):
        out.append(documents.index_drift(of("index"), known))
    out = out or [f.limit(0) for f in identify.findings(known)]
    return governance.choose_analyzers(union(out), list(config.only), list(config.skip))


@dataclass(frozen=True)
class Inspected:
    """What is known of files after the pass over their contents, before rules over whole targets."""

    files: DataFrame
    #: The artifact rows, as those rules read them.
    rows: DataFrame
    facts: DataFrame
    findings: DataFrame
    errors: DataFrame
    kept: tuple[DataFrame, ...]


def inspect(artifacts: DataFrame, config: Config = Config(), by_ranges: bool = False, hashes: bool = False) -> Inspected:
    """Identify and parse files, and judge each by itself."""
    known = identify.identify(artifacts)
    known = known.withColumn("sha256", tree.sha256_of_file() if hashes else F.lit(None).cast("string"))
    known = known.withColumn("_there", F.col("error").isNull() & (F.lit(True) if by_ranges else F.col("content").isNotNull()))
    # what is known of files is kept without their content, so rules about files don't identify them again
    told = known.withColumn("content", F.lit(None).cast("binary")).persist(StorageLevel.MEMORY_AND_DISK)
    # of a table at hand the rows themselves tell what needs no format
    rows = told if by_ranges else artifacts
    could = F.col("_there")
    found = file_facts((told if by_ranges else known).where(could), config)
    failed = facts.of(found, "error").select("target_id", "path", F.col("message").alias("error"))
    errors = rows.where("error is not null").select("target_id", "path", "error").unionByName(failed)
    broken = failed.select("target_id", "path", F.lit(True).alias("_broken")).distinct()
    files = told.join(broken, ["target_id", "path"], "left").select(
        "target_id", "path", "size", F.when(could, F.col("format")).otherwise("unknown").alias("format"),
        F.when(could & F.col("_broken").isNull(), F.col("sha256")).alias("sha256"), (could & F.col("_broken").isNull()).alias("inspected"),
    )
    return Inspected(files, rows, found, file_findings(told.where(could), found, config), errors, (told, found))


def audit(artifacts: DataFrame, config: Config = Config(), identifiers: DataFrame | None = None, repos: DataFrame | None = None, corpus: DataFrame | None = None, corpus_age_days: int | None = None, baseline: DataFrame | None = None, as_of: str = "now", by_ranges: bool = False) -> Audit:
    """artifacts: ``tree.artifacts`` rows. identifiers: target_id, repo_id, for name checks; repos:
    metadata of the same repositories, for provenance rules and for files that a listing lacks; corpus:
    known names, ``corpus_age_days`` old; baseline: rule_id, location, sha256, whose findings are left out.

    With ``by_ranges`` rows hold a file's head alone: formats are told from it, and parsers and hashes read
    the file at ``uri``. What is known of each file is kept without any content, so files are listed and
    identified once. A file that can't be read or parsed is an error of its target, and ends nothing."""
    seen = inspect(artifacts, config, by_ranges, config.hash_files or baseline is not None)
    rows, files = seen.rows, seen.files
    out, names = [seen.findings], []
    if wants(config, "repository", "provenance"):
        rules = union(repository.findings(repository.inventory(rows.where("is_repo")), repository.declared_maps(facts.of(seen.facts, "config"))))
        out.append(governance.choose_analyzers(rules, list(config.only), list(config.skip)))
    if identifiers is not None and wants(config, "naming"):
        out.append(naming.findings(identifiers, corpus if corpus is not None else naming.seed_corpus(artifacts.sparkSession), corpus_age_days, kept=names))
    if repos is not None and wants(config, "hub"):
        out.append(hub.provenance_findings(repos, as_of))
        ids = identifiers.select("target_id", F.col("repo_id").alias("id")) if identifiers is not None else None
        out.append(hub.manifest_drift(rows, repos, ids=ids))
    findings = union(out)
    if baseline is not None:
        findings = governance.new_findings(findings, files, baseline).drop("is_new")
    left = governance.apply_policy(findings, config.policy)
    return Audit(files, left, governance.verdicts(findings, rows, config.policy, seen.errors), seen.errors, (*seen.kept, *names))


def audit_paths(spark: SparkSession, roots: list[str], config: Config = Config(), max_file_mb: int = 4096, max_files: int | None = None, **more) -> Audit:
    return audit(tree.artifacts(spark, roots, max_file_mb, max_files, tree.HEAD_BYTES), config, by_ranges=True, **more)


def audit_hub(repos: DataFrame, config: Config = Config(), as_of: str = "now", corpus: DataFrame | None = None, corpus_age_days: int | None = None, configs: DataFrame | None = None, streams: DataFrame | None = None) -> Audit:
    """The audit of remote repositories from their metadata; ``streams`` (target_id, location, content, and error) are
    pickles read by ranges, as ``remote_zip.remote_pickles`` gives them, and ``configs`` (the same columns) their config.json.
    Repositories with an ``error`` keep what their name tells, and are errors of their targets."""
    lost = repos.where("error is not null").select(F.col("id").alias("target_id"), F.lit("").alias("path"), "error") if "error" in repos.columns else None
    ids = repos.select(F.col("id").alias("target_id"), F.col("id").alias("repo_id"))
    if lost is not None:
        repos = repos.where("error is null")
    known = corpus if corpus is not None else naming.seed_corpus(ids.sparkSession)
    names: list[DataFrame] = []
    out = [naming.findings(ids, known, corpus_age_days, kept=names), hub.provenance_findings(repos, as_of), hub.listing_findings(repos, configs.where("content is not null") if configs is not None else None)]
    if streams is not None:
        out += pickles.findings(pickles.facts(streams.where("content is not null")))
    findings = union(out)
    files = hub.listed_files(repos).withColumn("sha256", F.lit(None).cast("string")).withColumn("inspected", F.lit(False))
    read = [x.where("error is not null").select("target_id", F.col("location").alias("path"), "error") for x in (streams, configs) if x is not None and "error" in x.columns]
    errors = union([*([lost] if lost is not None else []), *read] or [ids.select("target_id", F.lit("").alias("path"), F.lit("").alias("error")).limit(0)])
    return Audit(files, governance.apply_policy(findings, config.policy), governance.verdicts(findings, ids, config.policy, errors), errors, tuple(names))


def audit_hub_online(spark: SparkSession, ids: list[str], config: Config = Config(), endpoint: str = hub_listing.DEFAULT, revision: str = "main", most: int = 6, members: int = 3, **options) -> Audit:
    """From ids to verdicts in one call: metadata, then each repository's config.json and the pickled members of its first
    ``most`` weight files, read by ranges in tasks. What was read is kept, so that the results share one pass over the hub."""
    repos = hub_listing.repositories(spark, ids, endpoint=endpoint, **options).persist(StorageLevel.MEMORY_AND_DISK)
    weights, configs = hub.deep_files(repos.where("error is null"), endpoint, revision, most)
    opener = partial(remote_zip.http_fetch, token=options.get("token"))
    tasks = max(1, min(10_000, len(ids)))
    streams = remote_zip.remote_pickles(weights.repartition(tasks), opener, members).persist(StorageLevel.MEMORY_AND_DISK)
    read = remote_zip.remote_documents(configs.repartition(tasks), opener).persist(StorageLevel.MEMORY_AND_DISK)
    a = audit_hub(repos, config, configs=read, streams=streams)
    return replace(a, kept=(*a.kept, repos, streams, read))

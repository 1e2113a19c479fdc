"""Provenance rules over a table of repository metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import knowledge as K
from ..functions.content import base_name, suffix
from ..model import emit, rule, union
from .identify import format_of_name
from .repository import ends

REPOS = "id string, author string, downloads long, likes long, createdAt string, lastModified string, gated string, disabled boolean, tags array<string>, siblings array<struct<rfilename:string,size:long,lfs:boolean>>"


def age_days(stamp: Column, as_of: Column) -> Column:
    """Whole days since an ISO time; null if it can't be read."""
    return F.floor((as_of.cast("timestamp").cast("double") - F.try_to_timestamp(stamp).cast("double")) / 86400).cast("int")


def _truthy(text: Column) -> Column:
    return F.coalesce(~F.lower(text).isin("", "false", "0", "none", "null"), F.lit(False))


def provenance_findings(repos: DataFrame, as_of: str, bulk: int = 10) -> DataFrame:
    """PRV-001 to 006. as_of: the time that ages are counted to, so that a result can be repeated."""
    by_id = F.when(F.col("id").contains("/"), F.substring_index("id", "/", 1))
    at = repos.withColumn("target_id", F.col("id")).withColumn("location", F.col("id")).withColumn("age", age_days(F.coalesce("createdAt", "lastModified"), F.lit(as_of))).withColumn("publisher", F.coalesce("author", by_id))
    counts = at.where("publisher is not null").groupBy("publisher").agg(F.count(F.lit(1)).alias("published")).where(F.col("published") >= bulk)
    at = at.join(counts, "publisher", "left")
    return emit(
        at,
        rule("PRV-001", "age < 14", "LOW", "provenance", "medium", evidence=F.array(F.coalesce("createdAt", "lastModified"))),
        rule("PRV-002", "coalesce(downloads, 0) < 100 and coalesce(likes, 0) < 5", "LOW", "provenance", "low"),
        rule("PRV-003", _truthy(F.col("gated")), "INFO", "provenance", "low"),
        rule("PRV-004", "disabled", "HIGH", "provenance"),
        rule("PRV-005", "array_contains(tags, 'custom_code')", "MEDIUM", "execution"),
        rule("PRV-006", "age < 30 and published is not null", "MEDIUM", "provenance", "low", evidence=F.array(F.concat(F.lit("author="), "publisher"), F.concat(F.lit("models="), F.col("published").cast("string")))),
    )


def listed_files(repos: DataFrame) -> DataFrame:
    """The inventory rows of remote repositories, with the format that a name suggests."""
    rows = repos.select(F.col("id").alias("target_id"), F.explode("siblings").alias("s")).select("target_id", F.col("s.rfilename").alias("path"), "s.size")
    name = base_name(F.col("path"))
    return rows.withColumn("format", format_of_name(name, suffix(name)))


def deep_files(repos: DataFrame, endpoint: str, revision: str = "main", most: int = 6) -> tuple[DataFrame, DataFrame]:
    """What an audit reads of remote repositories: (target_id, path, url) of the first ``most`` pickled files in the order
    of the listing, and of their config.json."""
    names = F.transform("siblings", lambda s: s["rfilename"])
    url = F.concat(F.lit(endpoint.rstrip("/") + "/"), "target_id", F.lit(f"/resolve/{revision}/"), F.array_join(F.transform(F.split("path", "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/"))
    at = repos.select(F.col("id").alias("target_id"), names.alias("names"))
    weights = at.select("target_id", F.explode(F.slice(F.filter("names", lambda n: ends(n, K.WEIGHT_ENDS_PICKLE)), 1, most)).alias("path")).withColumn("url", url)
    configs = at.where(F.array_contains("names", "config.json")).select("target_id", F.lit("config.json").alias("path")).withColumn("url", url)
    return weights, configs


def listing_findings(repos: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """REPO-001 and REPO-006 from the listing alone, and CFG-001 where ``configs`` (target_id, content) has the repository's config.json."""
    from .documents import as_text, config_facts

    per = listed_files(repos).groupBy("target_id").agg(
        F.max(F.col("path").endswith(".safetensors")).alias("safe"),
        F.slice(F.array_sort(F.collect_set(F.when(ends(F.col("path"), K.WEIGHT_ENDS_PICKLE), F.col("path")))), 1, 8).alias("pickles"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("path").endswith(".py"), F.col("path")))), 1, 8).alias("sources"),
    )
    out = [
        emit(
            per,
            rule("REPO-001", "size(pickles) > 0 and not safe", "MEDIUM", "serialization", evidence=F.col("pickles")),
            rule("REPO-006", "size(sources) > 0", "MEDIUM", "execution", evidence=F.col("sources")),
            location="target_id",
        )
    ]
    if configs is not None:
        x = configs.withColumn("x", config_facts(as_text(F.col("content")))).withColumn("location", F.lit("config.json"))
        out.append(emit(x, rule("CFG-001", "x.auto_map is not null", "HIGH", "execution", evidence=F.array("x.auto_map"))))
    return union(out)


def manifest_drift(local: DataFrame, repos: DataFrame, evidence: int = 12, ids: DataFrame | None = None) -> DataFrame:
    """PRV-007: local files that the repository's listing has under neither their path nor their name. local: target_id,
    path; ids: target_id and the repository's id, by default the same. A repository without a listing says nothing."""
    known = (ids if ids is not None else repos.select(F.col("id").alias("target_id"), "id")).distinct()
    remote = known.join(repos.where("size(siblings) > 0"), "id").select("target_id", F.explode("siblings").alias("s")).select("target_id", F.col("s.rfilename").alias("listed")).distinct()
    name = base_name(F.col("path"))
    ours = local.select("target_id", "path").join(remote.select("target_id").distinct(), "target_id", "left_semi").where(~name.isin(*K.UNLISTED_FILES)).withColumn("name", name)
    by_path = ours.join(remote.withColumnRenamed("listed", "path"), ["target_id", "path"], "left_anti")
    gone = by_path.join(remote.withColumnRenamed("listed", "name"), ["target_id", "name"], "left_anti")
    per = gone.groupBy("target_id").agg(F.min("path").alias("location"), F.slice(F.array_sort(F.collect_set("path")), 1, evidence).alias("paths"))
    return emit(per, rule("PRV-007", F.lit(True), "HIGH", "provenance", "medium", evidence=F.col("paths")))

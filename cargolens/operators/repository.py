"""Rules over all files of a directory: one aggregate per target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import knowledge as K
from ..functions.content import base_name, path_parts_contain
from ..model import emit, rule


def ends(path: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | path.endswith(s)
    return out


def _first(condition: Column, n: int) -> Column:
    """The first n paths that fulfil the condition, in order of name."""
    return F.slice(F.array_sort(F.collect_set(F.when(condition, F.col("path")))), 1, n)


def inventory(files: DataFrame) -> DataFrame:
    """files: target_id, path. A row for each target with what its rules ask for."""
    path, name = F.col("path"), base_name(F.col("path"))
    return files.groupBy("target_id").agg(
        F.max(name.endswith(".safetensors")).alias("has_safetensors"),
        _first(ends(path, K.WEIGHT_ENDS_PICKLE), 8).alias("pickles"),
        _first(path.endswith(".py"), 8).alias("sources"),
        F.max(name == "README.md").alias("has_readme"),
        F.array_sort(F.collect_set(F.when(name.isin(*K.INSTALL_FILES), name))).alias("installers"),
        F.max(ends(path, K.WEIGHT_ENDS)).alias("has_weights"),
        _first(ends(name, K.SIGNATURE_ENDS) | path_parts_contain(path, ".well-known"), 8).alias("signatures"),
    )


def declared_maps(configs: DataFrame) -> DataFrame:
    """Targets whose root config.json names an auto_map. configs: facts of configs."""
    return configs.where("path = 'config.json' and ok and mentions_map").select("target_id").distinct()


def findings(targets: DataFrame, mapped: DataFrame) -> list[DataFrame]:
    """REPO-001 to 005 and SIG-001, 002. targets: ``inventory``; mapped: ``declared_maps``."""
    at = targets.join(mapped.withColumn("mapped", F.lit(True)), "target_id", "left").withColumn("location", F.col("target_id"))
    installs = [rule("REPO-005", F.array_contains("installers", f), "MEDIUM", "file_anomaly", "medium", f, F.array(F.lit(f))) for f in K.INSTALL_FILES]
    return [
        emit(
            at,
            rule("REPO-001", "size(pickles) > 0 and not has_safetensors", "MEDIUM", "serialization", evidence=F.col("pickles")),
            rule("REPO-002", "size(pickles) > 0 and has_safetensors", "LOW", "serialization", evidence=F.col("pickles")),
            rule("REPO-003", "size(sources) > 0 and mapped is null", "MEDIUM", "file_anomaly", "medium", evidence=F.col("sources")),
            rule("REPO-004", "not has_readme", "LOW", "provenance", "low"),
            *installs,
            rule("SIG-001", "size(signatures) > 0", "INFO", "provenance", evidence=F.col("signatures")),
            rule("SIG-002", "size(signatures) = 0 and has_weights", "INFO", "provenance"),
        )
    ]

"""Continuous gates: artifact rows arrive as a stream, verdicts leave as a table.

:func:`gate` judges targets whose rows arrive together. :class:`StatefulGate` judges targets whose files arrive in
any number of batches, in two queries: the first turns each batch's files into a few numbers a target, the second
keeps their sums as state and judges a target whenever they change."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..model import union
from ..operators import facts, governance, repository
from ..operators.governance import admitted
from ..plans.audit import Config, audit, inspect, wants


def gate(arrivals: DataFrame, out: str, checkpoint: str, config: Config = Config()) -> StreamingQuery:
    """Audits each micro-batch of artifact rows and writes its verdicts under its number, so a batch
    that is run again after a failure replaces what it wrote before. A target's rows must arrive together."""

    def judge(batch: DataFrame, number: int) -> None:
        judged = audit(batch, config)
        rows = admitted(judged.verdicts).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{out}/{number:012d}")
        judged.release()

    return arrivals.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_INVENTORY = "has_safetensors boolean, pickles array<string>, sources array<string>, has_readme boolean, installers array<string>, has_weights boolean, signatures array<string>"
#: A target's share of a batch: how many findings of each severity and confidence, errors, and what rules over the target ask for.
PARTIAL = f"target_id string, counts map<string,long>, n_errors long, is_repo boolean, mapped boolean, {_INVENTORY}"
_STATE = f"{PARTIAL}, parts long, settled boolean"
#: Names that an inventory lists for each of its rules.
_LISTED = 8
_FLAGS, _LISTS = ("has_safetensors", "has_readme", "has_weights", "is_repo", "mapped"), ("pickles", "sources", "installers", "signatures")


def partials(arrivals: DataFrame, config: Config = Config()) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """A row for each target of a batch of artifact rows, and the tables to release once it is read."""
    seen = inspect(arrivals, config)
    left = governance.counted(governance.apply_policy(seen.findings, config.policy))
    counts = left.groupBy("target_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "severity", "confidence"), "n"))).alias("counts"))
    failed = seen.errors.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_errors"))
    inventory = repository.inventory(seen.rows.where("is_repo")).withColumn("is_repo", F.lit(True))
    mapped = repository.declared_maps(facts.of(seen.facts, "config")).withColumn("mapped", F.lit(True))
    out = seen.rows.select("target_id").distinct()
    for part in (counts, failed, inventory, mapped):
        out = out.join(part, "target_id", "left")
    return out.select([F.col(f.split(" ")[0]) for f in PARTIAL.split(", ")]), seen.kept


def merged(state: dict | None, part: dict) -> dict:
    """The sums of a target's shares. Lists keep their first names, so the state of a target stays as small as one share."""
    out = state or {"counts": {}, "n_errors": 0, **dict.fromkeys(_FLAGS, False), **{k: [] for k in _LISTS}}
    counts = dict(out["counts"])
    for key, n in (part["counts"] or {}).items():
        counts[key] = counts.get(key, 0) + int(n)
    flags = {k: bool(out[k] or part[k]) for k in _FLAGS}
    lists = {k: sorted({*out[k], *(part[k] if part[k] is not None else ())}) for k in _LISTS}
    return {"counts": counts, "n_errors": out["n_errors"] + int(part["n_errors"] or 0), **flags, **{k: v if k == "installers" else v[:_LISTED] for k, v in lists.items()}}


class _Targets(StatefulProcessor):
    """Sums of a target's shares. A share that comes again, since its batch was run again after a failure, has a number that
    was added already, and is left out. A target is settled once it has been quiet for some time."""

    def __init__(self, quiet_ms: int | None):
        """quiet_ms: none where the query has no timers."""
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "batch long, parts long, sums string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, parts, state = self.sums.get() if self.sums.exists() else (-1, 0, None)
        state = json.loads(state) if state else None
        found = sorted((r for frame in rows for r in frame.to_dict("records")), key=lambda r: r["batch"])
        for r in found:
            if r["batch"] > last:
                # the columns that a target lacks come as NaN
                share = {k: None if isinstance(v, float) and v != v else dict(v) if k == "counts" and v is not None else list(v) if k in _LISTS and v is not None else v for k, v in r.items()}
                state, last, parts = merged(state, share), int(r["batch"]), parts + 1
        self.sums.update((last, parts, json.dumps(state)))
        if self.quiet_ms is not None:
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield self._row(key, state, parts, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sums.exists():
            _, parts, state = self.sums.get()
            yield self._row(key, json.loads(state), parts, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, state: dict, parts: int, settled: bool) -> pd.DataFrame:
        row = {"target_id": key[0], **state, "parts": parts, "settled": settled}
        return pd.DataFrame({f.split(" ")[0]: [row[f.split(" ")[0]]] for f in _STATE.split(", ")})


@dataclass(frozen=True)
class StatefulGate:
    """``work``: a folder that all executors share. Verdicts are those of an audit of all files that a target has so far,
    however they arrived; baselines, names and metadata of a hub are left to the audit."""

    work: str
    config: Config = field(default_factory=Config)
    quiet_seconds: float = 600.0

    def collect(self, arrivals: DataFrame, **trigger) -> StreamingQuery:
        """The first query: artifact rows in, shares of targets out, under their batch's number."""

        def share(batch: DataFrame, number: int) -> None:
            rows, kept = partials(batch, self.config)
            rows.write.mode("overwrite").parquet(f"{self.work}/partials/batch={number}")
            for df in kept:
                df.unpersist()

        return arrivals.writeStream.foreachBatch(share).option("checkpointLocation", f"{self.work}/collecting").trigger(**(trigger or {"availableNow": True})).start()

    def judge(self, spark: SparkSession, **trigger) -> StreamingQuery:
        """The second query: sums as state, a verdict for each target that changed. A query that goes on (``processingTime``)
        also tells when a target has settled; one over what is there (``availableNow``) has no timers, as it wouldn't end."""
        trigger = trigger or {"availableNow": True}
        quiet, mode = (None, "None") if trigger.get("availableNow") or trigger.get("once") else (int(self.quiet_seconds * 1000), "processingTime")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        shares = spark.readStream.schema(f"{PARTIAL}, batch long").parquet(f"{self.work}/partials")
        sums = shares.groupBy("target_id").transformWithStateInPandas(_Targets(quiet), _STATE, "Update", mode)

        def write(batch: DataFrame, number: int) -> None:
            self._verdicts(batch.persist()).withColumn("judged", F.lit(number)).write.mode("overwrite").parquet(f"{self.work}/verdicts/{number:012d}")
            batch.unpersist()

        return sums.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{self.work}/judging").trigger(**trigger).start()

    def _verdicts(self, sums: DataFrame) -> DataFrame:
        # a target may change and settle in one batch
        last = sums.groupBy("target_id").agg(F.max_by(F.struct(*[c for c in sums.columns if c != "target_id"]), F.struct("parts", "settled")).alias("x")).select("target_id", "x.*")
        counts = [last.select("target_id", F.explode("counts").alias("key", "n")).select("target_id", F.split_part("key", F.lit("|"), F.lit(1)).alias("severity"), F.split_part("key", F.lit("|"), F.lit(2)).alias("confidence"), "n")]
        if wants(self.config, "repository", "provenance"):
            rules = union(repository.findings(last.where("is_repo").drop("mapped"), last.where("mapped").select("target_id")))
            chosen = governance.choose_analyzers(rules, list(self.config.only), list(self.config.skip))
            counts.append(governance.counted(governance.apply_policy(chosen, self.config.policy)))
        policy = self.config.policy
        scores = governance.scores_of(union(counts))
        rows = governance.verdicts_of(scores, last, policy, last.where("n_errors > 0").select("target_id"))
        return admitted(rows.join(last.select("target_id", "parts", "settled"), "target_id"))

    def verdicts(self, spark: SparkSession) -> DataFrame:
        """The latest verdict of each target."""
        rows = spark.read.parquet(f"{self.work}/verdicts/*")
        return rows.groupBy("target_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "target_id"]), "judged").alias("x")).select("target_id", "x.*")

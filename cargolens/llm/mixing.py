"""Mixing sources to target weights, with soft membership.

A softmax classifier over hashed byte-pair counts, fitted on labelled documents (at most
``MAX_LABELLED``, those with the smallest hash of their id), gives each document its domain
posteriors p. Nonnegative document rates r then minimise half the squared distance between the
expected domain token totals, sum of r x tokens x p, and the targets, in units of all tokens; a weight
``RIDGE`` on the distance of the rates from 1, by tokens, picks one of the many solutions. In that
metric the gradient of a document is its posteriors times the domains' excess, whatever its tokens, so
gradient steps from 1, projected onto r >= 0 at the end, give ``r = max(0, 1 - p . pull)``: the state is
one number per domain. Each step is scaled by the inverse of the domains' k x k matrix of summed token-
weighted products over documents of positive rate, and cut until the dual objective falls enough, which
makes it converge from anywhere. One aggregate over all documents gives what a step asks for; neither
rates nor documents are collected. The fit ends when the gradient, the violation of the optimality
conditions, is below ``TOLERANCE`` of all tokens; if it isn't after ``STEPS``, that is an error.

A rate becomes whole copies by a draw that hashes the document, so it is repeatable. Null and empty
texts have no tokens and the posteriors of an empty text; repeated rows draw alike; without labelled
rows there is one domain and every rate is 1; a domain whose expected total is 0 is left out of the
targets; an empty table gives no rows; clashing columns of the documents are left alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_LABELLED = 4000
DIMENSIONS = 1024
STEPS = 100
TOLERANCE = 1e-6
#: Weight of the rates' distance from 1 against that of the totals from the targets.
RIDGE = 1e-8
#: Parts of a step that are tried at once.
CUTS = (1.0, 0.5, 0.25, 0.0625, 0.004)
#: Wanted shares of tokens by domain (the language of labelled documents).
TARGETS = {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13}
_SLOT = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.int64)
    out = np.bincount(_SLOT[b[:-1] * 256 + b[1:]], minlength=DIMENSIONS).astype(np.float64) if len(b) > 1 else np.zeros(DIMENSIONS)
    return np.sqrt(out / max(out.sum(), 1))


class Classifier:
    """Softmax regression, fitted by gradient steps with momentum."""

    def __init__(self, x: np.ndarray, y: list[str], steps: int = 300, rate: float = 8.0, decay: float = 1e-4):
        self.domains = sorted(set(y))
        gold = np.eye(len(self.domains))[[self.domains.index(d) for d in y]]
        self.w, self.b = np.zeros((x.shape[1], len(self.domains))), np.zeros(len(self.domains))
        vw, vb = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(steps):
            g = (self.posteriors(x) - gold) / len(x)
            vw, vb = 0.9 * vw - rate * (x.T @ g + decay * self.w), 0.9 * vb - rate * 0.1 * g.sum(0)
            self.w, self.b = self.w + vw, self.b + vb

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w + self.b
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: str = "lang", max_labelled: int = MAX_LABELLED) -> Classifier | None:
    """Of the documents that the labelled table names, with the column ``domain`` as their label."""
    sample = labels.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", "text", F.col(f"`{domain}`").alias("_d")).where("_d is not null").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "d": b["_d"], "x": [features(t).astype(np.float32).tobytes() for t in b.text]})

    rows = sorted(texts.mapInPandas(numbers, "doc_id long, d string, x binary").collect(), key=lambda r: r.doc_id)
    return Classifier(np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(np.float64), [r.d for r in rows]) if rows else None


def with_posteriors(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """``docs`` with ``_m``: tokens (words) and posteriors of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("struct<n:bigint,p:array<double>>")
    def member(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for texts in batches:
            p = [c.posteriors(np.stack([features(t) for t in texts.iloc[i : i + 256]])) if c else np.ones((len(texts.iloc[i : i + 256]), 1)) for i in range(0, len(texts), 256)]
            yield pd.DataFrame({"n": [len((t or "").split()) for t in texts], "p": list(np.concatenate(p)) if p else []})

    return docs.withColumn("_m", member("text"))


def rate(pull: list[float]) -> F.Column:
    """The rate of a row with ``_m``: 1 less its posteriors' share of the domains' pull, not below 0."""
    if not pull:
        return F.lit(1.0)
    terms = [F.col("_m.p")[i] * F.lit(float(x)) for i, x in enumerate(pull)]
    return F.greatest(F.lit(1.0) - sum(terms[1:], terms[0]), F.lit(0.0))


def _sums(members: DataFrame, k: int, tried: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each pull: the domains' totals, the matrix of products over documents of positive rate, and the sum of tokens x rate squared."""
    pulls = np.stack(tried)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(pulls), k + k * k + 1))
        for b in batches:
            n = b.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            for t, pull in enumerate(pulls):
                r = np.maximum(1 - p @ pull, 0)
                out[t] += np.concatenate([(r * n) @ p, (p.T @ (p * (n * (r > 0))[:, None])).ravel(), [(r * r * n).sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["at", "x"])

    sums = members.select("_m.n", "_m.p").mapInArrow(part, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(len(pulls) * (k + k * k + 1))
    for row in sums:  # a few numbers for each pull
        flat[row["at"]] = row.x
    return [(x[:k], x[k:-1].reshape(k, k), float(x[-1])) for x in flat.reshape(len(pulls), -1)]


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], never_drop: bool = False, max_steps: int = STEPS) -> list[float]:
    """The domains' pull on every document's rate. members: rows with ``_m``.

    The targets are shares of the corpus's own tokens; with ``never_drop``, of the smallest total
    that no domain has to shrink for. Targets that no rates meet are met as nearly as they can be."""
    k = len(domains)
    pull = np.zeros(k)
    have, products, square = _sums(members, k, [pull])[0]
    share = np.array([targets.get(d, 0.0) for d in domains]) * (have > 0)
    if k < 2 or share.sum() <= 0:
        return []
    share /= share.sum()
    tokens = have.sum()
    want = share * (np.max(have[share > 0] / share[share > 0]) if never_drop else tokens)
    # the dual objective is (sum n r^2 + ridge |pull|^2) / 2 + pull . want, its gradient want + ridge pull - totals
    ridge = RIDGE * tokens
    now = have
    for _ in range(max_steps):
        gradient = want + ridge * pull - now
        if np.abs(gradient).max() <= TOLERANCE * want.sum():
            return [round(float(x), 9) for x in pull]
        step = -np.linalg.solve(products + ridge * np.eye(k), gradient)
        value = (square + ridge * pull @ pull) / 2 + pull @ want
        tried = [pull + c * step for c in CUTS]
        for c, x, (totals, m, q) in zip(CUTS, tried, _sums(members, k, tried), strict=True):
            if (q + ridge * x @ x) / 2 + x @ want <= value + 1e-4 * c * (gradient @ step) + 1e-12 * abs(value):
                pull, now, products, square = x, totals, m, q
                break
        else:
            pull = tried[-1]
            now, products, square = _sums(members, k, [pull])[0]
    raise RuntimeError(f"mixing rates did not settle in {max_steps} steps: {np.abs(want + ridge * pull - now).max() / want.sum():.1e} of the tokens is left")


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: str = "lang", never_drop: bool = False) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), rate and copies of each document."""
    c = fit_classifier(docs, labels, domain)
    domains = c.domains if c else ["all"]
    members = written(with_posteriors(docs.select("doc_id", "text"), c).select("doc_id", F.xxhash64("text").alias("_h"), "_m"), "mixing-members")
    pull = fit_rates(members, domains, targets, never_drop)
    best = F.array(*[F.lit(d) for d in domains])[(F.array_position(F.col("_m.p"), F.array_max("_m.p")) - 1).cast("int")]
    return members.withColumn("rate", rate(pull)).select("doc_id", F.col("_m.n").alias("n_tokens"), best.alias("domain"), "rate", _copies(F.col("rate"), F.col("_h")).alias("copies"))


def _copies(r: F.Column, text_hash: F.Column) -> F.Column:
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_hash, F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a rate within the fit's tolerance of a whole number is that number
    whole = F.when(F.abs(r - F.round(r)) < 1e-3, F.round(r)).otherwise(r)
    return (F.floor(whole) + (draw < whole - F.floor(whole)).cast("int")).cast("int")


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: str = "lang", never_drop: bool = True) -> DataFrame:
    """``docs`` with each row as often as its copies say; with ``never_drop`` no row goes."""
    c = fit_classifier(docs, labels, domain)
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), "doc_id", "text")
    members = written(with_posteriors(docs.select("text"), c).select("_m"), "mixing-members")
    pull = fit_rates(members, c.domains if c else ["all"], targets, never_drop)
    out = with_posteriors(rows, c).withColumn("_c", _copies(rate(pull), F.xxhash64("text")))
    if never_drop:
        out = out.withColumn("_c", F.greatest("_c", F.lit(1)))
    return out.where("_c > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_i")).select("row.*")

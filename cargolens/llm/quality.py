"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are trigrams of character classes (lower, upper, digit, space, newline, some marks, other,
non-ASCII) of the whole text, with graded indicators for repeated words, repeated lines, length and
word length. Labelled documents give a tf-idf matrix whose truncated SVD spans the latent space.
Their vectors, ``MAX_LABELLED`` at most, are broadcast; each document's vector is compared with all
of them by exact cosine in blocks, and its ``NEIGHBOURS`` nearest ones vote, weighted by similarity.

Fitting uses a bounded sample of labelled rows: the ``MAX_LABELLED`` with the smallest hash of their
id. Only the text is an input of a score. Null and empty texts get the score of an empty text; very long
texts are counted whole; neighbours that tie with the last one vote too; a repeated row gets the same
score again; without any labelled row every score is 0.5; extra columns stay, and clashing ones
(``score``, ``predicted``) are replaced."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

#: Labelled documents that are kept as neighbours; bounds what is collected and broadcast.
MAX_LABELLED = 4000
NEIGHBOURS = 15
DIMENSIONS = 96
#: Weight of a neighbour: its cosine to this power.
SHARPNESS = 32
THRESHOLD = 0.3

#: Bytes whose trigrams are counted at once.
STEP = 1 << 18
_KINDS = 12
_CLASS = np.full(256, 11, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 10
for _kind, _chars in ((3, b" "), (4, b"\n"), (5, b"."), (6, b","), (7, b"!"), (8, b"|"), (9, b"#$%&*@^~=")):
    _CLASS[list(_chars)] = _kind
_GRADES = 10
TERMS = _KINDS**3 + 4 * _GRADES


def _graded(out: np.ndarray, slot: int, x: float) -> None:
    p = min(max(x, 0.0), 1.0) * (_GRADES - 1)
    i = int(p)
    base = _KINDS**3 + slot * _GRADES
    out[base + i] += 1 - (p - i)
    out[base + min(i + 1, _GRADES - 1)] += p - i


def terms(text: str | None) -> np.ndarray:
    text = text or ""
    out = np.zeros(TERMS)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(data) > 2:
        counts = np.zeros(_KINDS**3, np.int64)
        for i in range(0, len(data) - 2, STEP):
            k = _CLASS[data[i : i + STEP + 2]]
            counts += np.bincount(k[:-2] * _KINDS**2 + k[1:-1] * _KINDS + k[2:], minlength=_KINDS**3)
        out[: _KINDS**3] = counts / (len(data) - 2)
    w, lines = text.lower().split(), [x for x in text.split("\n") if x]
    n = max(len(w), 1)
    _graded(out, 0, len(set(w)) / n)
    _graded(out, 1, len(set(lines)) / max(len(lines), 1))
    _graded(out, 2, np.log1p(len(w)) / 10)
    _graded(out, 3, len(text) / n / 15)
    out = np.sqrt(out)
    out[_KINDS**3 :] *= 0.35
    return out.astype(np.float32)


class Model:
    """The projection to the latent space, and the neighbours' vectors and labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dimensions: int = DIMENSIONS):
        idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1
        # right singular vectors are eigenvectors of the terms' products, which are summed over blocks of rows
        products = np.zeros((x.shape[1], x.shape[1]))
        for i in range(0, len(x), 256):
            block = x[i : i + 256] * idf
            products += block.T @ block
        v = np.linalg.eigh(products)[1][:, ::-1]
        self.projection = (idf[:, None] * v[:, :dimensions]).astype(np.float32)
        self.neighbours, self.labels = self.embed(x), y.astype(np.float64)

    def embed(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The share of label 1 in the vote of the nearest ones; all that are as near as the last of them vote too.

        Cosines are rounded to five digits, so that a text scores alike in whatever block it stands."""
        s = np.round((self.embed(x) @ self.neighbours.T).astype(np.float64), 5)
        k = min(neighbours, s.shape[1])
        last = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        row, at = np.nonzero(s >= last[:, None])
        w = np.maximum(s[row, at], 1e-6) ** SHARPNESS
        votes = lambda v: np.bincount(row, v, len(s))
        return np.clip(votes(w * self.labels[at]) / votes(w), 0, 1)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, all_labels: bool = False) -> Model | None:
    """A model of the labelled documents that aren't held out; None if there are none."""
    known = labels.where("quality in (0, 1) and doc_id is not null")
    if not all_labels:
        known = known.where(~held_out())
    sample = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "quality": b.quality, "x": [terms(t).tobytes() for t in b.text]})

    rows = texts.mapInPandas(numbers, "doc_id long, quality int, x binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    if not rows:
        return None
    x, y = np.empty((len(rows), TERMS), np.float32), np.array([r.quality for r in rows])
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r.x, np.float32)
    rows.clear()
    return Model(x, y)


def scored(docs: DataFrame, model: Model | None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with ``score``, 0 to 1."""
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    shared, model_id = docs.sparkSession.sparkContext.broadcast(model), uuid4().hex

    @F.pandas_udf("double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = kept(f"quality {model_id}", lambda: shared.value)
        for texts in batches:
            out = [m.score(np.stack([terms(t) for t in texts.iloc[i : i + 256]]), neighbours) for i in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return docs.withColumn("score", vote("text"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return scored(wrapped, fit(docs, labels)).where(F.col("score") >= threshold).select("row.*")

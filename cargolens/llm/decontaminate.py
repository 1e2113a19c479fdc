"""Benchmark decontamination: word n-grams of test items looked up in training documents.

A word is a run of letters, digits and non-ASCII characters of the text with A-Z lower-cased. An
item gives one window for each ``n`` consecutive words, or one of all its words if it has fewer;
an item without words gives none. A window's hash is a rolling sum over the XXH64 of its words.

Up to ``BROADCAST_WINDOWS`` windows (and ``BROADCAST_CHARS`` of text), the sorted hashes and the items'
words are broadcast as arrays; a task scans each document's rolling hashes against them and compares the
words of every hit. A benchmark beyond that is a table of windows: documents are scanned against a
broadcast bitmap of its hashes (32 MB at most), and only windows that may match are shuffled, by text
digest and not by row, and joined on hash and words; documents without any match aren't shuffled. Both
ways give the same columns.

Edge cases: null and empty texts have no words and are clean; null or empty items give no window;
repeated items count once per ``item_id``; an empty benchmark marks nothing; very long texts are scanned
whole, some tens of bytes for each word; repeated rows get equal results; extra columns of the documents
stay, and a column that has the name of a result column is replaced by it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_bitmap, key_filter, written

#: Windows and characters of benchmark text up to which a benchmark is broadcast.
BROADCAST_WINDOWS, BROADCAST_CHARS = 1_000_000, 32_000_000
#: Tasks that share the candidates of a very common window.
SALTS = 32
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SIEVE = 22
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.LongType()))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def word_hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` words, from the words' hashes."""
    n = len(h) - k + 1
    out = np.full(max(n, 0), k, np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * _MUL + h[j : j + n]
    return out


def item_windows(text: str | None, n: int) -> tuple[list[bytes], int, np.ndarray]:
    """(words, words of a window, hashes of the windows) of an item."""
    w = words(text)
    k = min(n, len(w))
    return w, k, window_hashes(word_hashes(w), k) if k else np.zeros(0, np.uint64)


def hit_spans(n_words: int, places: list[tuple[int, int]]) -> tuple[int, list[int]]:
    """(hit words, [first, end, ...] of the runs of hit words) of windows at (first word, words)."""
    edge = np.zeros(n_words + 1, np.int64)
    for at, k in places:
        edge[at] += 1
        edge[at + k] -= 1
    inside = np.concatenate(([0], np.cumsum(edge[:-1]) > 0, [0])).astype(np.int8)
    return int(inside.sum()), np.flatnonzero(np.diff(inside)).tolist()


class Index:
    """Windows of a benchmark as arrays: for each length the sorted hashes, and where each window stands."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.items, self.text, self.edge = [i for i, _ in items], [], []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, (_, text) in enumerate(items):
            w, k, h = item_windows(text, n)
            self.text.append(b" ".join(w))
            self.edge.append(np.cumsum([0, *(len(x) + 1 for x in w)]).astype(np.int64))
            if k:
                found.setdefault(k, []).append((h, i))
        self.windows = {}
        for k, parts in found.items():
            h = np.concatenate([x for x, _ in parts])
            item = np.repeat(np.array([i for _, i in parts], np.int32), [len(x) for x, _ in parts])
            at = np.concatenate([np.arange(len(x), dtype=np.int32) for x, _ in parts])
            order = np.argsort(h, kind="stable")
            sieve = np.zeros(1 << _SIEVE, bool)
            sieve[h >> np.uint64(64 - _SIEVE)] = True
            self.windows[k] = (h[order], item[order], at[order], sieve)
        self.known: dict[tuple[int, int], dict[bytes, list[str]]] = {}

    def holders(self, k: int, h: int) -> dict[bytes, list[str]]:
        """Items by the words of their windows that have the hash; kept, for a window that is hit once is often hit again."""
        if (k, h) not in self.known:
            hashes, item, at, _ = self.windows[k]
            out: dict[bytes, set[str]] = {}
            first, end = (int(np.searchsorted(hashes, np.uint64(h), side)) for side in ("left", "right"))
            for i, a in zip(item[first:end].tolist(), at[first:end].tolist(), strict=True):
                out.setdefault(self.text[i][self.edge[i][a] : self.edge[i][a + k] - 1], set()).add(self.items[i])
            self.known[k, h] = {t: sorted(s) for t, s in out.items()}
        return self.known[k, h]

    def scan(self, text: str | None) -> tuple[int, int, list[str], list[int]]:
        """Words, hit words, items hit (sorted), and the hit words as flat [first, end, ...] word spans."""
        w = words(text)
        h = word_hashes(w)
        found: set[str] = set()
        places = []
        for k, (hashes, _, _, sieve) in self.windows.items():
            key = window_hashes(h, k)
            at = np.flatnonzero(sieve[key >> np.uint64(64 - _SIEVE)])
            at = at[hashes[np.minimum(np.searchsorted(hashes, key[at]), len(hashes) - 1)] == key[at]]
            for i, x in zip(at.tolist(), key[at].tolist(), strict=True):
                if hit := self.holders(k, x).get(b" ".join(w[i : i + k])):
                    found.update(hit)
                    places.append((i, k))
        n_hit, spans = hit_spans(len(w), places) if places else (0, [])
        return len(w), n_hit, sorted(found), spans


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (ids as strings, sorted) and ``spans`` (hit word ranges)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("passage")).where("passage is not null")
    # a window starts at a word, and words are told apart by signs of one byte
    starts = F.length(F.regexp_replace("passage", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "")) + 1
    size = items.agg(F.sum(starts.cast("long")), F.sum(F.length("passage") + 32)).first()
    if (size[0] or 0) > broadcast_windows or (size[1] or 0) > BROADCAST_CHARS:
        return _joined(docs, items, n)
    shared = docs.sparkSession.sparkContext.broadcast(Index([(r.item, r.passage) for r in items.collect()], n))

    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for texts in batches:
            yield pd.DataFrame([index.scan(t) for t in texts], columns=HITS.names)

    return docs.withColumn("_hits", hits("text")).select(*[c for c in docs.columns if c not in HITS.names], "_hits.*")


def _joined(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The same for a benchmark of any size."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, passage in zip(b.item, b.passage, strict=True):
                w, k, h = item_windows(passage, n)
                rows += [(item, k, x, b" ".join(w[i : i + k])) for i, x in enumerate(h.astype(np.int64).tolist())]
            yield pd.DataFrame(rows, columns=["item", "k", "h", "win"])

    windows = written(items.mapInPandas(cut, "item string, k int, h long, win binary").distinct(), "benchmark-windows")
    lengths = sorted(r.k for r in windows.select("k").distinct().collect())  # at most n numbers
    may = key_bitmap(windows.select(F.col("h").alias("_k")))
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, text in zip(b.digest, b.text, strict=True):
                w = words(text)
                h = word_hashes(w)
                for k in lengths:
                    key = window_hashes(h, k).astype(np.int64)
                    near = np.flatnonzero(may(key))
                    for i in range(0, len(near), 10_000):
                        at = near[i : i + 10_000]
                        yield pd.DataFrame({"digest": [d] * len(at), "n_words": len(w), "at": at, "k": k, "h": key[at], "win": [b" ".join(w[j : j + k]) for j in at.tolist()]})

    given = docs.select(digest.alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    every = given.mapInPandas(starts, "digest binary, n_words long, at int, k int, h long, win binary")
    maybe = written(every.dropDuplicates(["digest", "at", "k"]), "window-candidates")
    # items of the windows that do occur, once for each window however often it does
    seen = maybe.select("k", "h", "win").distinct()
    holders = written(seen.join(windows, ["k", "h", "win"]).groupBy("k", "h", "win").agg(F.collect_set("item").alias("items")), "window-items")
    salted = holders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = maybe.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    hits = dealt.join(salted, ["k", "h", "win", "salt"])
    found = hits.groupBy("digest").agg(F.first("n_words").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"), F.collect_set(F.struct("at", "k")).alias("at"))

    @F.pandas_udf("struct<hit:bigint,spans:array<bigint>>")
    def spans_of(size: pd.Series, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hit_spans(int(s), [(p["at"], p["k"]) for p in a]) for s, a in zip(size, at, strict=True)], columns=["hit", "spans"])

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words(t)) for t in texts], dtype="int64")

    found = written(found.select("digest", "_items", spans_of("n", "at").alias("_x")), "contaminated")
    kept = [c for c in docs.columns if c not in HITS.names]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), digest.alias("digest"), count("text").alias("n_words")).withColumn("_k", F.xxhash64("digest"))
    near = key_filter(found.select(F.xxhash64("digest").alias("_k")))("_k")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    own = [F.col(f"row.`{c}`") for c in kept]
    clean = rows.where(~near).select(*own, "n_words", F.lit(0).cast("long").alias("n_hit"), none("string").alias("items"), none("bigint").alias("spans"))
    # copies of a text are dealt out by their place; any salt meets its match
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    met = rows.where(near).withColumn("salt", salt).join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"], "left")
    return clean.unionByName(met.select(*own, "n_words", F.coalesce("_x.hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("_items", none("string")).alias("items"), F.coalesce("_x.spans", none("bigint")).alias("spans")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents without any hit, with their own columns."""
    keep = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return contamination(keep, benchmark, n).where("n_hit = 0").select("row.*")


def cut_spans(text: str | None, spans: list[int]) -> str | None:
    """``text`` without the words of the spans (flat list of word ranges) and what stands between them."""
    import re

    if text is None or not len(spans):
        return text
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join(out) + text[last:]


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` with the hit passages cut out of ``text``; clean documents are unchanged."""
    keep = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    marked = contamination(keep, benchmark, n)
    return marked.select(*[(F.when(F.col("n_hit") > 0, cut("text", "spans")).otherwise(F.col("text")) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The digest columns of the contract: counts, hash of the item list, and the verdict."""
    found = contamination(docs.select("doc_id", "text"), benchmark, n)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], n: int = 10) -> dict:
    """For tests: the contract's row of each document, by comparing every window with every position."""
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            k = min(n, len(p))
            for j in range(len(p) - k + 1 if k else 0):
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == p[j : j + k]:
                        hit |= set(range(i, i + k))
                        found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out

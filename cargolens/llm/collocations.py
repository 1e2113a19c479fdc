"""Phrase collocations: phrases of two to four words scored by their weakest cut, for each language.

Documents become word numbers in packed blocks (``wordblocks``); only words of ``least`` occurrences or more
have a number, any other breaks a phrase. Lengths are mined in turn, each in one pass over the packed numbers
(about a byte and a half a word): a task counts a block's different phrases in numpy, as far as their shorter
phrases are frequent, packs them by the bucket of their hash and sends each bucket's list to the task that sums
it. What a pass shuffles is at most a row of a list for each occurrence, and what a task holds is one bucket,
whose number grows with the words; so time, disk and memory grow no faster than the input. The parts of a
phrase's cut and the longer phrases around it meet in joins.

A bitmap of bounded size says which shorter phrases are frequent. Where there are so many that it is full, it
lets more occurrences through; the counts are exact at any size.

Null texts are empty, a null ``lang`` is ``und``, repeated rows count again, ids aren't read. A very long
text is cut whole in one task. Ties end with the phrase, so ranks are unique. An empty table, or one without
a frequent phrase, gives no rows. Extra columns and clashing names don't matter: only ``lang`` and ``text``
are read."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_BITS, key_bitmap, numbered, remove, written
from .perfect_hash import mixed
from .wordblocks import BLOCK_CHARS, entries, pack, unpack, with_values, word_blocks

#: Occurrences that a candidate has at least, words of the longest phrase, rows for each language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one around it has this percentage of its occurrences.
INSIDE = 80
#: Occurrences of phrases, on average at most, whose counts one task sums at once (40 bytes each, if all differ).
ROWS_A_BUCKET = 1 << 21
#: Words whose phrases a task holds at once; those whose phrases it counts together; lists that are summed at a time.
STEP, COUNTED, FAN = 1 << 18, 1 << 22, 16

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TOKENS = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
_KEYS = ["a", "b", "c", "d"]
_KEYED = "a int, b int, c int, d int"


def _split() -> Callable[[str], list[bytes]]:
    return lambda text: [*_TOKENS.findall(text.encode("utf-8", "surrogatepass").lower()), b"\n"]


class Length:
    """What tasks need to find the occurrences of phrases of ``k`` words that may be frequent."""

    def __init__(self, k: int, shorter=None):
        #: shorter: a bitmap test of the hashes of frequent phrases of k - 1 words; None for pairs, whose words are frequent.
        self.k, self.shorter = k, shorter

    def occurrences(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """Keys of the phrases as rows of four numbers (0 beyond k), those of about ``COUNTED`` words at a time."""
        for first in range(0, len(ids), COUNTED):
            last = min(first + COUNTED, len(ids))
            keys = np.concatenate([self._at(ids[i : min(i + STEP, last) + self.k - 1]) for i in range(first, last, STEP)])
            if len(keys):
                yield keys

    def _at(self, ids: np.ndarray) -> np.ndarray:
        k, n = self.k, len(ids) - self.k + 1
        if n <= 0:
            return np.zeros((0, LONGEST), np.uint32)
        ok = np.ones(n, bool)
        for i in range(k):
            ok &= ids[i : i + n] > 0
        at = np.flatnonzero(ok)
        if self.shorter is not None and len(at):
            sub = np.zeros((len(ids), LONGEST), np.uint32)
            for i in range(k - 1):
                sub[: len(ids) - i, i] = ids[i:]
            test = np.zeros(len(ids), bool)
            test[at] = test[at + 1] = True
            test = np.flatnonzero(test)
            good = np.zeros(len(ids), bool)
            good[test] = self.shorter(mixed(sub[test], 0).view(np.int64))
            at = at[good[at] & good[at + 1]]
        keys = np.zeros((len(at), LONGEST), np.uint32)
        for i in range(k):
            keys[:, i] = ids[at + i]
        return keys


def _summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in the order of their hashes, the sums of ``n`` (None: 1 each), and the hashes."""
    h = mixed(keys, 0)
    order = np.argsort(h)
    keys, h = keys[order], h[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
    if (new[1:] & (h[1:] == h[:-1])).any():  # different keys of one hash may stand in turns
        again = np.lexsort((*keys.T, h))
        order, keys, h = order[again], keys[again], h[again]
        new[1:] = (keys[1:] != keys[:-1]).any(1)
    first = np.flatnonzero(new)
    total = np.diff(first, append=len(keys)) if n is None else np.add.reduceat(n[order], first)
    return keys[first], total, h[first]


def _packed(keys: np.ndarray, n: np.ndarray, k: int) -> bytes:
    """Keys and counts by column; a count's upper half is a column of its own."""
    return pack(np.concatenate([*keys.T[:k], n & 0xFFFFFFFF, n >> 32]).astype(np.uint32))


def _unpacked(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    columns = unpack(data).reshape(k + 2, -1)
    keys = np.zeros((columns.shape[1], LONGEST), np.uint32)
    keys[:, :k] = columns[:k].T
    return keys, columns[k].astype(np.int64) | columns[k + 1].astype(np.int64) << 32


def _counted(blocks: DataFrame, length: Length, least: int, buckets: int) -> DataFrame:
    """The frequent phrases of a length (a, b, c, d, f, h), written. A block's phrases are a row for each bucket of their hash."""
    k, fan = length.k, FAN

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (x for b in batches for x in b.column(0)):
            for keys in length.occurrences(unpack(data.as_py())):
                # buckets are ranges of the hash, in whose order the keys stand
                keys, n, h = _summed(keys)
                bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
                rows = [_packed(keys[i:j], n[i:j], k) for i, j in zip(starts, [*starts[1:], len(keys)], strict=True)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[starts].astype(np.int32)), "phrases": rows})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for _, same in groupby(rows, lambda x: x[0]):
            some: list[tuple[np.ndarray, np.ndarray]] = []
            held = fresh = 0
            for _, data in same:
                some.append(_unpacked(data.as_py(), k))
                fresh += len(some[-1][1])
                if len(some) > fan and fresh > held:  # at twice what was left, so that sums aren't summed again for every few lists
                    some = [_summed(*map(np.concatenate, zip(*some, strict=True)))[:2]]
                    held, fresh = len(some[0][1]), 0
            keys, f, h = _summed(*map(np.concatenate, zip(*some, strict=True)))
            keys, f, h = keys[f >= least], f[f >= least], h[f >= least]
            yield pa.RecordBatch.from_pydict({**{c: pa.array(keys[:, i].astype(np.int32)) for i, c in enumerate(_KEYS)}, "f": pa.array(f), "h": pa.array(h.view(np.int64))})

    lists = blocks.select("ids").mapInArrow(count, "bucket int, phrases binary")
    tasks = min(buckets, max(64, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return written(lists.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket").mapInArrow(total, f"{_KEYED}, f long, h long"), "frequent")


def _inner(phrases: DataFrame) -> DataFrame:
    """A row for each phrase of two words or more inside a longer one: the longer one's keys (o_a, ...) and f, ``lo`` and ``size`` of the inner one and its keys."""
    of = lambda lo, size: F.struct(F.lit(lo).alias("lo"), F.lit(size).alias("size"), *[F.col(_KEYS[lo + i]).alias(c) if i < size else F.lit(0).alias(c) for i, c in enumerate(_KEYS)])
    of_three = [(0, 2), (1, 2)]
    of_four = [*of_three, (2, 2), (0, 3), (1, 3)]
    parts = F.when(F.col("k") == 3, F.array(*[of(*x) for x in of_three])).otherwise(F.array(*[of(*x) for x in of_four]))
    return phrases.where("k > 2").select(*[F.col(c).alias(f"o_{c}") for c in _KEYS], F.col("f").alias("o_f"), F.explode(parts).alias("x")).select(*[f"o_{c}" for c in _KEYS], "o_f", "x.*")


def mine(docs: DataFrame, least: int = LEAST, rows_a_bucket: int = ROWS_A_BUCKET, buckets: int = MOST_BITS, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """All candidates (lang, phrase, k, a, l, r, score, longer: the most occurrences of a longer candidate around it) and the languages' n.

    ``buckets``: bits of the bitmap of shorter phrases, at most, a power of two."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    blocks = word_blocks(docs.select(F.lit(0).alias("doc_id"), "lang", "text"), key, _split, tuple(bytes([c]) for c in _BREAKS), "phrase-blocks", block_chars)
    words = entries(blocks).groupBy("key", "word").agg(F.sum("n").cast("long").alias("f"), F.count(F.lit(1)).alias("blocks"))
    words = written(words, "phrase-words")
    totals = words.groupBy(F.col("key").alias("lang")).agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least).select("key", "word", "f", "blocks", F.lit(0).alias("tree"))
    frequent = written(numbered(frequent, "tree", [F.col("f").desc(), F.col("key"), F.col("word")]).select("key", "word", "f", "blocks", (F.col("pos") + 1).cast("int").alias("id")), "word-numbers")

    @F.pandas_udf("binary")
    def numbers(slots: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for data, some in zip(slots, at, strict=True):
            s = unpack(data)
            ids = np.zeros(int(s.max()) + 1 if len(s) else 1, np.uint32)
            if some is not None:
                for x in some:
                    ids[x["slot"]] = x["v"]
            out.append(pack(ids[s]))
        return pd.Series(out)

    ids = written(with_values(blocks, frequent, F.col("id")).select(numbers("slots", "at").alias("ids")), "phrase-ids")
    remove(blocks)
    n_words = words.where(F.col("f") >= least).agg(F.sum("f")).first()[0] or 0
    parts = shorter = None
    for k in range(2, LONGEST + 1):
        phrases = _counted(ids, Length(k, shorter), least, max(64, -(-n_words // rows_a_bucket)))
        if not phrases.limit(1).count():
            break
        one = phrases.select(F.lit(k).alias("k"), *_KEYS, "f")
        parts = one if parts is None else parts.unionByName(one)
        if k < LONGEST:
            shorter = key_bitmap(phrases.select(F.col("h").alias("_k")), buckets)
    remove(ids)
    if parts is None:
        return spark.createDataFrame([], "lang string, phrase string, k int, a long, l long, r long, score long, longer long"), totals
    # each phrase inside another one takes the longer one's count and gives its own
    inner = _inner(parts)
    longer = inner.groupBy(*_KEYS).agg(F.max("o_f").alias("longer"))
    of = lambda lo, size: F.max(F.when((F.col("lo") == lo) & (F.col("size") == size), F.col("f")))
    sides = inner.drop("o_f").join(parts.select(*_KEYS, "f"), _KEYS).groupBy(*[F.col(f"o_{c}").alias(c) for c in _KEYS])
    sides = sides.agg(of(0, 2).alias("ab"), of(1, 2).alias("bc"), of(2, 2).alias("cd"), of(0, 3).alias("abc"), of(1, 3).alias("bcd"))
    whole = parts.join(longer, _KEYS, "left").withColumn("longer", F.coalesce("longer", F.lit(0).cast("long"))).join(sides, _KEYS, "left")
    # counts of the cuts' parts of two words or more, by cut (0: a word)
    whole = whole.withColumn("left", F.expr("array(0L, ab, abc)")).withColumn("right", F.expr("if(k = 3, array(bc, 0L), array(bcd, cd, 0L))"))
    for i, c in enumerate(_KEYS):
        whole = whole.join(frequent.select(F.col("id").alias(c), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *([F.col("key").alias("lang")] if not i else [])), c, "left" if i > 1 else "inner")
    ends = F.element_at(F.array("f0", "f1", "f2", "f3"), F.col("k"))
    cut = """array_min(transform(sequence(1, k - 1), i -> struct(
        (2000000 * cast(f as decimal(20, 0))) div (cast(if(i = 1, f0, left[i - 1]) as decimal(20, 0)) + if(i = k - 1, last, right[i - 1])) as score,
        i as at, if(i = 1, f0, left[i - 1]) as l, if(i = k - 1, last, right[i - 1]) as r)))"""
    whole = whole.withColumn("last", ends).withColumn("cut", F.expr(cut))
    return whole.select("lang", F.concat_ws(" ", "w0", "w1", "w2", "w3").alias("phrase"), "k", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score", "longer"), totals


def top_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, rows_a_bucket: int = ROWS_A_BUCKET, buckets: int = MOST_BITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = mine(docs, least, rows_a_bucket, buckets, block_chars)
    kept = phrases.where(100 * F.col("longer") < INSIDE * F.col("a"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH lower AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM lower),
cut AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM cut GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut WHERE len(w) > 0),
grams AS (SELECT lang, w, i, unnest(range(1, 5)) AS k FROM starts),
counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM grams WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2),
inside AS (SELECT lang, a AS longer, k, w, unnest(range(2, k)) AS size FROM candidates),
inner_phrases AS (SELECT lang, longer, w, size, unnest(range(1, k - size + 2)) AS i FROM inside),
covered AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(longer) AS longer FROM inner_phrases GROUP BY ALL),
cuts AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS j FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ')
              JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:c.k], ' ')),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM scored),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN covered v ON v.lang = w.lang AND v.phrase = w.phrase
  WHERE w.nth = 1 AND (v.longer IS NULL OR 100 * v.longer < 80 * w.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

"""Substring dedup: repeated sentences and lines, removed where they run to a passage.

Units are the pieces between line ends and sentence ends; a unit's normal form is its words (letters,
digits, non-ASCII; A-Z lower-cased) joined by one space, and its digest is XXH3-128 of that. Digests
are grouped over all documents; the occurrence that ranks first by (doc_id, row, position) stays, and
every later one is a repeat. Consecutive repeats of a document form a run; a run of ``MIN_WORDS``
words or more is removed, so that short units which recur by chance stay. Offsets are code points of
the original text.

With ``min_words`` of 1 every repeated unit goes; at ``MIN_WORDS`` a short line or sentence that recurs
alone, as a heading or a licence's first line does, stays wherever it stands.

Null and empty texts have no unit; a very long text is cut whole by its task. Copies and repeated rows: the first row by (doc_id, place in the
table) keeps its text; the others lose theirs, for each row is a document of its own. Null ids rank
first. An empty table gives no rows. Extra columns stay in :func:`cleaned`; clashing names don't
matter, for the row is carried whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .decontaminate import words

#: Words that a run of repeats must have to be removed.
MIN_WORDS = 25
#: Occurrences of a digest that one task gets. A digest with more than these and a ten-thousandth of all units is dealt
#: out; there can be 10,000 such digests at most, which bounds their broadcast.
HOT_UNITS, HOT_SHARE = 20_000, 10_000
_END = re.compile(r"[.!?]+[ \t\n\r]+|\n+")
UNITS = "_row long, doc_id long, pos int, start int, end int, n_words int, digest binary"


def units(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units that have words."""
    out, at = [], 0
    text = text or ""
    for a, b in [*[m.span() for m in _END.finditer(text)], (len(text), len(text))]:
        if w := words(text[at:a]):
            out.append((at, a, len(w), xxhash.xxh3_128_digest(b" ".join(w))))
        at = b
    return out


def runs(repeats: list[tuple], min_words: int) -> list[tuple]:
    """Of sorted (pos, start, end, n_words, first_doc, first_start): (start, end, units, words, first_doc, first_start) of each run that is long enough."""
    out, run = [], []
    for r in [*repeats, None]:
        if run and (r is None or r[0] != run[-1][0] + 1):
            if (n := sum(x[3] for x in run)) >= min_words:
                out.append((run[0][1], run[-1][2], len(run), n, run[0][4], run[0][5]))
            run = []
        if r is not None:
            run.append(r)
    return out


def _removed(keyed: DataFrame, min_words: int) -> DataFrame:
    """keyed: _row, doc_id, text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in UNITS.split(", ")]
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.iloc[i : i + 200]
                rows = [(r, d, k, *u) for r, d, t in zip(part["_row"], part.doc_id.astype(object), part.text, strict=True) for k, u in enumerate(units(t))]
                frame = pd.DataFrame(rows, columns=names)
                frame["doc_id"] = pd.array([None if d is None or d != d else int(d) for d in frame.doc_id], "Int64")
                yield frame

    every = written(keyed.mapInPandas(cut, UNITS), "passage-units")
    first = written(every.groupBy("digest").agg(F.min(F.struct("doc_id", "_row", "pos", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "passage-firsts")
    # rows of a very common digest meet its first occurrence in several tasks
    least = max(HOT_UNITS, every.count() // HOT_SHARE)
    hot = F.broadcast(first.where(F.col("n") > least).select("digest", F.ceil(F.col("n") / least).cast("int").alias("salts")))
    dealt = every.join(hot, "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("_row", "pos"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    spread = first.join(hot, "digest", "left").select("digest", "first", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)")).alias("salt"))
    again = dealt.join(spread, ["digest", "salt"]).where("_row <> first._row or pos <> first.pos")
    lists = again.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")))).alias("repeats"))

    @F.pandas_udf("array<struct<start:int,end:int,n_units:int,n_words:int,first_doc_id:bigint,first_start:int>>")
    def join_runs(col: pd.Series) -> pd.Series:
        keys = ("pos", "start", "end", "n_words", "first_doc_id", "first_start")
        names = ("start", "end", "n_units", "n_words", "first_doc_id", "first_start")
        return pd.Series([[dict(zip(names, x, strict=True)) for x in runs([tuple(r[k] for k in keys) for r in rows], min_words)] for rows in col])

    return lists.select("_row", "doc_id", join_runs("repeats").alias("removed")).where("size(removed) > 0")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each removed run: doc_id, start, end, n_units, n_words, and where its first unit first stood."""
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _removed(keyed, min_words).select("doc_id", F.explode("removed").alias("x")).select("doc_id", "x.*")


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the removed runs cut out of ``text``, and with ``kept``: the [start, end) offsets that stay."""
    keyed = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "passage-rows")
    cut = _removed(keyed.select("_row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text")), min_words)
    both = keyed.join(cut.select("_row", "removed"), "_row", "left")
    size = F.length(F.coalesce("row.text", F.lit("")))
    edges = F.concat(F.array(F.lit(0)), F.coalesce(F.expr("flatten(transform(removed, x -> array(x.start, x.end)))"), F.array().cast("array<int>")), F.array(size))
    both = both.withColumn("_e", edges).withColumn("kept", F.expr("filter(transform(sequence(0, int(size(_e) / 2) - 1), i -> struct(_e[2 * i] as start, _e[2 * i + 1] as end)), x -> x.end > x.start)"))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.expr("concat_ws('', transform(kept, x -> substring(row.text, x.start + 1, x.end - x.start)))"))
    return both.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "kept"], "kept")


SQL = r"""
WITH cut AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id,
         regexp_split_to_array(text, '[.!?]+[ \t\n\r]+|\n+') AS parts,
         list_concat(regexp_extract_all(text, '[.!?]+[ \t\n\r]+|\n+'), ['']) AS ends
  FROM documents WHERE text IS NOT NULL AND text <> ''),
lens AS (
  SELECT r, doc_id, parts, list_transform(parts, lambda x: length(x)) AS a, list_transform(ends, lambda x: length(x)) AS b FROM cut),
each AS (
  SELECT r, doc_id, unnest(range(1, len(parts) + 1)) AS i, parts, a, b FROM lens),
unit AS (
  SELECT r, doc_id, i, parts[i] AS part, a[i] AS n,
         CAST(coalesce(list_sum(a[1:i-1]), 0) + coalesce(list_sum(b[1:i-1]), 0) AS BIGINT) AS start FROM each),
norm AS (
  SELECT r, doc_id, i, start, start + n AS stop,
         list_filter(string_split_regex(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM unit),
kept AS (
  SELECT r, doc_id, start, stop, len(w) AS n_words, list_aggregate(w, 'string_agg', ' ') AS form,
         row_number() OVER (PARTITION BY r ORDER BY i) AS pos FROM norm WHERE len(w) > 0),
ranked AS (
  SELECT *, row_number() OVER v AS nth, first_value(doc_id) OVER v AS first_doc, first_value(start) OVER v AS first_at
  FROM kept WINDOW v AS (PARTITION BY form ORDER BY doc_id, r, pos)),
again AS (SELECT *, pos - row_number() OVER (PARTITION BY r ORDER BY pos) AS run FROM ranked WHERE nth > 1)
SELECT doc_id, CAST(min(start) AS INTEGER) AS start, CAST(max(stop) AS INTEGER) AS "end", CAST(count(*) AS INTEGER) AS n_units,
       CAST(sum(n_words) AS INTEGER) AS n_words, arg_min(first_doc, pos) AS first_doc_id, CAST(arg_min(first_at, pos) AS INTEGER) AS first_start
FROM again GROUP BY r, doc_id, run HAVING sum(n_words) >= 25
"""

"""Columns over names and identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..knowledge import CONFUSABLES

_SEPARATORS = r"[-_.\s]+"


def _folded(names: pd.Series) -> pd.Series:
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return names.map(fold, na_action="ignore")


def ascii_canonical(name: Column) -> Column:
    """``canonical`` of names that are known to be ASCII: native."""
    return F.regexp_replace(F.lower(name), _SEPARATORS, "")


def canonical(name: Column) -> Column:
    """Unicode-folded, lower case, without separators. Spark has no NFKD, so a Pandas UDF folds."""
    return F.regexp_replace(F.pandas_udf(_folded, "string")(name), r"(?U)" + _SEPARATORS, "")


def non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def confusable_candidates(name: Column, depth: int = 2) -> Column:
    """All strings that ``depth`` substitutions of whole confusable pairs reach, the name itself included."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CONFUSABLES])
    out = F.array(name)
    for _ in range(depth):
        step = F.flatten(F.transform(out, lambda s: F.transform(pairs, lambda p: F.replace(s, p["a"], p["b"]))))
        out = F.array_distinct(F.concat(out, step))
    return out


def osa_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment: edits and swaps of neighbours. A fold over the rows of the matrix,
    each of which is a fold over its cells, so it stays in the JVM."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    as_, bs = chars(a), chars(b)
    first = F.transform(F.sequence(F.lit(0), F.size(bs)), lambda j: j.cast("int"))
    rows = F.struct(F.lit(0).alias("i"), F.lit("").alias("prev"), F.array().cast("array<int>").alias("r2"), first.alias("r1"))

    def row(acc: Column, ca: Column) -> Column:
        cells = F.struct(F.array((acc["i"] + 1).cast("int")).alias("r"), F.lit("").alias("prev"), F.lit(0).alias("j"))

        def cell(x: Column, cb: Column) -> Column:
            j = x["j"]
            cost = F.when(ca == cb, 0).otherwise(1)
            plain = F.least(F.get(acc["r1"], j + 1) + 1, F.get(x["r"], j) + 1, F.get(acc["r1"], j) + cost)
            swap = F.when((acc["i"] > 0) & (j > 0) & (ca == x["prev"]) & (acc["prev"] == cb), F.get(acc["r2"], j - 1) + cost)
            best = F.least(plain, F.coalesce(swap, plain)).cast("int")
            return F.struct(F.concat(x["r"], F.array(best)).alias("r"), cb.alias("prev"), (j + 1).alias("j"))

        return F.struct((acc["i"] + 1).alias("i"), ca.alias("prev"), acc["r1"].alias("r2"), F.aggregate(bs, cells, cell)["r"].alias("r1"))

    return F.element_at(F.aggregate(as_, rows, row)["r1"], -1)

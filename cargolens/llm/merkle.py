"""A Merkle manifest of a table of documents: digests, proofs, and proofs checked against a tampered copy.

Leaves are digests of rows, made by Spark's functions where the row lies; only digests and ids move on.
Each language's leaves, in order of ``doc_id``, are numbered and cut at multiples of ``FAN ** LEVELS`` into
aligned blocks. A block's subtree is traversed recursively in postorder: the digest comes back, and while
the recursion unwinds, each node's siblings are appended to the leaves it contains. The digests of the
blocks are the leaves of another distributed traversal, until one node is left; the roots of the languages
are then the leaves of one more tree. Proofs come down the same way: a block's path is appended to those of
its leaves.

Order: null ``doc_id`` first, ties by the leaf's digest. A null ``lang`` is a tree of its own and the first.
Repeated rows are leaves of their own with equal digests. Empty texts are ``0:``; very long texts are hashed
in the JVM, whole. A null ``doc_id`` is never tampered with. An empty table gives no rows. Extra columns and
clashing names don't matter: only the five columns of the leaf are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

FAN = 8
#: Levels of a block's subtree: 4096 leaves.
LEVELS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<at:int,run:array<string>>>"


def joined_digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(text: Column) -> Column:
    """The digest of a row whose text is ``text``."""
    values = [F.col("doc_id").cast("long").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long").cast("string"), text]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (a language; null first in order), doc_id, digest, and ``other``: the digest of the tampered row, if it is tampered with."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(3)) == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("v"), F.col("lang").cast("string")), F.lit("n")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(F.col("text")).alias("digest"),
        F.when(tampered, leaf(F.translate("text", _UPPER, _LOWER))).alias("other"),
    )


def levels_of(n: int, levels: int = LEVELS) -> int:
    """Levels of the subtree of a block in a tree of ``n`` leaves: all of a block's, or fewer if the tree ends before."""
    k = 0
    while k < levels and FAN**k < n:
        k += 1
    return k


def traverse(nodes: list[str], level: int) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The digest of the subtree of ``level`` levels over ``nodes``, and each node's path: (place in the run, the run), from the bottom up."""
    paths: list[list] = [[] for _ in nodes]

    def walk(lo: int, hi: int, level: int) -> str:
        if not level:
            return nodes[lo]
        step = FAN ** (level - 1)
        starts = range(lo, hi, step)
        run = [walk(a, min(a + step, hi), level - 1) for a in starts]
        for i, a in enumerate(starts):
            for k in range(a, min(a + step, hi)):
                paths[k].append((i, run))
        return joined_digest(run)

    return walk(0, len(nodes), level), paths


def fold(digest: str, path: list[tuple[int, list[str]]]) -> str:
    for at, run in path:
        digest = joined_digest([*run[:at], digest, *run[at + 1 :]])
    return digest


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes: tree, pos, n, digest, and more. A row for each aligned block: tree, block, n, kids in order, digest. Written."""

    @F.pandas_udf("string")
    def root(kids: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([traverse([x["digest"] for x in k], levels_of(m, levels))[0] for k, m in zip(kids, n, strict=True)], dtype=object)

    kid = F.struct("pos", *[c for c in nodes.columns if c not in ("tree", "pos", "n")])
    rows = nodes.groupBy("tree", F.expr(f"pos div {FAN**levels}").alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(kid)).alias("kids"))
    return written(rows.withColumn("digest", root("kids", "n")), "merkle-blocks")


def build(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks from the leaves up, and the roots: tree, digest, round (that of the tree's last block)."""
    rounds, roots, span = [], None, FAN**levels
    while True:
        blocks = _blocks(nodes, levels)
        done = blocks.where(F.col("n") <= span).select("tree", "digest", F.lit(len(rounds)).alias("round"))
        roots = done if roots is None else roots.unionByName(done)
        rounds.append(blocks)
        if not blocks.where(F.col("n") > span).limit(1).count():
            return rounds, roots
        nodes = blocks.where(F.col("n") > span).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / span).cast("long").alias("n"), "digest")


def _path(path) -> list[tuple[int, list[str]]]:
    return [(int(x["at"]), list(x["run"])) for x in path]


def _below(blocks: DataFrame, tops: DataFrame, levels: int) -> DataFrame:
    """Paths of the nodes in ``blocks``; tops: tree, block, path, subroot, root."""

    def unwind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tree, kids, n, path, subroot, root in zip(b.tree, b.kids, b.n, b.path, b.subroot, b.root, strict=True):
                paths = traverse([x["digest"] for x in kids], levels_of(n, levels))[1]
                rest = [{"at": at, "run": run} for at, run in _path(path)]
                yield pd.DataFrame({"tree": tree, "block": [x["pos"] for x in kids], "path": [[{"at": at, "run": run} for at, run in p] + rest for p in paths], "subroot": subroot, "root": root})

    return blocks.select("tree", "block", "n", "kids").join(tops, ["tree", "block"]).mapInPandas(unwind, f"tree string, block long, path {_PATH}, subroot string, root string")


def paths(rounds: list[DataFrame], tops: DataFrame, levels: int = LEVELS) -> DataFrame:
    """From the trees' tops (tree, round, path, subroot, root) to the paths of the lowest blocks."""
    top = lambda k: tops.where(F.col("round") == k).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    at = top(len(rounds) - 1)
    for k in range(len(rounds) - 1, 0, -1):
        at = _below(rounds[k], at, levels).unionByName(top(k - 1))
    return at


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Of each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rounds, roots = build(numbered(leaves(docs), "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")], "merkle-leaves"), levels)
    whole = numbered(roots.select(F.lit("all").alias("tree"), F.col("tree").alias("lang"), "digest", "round"), "tree", [F.col("lang")], "merkle-roots")
    upper, root = build(whole.select("tree", "pos", "n", "digest", "lang", "round"), levels)
    top = root.select("tree", "round", F.lit(None).cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    top = top.withColumn("path", F.array().cast(_PATH))

    def of_languages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kids, n, path, root in zip(b.kids, b.n, b.path, b.root, strict=True):
                paths = traverse([x["digest"] for x in kids], levels_of(n, levels))[1]
                rest = [{"at": at, "run": run} for at, run in _path(path)]
                yield pd.DataFrame({"tree": [x["lang"] for x in kids], "round": [x["round"] for x in kids], "path": [[{"at": at, "run": run} for at, run in p] + rest for p in paths], "subroot": [x["digest"] for x in kids], "root": root})

    tops = upper[0].select("tree", "block", "n", "kids").join(paths(upper, top, levels), ["tree", "block"]).mapInPandas(of_languages, f"tree string, round int, path {_PATH}, subroot string, root string")
    ends = paths(rounds, written(tops, "merkle-tops"), levels)

    def of_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kids, n, path, subroot, root in zip(b.kids, b.n, b.path, b.subroot, b.root, strict=True):
                own = traverse([x["digest"] for x in kids], levels_of(n, levels))[1]
                rest, out = _path(path), []
                for kid, mine in zip(kids, own, strict=True):
                    whole = mine + rest
                    proof = joined_digest([x for at, run in whole for x in (*run[:at], *run[at + 1 :])])
                    folded = fold(kid["other"] or kid["digest"], whole)
                    out.append((kid["doc_id"], kid["digest"], subroot, root, proof, folded, folded == root))
                frame = pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
                frame["doc_id"] = pd.array(frame.doc_id.tolist(), "Int64")
                yield frame

    return rounds[0].select("tree", "block", "n", "kids").join(ends, ["tree", "block"]).mapInPandas(of_documents, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _sql(depth: int = 7, upper: int = 3) -> str:
    """The same in SQL, for languages of up to ``FAN ** depth`` documents."""
    part = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE CAST(strlen({x}) AS VARCHAR) || ':' || {x} END"
    row = lambda text: "sha256(" + " || ".join(map(part, ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text])) + ")"
    bits = "list_reduce([xor(c, b), 0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(unicode(ch) AS BIGINT))), lambda c, b: {bits}))"
    out = [
        f"rows AS (SELECT coalesce('v' || lang, 'n') AS tree, doc_id, {row('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {row(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other FROM documents)",
        "l0 AS (SELECT tree, doc_id, leaf, other, leaf AS d, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows)",
        "p0 AS (SELECT tree, pos, doc_id, leaf, coalesce(other, leaf) AS fold, '' AS proof FROM l0)",
    ]

    def climb(node: str, proof: str, levels: int) -> None:
        for k in range(levels):
            out.append(f"r{node}{k} AS (SELECT tree, pos // {FAN} AS q, list(d ORDER BY pos) AS ds, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {node}{k}) GROUP BY tree, q)")
            out.append(f"{node}{k + 1} AS (SELECT tree, q AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM r{node}{k})")
            rest = "p.* EXCLUDE (tree, pos, fold, proof)"
            out.append(
                f"{proof}{k + 1} AS (SELECT p.tree, q AS pos, {rest}, "
                f"CASE WHEN n > 1 THEN sha256(array_to_string(list_concat(ds[1:p.pos % {FAN}], [fold], ds[p.pos % {FAN} + 2:]), '')) ELSE fold END AS fold, "
                f"CASE WHEN n > 1 THEN proof || array_to_string(list_concat(ds[1:p.pos % {FAN}], ds[p.pos % {FAN} + 2:]), '') ELSE proof END AS proof "
                f"FROM {proof}{k} p JOIN r{node}{k} r ON r.tree = p.tree AND r.q = p.pos // {FAN})"
            )

    climb("l", "p", depth)
    out.append(f"t0 AS (SELECT 'all' AS tree, tree AS lang, d, row_number() OVER (ORDER BY tree) - 1 AS pos FROM l{depth})")
    out.append(f"u0 AS (SELECT t.tree, t.pos, p.doc_id, p.leaf, t.d AS subroot, p.fold, p.proof FROM p{depth} p JOIN t0 t ON t.lang = p.tree)")
    climb("t", "u", upper)
    last = f"SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.d AS verified FROM u{upper} u JOIN t{upper} t ON t.tree = u.tree"
    return "WITH " + ",\n".join(out) + "\n" + last


SQL = _sql()

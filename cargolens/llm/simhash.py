"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint is the majority of the XXH64 hashes of its word shingles, bit by bit.
Distinct fingerprints meet in buckets: those that share a route. In a bucket they are sorted by the
rank of their bits in the Gray code, so neighbours differ in few bits; every ``LEAF`` of them form a
leaf node and every ``FAN`` nodes an upper node, and a node keeps the bits that all below it share
(mask and pattern). Two nodes are compared by the bits fixed in both; once the differences found so
far pass the limit, the whole pair of groups is pruned. Surviving leaf pairs are compared member by
member, and links go into a union-find, so a bucket gives at most a link for each member, however
many pairs it holds. A bucket beyond ``CHUNK`` members is cut into Gray-ordered chunks that act as
its top nodes: pairs of chunks that the masks don't prune are dealt to different tasks.

Routes of :func:`hamming_components` are choices of blocks of bits, of which linked fingerprints share
at least one: the search is exact. With more fingerprints there are more blocks, so routes stay small. :func:`near_duplicates` looks for
Jaccard similarity of shingle sets instead, where fingerprints differ in many bits; its routes are
``ANCHORS`` min-wise hashes of the set, the index finds candidates of ``CANDIDATE_BITS`` bits or
fewer by fingerprints of the sets, without repeats, whose signatures of ``SIGNED`` more such hashes are alike, and the sets
decide. Without signatures texts that share a passage chain into one group that grows with the corpus.

Very long texts are hashed whole. Null and empty texts have fingerprint zero and are linked like any other; fewer words than a shingle
make one shingle; repeated rows stay rows in :func:`report` and one of them stays in
:func:`drop_near_duplicates`; a null id ranks first there and is ignored as a component's smallest
id; an empty table gives no rows; extra columns are kept, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import key_filter, written
from .graph import components

SEED = 42
LEAF, FAN = 32, 8
CHUNK = 8192
ANCHORS = 8
#: Bits of 64 that candidates may differ in: sets of similarity 0.8 differ in 8 to 10 bits on average, with a standard deviation
#: of 2.9; sets of 4 and 5 hashes in 12. The gate misses at most 4 in 10,000 of such pairs, of 4 and 5 hashes 5 in 1000.
CANDIDATE_BITS = 20
#: Hashes of shingle sets that one task compares at once.
TASK_SHINGLES = 2_000_000
#: Min-wise hashes of a set that stand a byte each in its signature, and how many of two candidates must agree: at similarity 0.8
#: 51 of 64 do on average, with a standard deviation of 3.2, and fewer than 32 in under one pair in ten million.
SIGNED, ALIKE = 64, 32
_ODD = (np.random.default_rng(20240229).integers(0, 1 << 63, ANCHORS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SIGNED = np.concatenate([_ODD, (np.random.default_rng(20240301).integers(0, 1 << 63, SIGNED - ANCHORS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)])


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of the text's words, in order, repeats included."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    s = map(b" ".join, zip(*(w[i:] for i in range(size)))) if len(w) > size else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(SEED)), np.uint64)


def majority(h: np.ndarray) -> int:
    """Fingerprint as a signed 64-bit integer; a bit is set if over half of the hashes have it."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


# --- the index, in a task ------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _nodes(ones: np.ndarray, zeros: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits that are one, and bits that are zero, in everything below each parent."""
    at = np.arange(0, len(ones), fan)
    return np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether signatures, a row each, agree in ``ALIKE`` places or more."""
    out = np.empty(len(a), bool)
    for i in range(0, len(a), 1 << 16):
        out[i : i + (1 << 16)] = (a[i : i + (1 << 16)] == b[i : i + (1 << 16)]).sum(1) >= ALIKE
    return out


def linked(fp: np.ndarray, bits: int, signed: np.ndarray | None = None) -> np.ndarray:
    """For each fingerprint (distinct ones, or distinct with their signatures) the index of its group's first member, where groups are
    joined by ``bits`` differing bits or fewer, and signatures that are alike."""
    n = len(fp)
    order = np.argsort(gray_rank(fp))
    x = fp[order].astype(np.uint64)
    signs = None if signed is None else signed[order]
    levels = [_nodes(x, ~x, LEAF)]
    while len(levels[-1][0]) > FAN:
        levels.append(_nodes(*levels[-1], FAN))
    top = len(levels[-1][0])
    i, j = np.triu_indices(top)
    label = np.arange(n)
    stack = [(len(levels) - 1, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > 4096:
            stack += [(level, i[k : k + 4096], j[k : k + 4096]) for k in range(0, len(i), 4096)]
            continue
        ones, zeros = levels[level]
        near = np.bitwise_count((ones[i] & zeros[j]) | (zeros[i] & ones[j])) <= bits
        i, j = i[near], j[near]
        if not len(i):
            continue
        if level:
            step = np.arange(FAN)
            a = (i[:, None, None] * FAN + step[None, :, None] + 0 * step[None, None, :]).ravel()
            b = (j[:, None, None] * FAN + 0 * step[None, :, None] + step[None, None, :]).ravel()
            m = len(levels[level - 1][0])
            ok = (a < m) & (b < m) & (a <= b)
            stack.append((level - 1, a[ok], b[ok]))
            continue
        for k in range(0, len(i), 512):
            a = i[k : k + 512, None] * LEAF + np.arange(LEAF)
            b = j[k : k + 512, None] * LEAF + np.arange(LEAF)
            u, v = x[np.minimum(a, n - 1)], x[np.minimum(b, n - 1)]
            hit = np.bitwise_count(u[:, :, None] ^ v[:, None, :]) <= bits
            p, q, r = np.nonzero(hit)
            p, q = a[p, q], b[p, r]
            ok = (p < q) & (q < n)
            p, q = p[ok], q[ok]
            if signs is not None:
                # pairs of one group need no test
                differ = label[p] != label[q]
                p, q = p[differ], q[differ]
                near = np.concatenate([alike(signs[p[m : m + (1 << 16)]], signs[q[m : m + (1 << 16)]]) for m in range(0, len(p), 1 << 16)]) if len(p) else np.zeros(0, bool)
                p, q = p[near], q[near]
            _join(label, p, q)
    while True:
        flat = label[label]
        if (flat == label).all():
            break
        label = flat
    # back to the given order; a group's name is its first member there
    first = np.full(n, n)
    np.minimum.at(first, label, order)
    out = np.empty(n, np.int64)
    out[order] = first[label]
    return out


def _join(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    while len(p):
        while True:
            flat = label[label]
            if (flat == label).all():
                break
            label[:] = flat
        a, b = label[p], label[q]
        differ = a != b
        if not differ.any():
            return
        p, q, a, b = p[differ], q[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


# --- buckets, over the cluster -------------------------------------------------------------------


def _bucket_links(rows: DataFrame, bits: int) -> DataFrame:
    """rows: (route, fp, node, and signatures ``sig`` if they decide too), a bucket's rows in any task but all in one. Links (a, b) between nodes."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def groups(frame: pd.DataFrame) -> pd.DataFrame:
            route, fp, node = frame.route.to_numpy(), frame.fp.to_numpy(np.int64).view(np.uint64), frame.node.to_numpy(np.int64)
            signed = np.frombuffer(b"".join(frame.sig), np.uint8).reshape(-1, SIGNED) if "sig" in frame else None
            edge = np.flatnonzero(np.concatenate(([True], route[1:] != route[:-1], [True])))
            size = np.diff(edge)
            a, b = [], []
            start = edge[:-1][size == 2]
            near = start[np.bitwise_count(fp[start] ^ fp[np.minimum(start + 1, len(fp) - 1)]) <= bits] if len(start) else start
            if signed is not None and len(near):
                near = near[alike(signed[near], signed[near + 1])]
            a.append(node[near])
            b.append(node[near + 1] if len(near) else near)
            for s, n in zip(edge[:-1][size > 2], size[size > 2], strict=True):
                if signed is None:
                    unique, at = np.unique(fp[s : s + n], return_inverse=True)
                    of = linked(unique, bits)
                else:
                    both = np.ascontiguousarray(np.concatenate([fp[s : s + n, None].view(np.uint8), signed[s : s + n]], 1))
                    unique, one, at = np.unique(both.view(f"V{both.shape[1]}").ravel(), return_index=True, return_inverse=True)
                    of = linked(fp[s + one], bits, signed[s + one])
                # one member stands for all that have its fingerprint and signature
                first = np.full(len(unique), n)
                np.minimum.at(first, at, np.arange(n))
                mine, theirs = node[s : s + n], node[s + first[of[at]]]
                a.append(mine[mine != theirs])
                b.append(theirs[mine != theirs])
            return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

        left: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            left.append(batch)
            last = batch.route.iloc[-1]
            if left[0].route.iloc[0] == last:
                continue
            frame = pd.concat(left, ignore_index=True) if len(left) > 1 else batch.reset_index(drop=True)
            cut = int(np.flatnonzero(frame.route.to_numpy() != last)[-1]) + 1
            yield groups(frame.iloc[:cut])
            left = [frame.iloc[cut:]]
        if left:
            yield groups(pd.concat(left, ignore_index=True))

    return rows.mapInPandas(search, "a long, b long")


def bucket_links(rows: DataFrame, bits: int, chunk: int = CHUNK) -> DataFrame:
    """rows: (route long, fp long, node long; sig binary if signatures decide too). Links (a, b) that join all nodes of a route that
    differ in ``bits`` bits or fewer and are alike."""
    columns = ["route", "fp", "node", *(["sig"] if "sig" in rows.columns else [])]
    ddl = "route long, fp long, node long" + (", sig binary" if "sig" in columns else "")
    rows = written(rows.select(*columns), "routes")
    sizes = rows.groupBy("route").count().where("count > 1")
    if "sig" in columns:
        # most routes have one row, whose signature goes no further
        sizes = written(sizes, "route-sizes")
        rows = rows.where(key_filter(sizes.select(F.col("route").alias("_k")))("route"))
    hot = written(sizes.where(F.col("count") > chunk).select("route"), "hot-routes")
    usual = rows.join(sizes.where(F.col("count") <= chunk).select("route"), "route", "left_semi")
    out = _bucket_links(usual.repartition("route").sortWithinPartitions("route"), bits)
    if hot.isEmpty():
        return out
    # chunks of Gray order in a hot route; nodes of the index's top, a row each
    big = rows.join(hot, "route", "left_semi").withColumn("_at", F.xxhash64("route"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, k, filled, route = TaskContext.get().partitionId(), -1, 0, None
        for b in batches:
            ids = []
            for r in b.route:
                if r != route or filled >= chunk // 2:
                    k, filled, route = k + 1, 0, r
                filled += 1
                ids.append(task << 32 | k)
            yield b.assign(chunk=np.array(ids, np.int64))

    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    ordered = big.withColumn("_g", rank).repartitionByRange("route", "_g").sortWithinPartitions("route", "_g").select(*columns)
    chunks = written(ordered.mapInPandas(cut, f"{ddl}, chunk long"), "chunks")
    top = written(chunks.groupBy("route", "chunk").agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros")), "chunk-nodes")
    x, y = top.alias("x"), top.alias("y")
    apart = F.bit_count(F.col("x.ones").bitwiseAND(F.col("y.zeros")).bitwiseOR(F.col("x.zeros").bitwiseAND(F.col("y.ones"))))
    pairs = x.join(y, (F.col("x.route") == F.col("y.route")) & (F.col("x.chunk") <= F.col("y.chunk")) & (apart <= bits)).select(F.col("x.chunk").alias("c"), F.col("y.chunk").alias("d"))
    pairs = written(pairs.withColumn("pair", F.xxhash64("c", "d")), "chunk-pairs")
    sides = pairs.select("pair", F.col("c").alias("chunk")).unionByName(pairs.where("c <> d").select("pair", F.col("d").alias("chunk")))
    dealt = chunks.join(sides, "chunk").select(F.col("pair").alias("route"), *columns[1:])
    return out.unionByName(_bucket_links(dealt.repartition("route").sortWithinPartitions("route"), bits))


#: Fingerprints of a route that are expected at most; more blocks, and so longer routes, are taken where there are more.
ROUTE_PRINTS = 1024


def _block_routes(fp: F.Column, bits: int, intact: int = 1) -> F.Column:
    """array<long>: a number and the bits of every choice of ``intact`` of ``bits`` + ``intact`` blocks.

    Fingerprints that differ in ``bits`` bits have ``intact`` blocks in common, whichever they are."""
    n = bits + intact
    edges = [64 * i // n for i in range(n + 1)]
    block = lambda i: F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    return F.array(*[F.xxhash64(F.lit(k), *[block(i) for i in some]) for k, some in enumerate(combinations(range(n), intact))])


def intact_blocks(prints: int, bits: int) -> int:
    """Blocks of a route, so that random fingerprints would meet by ``ROUTE_PRINTS`` or fewer; every choice is exact."""
    return next((k for k in range(1, 5) if prints >> (64 * k // (bits + k)) <= ROUTE_PRINTS), 4)


def hamming_components(prints: DataFrame, bits: int = 2, chunk: int = CHUNK, intact: int | None = None) -> DataFrame:
    """prints: (fp) distinct. (fp, component): the smallest fingerprint that is reachable; fingerprints without a link are left out."""
    blocks = intact or intact_blocks(prints.count(), bits)
    routed = prints.select("fp", F.explode(_block_routes(F.col("fp"), bits, blocks)).alias("route")).withColumn("node", F.col("fp"))
    return components(bucket_links(routed, bits, chunk)).withColumnRenamed("node", "fp")


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` with ``fp``."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(t, size)) for t in texts], dtype="int64")

    return docs.withColumn("fp", fp("text"))


def report(docs: DataFrame, size: int = 3, bits: int = 2, chunk: int = CHUNK) -> DataFrame:
    """The contract's columns: doc_id, fingerprint as 16 hex digits, component_id."""
    marked = written(fingerprints(docs.select("doc_id", "text"), size).select("doc_id", "fp"), "fingerprints")
    prints = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    joined = hamming_components(prints.select("fp"), bits, chunk)
    named = prints.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "component").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates of a similarity -------------------------------------------------------------


def _similar(sets: list[np.ndarray], similarity: float, leads: int) -> np.ndarray:
    """Of sets in rank order: for each the position of the first earlier one that is similar enough, else -1.

    Only the first ``leads`` sets are compared with, of them those that weren't matched themselves. The
    sets that hold a hash stand side by side in one sorted array, a few numbers for each hash of the group."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    out = np.full(n, -1)
    flat, edge = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))
    order = np.argsort(flat, kind="stable").astype(np.int32 if len(flat) < 1 << 31 else np.int64)
    flat = flat[order]
    last = np.flatnonzero(np.append(flat[1:] != flat[:-1], True)).astype(order.dtype)
    del flat
    stop = np.repeat(last + 1, np.diff(last, prepend=-1))
    holder = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    place = np.empty_like(order)
    place[order] = np.arange(len(order), dtype=order.dtype)
    del order, last
    for i in range(min(leads, n - 1)):
        if out[i] >= 0:
            continue
        # of each of its hashes, the holders behind it
        first = place[edge[i] : edge[i + 1]] + 1
        more = stop[first - 1] - first
        at = np.repeat(first - np.cumsum(more) + more, more) + np.arange(more.sum())
        j, shared = np.unique(holder[at], return_counts=True)
        near = (out[j] < 0) & (shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9)
        out[j[near]] = i
    return out


def min_hashes(h: np.ndarray) -> np.ndarray:
    """The least of a set's hashes by each of ``SIGNED`` multipliers; zeros of an empty set. The first ``ANCHORS`` are its routes."""
    if not len(h):
        return np.zeros(SIGNED, np.uint64)
    return np.minimum.reduce([(_SIGNED[:, None] * h[i : i + 1024]).min(1) for i in range(0, len(h), 1024)])


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, chunk: int = CHUNK, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """doc_id and digest of the texts that go, for an earlier text (by doc_id) is equal or similar; with ``kept_doc_id``.

    In order of (doc_id, digest's hash) a text goes if a similar one before it stays, and its
    ``kept_doc_id`` is the first of these: one definition for groups of all sizes. A group beyond a
    task's share is settled from the front: its first texts among themselves in one task, then those
    of them that stay meet all texts behind, dealt to tasks, and what is left goes round again."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest_of("text").alias("digest"))

    @F.pandas_udf("struct<fp:bigint,anchors:array<bigint>,sig:binary,n:bigint>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            h = shingle_hashes(t, size)
            h = np.unique(h)  # sets decide, so repeats have no vote here
            least = min_hashes(h)
            rows.append((majority(h), least[:ANCHORS].view(np.int64).tolist(), ((least >> np.uint64(24)) & np.uint64(255)).astype(np.uint8).tobytes(), len(h)))
        return pd.DataFrame(rows, columns=["fp", "anchors", "sig", "n"])

    compact = written(marked.select("doc_id", "digest", sketch("text").alias("s")).select("doc_id", "digest", "s.*"), "sketches")
    # copies: the first of each text stands for it
    firsts = written(compact.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("anchors").alias("anchors"), F.first("sig").alias("sig"), F.first("n").alias("n")).withColumn("node", F.xxhash64("digest")), "texts")
    routed = firsts.select("fp", "sig", "node", F.posexplode("anchors").alias("i", "anchor")).select(F.xxhash64("i", "anchor").alias("route"), "fp", "node", "sig")
    groups = components(bucket_links(routed, CANDIDATE_BITS, chunk))
    members = written(firsts.join(groups, "node").select("digest", "doc_id", "n", "node", "component"), "candidates")

    @F.pandas_udf("binary")
    def as_set(texts: pd.Series) -> pd.Series:
        # no words: the set of one empty shingle
        return pd.Series([np.unique(shingle_hashes(t, size) if (t or "").split() else np.zeros(1, np.uint64)).tobytes() for t in texts], dtype=object)

    key = F.xxhash64("digest", "doc_id").alias("_k")
    wanted = written(members.select(key, "digest", "doc_id", "node", "component", F.greatest("n", F.lit(1)).alias("load")), "wanted")
    texts = marked.select(key, "digest", "text").where(key_filter(wanted.select("_k"))("_k"))
    texts = texts.join(wanted, ["_k", "digest"]).dropDuplicates(["_k", "digest"])
    sets = written(texts.select("digest", "doc_id", "node", "component", "load", as_set("text").alias("shingles")), "shingle-sets")

    kinds = "digest binary, doc_id long, kept_doc_id long"

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["lead", "doc_id", "node"], ascending=[False, True, True], na_position="first")
        ids = [None if d is None or d != d else int(d) for d in frame.doc_id.astype(object)]
        found = _similar([np.frombuffer(s, np.uint64) for s in frame.shingles], similarity, int(frame.lead.sum())).tolist()
        rows = [(g, d, ids[j]) for g, d, j in zip(frame.digest, ids, found, strict=True) if j >= 0]
        out = pd.DataFrame(rows, columns=["digest", "doc_id", "kept_doc_id"])
        return out.assign(doc_id=pd.array(out.doc_id, "Int64"), kept_doc_id=pd.array(out.kept_doc_id, "Int64"))

    def compared(rows: DataFrame, name: str) -> DataFrame:
        return written(rows.select("component", "part", "digest", "doc_id", "node", "lead", "shingles").groupBy("component", "part").applyInPandas(compare, kinds), name)

    whole = [F.lit(0).alias("part"), F.lit(True).alias("lead")]
    half = max(task_shingles // 2, 1)
    rank = F.struct(F.col("doc_id").isNotNull().alias("s"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("node").alias("n"))
    ahead = Window.partitionBy("component").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    gone, left = None, sets
    while True:
        # a group beyond a task's share takes at least that many hashes, so these are few
        large = written(left.groupBy("component").agg(F.sum("load").alias("all")).where(F.col("all") > task_shingles).select("component", F.ceil(F.col("all") / half).cast("int").alias("parts")), "large-groups")
        sized = left.join(F.broadcast(large), "component", "left")
        found = compared(sized.where("parts is null").select("*", *whole), "similar")
        gone = found if gone is None else gone.unionByName(found)
        if large.isEmpty():
            break
        ranked = sized.where("parts is not null").withColumn("rank", rank)
        front = ranked.select("component", "rank", "load").withColumn("ahead", F.coalesce(F.sum("load").over(ahead), F.lit(0)))
        ends = written(front.where(F.col("ahead") < half).groupBy("component").agg(F.max("rank").alias("end")), "fronts")
        cut = ranked.join(F.broadcast(ends), "component").withColumn("first", F.col("rank") <= F.col("end")).drop("rank", "end")
        first, behind = written(cut.where("first"), "first-sets"), cut.where("not first")
        found = compared(first.select("*", *whole), "similar")
        stay = first.join(found.select("digest"), "digest", "left_anti").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("lead", F.lit(True))
        dealt = behind.withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int")).withColumn("lead", F.lit(False))
        met = compared(dealt.unionByName(stay), "similar")
        gone = gone.unionByName(found).unionByName(met)
        left = written(behind.join(met.select("digest"), "digest", "left_anti").select(*sets.columns), "left")
    copies = compact.join(firsts.select("digest", F.col("doc_id").alias("kept_doc_id")), "digest").where(~F.col("doc_id").eqNullSafe(F.col("kept_doc_id"))).select("digest", "doc_id", "kept_doc_id")
    return copies.unionByName(gone).select("doc_id", "digest", "kept_doc_id")


def digest_of(column: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256))


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` less the rows whose text equals or is similar to one before; of repeated rows one stays."""
    gone = written(near_duplicates(docs, size, similarity).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d")).distinct(), "near-duplicates")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), digest_of("text").alias("_d"))
    rows = rows.withColumn("_k", F.xxhash64("_id", "_d"))
    may_go = key_filter(gone.select(F.xxhash64("_id", "_d").alias("_k")))("_k")
    doubtful = rows.where(may_go)
    left = rows.where(~may_go).unionByName(doubtful.join(gone, [doubtful["_id"].eqNullSafe(gone["_id"]), doubtful["_d"] == gone["_d"]], "left_anti"))
    # a text of which every copy but its first went is one row, unless that row is repeated
    often = written(left.groupBy("_id", "_d").count().where("count > 1").select("_id", "_d"), "repeated-rows")
    if often.isEmpty():
        return left.select("row.*")
    again = [left["_id"].eqNullSafe(often["_id"]), left["_d"] == often["_d"]]
    return left.join(often, again, "left_anti").select("row.*").unionByName(left.join(often, again, "left_semi").dropDuplicates(["_id", "_d"]).select("row.*"))

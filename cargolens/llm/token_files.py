"""Token-ID output: patched frame-of-reference files, one for each range of ``doc_id``.

A file is a row of blocks of ``BLOCK`` ids, then a footer. A block holds its minimum, the bit width
that covers ``PERCENTILE`` percent of the differences from it, the packed low bits, and an exception
list (position, difference) for the rest. The footer has the index of block starts, each document's
token count, and its place in order. Texts are encoded where they are read, and what is dealt out by ranges of ``doc_id``
are their ids, two bytes each where the vocabulary allows; the ranges' bounds come from ``doc_id`` alone. So file order is document
order and only one count per file meets on the driver. Rows of one id stand in order of their texts' hashes, and an id
that fills more than a range is cut by them, so that it is several files.

Null and empty texts get the end id alone. A very long text is encoded whole by its task; clashing names don't matter,
for only ``doc_id`` and ``text`` are read. Repeated rows are
documents of their own. An empty table gives no rows. Null ids sort first."""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, kept, shared_path, written

BLOCK = 4096
PERCENTILE = 98
END_ID = 2
MAGIC = b"CLPF0001"
#: Bytes of pieces that a worker keeps, by an estimate; what one piece takes besides its text and ids; and the longest piece kept.
CACHE_BYTES, PIECE_BYTES, KEPT_LENGTH = 112 << 20, 200, 256
#: The same where a worker does nothing else: a pipeline's workers have served other stages before.
ALONE_BYTES = 320 << 20
#: Characters of the texts that are cut into pieces at a time; a longer text is cut alone.
STEP_CHARS = 1 << 20
#: Documents in a file, at most, on average.
ROWS_A_FILE = 50_000
_HEAD = struct.Struct("<IBHH")
_L, _N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: Characters beyond those that _PIECES knows.
_ODD = re.compile(r"[^\n -~\u00a1-\u024f]")
#: The byte-level pre-tokenizer's pattern over the other characters; none of its runs ever gives back a character, so they are possessive.
_PIECES = re.compile(rf" ?[{_L}]++|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]++| ?[^ \n{_L}{_N}]++|\s+(?!\S)|\s++")
#: The byte-level alphabet: bytes that aren't visible Latin-1 characters stand as those from U+0100 on.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """ids of whole texts as bytes of little-endian unsigned 32-bit integers.

    A text of plain characters is cut into the byte-level pre-tokenizer's pieces, whose ids don't
    depend on their neighbours; pieces met for the first time go to the tokenizer's model as they are, for they need
    no more cutting, and are kept in a cache of bounded bytes; long pieces aren't kept. The cache has two halves: when the
    young one is full it becomes the old one, and the pieces that are met again move from there to the next. Other texts,
    texts that name an added token, and texts for a tokenizer of another kind are encoded as they are."""

    def __init__(self, path: str, cache_bytes: int | None = None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.cache_bytes = cache_bytes

        self.tokenizer = Tokenizer.from_file(path)
        self.short = self.tokenizer.get_vocab_size() <= 1 << 16
        self.model = self.tokenizer.model
        cut = self.tokenizer.pre_tokenizer
        self.by_pieces = self.tokenizer.normalizer is None and isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _odd(self, text: str) -> bool:
        return not self.by_pieces or _ODD.search(text) is not None or any(map(text.__contains__, self.added))

    def _learn(self, new: list[str]) -> None:
        tokenize = self.model.tokenize
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            ids = [[t.id for t in tokenize(p.encode().decode("latin-1").translate(_BYTES))] for p in some]
            data, at = np.fromiter(chain.from_iterable(ids), "<u4").tobytes(), 0
            for p, n in zip(some, map(len, ids), strict=True):
                self.pieces[p] = data[at : at + 4 * n]
                at += 4 * n

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if self._odd(t) else _PIECES.findall(t) for t in texts]
        if self.held > (self.cache_bytes or CACHE_BYTES) // 2:
            self.old, self.pieces, self.held = self.pieces, {}, 0
        here = set().union(*filter(None, split))
        here = here.difference(self.pieces)
        again = here & self.old.keys()
        for p in again:
            self.pieces[p] = self.old.pop(p)
        here -= again
        if here:
            self._learn(list(here))
        get = self.pieces.__getitem__
        out = [self._ids(t).tobytes() if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]
        for p in [p for p in here if len(p) > KEPT_LENGTH]:
            del self.pieces[p]
            here.discard(p)
        for some in (here, again):
            self.held += PIECE_BYTES * len(some) + sum(map(len, some)) + sum(map(len, map(get, some)))
        return out


def steps(texts: list[str]) -> Iterator[slice]:
    """Slices of ``texts`` with about ``STEP_CHARS`` characters each."""
    first = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > STEP_CHARS:
            yield slice(first, i)
            first, held = i, 0
        held += len(t) + 64
    if first < len(texts):
        yield slice(first, len(texts))


def encoder(path: str, cache_bytes: int | None = None) -> Encoder:
    """One for each worker process, so what a task learnt serves the next of its stage."""
    return kept(f"encoder {path} {cache_bytes}", lambda: Encoder(path, cache_bytes))


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    diff = ids.astype(np.uint32) - np.uint32(low)
    width = int(np.partition(diff, k := min(len(diff) - 1, len(diff) * PERCENTILE // 100))[k]).bit_length()
    out = np.flatnonzero(diff >> np.uint32(width)) if width < 32 else diff[:0]
    kept = diff & np.uint32((1 << width) - 1)
    if width <= 16:
        bits = np.unpackbits(kept.astype(">u2").view(np.uint8)).reshape(-1, 16)[:, 16 - width :]
    else:
        bits = np.unpackbits(kept.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - width :]
    packed = np.packbits(bits).tobytes() if width else b""
    return _HEAD.pack(low, width, len(ids), len(out)) + out.astype("<u2").tobytes() + diff[out].astype("<u4").tobytes() + packed


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    low, width, n, odd = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    where = np.frombuffer(data, "<u2", odd, at)
    what = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    at += 6 * odd
    size = (n * width + 7) // 8
    if width == 0:
        diff = np.zeros(n, np.uint32)
    elif width <= 25:
        # four bytes hold a value, wherever in its first byte it starts
        raw = np.concatenate([np.frombuffer(data, np.uint8, size, at), np.zeros(4, np.uint8)]).astype(np.uint32)
        bit = np.arange(n) * width
        byte = bit >> 3
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        diff = (window[byte] << (bit & 7).astype(np.uint32)) >> np.uint32(32 - width)
    else:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width).reshape(n, width)
        whole = np.zeros((n, 32), np.uint8)
        whole[:, 32 - width :] = bits
        diff = np.packbits(whole, axis=1).view(">u4").ravel().astype(np.uint32)
    diff[where] = what
    return diff + np.uint32(low)


class Writer:
    """Appends documents to one file."""

    def __init__(self, out: io.IOBase):
        self.out, self.at, self.starts, self.docs, self.left = out, len(MAGIC), [], [], []
        self.n = 0
        out.write(MAGIC)

    def add(self, docs: list[tuple], data: bytes) -> None:
        """docs: (doc_id, tokens) of documents whose ids are ``data``."""
        self.docs += docs
        self.left.append(data)
        self.n += len(data)
        if self.n >= 4 * BLOCK:
            self._flush(self.n // (4 * BLOCK))

    def _flush(self, blocks: int) -> None:
        ids = np.frombuffer(b"".join(self.left), "<u4")
        cut = min(blocks * BLOCK, len(ids))
        for i in range(0, cut, BLOCK):
            b = pack_block(ids[i : min(i + BLOCK, cut)])
            self.starts.append(self.at)
            self.at += len(b)
            self.out.write(b)
        self.left = [ids[cut:].tobytes()]
        self.n = len(self.left[0])

    def close(self) -> None:
        if self.n:
            self._flush(self.n // (4 * BLOCK) + 1)
        tables = (np.array(self.starts, "<u8").tobytes(), np.array([d[0] is not None for d in self.docs], "u1").tobytes(), np.array([d[0] or 0 for d in self.docs], "<i8").tobytes(), np.array([d[1] for d in self.docs], "<u4").tobytes())
        foot = zlib.compress(b"".join(tables), 1)
        head = json.dumps({"blocks": len(self.starts), "docs": len(self.docs), "block": BLOCK}).encode()
        self.out.write(foot + head + struct.pack("<II", len(foot), len(head)) + MAGIC)


def read_file(f, size: int) -> tuple[np.ndarray, list, np.ndarray]:
    """Of an open file: block starts, document ids (None where null) and token counts; from the footer alone."""
    f.seek(size - 8 - len(MAGIC))
    foot, head, magic = *struct.unpack("<II", f.read(8)), f.read(len(MAGIC))
    if magic != MAGIC:
        raise ValueError("not a token file")
    f.seek(size - 8 - len(MAGIC) - foot - head)
    raw, meta = zlib.decompress(f.read(foot)), json.loads(f.read(head))
    b, d = meta["blocks"], meta["docs"]
    known, ids = np.frombuffer(raw, "u1", d, 8 * b), np.frombuffer(raw, "<i8", d, 8 * b + d)
    return np.frombuffer(raw, "<u8", b), [int(i) if k else None for k, i in zip(known, ids, strict=True)], np.frombuffer(raw, "<u4", d, 8 * b + 9 * d)


def read_tokens(path: str, first: int = 0, count: int | None = None) -> np.ndarray:
    """Tokens ``first`` to ``first + count`` of a file; reads only the blocks that hold them."""
    fs, inner = file_system(path)
    with fs.open_input_file(inner) as f:
        size = f.size()
        starts, _, counts = read_file(f, size)
        total = int(counts.sum())
        end = total if count is None else min(total, first + count)
        if first >= end:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, (end - 1) // BLOCK
        f.seek(int(starts[a]))
        data = f.read(int(starts[b + 1] if b + 1 < len(starts) else size) - int(starts[a]))
        ids = np.concatenate([unpack_block(data, int(starts[i] - starts[a])) for i in range(a, b + 1)])
        return ids[first - a * BLOCK : end - a * BLOCK]


def encoded(docs: DataFrame, files: int, bounds: list[int], tokenizer: str, end_id: int = END_ID, cache_bytes: int | None = None) -> DataFrame:
    """A row for each document: its file's rank, doc_id, the hash that orders rows of one id, and its ids, two or four bytes each."""
    at = np.array(bounds, np.int64)
    last = files - 1

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, cache_bytes)
        short = enc.short and end_id < 1 << 16
        end = np.array([end_id], "<u2" if short else "<u4").tobytes()
        for b in batches:
            known = b.doc_id.notna().to_numpy()
            d = b.doc_id.fillna(0).to_numpy(np.int64)
            low, high = np.searchsorted(at, d, "left"), np.searchsorted(at, d, "right")
            # an id that is the bound of several ranges is cut by its rows' hashes, in their order
            share = ((b["_h"].to_numpy(np.int64) >> 32) + (1 << 31)) * (high - low + 1) >> 32
            rank = np.where(known, np.minimum(low + share, last), 0).astype(np.int32)
            texts = [t or "" for t in b.text]
            for part in steps(texts):
                ids = enc.encode(texts[part])
                if short:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                yield pd.DataFrame({"rank": rank[part], "doc_id": b.doc_id.iloc[part].to_numpy(), "_h": b["_h"].iloc[part].to_numpy(), "short": short, "ids": [x + end for x in ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    return rows.mapInPandas(encode, "rank int, doc_id long, _h long, short boolean, ids binary")


def dealt(docs: DataFrame, rows_a_file: int = ROWS_A_FILE) -> tuple[DataFrame, int, list[int]]:
    """``docs``, dealt out anew if its own splits are so few or uneven that cores would wait, the number of files, and the bounds of their
    ranges of ids. A share is what a core gets, not a file: splits are packed by bytes, so their rows differ a little at any size."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, most = docs.groupBy(F.spark_partition_id().alias("p")).count().agg(F.sum("count"), F.max("count")).first()
    rows = rows or 0
    files = max(1, min(rows, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_a_file))))
    if files == 1:
        return docs, 1, []
    bounds = docs.agg(F.percentile_approx("doc_id", [i / files for i in range(1, files)], min(20 * files, 1 << 20))).first()[0]
    share = rows / min(files, spark.sparkContext.defaultParallelism)
    return docs.repartition(files) if most > 2 * share else docs, files, sorted(bounds or [])


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, rows_a_file: int = ROWS_A_FILE, cache_bytes: int | None = None) -> DataFrame:
    """Writes the files and returns the table of them: file, its rank, documents, tokens, first token.

    A task writes a file of its own name; only the files of tasks that ended well are in the table."""
    spark = docs.sparkSession
    folder, tokenizer = folder or shared_path(spark, "token-files"), tokenizer or default_tokenizer()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rank = TaskContext.get().partitionId()
        fs, inner = file_system(folder)
        fs.create_dir(inner, recursive=True)
        name = f"tokens-{rank:06d}-{uuid.uuid4().hex}.clpf"
        n, tokens = 0, 0
        with fs.open_output_stream(f"{inner}/{name}") as f:
            w = Writer(f)
            for b in batches:
                size = np.where(b.short, 2, 4)
                counts = (b.ids.map(len).to_numpy() // size).tolist()
                known = [None if d is None or d != d else int(d) for d in b.doc_id.astype(object)]
                for i in range(0, len(b), 64):
                    data = [np.frombuffer(x, f"<u{k}").astype("<u4").tobytes() for x, k in zip(b.ids.iloc[i : i + 64], size[i : i + 64].tolist(), strict=True)]
                    w.add(list(zip(known[i : i + 64], counts[i : i + 64], strict=True)), b"".join(data))
                n, tokens = n + len(b), tokens + sum(counts)
            w.close()
        if n:
            yield pd.DataFrame({"file": [f"{folder}/{name}"], "rank": [rank], "docs": [n], "tokens": [tokens]})
        else:
            fs.delete_file(f"{inner}/{name}")

    docs, count, bounds = dealt(docs, rows_a_file)
    ids = encoded(docs, count, bounds, tokenizer, end_id, cache_bytes)
    ordered = ids.repartitionById(count, F.col("rank")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h").select("doc_id", "short", "ids")
    files = written(ordered.mapInPandas(write, "file string, rank int, docs long, tokens long"), "token-manifest")
    starts, total = [], 0
    for r in files.orderBy("rank").collect():
        starts.append((r.file, r["rank"], r.docs, r.tokens, total))
        total += r.tokens
    return spark.createDataFrame(starts, "file string, rank int, docs long, tokens long, start long")


def read_documents(files: DataFrame) -> DataFrame:
    """From the files: doc_id, start (tokens of all documents before), n_tokens, ids_crc32; a file a task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, start in zip(b.file, b.start, strict=True):
                fs, inner = file_system(file)
                with fs.open_input_file(inner) as f:
                    size = f.size()
                    starts, ids, counts = read_file(f, size)
                    ends = np.cumsum(counts.astype(np.int64))
                    rows, block, have = [], 0, memoryview(b"")
                    for n in counts:
                        parts, at, need = [have], have.nbytes // 4, int(n)
                        while at < need:
                            stop = min(block + 16, len(starts))
                            f.seek(int(starts[block]))
                            data = f.read(int(starts[stop] if stop < len(starts) else size) - int(starts[block]))
                            parts += [unpack_block(data, int(starts[k] - starts[block])).astype("<u4").tobytes() for k in range(block, stop)]
                            at, block = sum(memoryview(x).nbytes for x in parts) // 4, stop
                        whole = memoryview(b"".join(parts) if len(parts) > 1 else have)
                        rows.append(zlib.crc32(whole[: 4 * need]))
                        have = whole[4 * need :]
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "start": start + ends - counts, "n_tokens": counts.astype(np.int64), "ids_crc32": np.array(rows, np.int64)})

    n = max(1, files.count())
    return files.select("file", "start").repartition(n, "file").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, tokenizer: str | None = None, cache_bytes: int | None = None) -> DataFrame:
    return read_documents(write_tokens(docs, tokenizer=tokenizer, cache_bytes=cache_bytes))

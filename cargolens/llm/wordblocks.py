"""Word blocks: documents as numbers into a small dictionary of their block, to be joined with tables of words.

A block holds whole documents of one partition, about ``BLOCK_CHARS`` characters of them: each distinct
word of the block once, and for each document the slots of its words in order (slot 0 is a break). A table
of words then meets each block's dictionary instead of each occurrence, and comes back to the block as a
list by slot. What is shuffled is the dictionaries, and slots packed to a byte or two a word."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCK_CHARS = 16 << 20
#: Blocks of one word that one task gets. A word in more of them and in a ten-thousandth of all dictionary rows is dealt
#: out; at most 10,000 words can be such, and those of more than HOT_LENGTH characters aren't taken, which bounds their broadcast.
HOT_BLOCKS, HOT_SHARE, HOT_LENGTH = 20_000, 10_000, 1000

_SCHEMA = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("slots", pa.binary()), ("key", pa.list_(pa.string())), ("word", pa.list_(pa.string())), ("n", pa.list_(pa.int32()))])
_PART = pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("at", pa.binary())])
_DEALT = pa.schema([*list(_SCHEMA)[:4], ("parts", pa.list_(_PART))])
_DEALT_DDL = "block long, doc_id array<long>, sizes array<int>, slots binary, parts array<struct<bucket:int,words:binary,at:binary>>"
_DDL = "block long, doc_id array<long>, sizes array<int>, slots binary, key array<string>, word array<string>, n array<int>"


def pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes by place, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


_PART = pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("at", pa.binary())])
_DEALT = pa.schema([*list(_SCHEMA)[:4], ("parts", pa.list_(_PART))])
_DEALT_DDL = "block long, doc_id array<long>, sizes array<int>, slots binary, parts array<struct<bucket:int,words:binary,at:binary>>"
_DDL = "block long, doc_id array<long>, sizes array<int>, slots binary, key array<string>, word array<string>, n array<int>"


def pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes by place, deflated."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_texts(texts: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(texts), *map(len, texts)], "<u4").tobytes() + b"".join(texts), 6)


def unpack_texts(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)
    return [data[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


class _Block:
    def __init__(self, breaks: tuple):
        self.breaks, self.number, self.keys = breaks, count(1), {}
        self.docs, self.sizes, self.parts, self.chars = [], [], [], 0

    def add(self, doc_id, key: str, tokens: list, chars: int) -> None:
        if key not in self.keys:
            self.keys[key] = defaultdict(self.number.__next__, dict.fromkeys(self.breaks, 0))
        self.parts.append(np.fromiter(map(self.keys[key].__getitem__, tokens), np.uint32, len(tokens)))
        self.docs.append(doc_id)
        self.sizes.append(len(tokens))
        self.chars += chars

    def dealt(self, number: int, buckets: int) -> pa.RecordBatch:
        """The block with its words in lists by bucket, each in order, for an exchange by bucket. Slots are ranks by
        frequency, which pack best; a block without words has one empty list."""
        slots = np.concatenate(self.parts)
        counts = np.bincount(slots, minlength=next(self.number))
        rank = np.zeros(len(counts), np.uint32)
        rank[1 + np.argsort(-counts[1:], kind="stable")] = np.arange(1, len(counts))
        lists = defaultdict(list)
        for known in self.keys.values():
            for w, slot in known.items():
                if slot:
                    data = w.encode("utf-8", "surrogatepass")
                    lists[zlib.crc32(data) % buckets].append((data, slot))
        parts = [{"bucket": b, "words": pack_texts([w for w, _ in sorted(x)]), "at": pack(rank[[slot for _, slot in sorted(x)]])} for b, x in (lists or {0: []}).items()]
        return pa.RecordBatch.from_pylist([{"block": number, "doc_id": self.docs, "sizes": self.sizes, "slots": pack(rank[slots]), "parts": parts}], _DEALT)

    def row(self, number: int) -> pa.RecordBatch:
        slots = np.concatenate(self.parts)
        n = next(self.number) - 1
        key, word = [None] * n, [None] * n
        for k, known in self.keys.items():
            for w, slot in known.items():
                if slot:
                    key[slot - 1], word[slot - 1] = k, w if isinstance(w, str) else w.decode("utf-8", "replace")
        counts = np.bincount(slots, minlength=n + 1)[1:].tolist()
        return pa.RecordBatch.from_pylist([{"block": number, "doc_id": self.docs, "sizes": self.sizes, "slots": pack(slots), "key": key, "word": word, "n": counts}], _SCHEMA)


def word_blocks(docs: DataFrame, key: Column, split: Callable[[], Callable[[str], list]], breaks: tuple = (), name: str = "word-blocks", block_chars: int = BLOCK_CHARS, buckets: int = 0) -> DataFrame:
    """The written blocks of ``docs`` (doc_id, text). Words belong to a ``key`` (not null); ``split()`` gives a
    task's function from a text (null: empty) to its words; words equal to one of ``breaks`` get slot 0. With
    ``buckets`` a block has ``parts`` in place of key, word and n: its words packed by the bucket of their hash."""
    row = (lambda block, number: block.dealt(number, buckets)) if buckets else (lambda block, number: block.row(number))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, number, block = split(), TaskContext.get().partitionId() << 33, _Block(breaks)
        for b in batches:
            for d, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = t or ""
                block.add(d, k, tokens(t), len(t))
                if block.chars >= block_chars:
                    yield row(block, number)
                    number, block = number + 1, _Block(breaks)
        if block.docs:
            yield row(block, number)

    return written(docs.select(F.col("doc_id").cast("long"), key.alias("key"), "text").mapInArrow(cut, _DEALT_DDL if buckets else _DDL), name)


def entries(blocks: DataFrame) -> DataFrame:
    """The dictionaries' rows: block, slot, key, word, n (occurrences in the block)."""
    each = blocks.select("block", F.posexplode(F.arrays_zip("key", "word", "n")).alias("p", "x"))
    return each.select("block", (F.col("p") + 1).alias("slot"), "x.key", "x.word", "x.n")


def with_values(blocks: DataFrame, words: DataFrame, value: Column) -> DataFrame:
    """``blocks`` with ``at``, a list of (slot, v) for the words that ``words`` (key, word, blocks: in how many blocks) has.

    ``words`` is a written table; its words in very many blocks are dealt out with their blocks."""
    total = words.agg(F.sum("blocks")).first()[0] or 0
    least = max(HOT_BLOCKS, total // HOT_SHARE)
    hot = F.broadcast(words.where((F.col("blocks") > least) & (F.length("word") <= HOT_LENGTH)).select("key", "word", F.ceil(F.col("blocks") / least).cast("int").alias("salts")))
    salt = F.coalesce(F.pmod("block", F.col("salts")).cast("int"), F.lit(0)).alias("salt")
    rows = entries(blocks).join(hot, ["key", "word"], "left").select("block", "slot", "key", "word", salt)
    values = words.withColumn("v", value).join(hot, ["key", "word"], "left").select("key", "word", "v", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)")).alias("salt"))
    at = rows.join(values, ["key", "word", "salt"]).groupBy("block").agg(F.collect_list(F.struct("slot", "v")).alias("at"))
    return blocks.select("block", "doc_id", "sizes", "slots").join(at, "block", "left")

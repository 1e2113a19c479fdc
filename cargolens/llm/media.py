"""Media columns: content-addressed images in tar shards, described by rows.

A text's payload (its UTF-8 bytes, padded with spaces to a positive multiple of 192) is stored as an
8-bit greyscale PNG, 192 samples wide. Each task writes one tar shard; a payload met twice in a task
is stored once, and of shards that hold the same payload the first is read for all. Rows carry the
digest, the shard, offset and length; the header columns come from range reads of the first 33 bytes
of a member; reading the payload back is a range read of the member.

Null texts are empty and an empty text is one row of spaces; a very long text is one image, held whole
by its task. Equal texts get equal values: of shards with the same payload the one with the smallest
(path, offset) is read. Columns beside doc_id and text are not looked at, whatever their names. Repeated
rows stay rows. An empty table gives no rows and no shard."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, shared_path, written

WIDTH = 192
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "doc_id long, digest string, n_bytes long, shard string, offset long, length long"
FEATURES = "digest string, width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "replace")
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(data: bytes) -> bytes:
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    body = np.zeros((len(rows), WIDTH + 1), np.uint8)
    body[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(body.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int]:
    """Width and height, from the first ``HEADER_BYTES`` bytes; bad headers raise ValueError."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    if (depth, colour) != (8, 0):
        raise ValueError("not 8-bit greyscale")
    return width, height


def decode(data: bytes) -> bytes:
    width, height = header(data)
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return rows[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Mean, standard deviation, count of distinct samples, and an 8 x 8 average hash of the image."""
    x = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    at = np.arange(9) * len(x) // 8
    bands = np.stack([x[i : max(j, i + 1)].mean(0) for i, j in zip(at[:-1], at[1:], strict=True)])
    cells = bands.reshape(8, 8, WIDTH // 8).mean(2)
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"mean={x.mean():.4f};std={x.std():.4f};distinct={len(np.unique(x))};ahash={bits}"


def store(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the shards and returns the manifest, a row for each document. Only shards of tasks that
    ended well are named in it."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "media-shards")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, inner = file_system(folder)
        fs.create_dir(inner, recursive=True)
        name = f"shard-{uuid.uuid4().hex}.tar"
        known: dict[str, tuple[int, int]] = {}
        out, at = None, 0
        for b in batches:
            rows = []
            for doc, text in zip(b.doc_id.astype(object), b.text, strict=True):
                data = payload(text)
                digest = hashlib.sha256(data).hexdigest()
                if digest not in known:
                    out = out or fs.open_output_stream(f"{inner}/{name}")
                    media = encode(data)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + media + b"\0" * (-len(media) % 512))
                    known[digest] = (at + len(head), len(media))
                    at += len(head) + len(media) + -len(media) % 512
                rows.append((None if doc is None or doc != doc else int(doc), digest, len((text or "").encode("utf-8", "replace")), f"{folder}/{name}", *known[digest]))
            frame = pd.DataFrame(rows, columns=["doc_id", "digest", "n_bytes", "shard", "offset", "length"])
            frame["doc_id"] = pd.array(frame["doc_id"], "Int64")
            yield frame
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(write, MANIFEST), "media-manifest")


def _range(shards: dict, shard: str, offset: int, length: int) -> bytes:
    if shard not in shards:
        for f in shards.values():
            f.close()
        shards.clear()
        fs, inner = file_system(shard)
        shards[shard] = fs.open_input_file(inner)
    return shards[shard].read_at(length, offset)


def with_header(manifest: DataFrame) -> DataFrame:
    """The manifest with ``width`` and ``height``, which are read from the members' headers alone."""
    columns = [f for f in manifest.schema.fields if f.name not in ("width", "height")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards: dict = {}
        for b in batches:
            heads = [header(_range(shards, s, int(o), HEADER_BYTES)) for s, o in zip(b.shard, b.offset, strict=True)]
            yield b.assign(width=[h[0] for h in heads], height=[h[1] for h in heads])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    return manifest.select(*[f.name for f in columns]).mapInPandas(read, f"{kinds}, width long, height long")


def _pieces(members: DataFrame) -> int:
    """Tasks that members are read by: of 64 MB of media at most, of 4 MB at least where that keeps all cores busy."""
    total = members.agg(F.sum("length")).first()[0] or 0
    cores = members.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-total // (64 << 20)), min(-(-total // (4 << 20)), 4 * cores))


def read_back(manifest: DataFrame) -> DataFrame:
    """A row for each distinct payload: its first stored member, read, decoded and described."""
    members = manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards: dict = {}
        for b in batches:
            rows = []
            for digest, shard, offset, length in zip(b.digest, b.shard, b.offset, b.length, strict=True):
                width, height = header(_range(shards, shard, int(offset), HEADER_BYTES))
                media = _range(shards, shard, int(offset), int(length))
                data = decode(media)
                rows.append((digest, width, height, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])

    # by numbers in place of the shards' long paths, which a range's sample would take to the driver
    ordered = members.withColumn("_s", F.xxhash64("shard")).repartitionByRange(_pieces(manifest), "_s", "offset").sortWithinPartitions("_s", "offset")
    return ordered.drop("_s").mapInPandas(read, FEATURES)


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, and the header columns."""
    manifest = store(docs)
    return manifest.select("doc_id", "digest", "n_bytes").join(read_back(manifest), "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")

"""BPE by a table of distinct words: split in Spark, encoded once each, joined back by position.

For tokenizers whose pieces of text never cross white space and whose decoder puts one space between
pieces (``word_bpe_49k.json``). A text is cut at the tokenizer's added tokens, normalised and split as the
tokenizer does; the distinct words of all documents form a table, dealt out by their hash, in which each word is
encoded once. Ids come back to the documents by their words' places (``wordblocks``), and are decoded through a
join with the vocabulary (id, piece): :func:`decode` for any table of ids, and in :func:`report` for the
distinct words of a block. A word's ids don't depend on its neighbours and pieces are joined by one space, so a
document's ids and its decoded text are its words' in order.

Null and empty texts have no tokens and decode to the empty text. Very long texts are split whole in one
task; a word without white space is encoded whole, however long. Repeated rows and null ids are rows of
their own. An empty table gives no rows. Extra columns and clashing names don't matter: only ``doc_id`` and
``text`` are read."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, written
from .wordblocks import BLOCK_CHARS, pack, unpack, unpack_texts, word_blocks

#: Most pieces of a vocabulary that is broadcast for the join.
MOST_PIECES = 1 << 20
#: White space that both Python's pattern and the tokenizer's normalizer know.
_SPACE = re.compile(r"[ \t\n\r]+")
_L, _N = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
#: Characters that the pattern below doesn't cover, and one whose lower case is two characters.
_ODD = re.compile(r"[^\t\n\r -~¡-įı-ſ]")
#: The tokenizer's pattern for pieces, over all other characters in lower case.
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: Odd runs of a text that a task keeps with their words, and their longest.
KEPT_RUNS, KEPT_LENGTH = 20_000, 64
#: Distinct words that the task of a bucket remembers; it starts anew beyond them.
KEPT_WORDS = 1 << 20
#: Words whose ids and pieces are joined and hashed at once.
STEP = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Splitter:
    """The words of a text, normalised, with added tokens as words of their own."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.runs: dict[str, list[str]] = {}

    def __call__(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.added.split(text)):
            out += [part] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _WORDS.findall(text.lower())
        out = []
        for run in _SPACE.split(text):
            out += self._run(run) if _ODD.search(run) else _WORDS.findall(run.lower())
        return out

    def _run(self, run: str) -> list[str]:
        if (known := self.runs.get(run)) is None:
            normal = self.tokenizer.normalizer.normalize_str(run)
            known = [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
            if len(run) <= KEPT_LENGTH:
                if len(self.runs) >= KEPT_RUNS:
                    self.runs.clear()
                self.runs[run] = known
        return known


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """The join's small side: id, piece; its size is checked, since it is broadcast."""
    pieces = sorted((i, p) for p, i in load(path).get_vocab(with_added_tokens=True).items())
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"a vocabulary of {len(pieces)} pieces is not broadcast")
    return spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in pieces], pa.int32()), "piece": [p for _, p in pieces]}))


def decode(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``: the pieces of the column ``ids`` (array<int>), joined by one space; ids without a piece
    are left out, as the tokenizer does. Null and empty lists decode to the empty text."""
    pieces = F.broadcast(vocabulary(rows.sparkSession, tokenizer or default_tokenizer()))
    keyed = rows.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_all"), F.col("ids").alias("_ids"))
    keyed = written(keyed, "ids-to-decode")
    each = keyed.select("_row", F.posexplode("_ids").alias("_at", "id")).join(pieces, "id")
    text = each.groupBy("_row").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(_at, piece))), x -> x.piece)"), " ").alias("decoded"))
    return keyed.join(text, "_row", "left").select("_all.*", F.coalesce("decoded", F.lit("")).alias("decoded"))


def _encoded(docs: DataFrame, tokenizer: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(file, block, at, n, ids): of a block in a written file, the slots that one bucket's words have, how many ids each has, and these ids.

    A bucket is a part of the table of distinct words: the words of all blocks that fall in it meet in one task, which
    encodes each of them once. Words that very many blocks share are as many rows as others, for a row is a block's share
    of a bucket. A file's rows come together and in order of blocks, to the task that reads the file's slots."""
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = word_blocks(docs, F.lit(""), lambda: Splitter(tokenizer), name="bpe-blocks", block_chars=block_chars, buckets=buckets)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import normalizers

        t = load(tokenizer)
        # words are normalised; once more could reorder marks that lower-casing set free
        t.normalizer = normalizers.Sequence([])
        known: dict[bytes, list[int]] = {}
        for b in batches:
            for i, data in enumerate(b.column(2).to_pylist()):
                words = unpack_texts(data)
                new = [w for w in words if w not in known]
                known.update(zip(new, (e.ids for e in t.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False)), strict=True))
                ids = [known[w] for w in words]
                packed = [pack(np.fromiter(map(len, ids), np.uint32, len(ids))), pack(np.fromiter(chain.from_iterable(ids), np.uint32))]
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), row.column(3), pa.array(packed[:1], pa.binary()), pa.array(packed[1:], pa.binary())], names=["file", "block", "at", "n", "ids"])
                if len(known) > KEPT_WORDS:
                    known.clear()

    at = blocks.select(F.input_file_name().alias("file"), "block", F.explode("parts").alias("p")).select("file", "block", "p.words", "p.at", "p.bucket")
    ids = at.repartition(buckets, "bucket").drop("bucket").mapInArrow(encode, "file string, block long, at binary, n binary, ids binary")
    return ids.repartition(max(1, len(blocks.inputFiles())), "file").sortWithinPartitions("file", "block")


class _Rows:
    """A block's documents by slot."""

    def __init__(self, doc_id: list, sizes: list[int], slots: bytes, parts: list[dict]):
        self.doc_id, self.sizes, self.slots = doc_id, sizes, unpack(slots)
        top = int(self.slots.max()) + 1 if len(self.slots) else 1
        self.n, self.ids = np.zeros(top, np.int64), [()] * top
        for part in parts:
            n, at = unpack(part["n"]), unpack(part["at"])
            ends = np.cumsum(n, dtype=np.int64).tolist()
            flat = unpack(part["ids"]).tolist()
            self.n[at] = n
            for slot, end, k in zip(at.tolist(), ends, n.tolist(), strict=True):
                self.ids[slot] = flat[end - k : end]

    def documents(self) -> Iterator[tuple]:
        at = 0
        for d, size in zip(self.doc_id, self.sizes, strict=True):
            yield d, self.slots[at : at + size]
            at += size


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
    """Blocks of ``_encoded`` rows with their slots, which are read from the blocks' file once."""
    from pyarrow import parquet

    def parts() -> Iterator[tuple[tuple[str, int], dict]]:
        for b in batches:
            for r in b.to_pylist():
                yield (r["file"], r["block"]), r

    held, file = {}, None
    for (path, block), rows in groupby(parts(), key=lambda x: x[0]):
        if path != file:
            fs, inner = file_system(path)
            with fs.open_input_file(inner) as f:
                table = parquet.read_table(f, columns=["block", "doc_id", "sizes", "slots"])
            held, file = {b: i for i, b in enumerate(table["block"].to_pylist())}, path
        row = table.slice(held[block], 1)
        yield _Rows(row["doc_id"][0].as_py(), row["sizes"][0].as_py(), row["slots"][0].as_py(), [r for _, r in rows])


def _digest(parts: Iterator[list[str]]) -> str:
    h, first = hashlib.sha256(), True
    for part in parts:
        if joined := " ".join(filter(None, part)):
            h.update((joined if first else " " + joined).encode())
            first = False
    return h.hexdigest()


def report(docs: DataFrame, tokenizer: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Of each document: doc_id, n_tokens, and digests of its ids (decimal, joined by one space) and of the decoded text.

    The join of ids with pieces is a broadcast one, on a block's distinct words: the vocabulary's size is checked."""
    tokenizer = tokenizer or default_tokenizer()
    pieces = docs.sparkSession.sparkContext.broadcast({r.id: r.piece for r in vocabulary(docs.sparkSession, tokenizer).collect()})

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces.value.get
        for rows in _rows(batches):
            ids = [" ".join(map(str, x)) for x in rows.ids]
            text = [" ".join(filter(None, map(piece, x))) for x in rows.ids]
            out = []
            for d, mine in rows.documents():
                steps = [mine[k : k + STEP].tolist() for k in range(0, len(mine), STEP)]
                out.append({"doc_id": d, "n_tokens": int(rows.n[mine].sum()), "ids_sha256": _digest([ids[s] for s in x] for x in steps), "decoded_sha256": _digest([text[s] for s in x] for x in steps)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return _encoded(docs, tokenizer, block_chars).mapInArrow(put_together, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Of each document: doc_id and ids (array<int>)."""

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            for d, mine in rows.documents():
                ids = list(chain.from_iterable(rows.ids[s] for s in mine.tolist()))
                yield pa.RecordBatch.from_pylist([{"doc_id": d, "ids": ids}], pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return _encoded(docs, tokenizer or default_tokenizer()).mapInArrow(put_together, "doc_id long, ids array<int>")

"""Packing (operator 6): bounded-space online packing of token streams into windows.

Each partition keeps OPEN windows. A piece goes where the least room stays; when it fits nowhere
the fullest window is emitted, filled up with the head of the piece if more than SLIVER tokens of
room were left. At the end of a partition its open windows are merged, the last one by one; what
one partition cannot fill is merged with the remainders of others, as whole windows, best fit
first. A document longer than a window starts with full windows of its own.

Tokens are ids of a byte-level BPE vocabulary file, then one end id.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each by itself;
null ids are carried along; an empty table gives an empty result; extra columns are ignored,
whatever their names. Piece, sequence and offset do not depend on which executor ran a task.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import cut_lineage
from .words import packed, texts_of

WINDOW = 1024
OPEN = 64     # open windows of a partition
SLIVER = 4    # room that is rather padded than filled by cutting a document
END = 0
MERGE = 64    # partitions whose remainders are merged by one task of a round

PIECE = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine (each executor has its own copy)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids. Both libraries give the same ids for the same vocabulary; the rank file is
    read by the one that is four times as fast, and only a text that may hold the string of a
    special token goes to `tokenizers`, which knows those."""

    def __init__(self, json_path: str | None = None, rank_path: str | None = None):
        import public_tokenizers
        import tiktoken

        self.json_path = json_path
        with open(rank_path or vocabulary("byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def full(self):
        """Read when the first text needs it: it takes some 60 MB of a worker."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path or vocabulary("byte_bpe_50k.json"))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit values."""
        if "<|" in text:
            ids = np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        return ids.astype("<u4").tobytes()


_encoders: dict[tuple, Encoder] = {}


def encoder(*paths: str | None) -> Encoder:
    """One per Python worker, kept for its later tasks."""
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


class Packer:
    """Open windows of one partition. A window is [free room, list of pieces]; a piece is
    (row, start, ids as bytes)."""

    def __init__(self, first_id: int, window: int = WINDOW, most: int = OPEN):
        self.window, self.most, self.next_id = window, most, first_id
        self.open: list[list] = []
        self.out: list[tuple] = []  # (row, start, length, crc, sequence, offset)

    def emit(self, pieces: list[tuple]) -> int:
        sequence, offset = self.next_id, 0
        self.next_id += 1
        for row, start, ids in pieces:
            length = len(ids) // 4
            self.out.append((row, start, length, zlib.crc32(ids), sequence, offset))
            offset += length
        return sequence

    def add(self, row: object, ids: bytes, start: int = 0) -> None:
        step = 4 * self.window
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self.emit([(row, start + at // 4, ids[at:at + step])])
        ids, start = ids[whole:], start + whole // 4
        while ids:
            length = len(ids) // 4
            fitting = [w for w in self.open if w[0] >= length]
            if fitting:
                best = min(fitting, key=lambda w: w[0])
                best[1].append((row, start, ids))
                best[0] -= length
                if best[0] <= SLIVER:
                    self._close(best)
                return
            if len(self.open) < self.most:
                self.open.append([self.window - length, [(row, start, ids)]])
                return
            fullest = min(self.open, key=lambda w: w[0])
            room = fullest[0]
            fullest[1].append((row, start, ids[:4 * room]))
            ids, start = ids[4 * room:], start + room
            self._close(fullest)

    def _close(self, window: list) -> None:
        self.open.remove(window)
        self.emit(window[1])

    def finish(self) -> int | None:
        """Merges the open windows: pieces of the emptiest fill the fullest. Returns the sequence
        that stays unfilled, if any."""
        left = sorted(self.open, key=lambda w: w[0])
        self.open = []
        while len(left) > 1:
            target, source = left[0], left[-1]
            row, start, ids = source[1].pop()
            take = min(target[0], len(ids) // 4)
            target[1].append((row, start, ids[:4 * take]))
            target[0] -= take
            source[0] += take
            if 4 * take < len(ids):
                source[1].append((row, start + take, ids[4 * take:]))
            if not source[1]:
                left.pop()
            if target[0] == 0:
                self.emit(target[1])
                left.pop(0)
        return self.emit(left[0][1]) if left else None


def _pack(paths: tuple):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths).encode
        task = TaskContext.get()
        packer = Packer((task.partitionId() if task else 0) << 32)
        end = np.array([END], np.uint32).tobytes()
        tokens: dict[int, tuple] = {}
        rows: list = []       # carried columns of each row, as one-row slices
        schema = None

        def batch_of(found: list[tuple], last: int | None) -> pa.RecordBatch:
            columns = list(zip(*found))
            kept = pa.concat_arrays([tokens[r][1] for r in columns[0]])
            return pa.RecordBatch.from_arrays(
                [kept, *[pa.array(c, pa.int64()) for c in columns[1:4]],
                 pa.array([tokens[r][0] for r in columns[0]], pa.int64()),
                 pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64()),
                 pa.array([s == last for s in columns[4]])],
                names=["_row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                       "unfilled"])

        number = 0
        for batch in batches:
            for texts in texts_of(batch.column("_text")):
                strings = [texts.text(i).decode("utf-8", "replace") for i in range(len(texts))]
                for i, text in enumerate(strings):
                    ids = encode(text) + end
                    tokens[number] = (len(ids) // 4, batch.column("_row").slice(texts.first + i, 1))
                    packer.add(number, ids)
                    number += 1
                if len(packer.out) > 2000:
                    found, packer.out = packer.out, []
                    yield batch_of(found, None)
                    waiting = {p[0] for w in packer.open for p in w[1]}
                    tokens = {r: tokens[r] for r in waiting}
        last = packer.finish()
        if packer.out:
            yield batch_of(packer.out, last)

    return pack


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best fit of whole unfilled windows (sequence_id, size) of a partition into new ones: returns
    (sequence_id, target, shift, size of the target)."""
    found = sorted(((size, seq) for batch in batches for seq, size in zip(
        batch.column("sequence_id").to_pylist(), batch.column("size").to_pylist())), reverse=True)
    targets: list[list] = []
    for size, seq in found:
        fitting = [t for t in targets if t[0] + size <= WINDOW]
        if fitting:
            best = max(fitting, key=lambda t: t[0])
            best[1].append((seq, best[0]))
            best[0] += size
        else:
            targets.append([size, [(seq, 0)]])
    rows = [(seq, t[1][0][0], shift, t[0]) for t in targets for seq, shift in t[1]]
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                     names=["sequence_id", "target", "shift", "size"])


def pack(docs: DataFrame, *keep: str, json_path: str | None = None,
         rank_path: str | None = None) -> DataFrame:
    """The `keep` columns (as struct _row) and the pieces of every text of docs."""
    rows = packed(docs, *keep)
    kept = rows.schema["_row"]
    schema = T.StructType([kept, *T.StructType.fromDDL(PIECE + ", unfilled boolean").fields])
    pieces = cut_lineage(rows.mapInArrow(_pack((json_path, rank_path)), schema))
    # One unfilled window per partition remains; groups of MERGE partitions merge theirs.
    unfilled = pieces.where("unfilled").groupBy("sequence_id").agg(F.sum("length").alias("size"))
    group = F.shiftright("sequence_id", 32) / MERGE
    moves = (unfilled.withColumn("_group", F.floor(group))
             .repartition("_group").sortWithinPartitions("_group")
             .select("sequence_id", "size")
             .mapInArrow(_merged, "sequence_id long, target long, shift long, size long"))
    moved = pieces.where("unfilled").join(moves.drop("size"), "sequence_id").select(
        "_row", "start", "length", "ids_crc32", "doc_tokens", F.col("target").alias("sequence_id"),
        (F.col("offset") + F.col("shift")).alias("offset"))
    return pieces.where("NOT unfilled").drop("unfilled").select(*moved.columns).unionByName(moved)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, "doc_id").select(
        "_row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents, in their sequences."""
    return pack(docs, "doc_id").select(
        "_row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

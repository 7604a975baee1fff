"""Texts of an Arrow batch as numpy arrays: bytes, words, hashes. Helper of the operators here.

Words are maximal runs of characters other than \\x20 and \\x09-\\x0D. All functions work on UTF-8
bytes, so a text is never decoded; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes handled at once; a longer text is a chunk of its own

_ALL = np.arange(256)
SPACE = (_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13))
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
HEAD = (_ALL & 0xC0) != 0x80  # first byte of a code point

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finishing steps of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    data: np.ndarray     # bytes of all texts
    offsets: np.ndarray  # where each text starts, and the end of the last
    first: int           # row of the batch that the first text is from

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def total(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many bytes are flagged."""
        before = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return before[self.offsets[1:]] - before[self.offsets[:-1]]

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array, limit: int = CHUNK) -> Iterator[Texts]:
    """The texts of a string column in chunks of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        at = offsets[start:stop + 1]
        yield Texts(data[at[0]:at[-1]], at - at[0], start)
        start = stop


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a text's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
    before[offsets[:-1][offsets[:-1] < len(inside)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they stand."""
    power, inverse = _power_arrays(len(data) + 1)
    terms = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=terms[1:])
    plain = (terms[ends] - terms[starts]) * inverse[starts]
    return mix(plain ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray  # text of each word
    hash: np.ndarray


def words_of(texts: Texts, lower: bool) -> Words:
    """All words with their hashes; `lower` folds A-Z."""
    starts, ends = spans(~SPACE[texts.data], texts.offsets)
    data = LOWER[texts.data] if lower else texts.data
    return Words(starts, ends, texts.owner(starts), hashes(data, starts, ends))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first word and hashes of all windows of `size` words inside a text."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = words.hash[:n].copy()
    for k in range(1, size):
        value = mix(value + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) + words.hash[k:n + k]
    value = mix(value)
    at = np.flatnonzero(words.owner[:n] == words.owner[size - 1:])
    return at, value[at]


def packed(docs, *keep: str):
    """(_row: the `keep` columns as one struct, _text), so that no name can clash with what an
    operator adds."""
    from pyspark.sql import functions as F

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
                       F.col("text").cast("string").alias("_text"))


def with_added(rows, name_types: str):
    """Schema of `rows` without _text, and the added columns (as DDL)."""
    from pyspark.sql import types as T

    kept = [f for f in rows.schema.fields if f.name != "_text"]
    return T.StructType(kept + T.StructType.fromDDL(name_types).fields)


def without_text(batch: pa.RecordBatch, texts: Texts) -> tuple[list[pa.Array], list[str]]:
    """The other columns of the rows that `texts` holds, and their names."""
    part = batch.slice(texts.first, len(texts))
    names = [n for n in batch.schema.names if n != "_text"]
    return [part.column(n) for n in names], names

"""SentencePiece encoding and decoding (operator 2) by suffix-array matching.

The words of a chunk of texts (a blank run with what follows it; pieces never cross from one to the
next) are laid out one after the other. A suffix array of that text, sorted by as many characters
as the longest piece has, gives for each piece by binary search the range of all its occurrences.
These edges are relaxed from the best score to the worst, by position within a piece: an edge is
taken if it joins exactly two tokens as they stand, until no edge changes anything. For a model of
byte-pair merges this is its encoding; characters without a piece become byte pieces. Words met
before come from a bounded cache.

Decoding joins pieces and bytes; what is not valid UTF-8 becomes U+FFFD.

Defined cases: a null or empty text has no tokens and decodes to the empty text; repeated rows are
encoded each by itself; an empty table gives an empty result; extra columns are ignored, whatever
their names. A text holding the blank sign (U+2581) decodes with a blank in its place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .words import packed, texts_of, with_added, without_text

CACHE = 200_000   # words that a Python worker remembers
KEPT_WORD = 64    # characters of the longest word that is remembered
CHUNK = 4 << 20   # bytes of text whose new words are matched together
BLANK = "▁"

_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def vocabulary() -> str:
    """Path of the vocabulary file on this machine (each executor has its own copy)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _alphabet(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in order, and for each code its place among them."""
    met = np.zeros(int(codes.max()) + 1, bool)
    met[codes] = True
    return np.flatnonzero(met), (np.cumsum(met) - 1)[codes]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the `depth` codes (code points) from there on, by doubling; the first
    sort takes as many codes as one key holds."""
    if not len(codes):
        return np.zeros(0, np.int64)
    letters, key = _alphabet(codes)
    key = key + 1  # 0 is behind the end
    bits, reach = len(letters).bit_length(), 1
    while reach < depth and 2 * reach * bits < 63:
        ahead = np.zeros_like(key)
        ahead[:-reach] = key[reach:]
        key = (key << (reach * bits)) | ahead
        reach *= 2
    while True:
        order = np.argsort(key)
        if reach >= depth:
            return order
        inorder = key[order]
        rank = np.empty_like(order)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(inorder[1:] != inorder[:-1])])
        ahead = np.zeros_like(rank)
        ahead[:-reach] = rank[reach:]
        key = rank * (len(rank) + 1) + ahead
        reach *= 2


class Pieces:
    """A model's pieces, read through the `sentencepiece` library, which encodes nothing here."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary())
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i)
                                             or model.is_unknown(i) or model.is_unused(i))]
        self.single = {names[i]: i for i in plain if len(names[i]) == 1}
        self.byte = np.zeros(256, np.uint32)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(names[i][3:5], 16)] = i
        merged = [i for i in plain if len(names[i]) > 1]
        # Best score first; the search wants all pieces as rows of codes.
        self.merged = np.array(sorted(merged, key=lambda i: (-model.get_score(i), i)))
        self.length = np.array([len(names[i]) for i in self.merged])
        self.longest = int(self.length.max())
        self.codes = np.zeros((len(self.merged), self.longest), np.int64)
        for row, i in enumerate(self.merged):
            self.codes[row, :len(names[i])] = [ord(c) for c in names[i]]
        self.bytes = np.array([bytes([int(x[3:5], 16)]) if model.is_byte(i) else b""
                               if model.is_control(i) else x.replace(BLANK, " ").encode()
                               for i, x in enumerate(names)], object)
        self.known: dict[str, bytes] = {}

    def _ranges(self, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each merged piece, the range of the suffix array that begins with it."""
        padded = np.concatenate([codes, np.zeros(self.longest, np.int64)])
        out = []
        for upper in (False, True):
            low, high = np.zeros(len(self.merged), int), np.full(len(self.merged), len(order))
            while (low < high).any():
                mid = np.minimum((low + high) // 2, len(order) - 1)
                at, state = order[mid], np.zeros(len(mid), int)
                equal = np.flatnonzero(low < high)
                for k in range(self.longest):
                    equal = equal[(state[equal] == 0) & (k < self.length[equal])]
                    if not len(equal):
                        break
                    state[equal] = np.sign(padded[at[equal] + k] - self.codes[equal, k])
                before = (state < 0) | ((state == 0) & upper)
                open_ = low < high
                low = np.where(open_ & before, mid + 1, low)
                high = np.where(open_ & ~before, mid, high)
            out.append(low)
        return out[0], out[1]

    def _match(self, words: list[str]) -> list[bytes]:
        """Ids of words, as little-endian 32-bit values."""
        text = "\0".join(words) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        order = suffix_array(codes, self.longest)
        low, high = self._ranges(codes, order)
        n = len(codes)
        after, start = np.arange(1, n + 2), np.ones(n + 1, bool)
        token = np.full(n, -1, np.int64)
        present = np.flatnonzero(high > low)
        moved = True
        while moved:
            moved = False
            for k in present.tolist():
                length = self.length[k]
                edge = np.sort(order[low[k]:high[k]])
                middle = after[edge]
                edge = edge[start[edge] & (after[middle] == edge + length)]
                if not len(edge):
                    continue
                if len(edge) > 1 and (np.diff(edge) < length).any():
                    taken, end = [], -1
                    for at in edge.tolist():
                        if at >= end:
                            taken.append(at)
                            end = at + length
                    edge = np.array(taken)
                start[after[edge]] = False
                after[edge] = edge + length
                token[edge] = self.merged[k]
                moved = True
        # Tokens are where start holds; single characters are looked up, others become bytes.
        letters, back = _alphabet(codes)
        alone = np.array([self.single.get(chr(c), -1) for c in letters.tolist()])
        token = np.where(token < 0, alone[back], token)
        border = np.flatnonzero(codes == 0)
        start[border] = False
        at = np.flatnonzero(start[:n])
        ids = token[at]
        raw = [self.byte[np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8)]
               if i < 0 else None for c, i in zip(letters.tolist(), alone.tolist())]
        size = np.array([1 if r is None else len(r) for r in raw])
        count = np.where(ids < 0, size[back[at]], 1)
        flat = np.repeat(ids, count)
        first = np.cumsum(count) - count
        for k in np.flatnonzero(ids < 0).tolist():
            flat[first[k]:first[k] + count[k]] = raw[back[at[k]]]
        flat = flat.astype("<u4")
        ends = np.concatenate([first, [len(flat)]])[np.searchsorted(at, border)]
        begin = np.concatenate([[0], ends[:-1]])
        whole = flat.tobytes()
        return [whole[4 * a:4 * b] for a, b in zip(begin.tolist(), ends.tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_WORD.findall(BLANK + t.replace(" ", BLANK).replace("\0", "�")) if t else []
                 for t in texts]
        held, known = len(self.known), self.known
        new = list(set().union(*split).difference(known))
        found = dict(zip(new, self._match(new))) if new else {}
        known.update(found)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        if held > CACHE:
            self.known = {w: i for w, i in found.items() if len(w) <= KEPT_WORD}
        else:
            for word in new:
                if len(word) > KEPT_WORD:
                    del known[word]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(self.bytes[ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[str | None, Pieces] = {}


def pieces(path: str | None) -> Pieces:
    """One per Python worker, kept for its later tasks."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _batches(texts: Iterator, limit: int) -> Iterator[tuple[list, list[str]]]:
    held, strings, size = [], [], 0
    for part in texts:
        held.append(part)
        strings += [part.text(i).decode("utf-8", "replace") for i in range(len(part))]
        size += len(part.data)
        if size >= limit:
            yield held, strings
            held, strings, size = [], [], 0
    if held:
        yield held, strings


def encoded(docs: DataFrame, *keep: str, path: str | None = None) -> DataFrame:
    """_row (a struct of the `keep` columns) and ids, an array<int> of the tokens."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for held, strings in _batches(texts_of(batch.column("_text")), CHUNK):
                found, at = model.encode(strings), 0
                for part in held:
                    own = found[at:at + len(part)]
                    at += len(part)
                    ends = np.cumsum([0] + [len(x) // 4 for x in own]).astype(np.int32)
                    ids = np.frombuffer(b"".join(own), "<u4").astype(np.int32)
                    columns, names = without_text(batch, part)
                    yield pa.RecordBatch.from_arrays(
                        columns + [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))],
                        names=names + ["ids"])

    rows = packed(docs, *keep)
    return rows.mapInArrow(encode, with_added(rows, "ids array<int>"))


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows with _row and ids; adds text."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            lists = batch.column("ids").fill_null([]) if batch.column("ids").null_count \
                else batch.column("ids")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            texts = [model.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    return rows.mapInArrow(decode, with_added(rows, "text string"))


def round_trips(docs: DataFrame, *keep: str, path: str | None = None) -> DataFrame:
    """_row (a struct of the `keep` columns), n_tokens, ids_crc32 (of the ids as little-endian
    32-bit values) and round_trip: whether decoding gives the text back, blank signs as blanks."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for held, strings in _batches(texts_of(batch.column("_text")), CHUNK):
                found = model.encode(strings)
                same = [model.decode(np.frombuffer(ids, "<u4")) == text.replace(BLANK, " ")
                        for ids, text in zip(found, strings)]
                whole = batch.slice(held[0].first, len(strings))
                kept = [n for n in batch.schema.names if n != "_text"]
                yield pa.RecordBatch.from_arrays(
                    [whole.column(n) for n in kept]
                    + [pa.array([len(ids) // 4 for ids in found], pa.int64()),
                       pa.array([zlib.crc32(ids) for ids in found], pa.int64()), pa.array(same)],
                    names=kept + ["n_tokens", "ids_crc32", "round_trip"])

    rows = packed(docs, *keep)
    return rows.mapInArrow(check, with_added(
        rows, "n_tokens long, ids_crc32 long, round_trip boolean"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether decoding them gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trips(docs, "doc_id").select("_row.doc_id", "n_tokens", "ids_crc32", "round_trip")

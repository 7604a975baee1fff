"""Cross-tokenizer alignment (operator 13): which tokens of two vocabularies cover the same bytes.

Before a single space between two characters that are no white space both vocabularies have a
token end and go on with a space-marked token, and what stands on one side does not change the
tokens of the other. These anchors cut a document into windows, short stretches of text that repeat
all over a corpus. A window is encoded and aligned once and remembered: its groups (cut where both
end) and its links (pairs of overlapping tokens). The ids of a document's windows, one behind the
other, are those of the whole text. New windows are encoded many at a time, put together again to
one text; a window with white space at an end (the first or last of a text) is encoded by itself.

A link's count is how many links of the corpus join the same two ids. Links are kept per document as
sorted codes; the TOP most frequent id pairs are broadcast (a fixed bound), rarer ones meet their
documents in a join.

Defined cases: a null or empty text, and one whose tokens of either side do not join to the text (a
U+2581 in it, for instance), has no tokens: zeros and '' as digest; repeated rows count each; null ids
are carried along; an empty table gives an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import new_folder, removed_at_exit
from .packing import vocabulary
from .words import CHUNK, packed, texts_of

TOP = 1 << 20         # id pairs that are broadcast, 13 bytes each
REMEMBERED = 1 << 17  # windows a task remembers (some 300 bytes each); beyond, it starts anew
HELD_LINKS = 1 << 22  # links that remembered windows may have together
LONG_WINDOW = 128     # tokens; longer windows are aligned without being remembered
TOGETHER = 1 << 12    # characters of new windows that are encoded as one text
SIDE = 1 << 16        # ids of the second vocabulary are below this, so a pair is one 32-bit code

FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Vocabulary:
    """Ids of whole texts, and per id its bytes."""

    def __init__(self, tokens: list[bytes], encode):
        self.encode = encode  # text -> ids of space + text
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.tokens = np.array(tokens, dtype=object)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[ids].tolist())


def byte_level(rank_path: str | None = None, json_path: str | None = None) -> Vocabulary:
    """Byte-level vocabulary from its rank file, whose library is four times as fast; a text on which
    that library gives up (very long white space) goes to the library of the other file. Both give
    the same ids, the strings of special tokens being plain text."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(rank_path or vocabulary("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token

    def encode(text):
        try:
            return np.array(fast.encode_to_numpy(" " + text, disallowed_special=()), np.int64)
        except ValueError:
            full = Tokenizer.from_file(json_path or vocabulary("byte_bpe_50k.json"))
            full.encode_special_tokens = True
            return np.array(full.encode(" " + text, add_special_tokens=False).ids, np.int64)

    return Vocabulary(tokens, encode)


def piece_level(path: str | None = None) -> Vocabulary:
    """SentencePiece vocabulary, which puts the space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary("piece_bpe_32k.model"))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("a piece goes on after a space mark; long texts could not be cut")

    def raw(i, piece):
        if model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if model.is_control(i) else piece.replace("▁", " ").encode()

    return Vocabulary([raw(i, p) for i, p in enumerate(pieces)],
                      lambda text: np.array(model.encode(text, num_threads=1), np.int64))


_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_ANCHOR = re.compile(r" (?<=\S )(?=\S)")


def stretches(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in stretches of about `size` characters, the space between two left out: space and
    stretch, one after the other, are space and text."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.end()
    yield text[start:]


class Windows:
    """Aligned windows by their texts. Entry k has the text of its groups, their number, how many ids
    it has on either side, and its links at links[first[k]:first[k + 1]]."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        # Ids as they stand in a text: first of a window, first of a group, any other.
        self.shown_a = np.array([[f"{mark}{i}" for i in range(len(a.tokens))] for mark in ("", ";", ",")], object)
        self.shown_b = np.array([[f"{mark}{i}" for i in range(len(b.tokens))] for mark in ("|", ",")], object)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # -1: one side does not join to the window
        self.texts: list[str] = []
        self.groups, self.n_a, self.n_b = array("q"), array("q"), array("q")
        self.links = array("I")
        self.first = array("q", [0])

    def __len__(self) -> int:
        return len(self.texts)

    def align(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray,
              stop_a: np.ndarray, stop_b: np.ndarray) -> None:
        """Adds windows that lie one behind the other: their ids, the ends of these, and behind which
        id of either side each window stops."""
        ends = np.union1d(ends_a, ends_b)  # every stretch between two ends is one link
        links = a[np.searchsorted(ends_a, ends)] * SIDE + b[np.searchsorted(ends_b, ends)]
        common, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        group_a = np.searchsorted(at_a, np.arange(len(a)))
        group_b = np.searchsorted(at_b, np.arange(len(b)))
        begin_a, begin_b = np.r_[0, at_a + 1], np.r_[0, at_b + 1]  # first ids of the groups
        mark_a, mark_b = np.full(len(a), 2), np.ones(len(b), np.int64)
        mark_a[begin_a[:-1]] = 1
        mark_a[np.r_[0, stop_a[:-1]]] = 0
        mark_b[begin_b[:-1]] = 0
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + begin_b[group_a]] = self.shown_a[mark_a, a]
        shown[np.arange(len(b)) + begin_a[group_b + 1]] = self.shown_b[mark_b, b]
        shown, stop = shown.tolist(), (stop_a + stop_b).tolist()
        self.texts += ["".join(shown[i:j]) for i, j in zip([0, *stop], stop)]
        last = ends_a[stop_a - 1]
        self.groups.extend(np.diff(np.searchsorted(common, last) + 1, prepend=0).tolist())
        self.n_a.extend(np.diff(stop_a, prepend=0).tolist())
        self.n_b.extend(np.diff(stop_b, prepend=0).tolist())
        self.first.extend((len(self.links) + np.searchsorted(ends, last) + 1).tolist())
        self.links.frombytes(links.astype(np.uint32).tobytes())


class Aligner:
    """Two vocabularies and the windows met so far; one per Python worker."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b, self.windows = a, b, Windows(a, b)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None where one of them does not join to the text."""
        a, b = self.a.encode(text), self.b.encode(text)
        whole = b" " + text.encode()
        if self.a.joined(a) != whole or self.b.joined(b) != whole:
            return None
        return a, b

    def learn(self, inner: Iterable[str], alone: Iterable[str]) -> list[str]:
        """Encodes and aligns windows that are not known, those of `inner` put together to texts.
        Returns those not to be remembered: long ones, and those that do not join to the text."""
        known, good, parts, bad = self.windows.known, [], [], []
        for text in (*stretches(" ".join(inner), TOGETHER), *alone):
            group = _ANCHOR.split(text) if text else []
            found = self.tokens(text) if group else None
            if found is not None:
                good += group
                parts.append(found)
                continue
            for window in group:
                found = self.tokens(window) if len(group) > 1 else None
                if found is None:
                    bad.append(window)
                else:
                    good.append(window)
                    parts.append(found)
        known.update(dict.fromkeys(bad, -1))
        if not good:
            return bad
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        # Every window ends where tokens of both sides do: at an anchor, or with its text.
        ends = np.cumsum([len(w.encode()) + 1 for w in good])
        stop_a, stop_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1
        if (ends_a[stop_a - 1] != ends).any() or (ends_b[stop_b - 1] != ends).any():
            raise ValueError("a token goes across an anchor")
        size = np.diff(stop_a, prepend=0) + np.diff(stop_b, prepend=0)
        known.update(zip(good, range(len(self.windows), len(self.windows) + len(good))))
        self.windows.align(a, b, ends_a, ends_b, stop_a, stop_b)
        return bad + [good[k] for k in np.flatnonzero(size > LONG_WINDOW).tolist()]

    def aligned(self, texts: list[str]):
        """For each text its figures and the codes of its links in order."""
        out: list[tuple | None] = [None] * len(texts)
        windows = self.windows
        if len(windows) > REMEMBERED or len(windows.links) > HELD_LINKS:
            windows.clear()
        split = [_ANCHOR.split(text) if text else [] for text in texts]
        known = windows.known
        new = set().union(*split).difference(known)
        alone = {w for own in split for w in own[:1] + own[-1:] if w[0].isspace() or w[-1].isspace()} & new
        passing = self.learn(new - alone, alone)
        flat, groups, begin, n_a, n_b = (np.array(x) for x in (
            windows.links, windows.groups, windows.first, windows.n_a, windows.n_b))
        count = np.diff(begin)
        for i, own in enumerate(split):
            mine = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
            if not len(mine) or mine.min() < 0:
                continue
            digest = hashlib.sha256()
            for at in range(0, len(mine), 1 << 16):
                text = ";".join(map(windows.texts.__getitem__, mine[at:at + (1 << 16)].tolist()))
                digest.update((";" if at else "").encode() + text.encode())
            size = count[mine]
            shift = np.repeat(begin[mine] - (np.cumsum(size) - size), size)
            codes = np.sort(flat[shift + np.arange(len(shift))])
            out[i] = (int(n_a[mine].sum()), int(n_b[mine].sum()), int(groups[mine].sum()),
                      len(codes), digest.hexdigest(), codes)
        for window in passing:
            del known[window]
        return out


_aligners: dict[tuple, Aligner] = {}


def aligner(*paths: str | None) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(byte_level(*paths[:1]), piece_level(*paths[1:]))
    return _aligners[paths]


def _delta(codes: np.ndarray) -> bytes:
    return np.diff(codes, prepend=codes[:1] * 0).tobytes()


def _parts(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part has about `most` links, or one document."""
    for batch in batches:
        size = [x.as_buffer().size // 4 if x.is_valid else 0 for x in batch.column("_links")]
        start, held = 0, 0
        for k, n in enumerate(size):
            if held and held + n > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < len(size):
            yield batch.slice(start)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all rows, and the row of each."""
    raw = [np.frombuffer(x.as_buffer(), np.uint32) if x.is_valid else np.zeros(0, np.uint32)
           for x in column]
    size = np.array([len(x) for x in raw], np.int64)
    if not size.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.concatenate([np.cumsum(x, dtype=np.int64) for x in raw]),
            np.repeat(np.arange(len(raw)), size))


def alignments(docs: DataFrame, *keep: str, rank_path: str | None = None,
               piece_path: str | None = None) -> DataFrame:
    """_row (the `keep` columns), _id (unique), the FIGURES and _links: sorted codes of each
    document's links as differences."""
    rows = packed(docs, *keep)
    schema = T.StructType([*rows.schema.fields[:1], *T.StructType.fromDDL(
        f"_id long, {FIGURES}, _links binary").fields])

    def step(batches: Iterator[pa.RecordBatch]):
        work, next_id = aligner(rank_path, piece_path), TaskContext.get().partitionId() << 36
        for batch in batches:
            for texts in texts_of(batch.column("_text")):
                part = batch.slice(texts.first, len(texts))
                found = work.aligned([t or "" for t in part.column("_text").to_pylist()])
                found = [f or (0, 0, 0, 0, "", np.zeros(0, np.uint32)) for f in found]
                ids = np.arange(next_id, next_id + len(found))
                next_id += len(found)
                columns = [part.column("_row"), pa.array(ids),
                           *[pa.array([f[k] for f in found]) for k in range(5)],
                           pa.array([_delta(f[5]) for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(step, schema)


def _kept(df: DataFrame) -> DataFrame:
    """Written once, tightly packed, to the shared folder."""
    folder = new_folder(df.sparkSession, "links")
    df.write.option("compression", "zstd").parquet(folder)
    removed_at_exit(df.sparkSession, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(code, n, best): how many links of the corpus join the pair, and whether no other pair of its
    second id has more. Counts are summed in the task, then before the shuffle."""
    def step(batches: Iterator[pa.RecordBatch]):
        codes, counts = [], []

        def summed():
            unique, back = np.unique(np.concatenate(codes), return_inverse=True)
            return unique, np.bincount(back, np.concatenate(counts)).astype(np.int64)

        for batch in _parts(batches):
            unique, n = np.unique(_codes(batch.column("_links"))[0], return_counts=True)
            codes.append(unique)
            counts.append(n)
            if sum(map(len, codes)) > TOP:
                code, n = summed()
                codes, counts = [code], [n]
                if len(code) > TOP // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])
                    codes, counts = [], []
        if codes:
            code, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    partial = aligned.select("_links").mapInArrow(step, "code long, n long")
    total = _kept(partial.groupBy("code").agg(F.sum("n").alias("n")))
    second = F.pmod("code", F.lit(SIDE)).alias("b")
    most = total.groupBy(second).agg(F.max("n").alias("most"))  # at most one row per id
    return total.select("code", "n", second).join(F.broadcast(most), "b").select(
        "code", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, top: int) -> int:
    """The least count such that at most `top` pairs have it or more."""
    capped = F.least("n", F.lit(1 << 16))
    held, least = 0, (1 << 16) + 1
    for value, pairs in sorted(counts.groupBy(capped).count().collect(), reverse=True):
        held += pairs
        if held > top:
            break
        least = value
    return least


def scored(aligned: DataFrame, counts: DataFrame, top: int = TOP) -> DataFrame:
    """Adds n_best and count_sum to what `alignments` has given (and drops _id and _links)."""
    least = _frequent(counts, top)
    rows = counts.where(F.col("n") >= least).orderBy("code").toPandas()
    shared = aligned.sparkSession.sparkContext.broadcast(
        (rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(bool)))

    def found(links: pa.Array):
        codes, row = _codes(links)
        known, n, best = shared.value
        unique, back = np.unique(codes, return_inverse=True)
        at = np.minimum(np.searchsorted(known, unique), max(0, len(known) - 1))
        hit = known[at] == unique if len(known) else np.zeros(len(unique), bool)
        count = np.where(hit, n[at], 0) if len(known) else np.zeros(len(unique), np.int64)
        top_one = hit & best[at] if len(known) else hit
        return codes, row, hit[back], count[back], top_one[back]

    kept = [f for f in aligned.schema.fields if f.name != "_links"]
    schema = T.StructType([*kept, *T.StructType.fromDDL("n_best long, count_sum long").fields])

    def sums(batches):
        for batch in _parts(batches):
            _, row, _, count, top_one = found(batch.column("_links"))
            size = batch.num_rows
            # Exact as long as a document's counts sum to less than 2^53.
            added = [pa.array(np.bincount(row, top_one, size).astype(np.int64)),
                     pa.array(np.bincount(row, count, size).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], *added], names=schema.names)

    def rest(batches):
        for batch in _parts(batches):
            codes, row, hit, _, _ = found(batch.column("_links"))
            ids = np.asarray(batch.column("_id"))[row[~hit]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(codes[~hit])], ["_id", "code"])

    out = aligned.mapInArrow(sums, schema)
    rare = counts.where(F.col("n") < least)
    if rare.isEmpty():
        return out.drop("_id")
    links = aligned.select("_id", "_links").mapInArrow(rest, "_id long, code long")
    more = links.join(rare, "code").groupBy("_id").agg(
        F.sum(F.col("best").cast("long")).alias("_best"), F.sum("n").alias("_sum"))
    return out.join(more, "_id", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)),
    }).drop("_id", "_best", "_sum")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aligned = _kept(alignments(docs, "doc_id"))
    return scored(aligned, _kept(link_counts(aligned))).select(
        F.col("_row.doc_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best",
        "count_sum", "groups_sha256")

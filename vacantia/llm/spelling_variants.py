"""Spelling variants (operator 12): words one edit apart, found by k-d trees over letter counts.

A replaced letter moves one count up and one down, an inserted one moves one count up; so words one
edit apart are at L1 distance one or two, inside a length or between neighbouring lengths. A top
tree per length, fitted on a bounded sample of the vocabulary, deals every word to a cell; a word
also visits the cells whose box one such move can reach. In a cell a second tree of its words prunes
the same way down to a few words, whose letter sets and then letter order are compared. Every pair is
found in one place: the word on the lower side of the first split between them is the visitor.

Words are counted in the task and before the shuffle. A word's form is its near word with the largest
count, if that is twice its own; roots follow forms by pointer jumping, so chains of d forms take
log2(d) joins.

Defined cases: a null or empty text has no words; a null doc_id stands as an empty id in the checksum;
repeated rows count each; an empty table gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .words import CHUNK, HEAD, LOWER, Texts, hashes, packed, spans, texts_of

MIN_LENGTH, MIN_COUNT = 5, 3
ODD = 97            # runs whose checksum this divides lose a letter
SAMPLE = 1 << 18    # most words that the top trees are fitted on: 16 for each of 2^14 cells
CELL = 4096         # words of a cell, as far as the sample can tell cells apart
LEAF = 16           # words of a leaf inside a cell
PAIRS = 1 << 20     # pairs compared at once
LETTERS = 26 + 64   # a-z and U+00C0 to U+00FF

_ASCII = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
_DIM = np.zeros(256, np.int64)
_DIM[97:123] = np.arange(26)
_DIM[0xC0:0x100] = 26 + np.arange(64)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each data[start:end], going on from the crc32 `before` it; letter by letter for all
    words at once."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    state, at = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF), starts[order]
    longer = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")
    for k, n in enumerate(longer.tolist()):  # the first n words are longer than k
        state[:n] = (state[:n] >> np.uint32(8)) ^ _CRC[(state[:n] ^ data[at[:n] + k]) & 255]
    out = np.empty(len(starts), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offsets = np.r_[0, np.cumsum(size)]
    flat = data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32).tobytes()),
                                       pa.py_buffer(flat.tobytes()))


def counted(texts: Texts, doc_ids: list) -> tuple[pa.Array, np.ndarray]:
    """The words of a chunk of texts and how often each occurs."""
    data = LOWER[texts.data]
    lead = data == 0xC3  # of U+00C0 to U+00FF
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends = spans(inside, texts.offsets)
    before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in doc_ids], np.uint32)
    crc = checksums(data, starts, ends, before[texts.owner(starts)])
    chars = np.concatenate([[0], np.cumsum(HEAD[data], dtype=np.int64)])
    length = chars[ends] - chars[starts]
    odd = crc % ODD == 0
    plain = ~odd & (length >= MIN_LENGTH)
    starts_, ends_ = starts[plain], ends[plain]
    _, first, n = np.unique(hashes(data, starts_, ends_), return_index=True, return_counts=True)
    cut = Counter()
    for k in np.flatnonzero(odd & (length > MIN_LENGTH)).tolist():
        run, at = data[starts[k]:ends[k]].tobytes().decode(), int(crc[k]) % int(length[k])
        cut[run[:at] + run[at + 1:]] += 1
    words = pa.concat_arrays([_strings(data, starts_[first], ends_[first]),
                              pa.array(list(cut), pa.string())])
    return words, np.r_[n, np.fromiter(cut.values(), np.int64, len(cut))].astype(np.int64)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with MIN_COUNT occurrences or more."""
    def step(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column("_row").field(0)
            for texts in texts_of(batch.column("_text"), 4 * CHUNK):
                words, n = counted(texts, ids.slice(texts.first, len(texts)).to_pylist())
                yield pa.RecordBatch.from_arrays([words, pa.array(n)], ["word", "n"])

    parts = packed(docs, "doc_id").mapInArrow(step, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# K-d trees --------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Node k splits at vector[dim[k]] <= cut[k] into left[k] and right[k]; a leaf has dim -1 and its
    number in left[k]."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.dim < 0).sum())


def vectors(letters: np.ndarray) -> np.ndarray:
    """Letter counts of words given as rows of Latin-1 codes."""
    out = np.zeros((len(letters), LETTERS), np.int32)
    for column in letters.T:
        out[np.arange(len(letters)), _DIM[column]] += 1
    return out


def build(points: np.ndarray, size: int) -> tuple[Tree, np.ndarray]:
    """A tree whose leaves hold about `size` of the points, and the leaf of each point. Points that
    are all equal share a leaf, however many they are."""
    nodes: list[list[int]] = []
    leaf_of, todo, leaves = np.zeros(len(points), np.int64), [(np.arange(len(points)), -1, 0)], 0
    while todo:
        rows, parent, side = todo.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        best = None
        if len(rows) > size:
            part = points[rows]
            for cut in range(int(part.max())):
                share = np.abs((part <= cut).mean(axis=0) - 0.5)
                dim = int(share.argmin())
                if share[dim] < 0.5 and (best is None or share[dim] < best[0]):
                    best = (share[dim], dim, cut)
        if best is None:
            leaf_of[rows] = leaves
            nodes.append([-1, 0, leaves, 0])
            leaves += 1
            continue
        _, dim, cut = best
        low = points[rows, dim] <= cut
        nodes.append([dim, cut, 0, 0])
        todo += [(rows[~low], len(nodes) - 1, 1), (rows[low], len(nodes) - 1, 0)]
    return Tree(*np.array(nodes).T), leaf_of


def reach(tree: Tree, points: np.ndarray, ups: int, downs: int, once: bool = False
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, moved) of every leaf whose box a point can reach by raising at most `ups` (0 or 1)
    counts by one and lowering at most `downs`; `moved` tells whether a move was needed. With `once`
    the first move is always up, so that of two points in different leaves only one reaches the
    other."""
    row = np.arange(len(points))
    node = np.zeros(len(points), np.int64)
    up, down = np.full(len(points), -1 if ups else -2), np.full(len(points), -1 if downs else -2)
    out = []
    while len(row):
        dim = tree.dim[node]
        done = dim < 0
        out.append((row[done], tree.left[node[done]], (up[done] >= 0) | (down[done] >= 0)))
        row, node, up, down, dim = (x[~done] for x in (row, node, up, down, dim))
        value = points[row, dim] + (up == dim) - (down == dim)
        cut, left, right = tree.cut[node], tree.left[node], tree.right[node]
        low = value <= cut
        rises = (up == -1) & (value == cut)
        falls = (down == -1) & (value == cut + 1)
        if once:
            falls &= up >= 0
        row = np.concatenate([row, row[rises], row[falls]])
        node = np.concatenate([np.where(low, left, right), right[rises], left[falls]])
        up = np.concatenate([up, dim[rises], up[falls]])
        down = np.concatenate([down, down[rises], dim[falls]])
    row, leaf, moved = (np.concatenate(x) for x in zip(*out)) if out else (row, row, row > 0)
    # Several paths may lead to one leaf.
    key = row * max(1, tree.leaves) + leaf
    _, first = np.unique(key, return_index=True)
    return row[first], leaf[first], moved[first]


def top_trees(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, Tree]:
    """A tree for each length in a sample of at most about `sample` words, taken by hash."""
    total = words.count()
    share = -(-total // sample)
    rows = words.where(F.pmod(F.xxhash64("word"), F.lit(max(1, share))) == 0).select("word").collect()
    by_length: dict[int, list[str]] = {}
    for r in rows:
        by_length.setdefault(len(r.word), []).append(r.word)
    size = max(16, cell // max(1, share)) if share > 1 else cell
    return {length: build(vectors(_letters(part)), size)[0] for length, part in by_length.items()}


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 codes."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return flat.reshape(len(words), -1)


def dealt(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(length, cell, visit, word, n): each word in its own cell (visit 0), in the cells of its length
    that a replaced letter may lead to (1) and in those of the next length that an inserted one may
    lead to (2)."""
    shared = words.sparkSession.sparkContext.broadcast(trees)
    one = Tree(*np.array([[-1], [0], [0], [0]]))

    def step(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            text = batch.column("word").to_pylist()
            n = np.asarray(batch.column("n"))
            lengths = np.array([len(w) for w in text])
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                points = vectors(_letters([text[k] for k in mine]))
                row, leaf, moved = reach(shared.value.get(length, one), points, 1, 1, once=True)
                more, far, _ = reach(shared.value.get(length + 1, one), points, 1, 0)
                at = mine[np.r_[row, more]]
                visit = np.r_[moved.astype(np.int32), np.full(len(more), 2, np.int32)]
                to = np.r_[np.full(len(row), length), np.full(len(more), length + 1)]
                for k in range(0, len(at), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[part].astype(np.int32)), pa.array(np.r_[leaf, far][part].astype(np.int32)),
                         pa.array(visit[part]), pa.array([text[i] for i in at[part]], pa.string()),
                         pa.array(n[at[part]])], ["length", "cell", "visit", "word", "n"])

    return words.mapInArrow(step, "length int, cell int, visit int, word string, n long")


# Pairs of a cell ----------------------------------------------------------------------------------


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of `b` are rows of `a` with one more letter."""
    size = a.shape[1]
    head = np.cumprod(a == b[:, :size], axis=1).sum(axis=1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= size


def _masks(points: np.ndarray) -> np.ndarray:
    """The letters of a word as bits (letters beyond a-z share theirs by number modulo 38)."""
    bits = np.r_[np.arange(26), 26 + np.arange(64) % 38].astype(np.uint64)
    return np.bitwise_or.reduce(np.where(points > 0, np.uint64(1) << bits, np.uint64(0)), axis=1)


def pairs_of_cell(home: list[str], replaced: list[str], inserted: list[str]
                  ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) one edit apart: j is a word of `home`, i one of home + replaced + inserted; two
    words of `home` come once."""
    if not home:
        return
    letters = _letters(home)
    points = vectors(letters)
    tree, leaf_of = build(points, LEAF)
    order = np.argsort(leaf_of, kind="stable")
    begin = np.searchsorted(leaf_of[order], np.arange(tree.leaves + 1))
    masks = _masks(points)
    for kind, words in enumerate((home, replaced, inserted)):
        base = [0, len(home), len(home) + len(replaced)][kind]
        if not words:
            continue
        own = letters if kind == 0 else _letters(words)
        asked = points if kind == 0 else vectors(own)
        own_masks = _masks(asked)
        test, apart = (_one_inserted, 1) if kind == 2 else (_one_replaced, 2)
        # Bits that letters share can hide a difference, never make one.
        for at in range(0, len(words), 1 << 14):
            row, leaf, moved = reach(tree, asked[at:at + (1 << 14)], 1, int(kind != 2), kind == 0)
            row = row + at
            size = begin[leaf + 1] - begin[leaf]
            stop = np.cumsum(size)
            k = 0
            while k < len(row):
                last = max(k + 1, int(np.searchsorted(stop, (stop[k - 1] if k else 0) + PAIRS, "right")))
                part = slice(k, last)
                i = np.repeat(row[part], size[part])
                shift = np.repeat(begin[leaf[part]] - (stop[part] - size[part]), size[part])
                j = order[shift + np.arange(stop[k] - size[k], stop[last - 1])]
                near = np.bitwise_count(own_masks[i] ^ masks[j]) <= apart
                if kind == 0:  # inside a leaf both would find the other
                    near &= np.repeat(moved[part], size[part]) | (i < j)
                i, j = i[near], j[near]
                same = test(own[i], letters[j])
                yield i[same] + base, j[same]
                k = last


def _best(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Per word that has near ones here: their number and the first by count and code points."""
    a, b = np.r_[i, j], np.r_[j, i]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][:len(a)])
    near = np.diff(np.r_[first, len(a)])
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in a[first]], pa.string()), pa.array(near.astype(np.int64)),
         pa.array(-n[b[first]]), pa.array([words[k] for k in b[first]], pa.string())],
        ["word", "n_near", "best_n", "best"])


def _search(table: pa.Table) -> pa.Table:
    visit = np.asarray(table.column("visit"))
    order = np.argsort(visit, kind="stable")
    words = table.column("word").to_pylist()
    words = [words[k] for k in order]
    n = np.asarray(table.column("n"))[order]
    home, replaced = int((visit == 0).sum()), int((visit == 1).sum())
    found = list(pairs_of_cell(words[:home], words[home:home + replaced], words[home + replaced:]))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return pa.Table.from_batches([_best(words, n, i, j)])


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, n_near, best): each word that has near ones, how many, and the first of them by count
    (-n) and code points, as a struct."""
    rows = dealt(words, top_trees(words, sample, cell))
    found = rows.groupBy("length", "cell").applyInArrow(
        _search, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct(F.col("best_n"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root) by pointer jumping; counts rise along forms, so there is no
    circle."""
    links = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = cut_lineage(links.join(on, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_more")))
        links = jumped.drop("_more")
        if jumped.where("_more").isEmpty():
            return links


def variants(docs: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word (`docs` has doc_id and text)."""
    words = cut_lineage(vocabulary(docs))
    most = -F.col("best.best_n")
    formed = F.col("best").isNotNull() & (most >= 2 * F.col("n"))
    near = cut_lineage(words.join(near_words(words, sample, cell), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best.word")).alias("form"), F.when(formed, most).alias("form_n")))
    ends = roots(near.where("form IS NOT NULL"))
    return near.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# The checksum is worked out byte by byte; near words share what is left when one letter goes.
OP12_SQL = """
WITH tbl AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lower_runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM runs GROUP BY ALL),
summed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(doc || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)]
      ELSE [192 + (ord(c) >> 6), 128 + ord(c) % 64] END))),
    lambda s, b: xor(s >> 8, t[CAST(xor(s % 256, b) AS BIGINT) + 1])), 4294967295) AS h
  FROM lower_runs, tbl),
kept AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT))
    || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times
  FROM summed),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM kept WHERE length(word) >= 5
  GROUP BY word HAVING sum(times) >= 3),
less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b
    ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
near AS (
  SELECT word, count(*) AS n_near, max(m) AS most FROM pairs GROUP BY word),
best AS (
  SELECT p.word, min(p.other) AS best FROM pairs p JOIN near USING (word)
  WHERE p.m = near.most GROUP BY p.word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN most >= 2 * w.n THEN best END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
chain AS (
  WITH RECURSIVE steps AS (
    SELECT word, word AS here, 0 AS depth FROM formed
    UNION ALL SELECT s.word, f.form, depth + 1 FROM steps s JOIN formed f ON f.word = s.here
    WHERE f.form IS NOT NULL)
  SELECT word, max_by(here, depth) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
"""

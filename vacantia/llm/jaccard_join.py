"""N-gram Jaccard join (operator 7) by signature trees.

A document's set holds its distinct word shingles. Two sets link when their Jaccard similarity
reaches a bound; a link is never missed:

1. Equal sets are one class; only one set of a class goes on.
2. Two linked sets share one of the least tokens of each under any common order (the prefix rule).
   The order puts tokens that are frequent in the corpus last (a table of hashed counts over all
   documents says how frequent), so that what many documents share brings few together. Sets that
   share a prefix token form a group; groups with the same members are one.
3. In a group a signature tree is joined with itself: its nodes hold OR-combined bitmaps and size
   ranges, and a pair of nodes is followed only if the largest possible overlap reaches the bound.
   Groups of more than CELL sets are cut into a grid of tasks. A task returns a spanning forest of
   its possible pairs, not the pairs.
4. Sets connected by possible pairs form a family. Exact overlaps are counted inside a family (a
   large one again as a grid), which leaves the true links; their components are the result.

Defined cases: a null text or one without words has an empty set and links with nothing; fewer
words than a shingle has are one shingle; repeated rows are equal sets; a null id is no document
that others can be named after, so such a row has no component; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.shuffle import with_position
from ..session import cut_lineage
from .graph import components, forest
from .words import Texts, hashes, mix, packed, texts_of, windows, with_added, without_text, words_of

BITS = 1024        # of a bitmap; a set of more than FULL shingles has 4, 16 or 64 times as many
FULL = 1200
TABLE = 1 << 18    # hashed counts that order the tokens
CELL = 1024        # most sets on a side of a tree task
FAMILY = 512       # most sets, and
SHINGLES = 1 << 20  # about most shingles, on a side of a counting task
FAN = 8            # children of a node
BROADCAST_IDS = 1_000_000  # ids of 8 bytes that may be broadcast

_STEPS = [FULL, 4 * FULL, 16 * FULL]  # sizes above which a bitmap is four times as wide


@dataclass(frozen=True)
class Bound:
    """Sets link when 100 * intersection >= percent * union, of shingles of `size` words."""

    size: int = 3
    percent: int = 90

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (n * self.percent + 99) // 100 + 1

    def enough(self, common: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Whether an overlap of `common` links sets of `both` shingles together."""
        return (100 + self.percent) * common >= self.percent * both


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, shingle) of all sets, ordered by owner and shingle."""
    words = words_of(texts, lower=True)
    at, value = windows(words, size)
    owner = words.owner[at]
    count = np.bincount(words.owner, minlength=len(texts))
    for k in range(1, size):  # texts with fewer words: all of them are the one shingle
        few = np.flatnonzero(count == k)
        if len(few):
            first = np.searchsorted(words.owner, few)
            one = mix(words.hash[first] + np.uint64(k))
            for step in range(1, k):
                one = mix(one + words.hash[first + step])
            owner, value = np.concatenate([owner, few]), np.concatenate([value, one])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(40)).astype(np.int64) % TABLE


def _token_counts(docs: DataFrame, bound: Bound) -> np.ndarray:
    """How many documents hold a shingle of each bucket: a table of fixed size over all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLE, np.int64)
        for batch in batches:
            for texts in texts_of(batch.column("_text")):
                total += np.bincount(_bucket(shingle_sets(texts, bound.size)[1]), minlength=TABLE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])],
                                         names=["bucket", "n"])

    counts = packed(docs).select("_text").mapInArrow(count, "bucket int, n long")
    table = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(TABLE, np.int64)
    total[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return total


def width(n: np.ndarray) -> np.ndarray:
    """Class of a set's bitmap, which has BITS * 4 ** class bits."""
    return np.searchsorted(_STEPS, n, side="left")


def bitmaps(owner: np.ndarray, shingle: np.ndarray, n: np.ndarray) -> pa.Array:
    """One bitmap per set, `n` shingles each."""
    words = (BITS // 64) << (2 * width(n))
    start = np.concatenate([[0], np.cumsum(words)])
    bit = (mix(shingle) >> np.uint64(20)).astype(np.int64) & (words[owner] * 64 - 1)
    out = np.zeros(start[-1], np.uint64)
    np.bitwise_or.at(out, start[owner] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return pa.Array.from_buffers(pa.binary(), len(n), [
        None, pa.py_buffer((start * 8).astype(np.int32)), pa.py_buffer(out)])


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of the next narrower class: a bit keeps its place modulo the new width."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), 4, -1), axis=1)


def _lists(owner: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _prints(owner: np.ndarray, shingle: np.ndarray, n: int) -> list[np.ndarray]:
    """Two independent 64-bit sums over each set: equal for equal sets."""
    ends = np.searchsorted(owner, np.arange(n + 1))
    out = []
    for value in (mix(shingle + np.uint64(1)), mix(shingle ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        out.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
    return out


def profiles(docs: DataFrame, bound: Bound = Bound()) -> DataFrame:
    """id, n (set size), p1 and p2 (equal for equal sets), bitmap and prefix tokens of each row."""
    counts = docs.sparkSession.sparkContext.broadcast(_token_counts(docs, bound))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column("_text")):
                owner, shingle = shingle_sets(texts, bound.size)
                n = np.bincount(owner, minlength=len(texts))
                p1, p2 = _prints(owner, shingle, len(texts))
                order = np.lexsort((shingle, counts.value[_bucket(shingle)], owner))
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                first = place < np.where(n > 0, bound.prefix(n), 0)[owner]
                columns, names = without_text(batch, texts)
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(n, pa.int64()), pa.array(p1), pa.array(p2),
                               bitmaps(owner, shingle, n),
                               _lists(owner[first], shingle[order][first].view(np.int64), len(texts),
                                      pa.int64())],
                    names=names + ["n", "p1", "p2", "bitmap", "prefix"])

    rows = packed(docs, "doc_id")
    out = rows.mapInArrow(profile, with_added(
        rows, "n long, p1 long, p2 long, bitmap binary, prefix array<long>"))
    return out.select(F.col("_row.doc_id").alias("id"), "n", "p1", "p2", "bitmap", "prefix")


def _grid(rows: DataFrame, key: str, blocks: Column, spread: str) -> DataFrame:
    """Adds cell (x, y) and the row's own block: rows of a key with several blocks go to each task
    of a triangular grid that their block takes part in."""
    rows = rows.withColumn("_blocks", blocks.cast("int")).withColumn(
        "block", F.pmod(F.xxhash64(spread), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    rows = rows.withColumn("_other", other).withColumn("x", F.least("block", "_other")).withColumn(
        "y", F.greatest("block", "_other")).drop("_blocks", "_other")
    return rows.repartition(key, "x", "y").sortWithinPartitions(key, "x", "y")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one (key, x, y) after the other, from batches in that order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy() for c in (key, "x", "y")], axis=1)
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            now = tuple(ids[start].tolist())
            if last is not None and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _popcount(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


class Tree:
    """Levels of nodes over sets in order of size; level 0 has the sets themselves."""

    def __init__(self, bitmap: np.ndarray, size: np.ndarray):
        self.order = np.lexsort((bitmap[:, 0], size))
        bitmap, size = bitmap[self.order], size[self.order]
        # Of a set, at most `spare` elements share a bit with another of its elements.
        self.levels = [(bitmap, size, size, size - _popcount(bitmap))]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, spare = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0),
                                np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(spare, at)))


def _may_link(bound: Bound, one, i, other, j) -> np.ndarray:
    """Whether some set below node i may link with one below node j: the sizes must fit, and the
    largest overlap is the number of common bits and what may hide in them."""
    bits, low, high, spare = one
    bits2, low2, high2, spare2 = other
    fits = (100 * high[i] >= bound.percent * low2[j]) & (100 * high2[j] >= bound.percent * low[i])
    most = _popcount(bits[i] & bits2[j]) + np.minimum(spare[i], spare2[j])
    most = np.minimum(most, np.minimum(high[i], high2[j]))
    return fits & bound.enough(most, low[i] + low2[j])


def tree_forest(bound: Bound, rank: np.ndarray, label: np.ndarray, left: Tree,
                right: Tree | None = None, at_once: int = 4096):
    """Spanning pairs of all pairs that may link: of the sets of one tree, or between two. Both trees
    are descended together, pair by pair of nodes. `rank` numbers the sets of left, then of right;
    `label` says which numbers are joined already, and is returned with what is joined now."""
    same = right is None
    right = left if same else right
    shift = 0 if same else len(left.order)
    out = []
    top, top2 = len(left.levels) - 1, len(right.levels) - 1
    work = [(top, top2, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while work:
        a, b, i, j = work.pop()
        if len(i) > at_once:
            work += [(a, b, i[s:s + at_once], j[s:s + at_once])
                     for s in range((len(i) - 1) // at_once * at_once, -1, -at_once)]
            continue
        may = _may_link(bound, left.levels[a], i, right.levels[b], j)
        i, j = i[may], j[may]
        if not len(i):
            continue
        if a == b == 0:
            keep = i != j if same else slice(None)
            u, v = rank[left.order[i[keep]]], rank[shift + right.order[j[keep]]]
            spanning, label = forest(len(label), u, v, label)
            out.append((u[spanning], v[spanning]))
            continue
        step, step2 = (a > 0 and (a >= b)), (b > 0 and (b >= a))
        if step:
            i, j = _children(i, j, len(left.levels[a - 1][0]))
        if step2:
            j, i = _children(j, i, len(right.levels[b - 1][0]))
        if same and a - step == b - step2:
            i, j = i[i <= j], j[i <= j]
        work.append((a - step, b - step2, i, j))
    return out, label


def _children(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each i replaced by its children (of n nodes), with its j."""
    below = (i[:, None] * FAN + np.arange(FAN)).ravel()
    return below[below < n], np.repeat(j, FAN)[below < n]


def _of_group(bound: Bound, rank, n, maps, block, x, y) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning pairs of one task: trees of each width class, and of neighbouring classes (sets that
    may link differ too little in size to be further apart)."""
    classes = width(n)
    label = np.arange(len(rank))
    sides = [block == x] if x == y else [block == x, block == y]

    def of(side: np.ndarray, c: int, fold: bool) -> tuple[np.ndarray, np.ndarray] | None:
        at = np.flatnonzero(side & (classes == c))
        if not len(at):
            return None
        bits = np.frombuffer(b"".join(maps[at]), np.uint64).reshape(len(at), -1)
        return at, folded(bits) if fold else bits

    for c in np.unique(classes):
        pairs = [((sides[0], c, False), None if x == y else (sides[1], c, False))]
        pairs.append(((sides[0], c, False), (sides[-1], c + 1, True)))
        if x != y:
            pairs.append(((sides[1], c, False), (sides[0], c + 1, True)))
        for left, right in pairs:
            one, other = of(*left), of(*right) if right else None
            if one is None or (right and other is None):
                continue
            at = np.concatenate([one[0], other[0]]) if right else one[0]
            trees = [Tree(bits, n[own]) for own, bits in ([one, other] if right else [one])]
            found, label = tree_forest(bound, rank[at], label, *trees)
            yield from found


def _tree_edges(bound: Bound):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, size = [], [], 0
        for group in _groups(batches, "token"):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            ids, n = group["id"].to_numpy(), group["n"].to_numpy()
            block, x, y = group["block"].to_numpy(), group["x"][0].as_py(), group["y"][0].as_py()
            known, rank = np.unique(ids, return_inverse=True)
            maps = np.array(group["bitmap"].to_pylist(), object)
            for u, v in _of_group(bound, rank, n, maps, block, x, y):
                a.append(known[u])
                b.append(known[v])
                size += len(u)
            if size > 50_000:
                yield _pairs(a, b)
                a, b, size = [], [], 0
        if a:
            yield _pairs(a, b)

    return edges


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))],
                                      names=["a", "b"])


def candidate_families(sets: DataFrame, bound: Bound) -> DataFrame:
    """(id, component): sets connected by pairs that may link. `sets` has one row per class."""
    tokens = sets.select("id", F.explode("prefix").alias("token"))
    i = F.xxhash64("id")
    shared = tokens.groupBy("token").agg(
        F.count("*").alias("members"), F.sum(i.bitwiseAND(F.lit((1 << 40) - 1))).alias("s1"),
        F.bit_xor(i).alias("s2")).where("members > 1")
    groups = cut_lineage(shared.groupBy("members", "s1", "s2").agg(F.min("token").alias("token"))
                         .select("token", "members"))
    members = cut_lineage(tokens.join(groups, "token"))
    rows = members.join(sets.select("id", "n", "bitmap"), "id")
    gridded = _grid(rows, "token", F.ceil(F.col("members") / CELL), "id")
    pairs = gridded.select("token", "x", "y", "block", "id", "n", "bitmap").mapInArrow(
        _tree_edges(bound), "a long, b long")
    return components(pairs)


def _verified(bound: Bound):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "family"):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
            ids, block = group["id"].to_numpy(), group["block"].to_numpy()
            i, j = linked_pairs(bound, sets)
            x, y = group["x"][0].as_py(), group["y"][0].as_py()
            if x != y:
                i, j = i[block[i] != block[j]], j[block[i] != block[j]]
            known, rank = np.unique(ids, return_inverse=True)
            spanning, _ = forest(len(known), rank[i], rank[j])
            if len(spanning):
                yield _pairs([ids[i[spanning]]], [ids[j[spanning]]])

    return verify


def linked_pairs(bound: Bound, sets: list[np.ndarray], width: int = 4096
                 ) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets that link, by exact counts: overlaps are products of 0/1 columns."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    place = np.cumsum(often) - 1
    owner, column = owner[often[column]], place[column[often[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        common += part @ part.T
    return np.nonzero(np.triu(bound.enough(common, size[:, None] + size[None, :]), 1))


def _shingles(bound: Bound):
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column("_text")):
                owner, shingle = shingle_sets(texts, bound.size)
                p1, p2 = _prints(owner, shingle, len(texts))
                ends = (np.searchsorted(owner, np.arange(len(texts) + 1)) * 8).astype(np.int64)
                sets = pa.Array.from_buffers(pa.large_binary(), len(texts), [
                    None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(shingle))])
                columns, names = without_text(batch, texts)
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(p1), pa.array(p2), sets.cast(pa.binary())],
                    names=names + ["p1", "p2", "shingles"])

    return shingles


def linked(docs: DataFrame, bound: Bound = Bound()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    rows = cut_lineage(profiles(docs, bound))
    usable = rows.where("n > 0 AND id IS NOT NULL")
    classes = cut_lineage(usable.groupBy("p1", "p2", "n").agg(F.min("id").alias("rep")))
    # A class goes on with the row of its least id; copies of that row (same id) count once.
    sets = cut_lineage(usable.join(classes, ["p1", "p2", "n"]).where("id = rep")
                       .dropDuplicates(["id", "p1", "p2"]).select("id", "n", "p1", "p2", "bitmap",
                                                                  "prefix"))
    families = cut_lineage(candidate_families(sets, bound)
                           .withColumnRenamed("component", "family"))
    members = families.join(sets.select("id", "n", "p1", "p2"), "id")
    sizes = members.groupBy("family").agg(
        F.greatest(F.ceil(F.count("*") / FAMILY), F.ceil(F.sum("n") / SHINGLES)).alias("blocks"))
    placed = cut_lineage(members.join(sizes, "family").select("id", "p1", "p2", "family", "blocks"))
    wanted = placed.select(F.col("id").alias("doc_id")).distinct()
    if placed.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = packed(docs.join(wanted, "doc_id", "left_semi"), "doc_id")
    full = texts.mapInArrow(_shingles(bound), with_added(texts, "p1 long, p2 long, shingles binary"))
    full = (full.select(F.col("_row.doc_id").alias("id"), "p1", "p2", "shingles")
            .join(placed, ["id", "p1", "p2"]).dropDuplicates(["id", "p1", "p2"]))
    gridded = _grid(full, "family", F.col("blocks"), "id")
    edges = gridded.select("family", "x", "y", "block", "id", "shingles").mapInArrow(
        _verified(bound), "a long, b long")
    found = components(edges).select(F.col("id").alias("rep"), "component")
    named = cut_lineage(classes.join(found, "rep", "left").select(
        "p1", "p2", "n", F.coalesce("component", "rep").alias("_component")))
    out = rows.select("id", "n", "p1", "p2").join(named, ["p1", "p2", "n"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("_component", "id"))
                      .alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def kept_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (five-word shingles, similarity 0.8) the
    document with the least id stays, once; rows without an id stay. Where an id has several rows,
    each text counts as a document of its own, the least hash of a text first."""
    bound = Bound(size=5, percent=80)
    named, rest = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    if named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = named.join(_leaders(named, bound), "doc_id", "left_semi").select(*docs.columns)
    else:
        texts = F.xxhash64("text").alias("hash")
        rows = named.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", texts)
        once = rows.groupBy("doc_id", "hash", "text").agg(F.first("_row").alias("_row"))
        placed = with_position(once, [F.col("doc_id"), F.col("hash"), F.col("text")], "_place")
        apart = placed.select(F.col("_place").alias("doc_id"), "text")
        kept = placed.join(_leaders(apart, bound).withColumnRenamed("doc_id", "_place"), "_place",
                           "left_semi").select("_row.*")
    return kept.unionByName(rest).select(*docs.columns)


def _leaders(docs: DataFrame, bound: Bound) -> DataFrame:
    """The least id of each group of documents, whose ids are distinct."""
    return linked(docs, bound).where("doc_id = component_id").select("doc_id").distinct()


# All links by counting common shingles, then the closure: for the small tables of the check only.
OP7_SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda w: w <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1),
      lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS shingles
  FROM split),
rows_of AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS i, b.doc_id AS j
  FROM rows_of a JOIN rows_of b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    AND 100 * b.n >= 90 * a.n AND 100 * a.n >= 90 * b.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)),
steps AS (SELECT i, j FROM links UNION SELECT j, i FROM links),
reach AS (
  SELECT doc_id AS i, doc_id AS j FROM documents
  UNION SELECT r.i, s.j FROM reach r JOIN steps s ON r.j = s.i)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT i, min(j) AS component_id FROM reach GROUP BY i) c ON c.i = s.doc_id
"""

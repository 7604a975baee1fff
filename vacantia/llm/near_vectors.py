"""Embedding near-dedup (operator 9): a robust-pruned flat graph over overlapping cluster shards.

Only vectors with equal labels are compared. Equal vectors are one class. Classes go to the shards
of their OVERLAP nearest centroids (a bounded sample); a large shard is cut into blocks. Every block
builds a graph: near and random candidates are pruned robustly (a candidate that is much nearer to
an accepted neighbour than to the node itself is dropped), the nearest few stay. The adjacency lists
that a class gets in several shards are united. A query then walks greedily from a block's medoid
to its neighbourhood and from there expands along edges through all that is within range. Every
link is verified in double precision. Blocks of one shard meet pairwise in a grid of tasks, and a
pair is counted only in the first shard that both are in, so that no pairs are sent anywhere: a task
returns counts and a spanning forest. Recall is audited against brute force, per class and in growing
batches, until LINKED classes with true links were seen or all were asked (so a table with hardly any
link is compared as a whole); if it is too low the overlap is doubled.

Defined cases: a vector that is null, zero, or has null or non-finite components links with
nothing, nor does one without label or id; vectors of different lengths are never compared;
repeated rows are vectors of their own, with cosine 1; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .graph import components, forest

SHARD = 250           # classes per centroid, about
CENTROIDS = 4096      # most centroids: bounds the broadcast (and blocks take what is more)
OVERLAP = 3
BLOCK = 1500          # most classes, about, on a side of a task
NEAR, RANDOM = 48, 16  # candidates of a node
DEGREE, NEAREST = 16, 8
ALPHA = 1.2
BEAM = 16
SLACK = 0.01          # nodes this much below the bound are expanded too
AUDIT, MOST = 256, 4096  # classes of the first batch of the audit, and of any
LINKED = 64           # classes with true links that the audit wants to see
RECALL = 0.95


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = [np.asarray(x, np.float64) for x in column.to_pylist()]
    x = np.stack(rows)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) \
        / np.abs(x).max(axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """(space, vec, id, copies): one row per distinct usable vector of a label and length."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
            .select("vec_id", F.concat_ws(":", F.col("label").cast("string"),
                                          F.size("embedding").cast("string")).alias("space"),
                    wide.alias("vec"))
            .where(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
            .groupBy("space", "vec").agg(F.min("vec_id").alias("id"),
                                         F.count("*").alias("copies")))


def _sharded(rows: DataFrame, overlap: int) -> DataFrame:
    """Rows (space, id, copies, vec, shards): the numbers of the row's nearest centroids."""
    count = rows.count()
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(CENTROIDS, count // SHARD)))
    table = picked.select("space", "vec").toArrow()
    centroids: dict[str, tuple[int, np.ndarray]] = {}
    spaces = np.array(table["space"].to_pylist(), object)
    for k, space in enumerate(sorted(set(spaces))):
        own = np.flatnonzero(spaces == space)
        centroids[space] = k * CENTROIDS, _matrix(table["vec"].take(pa.array(own)))
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards: list = [[-1]] * batch.num_rows  # labels without a centroid are one shard
            spaces = np.array(batch.column("space").to_pylist(), object)
            for space in set(spaces) & shared.value.keys():
                first, known = shared.value[space]
                own = np.flatnonzero(spaces == space)
                near = _matrix(batch.column("vec").take(pa.array(own))) @ known.T
                best = np.argsort(-near, axis=1, kind="stable")[:, :overlap]
                for i, row in zip(own.tolist(), best):
                    shards[i] = sorted((first + row).tolist())
            yield batch.append_column("shards", pa.array(shards, pa.list_(pa.int64())))

    return rows.select("space", "id", "copies", "vec").mapInArrow(
        assign, "space string, id long, copies long, vec array<double>, shards array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one key after the other, from batches in that order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        ids = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        start = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[start]:
                if last is not None and ids[start] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, i - start))
                last, start = ids[start], i
    if held:
        yield pa.Table.from_batches(held)


def neighbours(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Adjacency (rows of node numbers, -1 where none) of a robust-pruned graph over unit vectors,
    and the medoid."""
    n = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    if n == 1:
        return np.full((1, 1), -1), medoid
    away = 1 - x @ x.T
    np.fill_diagonal(away, np.inf)
    k = min(NEAR, n - 1)
    near = np.argpartition(away, k - 1, axis=1)[:, :k]
    pool = np.concatenate([near, rng.integers(0, n, (n, RANDOM)), np.full((n, 1), medoid)], axis=1)
    dist = np.take_along_axis(away, pool, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    pool, dist = np.take_along_axis(pool, order, axis=1), np.take_along_axis(dist, order, axis=1)
    alive = np.isfinite(dist)
    rows = np.arange(n)
    kept = [np.where(alive[:, i], pool[:, i], -1) for i in range(min(NEAREST, pool.shape[1]))]
    for _ in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        chosen = pool[rows, first]
        kept.append(np.where(some, chosen, -1))
        alive[rows, first] = False
        alive &= ~(ALPHA * away[chosen[:, None], pool] <= dist) & some[:, None]
    forward = np.stack(kept, axis=1)
    # Edges lead both ways, as far as a node's list has room.
    source, target = np.repeat(rows, forward.shape[1]), forward.ravel()
    source, target = source[target >= 0], target[target >= 0]
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    pair = np.unique(a * n + b)
    a, b = pair // n, pair % n
    order = np.lexsort((away[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    room = 2 * (DEGREE + NEAREST)
    out = np.full((n, room), -1)
    fits = place < room
    out[a[fits], place[fits]] = b[fits]
    return out, medoid


def in_range(queries: np.ndarray, x: np.ndarray, edges: np.ndarray, medoid: int, bound: float,
             at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with a cosine of at least `bound` that a search of the graph finds."""
    found_q, found_n = [], []
    n = len(x)
    for start in range(0, len(queries), at_once):
        q = queries[start:start + at_once]
        seen, opened = np.zeros((len(q), n), bool), np.zeros((len(q), n), bool)
        close = np.full((len(q), n), -2.0)

        def look(who: np.ndarray, nodes: np.ndarray) -> None:
            pair = np.unique(who * n + nodes)
            who, nodes = pair // n, pair % n
            new = ~seen[who, nodes]
            who, nodes = who[new], nodes[new]
            seen[who, nodes] = True
            for s in range(0, len(who), 50_000):
                w, m = who[s:s + 50_000], nodes[s:s + 50_000]
                close[w, m] = np.einsum("pd,pd->p", q[w], x[m])

        def expand(who: np.ndarray, nodes: np.ndarray) -> None:
            opened[who, nodes] = True
            near = edges[nodes]
            who = np.repeat(who, near.shape[1])
            near = near.ravel()
            look(who[near >= 0], near[near >= 0])

        look(np.arange(len(q)), np.full(len(q), medoid))
        while True:  # greedy: open the best of each query's beam until all of the beam are open
            beam = min(BEAM, n)
            best = np.argpartition(-close, beam - 1, axis=1)[:, :beam]
            value = np.take_along_axis(close, best, axis=1)
            value[np.take_along_axis(opened, best, axis=1) | (value < -1.5)] = -2
            pick = value.argmax(axis=1)
            who = np.flatnonzero(value[np.arange(len(q)), pick] > -1.5)
            if not len(who):
                break
            expand(who, best[who, pick[who]])
        while True:  # range: open everything that is near enough
            who, nodes = np.nonzero((close >= bound - SLACK) & ~opened)
            if not len(who):
                break
            for s in range(0, len(who), 20_000):
                expand(who[s:s + 20_000], nodes[s:s + 20_000])
        who, nodes = np.nonzero(close >= bound)
        found_q.append(who + start)
        found_n.append(nodes)
    return (np.concatenate(found_q), np.concatenate(found_n)) if found_q else (
        np.zeros(0, int), np.zeros(0, int))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, near) of every node of every block."""
    for group in _groups(batches, ["space", "shard", "block"]):
        group = group.combine_chunks()
        ids = group["id"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        edges, _ = neighbours(_matrix(group["vec"])[order], np.random.default_rng(len(ids)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array([ids[e[e >= 0]] for e in edges], pa.list_(pa.int64()))],
            names=["id", "near"])


def _local(ids: np.ndarray, lists: list) -> np.ndarray:
    """United lists as node numbers; neighbours of other blocks are left out."""
    size = np.array([len(x) for x in lists])
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if size.sum() else np.zeros(0, int)
    at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full((len(ids), max(1, size.max())), -1)
    out[np.repeat(np.arange(len(ids)), size), place] = np.where(ids[at] == flat, at, -1)
    return out


def _links(bound: float):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["space", "shard", "x", "y"]):
            group = group.combine_chunks()
            ids = group["id"].to_numpy()
            order = np.argsort(ids)
            group, ids = group.take(pa.array(order)), ids[order]
            vec, block = _matrix(group["vec"]), group["block"].to_numpy()
            copies, shard = group["copies"].to_numpy(), group["shard"][0].as_py()
            near, shards = group["near"].to_pylist(), group["shards"].to_pylist()
            x, y = group["x"][0].as_py(), group["y"][0].as_py()
            pairs = []
            for asks, holds in {(x, y), (y, x)}:
                q, nodes = np.flatnonzero(block == asks), np.flatnonzero(block == holds)
                if len(q) and len(nodes):
                    edges = _local(ids[nodes], [near[i] for i in nodes])
                    medoid = int((vec[nodes] @ vec[nodes].mean(axis=0)).argmax())
                    i, j = in_range(vec[q], vec[nodes], edges, medoid, bound)
                    i, j = q[i], nodes[j]
                    pairs.append(np.minimum(i, j)[i != j] * len(ids) + np.maximum(i, j)[i != j])
            pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, int)
            i, j = pair // len(ids), pair % len(ids)
            # Count a pair only in the first shard that both are in.
            first = np.array([next(s for s in shards[a] if s in set(shards[b])) == shard
                              for a, b in zip(i.tolist(), j.tolist())], bool)
            i, j = i[first], j[first]
            spanning, _ = forest(len(ids), i, j)
            count = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(
                j, weights=copies[i], minlength=len(ids))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[some], ids[i[spanning]]])),
                 pa.array(np.concatenate([np.full(len(some), -1), ids[j[spanning]]])),
                 pa.array(np.concatenate([count[some], np.zeros(len(spanning))]).astype(np.int64))],
                names=["a", "b", "links"])

    return links


def search(rows: DataFrame, bound: float, overlap: int = OVERLAP) -> DataFrame:
    """(a, b, links): where b is -1, links (weighted by copies) that class a has in one task; else
    a and b are joined by a link."""
    placed = cut_lineage(_sharded(rows, overlap))
    members = placed.withColumn("shard", F.explode("shards"))
    key = ["space", "shard"]
    sizes = members.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = cut_lineage(members.join(sizes, key).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    built = (members.select(*key, "block", "id", "vec").repartition(*key, "block")
             .sortWithinPartitions(*key, "block").mapInArrow(_edges, "id long, near array<long>"))
    united = cut_lineage(built.groupBy("id").agg(
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = (members.join(united, "id").withColumn("_other", other)
             .withColumn("x", F.least("block", "_other")).withColumn("y", F.greatest("block", "_other")))
    grid = [*key, "x", "y"]
    return (cells.select(*grid, "block", "id", "copies", "vec", "shards", "near")
            .repartition(*grid).sortWithinPartitions(*grid)
            .mapInArrow(_links(bound), "a long, b long, links long"))


class Audit(NamedTuple):
    recall: float  # mean over the classes with true links; 1 without any
    linked: int    # classes with true links that were seen
    asked: int


def _asked(rows: DataFrame, table: pa.Table, found: DataFrame, bound: float) -> list[float]:
    """Of each class of table (space, id, vec) that has true links, the share that was found."""
    asked: dict[str, tuple] = {}
    spaces = np.array(table["space"].to_pylist(), object)
    for space in set(spaces):
        own = pa.array(np.flatnonzero(spaces == space))
        asked[space] = table["id"].take(own).to_numpy(), _matrix(table["vec"].take(own))
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = np.array(batch.column("space").to_pylist(), object)
            for space in set(spaces) & shared.value.keys():
                ids, vec = shared.value[space]
                every = np.flatnonzero(spaces == space)
                for s in range(0, len(every), 1000):
                    own = pa.array(every[s:s + 1000])
                    hit = vec @ _matrix(batch.column("vec").take(own)).T >= bound
                    hit &= ids[:, None] != batch.column("id").take(own).to_numpy()[None, :]
                    links = hit @ batch.column("copies").take(own).to_numpy()
                    some = links > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[some]), pa.array(links[some])], names=["a", "links"])

    exact = rows.select("space", "id", "copies", "vec").mapInArrow(count, "a long, links long")
    true = {r.a: r.n for r in exact.groupBy("a").agg(F.sum("links").alias("n")).collect()}
    if not true:
        return []
    ids = rows.sparkSession.createDataFrame([(a,) for a in true], "a long")
    got = found.where("b = -1").join(F.broadcast(ids), "a", "left_semi")
    seen = {r.a: r.n for r in got.groupBy("a").agg(F.sum("links").alias("n")).collect()}
    return [min(1.0, seen.get(a, 0) / n) for a, n in true.items()]


def recall(rows: DataFrame, found: DataFrame, bound: float) -> Audit:
    """Mean share of the true links of a class that were found."""
    keyed = rows.withColumn("_key", F.xxhash64("id", F.lit(1)))
    shares: list[float] = []
    asked, batch, after = 0, AUDIT, F.lit(True)
    while len(shares) < LINKED:
        table = keyed.where(after).orderBy("_key", "id").limit(batch).select(
            "_key", "space", "id", "vec").toArrow()
        if not table.num_rows:
            break
        shares += _asked(rows, table, found, bound)
        asked += table.num_rows
        if table.num_rows < batch:
            break
        key, last = table["_key"][-1].as_py(), table["id"][-1].as_py()
        after = (F.col("_key") > key) | ((F.col("_key") == key) & (F.col("id") > last))
        batch = min(2 * batch, MOST)
    out = Audit(float(np.mean(shares)) if shares else 1.0, len(shares), asked)
    logging.getLogger(__name__).info("recall %.4f of %d linked classes, %d asked", *out)
    return out


def linked(vectors: DataFrame, bound: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors."""
    rows = cut_lineage(classes(vectors))
    overlap = OVERLAP
    found = cut_lineage(search(rows, bound, overlap))
    while recall(rows, found, bound).recall < RECALL and overlap < CENTROIDS:
        overlap *= 2
        found = cut_lineage(search(rows, bound, overlap))
    counts = found.where("b = -1").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("more"))
    groups = components(found.where("b >= 0"))
    named = cut_lineage(rows.join(counts, "id", "left").join(groups, "id", "left").select(
        "space", "vec", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id")))
    wide = F.transform("embedding", lambda x: x.cast("double"))
    keyed = vectors.select("vec_id", wide.alias("vec"), F.when(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull(),
        F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string")))
        .alias("space"))
    out = keyed.join(named, ["space", "vec"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# All pairs of a label, then the closure: for the small tables of the check only.
OP9_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM usable a JOIN usable b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS i, vec_id AS j FROM embeddings
  UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
parts AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i),
counts AS (SELECT i, count(*) AS n FROM links GROUP BY i)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, p.component_id, p.component_id = e.vec_id AS kept
FROM embeddings e JOIN parts p ON p.i = e.vec_id LEFT JOIN counts c ON c.i = e.vec_id
"""

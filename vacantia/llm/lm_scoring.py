"""Language-model scoring (operator 10): a hierarchical Pitman-Yor model.

A word is drawn in the restaurant of the word before it (the end token before a text's first word),
whose parent is one restaurant of all words. Its base measure is half uniform over the vocabulary and
one unknown type (as the base score has it), and half spells words byte by byte: a restaurant for each
context of three preceding bytes, whose parent has the context of two, then one, then none. At how many
tables the customers of a dish sit (Chinese restaurant process) is sampled by Gibbs sweeps that draw
every count anew; each table sends a customer to the parent. Predictive probabilities are averaged over
the samples and used for scores and perplexity. Levels are sampled one after the other, once: contexts
given the frequencies of words, then words given the tables of contexts.

Everything is counted over all learnable documents. Word pairs are dealt out by their first word into
buckets of bounded size (a frequent first word has several), together with where they occur, so that a
pair is counted, seated and looked up in one place, a range of first words at a time. A bucket holds the TOP most frequent words by rank
(broadcast, bounded) and others by hash; these meet the vocabulary, which grows with the corpus and is
never collected, in a join. Between sweeps over the vocabulary one number is exchanged. What is drawn
depends on hashes and on the number of tokens, not on partitions or batches.

Defined cases: a null or empty text is the end token alone; rows without an id are scored and not
learned from; repeated rows count and are scored once each; without learnable documents spelling is
uniform; an empty table gives an empty result; extra columns are ignored, whatever their names. In pairs
words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..session import cut_lineage
from .words import LOWER, hashes, mix, packed, texts_of, words_of

TOP = 1 << 19       # words that are broadcast, 32 bytes each
SWEEPS, BURN_IN = 8, 3
EXACT = 64          # customers of a cell up to which its table count has its exact distribution
DISCOUNTS = (0.5, 0.65, 0.75)  # of contexts with one, two and three bytes
CONTEXT = 0.75      # discount of contexts of one word
CONTEXT_SWEEPS, CONTEXT_BURN_IN = 4, 2
STRENGTH = 1.0
UNIFORM = 0.5       # share of the base measure that is uniform over the vocabulary
BLANK = 32          # stands before and after a word; no word holds it
EVERY_CHUNKS = 16   # chunks whose words a task adds up before it hands them on
BLOCK_CHUNKS, BLOCK_DOCS = 6, 1 << 15  # chunks and documents of a block at most
BUCKETS, BUCKET_TOKENS = 64, 1 << 21  # buckets of all but small tables, at least; tokens of a bucket, about
HOT = 1 << 18       # tokens after a word from which on its pairs go to several buckets
RANGE_TOKENS = 1 << 17  # tokens of a row of a bucket, about: the first words of a bucket are worked on by ranges


def learnable() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of data[start:end] one after the other, and where each begins and the last ends."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return data[at], offsets


def _binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


_END = hashes(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))  # the empty word


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, word, n) of a task's words; the end token is the empty word."""
    held: list[tuple] = []
    documents = 0

    def total() -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        n = np.concatenate([x[1] for x in held])
        words = pa.concat_arrays([x[2] for x in held])
        held.clear()
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(own.view(np.int64)), words.take(pa.array(first)),
             pa.array(np.bincount(back, weights=n).astype(np.int64))], names=["h", "word", "n"])

    for batch in batches:
        for texts in texts_of(batch.column("_text")):
            documents += len(texts)
            words = words_of(texts, lower=True)
            own, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            held.append((own, n, _binaries(*gathered(LOWER[texts.data], words.starts[first],
                                                     words.ends[first]))))
            if len(held) >= EVERY_CHUNKS:
                yield total()
    if documents:
        held.append((_END, np.array([documents]), pa.array([b""], pa.binary())))
        yield total()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(h, word, n): how often each token occurs in docs."""
    counts = packed(docs).select("_text").mapInArrow(_tally, "h long, word binary, n long")
    return counts.groupBy("h", "word").agg(F.sum("n").alias("n"))


@functools.cache
def _stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S[c, t]: weights of all seatings of c <= most customers of a dish at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1:c + 2] = np.logaddexp(
                out[c, :c + 1], out[c, 1:c + 2] + np.log(np.maximum(c - d * t, 0)))
    return out


@functools.cache
def _stable(d: float) -> tuple[np.ndarray, ...]:
    """Tables for _log_sum: log(t / c), the exponent per customer and log of the variance per table
    of the saddle point; and log x with what the positive stable density has above its own."""
    low = -600 / (2 - d)
    near = np.exp(np.concatenate([np.linspace(low, -20, 20_000), np.linspace(-19.99, -1e-6, 20_000)]))
    # near is 1 - z at the saddle point
    g, r = 1 - near ** d, -np.expm1(np.log(near))
    slope = r * d * near ** (d - 1) / g
    exponent = np.log1p(-near ** d) / slope - np.log1p(-near)
    variance = slope + r * r * d * (1 - d) * near ** (d - 2) / g - slope ** 2
    x = np.linspace(-8, 30, 800)
    v = np.linspace(0, 120, 12_000)
    left = np.pi * np.exp(-v)  # distance from pi
    turn = np.pi - left
    turn[0] = 1e-12
    with np.errstate(divide="ignore"):
        shape = (np.log(np.sin(d * turn) / np.sin(left.clip(max=np.pi - 1e-12))) / (1 - d)
                 + np.log(np.sin((1 - d) * turn) / np.sin(d * turn)))
    density = np.empty(len(x))
    for k, value in enumerate(x):
        inner = shape - np.exp(np.minimum(shape - value * d / (1 - d), 700)) + np.log(left)
        top = inner.max()
        density[k] = top + np.log(np.trapezoid(np.exp(inner - top), v))
    density += np.log(d / (1 - d) / np.pi) - x / (1 - d)
    own = np.exp((x - np.log(d)) / (d - 1))
    own = -own ** d + np.exp(x) * own - 0.5 * np.log(2 * np.pi * d * (1 - d) * own ** (d - 2))
    return -np.log(slope), exponent, np.log(variance), x, density - own


def _log_sum(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of the probability that t table sizes (with generating function 1 - (1 - z)^d) sum to c:
    the saddle point, corrected by the stable law's for few and very unequal tables."""
    ratio, exponent, variance, x, above = _stable(d)
    at = np.log(t) - np.log(c)
    return (c * np.interp(at, ratio, exponent) - 0.5 * (
        np.log(2 * np.pi * t) + np.interp(at, ratio, variance))
        + np.interp(np.log(c) - np.log(t) / d, x, above))


class Given:
    """Random numbers that are there already, a row for each draw."""

    def __init__(self, rows: np.ndarray):
        self.rows = iter(rows)

    def random(self, n: int) -> np.ndarray:
        return next(self.rows)


class Keyed:
    """Random numbers of cells by their keys, whatever cells stand beside them."""

    def __init__(self, key: np.ndarray, seed: int):
        self.key = mix(key.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))

    def random(self, shape: tuple[int, int]) -> np.ndarray:
        return np.stack([(mix(self.key + np.uint64(k + 1)) >> np.uint64(11)) * 2.0 ** -53
                         for k in range(shape[0])])


def draw_tables(c: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells with c customers, in proportion to S(c, t) weight^t: exact up to EXACT
    customers, from the asymptotic law of the table sizes above."""
    t = np.minimum(c, 1)
    uniform = rng.random((2, len(c)))
    log_weight = np.log(np.maximum(weight, 1e-300))
    order = np.argsort(c, kind="stable")
    order = order[np.searchsorted(c[order], 2):]
    most = 2
    while most <= EXACT:  # cells of up to 2, 4, 8... customers at once
        a, b = np.searchsorted(c[order], [most // 2, most], side="right")
        steps, base = np.arange(1, most + 1), _stirling(d)[:, 1:most + 1]
        for s in range(a, b, 20_000):
            own = order[s:min(b, s + 20_000)]
            t[own] = 1 + _drawn(base[c[own]] + log_weight[own, None] * steps, Given(uniform[:, own]))
        most *= 2
    large = order[np.searchsorted(c[order], EXACT, side="right"):]
    for s in range(0, len(large), 1000):
        own = large[s:s + 1000]
        t[own] = _draw_large(c[own], log_weight[own] - np.log(d), d, Given(uniform[:, own]))
    return t


def _drawn(log_p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column of each row, in proportion to exp(log_p)."""
    p = np.exp(log_p - log_p.max(axis=1, keepdims=True)).cumsum(axis=1)
    return (p < rng.random(len(p))[:, None] * p[:, -1:] * (1 - 1e-12)).sum(axis=1)


def _draw_large(c: np.ndarray, log_mean: np.ndarray, d: float,
                rng: np.random.Generator) -> np.ndarray:
    size = c[:, None].astype(float)

    def log_p(t: np.ndarray) -> np.ndarray:
        # log(t!) by Stirling's series, within 1e-6 from t = 1 on
        fact = (t + 1.5) * np.log(t + 2) - t - 2 + 0.5 * np.log(2 * np.pi) + 1 / (12 * (t + 2)) \
            - 1 / (360 * (t + 2) ** 3) + 1 / (1260 * (t + 2) ** 5) - np.log(t + 1)
        return t * log_mean[:, None] - fact + _log_sum(size, t, d)

    rows = np.arange(len(c))
    grid = np.exp(np.linspace(0, 1, 96) * np.log(size))
    for points in (64, 128):  # twice nearer to where the mass is
        some = log_p(grid)
        some = some > some.max(axis=1, keepdims=True) - 40
        first = np.maximum(some.argmax(axis=1) - 1, 0)
        last = np.minimum(grid.shape[1] - some[:, ::-1].argmax(axis=1), grid.shape[1] - 1)
        low, high = np.floor(grid[rows, first]), np.minimum(np.ceil(grid[rows, last]), c)
        step = np.maximum(1, np.ceil((high - low + 1) / points))
        fine = low[:, None] + step[:, None] * np.arange(points)
        grid = np.minimum(fine, high[:, None])
    value = log_p(np.minimum(fine + (step[:, None] - 1) / 2, size))
    value[fine > high[:, None]] = -np.inf
    t = fine[rows, _drawn(value, rng)] + np.floor(rng.random(len(c)) * step)
    return np.clip(t, 1, c).astype(np.int64)


class Seating:
    """Table counts of cells (restaurant, dish). Predictions and parents need no more than the
    counts, so the sizes of tables are summed out: given a gamma variable of its restaurant, the
    count of each cell is drawn anew in every sweep, whatever its number of customers."""

    def __init__(self, restaurant: np.ndarray, customers: np.ndarray, discount: float,
                 elsewhere: float | np.ndarray = 0.0):
        self.r, self.c, self.d = restaurant, customers.astype(np.int64), discount
        self.n = int(restaurant.max()) + 1 if len(restaurant) else 0
        self.elsewhere = elsewhere  # tables of the same restaurant that other tasks hold
        self.t = np.minimum(self.c, 1)
        self._count()

    def _count(self) -> None:
        self.tables = np.bincount(self.r, weights=self.t, minlength=self.n) + self.elsewhere

    @property
    def owner(self) -> np.ndarray:
        """The cell of each table."""
        return np.repeat(np.arange(len(self.c)), self.t)

    @property
    def size(self) -> np.ndarray:
        """Customers of each table in one of the seatings that have these counts."""
        out = np.ones(int(self.t.sum()), np.int64)
        some = self.t > 0
        out[(np.cumsum(self.t) - self.t)[some]] += (self.c - self.t)[some]
        return out

    def move_in(self, customers: np.ndarray) -> None:
        """The customers that children send now."""
        self.c = customers.astype(np.int64)
        self.t = np.minimum(np.maximum(self.t, 1), self.c)
        self._count()

    def gibbs(self, parent: np.ndarray, rng: np.random.Generator) -> None:
        """One sweep: with x of Gamma(STRENGTH / d + tables), the tables of a restaurant's cells are
        independent, with weight S(c, t) (d x parent)^t."""
        x = rng.gamma(STRENGTH / self.d + self.tables)
        self.t = draw_tables(self.c, self.d * x[self.r] * parent, self.d, rng)
        self._count()

    def backoff(self) -> np.ndarray:
        """Per restaurant, the weight of the parent's prediction."""
        total = np.bincount(self.r, weights=self.c, minlength=self.n)
        return (STRENGTH + self.d * self.tables) / (STRENGTH + total)

    def predict(self, parent: np.ndarray) -> np.ndarray:
        """Per cell, the predictive probability of its dish in its restaurant."""
        total = np.bincount(self.r, weights=self.c, minlength=self.n)
        return (self.c - self.d * self.t) / (STRENGTH + total)[self.r] + self.backoff()[self.r] * parent


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, byte, word) of each byte of the words, closing blank included. A context is the three
    bytes before, the last one lowest."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    start = np.concatenate([[0], np.cumsum(size + 4)])  # three blanks before, one after
    line = np.full(start[-1], BLANK, np.int64)
    word = np.repeat(np.arange(n), size)
    line[np.arange(len(data)) + 4 * word + 3] = data
    at = np.arange(len(line)) - np.repeat(start[:-1], size + 4) >= 3
    at = np.flatnonzero(at)
    context = (line[at - 3] << 16) | (line[at - 2] << 8) | line[at - 1]
    return context, line[at], np.repeat(np.arange(n), size + 1)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("word")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, int] = {}
    for batch in batches:
        context, byte, _ = spelled(*_words(batch))
        key, n = np.unique(context << 8 | byte, return_counts=True)
        for k, v in zip(key.tolist(), n.tolist()):
            held[k] = held.get(k, 0) + v
    yield pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.int64()),
                                      pa.array(list(held.values()), pa.int64())], names=["cell", "n"])


def _subtree(cell: np.ndarray, n: np.ndarray, root: np.ndarray, seed: int) -> list[tuple]:
    """Gibbs sampling of all restaurants whose context ends with one byte: averaged predictions of
    cells and averaged backoff weights, for three, two and one byte of context."""
    rng = np.random.default_rng(seed)
    context, byte = cell >> 8, cell & 255
    cell2, up3 = np.unique((context & 0xFFFF) << 8 | byte, return_inverse=True)
    cell1, up2 = np.unique(cell2 & 0xFFFF, return_inverse=True)
    known, rest = [], []
    for own in (cell, cell2, cell1):
        ids, r = np.unique(own >> 8, return_inverse=True)
        known.append(ids)
        rest.append(r)
    three = Seating(rest[0], n, DISCOUNTS[2])
    two = Seating(rest[1], np.bincount(up3, weights=three.t, minlength=len(cell2)), DISCOUNTS[1])
    one = Seating(rest[2], np.bincount(up2, weights=two.t, minlength=len(cell1)), DISCOUNTS[0])
    base = root[cell1 & 255]
    sums = [0.0] * 6
    for sweep in range(SWEEPS):
        p1 = one.predict(base)
        p2 = two.predict(p1[up2])
        three.gibbs(p2[up3], rng)
        two.move_in(np.bincount(up3, weights=three.t, minlength=len(cell2)))
        two.gibbs(p1[up2], rng)
        one.move_in(np.bincount(up2, weights=two.t, minlength=len(cell1)))
        one.gibbs(base, rng)
        if sweep >= BURN_IN:
            p1 = one.predict(base)
            p2 = two.predict(p1[up2])
            now = (three.predict(p2[up3]), p2, p1, three.backoff(), two.backoff(), one.backoff())
            sums = [a + b / (SWEEPS - BURN_IN) for a, b in zip(sums, now)]
    return [(level, key, value) for level, key, value in zip(
        (3, 2, 1, -3, -2, -1), (cell, cell2, cell1, *known), sums)]


class Spelling:
    """The averaged spelling model: sorted keys and values per level."""

    def __init__(self, root: np.ndarray, levels: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.root, self.levels = root, levels

    def _look(self, level: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.levels.get(level, (np.zeros(0, np.int64), np.zeros(0)))
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key))
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, values[at]

    def logp(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 of the probability that each word is spelled."""
        context, byte, word = spelled(data, offsets)
        p, factor = self.root[byte].copy(), np.ones(len(byte))
        open_ = np.ones(len(byte), bool)
        for level, mask in ((3, 0xFFFFFF), (2, 0xFFFF), (1, 0xFF)):
            hit, value = self._look(level, (context & mask) << 8 | byte)
            hit &= open_
            p[hit] = value[hit]
            open_ &= ~hit
            known, weight = self._look(-level, context & mask)
            factor[open_ & known] *= weight[open_ & known]
        return np.bincount(word, weights=np.log10(factor * p), minlength=len(offsets) - 1)


def fit_spelling(words: DataFrame) -> Spelling:
    """Every word of the vocabulary is spelled once. Subtrees (one per last byte, so at most 256)
    are sampled in parallel. The model holds the byte sequences of length four that words have, which
    alphabets bound, not the size of the corpus."""
    cells = cut_lineage(words.select("word").where(F.length("word") > 0)
                        .mapInArrow(_cells, "cell long, n long")
                        .groupBy("cell").agg(F.sum("n").alias("n")))
    last, byte = F.shiftright("cell", 8).bitwiseAND(F.lit(255)), F.col("cell").bitwiseAND(F.lit(255))
    # Of the root, only the customers that one table per dish and restaurant sends are known here.
    seen = cells.select(last.alias("last"), byte.alias("byte")).distinct().groupBy("byte").count()
    root = np.full(256, 0.5)
    for row in seen.collect():
        root[row["byte"]] += row["count"]
    root /= root.sum()

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        cell, n = table["cell"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, n = cell[order], n[order]
        for end in np.unique(cell >> 8 & 255).tolist():
            own = (cell >> 8 & 255) == end
            for level, key, value in _subtree(cell[own], n[own], root, end):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), level), pa.int32()), pa.array(key), pa.array(value)],
                    names=["level", "key", "value"])

    model = (cells.withColumn("_last", last).repartition("_last").select("cell", "n")
             .mapInArrow(sample, "level int, key long, value double").toArrow())
    level, key, value = (model[c].to_numpy() for c in ("level", "key", "value"))
    levels = {}
    for k in (3, 2, 1, -3, -2, -1):
        order = np.argsort(key[level == k])
        levels[k] = key[level == k][order], value[level == k][order]
    return Spelling(root, levels)


def base_measure(spelled, types: int):
    """Probability of a word before it is met, from that of its spelling (a number or a column)."""
    return spelled * (1 - UNIFORM) + UNIFORM / (types + 1)


def most_frequent(words: DataFrame) -> DataFrame:
    """The words from a frequency on that at most TOP words reach. The frequency comes from counts of
    words by eighths of a doubling (some hundred rows), so that no task has to sort them all."""
    step = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for row in sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += row["count"]
        if total > TOP:
            break
        least = row["step"]
    return words.where(step >= least if least is not None else F.lit(False))


def _by_hash(words: DataFrame, *columns: str) -> tuple[np.ndarray, ...]:
    """h and the columns of the most frequent words, in order of h. Words with equal hashes (none are
    expected) are left to the join."""
    top = most_frequent(words).select("h", *columns).toArrow()
    h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    alone = ~(np.append(same, False) | np.append(False, same))[:len(h)]
    return h[alone], *[top[c].to_numpy()[order][alone] for c in columns]


def _listed(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column with one row per part."""
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind.to_pandas_dtype())))


LISTS = {"tail": pa.int64(), "spell": pa.float64(), "chunks": pa.int64()}
CELLS = ("u", "w", "c", "k", "t", "docs")
HEAD = {"rows": None, "tokens": pa.int64(), "known": pa.int64(), "base": pa.float64()}
NAMES = ["bucket", "block", *HEAD]


def _bytes(arrays: list[np.ndarray]) -> bytes:
    """Arrays of 32-bit numbers, compressed: pairs are most of what is shuffled and stored."""
    planes = [np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4).T.ravel() for x in arrays]
    raw = np.concatenate([np.array([len(arrays), *map(len, arrays)], "<i8").view(np.uint8), *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _arrays(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd"), np.uint8)
    sizes = raw[8:8 + 8 * int(raw[:8].view("<i8")[0])].view("<i8")
    ends = 8 + 8 * len(sizes) + 4 * np.cumsum(np.append(0, sizes))
    return [np.ascontiguousarray(raw[a:b].reshape(4, -1).T).view("<i4").ravel()
            for a, b in zip(ends[:-1], ends[1:])]


def _read(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    """What row i holds of a bucket."""
    out = {name: batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in LISTS}
    return out | dict(zip(CELLS, _arrays(batch.column("cells")[i].as_py())))


def _lists(batch: pa.RecordBatch, names) -> list[tuple[np.ndarray, np.ndarray]]:
    """Values and borders of list columns."""
    return [(batch.column(n).values.to_numpy(zero_copy_only=False), batch.column(n).offsets.to_numpy())
            for n in names]


def _runs(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and the run of every place."""
    start = np.append(True, u[1:] != u[:-1])[:len(u)]
    return np.flatnonzero(start), np.cumsum(start) - 1


def _rank(h: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in `top`, and whether it is there."""
    at = np.minimum(np.searchsorted(top, h), max(len(top) - 1, 0))
    return at, top[at] == h if len(top) else np.zeros(len(h), bool)


class Block:
    """The tokens of some documents in order, as rows for the buckets of their pairs."""

    def __init__(self, model: Fixed):
        self.model, self.hash, self.size, self.learn, self.rows = model, [], [], [], []
        self.tail, self.spell = [], []
        self.chunks = self.docs = 0

    def add(self, batch: pa.RecordBatch, texts) -> None:
        n, m = len(texts), self.model
        words = words_of(texts, lower=True)
        size = np.bincount(words.owner, minlength=n) + 1
        line = np.full(int(size.sum()), _END[0])
        line[np.arange(len(words.hash)) + words.owner] = words.hash
        part = batch.slice(texts.first, n)
        learn = part.column("_learn").to_numpy(zero_copy_only=False)
        # Words of documents that are learned from are in the vocabulary with their spelling.
        new = np.flatnonzero(~learn[words.owner])
        new = new[~_rank(words.hash[new], m.top)[1]]
        own, first = np.unique(words.hash[new], return_index=True)
        at = new[first]
        if len(at):
            self.tail.append(own)
            self.spell.append(m.spelling.logp(*gathered(LOWER[texts.data], words.starts[at], words.ends[at])))
        self.hash.append(line)
        self.size.append(size)
        self.learn.append(learn)
        self.rows.append(part.column("_row"))
        self.chunks += 1
        self.docs += n

    def head(self, block: int) -> pa.RecordBatch:
        """The rows of the documents with what is known of them already."""
        m, size = self.model, np.concatenate(self.size)
        owner = np.repeat(np.arange(self.docs), size)
        at, hit = _rank(np.concatenate(self.hash), m.top)
        known = np.bincount(owner[hit], minlength=self.docs)
        base = np.bincount(owner[hit], weights=m.base[at[hit]], minlength=self.docs)
        rows = pa.concat_arrays(self.rows)
        ends = pa.array([0, len(rows)], pa.int32())
        bucket = -1 - int(mix(np.array([block], np.uint64))[0] >> np.uint64(34))  # so heads are spread
        columns = [pa.array([bucket], pa.int32()), pa.array([block], pa.int64()),
                   pa.ListArray.from_arrays(ends, rows), _listed([size], pa.int64()), _listed([known], pa.int64()),
                   _listed([base], pa.float64())]
        empty = [pa.nulls(1, pa.list_(kind)) for kind in LISTS.values()] + [pa.nulls(1, pa.binary())]
        return pa.RecordBatch.from_arrays(columns + empty, names=NAMES + [*LISTS, "cells"])

    def pieces(self, block: int, rows: pa.DataType) -> pa.RecordBatch:
        """One row per bucket that a pair falls into: its cells by first and second word, and the
        documents that these are in."""
        m = self.model
        h, size = np.concatenate(self.hash), np.concatenate(self.size)
        owner = np.repeat(np.arange(self.docs), size)
        learn = np.concatenate(self.learn)[owner]
        w, hit = _rank(h, m.top)
        tail, other = np.unique(h[~hit], return_inverse=True)
        w[~hit] = len(m.top) + other
        spell = np.full(len(tail), np.nan)
        for own, value in zip(self.tail, self.spell):
            spell[np.searchsorted(tail, own)] = value
        end, frequent = _rank(_END, m.top)
        if not frequent[0]:
            end = np.searchsorted(tail, _END)
            spell[end] = m.spelling.logp(np.zeros(0, np.uint8), np.zeros(2, np.int64))
            end = len(m.top) + end
        before = np.concatenate([_END, h[:-1]])  # each document ends with the end token
        u = np.concatenate([end, w[:-1]])
        salts = np.ones(len(m.top) + len(tail), np.uint64)
        salts[:len(m.top)] = -(-m.n // HOT)
        salt = mix(h) % salts[u]
        bucket = (mix(before + salt * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m.buckets)).astype(np.int64)
        types = len(m.top) + len(tail)
        key = (bucket * types + u) * types + w
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        k = np.diff(np.append(first, len(key)))
        c = np.add.reduceat(learn[order].astype(np.int64), first)
        key, w = np.divmod(key[first], types)
        bucket, u = np.divmod(key, types)
        docs = owner[order]
        out: dict[str, list] = {name: [] for name in (*LISTS, "cells")}
        borders = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        firsts = np.append(first, len(docs))
        for a, b in zip(borders[:-1], borders[1:]):
            pu, pw = u[a:b], w[a:b]
            own = np.unique(np.concatenate([pu[pu >= len(m.top)], pw[pw >= len(m.top)]]))
            cells = [np.where(part >= len(m.top), len(m.top) + np.searchsorted(own, part), part) for part in (pu, pw)]
            out["cells"].append(_bytes([*cells, c[a:b], k[a:b], np.zeros(0), docs[firsts[a]:firsts[b]]]))
            out["tail"].append(tail[own - len(m.top)].view(np.int64))
            out["spell"].append(spell[own - len(m.top)])
            out["chunks"].append(np.array([block]))
        n = len(borders) - 1
        columns = [pa.array(bucket[borders[:-1]], pa.int32()), pa.array(np.full(n, block)), pa.nulls(n, rows),
                   *[pa.nulls(n, pa.list_(kind)) for kind in list(HEAD.values())[1:]]]
        columns += [_listed(out[name], kind) for name, kind in LISTS.items()]
        return pa.RecordBatch.from_arrays(
            columns + [pa.array(out["cells"], pa.binary())], names=NAMES + [*LISTS, "cells"])


class Fixed:
    """What all tasks know: the most frequent words (hashes, counts, base scores), how many buckets
    there are, the spelling model."""

    def __init__(self, top, n, base, rest, buckets, spelling):
        self.top, self.n, self.base, self.rest = top, n, base, rest
        self.buckets, self.spelling = buckets, spelling


def _blocks(shared):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in batches:
            kind = pa.list_(batch.column("_row").type)
            ids = batch.column("_id").to_numpy()
            for texts in texts_of(batch.column("_text")):
                for part in _cut(texts):
                    if held is not None and (held.chunks >= BLOCK_CHUNKS or held.docs + len(part) >= BLOCK_DOCS):
                        yield held.head(block)
                        yield held.pieces(block, kind)
                        held = None
                    if held is None:
                        held, block = Block(shared.value), int(ids[part.first])
                    held.add(batch, part)
        if held is not None:
            yield held.head(block)
            yield held.pieces(block, kind)

    return go


def _cut(texts):
    """Parts of fewer than BLOCK_DOCS documents."""
    step = BLOCK_DOCS // 2
    for s in range(0, len(texts), step):
        at = texts.offsets[s:s + step + 1]
        yield type(texts)(texts.data[at[0]:at[-1]], at - at[0], texts.first + s)


def _gathered(shared):
    """Rows of one bucket become its ranges, their cells counted and seated; heads stay as they are."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            kind = batch.column("rows").type
            for i, own in enumerate(batch.column("bucket").to_pylist()):
                if own < 0:
                    yield batch.slice(i, 1)
                    continue
                if own != bucket and held:
                    yield from _ranges(shared.value, bucket, held, kind)
                    held = []
                bucket = own
                x = _read(batch, i)
                held.append(x | {k: x[k].copy() for k in LISTS})  # no view keeps a batch
        if held:
            yield from _ranges(shared.value, bucket, held, kind)

    return go


def _ranges(m: Fixed, bucket: int, held: list[dict], rows: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row for each range of a bucket's first words. Borders follow the words and the number of tokens,
    not the blocks that the tokens came in."""
    n = len(m.top)
    tail = np.unique(np.concatenate([x["tail"].view(np.uint64) for x in held]))
    chunks = np.unique(np.concatenate([x["chunks"] for x in held]))
    spell, tokens = np.full(len(tail), np.nan), np.zeros(2, np.int64)
    for x in held:
        place = np.searchsorted(tail, x.pop("tail").view(np.uint64))
        given = ~np.isnan(x["spell"])
        spell[place[given]] = x["spell"][given]
        for name in "uw":
            x[name] = x[name].copy()  # which may be read-only
            late = np.flatnonzero(x[name] >= n)
            x[name][late] = n + place[x[name][late] - n]
        x["ends"] = np.append(0, np.cumsum(x["k"], dtype=np.int64)).astype(np.int32)
        frequent = x["ends"][np.searchsorted(x["u"], np.int32(n))]
        tokens += frequent, x["ends"][-1] - frequent
        x["slot"] = np.searchsorted(chunks, x["chunks"][0]) if len(x["chunks"]) else 0
    borders = [np.zeros(1, np.int64)]
    for first, size, own in zip((0, n), (n, len(tail)), tokens):
        parts = int(max(1, -(-own // RANGE_TOKENS)))
        borders.append(first + size * np.arange(1, parts + 1) // parts)
    borders = np.unique(np.concatenate(borders)).astype(np.int32)
    rng = np.random.default_rng(bucket)
    places = [np.searchsorted(x["u"], borders) for x in held]
    for i in range(len(borders) - 1):
        some = [(x, at[i], at[i + 1]) for x, at in zip(held, places) if at[i] < at[i + 1]]
        if some:
            yield _range(m, bucket, rng, some, tail, spell, chunks, rows)


def _range(m: Fixed, bucket: int, rng: np.random.Generator, held: list[tuple[dict, int, int]], tail: np.ndarray,
           spell: np.ndarray, chunks: np.ndarray, rows: pa.DataType) -> pa.RecordBatch:
    """The cells a to b of each of the parts held, as one row."""
    def joined(name: str) -> np.ndarray:
        return np.concatenate([x[name][a:b] for x, a, b in held])

    n, types = len(m.top), len(m.top) + len(tail)
    counts = joined("k")
    key, back = np.unique(joined("u").astype(np.int64) * types + joined("w"), return_inverse=True)
    c, k = (np.bincount(back, weights=v).astype(np.int64) for v in (joined("c"), counts))
    docs = np.concatenate([x["slot"] * BLOCK_DOCS + x["docs"][x["ends"][a]:x["ends"][b]].astype(np.int64)
                           if len(x["docs"]) else np.zeros(0, np.int64) for x, a, b in held])
    order = np.argsort(np.repeat(back, counts))
    u, w = np.divmod(key, types)
    t = _seated(m, rng, u, w, c)
    own = np.unique(np.concatenate([u[u >= n], w[w >= n]]))
    u, w = (np.where(part >= n, n + np.searchsorted(own, part), part) for part in (u, w))
    out = {"tail": tail[own - n].view(np.int64), "spell": spell[own - n], "chunks": chunks}
    cells = _bytes([u, w, c, k, t, docs[order]])
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, rows),
         *[pa.nulls(1, pa.list_(kind)) for kind in list(HEAD.values())[1:]],
         *[_listed([out[name]], kind) for name, kind in LISTS.items()], pa.array([cells], pa.binary())],
        names=NAMES + [*LISTS, "cells"])


def _seated(m: Fixed, rng: np.random.Generator, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Tables of the cells, which stand in order of u, summed over the samples. Of a word whose pairs are in several buckets, tables
    elsewhere are taken to be as many for each customer as here."""
    some = np.flatnonzero(c > 0)
    t = np.zeros(len(c), np.int64)
    if not len(some):
        return t
    first, r = _runs(u[some])
    own = u[some][first]
    here = np.bincount(r, weights=c[some])
    more = np.zeros(len(own))
    hot = np.flatnonzero(own < len(m.top))
    hot = hot[m.n[own[hot]] > HOT]
    more[hot] = m.n[own[hot]] / here[hot] - 1
    total = max(int(m.n.sum()) + m.rest[0], 1)
    parent = np.full(len(some), m.rest[0] / max(m.rest[1], 1) / total)
    top = w[some] < len(m.top)
    parent[top] = m.n[w[some][top]] / total
    seats = Seating(r, c[some], CONTEXT)
    for sweep in range(CONTEXT_SWEEPS):
        seats.elsewhere = more * np.bincount(r, weights=seats.t)
        seats._count()
        seats.gibbs(parent, rng)
        if sweep >= CONTEXT_BURN_IN:
            t[some] += seats.t
    return t


KEPT = CONTEXT_SWEEPS - CONTEXT_BURN_IN


def _sent(shared):
    """(h, context, tables): customers that contexts send to a word, and tables of words whose pairs
    are in several buckets. Of the most frequent words, a task's sums."""
    def row(h: np.ndarray, context: bool, tables: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(np.full(len(h), context)), pa.array(tables.astype(np.int64))],
            names=["h", "context", "tables"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n = len(m.top)
        several = m.n > HOT
        sums = np.zeros((2, n))
        for batch in batches:
            for i in range(batch.num_rows):
                x = _read(batch, i)
                tail, u, w, t = x["tail"], x["u"], x["w"], x["t"]
                top = w < n
                sums[0] += np.bincount(w[top], weights=t[top], minlength=n)
                hot = u < n
                hot[hot] = several[u[hot]]
                sums[1] += np.bincount(u[hot], weights=t[hot], minlength=n)
                yield row(tail, False, np.bincount(w[~top] - n, weights=t[~top], minlength=len(tail)))
        for tables, context in zip(sums, (False, True)):
            own = np.flatnonzero(tables)
            yield row(m.top[own], context, tables[own])

    return go


class Model:
    """The vocabulary with seatings and spellings, its totals, the spelling model, and the pairs of
    the documents with their seatings."""

    def __init__(self, docs: DataFrame, learn: Column | None = None, *keep: str):
        """Learns from the rows of docs where `learn` (all rows without it); the others are held ready
        for `scores`."""
        self.spark = spark = docs.sparkSession
        learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
        words = cut_lineage(vocabulary(docs.where(learn)))
        self.spelling = fit_spelling(words)
        figures = words.agg(F.sum("n"), F.count("*")).first()
        self.total, self.types = int(figures[0] or 0), int(figures[1])
        h, n = _by_hash(words, "n")
        self.fixed = Fixed(h, n, self.base(n), (self.total - int(n.sum()), self.types - len(n)),
                           max(1, min(BUCKETS, self.total >> 16), -(-self.total // BUCKET_TOKENS)), self.spelling)
        self.shared = spark.sparkContext.broadcast(self.fixed)
        self.prior = functools.partial(base_measure, types=self.types)
        self.store = self._gather(self._pieces(docs, learn, *keep))
        sent = cut_lineage(self.store.where("bucket >= 0").select(*LISTS, "cells").mapInArrow(
            _sent(self.shared), "h long, context boolean, tables long").groupBy("h", "context").agg(
            F.sum("tables").alias("tables")))
        # Bounded: the words with more than HOT tokens.
        hot = sent.where("context").select("h", "tables").toArrow()
        self.hot = dict(zip(hot["h"].to_numpy().view(np.uint64).tolist(), (hot["tables"].to_numpy() / KEPT).tolist()))
        self._seat(words, sent.where("NOT context").select("h", "tables"))

    def _pieces(self, docs: DataFrame, learn: Column, *keep: str) -> DataFrame:
        marked = docs.select(learn.alias("_learn"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row") if keep
                             else F.struct(F.lit(0).alias("_")).alias("_row"),
                             F.col("text").cast("string").alias("_text"), F.monotonically_increasing_id().alias("_id"))
        return marked.mapInArrow(_blocks(self.shared), self._schema(T.ArrayType(marked.schema["_row"].dataType)))

    @staticmethod
    def _schema(rows: T.DataType) -> T.StructType:
        fields = T.StructType.fromDDL("bucket int, block long").add("rows", rows)
        for name, kind in (HEAD | LISTS).items():
            if kind is not None:
                fields = fields.add(name, T.ArrayType(from_arrow_type(kind)))
        return fields.add("cells", T.BinaryType())

    def _gather(self, pieces: DataFrame) -> DataFrame:
        rows = pieces.schema["rows"].dataType
        # So many partitions that few hold several buckets.
        return cut_lineage(pieces.repartition(4 * self.fixed.buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(
            _gathered(self.shared), self._schema(rows)))

    def _seat(self, words: DataFrame, sent: DataFrame) -> None:
        """The restaurant of all words: its customers are the tables of contexts. Between sweeps the
        tasks exchange the number of tables."""
        spelling = self.spark.sparkContext.broadcast(self.spelling)

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("h", "n", "c")] + [pa.array(spelling.value.logp(*_words(batch)))],
                    names=["h", "n", "c", "spell"])

        tables = F.greatest(F.lit(1), F.coalesce(F.round(F.col("tables") / KEPT), F.lit(1))).cast("long")
        seen = cut_lineage(words.join(sent, "h", "left").select("h", "word", "n", tables.alias("c")).mapInArrow(
            spell, "h long, n long, c long, spell double"))
        figures = seen.agg(F.sum("c"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
        self.customers = int(figures[0] or 0)
        self.discount = d = min(0.95, max(0.1, figures[1] / max(figures[1] + 2 * figures[2], 1)))
        prior = self.prior

        def drawn(batch, x, sweep):
            spell = batch.column("spell").to_numpy()
            return draw_tables(batch.column("c").to_numpy(), d * x * prior(10 ** spell), d,
                               Keyed(batch.column("h").to_numpy(), sweep))

        def counted(x, sweep):
            def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                n = sum(int(drawn(batch, x, sweep).sum()) for batch in batches)
                yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

            return go

        # A word with one customer has one table.
        several, alone = seen.where("c > 1"), int(figures[1])
        count, rng, xs = self.types, np.random.default_rng(0), []
        for sweep in range(SWEEPS):
            xs.append(float(rng.gamma(STRENGTH / d + count)))
            if sweep + 1 < SWEEPS:
                count = alone + int(several.mapInArrow(counted(xs[-1], sweep), "n long").agg(F.sum("n")).first()[0] or 0)

        def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mean = sum(drawn(batch, xs[s], s) for s in range(BURN_IN, SWEEPS)) / (SWEEPS - BURN_IN)
                yield batch.append_column("tables", pa.array(np.asarray(mean, float)))

        self.words = cut_lineage(seen.mapInArrow(
            averaged, "h long, n long, c long, spell double, tables double"))
        # Averages of whole numbers by a number known: added up as whole numbers, whatever the order.
        self.tables = int(self.words.agg(F.sum(F.round(F.col("tables") * (SWEEPS - BURN_IN)).cast("long"))).first()[0]
                          or 0) / (SWEEPS - BURN_IN)

    def fresh(self) -> float:
        """Weight of the base measure in the word restaurant."""
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)

    def scored_words(self) -> DataFrame:
        """(h, n, score): log10 of the averaged predictive probability of each word without context."""
        own = (F.col("c") - self.discount * F.col("tables")) / (STRENGTH + self.customers)
        return self.words.select("h", "n", F.log10(
            own + self.fresh() * self.prior(F.pow(F.lit(10.0), "spell"))).alias("score"))

    def base(self, n):
        return np.log10((n + 0.1) / (self.total + 0.1 * (self.types + 1)))

    def scores(self, store: DataFrame | None = None) -> DataFrame:
        """_row (a struct of the `keep` columns), n_tokens, n_known, base_score and score of the
        documents of the store (the model's own without one)."""
        store = self.store if store is None else store
        table = self.scored_words()
        h, score = _by_hash(table, "score")
        known = self.spark.sparkContext.broadcast((10 ** score, self.hot))
        cells = store.where("bucket >= 0").select("bucket", *LISTS, "cells")
        added = "bucket int, block long, at array<smallint>, add_known array<bigint>, add_base array<double>, " \
                "add_score array<double>"
        frequent = cells.mapInArrow(_sums(self.shared, known), added)
        tail = cells.mapInArrow(_tail(self.shared, known), "block long, doc int, times long, h long, own double, "
                                                           "back double, spell double")
        by_hash = table.groupBy("h").agg(F.sum("n").alias("n"), F.max("score").alias("word"))
        p = F.coalesce(F.pow(F.lit(10.0), "word"), self.fresh() * self.prior(F.pow(F.lit(10.0), "spell")))
        seen = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / (self.total + 0.1 * (self.types + 1)))
        times = F.col("times")
        rare = tail.join(by_hash, "h", "left").groupBy("block", "doc").agg(
            F.sum(F.when(F.col("n").isNotNull(), times).otherwise(0)).alias("known"), F.sum(times * seen).alias("base"),
            F.sum(times * F.log10(F.col("own") + F.col("back") * p)).alias("score")).select(
            F.lit(-1).alias("bucket"), "block", F.array(F.col("doc").cast("short")).alias("at"),
            F.array("known").alias("add_known"), F.array("base").alias("add_base"),
            F.array("score").alias("add_score"))
        heads = store.where("bucket < 0").select("block", "rows", "tokens", "known", "base")
        line = frequent.unionByName(rare).unionByName(
            heads.withColumn("bucket", F.lit(-2)), allowMissingColumns=True)
        out = T.StructType().add("_row", store.schema["rows"].dataType.elementType)
        for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
            out = out.add(name, kind)
        return line.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(_added, out)


def _rated(m: Fixed, batch: pa.RecordBatch, known, hot: dict):
    """Of each row: its cells' own share of the probability, the share left to the word without
    context, and the lists."""
    for i in range(batch.num_rows):
        x = _read(batch, i)
        first, r = _runs(x["u"])
        ids, t = x["u"][first], x["t"] / KEPT
        total, tables = (np.bincount(r, weights=v, minlength=len(ids)) for v in (x["c"], t))
        for k in np.flatnonzero(ids < len(m.top)).tolist():
            if m.n[ids[k]] > HOT:
                total[k], tables[k] = m.n[ids[k]], hot.get(int(m.top[ids[k]]), 0.0)
        own = (x["c"] - CONTEXT * t) / (STRENGTH + total)[r]
        back = np.where(total > 0, (STRENGTH + CONTEXT * tables) / (STRENGTH + total), 1.0)[r]
        yield i, x, own, back


def _plus(docs: np.ndarray, sums: np.ndarray, more: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by document, both sides in order of documents, added up."""
    at, hit = _rank(more, docs)
    sums[at[hit]] += extra[hit]
    at = np.searchsorted(docs, more[~hit])
    return np.insert(docs, at, more[~hit]), np.insert(sums, at, extra[~hit])


def _sums(shared, known):
    """Scores of tokens with frequent words, added up by document over the ranges of a bucket."""
    def row(bucket: int, chunks: np.ndarray, docs: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        borders = np.searchsorted(docs, np.arange(len(chunks) + 1) * BLOCK_DOCS)
        parts = list(zip(borders[:-1], borders[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(parts), bucket), pa.int32()),
             pa.array(chunks), _listed([docs[a:b] % BLOCK_DOCS for a, b in parts], pa.int16()),
             pa.nulls(len(parts), pa.list_(pa.int64())), pa.nulls(len(parts), pa.list_(pa.float64())),
             _listed([score[a:b] for a, b in parts], pa.float64())],
            names=["bucket", "block", "at", "add_known", "add_base", "add_score"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (p, hot) = shared.value, known.value
        bucket, held = None, None
        for batch in batches:
            buckets = batch.column("bucket").to_pylist()
            for i, x, own, back in _rated(m, batch, p, hot):
                top = x["w"] < len(m.top)
                log = np.zeros(len(own))
                log[top] = np.log10(own[top] + back[top] * p[x["w"][top]])
                every = np.repeat(top, x["k"])
                docs, at = np.unique(x["docs"][every], return_inverse=True)
                score = np.bincount(at, weights=np.repeat(log, x["k"])[every], minlength=len(docs))
                if buckets[i] == bucket:
                    held = held[0], *_plus(*held[1:], docs, score)
                    continue
                if held is not None:
                    yield row(bucket, *held)
                bucket, held = buckets[i], (x["chunks"].copy(), docs, score)
        if held is not None:
            yield row(bucket, *held)

    return go


def _tail(shared, known):
    """Tokens with other words, one row for each pair of a document."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (p, hot) = shared.value, known.value
        for batch in batches:
            for _, x, own, back in _rated(m, batch, p, hot):
                cell = np.repeat(np.arange(len(own)), x["k"])
                some = x["w"][cell] >= len(m.top)
                width = max(len(x["chunks"]), 1) * BLOCK_DOCS
                key, times = np.unique(cell[some] * width + x["docs"][some], return_counts=True)
                cell, docs = np.divmod(key, width)
                word = x["w"][cell] - len(m.top)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["chunks"][docs // BLOCK_DOCS]), pa.array(docs % BLOCK_DOCS, pa.int32()),
                     pa.array(times, pa.int64()), pa.array(x["tail"][word]), pa.array(own[cell]), pa.array(back[cell]),
                     pa.array(x["spell"][word])],
                    names=["block", "doc", "times", "h", "own", "back", "spell"])

    return go


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a block with all that was added up for them: first its head, then tokens with other
    words, which are yet to be counted as known, then scores of frequent words."""
    head, sums = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [head[0], pa.array(head[1]), pa.array(sums[0].astype(np.int64)), *[pa.array(s) for s in sums[1:]]],
            names=["_row", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, buckets = batch.column("block").to_numpy(), batch.column("bucket").to_numpy()
        lists = _lists(batch, ("at", "add_known", "add_base", "add_score"))
        borders = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (buckets[:-1] == -2)))
        for a, b in zip(borders, np.append(borders[1:], len(blocks))):
            if buckets[a] == -2:
                if head is not None:
                    yield done()
                row = batch.slice(a, 1)
                rows, tokens, known, base = (row.column(c).flatten() for c in ("rows", "tokens", "known", "base"))
                head = (pa.concat_arrays([rows]), tokens.to_numpy().copy())
                sums = [known.to_numpy().astype(float), base.to_numpy().copy(), np.zeros(len(rows))]
                continue
            at = lists[0][0][lists[0][1][a]:lists[0][1][b]]
            for into, (values, ends) in zip(sums, lists[1:]):
                some = values[ends[a]:ends[b]]
                if len(some):
                    into += np.bincount(at[:len(some)], weights=some, minlength=len(into))
    if head is not None:
        yield done()


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """_row (a struct of the `keep` columns), n_tokens, n_known, base_score and score."""
    pieces = model._pieces(docs, F.lit(False), *keep)
    rows = pieces.schema["rows"].dataType
    learned = model.store.where("bucket >= 0").withColumns({
        "rows": F.lit(None).cast(rows), "chunks": F.array().cast("array<bigint>")}).mapInArrow(_without_docs, pieces.schema)
    return model.scores(model._gather(pieces.unionByName(learned)))


def _without_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The learned counts of buckets, without what occurs where."""
    for batch in batches:
        cells = []
        for data in batch.column("cells").to_pylist():
            u, w, c, k, t, _ = _arrays(data)
            cells.append(_bytes([u, w, c, np.zeros(len(k)), np.zeros(0), np.zeros(0)]))
        yield batch.set_column(batch.schema.get_field_index("cells"), "cells", pa.array(cells, pa.binary()))


def perplexity(scores: DataFrame, column: str = "score") -> DataFrame:
    """One row: perplexity per token of the scored rows."""
    mean = F.sum(column) / F.sum("n_tokens")
    return scores.agg(F.pow(F.lit(10.0), -mean).alias("perplexity"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = Model(docs, learnable(), "doc_id")
    return model.scores().select(
        "_row.doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "n_tokens",
        "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")

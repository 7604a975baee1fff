"""Operators that compare or count over whole tables, against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import graph, jaccard_join, lm_scoring, near_vectors, url_filter

from .conftest import ODD, SF, words


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    groups = Groups({x for p in pairs for x in p})
    for a, b in pairs:
        groups.join(a, b)
    got = {r.id: r.component for r in graph.components(
        spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: groups.root(x) for p in pairs if p[0] != p[1] for x in p}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(texts, size):
    out = {}
    for i, text in texts.items():
        w = words(text, lower=True)
        out[i] = frozenset([tuple(w[k:k + size]) for k in range(len(w) - size + 1)]
                           or ([tuple(w)] if w else []))
    return out


def check_join(table, bound):
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    sets = sets_of(texts, bound.size)
    named = [i for i in sets if i is not None]
    groups = Groups(named)
    for k, a in enumerate(named):
        for b in named[:k]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= bound.percent * len(sets[a] | sets[b]):
                groups.join(a, b)
    rows = jaccard_join.linked(table, bound).collect()
    assert len(rows) == table.count()
    for r in rows:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else groups.root(r.doc_id))
    return sum(groups.root(i) != i for i in named)


@pytest.mark.parametrize("bound", [jaccard_join.Bound(), jaccard_join.Bound(5, 80)])
def test_jaccard_join(docs, bound):
    assert check_join(docs, bound) > 5


def test_jaccard_join_odd(spark, odd, none):
    check_join(odd, jaccard_join.Bound())
    assert jaccard_join.linked(none).count() == 0
    stage = jaccard_join.kept_documents(spark, odd, SF)
    assert stage.columns == odd.columns
    kept = [r.doc_id for r in stage.collect()]
    assert kept.count(5) == 1 and kept.count(None) == 1 and 14 not in kept


def test_several_texts_under_one_id_stay(spark):
    """Each text counts; only copies of what is kept go, whichever id they have."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a, "s"), (1, b, "s"), (1, b, "s"), (0, c, "s"), (2, a, "s"), (3, b, "s"), (2, c, "s"), (4, "", "s"),
            (None, a, "s"), (5, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    for parts in (1, 7):
        kept = jaccard_join.kept_documents(spark, docs.repartition(parts), SF)
        assert kept.columns == docs.columns
        assert sorted(map(str, kept.collect())) == sorted(map(str, [docs.where(t).first() for t in (
            "doc_id = 1 AND text LIKE 'a%'", "doc_id = 1 AND text LIKE 'b%'", "doc_id = 0", "doc_id = 4",
            "doc_id IS NULL", "doc_id = 5")]))


def test_grids_and_widths_change_nothing(spark, monkeypatch):
    """Small limits cut groups and families into many tasks, and give sets wider bitmaps."""
    monkeypatch.setattr(jaccard_join, "CELL", 4)
    monkeypatch.setattr(jaccard_join, "FAMILY", 3)
    monkeypatch.setattr(jaccard_join, "_STEPS", [40, 160, 640])
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        base = [f"w{k}" for k in range(30 + 40 * (i % 3))]
        for _ in range(int(rng.integers(0, 3))):
            base[int(rng.integers(0, len(base)))] = f"x{int(rng.integers(0, 5))}"
        rows.append((i, " ".join(base)))
    assert check_join(spark.createDataFrame(rows, "doc_id long, text string"),
                      jaccard_join.Bound()) > 20


def test_tree_prunes_no_link():
    """All pairs that link are connected by the pairs a tree join returns."""
    rng = np.random.default_rng(4)
    bound = jaccard_join.Bound(3, 80)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(70)]
    owner, shingle = np.repeat(np.arange(70), [len(s) for s in sets]), np.concatenate(sets)
    n = np.array([len(s) for s in sets])
    bits = np.frombuffer(b"".join(jaccard_join.bitmaps(owner, shingle, n).to_pylist()),
                         np.uint64).reshape(70, -1)
    found, label = jaccard_join.tree_forest(bound, np.arange(70), np.arange(70),
                                            jaccard_join.Tree(bits, n))
    i, j = jaccard_join.linked_pairs(bound, sets)
    want = {(a, b) for a in range(70) for b in range(a + 1, 70)
            if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert set(zip(i.tolist(), j.tolist())) == want
    assert (label[i] == label[j]).all()


def test_url_filter(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = url_filter.op5_url_filter(spark, SF)
    want = con.execute(url_filter.OP5_SQL)
    order = [d[0] for d in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(
        str(tuple(r)) for r in got.select(*order).collect())


URLS = [(1, None), (2, ""), (3, "no-scheme.net/x"), (4, "http://NET/"), (5, "http://net"),
        (6, "http://a.example.net/en/x?y#z"), (7, "http://a.example.net/en"),
        (8, "https://example.com/de/"), (9, "https://notexample.com/de/"), (10, "http://x.org/fr/1"),
        (11, "http://www.bad.org/p/?utm_source=a&k=1#f"), (12, "https://bad.org/p?k=1&ref=z"),
        (13, "http://bad.org/p?k=2"), (13, "http://bad.org/p?k=2"), (None, "http://bad.org/p?k=1")]


def test_url_rules_and_list(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in URLS],
                                  "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("http://bad.org/p/?k=1",), (None,), ("x",)], "url string")
    rows = [tuple(r) for r in url_filter.judged(pages, listed).select(
        "page_id", "host", "path", "rule", "verdict").collect()]
    assert len(rows) == len(URLS)
    by = {r[0]: r[1:] for r in rows}
    assert by[1] == by[2] == by[3] == ("", "", None, "allow")
    assert by[4] == ("net", "/", "net/", "block") and by[5] == ("net", "", None, "allow")
    assert by[6] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[7][2:] == ("net/", "block") and by[8][2:] == ("example.com/de/", "block")
    assert by[9][2:] == (None, "allow") and by[10][2:] == ("org/fr/", "allow")
    assert by[11][3] == by[12][3] == by[None][3] == "block" and by[13][3] == "allow"
    assert url_filter.judged(pages.limit(0), listed).count() == 0
    assert url_filter.judged(pages, listed.limit(0)).where("verdict = 'block'").count() == 3


def test_bloom_filter_has_no_false_negative(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("url_key"))
    blocks = url_filter.bloom_filter(keys)
    key = F.col("url_key")
    probed = keys.withColumn("block", url_filter._block(key)).join(blocks, "block")
    for k in range(url_filter.LONGS):
        mask = url_filter._mask(key, k)
        probed = probed.where(F.col(f"w{k}").bitwiseAND(mask) == mask)
    assert probed.count() == 5000


def test_near_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(600):
        v = base[i % 60] + rng.normal(size=16) * (0.01 if i % 2 else 0.2)
        rows.append((i, [float(x) for x in v], i % 60 % 4))
    rows += [(600 + i, rows[0][1], 0) for i in range(40)]
    rows += [(700, None, 0), (701, [0.0] * 16, 0), (702, [None] + [1.0] * 15, 0),
             (703, [float("nan")] * 16, 0), (704, [1.0, 2.0], 0), (705, rows[0][1], None),
             (706, [x * 3 for x in rows[0][1]], 0), (707, [float("inf")] * 16, 0), (708, [], 0)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "vec_id long, embedding array<double>, label int, id string, copies int")
    usable = {i: np.array(v) / np.linalg.norm(v) for i, v, k in rows if k is not None and v
              and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: k for i, _, k in rows}
    groups, count = Groups([r[0] for r in rows]), Counter()
    ids = sorted(usable)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if label[a] == label[b] and len(usable[a]) == len(usable[b]) \
                    and usable[a] @ usable[b] >= 0.98:
                groups.join(a, b)
                count[a] += 1
                count[b] += 1
    got = {r.vec_id: r for r in near_vectors.linked(table).collect()}
    assert len(got) == len(rows)
    missed = sum(count[i] - got[i].n_links for i in got)
    assert all(got[i].n_links <= count[i] for i in got) and missed <= 0.02 * sum(count.values())
    assert sum(got[i].component_id != groups.root(i) for i in got) <= 0.02 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert near_vectors.linked(table.limit(0)).count() == 0


def test_recall_of_sparse_links(spark):
    """Half of 50 isolated pairs among 3,000 vectors are missed, while a dense family is found."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 24))
    v[50:100] = v[:50] * 2 + rng.normal(size=(50, 24)) * 1e-3
    v[100:104] = v[104] + rng.normal(size=(4, 24)) * 1e-3
    rows = spark.createDataFrame([("s", [float(y) for y in x], i, 500 if 100 <= i < 105 else 1)
                                  for i, x in enumerate(v)],
                                 "space string, vec array<double>, id long, copies long")
    links = [(i + k, -1, 1) for i in range(25) for k in (0, 50)]
    links += [(i, -1, 2000) for i in range(100, 105)]
    got = near_vectors.recall(rows, spark.createDataFrame(links, "a long, b long, links long"), 0.98)
    assert got.linked >= near_vectors.LINKED and got.asked <= 3000
    assert 0.35 < got.recall < 0.7
    none = near_vectors.recall(rows.where("id >= 105"), spark.createDataFrame(
        [], "a long, b long, links long"), 0.98)
    assert none == (1.0, 0, 2895)


def test_vector_blocks(spark, monkeypatch):
    """Shards that are cut into blocks find the same links."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(8, 12))
    rows = [(i, [float(x) for x in centre[i % 8] + rng.normal(size=12) * 0.03], 1)
            for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = {r.vec_id: tuple(r) for r in near_vectors.linked(table).collect()}
    monkeypatch.setattr(near_vectors, "BLOCK", 60)
    monkeypatch.setattr(near_vectors, "SHARD", 50)
    cut = {r.vec_id: tuple(r) for r in near_vectors.linked(table).collect()}
    assert sum(whole[i][1] for i in whole) > 1000
    assert sum(cut[i] != whole[i] for i in whole) <= 0.05 * len(whole)


@pytest.mark.parametrize("top", [lm_scoring.TOP, 50])
def test_lm_scoring(spark, docs, monkeypatch, top):
    monkeypatch.setattr(lm_scoring, "TOP", top)
    rows = lm_scoring.op10_lm_scoring(spark, SF).collect()
    token = {r.doc_id: words(r.text, lower=True) + ["\n"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in token}
    seen = Counter(w for i, t in token.items() if not held[i] for w in t)
    total = sum(seen.values())
    for r in rows:
        base = sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (len(seen) + 1)))
                   for w in token[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(token[r.doc_id]), total)
        assert r.n_known == sum(w in seen for w in token[r.doc_id])
        assert abs(base - r.base_score) < 1e-6 * abs(base)
        assert r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_model_is_a_distribution(spark):
    """Predictions of the vocabulary and of the unknown type sum to at most one; spellings of one
    and two bytes sum to what the model leaves for them."""
    text = ["the cat sat on the mat", "the dog and the cat", "a cat a dog a mat"] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    model = lm_scoring.Model(docs)
    known = sum(10 ** r.score for r in model.scored_words().collect())
    assert 0.5 < known <= 1 - model.fresh() * lm_scoring.UNIFORM / (model.types + 1) + 1e-9
    one = np.arange(256, dtype=np.uint8)
    context = lm_scoring.Spelling(model.spelling.root, model.spelling.levels)
    p = 10 ** context.logp(one, np.arange(257))
    assert p.sum() < 1.001
    assert abs(model.spelling.root.sum() - 1) < 1e-9


def test_seating_is_consistent():
    rng = np.random.default_rng(0)
    restaurant = np.array([0, 0, 0, 1, 1, 2])
    seats = lm_scoring.Seating(restaurant, np.array([5, 1, 40, 2, 7, 1]), 0.5)
    parent = np.full(6, 0.2)
    for _ in range(50):
        seats.gibbs(parent, rng)
        assert np.bincount(seats.owner, weights=seats.size).tolist() == seats.c.tolist()
        assert (seats.size > 0).all() and (seats.t >= 1).all() and (seats.t <= seats.c).all()
    assert seats.t[1] == 1
    total = seats.predict(parent)[:3].sum() + seats.backoff()[0] * (1 - 3 * 0.2)
    assert np.isclose(total, 1)


def test_gibbs_finds_the_posterior():
    """Tables of a single cell against the exact distribution over seatings of its customers."""
    c, d, p = 4, 0.5, 0.3
    exact = defaultdict(float)

    def seat(sizes, weight):
        if sum(sizes) == c:
            exact[len(sizes)] += weight
            return
        for k, s in enumerate(sizes):
            seat(sizes[:k] + [s + 1] + sizes[k + 1:], weight * (s - d))
        seat(sizes + [1], weight * (lm_scoring.STRENGTH + d * len(sizes)) * p)

    seat([], 1.0)
    want = sum(t * w for t, w in exact.items()) / sum(exact.values())
    rng, seats, seen = np.random.default_rng(6), None, []
    seats = lm_scoring.Seating(np.arange(400), np.full(400, c), d)
    for sweep in range(60):
        seats.gibbs(np.full(400, p), rng)
        if sweep >= 20:
            seen.append(seats.t.mean())
    assert abs(np.mean(seen) - want) < 0.05


def _long_chain(c, d, p, others, sweeps, seed):
    """Table counts after each sweep in which every single customer is seated again once."""
    rnd, strength = random.Random(seed), lm_scoring.STRENGTH
    at, size, free, tables, out = [0] * c, [c], [], 1, []
    for _ in range(sweeps):
        for i in range(c):
            k = at[i]
            size[k] -= 1
            if not size[k]:
                free.append(k)
                tables -= 1
            new = (strength + d * (others + tables)) * p
            if rnd.random() * (new + c - 1 - d * tables) < new:
                k = free.pop() if free else len(size)
                if k == len(size):
                    size.append(0)
                tables += 1
            else:
                while True:  # a table in proportion to size - d, by the table of another customer
                    j = int(rnd.random() * c)
                    k = at[j]
                    if j != i and rnd.random() * size[k] < size[k] - d:
                        break
            size[k] += 1
            at[i] = k
        out.append(tables)
    return out


def test_large_cell_against_a_long_chain():
    """A cell of 100,000 customers: its table count settles where a chain over single customers does."""
    c, d, p, others = 100_000, 0.5, 0.3, 500
    want = np.mean(_long_chain(c, d, p, others, 40, 3)[20:])
    rng, seats = np.random.default_rng(6), lm_scoring.Seating(
        np.arange(100), np.full(100, c), d, others)
    seen = []
    for sweep in range(30):
        seats.gibbs(np.full(100, p), rng)
        if sweep >= 15:
            seen.append(seats.t.mean())
    assert abs(np.mean(seen) / want - 1) < 0.1, (np.mean(seen), want)


@pytest.mark.parametrize("d", [0.1, 0.5, 0.9])
@pytest.mark.parametrize("mean", [0.5, 20, 400])
def test_table_counts_of_large_cells(d, mean):
    """The asymptotic law at 512 customers against the exact one."""
    weight = lm_scoring._stirling(d, 512)[512, 1:] + np.arange(1, 513) * np.log(mean * d)
    weight = np.exp(weight - weight.max()) / np.exp(weight - weight.max()).sum()
    want = (weight * np.arange(1, 513)).sum()
    got = lm_scoring._draw_large(np.full(20_000, 512), np.full(20_000, np.log(mean)), d,
                                 np.random.default_rng(2))
    assert abs(got.mean() / want - 1) < 0.02


def test_lm_words_have_contexts(spark):
    """The order of words counts, and neither partitions nor batches do."""
    text = ["the cat sat on the mat", "the dog sat on the rug", "a cat ran on a rug"] * 4
    rows = [(i, t) for i, t in enumerate(text)] + [(100, "the cat sat on the mat"), (101, "mat the on sat cat the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def scores(parts):
        learned = docs.repartition(parts).where("doc_id < 100")
        out = lm_scoring.scored(docs.repartition(parts), lm_scoring.Model(learned), "doc_id").collect()
        return {r._row.doc_id: r.score for r in out}

    one = scores(1)
    assert one[100] > one[101] + 1 and one[100] == pytest.approx(one[0])
    assert scores(5) == pytest.approx(one, abs=1e-9)


def test_lm_own_documents_score_as_others_do(spark, docs, monkeypatch):
    """Documents held with the model and the same ones scored later; frequent words by several buckets."""
    monkeypatch.setattr(lm_scoring, "BUCKET_TOKENS", 2000)
    own = lm_scoring.Model(docs, lm_scoring.learnable(), "doc_id")
    first = {r._row.doc_id: r.score for r in own.scores().collect()}
    again = {r._row.doc_id: r.score for r in lm_scoring.scored(docs, own, "doc_id").collect()}
    assert len(first) > 100 and again == pytest.approx(first, abs=1e-6)


def test_lm_buckets_are_worked_on_by_ranges(docs, monkeypatch):
    """A row holds a range of a bucket's first words, no pair is in two rows, and no token is lost."""
    monkeypatch.setattr(lm_scoring, "RANGE_TOKENS", 5000, raising=False)
    monkeypatch.setattr(lm_scoring, "TOP", 500)
    model = lm_scoring.Model(docs)
    assert model.fixed.buckets == 1
    pieces = model._pieces(docs, F.lit(True)).where("bucket >= 0").toArrow().to_batches()
    rows = [lm_scoring._read(b, i) for b in lm_scoring._gathered(SimpleNamespace(value=model.fixed))(iter(pieces))
            for i in range(b.num_rows)]
    assert len(rows) >= model.total // 5000 > 5
    assert max(len(x["docs"]) for x in rows) < model.total / 3
    seen = Counter()
    for x in rows:
        h = np.concatenate([model.fixed.top, x["tail"].view(np.uint64)])
        seen.update(zip(h[x["u"]].tolist(), h[x["w"]].tolist()))
        assert (x["c"] == x["k"]).all() and x["k"].sum() == len(x["docs"])
    end, want = int(lm_scoring._END[0]), Counter()
    for r in docs.collect():
        data = [np.frombuffer(word.encode(), np.uint8) for word in words(r.text, lower=True)]
        line = [int(lm_scoring.hashes(d, np.zeros(1, np.int64), np.array([len(d)]))[0]) for d in data] + [end]
        want.update(zip([end, *line], line))
    assert max(seen.values()) == 1 and set(seen) == set(want)
    assert sum(int(x["k"].sum()) for x in rows) == sum(want.values()) == model.total


def test_spelling_contexts_are_whole_bytes():
    data = np.frombuffer(b"aXyzbXyz", np.uint8)
    context, byte, _ = lm_scoring.spelled(data, np.array([0, 4, 8]))
    last = context[(byte == ord("z"))]
    assert last.tolist() == [int.from_bytes(b"aXy", "big"), int.from_bytes(b"bXy", "big")]


def test_lm_odd(spark, odd, none):
    rows = lm_scoring.scored(odd, lm_scoring.Model(odd.where(lm_scoring.learnable())), "doc_id").collect()
    assert len(rows) == len(ODD) + 2 and all(math.isfinite(r.score) for r in rows)
    empty = lm_scoring.Model(none)
    assert lm_scoring.scored(none, empty, "doc_id").count() == 0
    assert all(math.isfinite(r.score) for r in lm_scoring.scored(odd, empty, "doc_id").collect())


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF)
    used = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(
        F.col("offset") + F.col("length")).alias("end")).collect()
    assert used and all(r.n == r.end <= 1024 for r in used)

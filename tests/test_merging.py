"""Merging: hand-worked tables, and properties that every merge must have."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vacantia.functions.similarity import MovingTitles, OrderedTitles
from vacantia.operators import dedup, replay, similar as similar_titles, upsert
from vacantia.operators.shuffle import last_before, salted_join, with_position
from vacantia.schema import POSTING


def similar(a, b):
    return SequenceMatcher(None, a, b).ratio() >= 0.88


def random_titles(rnd, n):
    words = ["devops", "engineer", "cloud", "senior", "sr", "s", "azure", "lead", "x", "engineers"]
    return ["".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


@pytest.mark.parametrize("head, block", [(3, 4), (2, 1000), (2048, 4096)])
def test_leaders(spark, head, block):
    """Settled by heads alone, or by heads and then rounds, compared whole or by letter pairs."""
    rnd = random.Random(head)
    keys = {(rnd.choice("aaab"), t) for t in random_titles(rnd, 160)}
    rows = [(c, t, i) for i, (c, t) in enumerate(sorted(keys, key=lambda _: rnd.random()))]
    leaders, want = {}, set()
    for company, title, _ in rows:
        mine = leaders.setdefault(company, [])
        hit = next((x for x in mine if similar(x, title)), None)
        if hit is None:
            mine.append(title)
        want.add((company, title, hit or title))
    df = spark.createDataFrame(rows, "company string, title string, ord long")
    got = {tuple(r) for r in similar_titles.assign_leaders(df, head, block).collect()}
    assert got == want


@pytest.mark.parametrize("block", [5, 4096])
def test_first_similar(spark, block):
    rnd = random.Random(block)
    held = [(rnd.choice("aab"), t, rnd.randint(0, 500), since, since + rnd.randint(1, 60))
            for t in random_titles(rnd, 160) for since in [rnd.randint(0, 90)]]
    probes = [(rnd.choice("aabc"), t, rnd.randint(0, 120)) for t in random_titles(rnd, 160)]
    want = set()
    for company, title, at in probes:
        hits = [i for c, t, i, since, until in held if c == company and since < at <= until and similar(t, title)]
        if hits:
            want.add((company, title, at, min(hits)))
    got = similar_titles.first_similar(
        spark.createDataFrame(probes, "company string, title string, at long"),
        spark.createDataFrame(held, "company string, title string, ord long, since long, until long"), block)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10


@settings(max_examples=400, deadline=None)
@given(st.text("abc1", min_size=1, max_size=24), st.lists(st.tuples(
    st.integers(0, 23), st.sampled_from(["out", "in", "swap"]), st.sampled_from("abc1x")), max_size=5))
def test_similar_titles_show_a_common_pair(title, edits):
    """Whatever order the pairs are in."""
    other = title
    for at, kind, letter in edits:
        at %= len(other) + 1
        other = other[:at] + (letter if kind != "out" else "") + other[at + (kind != "in"):]
    if title == other or not other or not similar(title, other):
        return
    for salt in range(5):
        def shown(t):
            ranked = sorted(similar_titles._pairs(t), key=lambda p: (hash((p, salt)), p))
            return set(ranked[:similar_titles.prefix(len(t))])

        assert shown(title) & shown(other)


def test_one_company_of_many_titles(spark):
    """8,000 titles of one company: a family around every one of 400 stems. The first 100 titles and
    their kin are settled at once, what is left by rounds and letter pairs."""
    rnd = random.Random(4)
    stems = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(400)]
    titles = list(dict.fromkeys(stems[i % 400] + f"{i // 400:02d}" for i in range(8_000)))
    df = spark.createDataFrame([("hot", t, i) for i, t in enumerate(titles)], "company string, title string, ord long")
    got = {r.title: r.leader for r in similar_titles.assign_leaders(df, head=100).collect()}
    assert got == {t: t[:24] + "00" for t in titles}


ROW = ("id long, company string, title string, location string, is_reposted int, status string, "
       "description string")

# id, company, title, location, is_reposted, status, description
CRAWLED = [
    (1, "Blue Fjord Ltd", "Tide Analyst", "Bergen, Norway", 0, "saved", "short"),
    (2, "BLUE FJORD", "tide analyst", "Tromso, Norway", None, "applied", "a longer text"),
    (3, "Blue Fjord", "Tide Analyst", "bergen", 1, "ignored", "same length"),
    (4, "", "Tide Analyst", "Oslo", 0, None, "no company, so never merged"),
    (5, "", "Tide Analyst", "Oslo", 0, None, "no company, so never merged"),
    (6, "Blue Fjord", "Tide Analysts", "Oslo", 0, "new", "almost the same title"),
    (7, "Red Delta", "Tide Analyst", None, 0, None, None),
    (8, "Red Delta", "Tide Analyst", "Lima", 0, "odd", ""),
]
MERGED_EXACT = {
    1: ("Bergen, Norway / Tromso", 1, "applied", "a longer text"),
    4: ("Oslo", 0, None, "no company, so never merged"),
    5: ("Oslo", 0, None, "no company, so never merged"),
    6: ("Oslo", 0, "new", "almost the same title"),
    7: ("Lima", 0, "new", ""),
}
MERGED_FUZZY = {**MERGED_EXACT, 1: ("Bergen, Norway / Tromso / Oslo", 1, "applied",
                                    "almost the same title")}
del MERGED_FUZZY[6]


@pytest.mark.parametrize("fuzzy, want", [(False, MERGED_EXACT), (True, MERGED_FUZZY)])
def test_dedup(spark, fuzzy, want):
    df = spark.createDataFrame(CRAWLED, ROW)
    clean = dedup.dedup_fuzzy(df) if fuzzy else dedup.dedup_exact(df)
    got = {r.id: (r.location, r.is_reposted, r.status, r.description) for r in clean.collect()}
    assert got == want


def test_dedup_properties(spark):
    """Merging again changes nothing; a merge keeps each key once, with its least id; every text
    that survives is the longest of its key."""
    rnd = random.Random(3)
    titles = random_titles(rnd, 15)
    rows = [(i, rnd.choice(["Cobalt", "Umber", ""]), rnd.choice(titles), rnd.choice(["Lima", "Oslo"]),
             0, "new", "d" * rnd.randint(0, 9)) for i in range(150)]
    df = spark.createDataFrame(rows, ROW)
    clean = dedup.dedup_exact(df).cache()
    again = dedup.dedup_exact(clean)
    assert sorted(again.collect()) == sorted(clean.collect())
    keyed = dedup.with_key(df).where("dedup_key <> ''").groupBy("dedup_key").agg(
        F.min("id").alias("id"), F.max(F.length("description")).alias("n"))
    got = clean.where("dedup_key <> ''").select("dedup_key", "id", F.length("description"))
    assert sorted(got.collect()) == sorted(keyed.select("dedup_key", "id", "n").collect())
    assert clean.where("dedup_key = ''").count() == sum(r[1] == "" for r in rows)


TEXTS = ("posting_id", "company", "title", "location", "url", "description")
BLANK = ("posted_at", "employment_type", "experience_level", "work_mode", "salary")


def crawl(spark, rows):
    """Batch rows (seq, *TEXTS)."""
    df = spark.createDataFrame(rows, "seq long, " + ", ".join(f"{f} string" for f in TEXTS))
    return df.withColumns({c: F.lit("") for c in BLANK})


def table(spark, rows):
    """Stored postings (id, *TEXTS, dedup_key)."""
    df = spark.createDataFrame(
        rows, "id long, " + ", ".join(f"{f} string" for f in TEXTS) + ", dedup_key string")
    return df.withColumns({c: F.lit("") for c in BLANK} | {
        "is_reposted": F.lit(0), "status": F.lit("new")})


def shown(df):
    return sorted(df.select("id", *TEXTS, "dedup_key").collect())


# Stored: one posting of each of two companies.
HELD = [(1, "p1", "Acme", "Aaaa", "Lima", "u1", "text one", "acme:aaaa"),
        (2, "p2", "Bolt", "Bbbb", "Oslo", "u2", "t", "bolt:bbbb")]


@pytest.mark.parametrize("rows, want", [
    # By id: the later link wins, an empty one does not; the longer text wins; a city is added.
    ([(0, "p1", "Acme", "Aaaa", "Pune, India", "v", "x"), (1, "p1", "Acme", "Aaaa", "lima", "", "")],
     [(1, "p1", "Acme", "Aaaa", "Lima / Pune", "v", "text one", "acme:aaaa"), HELD[1]]),
    # By key under another id; the posting keeps its own id.
    ([(0, "q9", "BOLT", "bbbb", "", "w", "a longer text")],
     [HELD[0], (2, "p2", "BOLT", "bbbb", "Oslo", "w", "a longer text", "bolt:bbbb")]),
    # New ones are numbered in order of the batch, rows of one key together.
    ([(5, "n5", "Cobo", "Cccc", "Rome", "c", "1"), (3, "n3", "Dodo", "Dddd", "", "d", "2"),
      (6, "n6", "Cobo", "Cccc", "Bonn", "e", "333")],
     [*HELD, (3, "n3", "Dodo", "Dddd", "", "d", "2", "dodo:dddd"),
      (4, "n5", "Cobo", "Cccc", "Rome / Bonn", "e", "333", "cobo:cccc")]),
    # A stored key moves; the next row finds the posting under its new key.
    ([(0, "p1", "Acme", "Zzzz", "", "", ""), (1, "n1", "Acme", "Zzzz", "", "z", "")],
     [(1, "p1", "Acme", "Zzzz", "Lima", "z", "text one", "acme:zzzz"), HELD[1]]),
    # A stored key moves away; what has the old key is a new posting.
    ([(0, "p1", "Acme", "Zzzz", "", "", ""), (1, "n1", "Acme", "Aaaa", "", "y", "")],
     [(1, "p1", "Acme", "Zzzz", "Lima", "u1", "text one", "acme:zzzz"), HELD[1],
      (3, "n1", "Acme", "Aaaa", "", "y", "", "acme:aaaa")]),
    # Before the move the old key still finds it; it moves on to a company that is stored, too.
    ([(0, "n0", "Acme", "Aaaa", "", "k", ""), (1, "p1", "Bolt", "Bbbb", "", "", ""),
      (2, "n2", "Bolt", "Bbbb", "", "m", ""), (3, "p2", "Bolt", "Eeee", "", "", ""),
      (4, "n4", "Bolt", "Eeee", "", "o", "")],
     [(1, "p1", "Bolt", "Bbbb", "Lima", "m", "text one", "bolt:bbbb"),
      (2, "p2", "Bolt", "Eeee", "Oslo", "o", "t", "bolt:eeee")]),
    # A posting that the batch itself starts moves.
    ([(0, "n0", "Cobo", "Cccc", "", "a", ""), (1, "n0", "Cobo", "Ffff", "", "b", ""),
      (2, "n2", "Cobo", "Cccc", "", "c", ""), (3, "n3", "Cobo", "Ffff", "", "d", "")],
     [*HELD, (3, "n0", "Cobo", "Ffff", "", "d", "", "cobo:ffff"),
      (4, "n2", "Cobo", "Cccc", "", "c", "", "cobo:cccc")]),
])
def test_upsert(spark, rows, want):
    stored = table(spark, HELD)
    got = upsert.upsert(crawl(spark, rows), stored, fuzzy=False)
    assert shown(got) == sorted(want)


def one_by_one(stored, rows, fuzzy):
    """Rows (seq, posting_id, key) against stored (id, posting_id, key): the owner of each row, a
    stored id or the seq of the row that starts the posting."""
    postings = [[("stored", i), p, k] for i, p, k in sorted(stored)]
    out = {}
    for seq, name, key in sorted(rows):
        company = key.split(":")[0]
        found = next((x for x in postings if x[1] == name), None)
        if found is None and key:
            found = next((x for x in postings if x[2] == key), None) or (next((
                x for x in postings if fuzzy and x[2].split(":")[0] == company and similar(
                    x[2].split(":")[1], key.split(":")[1])), None))
        if found is None:
            found = [("new", seq), name, key]
            postings.append(found)
        elif key:
            found[2] = key
        out[seq] = found[0]
    return out


def resolved(spark, stored, rows, fuzzy):
    """The same from `resolve`, for keys of normalised company and title."""
    held = spark.createDataFrame([(i, p, *(k.split(":") if k else ("", "")), k) for i, p, k in stored],
                                 "id long, posting_id string, company string, title string, dedup_key string")
    batch = spark.createDataFrame([(s, p, *(k.split(":") if k else ("", "x"))) for s, p, k in rows],
                                  "seq long, posting_id string, company string, title string").withColumns(
        {c: F.lit("") for c in ("posted_at", "description", "location")})
    got = upsert.resolve(batch, held, fuzzy).collect()
    start = {r.new_group: r.seq for r in got if r.is_new}
    assert len(got) == len(rows)
    return {r.seq: ("new", start[r.new_group]) if r.target_id is None else ("stored", r.target_id) for r in got}


FAMILY = ["devopsengineer", "devopsengineers", "srdevopsengineer", "srdevopsengineers", "devopsengineerx",
          "xdevopsengineersx", "cloudlead", "cloudleads", "scloudleads", "azure"]


@pytest.mark.parametrize("seed, fuzzy, small", [(1, True, 20_000), (2, False, 20_000), (3, True, 0), (5, False, 0)])
def test_resolve_goes_row_by_row(spark, monkeypatch, seed, fuzzy, small):
    """Random batches full of moves, similar titles, keyless rows and repeated ids; in tasks, or by
    guesses as for large companies."""
    monkeypatch.setattr(replay.resolved, "__defaults__", (small,))
    rnd, size = random.Random(seed), 70 if small else 30

    def key():
        return f"{rnd.choice(['acme', 'bolt', 'bolt', 'cobo'])}:{rnd.choice(FAMILY)}" if rnd.random() < 0.93 else ""

    stored = [(i, f"p{i}", key()) for i in range(1, 9)]
    rows = [(s, f"p{rnd.randint(1, size // 2)}", key()) for s in range(size)]
    assert resolved(spark, stored, rows, fuzzy) == one_by_one(stored, rows, fuzzy)


def test_similar_titles_follow_the_key_of_the_batch(spark):
    """The case of one batch against two: a new posting is found under its key, not made twice."""
    stored, rows = [(1, "p1", "acme:aaaaaaaa")], [(0, "p1", "acme:zzzzzzzz"), (1, "p2", "acme:zzzzzzzz")]
    assert resolved(spark, stored, rows, True) == {0: ("stored", 1), 1: ("stored", 1)}
    drift = [(k, f"n{k}", f"acme:{t}") for k, t in enumerate(
        ["devopsengineer", "devopsengineers", "sdevopsengineers", "sdevopsengineersx", "devopsengineer"])]
    assert resolved(spark, stored, drift, True) == one_by_one(stored, drift, True)


def test_titles_of_any_length_are_found():
    """Letters are counted in bytes until a title is too long for them."""
    index, held = OrderedTitles(5), ["engineer", "engineers", "a" * 300 + "b", "abc" * 90, "a" * 256]
    for title in held:
        index.add(title)
        for probe in ("engineer", "a" * 300, "abc" * 88, "a" * 400, "x", "a" * 255):
            first = next((i for i, t in enumerate(index.titles) if similar(t, probe)), -1)
            assert index.first_like(probe) == first


def test_moving_titles():
    """Holders come, move and go in any order; runs fill up, are parted and fall empty."""
    for seed in range(60):
        rnd, held = random.Random(seed), {}
        index = MovingTitles()
        index._size = rnd.choice([2, 3, 8, 2048])
        for title, probe in zip(random_titles(rnd, 150), random_titles(rnd, 150)):
            owner = rnd.choice([None, rnd.randint(0, 40), rnd.randint(0, 40)])
            for left in [t for t, o in held.items() if o == owner and t != title]:
                index.hold(left, None)
                del held[left]
            index.hold(title, owner)
            held[title] = owner
            want = min((o for t, o in held.items() if o is not None and similar(t, probe)), default=None)
            assert index.lowest(probe) == want


def test_a_similar_title_is_found_before_all_titles_are_compared(monkeypatch):
    """60,000 titles are held; what is asked for is similar to one of the first thousand, whoever moves."""
    rnd, compared, count = random.Random(5), [], OrderedTitles._shared
    monkeypatch.setattr(OrderedTitles, "_shared", lambda self, probe: compared.append(len(self.titles)) or count(self, probe))
    titles = list(dict.fromkeys("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(60_000)))
    index = MovingTitles()
    for owner, title in enumerate(titles):
        index.hold(title, owner)
    for owner in range(0, 1000, 10):
        assert index.lowest(titles[owner] + "s") == owner
        index.hold(titles[owner], None)
        index.hold(titles[owner] + "s", owner)
    assert sum(compared) <= 100 * 2 * 2048


def test_a_chain_of_moves_by_similar_titles_takes_no_rounds(spark, monkeypatch):
    """Every row moves the posting to its own title, so no row is settled before the one ahead of it."""
    monkeypatch.setattr(replay, "settled", lambda *_: pytest.fail("guessed"))
    n, titles = 21_000, ["devopsengineer", "devopsengineers"]
    stored = spark.createDataFrame([(1, "p1", "acme", titles[0], "acme:" + titles[0])],
                                   "id long, posting_id string, company string, title string, dedup_key string")
    batch = spark.range(n).selectExpr(
        "id AS seq", "concat('n', id) AS posting_id", "'acme' AS company",
        f"if(id % 2 = 0, '{titles[1]}', '{titles[0]}') AS title", "'' AS posted_at", "'' AS description", "'' AS location")
    got = upsert.resolve(batch, stored).groupBy("target_id").count().collect()
    assert [(r.target_id, r["count"]) for r in got] == [(1, n)]


@pytest.mark.parametrize("fuzzy", [False, True])
def test_keys_are_made_once(spark, fuzzy):
    """Stored postings without a key, as scored ones are, and batch rows: each is read once to be resolved, and a
    batch row once more for the result."""
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(rows, count):
        def read(company):
            count.add(1)
            return company

        return rows.withColumn("company", F.udf(read)("company"))

    stored = table(spark, [(i, f"p{i}", "Acme", f"Engineer {i}", "", "", "", "") for i in range(1, 21)]).drop("dedup_key")
    batch = crawl(spark, [(s, f"p{s % 30}", "Acme", f"Engineers {s % 7}", "", "", "") for s in range(40)])
    got = upsert.resolve(counted(batch, seen[1]), counted(stored, seen[0]), fuzzy)
    assert [count.value for count in seen] == [20, 40]
    assert got.count() == 40


def test_many_small_companies_and_a_large_one(spark, monkeypatch):
    """Small ones in tasks, the large one by guesses, in one batch."""
    monkeypatch.setattr(replay.resolved, "__defaults__", (12,))
    rnd = random.Random(3)
    rows = [(s, f"{c}p{rnd.randint(1, 9)}", f"{c}:{rnd.choice(FAMILY)}") for s, c in enumerate(
        rnd.choice(["hot", "hot", "a", "b", "c", "d"]) for _ in range(44))]
    stored = [(i, f"{c}p{i}", f"{c}:{rnd.choice(FAMILY)}") for i, c in enumerate(["hot", "a", "b", "c"], 1)]
    assert resolved(spark, stored, rows, True) == one_by_one(stored, rows, True)


@pytest.mark.parametrize("fuzzy", [False, True])
def test_one_hot_key(spark, fuzzy):
    """200,000 rows of one key that postings move from and to, and stored postings that share it."""
    n = 200_000
    stored = spark.range(1, 2001).selectExpr(
        "id", "concat('p', id) AS posting_id", "'acme' AS company", "'devopsengineer' AS title",
        "'acme:devopsengineer' AS dedup_key")
    batch = spark.range(n).selectExpr(
        "id AS seq", "CASE WHEN id % 50000 = 7 THEN concat('p', id DIV 50000 + 1) ELSE concat('n', id) END AS posting_id",
        "'acme' AS company", "CASE WHEN id % 50000 = 7 THEN 'azurelead' ELSE 'devopsengineer' END AS title",
        "'' AS posted_at", "'' AS description", "'' AS location")
    got = upsert.resolve(batch, stored, fuzzy).groupBy("target_id").count().collect()
    # Postings 1 to 4 leave one after the other; the lowest that stays takes the rows.
    want = {1: 8, 2: 50_000, 3: 50_000, 4: 50_000, 5: n - 150_008}
    assert {r.target_id: r["count"] for r in got} == want


@pytest.mark.parametrize("width", [4, 1 << 16])
def test_last_before(spark, width):
    rnd = random.Random(width)
    rows = [(rnd.choice("aab"), i, rnd.choice([None, f"v{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o long, v string")
    got = {r.o: r.seen for r in last_before(df, "k", "o", "v", "seen", width).collect()}
    for k, o, _ in rows:
        earlier = [v for k2, o2, v in rows if k2 == k and o2 < o and v is not None]
        assert got[o] == (earlier[-1] if earlier else None)


@pytest.mark.parametrize("fuzzy", [False, True])
def test_upsert_does_not_depend_on_batches(spark, fuzzy):
    rnd = random.Random(8)
    titles = ["Aaaa", "Bbbb", "Cccc", "Dddd"] + ["Devops Engineer", "Devops Engineers", "Sr Devops Engineer"] * fuzzy
    rows = [(i, f"p{rnd.randint(1, 14)}", rnd.choice(["Acme", "Bolt"]), rnd.choice(titles),
             rnd.choice(["", "Rome", "Bonn"]), f"v{i}", "e" * rnd.randint(0, 12)) for i in range(32)]
    whole = shown(upsert.upsert(crawl(spark, rows), table(spark, HELD), fuzzy))
    stored = table(spark, HELD)
    for start, stop in ((0, 13), (13, 32)):
        part = upsert.upsert(crawl(spark, rows[start:stop]), stored, fuzzy)
        stored = table(spark, [tuple(r) for r in shown(part)])
    assert shown(stored) == whole


@pytest.mark.parametrize("how", ["left", "left_semi"])
def test_salted_lookups_do_not_pass_through_the_driver(spark, tmp_path, how):
    """Few bytes on disk, sixteen times as many rows in the join."""
    spark.range(5000).selectExpr("concat('k', id DIV 2) AS k").distinct().write.parquet(f"{tmp_path}/lookup")
    lookup = spark.read.parquet(f"{tmp_path}/lookup").withColumn("found", F.lit(True))
    got = salted_join(spark.range(6000).selectExpr("id", "concat('k', id) AS k"), lookup, "k", "id", how)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == (6000 if how == "left" else 2500)


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = with_position(df, [F.desc("v")]).collect()
    assert all(r.position == 1000 - r.v for r in rows)


def test_score_columns_last_given_wins(spark):
    assert {f.name for f in POSTING.fields} >= {"ats_score", "matched_skills"}
    stored = spark.createDataFrame([(1, "p1", "t", "c", "", "u", "", 0, "new", "c:t", 5.0, ["A"])],
                                   "id long, posting_id string, title string, company string, "
                                   "location string, url string, description string, is_reposted int,"
                                   " status string, dedup_key string, ats_score double, "
                                   "matched_skills array<string>")
    batch = spark.createDataFrame(
        [(0, "p1", "t", "c", "", 7.0, ["B"]), (1, "p1", "t", "c", "", None, ["C"])],
        "seq long, posting_id string, title string, company string, location string, "
        "ats_score double, matched_skills array<string>")
    batch = batch.withColumns({c: F.lit(None).cast("string") for c in ("description", "url", "posted_at")})
    r = upsert.apply_updates(stored, upsert.updates(upsert.resolve(batch, stored))).first()
    assert (r.ats_score, r.matched_skills, r.url) == (7.0, ["C"], "u")

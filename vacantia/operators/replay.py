"""Rows of a batch, one after the other, as joins: which posting each row belongs to when every row
may move a posting to another key and so change what later rows find.

A row belongs to the posting of its id; else to the one that holds its key at its time, the lowest if
several do; else, with `fuzzy`, to the lowest whose key at its time is of the same company and has a
similar title; else it starts a posting. A row that is not there by its key moves its posting to the
key it brings.

Companies do not meet but in posting ids, so those with at most SMALL rows are gone through row by row,
many of them in one task. Larger ones are settled as a whole: who belongs where is guessed, the keys
that postings hold from when to when follow from the guess, and looking every row up in them gives the
next guess, until nothing changes. What a row finds depends on earlier rows only, so the end result is
the same; and since a guess is wrong only behind a wrong one, it takes as many rounds as the longest
chain of wrong ones. No row meets all rows of its key: keys are looked up as of a time, in blocks of
time.

Owners are numbers: the id of a stored posting, or NEW + seq for the posting that row seq starts, so
the lowest owner is the one that came first.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.similarity import MovingTitles
from ..session import cut_lineage
from .shuffle import last_before
from .similar import ALWAYS, first_similar

NEW = 1 << 62
NOBODY = -1 << 62  # stands for no stored posting, so that ids are never read by way of floats
BEFORE = -1  # the time from which stored postings hold their keys; batches start at 0


# Rows and stored postings of a company that one task goes through. They stream by in order, and the state
# is a few hundred bytes for each posting, so time sets the bound, not memory.
SMALL = 2_000_000


def resolved(rows: DataFrame, owners: DataFrame, fuzzy: bool, small: int = SMALL) -> DataFrame:
    """rows (seq, posting_id, dedup_key, fixed: the stored posting of that id or null) and the stored
    postings (id, dedup_key) that they can meet -> (seq, owner)."""
    def company(c):
        return X.key_company(F.col(c))

    # Where an id occurs: its rows, and the stored posting it names. Companies that share one, and rows
    # without a key, go with the least company of the id or, if there are several, all together.
    held = owners.select(F.col("id").alias("fixed"), F.col("dedup_key").alias("_held"))
    named = rows.join(held, "fixed", "left")
    met = F.array_compact(F.array(F.when(F.col("dedup_key") != "", company("dedup_key")),
                                  F.when(F.col("_held") != "", company("_held"))))
    ids = named.groupBy("posting_id").agg(F.min(F.array_min(met)).alias("_low"), F.max(F.array_max(met)).alias("_high"))
    linked = ids.where("_low <> _high").select("posting_id")
    together = named.join(linked, "posting_id", "left_semi").select(F.explode(met).alias("company")).distinct().withColumn(
        "_linked", F.lit("*"))
    placed = rows.join(ids.select("posting_id", "_low"), "posting_id", "left").withColumn(
        "company", F.when(F.col("dedup_key") != "", company("dedup_key")).otherwise(F.coalesce("_low", F.lit("*"))))
    of_id = rows.where("fixed IS NOT NULL").join(ids, "posting_id").groupBy(F.col("fixed").alias("id")).agg(
        F.min("_low").alias("_low"))
    kept = owners.join(of_id, "id", "left").withColumn("company", F.when(
        F.col("dedup_key") != "", company("dedup_key")).otherwise(F.coalesce("_low", F.lit("*"))))
    placed, kept = (df.join(together, "company", "left").withColumn("part", F.coalesce("_linked", "company"))
                    .drop("_linked", "company", "_low") for df in (placed, kept))
    placed, kept = cut_lineage(placed), cut_lineage(kept)
    sizes = placed.select("part").unionByName(kept.select("part")).groupBy("part").count()
    large = cut_lineage(sizes.where(F.col("count") > small).select("part"))
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = placed.select("part", "seq", "posting_id", "dedup_key", F.coalesce("fixed", F.lit(NOBODY)).alias(
        "fixed")).unionByName(kept.select(
        "part", F.lit(BEFORE).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("posting_id"), "dedup_key",
        F.col("id").alias("fixed")))
    if large.isEmpty():
        out = line
    else:
        out = line.join(large, "part", "left_anti")
    done = (out.repartition(tasks, "part").sortWithinPartitions("part", "seq", "fixed")
            .mapInPandas(_row_by_row(fuzzy), "seq long, owner long"))
    if large.isEmpty():
        return done
    many = settled(placed.join(large, "part", "left_semi").drop("part"),
                   kept.join(large, "part", "left_semi").drop("part"), fuzzy)
    return done.unionByName(many)


def _row_by_row(fuzzy: bool):
    """Rows of one part after the other, its stored postings first (before all rows, seq BEFORE)."""
    def go(frames):
        part, state = None, None
        for frame in frames:
            out = []
            for name, seq, posting_id, key, own in zip(frame["part"], frame["seq"].tolist(), frame["posting_id"],
                                                       frame["dedup_key"], frame["fixed"].tolist()):
                if name != part:
                    part, state = name, _State(fuzzy)
                if seq == BEFORE:
                    state.move(own, key)
                else:
                    out.append((seq, state.row(seq, posting_id, key, None if own == NOBODY else own)))
            yield pd.DataFrame(out, columns=["seq", "owner"]).astype("int64")

    return go


class _State:
    """Keys that postings hold, and which postings hold a key or a title of a company."""

    def __init__(self, fuzzy: bool):
        self.fuzzy = fuzzy
        self.key_of: dict[int, str] = {}
        self.holders: dict[str, list[int]] = {}  # heaps; who has left is dropped when it comes up
        self.started: dict[str, int] = {}
        self.titles: dict[str, MovingTitles] = {}

    def move(self, owner: int, key: str) -> None:
        left = self.key_of.get(owner)
        if not key or left == key:
            return
        self.key_of[owner] = key
        heapq.heappush(self.holders.setdefault(key, []), owner)
        if self.fuzzy:
            for each in (left, key) if left else (key,):
                company, _, title = each.partition(":")
                if company not in self.titles:
                    self.titles[company] = MovingTitles()
                self.titles[company].hold(title, self.holder(each))

    def holder(self, key: str) -> int | None:
        heap = self.holders.get(key, [])
        while heap and self.key_of[heap[0]] != key:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def row(self, seq: int, posting_id: str, key: str, fixed: int | None) -> int:
        owner = fixed if fixed is not None else self.started.get(posting_id)
        if owner is None and key:
            owner = self.holder(key)
            if owner is None and self.fuzzy:
                company, _, title = key.partition(":")
                if company in self.titles:
                    owner = self.titles[company].lowest(title)
        if owner is None:
            owner = self.started[posting_id] = NEW + seq
        self.move(owner, key)
        return owner


def settled(rows: DataFrame, owners: DataFrame, fuzzy: bool, block: int | None = None) -> DataFrame:
    """As `resolved`, by guesses."""
    guess = cut_lineage(_first_guess(rows, owners))
    while True:
        guess = cut_lineage(_next_guess(guess, owners, fuzzy, block))
        if guess.where("changed").isEmpty():
            return guess.select("seq", "owner")


def _first_guess(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """By id, else by key as held before the batch, else with the first row of the key."""
    held = owners.where("dedup_key <> ''").groupBy("dedup_key").agg(F.min("id").alias("_held"))
    first = rows.where("fixed IS NULL AND dedup_key <> ''").groupBy("dedup_key").agg(
        F.min("seq").alias("_first"))
    known = first.join(held, "dedup_key", "left")
    start = F.coalesce("_first", "seq")
    return rows.join(known, "dedup_key", "left").select(
        "seq", "posting_id", "dedup_key", "fixed",
        F.coalesce("fixed", "_held", NEW + start).alias("owner"),
        F.when(F.col("fixed").isNotNull(), "id").when(F.col("_held").isNull() & (start == F.col("seq")), "start")
        .otherwise("key").alias("how"))


def moves(guess: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, seq, dedup_key, before): each time a posting takes another key, and the key it held
    until then (null for one that starts). Stored postings that move are listed with their first key."""
    brought = guess.where("dedup_key <> '' AND how <> 'key'").select("owner", "seq", "dedup_key")
    moving = brought.where(F.col("owner") < NEW).select(F.col("owner").alias("id")).distinct()
    held = owners.join(moving, "id", "left_semi").select(
        F.col("id").alias("owner"), F.lit(BEFORE).cast("bigint").alias("seq"), "dedup_key")
    seen = last_before(brought.unionByName(held), "owner", "seq", "dedup_key", "before")
    return cut_lineage(seen.where("(before IS NULL AND dedup_key <> '') OR before <> dedup_key"))


def _steps(moved: DataFrame, still: DataFrame) -> DataFrame:
    """(dedup_key, seq, low): the lowest posting that holds a key from a time on, or null. `still` is
    the lowest posting of each key that never moves."""
    enters = moved.select("dedup_key", "seq", "owner", F.lit(1).alias("sign"))
    leaves = moved.where("before <> ''").select(F.col("before").alias("dedup_key"), "seq", "owner",
                                                F.lit(-1).alias("sign"))
    events = enters.unionByName(leaves)
    keys = events.select("dedup_key").distinct()
    alone = still.join(keys, "dedup_key", "left_anti").select(
        "dedup_key", F.lit(BEFORE - 1).cast("bigint").alias("seq"), F.col("owner").alias("low"))
    there = still.join(keys, "dedup_key", "left_semi").select(
        "dedup_key", F.lit(BEFORE - 1).cast("bigint").alias("seq"), "owner", F.lit(1).alias("sign"))
    line = events.unionByName(there).repartition("dedup_key").sortWithinPartitions(
        "dedup_key", "seq", "owner")
    return alone.unionByName(line.mapInPandas(_lowest, "dedup_key string, seq long, low long"))


def _lowest(frames):
    """Sweeps the moves of one key after the other; the state is the postings that hold the key."""
    key, heap, active, low = None, [], set(), None
    for frame in frames:
        out = []
        for name, seq, owner, sign in frame[["dedup_key", "seq", "owner", "sign"]].itertuples(index=False):
            if name != key:
                key, heap, active, low = name, [], set(), None
            if sign > 0:
                active.add(owner)
                heapq.heappush(heap, owner)
            else:
                active.discard(owner)
            while heap and heap[0] not in active:
                heapq.heappop(heap)
            now = heap[0] if heap else None
            if now != low:
                low = now
                out.append((name, seq, low))
        keys, times, lows = zip(*out) if out else ((), (), ())
        yield pd.DataFrame({"dedup_key": pd.Series(keys, dtype="object"), "seq": pd.Series(times, dtype="int64"),
                            "low": pd.array(lows, dtype="Int64")})  # never by way of floats


def _followed(guess: DataFrame) -> DataFrame:
    """A posting that turns out not to be started belongs to where its row belongs now."""
    jump = guess.where("how <> 'start'").select((NEW + F.col("seq")).alias("owner"), F.col("owner").alias("_to"))
    return guess.join(jump, "owner", "left").withColumn("owner", F.coalesce("_to", "owner")).drop("_to")


def _next_guess(guess: DataFrame, owners: DataFrame, fuzzy: bool, block: int | None) -> DataFrame:
    moved = moves(_followed(guess), owners)
    still = owners.where("dedup_key <> ''").join(
        moved.select(F.col("owner").alias("id")).distinct(), "id", "left_anti").groupBy("dedup_key").agg(
        F.min("id").alias("owner"))
    starts = guess.where("how = 'start' AND posting_id IS NOT NULL").groupBy("posting_id").agg(
        F.min("seq").alias("_start"))
    by_id = F.when(F.col("_start") < F.col("seq"), NEW + F.col("_start"))
    rows = guess.select("seq", "posting_id", "dedup_key", "fixed", F.col("owner").alias("was"),
                        F.col("how").alias("was_how")).join(starts, "posting_id", "left").withColumn(
        "_id", F.coalesce("fixed", by_id)).drop("_start")
    # As of a row's time: what happened at earlier rows. Steps of a row's own time come after it.
    steps = _steps(moved, still).select(
        "dedup_key", (2 * F.col("seq") + 1).alias("_at"), F.struct("low").alias("_step"))
    asks = rows.where("_id IS NULL AND dedup_key <> ''")
    line = asks.select("dedup_key", (2 * F.col("seq")).alias("_at"), "seq").unionByName(
        steps, allowMissingColumns=True)
    found = last_before(line, "dedup_key", "_at", "_step", "_found").where(
        "seq IS NOT NULL").select("seq", F.col("_found.low").alias("_key"))
    rows = rows.join(found, "seq", "left")
    if fuzzy:
        rows = cut_lineage(rows)
        rows = rows.join(_by_title(rows, moved, still, block), ["dedup_key", "seq"], "left")
    else:
        rows = rows.withColumn("_title", F.lit(None).cast("bigint"))
    owner = F.coalesce("_id", "_key", "_title", NEW + F.col("seq"))
    how = (F.when(F.col("_id").isNotNull(), "id").when(F.col("_key").isNotNull(), "key")
           .when(F.col("_title").isNotNull(), "title").otherwise("start"))
    return rows.select("seq", "posting_id", "dedup_key", "fixed", owner.alias("owner"), how.alias("how"),
                       ((owner != F.col("was")) | (how != F.col("was_how"))).alias("changed"))


def _by_title(rows: DataFrame, moved: DataFrame, still: DataFrame, block: int | None) -> DataFrame:
    """(dedup_key, seq, _title) of rows that neither id nor key has found a posting for."""
    asked = rows.where("_id IS NULL AND _key IS NULL AND dedup_key <> ''").select(
        X.key_company(F.col("dedup_key")).alias("company"), X.key_title(F.col("dedup_key")).alias("title"),
        F.col("seq").alias("at"))
    after = F.lead("seq", 1, ALWAYS).over(Window.partitionBy("owner").orderBy("seq"))
    spans = moved.withColumn("until", after).where("dedup_key <> ''").select(
        "dedup_key", "owner", F.col("seq").alias("since"), "until").unionByName(still.select(
            "dedup_key", "owner", F.lit(BEFORE - 1).cast("bigint").alias("since"),
            F.lit(ALWAYS).alias("until")))
    held = spans.select(X.key_company(F.col("dedup_key")).alias("company"),
                        X.key_title(F.col("dedup_key")).alias("title"), F.col("owner").alias("ord"),
                        "since", "until")
    more = {} if block is None else {"block": block}
    return first_similar(asked, held, **more).select(
        F.concat_ws(":", "company", "title").alias("dedup_key"), F.col("at").alias("seq"),
        F.col("ord").alias("_title"))

"""Similar titles within a company: an exact join over rare letter pairs.

Two titles are similar if their ratio of matching letters is at least TITLE_SIMILARITY = r. Matching
letters stand in both in one order, so with M of them, M >= r/2 * (la + lb), the longer way round is
la - M letters taken out and lb - M put in. Of the la - 1 adjacent pairs of the first title at most two
go with each letter out and one with each letter in, so at least 3 M - la - lb - 1 pairs stand in
both. With the pairs of every title in one order, the rarest first, two similar titles therefore share
a pair among their first `prefix` ones: titles meet only there, a dozen rows a title.

Companies with few titles on either side are compared whole, many of them in one task; larger ones
meet by pair, and a pair that many titles share is cut into a grid of bounded cells. A task returns at
most one row per probe, never the pairs it has compared.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.similarity import OrderedTitles
from ..session import cut_lineage
from ..vocab import TITLE_SIMILARITY
from .shuffle import in_cells

BLOCK = 4096          # titles of a cell, on either side
TASKS = 4             # batches of cells for each shuffle partition; a batch is in memory at once
PAIRS_KNOWN = 1 << 14  # most letter pairs whose frequency is kept; others count as the rarest
HEAD = 2048           # titles of a company that one task compares in sequence

ALWAYS = (1 << 63) - 1  # end of a span that is still open


def prefix(n: int) -> int:
    """How many of its rarest pairs a title of n letters must show: its n - 1 pairs less those that a
    similar title is sure to share, and one. The shortest similar title is the least sure."""
    other = np.ceil(TITLE_SIMILARITY / (2 - TITLE_SIMILARITY) * n - 1e-9)
    shared = int(np.ceil((1.5 * TITLE_SIMILARITY - 1) * (n + other) - 1 - 1e-9))
    return max(0, n - max(1, shared))


def _pairs(title: str) -> list[str]:
    return [title[i:i + 2] for i in range(len(title) - 1)]


def _frequencies(titles: DataFrame) -> dict[str, int]:
    def count(frames):
        for frame in frames:
            found = pd.Series([p for t in frame["title"] for p in _pairs(t)], dtype="object")
            counts = found.value_counts()
            yield pd.DataFrame({"pair": counts.index.astype(str), "n": counts.to_numpy(np.int64)})

    rows = (titles.mapInPandas(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "pair").limit(PAIRS_KNOWN).collect())
    return {r["pair"]: r["n"] for r in rows}


def _shown(rows: DataFrame, known) -> DataFrame:
    """One row for each pair that a title shows, and one for the whole title."""
    def show(frames):
        for frame in frames:
            titles = frame["title"].tolist()
            frequency, shown = known.value, {}
            for title in set(titles):
                ranked = sorted(_pairs(title), key=lambda p: (frequency.get(p, 0), p))
                shown[title] = ["=" + title, *dict.fromkeys(ranked[:prefix(len(title))])]
            of = [shown[t] for t in titles]
            out = frame.loc[frame.index.repeat([len(x) for x in of])].copy()
            out["pair"] = [p for x in of for p in x]
            yield out

    return rows.mapInPandas(show, f"{rows._jdf.schema().toDDL()}, pair string")


def first_similar(probes: DataFrame, held: DataFrame, block: int = BLOCK) -> DataFrame:
    """Probes (company, title, at) against held titles (company, title, ord, since, until): for each
    probe that has one, the least `ord` of a similar title of its company that is held at its time
    (since < at <= until), as (company, title, at, ord)."""
    probes = probes.where("title <> ''").select("company", "title", "at").distinct()
    # Named anew, so that both sides may come from one table.
    names = ["company", "title", "ord", "since", "until"]
    held = held.where("title <> ''").select(*[F.col(c).alias(c) for c in names]).join(
        probes.select("company").distinct(), "company", "left_semi").select(*names)
    large = probes.groupBy("company").count().unionByName(held.groupBy("company").count()).where(
        F.col("count") > block).select("company").distinct()
    spark = probes.sparkSession
    sides = [[probes, held]]
    if not large.isEmpty():
        large = cut_lineage(large)
        sides = [[df.join(large, "company", "left_anti") for df in (probes, held)]]
        many = [df.join(large, "company", "left_semi") for df in (probes, held)]
        known = spark.sparkContext.broadcast(_frequencies(many[0].select("title").union(many[1].select("title"))))
        shown = [cut_lineage(_shown(df, known)) for df in many]
        sides.append([df.withColumn("_cell", F.xxhash64("_cell")).drop("pair") for df in in_cells(
            *shown, ["company", "pair"], "title", "title", block)])
    sides[0] = [df.withColumn("_cell", F.xxhash64("company")) for df in sides[0]]
    left, right = (reduce(DataFrame.unionByName, side) for side in zip(*sides))
    tasks = TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucket(df):
        return df.withColumn("_task", F.pmod("_cell", F.lit(tasks)))

    hits = (bucket(left).groupBy("_task").cogroup(bucket(right).groupBy("_task"))
            .applyInPandas(_least, "company string, title string, at long, ord long"))
    return hits.groupBy("company", "title", "at").agg(F.min("ord").alias("ord"))


def _least(probes: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Cells do not mix: titles are compared inside a cell and company."""
    out = []
    by = ["_cell", "company"]
    cells = dict(tuple(held.sort_values("ord").groupby(by, sort=False)))
    for key, asked in probes.groupby(by, sort=False):
        mine = cells.get(key)
        if mine is None:
            continue
        index = OrderedTitles(len(mine))
        for title in mine["title"]:
            index.add(title)
        order, since, until = (mine[c].to_numpy(np.int64) for c in ("ord", "since", "until"))
        for company, title, at in asked[["company", "title", "at"]].itertuples(index=False):
            hit = index.first_like(title, (since < at) & (at <= until))
            if hit >= 0:
                out.append((company, title, at, order[hit]))
    return pd.DataFrame(out, columns=["company", "title", "at", "ord"])


# Leaders ------------------------------------------------------------------------------------------


def assign_leaders(keys: DataFrame, head: int = HEAD, block: int = BLOCK) -> DataFrame:
    """(company, title, ord) -> (company, title, leader): each title, in `ord` order, joins the
    first leader of its company it is similar to, or becomes a leader.

    The first `head` open titles of every company are settled in one small task per company and take
    what is similar to their leaders; that goes on while it settles most of what is open, as it does
    in companies with few titles or few families. What is left is settled by rounds in which every
    open title asks for its first similar one: with none it is a leader; if that one is a leader it
    joins it; if that one joined another, it asks again. A round settles all chains of open titles
    from their front, so there are as many as such chains have changes of mind, whatever the number
    of titles.
    """
    opened, settled = cut_lineage(keys.select("company", "title", F.col("ord").cast("bigint").alias("ord"))), []
    size = opened.count()
    while size:
        first, opened = _heads(opened, head, block)
        settled.append(first)
        left = opened.count()
        if left > size / 2:
            break
        size = left
    else:
        return reduce(DataFrame.unionByName, settled) if settled else keys.select(
            "company", "title", F.col("title").alias("leader"))
    leaders = None
    while True:
        held = opened if leaders is None else opened.unionByName(leaders)
        asked = _asked(opened, held, block)
        free = asked.where("first IS NULL")
        leaders = free.select("company", "title", "ord") if leaders is None else leaders.unionByName(
            free.select("company", "title", "ord"))
        leaders = cut_lineage(leaders)
        known = leaders.select("company", F.col("ord").alias("first"), F.col("title").alias("leader"))
        joined = cut_lineage(asked.where("first IS NOT NULL").join(known, ["company", "first"], "left"))
        done = joined.where("leader IS NOT NULL").select("company", "title", "leader")
        settled += [free.select("company", "title", F.col("title").alias("leader")), done]
        opened = joined.where("leader IS NULL").select("company", "title", "ord")
        if opened.isEmpty():
            return reduce(DataFrame.unionByName, settled)


def _asked(opened: DataFrame, held: DataFrame, block: int) -> DataFrame:
    """Open titles with `first`, the place of the first similar title before them, or null."""
    probes = opened.select("company", "title", F.col("ord").alias("at"))
    spans = held.select("company", "title", "ord", F.col("ord").alias("since"), F.lit(ALWAYS).alias("until"))
    found = first_similar(probes, spans, block).select("company", "title", F.col("ord").alias("first"))
    return cut_lineage(opened.join(found, ["company", "title"], "left"))


def _heads(opened: DataFrame, head: int, block: int) -> tuple[DataFrame, DataFrame]:
    """What the first `head` titles of each company settle, and what stays open. The row limit applies
    before the shuffle, too."""
    rank = F.row_number().over(Window.partitionBy("company").orderBy("ord"))
    first = opened.withColumn("_n", rank).where(F.col("_n") <= head).drop("_n")
    first = cut_lineage(first.groupBy("company").applyInPandas(
        _settle, "company string, title string, ord long, leader string"))
    rest = cut_lineage(opened.join(first, ["company", "title"], "left_anti"))
    settled = first.select("company", "title", "leader")
    if rest.isEmpty():
        return settled, rest
    leaders = first.where(F.col("title") == F.col("leader")).select("company", "title", "ord")
    known = leaders.select("company", F.col("ord").alias("first"), F.col("title").alias("leader"))
    asked = cut_lineage(_asked(rest, leaders, block).join(known, ["company", "first"], "left"))
    taken = asked.where("leader IS NOT NULL").select("company", "title", "leader")
    return settled.unionByName(taken), asked.where("leader IS NULL").select("company", "title", "ord")


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ord")
    index, chosen = OrderedTitles(len(pdf)), []
    for title in pdf["title"]:
        hit = index.first_like(title)
        if hit < 0:
            index.add(title)
        chosen.append(title if hit < 0 else index.titles[hit])
    return pdf.assign(leader=chosen)[["company", "title", "ord", "leader"]]

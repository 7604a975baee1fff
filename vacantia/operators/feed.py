"""The feed: filters, sort orders, pages, and what a page shows."""

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions import text as X
from .shuffle import with_position

# Pages up to this depth come from a top-n; deeper ones from positions of the narrow sort keys. Both
# give the same rows in the same order.
TOP_N = 10_000


def _has(name: str, value: str) -> Column:
    return F.lower(name).contains(value.lower())


def experience_cap(cap: float) -> Column:
    numeric = F.col("required_experience").isNull() | (F.col("required_experience") <= cap)
    if cap > vocab.STRICT_CAP_YEARS:
        return numeric
    return numeric & _plain_words()


def _plain_words() -> Column:
    title, level = F.lower("title"), F.lower("experience_level")
    plain_title = reduce(and_, [~title.contains(k) for k in vocab.STRICT_TITLE_BLOCK])
    plain_level = reduce(and_, [level.isNull() | ~level.contains(k)
                                for k in vocab.STRICT_LEVEL_BLOCK])
    return plain_title & plain_level


def in_tab(status: str) -> Column:
    if status.lower() == "new":
        return (F.col("status") == "new") | F.col("status").isNull()
    return F.col("status") == status.lower()


def mentions(keyword: str) -> Column:
    return _has("title", keyword) | _has("company", keyword) | _has("description", keyword)


def conditions(min_ats=None, min_fit=None, max_exp=3.0, priority=None, work_mode=None,
               experience_level=None, status=None, keyword=None, location=None) -> list[Column]:
    """Predicates of the given filters; an absent filter adds none."""
    def given(value):
        return value and value.lower() != "all"

    out = []
    if max_exp is not None and max_exp > 0:
        out.append(experience_cap(max_exp))
    if min_ats is not None and min_ats > 0:
        out.append(F.col("ats_score") >= min_ats)
    if min_fit is not None and min_fit > 0:
        out.append(F.col("fit_score") >= min_fit)
    if given(priority):
        out.append(F.col("priority") == priority.upper())
    if given(work_mode):
        out.append(_has("work_mode", work_mode))
    if given(experience_level):
        out.append(_has("experience_level", experience_level))
    if given(status):
        out.append(in_tab(status))
    if keyword:
        out.append(mentions(keyword))
    if given(location):
        out.append(_has("location", location))
    return out


SCORE_FILTERS = ("min_ats", "min_fit", "priority")


def before_scoring(postings: DataFrame, **filters) -> DataFrame:
    """Rows that the filters on stored columns leave: apply it before scoring, which then works on
    those rows alone. A strict or loose cap tests the mined years, so only its title and level
    words apply here."""
    cap = filters.get("max_exp", 3.0)
    own = {k: v for k, v in filters.items() if k not in (*SCORE_FILTERS, "max_exp")}
    rows = reduce(DataFrame.where, conditions(max_exp=None, **own), postings)
    if cap is not None and 0 < cap <= vocab.STRICT_CAP_YEARS:
        rows = rows.where(_plain_words())
    return rows


def filtered(postings: DataFrame, **filters) -> DataFrame:
    return reduce(DataFrame.where, conditions(**filters), postings)


def priority_rank(priority: Column) -> Column:
    return F.coalesce(F.try_element_at(X.literal_map(vocab.PRIORITY_ORDER, "int"), priority),
                      F.lit(4))


def sort_order(sort_by: str) -> list[Column]:
    """Sort keys; an unknown name means priority_desc. The id ends every order, so pages are
    stable."""
    ats, fit, key = F.desc("ats_score"), F.desc("fit_score"), F.col("id")
    orders = {
        "ats_desc": [ats, fit, key],
        "fit_desc": [fit, ats, key],
        "date_desc": [F.desc("scraped_at"), F.desc("id")],
    }
    return orders.get(sort_by, [priority_rank(F.col("priority")), ats, fit, key])


def page(postings: DataFrame, sort_by: str = "priority_desc", limit: int = 100,
         offset: int = 0) -> DataFrame:
    """Rows offset .. offset+limit-1 of the order. Near the top this is a top-n: each task keeps
    offset+limit rows. Far down, rows are numbered by a distributed sort instead."""
    order = sort_order(sort_by)
    if offset + limit <= TOP_N:
        return postings.orderBy(*order).offset(offset).limit(limit)
    keys = postings.select("id", "priority", "ats_score", "fit_score", "scraped_at") \
        if "scraped_at" in postings.columns else postings.select("id", "priority", "ats_score",
                                                                 "fit_score")
    place = F.col("_position")
    wanted = with_position(keys, order, "_position").where(
        place.between(offset + 1, offset + limit)).select("id", "_position")
    return (postings.join(F.broadcast(wanted), "id").orderBy("_position")  # `limit` rows at most
            .select(*postings.columns))


def feed(postings: DataFrame, sort_by: str = "priority_desc", limit: int = 100, offset: int = 0,
         **filters) -> DataFrame:
    return page(filtered(postings, **filters), sort_by, limit, offset)


def total(postings: DataFrame, **filters) -> DataFrame:
    return filtered(postings, **filters).agg(F.count("*").alias("total"))


def page_count(postings: DataFrame, limit: int, **filters) -> DataFrame:
    pages = F.ceil(F.col("total") / F.lit(limit)).cast("bigint")
    return total(postings, **filters).select(
        "total", F.greatest(F.lit(1).cast("bigint"), pages).alias("pages"))


def ranked(page_rows: DataFrame, sort_by: str, offset: int) -> DataFrame:
    """Rank numbers of one page's rows. The input is a page, so one task numbers it."""
    place = F.row_number().over(Window.orderBy(*sort_order(sort_by)))
    return page_rows.withColumn("rank", (place + F.lit(offset)).cast("bigint"))


def score_band(score: Column) -> Column:
    shown = F.floor(F.coalesce(score, F.lit(0.0)) + 0.5)
    return F.when(shown >= 80, "green").when(shown >= 60, "amber").otherwise("red")


def leaves_tab(tab: Column, status: Column) -> Column:
    """Whether a status change takes the row off the tab it is shown on."""
    moved = ["applied", "ignored", "rejected", "saved"]
    return ((tab == "new") & status.isin(moved)) | (tab.isin(moved) & (status != tab))


def search(postings: DataFrame, keywords: str = vocab.FALLBACK_ROLE, location: str = "",
           posted_within: str = "r86400", work_type: str = "", max_pages: int = 5) -> DataFrame:
    """Newest postings for one role, at most `max_pages` pages of 25."""
    found = recent(in_work_type(postings, work_type), posted_within).where(mentions(keywords))
    if location:
        found = found.where(_has("location", location))
    return found.orderBy(*sort_order("date_desc")).limit(max_pages * vocab.PAGE_SIZE)


def roles_to_search(roles: list[str] | None, keywords: str | None) -> list[str]:
    return roles if roles else [keywords or vocab.FALLBACK_ROLE]


def search_roles(postings: DataFrame, roles: list[str], max_pages: int = 5,
                 location: str = "") -> DataFrame:
    """Newest postings per role in one pass: each row lists the roles it mentions, and the rank
    limit per role applies before the shuffle, too."""
    if location:
        postings = postings.where(_has("location", location))
    hit = F.array_compact(F.array(*[F.when(mentions(r), F.lit(r)) for r in roles]))
    rank = F.row_number().over(
        Window.partitionBy("role").orderBy(*sort_order("date_desc")))
    return (postings.withColumn("role", F.explode(hit)).withColumn("role_rank", rank)
            .where(F.col("role_rank") <= max_pages * vocab.PAGE_SIZE))


def recent(postings: DataFrame, posted_within: str) -> DataFrame:
    """Rows within the window before the newest row."""
    seconds = vocab.RECENCY_SECONDS[posted_within]
    if seconds is None:
        return postings
    newest = postings.agg(F.max("scraped_at")).scalar()
    return postings.where(F.col("scraped_at") >= newest - F.make_dt_interval(secs=F.lit(seconds)))


def in_work_type(postings: DataFrame, code: str) -> DataFrame:
    mode = vocab.WORK_TYPES[code]
    return postings if mode is None else postings.where(F.col("work_mode") == mode)


def pages_of(total_rows: int, limit: int) -> int:
    return max(1, math.ceil(total_rows / limit))

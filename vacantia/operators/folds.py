"""Merging the rows of one posting, as aggregates that combine before the shuffle."""

from pyspark.sql import Column, functions as F

from .. import vocab
from ..functions import text as X


def status_rank(status: Column) -> Column:
    return F.coalesce(F.try_element_at(X.literal_map(vocab.STATUS_RANK, "int"), status), F.lit(1))


def known_status(status: Column) -> Column:
    return F.coalesce(X.present(status), F.lit("new"))


def strongest_status(order: Column, status: Column) -> Column:
    """Orderable struct: the largest is the highest-ranked status, the earliest on a tie."""
    known = known_status(status)
    return F.struct(status_rank(known).alias("rank"), (-order).alias("back"),
                    known.alias("status"))


def city_entry(order: Column, location: Column) -> Column:
    """Orderable struct of a non-empty location, else null."""
    return F.when(~X.either_empty(location), F.struct(
        order.alias("seq"), X.city(location).alias("city"), location.alias("location")))


def city_group(location: Column) -> Column:
    """Rows of one city fold like the first of them: once a city is part of the text, another
    location of that city adds nothing. Grouping by it first splits a hot posting over tasks and
    leaves one entry per distinct city, which is also what the merged text holds."""
    return F.lower(F.coalesce(X.city(location), F.lit("")))


def fold_locations(seed: Column, entries: Column) -> Column:
    """Folds city entries, sorted by order, onto a location (X.merge_locations per step)."""
    def step(acc, e):
        low = F.lower(acc)
        same = X.strip(low) == X.strip(F.lower(e["location"]))
        return (F.when(acc == "", e["location"])
                .when(same | low.contains(F.lower(e["city"])), acc)
                .otherwise(F.concat(acc, F.lit(" / "), e["city"])))

    return F.aggregate(entries, F.coalesce(seed, F.lit("")), step)

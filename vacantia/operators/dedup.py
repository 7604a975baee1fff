"""Merging duplicate postings: by equal key, and by similar title within a company.

A narrow pass decides which rows merge and what the survivors look like; it never moves
descriptions. Full rows then move once, by their unique id, so no hot key reaches that join.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..session import cut_lineage
from . import folds
from .similar import assign_leaders


def row_key(rows: DataFrame) -> Column:
    """Stored key, else the one its company and title give."""
    made = X.dedup_key(F.col("company"), F.col("title"))
    return F.coalesce(X.present(F.col("dedup_key")), made) if "dedup_key" in rows.columns else made


def with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("dedup_key", X.fenced(row_key(rows)))


def _partials(keyed: DataFrame) -> DataFrame:
    """One row per (key, city): all that is needed to merge, without texts."""
    narrow = keyed.where(F.col("dedup_key") != "").select(
        "dedup_key", "id", "location", "is_reposted", "status",
        F.length(F.coalesce("description", F.lit(""))).alias("_length"))
    i = F.col("id")
    return narrow.groupBy("dedup_key", folds.city_group(F.col("location")).alias("_city")).agg(
        F.min("id").alias("leader_id"),
        F.count("*").alias("copies"),
        F.max((F.coalesce("is_reposted", F.lit(0)) != 0).cast("int")).alias("reposted"),
        F.max(folds.strongest_status(i, F.col("status"))).alias("strongest"),
        F.max(F.struct(F.col("_length").alias("length"), (-i).alias("back"))).alias("longest"),
        F.min(folds.city_entry(i, F.col("location"))).alias("entry"),
    )


def _combined(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by).agg(
        F.min("leader_id").alias("leader_id"),
        F.sum("copies").alias("copies"),
        F.max("reposted").alias("reposted"),
        F.max("strongest").alias("strongest"),
        F.max("longest").alias("longest"),
        F.sort_array(F.collect_list("entry")).alias("entries") if len(by) == 1
        else F.min("entry").alias("entry"),
    )


def _groups(parts: DataFrame, by: str) -> DataFrame:
    """One row per merged posting: its surviving id and the folded columns."""
    return _combined(parts, by).select(
        by, "leader_id", "copies", "reposted",
        F.col("strongest.status").alias("merged_status"),
        (-F.col("longest.back")).alias("text_id"),
        folds.fold_locations(F.lit(""), F.col("entries")).alias("merged_location"))


def exact_groups(rows: DataFrame) -> DataFrame:
    return _groups(_partials(with_key(rows)), "dedup_key")


def fuzzy_groups(rows: DataFrame) -> DataFrame:
    """Groups of `exact_groups` further merged where titles of a company are similar."""
    parts = cut_lineage(_partials(with_key(rows)))
    keys = parts.groupBy("dedup_key").agg(F.min("leader_id").alias("ord")).select(
        X.key_company(F.col("dedup_key")).alias("company"),
        X.key_title(F.col("dedup_key")).alias("title"), "ord")
    leaders = assign_leaders(keys).select(
        F.concat_ws(":", "company", "title").alias("dedup_key"),
        F.concat_ws(":", "company", "leader").alias("leader_key"))
    moved = _combined(parts.join(leaders, "dedup_key"), "leader_key", "_city")
    return _groups(moved, "leader_key")


def apply_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Keeps the survivors with their merged columns, and rows without a key as they are. A text
    taken over from another copy is fetched for those groups alone."""
    keyed = with_key(rows)
    groups = groups.select("leader_id", "copies", "reposted", "merged_status", "text_id",
                           "merged_location")
    kept = keyed.join(groups, keyed["id"] == groups["leader_id"], "left").where(
        F.col("leader_id").isNotNull() | (F.col("dedup_key") == ""))
    borrowed = groups.where(F.col("text_id") != F.col("leader_id")).select(
        F.col("leader_id").alias("_for"), "text_id")
    texts = borrowed.join(
        rows.select(F.col("id").alias("text_id"), F.col("description").alias("_text")),
        "text_id").select("_for", "_text")
    merged = F.col("copies") > 1
    out = kept.join(texts, kept["id"] == texts["_for"], "left").withColumns({
        "location": F.when(merged, F.col("merged_location")).otherwise(F.col("location")),
        "is_reposted": F.when(merged, F.col("reposted")).otherwise(F.col("is_reposted")),
        "status": F.when(merged, F.col("merged_status")).otherwise(F.col("status")),
        "description": F.when(merged, F.coalesce("_text", "description", F.lit("")))
        .otherwise(F.col("description")),
    })
    return out.select(*keyed.columns)


def dedup_exact(rows: DataFrame) -> DataFrame:
    return apply_groups(rows, exact_groups(rows))


def dedup_fuzzy(rows: DataFrame) -> DataFrame:
    return apply_groups(rows, cut_lineage(fuzzy_groups(rows)))


def report(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """initial_count, cleaned_count, duplicates_removed of a merge."""
    merged = groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("removed"))
    total = rows.agg(F.count("*").alias("initial_count"))
    return total.withColumn("removed", merged.scalar()).select(
        "initial_count", (F.col("initial_count") - F.col("removed")).alias("cleaned_count"),
        F.col("removed").cast("bigint").alias("duplicates_removed"))

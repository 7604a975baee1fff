"""Merging a batch of crawled postings into the stored ones.

A row of the batch belongs to a stored posting with the same posting id, else the same key, else
a similar title of the same company, else it starts a new posting together with the batch rows
that share its key. `seq` is the order inside the batch.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import text as X
from ..schema import POSTING, SCORE_COLUMNS
from ..session import cut_lineage
from . import folds, replay
from .dedup import row_key
from .shuffle import salted_join, with_position

# Columns where the last non-empty value wins.
TEXT_COLUMNS = ["title", "company", "url", "posted_at", "employment_type", "experience_level",
                "work_mode", "salary", "dedup_key"]

# Values a new posting gets for what its row does not give.
INSERT_DEFAULTS = {
    "title": vocab.UNKNOWN_TITLE, "company": vocab.UNKNOWN_COMPANY, "location": "", "url": "",
    "posted_at": "", "employment_type": "", "experience_level": "", "work_mode": "", "salary": "",
    "description": "", "ats_score": 0.0, "fit_score": 0.0, "priority": "MEDIUM",
    "ai_analysis": "", "seniority": "",
}


def prepared(batch: DataFrame) -> DataFrame:
    """Key and repost flag as they are at ingest; a missing company or title gets its stand-in
    before the key is made, an empty one does not."""
    company = F.coalesce("company", F.lit(vocab.UNKNOWN_COMPANY))
    title = F.coalesce("title", F.lit(vocab.UNKNOWN_TITLE))
    given = F.col("is_reposted") if "is_reposted" in batch.columns else F.lit(None).cast("int")
    return batch.withColumns({
        "posting_id": F.coalesce("posting_id", F.lit("")),
        "dedup_key": X.fenced(X.dedup_key(company, title)),
        "is_reposted": X.repost_flag(given, F.col("posted_at"), F.col("description")),
    })


def match_by_id(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds `by_id`: the stored posting with the same posting id. The batch's distinct ids pick
    the stored rows first; the few that remain are looked up by the batch rows."""
    wanted = batch.select("posting_id").distinct()
    ids = stored.select("posting_id", F.col("id").alias("by_id")).join(wanted, "posting_id",
                                                                       "left_semi")
    return salted_join(batch, ids, "posting_id", "seq")


def _stored_keys(stored: DataFrame) -> DataFrame:
    return stored.select(X.fenced(row_key(stored)).alias("dedup_key"), "id").where(
        "dedup_key <> ''")


def _lowest_by_key(keys: DataFrame) -> DataFrame:
    return keys.groupBy("dedup_key").agg(F.min("id").alias("by_key"))


def _open_keys(matched: DataFrame) -> DataFrame:
    return (matched.where(F.col("by_id").isNull() & (F.col("dedup_key") != ""))
            .select("dedup_key").distinct())


def match_by_key(matched: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds `by_key`: the lowest stored id with the same key. The batch's distinct keys pick the
    stored rows first, so the stored table is not shuffled when they are few."""
    return _match_by_key(matched, _stored_keys(stored))


def _match_by_key(matched: DataFrame, keys: DataFrame) -> DataFrame:
    hits = salted_join(keys, _open_keys(matched), "dedup_key", "id", "left_semi")
    return salted_join(matched, _lowest_by_key(hits), "dedup_key", "seq").withColumn(
        "by_key", F.when(F.col("by_id").isNull(), F.col("by_key")))


def resolve(batch: DataFrame, stored: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Batch rows with `target_id`, the stored posting they belong to, or else `new_group`, the
    new posting they belong to; `is_new` marks the row that starts it.

    Rows count one after the other: a row that moves a posting to another key does so for the rows
    after it. Rows that such moves, or with `fuzzy` similar titles, can concern go through `replay`, on
    ids and keys alone; all others are matched as a set. Keys are made once, on either side."""
    ready = prepared(batch)
    keyed = cut_lineage(ready.select("seq", "posting_id", "dedup_key"))
    held = cut_lineage(stored.select("id", "posting_id", F.coalesce(
        X.fenced(row_key(stored)), F.lit("")).alias("dedup_key")))
    out = _match_by_key(match_by_id(keyed, held), held.select("dedup_key", "id").where("dedup_key <> ''"))
    key = F.col("dedup_key")
    group = F.when(key != "", F.concat(F.lit("k:"), key)).otherwise(F.concat(F.lit("p:"), F.col("posting_id")))
    narrow = cut_lineage(out.select(F.col("seq").cast("bigint").alias("seq"), "posting_id", "dedup_key",
                                    F.col("by_id").cast("bigint").alias("fixed"), "by_key"))
    concerned = _concerned(narrow, held, fuzzy)
    found = narrow.select("seq", F.coalesce("fixed", "by_key").alias("target_id"), F.when(
        F.coalesce("fixed", "by_key").isNull(), group).alias("new_group"))
    if concerned is not None:
        rows, owners = concerned
        new = F.col("owner") >= replay.NEW
        done = replay.resolved(rows, owners, fuzzy).select(
            "seq", F.when(~new, F.col("owner")).alias("_target"), F.when(new, F.concat(
                F.lit("s:"), (F.col("owner") - replay.NEW).cast("string"))).alias("_group"),
            F.lit(True).alias("_done"))
        found = cut_lineage(found.join(done, "seq", "left").select(
            "seq", F.when(F.col("_done"), F.col("_target")).otherwise(F.col("target_id")).alias("target_id"),
            F.when(F.col("_done"), F.col("_group")).otherwise(F.col("new_group")).alias("new_group")))
    starts = found.where(F.col("target_id").isNull()).groupBy("new_group").agg(
        F.min("seq").alias("seq")).select("seq", F.lit(True).alias("is_new"))
    found = found.join(starts, "seq", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    return ready.join(found, "seq")


def _concerned(rows: DataFrame, owners: DataFrame, fuzzy: bool) -> tuple[DataFrame, DataFrame] | None:
    """The rows whose posting may depend on the order of the batch, and the stored postings (id,
    posting_id, dedup_key) they can meet; None if there are none. Those are rows of posting ids that come
    with several keys (a stored one included), and rows that share with them a key or, with `fuzzy`, a
    company; with `fuzzy` also all rows of companies that have several keys."""
    named = rows.where("fixed IS NOT NULL").select(F.col("fixed").alias("id")).distinct()
    ids = rows.select("posting_id", "dedup_key").unionByName(
        owners.join(named, "id", "left_semi").select("posting_id", "dedup_key"))
    several = cut_lineage(ids.groupBy("posting_id").agg(F.min("dedup_key").alias("a"), F.max("dedup_key").alias("b"))
                          .where("a <> b").select("posting_id"))

    def scope():
        return X.key_company(F.col("dedup_key")) if fuzzy else F.col("dedup_key")

    moving = ids.join(several, "posting_id", "left_semi").where("dedup_key <> ''").select(scope().alias("scope"))
    if fuzzy:
        asked = rows.where("dedup_key <> ''").select(scope().alias("scope"), "dedup_key")
        there = owners.where("dedup_key <> ''").select(scope().alias("scope"), "dedup_key").join(
            asked.select("scope").distinct(), "scope", "left_semi")
        mixed = asked.unionByName(there).groupBy("scope").agg(
            F.min("dedup_key").alias("a"), F.max("dedup_key").alias("b")).where("a <> b")
        moving = moving.unionByName(mixed.select("scope"))
    scopes = cut_lineage(moving.distinct())
    if scopes.isEmpty() and several.isEmpty():
        return None
    scoped = rows.withColumn("scope", scope())
    marked = scopes.withColumn("_in", F.lit(True))
    concerned = (salted_join(scoped, marked, "scope", "seq")
                 .join(several.withColumn("_several", F.lit(True)), "posting_id", "left")
                 .where("_in OR _several").select("seq", "posting_id", "dedup_key", "fixed"))
    near = salted_join(owners.withColumn("scope", scope()), scopes, "scope", "id", "left_semi")
    by_id = owners.join(named, "id", "left_semi").join(several, "posting_id", "left_semi")
    met = near.select("id", "dedup_key").unionByName(by_id.select("id", "dedup_key")).distinct()
    return cut_lineage(concerned), met


def _folded(rows: DataFrame, by: str) -> DataFrame:
    """All that a group's rows bring to their posting, in two aggregates that combine early: one
    per (group, city), one per group, so a hot group is split over its cities first."""
    seq = F.col("seq")
    columns = set(rows.columns)
    scores = [c for c in SCORE_COLUMNS if c in columns]
    others = [c for c in POSTING.names if c in columns and c not in ("id", "status")]

    def newest(name):
        return F.max(F.when(~X.either_empty(F.col(name)), F.struct(seq, F.col(name).alias("value"))))

    def combine(name):
        return F.max(name).alias(name)

    first = F.struct(seq, *[F.col(c) for c in others if c not in ("description", *SCORE_COLUMNS)])
    parts = rows.groupBy(by, folds.city_group(F.col("location")).alias("_city")).agg(
        F.min(first).alias("_row"),
        *[newest(c).alias("_" + c) for c in TEXT_COLUMNS if c in columns],
        F.max(F.struct(F.length(F.coalesce("description", F.lit(""))).alias("length"),
                       (-seq).alias("back"), F.coalesce("description", F.lit("")).alias("text")))
        .alias("_description"),
        F.max("is_reposted").alias("_is_reposted"),
        F.min(folds.city_entry(seq, F.col("location"))).alias("_entry"),
        *[F.max_by(F.struct(seq, F.col(c).alias("value")),
                   F.when(F.col(c).isNotNull(), seq)).alias("_" + c) for c in scores],
    )
    return parts.groupBy(by).agg(
        F.min("_row").alias("_row"),
        *[combine("_" + c) for c in TEXT_COLUMNS if c in columns],
        combine("_description"), combine("_is_reposted"),
        F.sort_array(F.collect_list("_entry")).alias("_entries"),
        *[F.max_by("_" + c, F.col("_" + c + ".seq")).alias("_" + c) for c in scores],
    )


def _filled(name: str, fallback: Column) -> Column:
    return F.coalesce(F.col(f"_{name}.value"), fallback)


def updates(resolved: DataFrame) -> DataFrame:
    """One folded row per stored posting the batch touches."""
    return _folded(resolved.where(F.col("target_id").isNotNull()), "target_id")


def inserts(resolved: DataFrame, stored: DataFrame) -> DataFrame:
    """New postings with their defaults. Ids go on from the highest stored id, in batch order."""
    folded = _folded(resolved.where(F.col("target_id").isNull()), "new_group")
    highest = F.coalesce(stored.agg(F.max("id")).scalar(), F.lit(0))
    placed = with_position(folded, [F.col("_row.seq")], "_position")

    def column(field):
        name = field.name
        default = F.lit(INSERT_DEFAULTS.get(name)).cast(field.dataType)
        if name == "id":
            return F.col("_position") + highest
        if name == "status":
            return F.lit("new")
        if name == "location":
            return folds.fold_locations(F.lit(""), F.col("_entries"))
        if name == "description":
            return F.col("_description.text")
        if name == "is_reposted":
            return F.col("_is_reposted")
        if name in ("matched_skills", "missing_skills", "hard_req_concerns"):
            default = F.array().cast("array<string>")
        given = "_" + name in folded.columns
        if name in TEXT_COLUMNS:
            return _filled(name, F.coalesce(F.col(f"_row.{name}"), default))
        if name in SCORE_COLUMNS:
            return _filled(name, default) if given else default
        return F.col(f"_row.{name}")

    return placed.select(*[column(f).cast(f.dataType).alias(f.name) for f in POSTING.fields
                           if f.name != "scraped_at" or "scraped_at" in resolved.columns])


def apply_updates(stored: DataFrame, folded: DataFrame) -> DataFrame:
    """Stored postings with the batch's values; id, posting id, crawl time and status stay."""
    joined = stored.join(folded, stored["id"] == folded["target_id"], "left")
    touched = F.col("target_id").isNotNull()
    text = F.col("_description")

    def column(name):
        old = F.col(name)
        if name == "location":
            new = folds.fold_locations(old, F.col("_entries"))
        elif name == "description":
            new = F.when(text["length"] > F.length(F.coalesce(old, F.lit(""))),
                         text["text"]).otherwise(old)
        elif name == "is_reposted":
            new = F.greatest((F.coalesce(old, F.lit(0)) != 0).cast("int"), F.col("_is_reposted"))
        elif "_" + name in folded.columns and name in (*TEXT_COLUMNS, *SCORE_COLUMNS):
            new = _filled(name, old)
        else:
            return old
        return F.when(touched, new).otherwise(old)

    return joined.select(*[column(c).alias(c) for c in stored.columns])


def upsert(batch: DataFrame, stored: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The stored postings after the batch. The resolved batch, small next to the stored table,
    feeds both the updates and the inserts, so it is written once."""
    resolved = cut_lineage(resolve(batch, stored, fuzzy))
    fresh = inserts(resolved, stored)
    return apply_updates(stored, updates(resolved)).unionByName(fresh, allowMissingColumns=True)


def apply_scores(stored: DataFrame, scores: DataFrame) -> DataFrame:
    """Overwrites every score column of postings that have a row in `scores` (id, score columns)."""
    new = scores.select(F.col("id").alias("_id"),
                        *[F.col(c).alias("_" + c) for c in SCORE_COLUMNS if c in scores.columns])
    joined = stored.join(new, stored["id"] == new["_id"], "left")
    scored = F.col("_id").isNotNull()
    return joined.select(*[
        F.when(scored, F.col("_" + c)).otherwise(F.col(c)).alias(c)
        if "_" + c in new.columns else F.col(c) for c in stored.columns])


def apply_status(stored: DataFrame, latest: DataFrame) -> DataFrame:
    """Sets the status of postings that have a row in `latest` (id, status)."""
    new = latest.select(F.col("id").alias("_id"), F.lower("status").alias("_status"))
    return (stored.join(new, stored["id"] == new["_id"], "left")
            .withColumn("status", F.coalesce("_status", "status")).drop("_id", "_status"))


def run_log(resolved: DataFrame, stamp: Column, *by: str) -> DataFrame:
    """Found and new rows per search, as appended to the log."""
    return resolved.groupBy(*by).agg(
        F.count("*").alias("jobs_found"), F.count_if("is_new").alias("new_jobs")).withColumn(
        "ts", stamp)

"""Scoring postings against one active profile or many."""

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions import extract, scoring as S
from ..functions import text as X
from ..schema import SCORE_COLUMNS
from ..session import cut_lineage
from .feed import priority_rank
from .shuffle import in_cells, salted_join

CELL = 256  # signatures that meet CELL profiles in one cell
TITLE_CLOUDS = ["azure", "aws", "gcp"]  # what the title gate looks for


def with_active_profile(postings: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds column `p`, the active profile, as a literal: the profile table has one row for the
    whole job, so its fields fold into the plan and no join is needed."""
    rows = profile.limit(1).select(S.prepared_profile().alias("p")).select("p.*").collect()
    if not rows:
        raise ValueError("an active profile is needed; see operators.profiles.active_profile")
    typed = ",".join(f.strip().replace(" ", ":", 1) for f in S.PROFILE_FIELDS.split(","))
    literal = F.from_json(F.lit(json.dumps(rows[0].asDict(recursive=True))), f"struct<{typed}>")
    return postings.withColumn("p", literal)


def with_scores(df: DataFrame) -> DataFrame:
    """Adds the ten score columns from `req` and `p`. Narrow: no shuffle, no Python."""
    req, p = F.col("req"), F.col("p")
    kept = [c for c in df.columns if c not in SCORE_COLUMNS]
    df = df.withColumns({
        "matched_skills": S.matched_skills(req, p),
        "missing_skills": S.missing_skills(req, p),
        "_exp": S.experience(req, p),
        "_gate": S.title_gate(F.col("title"), p),
        "_degree": S.degree_gate(req, p),
    })
    matched = F.col("matched_skills")
    parts = {
        "skills": S.skills_score(req, p),
        "experience": F.col("_exp.score"),
        "responsibilities": S.responsibilities_score(req),
        "cloud_platform": S.cloud_score(req, p),
        "education": S.education_score(p),
        "certifications": S.certifications_score(p),
        "ats_keywords": S.keywords_score(matched),
        "location": S.location_score(F.col("location"), p),
    }
    df = df.withColumns({
        "_parts": F.struct(*[c.alias(n) for n, c in parts.items()]),
        "_penalty": F.col("_exp.penalty") + F.col("_gate.penalty") + F.col("_degree.penalty"),
        "hard_req_concerns": F.concat("_exp.concerns", "_gate.concerns", "_degree.concerns"),
        "fit_score": S.fit_score(req, p, matched, F.col("work_mode")),
    })
    total = sum((F.col(f"_parts.{n}") for n in ("experience", "responsibilities", "cloud_platform",
                                                "education", "certifications", "ats_keywords",
                                                "location")), F.col("_parts.skills"))
    df = df.withColumn("_raw", F.bround(total, 1))
    df = df.withColumn("ats_score", F.greatest(F.lit(0.0), F.least(
        F.lit(100.0), F.bround(F.col("_raw") - F.col("_penalty"), 1))))
    df = df.withColumn("priority", S.priority(
        F.col("ats_score"), F.col("fit_score"), F.col("hard_req_concerns"), F.col("_exp.concerns")))
    level = S.breakdown(
        {n: F.col(f"_parts.{n}") for n in parts}, F.col("_raw"), F.col("_penalty"),
        F.col("hard_req_concerns"), F.col("ats_score"), F.col("fit_score"), F.col("priority"))
    score = F.struct(
        "ats_score", "fit_score", "priority", "matched_skills", "missing_skills",
        "hard_req_concerns", level.alias("score_breakdown"), F.lit("").alias("ai_analysis"),
        req["min_years"].alias("required_experience"), req["seniority"].alias("seniority"))
    return df.select(*kept, X.fenced(score).alias("_score")).select(*kept, "_score.*")


def score_postings(postings: DataFrame, profile: DataFrame) -> DataFrame:
    """Requirements and scores of every posting for the active profile: one narrow pass."""
    analysed = extract.with_requirements(postings)
    return with_scores(with_active_profile(analysed, profile)).drop("p")


# Many profiles ----------------------------------------------------------------------------------
#
# What a score sees of a posting is its signature; postings that look alike share one, as candidates
# that look alike share a profile. Texts are mined once, scores are worked out per signature and
# profile, and nothing about profiles passes through the driver or the plan.


def signature() -> Column:
    """All that `with_scores` reads of a posting, from `req`, title, location and work_mode."""
    title, here = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("location", F.lit("")))
    mode, req = F.lower(F.coalesce("work_mode", F.lit(""))), F.col("req")
    return F.struct(
        req.alias("req"),
        F.array_join(F.array_compact(F.array(*[F.when(title.contains(c), F.lit(c)) for c in TITLE_CLOUDS])), " ")
        .alias("title"),
        F.when(here.contains("india") | here.contains("remote"), "").otherwise(here).alias("location"),
        F.when(mode.contains("remote"), "remote").when(mode.contains("hybrid"), "hybrid").otherwise("")
        .alias("work_mode"))


def signed(postings: DataFrame) -> DataFrame:
    """(id, sig_key, sig) of every posting, written: one narrow pass over the texts."""
    mined = extract.with_requirements(postings.select(
        "id", "title", "location", "work_mode", "description", "experience_level"))
    return cut_lineage(mined.select("id", X.fenced(signature()).alias("sig")).select(
        "id", F.sha2(F.to_json("sig"), 256).alias("sig_key"), "sig"))


def _scored_pairs(pairs: DataFrame) -> DataFrame:
    """Scores of (sig, p) rows; other columns stay."""
    kept = [c for c in pairs.columns if c not in ("sig", "p")]
    return with_scores(pairs.select(*kept, "sig.*", "p")).drop("req", "p", "title", "location", "work_mode")


def scored_signatures(signatures: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every distinct signature (sig_key, sig, ...) scored for every distinct profile (as
    `profile_key`), in cells of CELL by CELL."""
    return _in_cells(signatures, distinct_profiles(profiles))


def _in_cells(signatures: DataFrame, prepared: DataFrame) -> DataFrame:
    left, right = in_cells(signatures, _as_struct(prepared), [], "sig_key", "profile_key", CELL)
    return _scored_pairs(left.join(right, "_cell").drop("_cell"))


def _as_struct(prepared: DataFrame) -> DataFrame:
    return prepared.select("profile_key", F.struct(*[c for c in prepared.columns if c != "profile_key"]).alias("p"))


def score_for_profiles(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every posting with its scores for every *distinct* profile (column `profile_key`)."""
    rows = signed(postings)
    scored = scored_signatures(rows.groupBy("sig_key").agg(F.first("sig").alias("sig")), profiles)
    kept = [c for c in postings.columns if c not in SCORE_COLUMNS]
    return postings.select(*kept).join(rows.select("id", "sig_key"), "id").join(scored, "sig_key").drop("sig_key")


def profile_tally(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per distinct profile, how many postings have each priority, and the best scores."""
    return _tally(postings, distinct_profiles(profiles))


def _tally(postings: DataFrame, prepared: DataFrame) -> DataFrame:
    counted = signed(postings).groupBy("sig_key").agg(F.first("sig").alias("sig"), F.count("*").alias("n"))
    scored = _in_cells(counted, prepared)

    def of(level):
        return F.sum(F.when(F.col("priority") == level, F.col("n")).otherwise(F.lit(0).cast("bigint")))

    return scored.groupBy("profile_key").agg(
        of("HIGH").alias("n_high"), of("MEDIUM").alias("n_medium"), of("LOW").alias("n_low"),
        F.max("ats_score").alias("best_ats"), F.max("fit_score").alias("best_fit"))


# Best postings of each profile. Signatures fall into classes by all that bounds a score but skills,
# clouds and place: the best score that any signature of a class can reach is known from the class and
# a few facts about the profile. Classes are opened best first until they hold k postings; then all
# classes whose bound reaches the k-th score found.


def _signature_class() -> Column:
    req = F.col("sig.req")
    return F.struct(req["min_years"].alias("min_years"), req["seniority"].alias("seniority"),
                    req["domain"].alias("domain"), req["degree_required"].alias("degree_required"),
                    F.col("sig.title").alias("title"), F.col("sig.work_mode").alias("work_mode"))


def _profile_class() -> Column:
    clouds = F.filter(F.array(*[F.lit(c) for c in TITLE_CLOUDS]),
                      lambda c: F.exists(F.col("p.clouds"), lambda owned: owned.contains(c)))
    return F.struct(F.col("p.years").alias("years"), F.col("p.has_education").alias("has_education"),
                    F.col("p.has_certifications").alias("has_certifications"), clouds.alias("clouds"))


def _with_bounds(pairs: DataFrame) -> DataFrame:
    """Adds priority rank, ATS and FIT score that no signature of class `sc` exceeds for a profile of
    class `pc`: every skill and cloud matched, the place right."""
    req = F.struct(F.col("sc.min_years").alias("min_years"), F.lit(None).cast("double").alias("max_years"),
                   F.col("sc.seniority").alias("seniority"), F.col("sc.domain").alias("domain"),
                   F.col("sc.degree_required").alias("degree_required"))
    p = F.col("pc")
    every_core = F.array(*[F.lit(s) for s in vocab.CORE_STACK])
    out = pairs.withColumns({"_exp": S.experience(req, p), "_gate": S.title_gate(F.col("sc.title"), p),
                             "_degree": S.degree_gate(req, p)})
    most = (F.col("_exp.score") + S.responsibilities_score(req) + S.education_score(p)
            + S.certifications_score(p) + F.lit(35.0 + 10.0 + 5.0 + 5.0))
    penalty = F.col("_exp.penalty") + F.col("_gate.penalty") + F.col("_degree.penalty")
    slack = 0.1  # of rounding
    out = out.withColumns({
        "ats_most": F.greatest(F.lit(0.0), F.least(F.lit(100.0), most - penalty + slack)),
        "fit_most": F.least(F.lit(100.0), S.fit_score(req, p, every_core, F.col("sc.work_mode")) + slack),
    })
    level = S.priority(F.col("ats_most"), F.col("fit_most"),
                       F.concat("_exp.concerns", "_gate.concerns", "_degree.concerns"), F.col("_exp.concerns"))
    return out.withColumn("rank_least", priority_rank(level)).drop("_exp", "_gate", "_degree")


def _best(scored: DataFrame, k: int, last: str) -> DataFrame:
    """The first k rows of each profile; the limit applies before the shuffle, too."""
    order = [F.col("priority_rank"), F.desc("ats_score"), F.desc("fit_score"), F.col(last)]
    rank = F.row_number().over(Window.partitionBy("profile_key").orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _opened(signatures: DataFrame, profiles: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Signatures of the classes (profile_key, sc) scored for their profiles, the k best of each."""
    asked = profiles.join(classes, "profile_key")
    left, right = in_cells(signatures, asked, ["sc"], "sig_key", "profile_key", CELL)
    scored = _scored_pairs(left.drop("sc").join(right.drop("sc"), "_cell").drop("_cell"))
    ranked = scored.select("profile_key", "sig_key", "first_id", "ids", "priority", "ats_score", "fit_score",
                           priority_rank(F.col("priority")).alias("priority_rank"))
    return _best(ranked, k, "first_id").drop("rank")


def top_postings(postings: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """(profile_key, rank, id, priority, ats_score, fit_score): the best k postings of every distinct
    profile by priority, ATS, FIT and id."""
    return _top(postings, distinct_profiles(profiles), k)


def _top(postings: DataFrame, prepared: DataFrame, k: int) -> DataFrame:
    rows = signed(postings)
    place = F.row_number().over(Window.partitionBy("sig_key").orderBy("id"))
    few = rows.withColumn("_n", place).where(F.col("_n") <= k)  # alike in score, so the first k will do
    signatures = cut_lineage(few.groupBy("sig_key").agg(
        F.first("sig").alias("sig"), F.min("id").alias("first_id"), F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("sc", _signature_class()))
    people = cut_lineage(_as_struct(prepared).withColumn("pc", _profile_class()))
    # Classes are few: years, levels and flags. Both sides are bounded by what these can be.
    held = signatures.groupBy("sc").agg(F.sum(F.size("ids")).alias("n"))
    left, right = in_cells(held, people.select("pc").distinct(), [], "sc", "pc", CELL)
    bounds = cut_lineage(_with_bounds(left.join(right, "_cell").drop("_cell")))
    order = Window.partitionBy("pc").orderBy("rank_least", F.desc("ats_most"), F.desc("fit_most"), "sc")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = cut_lineage(bounds.withColumn("first", before < k))
    by_profile = people.select("profile_key", "pc").join(bounds, "pc").drop("pc")
    profiles = people.drop("pc")
    start = cut_lineage(_opened(signatures, profiles, by_profile.where("first").select("profile_key", "sc"), k))
    score = F.struct(-F.col("priority_rank"), F.col("ats_score"), F.col("fit_score"))
    holds = F.size("ids")
    reached = start.withColumn("_n", F.sum(holds).over(Window.partitionBy("profile_key").orderBy(
        "priority_rank", F.desc("ats_score"), F.desc("fit_score"), "first_id"))).where(
        F.col("_n") >= k).groupBy("profile_key").agg(F.max(score).alias("kth"))
    most = F.struct(-F.col("rank_least"), F.col("ats_most"), F.col("fit_most"))
    more = by_profile.where("NOT first").join(reached, "profile_key", "left").where(
        F.col("kth").isNull() | (most >= F.col("kth"))).select("profile_key", "sc")
    rest = _opened(signatures, profiles, more, k)
    best = _best(start.unionByName(rest), k, "first_id").drop("rank")
    return _best(best.withColumn("id", F.explode("ids")), k, "id").select(
        "profile_key", "rank", "id", "priority", "ats_score", "fit_score")


SCORER_FIELDS = ("years_experience", "location", "skills", "cloud_platforms", "education", "certifications")


def _scorer_view() -> Column:
    """What the scorer sees of a profile, as it was entered."""
    return F.struct("years_experience", F.lower("location").alias("location"), "skills",
                    "cloud_platforms", S.has_items("education").alias("has_education"),
                    S.has_items("certifications").alias("has_certifications"))


def profile_key() -> Column:
    # Never null, and said so: else a join on it works it out once more to filter.
    return F.coalesce(F.sha2(F.to_json(_scorer_view()), 256), F.lit(""))


def distinct_profiles(profiles: DataFrame) -> DataFrame:
    """Prepared profiles by key. Equal profiles meet before they are prepared."""
    return _distinct(profiles.withColumn("profile_key", profile_key()))


def _distinct(keyed: DataFrame) -> DataFrame:
    return (keyed.select("profile_key", _scorer_view().alias("v"))
            .groupBy("profile_key").agg(F.first("v").alias("v")).select("profile_key", "v.*")
            .select("profile_key", S.prepared_profile(
                F.col("has_education"), F.col("has_certifications")).alias("p"))
            .select("profile_key", "p.*"))


def _keyed(candidates: DataFrame) -> DataFrame:
    """Candidates with the key of their profile, worked out once and written."""
    return cut_lineage(candidates.withColumn("profile_key", profile_key()))


def top_per_candidate(postings: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Best k postings of each candidate; candidates join last, on the key of their profile."""
    keyed = _keyed(candidates)
    return _of_candidates(_top(postings, _distinct(keyed), k), keyed)


def tally_per_candidate(postings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each candidate with the `profile_tally` of their profile."""
    keyed = _keyed(candidates)
    return _of_candidates(_tally(postings, _distinct(keyed)), keyed)


def for_candidates(by_profile: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with the rows of their profile."""
    return _of_candidates(by_profile, candidates.withColumn("profile_key", profile_key()))


def _of_candidates(by_profile: DataFrame, keyed: DataFrame) -> DataFrame:
    # Many may share one profile, so they are spread.
    return salted_join(keyed, by_profile, "profile_key", "candidate_id", "inner")

"""Score columns: requirements (`req`) against a prepared profile (`p`).

Everything is a native expression over one row; rounding is half-even.
"""

from pyspark.sql import Column, functions as F

from .. import vocab
from ..schema import COMPONENTS
from . import text as X


def skill_match(job_skill: Column, resume_skill: Column) -> Column:
    """Equal, or one inside the other when both are longer than two characters."""
    inside = job_skill.contains(resume_skill) | resume_skill.contains(job_skill)
    return (job_skill == resume_skill) | (
        inside & (F.length(job_skill) > 2) & (F.length(resume_skill) > 2))


def has_items(name: str) -> Column:
    return F.size(name) > 0


def prepared_profile(has_education: Column | None = None,
                     has_certifications: Column | None = None) -> Column:
    """Struct of what the scorer needs from a profile row. The comparison of the skill dictionary
    with the profile happens here, once per profile, so scoring a posting is set arithmetic on
    its few skills."""
    owned = F.array_distinct(F.transform("skills", lambda s: F.lower(X.strip(s))))
    hits = F.filter(X.literal_list(vocab.SKILL_TERMS), lambda t: F.exists(owned, lambda s: skill_match(F.lower(t), s)))
    cloud_low = F.transform("cloud_platforms", lambda c: F.lower(c))
    return F.struct(
        F.col("years_experience").alias("years"),
        F.lower("location").alias("location"),
        hits.alias("skill_hits"),
        F.slice("skills", 1, 6).alias("first_skills"),
        cloud_low.alias("clouds"),
        (has_items("education") if has_education is None else has_education)
        .alias("has_education"),
        (has_items("certifications") if has_certifications is None else has_certifications)
        .alias("has_certifications"),
    )


PROFILE_FIELDS = ("years double, location string, skill_hits array<string>, "
                  "first_skills array<string>, clouds array<string>, has_education boolean, "
                  "has_certifications boolean")


def matched_skills(req: Column, p: Column) -> Column:
    return F.when(F.size(req["skills"]) == 0, p["first_skills"]).otherwise(
        F.array_intersect(req["skills"], p["skill_hits"]))


def missing_skills(req: Column, p: Column) -> Column:
    return F.array_except(req["skills"], p["skill_hits"])


def _share(part: Column, whole: Column, points: float) -> Column:
    return F.bround(part / whole * F.lit(points), 1)


def skills_score(req: Column, p: Column) -> Column:
    asked = F.size(req["skills"])
    return F.when(asked == 0, F.lit(28.0)).otherwise(
        _share(F.size(F.array_intersect(req["skills"], p["skill_hits"])), asked, 35.0))


def cloud_score(req: Column, p: Column) -> Column:
    asked = F.size(req["clouds"])
    shared = F.size(F.filter(req["clouds"],
                             lambda c: F.array_contains(p["clouds"], F.lower(c))))
    return F.when(asked == 0, F.when(F.size(p["clouds"]) > 0, 7.0).otherwise(4.0)).otherwise(
        _share(shared, asked, 10.0))


def _is_senior(req: Column) -> Column:
    return req["seniority"].isin(vocab.SENIOR_GROUP)


def experience(req: Column, p: Column) -> Column:
    """{score, penalty, concerns}."""
    years, low, high = p["years"], req["min_years"], req["max_years"]
    gap = low - years
    asked = F.concat(
        X.plain_number(low),
        F.when(high.isNotNull() & (high != 0), F.concat(F.lit("-"), X.plain_number(high)))
        .otherwise(F.lit("+")),
        F.lit(" years"))
    mismatch = _is_senior(req) & (years < 3.0)
    short = low.isNotNull() & (years < low)
    have = F.concat(F.lit(" (Candidate has "), X.plain_number(years), F.lit(" yr"))
    tail = F.concat(F.lit(" experience"), have, F.lit(", deficit: -"), X.plain_number(gap),
                    F.lit(" yrs)"))
    # Message formats are fixed values.
    concern = F.when(short, (
        F.when(gap >= 4, F.concat(F.lit("❌ CRITICAL BLOCKER: JD requires "), asked, tail))
        .when(gap >= 2, F.concat(F.lit("⚠ HARD REQ MISMATCH: JD requires "), asked, tail))
        .when(gap >= 1, F.concat(F.lit("⚠ Experience Deficit: JD asks for "), asked, have,
                                 F.lit(")")))
        .otherwise(F.concat(F.lit("ℹ Minor experience gap: JD asks for "), asked))))
    level_concern = F.when(mismatch, F.concat(
        F.lit("❌ SENIORITY MISMATCH: Role is "), F.initcap(req["seniority"]),
        F.lit(" level (Candidate has "), years.cast("string"), F.lit(" yr experience)")))

    def by_gap(*points):
        return (F.when(gap >= 4, F.lit(points[0])).when(gap >= 2, F.lit(points[1]))
                .when(gap >= 1, F.lit(points[2])).otherwise(F.lit(points[3])))

    unstated = (F.when(_is_senior(req), F.lit(4.0))
                .when(req["seniority"] == "SENIOR", F.lit(8.0)).otherwise(F.lit(18.0)))
    score = (F.when(low.isNull(), unstated).when(~short, F.lit(20.0))
             .otherwise(by_gap(0.0, 4.0, 10.0, 15.0)))
    penalty = (F.when(mismatch, F.lit(25.0)).otherwise(F.lit(0.0))
               + F.when(short, by_gap(35.0, 20.0, 10.0, 4.0)).otherwise(F.lit(0.0)))
    return F.struct(score.alias("score"), penalty.alias("penalty"),
                    F.array_compact(F.array(level_concern, concern)).alias("concerns"))


def title_gate(title: Column, p: Column) -> Column:
    """{penalty, concerns}: first cloud named in the title that the candidate lacks."""
    low = F.lower(F.coalesce(title, F.lit("")))

    def lacks(cloud):
        return low.contains(cloud) & ~F.exists(p["clouds"], lambda owned: owned.contains(cloud))

    lacking = F.coalesce(*[F.when(lacks(c), F.lit(c.upper())) for c in ("azure", "aws", "gcp")])
    concern = F.concat(F.lit("❌ Primary Platform Missing: Title requires "), lacking,
                       F.lit(" (Not in candidate cloud stack)"))
    return F.struct(F.when(lacking.isNotNull(), 20.0).otherwise(0.0).alias("penalty"),
                    F.array_compact(F.array(concern)).alias("concerns"))


def responsibilities_score(req: Column) -> Column:
    return (F.when(req["domain"] == "cloud_devops", 14.0)
            .when(req["domain"] == "data_ai", 8.0).otherwise(4.0))


def education_score(p: Column) -> Column:
    return F.when(p["has_education"], 5.0).otherwise(3.0)


def degree_gate(req: Column, p: Column) -> Column:
    """{penalty, concerns}."""
    lacks = req["degree_required"] & ~p["has_education"]
    return F.struct(
        F.when(lacks, 5.0).otherwise(0.0).alias("penalty"),
        F.array_compact(F.array(F.when(lacks, F.lit("⚠ Job specifies a degree requirement"))))
        .alias("concerns"))


def certifications_score(p: Column) -> Column:
    return F.when(p["has_certifications"], 5.0).otherwise(2.0)


def keywords_score(matched: Column) -> Column:
    return F.least(F.lit(5.0), F.bround(F.size(matched) * F.lit(0.8), 1))


def location_score(location: Column, p: Column) -> Column:
    here = F.lower(F.coalesce(location, F.lit("")))
    fits = here.contains(p["location"]) | here.contains("india") | here.contains("remote")
    return F.when((p["location"] == "") | (here == "") | fits, 5.0).otherwise(2.0)


def fit_score(req: Column, p: Column, matched: Column, work_mode: Column) -> Column:
    years, low, level = p["years"], req["min_years"], req["seniority"]
    new_here = years < 2.0
    seniority = (
        F.when(_is_senior(req), F.when(years < 3.0, 0.0).otherwise(25.0))
        .when(level == "SENIOR", F.when(years < 3.0, 8.0).otherwise(30.0))
        .when(level.isin("ENTRY", "ASSOCIATE"), 35.0)
        .when((low >= 5.0) & new_here, 5.0)
        .when((low >= 3.0) & new_here, 15.0)
        .otherwise(30.0))
    domain = (F.when(req["domain"] == "cloud_devops", 35.0)
              .when(req["domain"] == "data_ai", 15.0).otherwise(5.0))
    core = F.filter(matched, lambda s: F.lower(s).isin(vocab.CORE_STACK))
    stack = F.least(F.lit(20.0), F.bround(F.size(core) * F.lit(3.5), 1))
    mode = F.lower(F.coalesce(work_mode, F.lit("")))
    comfort = F.when(mode.contains("remote"), 10.0).when(mode.contains("hybrid"), 8.0).otherwise(6.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(
        seniority + domain + stack + comfort, 1)))


def priority(ats: Column, fit: Column, concerns: Column, experience_concerns: Column) -> Column:
    blocked = F.exists(concerns, lambda c: X.contains_any(
        c, ["CRITICAL", "SENIORITY MISMATCH", "HARD REQ MISMATCH"]))
    return (F.when(blocked | (ats < 60) | (fit < 50), "LOW")
            .when((ats >= 78) & (fit >= 75) & (F.size(experience_concerns) == 0), "HIGH")
            .when((ats >= 65) | (fit >= 60), "MEDIUM")
            .otherwise("LOW"))


def breakdown(parts: dict, raw, penalty, concerns, ats, fit, level) -> Column:
    return F.struct(
        *[F.struct(parts[name].alias("score"), F.lit(most).alias("max")).alias(name)
          for name, most in COMPONENTS.items()],
        raw.alias("raw_ats"),
        F.struct(penalty.alias("total"), concerns.alias("reasons")).alias("penalties"),
        ats.alias("final_ats"), fit.alias("fit_score"), level.alias("priority"))

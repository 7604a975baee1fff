"""Profiles: defaults, the active one, the latest per candidate, and profiles from resumes."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import resume as R
from ..functions import text as X
from ..schema import PROFILE


def _literal(value) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast("array<string>")
    return F.lit(value)


def with_defaults(profiles: DataFrame, defaults: dict = vocab.PROFILE_DEFAULTS) -> DataFrame:
    """The ten profile fields, nulls and missing columns filled with defaults."""
    filled = {}
    for field in PROFILE.fields:
        default = _literal(defaults[field.name]).cast(field.dataType)
        given = field.name in profiles.columns
        filled[field.name] = F.coalesce(F.col(field.name), default) if given else default
    return profiles.withColumns(filled)


def default_profile(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(*[
        _literal(vocab.DEFAULT_PROFILE[f.name]).cast(f.dataType).alias(f.name)
        for f in PROFILE.fields])


def active_profile(spark: SparkSession, stored: DataFrame | None = None) -> DataFrame:
    """One row: the stored profile (latest `updated_at`), else the default one."""
    if stored is None:
        return default_profile(spark)
    newest = (stored.orderBy(F.desc("updated_at")).limit(1)
              if "updated_at" in stored.columns else stored.limit(1))
    chosen = with_defaults(newest).select(*PROFILE.names, F.lit(0).alias("_rank"))
    fallback = default_profile(spark).withColumn("_rank", F.lit(1))
    return chosen.unionByName(fallback).orderBy("_rank").limit(1).drop("_rank")


def latest(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last write per key. An aggregate rather than a window: one row per key leaves each task."""
    rest = [c for c in updates.columns if c not in (key, *order)]
    return (updates.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("row"))
            .select(key, "row.*"))


def or_default(people: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Each person's stored profile, or the default profile when none is stored."""
    marked = with_defaults(stored).select(key, *PROFILE.names, F.lit(True).alias("_stored"))
    joined = people.join(marked, key, "left")
    return joined.select(
        *people.columns,
        *[F.when(F.col("_stored"), F.col(f.name))
          .otherwise(_literal(vocab.DEFAULT_PROFILE[f.name]).cast(f.dataType)).alias(f.name)
          for f in PROFILE.fields])


def from_forms(forms: DataFrame) -> DataFrame:
    """Comma-separated form fields (<name>_csv) -> array fields, then defaults."""
    arrays = {"skills_csv": "skills", "clouds_csv": "cloud_platforms",
              "certifications_csv": "certifications", "education_csv": "education"}
    out = forms.withColumns({to: X.csv_items(F.col(c)) for c, to in arrays.items()})
    return with_defaults(out.drop(*arrays))


def from_resumes(resumes: DataFrame) -> DataFrame:
    """Resume rows (resume_id, file_name, resume_text) -> profile fields by rule. Blank resumes
    are rejected. Narrow."""
    staged = (resumes.where(X.strip(F.col("resume_text")) != "")
              .withColumn("_low", F.lower("resume_text")))
    text, low = F.col("resume_text"), F.col("_low")
    return staged.select(
        "resume_id",
        R.file_stem(F.col("file_name")).alias("candidate_name"),
        _literal(vocab.PROFILE_DEFAULTS["target_roles"]).alias("target_roles"),
        R.years(low).alias("years_experience"),
        F.lit(vocab.PROFILE_DEFAULTS["location"]).alias("location"),
        R.skills(low).alias("skills"),
        R.clouds(low).alias("cloud_platforms"),
        R.certifications(low).alias("certifications"),
        R.education(low).alias("education"),
        R.summary(text).alias("summary"),
        text.alias("raw_text"),
    )


def from_replies(resumes: DataFrame, replies: DataFrame) -> DataFrame:
    """Profiles from stored model replies (resume_id, reply): skills and clouds fall back to the
    rules when the reply has none, other missing fields to defaults; without a usable reply the
    whole profile comes from the rules."""
    parsed = replies.select("resume_id", F.from_json("reply", PROFILE).alias("reply"))
    parsed = parsed.where(F.exists(F.array(*[F.col(f"reply.{n}").isNotNull()
                                             for n in PROFILE.names]), lambda x: x))
    joined = from_resumes(resumes).join(parsed, "resume_id", "left")
    replied = F.col("reply").isNotNull()

    def pick(field):
        rule, said = F.col(field.name), F.col(f"reply.{field.name}")
        if field.name == "raw_text":
            return rule
        if field.name in ("skills", "cloud_platforms"):
            return F.when(replied & (F.size(said) > 0), said).otherwise(rule)
        default = _literal(vocab.PROFILE_DEFAULTS[field.name]).cast(field.dataType)
        return F.when(replied, F.coalesce(said, default)).otherwise(rule)

    return joined.select("resume_id", *[pick(f).alias(f.name) for f in PROFILE.fields])

"""Table schemas."""

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

_component = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("max", T.IntegerType()),
])

# Component name -> points at most, in display order.
COMPONENTS = {
    "skills": 35, "experience": 20, "responsibilities": 15, "cloud_platform": 10,
    "education": 5, "certifications": 5, "ats_keywords": 5, "location": 5,
}

BREAKDOWN = T.StructType(
    [T.StructField(name, _component) for name in COMPONENTS]
    + [
        T.StructField("raw_ats", T.DoubleType()),
        T.StructField("penalties", T.StructType([
            T.StructField("total", T.DoubleType()),
            T.StructField("reasons", STRINGS),
        ])),
        T.StructField("final_ats", T.DoubleType()),
        T.StructField("fit_score", T.DoubleType()),
        T.StructField("priority", T.StringType()),
    ]
)

POSTING = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("posting_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("posted_at", T.StringType()),
    T.StructField("employment_type", T.StringType()),
    T.StructField("experience_level", T.StringType()),
    T.StructField("work_mode", T.StringType()),
    T.StructField("salary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
    T.StructField("is_reposted", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("dedup_key", T.StringType()),
    T.StructField("ats_score", T.DoubleType()),
    T.StructField("fit_score", T.DoubleType()),
    T.StructField("priority", T.StringType()),
    T.StructField("matched_skills", STRINGS),
    T.StructField("missing_skills", STRINGS),
    T.StructField("hard_req_concerns", STRINGS),
    T.StructField("score_breakdown", BREAKDOWN),
    T.StructField("ai_analysis", T.StringType()),
    T.StructField("required_experience", T.DoubleType()),
    T.StructField("seniority", T.StringType()),
])

# The narrow column set the scorer reads.
SCORING_COLUMNS = ["id", "posting_id", "title", "company", "location", "url", "is_reposted",
                   "posted_at", "experience_level", "work_mode", "description"]

# Columns a score run overwrites.
SCORE_COLUMNS = ["ats_score", "fit_score", "priority", "matched_skills", "missing_skills",
                 "hard_req_concerns", "score_breakdown", "ai_analysis", "required_experience",
                 "seniority"]

PROFILE = T.StructType([
    T.StructField("candidate_name", T.StringType()),
    T.StructField("target_roles", STRINGS),
    T.StructField("years_experience", T.DoubleType()),
    T.StructField("location", T.StringType()),
    T.StructField("skills", STRINGS),
    T.StructField("cloud_platforms", STRINGS),
    T.StructField("certifications", STRINGS),
    T.StructField("education", STRINGS),
    T.StructField("summary", T.StringType()),
    T.StructField("raw_text", T.StringType()),
])

# Stored model reply about a posting: only the parts that are used.
FIT_REPLY = T.StructType([
    T.StructField("key_strengths", STRINGS),
    T.StructField("critical_gaps", STRINGS),
    T.StructField("interview_tips", T.StringType()),
])

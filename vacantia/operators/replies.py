"""Stored model replies about postings, and the requests they answer. No model is called here."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..schema import FIT_REPLY

# How much of each text a request carries (fixed values).
REQUEST_SKILLS, REQUEST_POSTING, REQUEST_RESUME, MIN_DESCRIPTION = 25, 3000, 4000, 100


def unfenced(reply: Column) -> Column:
    """Reply without a surrounding code fence."""
    body = X.strip(reply)
    opened = F.regexp_replace(body, r"^```[^\n]*(\n|$)", "")
    closed = F.regexp_replace(opened, r"(^|\n)```[^\n]*$", "")
    return F.when(body.startswith("```"), X.strip(closed)).otherwise(body)


def parse(replies: DataFrame) -> DataFrame:
    """Adds struct `answer`; null when the reply is missing or not a JSON object."""
    body = unfenced(F.col("reply"))
    return replies.withColumn("answer", F.when(body.startswith("{"),
                                               F.from_json(body, FIT_REPLY)))


def analysis(answer: Column) -> Column:
    """Strengths, gaps and tip as paragraphs; blank parts are left out."""
    def part(label, text):
        return F.when(text != "", F.concat(F.lit(f"**{label}:** "), text))

    return F.concat_ws(
        "\n\n",
        part("Strengths", F.array_join(answer["key_strengths"], ", ")),
        part("Critical Gaps", F.array_join(answer["critical_gaps"], ", ")),
        part("Action Tip", answer["interview_tips"]))


def apply_replies(scored: DataFrame, replies: DataFrame) -> DataFrame:
    """Fills `ai_analysis` from stored replies (id, reply) for postings with enough text."""
    texts = parse(replies).select("id", analysis(F.col("answer")).alias("_analysis"))
    enough = F.length("description") > MIN_DESCRIPTION
    return (scored.join(texts, "id", "left")
            .withColumn("ai_analysis", F.when(enough, F.coalesce("_analysis", F.lit("")))
                        .otherwise(F.lit(""))).drop("_analysis"))


def fit_request(title: Column, company: Column, description: Column, profile: dict) -> Column:
    """Request text about one posting for a profile."""
    who = "\n".join([
        f"Years: {profile['years_experience']}",
        f"Skills: {', '.join(profile['skills'][:REQUEST_SKILLS])}",
        f"Clouds: {', '.join(profile['cloud_platforms'])}",
        f"Certificates: {', '.join(profile['certifications'])}",
        f"Place: {profile['location']}",
    ])
    ask = ("Answer with one JSON object: key_strengths (list), critical_gaps (list), "
           "interview_tips (one sentence).")
    return F.concat(
        F.lit(f"How well does this person fit the posting?\n{who}\nTitle: "),
        F.coalesce(title, F.lit("")), F.lit("\nCompany: "), F.coalesce(company, F.lit("")),
        F.lit("\nPosting:\n"), F.substring(description, 1, REQUEST_POSTING), F.lit(f"\n{ask}"))


def resume_request(resume_text: Column) -> Column:
    ask = ("Read the resume and answer with one JSON object: candidate_name, target_roles, "
           "years_experience, location, skills, cloud_platforms, certifications, education, "
           "summary.\nResume:\n")
    return F.concat(F.lit(ask), F.substring(resume_text, 1, REQUEST_RESUME))


def fit_requests(postings: DataFrame, profile: dict) -> DataFrame:
    """One request per posting whose description is long enough."""
    return postings.where(F.length("description") > MIN_DESCRIPTION).select(
        "id", fit_request(F.col("title"), F.col("company"), F.col("description"), profile)
        .alias("request"))

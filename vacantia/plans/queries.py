"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame.

Arrays come back joined by '|', times as epoch seconds, so that results compare as plain values.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import extract as E
from ..functions import html as H
from ..functions import resume as R
from ..functions import scoring as S
from ..functions import text as X
from ..functions.similarity import title_similarity as similarity
from ..operators import dedup, feed, pages, profiles, replies, score, stats, upsert
from ..schema import COMPONENTS, PROFILE
from ..session import cut_lineage, new_folder
from ..sources import tables
from ..sources.adapter import Tables
from ..sources.store import stored_scores
from ..streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn):
    """Registers fn(tables) under its name."""
    _REGISTRY[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def joined(items) -> Column:
    return F.array_join(items, "|")


# Shared inputs ------------------------------------------------------------------------------


def _profile(t: Tables) -> DataFrame:
    return profiles.default_profile(t.spark)


def _lowered(t: Tables) -> DataFrame:
    return t.postings().withColumn("_low", F.lower(E.full_text(F.col("title"),
                                                               F.col("description"))))


def _analysed(t: Tables) -> DataFrame:
    return E.with_requirements(t.postings())


def _against_profile(t: Tables) -> DataFrame:
    """Postings with `req` and the active profile `p`."""
    return score.with_active_profile(_analysed(t), _profile(t))


def _scored(t: Tables) -> DataFrame:
    return score.score_postings(t.postings(), _profile(t))


def _stored(t: Tables) -> DataFrame:
    """Stands for the stored table a batch merges into, so it is written once."""
    return cut_lineage(dedup.dedup_exact(t.postings()))


def _candidates(t: Tables) -> DataFrame:
    """What the scorer sees of candidates. They are spread while they are narrow: a file of a few MB, which
    one task reads, holds very many."""
    return profiles.from_forms(t.candidate_forms().repartition("candidate_id")).select(
        "candidate_id", *score.SCORER_FIELDS)


def _cards(t: Tables) -> DataFrame:
    return pages.cards(t.list_pages())


def _resolved(t: Tables) -> DataFrame:
    return upsert.resolve(t.incoming(), _stored(t), fuzzy=False)


# Scans, sources, sinks ----------------------------------------------------------------------


@query
def scan_decode_json(t):
    return tables.decoded_json(t.json_postings()).select(
        "id", joined("matched_skills").alias("matched"),
        F.size("missing_skills").cast("bigint").alias("n_missing"),
        F.col("score_breakdown.raw_ats").alias("raw_ats"),
        F.col("score_breakdown.skills.score").alias("skills_score"),
        F.col("score_breakdown.skills.max").alias("skills_max"))


@query
def scan_projected(t):
    return tables.scoring_scan(t.postings())


@query
def lookup_by_id(t):
    # The view's id is the stored doc_id + 1.
    return tables.by_id(t.json_postings("d.doc_id = 41"), 42).select(
        "id", "title", "company", joined("matched_skills").alias("matched"),
        joined("missing_skills").alias("missing"))


@query
def profile_or_default(t):
    people = t.candidate_forms().select("candidate_id", F.col("candidate_name").alias("person"))
    saved = profiles.latest(t.profile_saves(), "candidate_id", ["updated_at", "event_id"])
    return profiles.or_default(people, saved, "candidate_id").select(
        "candidate_id", "person", "candidate_name", "years_experience", "location", "summary",
        joined("skills").alias("skills"), joined("target_roles").alias("target_roles"))


@query
def profile_latest(t):
    return profiles.latest(t.profile_saves(), "candidate_id", ["updated_at", "event_id"]).select(
        "candidate_id", "event_id", "years_experience", "location", "summary")


@query
def schema_evolve_defaults(t):
    old = t.postings().drop("is_reposted")
    return tables.grown(old).select("id", "title", "required_experience", "seniority",
                                    "is_reposted", "dedup_key")


@query
def decode_resume_bytes(t):
    encoded = t.raw("documents").select("doc_id", F.when(
        (F.col("doc_id") % 2 == 0) | ~F.col("text").rlike(r"^[\x00-\xff]*$"),
        F.encode("text", "UTF-8")).otherwise(F.encode(
            F.regexp_replace("text", r"[^\x00-\xff]", ""), "ISO-8859-1")).alias("content"))
    return encoded.select("doc_id", R.decoded(F.col("content")).alias("resume_text"))


@query
def html_cards(t):
    return _cards(t)


@query
def html_cards_rendered(t):
    return pages.cards(t.rendered_pages(), template=H.RENDERED).select(
        "page", "posting_id", "title", "company", "location", "url")


@query
def html_detail(t):
    return pages.details(t.detail_pages()).select(
        "page_id", "title", "company", "location", "description", "experience_level",
        "employment_type", "work_mode", "salary", "is_reposted")


@query
def upsert_insert_rows(t):
    stored = _stored(t)
    fresh = upsert.inserts(upsert.resolve(t.incoming(), stored, fuzzy=False), stored)
    return fresh.select(
        "id", "posting_id", "title", "company", "location", "url", "posted_at", "employment_type",
        "experience_level", "work_mode", "salary", "description", "is_reposted", "dedup_key",
        "status", "ats_score", "fit_score", "priority", "seniority",
        joined("matched_skills").alias("matched"))


@query
def apply_scores(t):
    stored = t.postings().withColumns({
        "ats_score": F.lit(0.0), "fit_score": F.lit(0.0), "priority": F.lit("MEDIUM"),
        "matched_skills": F.array().cast("array<string>"),
        "required_experience": F.lit(9.0), "seniority": F.lit("old")})
    scores = _scored(t).where(F.col("priority") != "LOW")
    return upsert.apply_scores(stored, scores).select(
        "id", "ats_score", "fit_score", "priority", joined("matched_skills").alias("matched"),
        "required_experience", "seniority")


@query
def ingest_run_log(t):
    log = upsert.run_log(_resolved(t), F.current_timestamp(), "keywords")
    return log.select("keywords", F.lit("India").alias("location"), "jobs_found", "new_jobs")


# Feed filters -------------------------------------------------------------------------------


def _feed_ids(df, *columns):
    return df.select("id", *columns)


@query
def feed_exp_cap_strict(t):
    return _feed_ids(feed.filtered(_scored(t), max_exp=3.0), "title", "required_experience")


@query
def feed_exp_cap_loose(t):
    return _feed_ids(feed.filtered(_scored(t), max_exp=5.0), "title", "required_experience")


@query
def feed_no_cap(t):
    return _feed_ids(feed.filtered(_scored(t), max_exp=0), "title", "required_experience")


@query
def feed_min_scores(t):
    return _feed_ids(feed.filtered(_scored(t), max_exp=None, min_ats=60, min_fit=70),
                     "ats_score", "fit_score")


@query
def feed_priority(t):
    return _feed_ids(feed.filtered(_scored(t), max_exp=None, priority="medium"), "priority")


@query
def feed_work_mode(t):
    return _feed_ids(feed.filtered(t.postings(), max_exp=None, work_mode="REMOTE"), "work_mode")


@query
def feed_exp_level(t):
    return _feed_ids(feed.filtered(t.postings(), max_exp=None, experience_level="senior"),
                     "experience_level")


@query
def feed_status_tab(t):
    tabs = F.array_compact(F.array(
        *[F.when(feed.in_tab(tab), F.lit(tab)) for tab in ("new", "saved")], F.lit("all")))
    return t.postings().select(F.explode(tabs).alias("tab"), "id", "status")


@query
def feed_keyword(t):
    return _feed_ids(feed.filtered(t.postings(), max_exp=None, keyword="Terraform"), "title")


@query
def feed_location(t):
    return _feed_ids(feed.filtered(t.postings(), max_exp=None, location="HYDERABAD"), "location")


@query
def feed_combined(t):
    # Filters on stored columns come before scoring, filters on scores after it.
    rows = feed.filtered(t.postings(), max_exp=None, work_mode="remote", status="new",
                         keyword="engineer", location="india")
    scored = score.score_postings(rows, _profile(t))
    return _feed_ids(feed.filtered(scored, max_exp=6, min_ats=40), "ats_score", "fit_score",
                     "priority")


@query
def feed_total(t):
    rows = feed.before_scoring(t.postings(), max_exp=3.0, status="new")
    return feed.total(score.score_postings(rows, _profile(t)), max_exp=3.0)


@query
def feed_page(t):
    return feed.feed(_scored(t), max_exp=None, limit=25, offset=50).select(
        "id", "priority", "ats_score", "fit_score")


@query
def feed_page_stored(t):
    """A page far down, from a store of scored postings."""
    store = stored_scores(_scored(t), new_folder(t.spark, "store"))
    return store.page("ats_desc", limit=25, offset=700).select("rank", "id", "ats_score", "fit_score", "title")


@query
def feed_tab_stored(t):
    store = stored_scores(_scored(t), new_folder(t.spark, "store"))
    return store.page("priority_desc", limit=40, offset=20, tab="Saved").select(
        "rank", "id", "priority", "ats_score", "fit_score")


@query
def lookup_stored(t):
    """Stored postings that every fiftieth row of a later crawl names, scores included."""
    store = stored_scores(_scored(t), new_folder(t.spark, "store"))
    return store.by_posting_ids(t.incoming().where("seq % 50 = 0")).select(
        "id", "posting_id", "title", "priority", "ats_score", "fit_score")


@query
def feed_unknown_sort(t):
    rows = feed.feed(_scored(t), max_exp=None, sort_by="no such order", limit=25)
    return feed.ranked(rows, "no such order", 0).select("rank", "id", "priority")


@query
def feed_page_count(t):
    rows = feed.before_scoring(t.postings(), max_exp=3.0)
    return feed.page_count(score.score_postings(rows, _profile(t)), 25, max_exp=3.0)


@query
def feed_rank(t):
    rows = feed.feed(_scored(t), max_exp=None, sort_by="ats_desc", limit=50, offset=25)
    return feed.ranked(rows, "ats_desc", 25).select("rank", "id", "ats_score")


def _sorted_page(t, sort_by):
    rows = feed.feed(_scored(t), max_exp=None, sort_by=sort_by)
    return feed.ranked(rows, sort_by, 0).select("rank", "id", "ats_score", "fit_score", "priority")


@query
def sort_priority_desc(t):
    return _sorted_page(t, "priority_desc")


@query
def sort_ats_desc(t):
    return _sorted_page(t, "ats_desc")


@query
def sort_fit_desc(t):
    return _sorted_page(t, "fit_desc")


@query
def sort_date_desc(t):
    return _sorted_page(t, "date_desc")


@query
def feed_exit_flag(t):
    tabs = t.postings().select("id", F.coalesce("status", F.lit("new")).alias("tab"))
    changed = t.status_events().withColumn("status", F.lower("status")).join(tabs, "id")
    return changed.select("event_id", "id", "tab", "status", feed.leaves_tab(
        F.col("tab"), F.col("status")).cast("int").alias("leaves"))


@query
def repost_flag(t):
    return t.postings().select("id", X.repost_flag(
        F.col("is_reposted"), F.col("posted_at"), F.col("description")).alias("is_reposted"))


@query
def repost_display(t):
    return t.postings().select("id", X.repost_shown(
        F.col("is_reposted"), F.col("posted_at")).cast("int").alias("shown"))


@query
def search_recency(t):
    return feed.recent(t.postings(), "r604800").select(
        "id", F.unix_timestamp("scraped_at").alias("scraped"))


@query
def search_work_type(t):
    return feed.in_work_type(t.postings(), "2").select("id", "work_mode")


@query
def search_roles_topn(t):
    return feed.search_roles(t.postings(), vocab.PRESET_ROLES, max_pages=2).select(
        "role", F.col("role_rank").cast("bigint").alias("role_rank"), "id")


@query
def roles_union_all(t):
    roles = feed.roles_to_search(["DevOps Engineer", "Cloud Engineer", "Engineer"], None)
    return feed.search_roles(t.postings(), roles, max_pages=4).select("role", "id")


# Scores -------------------------------------------------------------------------------------


@query
def score_postings(t):
    return _scored(t).select(
        "id", "ats_score", "fit_score", "priority", "required_experience", "seniority",
        joined("matched_skills").alias("matched"), joined("missing_skills").alias("missing"),
        joined("hard_req_concerns").alias("concerns"))


@query
def score_breakdown(t):
    b = F.col("score_breakdown")
    return _scored(t).select(
        "id", *[b[n]["score"].alias(n) for n in COMPONENTS],
        *[b[n]["max"].alias(f"{n}_max") for n in COMPONENTS], b["raw_ats"].alias("raw_ats"),
        b["penalties"]["total"].alias("penalty"), joined(b["penalties"]["reasons"]).alias("reasons"),
        b["final_ats"].alias("final_ats"), b["fit_score"].alias("fit"), b["priority"].alias("priority"))


@query
def skills_match(t):
    return _against_profile(t).select("id", joined(S.matched_skills(
        F.col("req"), F.col("p"))).alias("matched"))


@query
def skills_missing(t):
    return _against_profile(t).select("id", joined(S.missing_skills(
        F.col("req"), F.col("p"))).alias("missing"))


@query
def score_skills(t):
    return _against_profile(t).select("id", S.skills_score(F.col("req"), F.col("p")).alias("score"))


@query
def score_cloud(t):
    return _against_profile(t).select("id", S.cloud_score(F.col("req"), F.col("p")).alias("score"))


@query
def score_experience(t):
    df = _against_profile(t).select("id", S.experience(F.col("req"), F.col("p")).alias("e"))
    return df.select("id", F.col("e.score").alias("score"), F.col("e.penalty").alias("penalty"),
                     joined("e.concerns").alias("concerns"))


@query
def score_fit(t):
    req, p = F.col("req"), F.col("p")
    return _against_profile(t).select("id", S.fit_score(
        req, p, S.matched_skills(req, p), F.col("work_mode")).alias("fit"))


@query
def score_title_gate(t):
    df = score.with_active_profile(t.postings(), _profile(t)).select(
        "id", S.title_gate(F.col("title"), F.col("p")).alias("g"))
    return df.select("id", F.col("g.penalty").alias("penalty"),
                     joined("g.concerns").alias("concerns"))


@query
def score_components(t):
    b = F.col("score_breakdown")
    return _scored(t).select("id", *[b[n]["score"].alias(n) for n in (
        "responsibilities", "education", "certifications", "ats_keywords", "location")])


@query
def score_priority(t):
    return _scored(t).select("id", "priority", F.exists("hard_req_concerns", lambda c: X.contains_any(
        c, ["CRITICAL", "SENIORITY MISMATCH", "HARD REQ MISMATCH"])).cast("int").alias("blocked"))


@query
def score_many_candidates(t):
    return score.tally_per_candidate(t.postings(), _candidates(t)).select(
        "candidate_id", "n_high", "n_medium", "n_low", "best_ats", "best_fit")


@query
def topk_per_candidate(t):
    return score.top_per_candidate(t.postings(), _candidates(t), 5).select(
        "candidate_id", F.col("rank").cast("bigint").alias("rank"), "id", "ats_score", "fit_score")


@query
def score_bands(t):
    return _scored(t).groupBy(feed.score_band(F.col("ats_score")).alias("band")).agg(
        F.count("*").alias("postings"))


@query
def skill_chips(t):
    return _scored(t).select(
        "id", joined(F.slice("matched_skills", 1, 10)).alias("matched"),
        joined(F.slice("missing_skills", 1, 8)).alias("missing"),
        joined(F.slice("matched_skills", 1, 6)).alias("summary"))


@query
def csv_to_array(t):
    return t.candidate_forms().select(
        "candidate_id", joined(X.csv_items(F.col("skills_csv"))).alias("skills"),
        F.size(X.csv_items(F.col("skills_csv"))).cast("bigint").alias("n_skills"),
        joined(X.csv_items(F.col("clouds_csv"))).alias("clouds"))


# Extraction ---------------------------------------------------------------------------------


@query
def extract_skills(t):
    return _lowered(t).select("id", joined(E.skills(F.col("_low"))).alias("skills"))


@query
def extract_clouds(t):
    return _lowered(t).select("id", joined(E.clouds(F.col("_low"))).alias("clouds"))


@query
def extract_experience(t):
    df = _lowered(t).select("id", E.required_years(F.col("_low")).alias("y"))
    return df.select("id", F.col("y.lo").alias("min_years"), F.col("y.hi").alias("max_years"),
                     F.coalesce("y.shown", F.lit("")).alias("years_text"))


@query
def extract_seniority(t):
    return t.postings().select("id", E.seniority(F.col("title"), F.col("experience_level"))
                               .alias("seniority"))


@query
def infer_experience(t):
    level = E.seniority(F.col("title"), F.col("experience_level"))
    return t.postings().select("id", E.inferred_years(level).alias("inferred_years"))


@query
def detect_domain(t):
    return _lowered(t).select("id", E.domain(F.col("title"), F.col("_low")).alias("domain"))


@query
def domain_term_counts(t):
    return _lowered(t).select(
        "id", E.term_count(F.col("_low"), vocab.CLOUD_DOMAIN_TERMS).alias("cloud_terms"),
        E.term_count(F.col("_low"), vocab.SOFTWARE_DOMAIN_TERMS).alias("software_terms"))


@query
def degree_required(t):
    return _lowered(t).select("id", E.degree_required(F.col("_low")).cast("int").alias("degree"))


@query
def analyze_postings(t):
    r = F.col("req")
    return _analysed(t).select(
        "id", joined(r["skills"]).alias("skills"), joined(r["clouds"]).alias("clouds"),
        r["min_years"].alias("min_years"), r["max_years"].alias("max_years"),
        r["years_text"].alias("years_text"), r["years_inferred"].cast("int").alias("inferred"),
        r["seniority"].alias("seniority"), r["domain"].alias("domain"),
        r["degree_required"].cast("int").alias("degree"))


@query
def normalize_company(t):
    return t.postings().select("id", X.normalize_company(F.col("company")).alias("company"))


@query
def normalize_title(t):
    return t.postings().select("id", X.normalize_title(F.col("title")).alias("title"))


@query
def dedup_key(t):
    return t.postings().select("id", X.dedup_key(F.col("company"), F.col("title"))
                               .alias("dedup_key"))


@query
def work_mode_detect(t):
    return t.postings().select("id", H.work_mode(
        F.col("title"), F.col("location"), F.col("description")).alias("work_mode"))


# Duplicates and merging ---------------------------------------------------------------------


@query
def merge_locations_pair(t):
    first = t.postings().select("posting_id", "id", F.col("location").alias("kept"))
    pairs = t.incoming().select("posting_id", "location").join(first, "posting_id")
    return pairs.select("id", "kept", "location", X.merge_locations(
        F.col("kept"), F.col("location")).alias("merged"))


@query
def merge_locations(t):
    return dedup.exact_groups(t.postings()).select("leader_id", "copies", "merged_location")


@query
def dedup_status_merge(t):
    return dedup.exact_groups(t.postings()).select("leader_id", "merged_status")


@query
def dedup_exact_key(t):
    return dedup.dedup_exact(t.postings()).select(
        "id", "posting_id", "title", "company", "location", "is_reposted", "status", "description",
        "dedup_key")


@query
def dedup_report(t):
    rows = t.postings()
    return dedup.report(rows, dedup.exact_groups(rows))


@query
def dedup_fuzzy(t):
    return dedup.dedup_fuzzy(t.postings()).select(
        "id", "posting_id", "location", "is_reposted", "status",
        F.length("description").alias("n_chars"), "dedup_key")


@query
def dedup_fuzzy_report(t):
    rows = t.postings()
    return dedup.report(rows, dedup.fuzzy_groups(rows))


@query
def title_similarity(t):
    ours = t.postings().select("posting_id", "id", X.normalize_title(F.col("title")).alias("a"))
    theirs = t.incoming().select("posting_id", X.normalize_title(F.col("title")).alias("b"))
    return ours.join(theirs, "posting_id").select("id", "a", "b", similarity("a", "b")
                                                  .alias("ratio"))


@query
def upsert_match_id(t):
    return upsert.match_by_id(upsert.prepared(t.incoming()), _stored(t)).select("seq", "by_id")


@query
def upsert_match_key(t):
    stored = _stored(t)
    matched = upsert.match_by_id(upsert.prepared(t.incoming()), stored)
    return upsert.match_by_key(matched, stored).select("seq", "by_id", "by_key")


@query
def upsert_match_fuzzy(t):
    return upsert.resolve(t.incoming(), _stored(t)).select("seq", "dedup_key", "target_id", "is_new")


@query
def upsert_resolve_exact(t):
    return _resolved(t).select("seq", "dedup_key", "is_reposted", "target_id",
                               F.col("is_new").cast("int").alias("is_new"))


MERGED = ["id", "posting_id", "title", "company", "location", "url", "posted_at",
          "employment_type", "experience_level", "work_mode", "salary", "description",
          "is_reposted", "status", "dedup_key"]


@query
def upsert_merge_exact(t):
    return upsert.upsert(t.incoming(), _stored(t), fuzzy=False).select(*MERGED)


@query
def upsert_merge_fuzzy(t):
    return upsert.upsert(t.incoming(), _stored(t)).select(*MERGED)


@query
def upsert_merge_drift(t):
    stored = cut_lineage(t.drift_stored())
    return upsert.upsert(t.drift_batch(), stored, fuzzy=False).select(
        "id", "posting_id", "title", "company", "url", "description", "status")


@query
def apply_status(t):
    latest = profiles.latest(t.status_events(), "id", ["ts", "event_id"])
    return upsert.apply_status(t.postings(), latest).select("id", "status")


@query
def status_latest(t):
    return profiles.latest(t.status_events(), "id", ["ts", "event_id"]).select(
        "id", F.lower("status").alias("status"), "event_id")


# Aggregates ---------------------------------------------------------------------------------


@query
def stats_dashboard(t):
    return stats.dashboard(_scored(t))


@query
def stream_figures(t):
    """The dashboard after a crawl was merged, from sums kept by the stream."""
    ids = _stored(t).select("id")
    scored = _scored(t).join(ids, "id", "left_semi")
    return jobs.run_figures_once(t, cut_lineage(scored))


@query
def priority_counts(t):
    return stats.by_priority(_scored(t))


@query
def top5_high(t):
    return stats.top_high(_scored(t)).select("id", "title", "ats_score", "fit_score")


@query
def ingest_role_rollup(t):
    return stats.run_rollup(_resolved(t), "keywords")


# Pages --------------------------------------------------------------------------------------


@query
def cards_first_seen(t):
    return pages.first_seen(_cards(t)).select("search_id", "posting_id", "page", "pos", "title")


@query
def page_yield(t):
    listed = t.list_pages()
    return pages.page_yield(pages.cards(listed), listed).select(
        "search_id", "page", "new_cards", F.col("kept").cast("int").alias("kept"))


@query
def search_cards(t):
    return pages.search_cards(t.list_pages()).select("search_id", "page", "pos", "posting_id", "url")


@query
def posting_id_extract(t):
    return _cards(t).select("page", "pos", "posting_id")


@query
def url_canonical(t):
    return _cards(t).select("page", "pos", "url")


@query
def html_repost(t):
    return pages.details(t.detail_pages()).select("page_id", "is_reposted")


@query
def html_to_text(t):
    return t.detail_pages().select("page_id", H.description(F.col("html")).alias("description"))


@query
def html_nested(t):
    return t.nested_pages().select("page_id", H.description(F.col("html")).alias("description"))


@query
def html_criteria(t):
    return t.detail_pages().select(
        "page_id", H.criteria(F.col("html"), "seniority").alias("experience_level"),
        H.criteria(F.col("html"), "employment", without="seniority").alias("employment_type"))


@query
def salary_extract(t):
    return pages.details(t.detail_pages()).select("page_id", "salary")


# Resumes and replies ------------------------------------------------------------------------


def _resume_field(t, name, column):
    df = t.resumes().withColumn("_low", F.lower("resume_text"))
    return df.select("resume_id", column.alias(name))


@query
def resume_skills(t):
    return _resume_field(t, "skills", joined(R.skills(F.col("_low"))))


@query
def resume_years(t):
    return _resume_field(t, "years", R.years(F.col("_low")))


@query
def resume_clouds(t):
    return _resume_field(t, "clouds", joined(R.clouds(F.col("_low"))))


@query
def resume_certs(t):
    return _resume_field(t, "certifications", joined(R.certifications(F.col("_low"))))


@query
def resume_education(t):
    return _resume_field(t, "education", joined(R.education(F.col("_low"))))


@query
def resume_summary(t):
    return _resume_field(t, "summary", R.summary(F.col("resume_text")))


def _flat_profile(df):
    arrays = {f.name for f in PROFILE.fields if f.dataType.simpleString() == "array<string>"}
    return df.select("resume_id", *[joined(n).alias(n) if n in arrays else F.col(n)
                                    for n in PROFILE.names])


@query
def structure_resumes(t):
    return _flat_profile(profiles.from_resumes(t.resumes()))


@query
def profile_reply_or_rules(t):
    return _flat_profile(profiles.from_replies(t.resumes(), t.profile_replies()))


@query
def profile_defaults(t):
    given = t.profile_replies().select(
        "resume_id", F.from_json("reply", PROFILE).alias("r")).select("resume_id", "r.*")
    return _flat_profile(profiles.with_defaults(given))


@query
def profile_json_sink(t):
    """Profiles written as JSON and read back."""
    given = t.profile_replies().select("resume_id", F.from_json("reply", PROFILE).alias("r")).select("resume_id", "r.*")
    folder = new_folder(t.spark, "profiles")
    tables.write_profiles(profiles.with_defaults(given), folder)
    return _flat_profile(tables.read_profiles(t.spark, folder, "resume_id long"))


@query
def any_contains(t):
    return t.candidate_forms().select("candidate_id", X.any_contains(
        X.csv_items(F.lower("skills_csv")), F.lit("python")).alias("has_python"))


@query
def model_reply_parse(t):
    return replies.parse(t.fit_replies()).select(
        "id", joined("answer.key_strengths").alias("strengths"),
        joined("answer.critical_gaps").alias("gaps"),
        F.col("answer.interview_tips").alias("tips"))


@query
def ai_analysis_compose(t):
    return replies.apply_replies(t.postings(), t.fit_replies()).select("id", "ai_analysis")


@query
def prompt_build(t):
    return replies.fit_requests(t.postings(), vocab.DEFAULT_PROFILE)


# Streams ------------------------------------------------------------------------------------


@query
def stream_upsert(t):
    return jobs.run_upsert_once(t, fuzzy=False).select(*MERGED)


@query
def stream_upsert_fuzzy(t):
    return jobs.run_upsert_once(t).select(*MERGED)


@query
def stream_status_latest(t):
    return jobs.run_status_once(t).select("id", "status", "event_id")


@query
def stream_first_seen(t):
    return jobs.run_first_seen_once(t).select("id")


@query
def stream_run_log(t):
    return jobs.run_log_once(t).select("keywords", "jobs_found", "new_jobs")

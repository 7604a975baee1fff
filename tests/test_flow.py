"""The whole flow over the hand-worked postings: ingest, score, feed, merge, figures."""

import pytest
from pyspark.sql import functions as F

from vacantia.operators import feed, stats, upsert
from vacantia.operators.profiles import default_profile
from vacantia.operators.score import score_postings

from .fixtures import DUPLICATE, POSTINGS, batch, empty_store

TRAINEE, JAVA, LEAD, DESK = (p[0] for p in POSTINGS)


@pytest.fixture(scope="module")
def stored(spark):
    fresh = upsert.upsert(batch(spark, POSTINGS), empty_store(spark))
    scored = score_postings(fresh, default_profile(spark))
    return upsert.apply_scores(fresh, scored).cache()


@pytest.fixture(scope="module")
def rows(stored):
    return {r.posting_id: r for r in stored.collect()}


def test_ingest(rows):
    assert {p: r.id for p, r in rows.items()} == {TRAINEE: 1, JAVA: 2, LEAD: 3, DESK: 4}
    assert rows[TRAINEE].dedup_key == "harbourlights:platformtrainee"
    assert rows[LEAD].dedup_key == "nightowlfreight:leaddataengineer"
    assert [rows[p].is_reposted for p in (TRAINEE, JAVA, LEAD, DESK)] == [0, 0, 0, 1]
    assert all(r.status == "new" for r in rows.values())


def test_skills(rows):
    assert rows[TRAINEE].matched_skills == ["Azure", "Docker", "Terraform", "Linux"]
    assert rows[JAVA].matched_skills == ["AWS"]
    assert rows[JAVA].missing_skills == ["PostgreSQL", "Kafka", "Java"]
    assert rows[DESK].missing_skills == []


@pytest.mark.parametrize("key, ats, fit, priority, years, seniority", [
    (TRAINEE, 97.2, 92.0, "HIGH", 1.0, "ENTRY"),
    (JAVA, 3.6, 22.5, "LOW", 8.0, "SENIOR"),
    (LEAD, 0.0, 28.5, "LOW", 5.0, "LEAD"),
    (DESK, 91.8, 79.5, "HIGH", 0.5, "ENTRY"),
])
def test_scores(rows, key, ats, fit, priority, years, seniority):
    r = rows[key]
    assert (r.ats_score, r.fit_score, r.priority) == (ats, fit, priority)
    assert (r.required_experience, r.seniority) == (years, seniority)


def test_breakdown(rows):
    b = rows[LEAD].score_breakdown
    # Two of three skills are known: 35 * 2 / 3; 47.9 less 60 of penalties is clamped.
    assert (b.skills.score, b.skills.max, b.cloud_platform.score, b.ats_keywords.score) == (
        23.3, 35, 0.0, 1.6)
    assert (b.raw_ats, b.penalties.total, b.final_ats) == (47.9, 60.0, 0.0)
    assert [c.split(":")[0] for c in rows[LEAD].hard_req_concerns] == [
        "❌ SENIORITY MISMATCH", "❌ CRITICAL BLOCKER"]
    assert rows[TRAINEE].hard_req_concerns == []


def test_feed(stored):
    def ids(**filters):
        return [r.posting_id for r in feed.feed(stored, **filters).collect()]

    assert ids(max_exp=None) == [TRAINEE, DESK, JAVA, LEAD]
    assert ids() == [TRAINEE, DESK]
    assert ids(priority="high") == [TRAINEE, DESK]
    assert ids(max_exp=0, work_mode="remote") == [LEAD]
    assert ids(max_exp=None, sort_by="fit_desc", limit=2, offset=1) == [DESK, LEAD]
    assert ids(max_exp=None, sort_by="no such order") == [TRAINEE, DESK, JAVA, LEAD]
    assert feed.page_count(stored, 3, max_exp=None).first() == (4, 2)
    assert feed.page_count(stored, 3, keyword="nothing").first() == (0, 1)
    early = feed.before_scoring(stored, max_exp=3.0, status="new", keyword="linux")
    assert sorted(r.posting_id for r in early.collect()) == [TRAINEE, DESK]


def test_deep_page_equals_top_n(stored, monkeypatch):
    for sort_by in ("priority_desc", "fit_desc", "date_desc"):
        rows = stored.withColumn("scraped_at", F.timestamp_seconds(F.col("id") % 2))
        near = feed.feed(rows, sort_by, limit=3, offset=1, max_exp=None).collect()
        with monkeypatch.context() as m:
            m.setattr(feed, "TOP_N", 0)
            assert feed.feed(rows, sort_by, limit=3, offset=1, max_exp=None).collect() == near


def test_duplicate_merges(spark, stored):
    again = batch(spark, [DUPLICATE])
    resolved = upsert.resolve(again, stored).first()
    assert (resolved.target_id, resolved.is_new) == (1, False)
    after = upsert.upsert(again, stored)
    r = after.where("id = 1").first()
    assert r.location == "Pune, India / Kochi"
    assert r.description == POSTINGS[0][-1]
    assert (r.url, r.posted_at, r.posting_id, r.status) == ("u9", "10 minutes ago", TRAINEE, "new")
    assert r.ats_score == 97.2
    figures = stats.dashboard(after).first()
    assert (figures.total, figures.scored, figures.high_priority, figures.count_new) == (4, 3, 2, 4)


def test_same_batch_twice_adds_nothing(spark, stored):
    resolved = upsert.resolve(batch(spark, POSTINGS), stored)
    assert resolved.where("is_new").count() == 0
    assert [r.target_id for r in resolved.orderBy("seq").collect()] == [1, 2, 3, 4]

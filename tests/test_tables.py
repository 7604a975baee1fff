"""Stored tables, profiles and many-candidate scoring."""

import pytest
from pyspark.sql import Window, functions as F

from vacantia.operators import profiles, replies, score, upsert
from vacantia.operators.feed import priority_rank
from vacantia.session import cut_lineage, new_folder
from vacantia.sources import tables

from .fixtures import POSTINGS, batch, empty_store


def test_snapshot_round_trip(spark):
    fresh = upsert.inserts(upsert.resolve(batch(spark, POSTINGS), empty_store(spark)),
                           empty_store(spark)).withColumn("scraped_at", F.lit(None).cast("timestamp"))
    folder = new_folder(spark, "snapshot")
    tables.write_snapshot(fresh, folder)
    back = tables.read_snapshot(spark, folder)
    assert [r.posting_id for r in back.orderBy("id").collect()] == [p[0] for p in POSTINGS]
    text = tables.encoded_json(back)
    assert tables.decoded_json(text).where("id = 1").first().matched_skills == []
    assert tables.by_id(text, 99).count() == 0
    new = tables.read_snapshot(spark, folder, "New")
    assert new.count() == 4 and tables.read_snapshot(spark, folder, "saved").count() == 0
    assert "PartitionFilters: [isnotnull(tab" in new._jdf.queryExecution().executedPlan().toString()


def test_grown_schema(spark):
    old = spark.createDataFrame([(1,)], "id long")
    row = tables.grown(old).first()
    assert (row.required_experience, row.seniority, row.is_reposted, row.dedup_key) == (
        None, "", 0, "")


def test_profiles(spark):
    assert profiles.active_profile(spark).first().years_experience == 1.0
    stored = spark.createDataFrame([(1, "Old", 2.0), (2, "New", None)],
                                   "updated_at long, candidate_name string, years_experience double")
    chosen = profiles.active_profile(spark, stored).first()
    assert (chosen.candidate_name, chosen.years_experience, chosen.skills) == ("New", 1.0, [])
    assert profiles.active_profile(spark, stored.where("false")).first().location == "India"
    folder = new_folder(spark, "profiles")
    tables.write_profiles(profiles.active_profile(spark, stored), folder)
    assert spark.read.json(folder).first().candidate_name == "New"


def test_run_log(spark):
    resolved = upsert.resolve(batch(spark, POSTINGS), empty_store(spark)).withColumn(
        "keywords", F.lit("sre"))
    folder = new_folder(spark, "runs")
    for _ in range(2):
        tables.append_run_log(upsert.run_log(resolved, F.current_timestamp(), "keywords"), folder)
    assert [(r.jobs_found, r.new_jobs) for r in spark.read.parquet(folder).collect()] == [(4, 4)] * 2


def some_profiles(spark, n):
    """n distinct profiles over years, clouds, places and skills."""
    i = F.col("id")
    skills = F.array(F.lit("Azure"), F.lit("Kafka"), F.lit("Docker"), F.lit("Terraform"), F.lit("Linux"))
    people = spark.range(n).select(
        i.alias("candidate_id"), (i % 7).cast("double").alias("years_experience"),
        F.when(i % 3 == 0, "Oslo").when(i % 3 == 1, "").otherwise(F.concat(F.lit("x"), i)).alias("location"),
        F.concat(F.slice(skills, (i % 4 + 1).cast("int"), 2), F.array(F.concat(F.lit("zz"), i))).alias("skills"),
        F.when(i % 2 == 0, F.array(F.lit("Azure"))).otherwise(F.array(F.lit("AWS"))).alias("cloud_platforms"))
    return profiles.with_defaults(people)


@pytest.mark.parametrize("cell", [3, 256])
def test_many_profiles(spark, monkeypatch, cell):
    """Every posting for every profile, as scored one profile after the other."""
    monkeypatch.setattr(score, "CELL", cell)
    people = some_profiles(spark, 9)
    rows = batch(spark, POSTINGS).withColumnRenamed("seq", "id")
    scored = score.score_for_profiles(rows, people).select("profile_key", "id", "ats_score", "fit_score", "priority",
                                                           "hard_req_concerns", "matched_skills")
    got = sorted(score.for_candidates(scored, people).drop("profile_key", *people.columns[1:]).collect())
    want = []
    for k in range(9):
        alone = score.score_postings(rows, people.where(F.col("candidate_id") == k).drop("candidate_id"))
        want += [(k, *r) for r in alone.select("id", "ats_score", "fit_score", "priority", "hard_req_concerns",
                                               "matched_skills").collect()]
    assert [(r.candidate_id, r.id, r.ats_score, r.fit_score, r.priority, r.hard_req_concerns, r.matched_skills)
            for r in got] == sorted(want)


def test_five_thousand_profiles(spark, k=5):
    """The tally and the best postings against a ranking of all pairs; the plan does not grow."""
    people = some_profiles(spark, 5000)
    base = batch(spark, POSTINGS).drop("seq")
    rows = base.crossJoin(spark.range(6).select(F.col("id").alias("n"))).select(
        *[c for c in base.columns if c != "title"],
        F.concat("title", F.when(F.col("n") % 3 == 0, " Azure Lead").when(F.col("n") % 3 == 1, " Junior").otherwise(""))
        .alias("title")).withColumn("id", F.monotonically_increasing_id())
    rows = cut_lineage(rows)
    scored = cut_lineage(score.score_for_profiles(rows, people).select(
        "profile_key", "id", "priority", "ats_score", "fit_score"))
    assert scored.count() == 5000 * rows.count()
    tally = score.profile_tally(rows, people)
    want = scored.groupBy("profile_key").agg(
        F.count_if(F.col("priority") == "HIGH"), F.count_if(F.col("priority") == "MEDIUM"),
        F.count_if(F.col("priority") == "LOW"), F.max("ats_score"), F.max("fit_score"))
    assert sorted(tally.collect()) == sorted(want.collect())
    order = Window.partitionBy("profile_key").orderBy(
        priority_rank(F.col("priority")), F.desc("ats_score"), F.desc("fit_score"), "id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    top = score.top_postings(rows, people, k)
    assert sorted(top.collect()) == sorted(best.select(*top.columns).collect())
    few = score.top_postings(rows, some_profiles(spark, 3), k)
    sizes = [df._jdf.queryExecution().optimizedPlan().toString().count("\n") for df in (top, few)]
    assert sizes[0] == sizes[1]


def test_keys_of_candidates_are_worked_out_once(spark):
    """The last join reads the keys that were written, neither hashing candidates again nor to filter them."""
    people, rows = some_profiles(spark, 12), batch(spark, POSTINGS).withColumnRenamed("seq", "id")
    top, tally = score.top_per_candidate(rows, people, 2), score.tally_per_candidate(rows, people)
    for df in (top, tally):
        assert "sha2" not in df._jdf.queryExecution().optimizedPlan().toString()
    plain = score.for_candidates(score.top_postings(rows, people, 2), people)
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("sha2") == 1
    assert sorted(top.select("candidate_id", "rank", "id").collect()) == sorted(
        plain.select("candidate_id", "rank", "id").collect())


def test_requests(spark):
    rows = batch(spark, POSTINGS).withColumnRenamed("seq", "id")
    asked = replies.fit_requests(rows, {**profiles.vocab.DEFAULT_PROFILE}).collect()
    assert len(asked) == sum(len(p[-1]) > 100 for p in POSTINGS)
    long = spark.range(1).select(replies.resume_request(F.repeat(F.lit("x"), 5000)).alias("r"))
    assert long.first().r.endswith("x" * 4000) and not long.first().r.endswith("x" * 4001)

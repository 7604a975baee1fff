"""Streams over several micro-batches against the batch result."""

from pyspark.sql import functions as F

from vacantia.operators import upsert
from vacantia.session import new_folder
from vacantia.sources.adapter import Tables
from vacantia.streaming import jobs


def staged(spark, df, parts):
    """df as a folder of `parts` files in seq order, read one file per micro-batch."""
    folder = new_folder(spark, "in")
    for i in range(parts):
        df.where(F.col("part") == i).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def batch_rows(spark):
    rows = [(i, f"p{i % 7}", ["acme", "bolt"][i % 7 % 2], f"title{'abcdefg'[i % 7] * 4}",
             ["Pune", "Oslo, NO", ""][i % 3], f"u{i}", "d" * (i % 5), "kw", i // 10)
            for i in range(30)]
    df = spark.createDataFrame(rows, "seq long, posting_id string, company string, title string, "
                                     "location string, url string, description string, "
                                     "keywords string, part long")
    return df.withColumns({c: F.lit("") for c in ("posted_at", "employment_type", "salary",
                                                  "experience_level", "work_mode")})


COLUMNS = ["id", "posting_id", "title", "company", "location", "url", "description", "status"]


def test_upsert_stream(spark):
    df = batch_rows(spark)
    stored = spark.createDataFrame(
        [(1, "p3", "titledddd", "bolt", "Rome", "u", "text", 0, "saved", "bolt:titledddd")],
        "id long, posting_id string, title string, company string, location string, url string, "
        "description string, is_reposted int, status string, dedup_key string")
    home = new_folder(spark, "test")
    log = jobs.PostingLog(spark, f"{home}/log", fold_every=2).start(stored)
    jobs.upsert_stream(staged(spark, df, 3), log, f"{home}/offsets", fuzzy=False,
                       run_log=f"{home}/runs").awaitTermination()
    want = upsert.upsert(df, stored, fuzzy=False).select(*COLUMNS)
    assert sorted(log.current().select(*COLUMNS).collect()) == sorted(want.collect())
    runs = spark.read.parquet(f"{home}/runs").orderBy("batch").collect()
    assert [(r.jobs_found, r.new_jobs) for r in runs] == [(10, 6), (10, 0), (10, 0)]
    folded = spark.read.parquet(f"{home}/log/bases").select("upto").distinct().collect()
    assert sorted(r.upto for r in folded) == [-1, 1]
    compacted = log.compact(f"{home}/compact").current().select(*COLUMNS)
    assert sorted(compacted.collect()) == sorted(want.collect())


def test_fuzzy_stream_does_not_depend_on_batches(spark):
    """Similar titles, moves and repeats in one batch and in three micro-batches."""
    titles = ["devops engineer", "devops engineers", "sr devops engineer", "cloud lead", "cloud leads"]
    rows = [(i, f"p{i * 5 % 11}", ["acme", "bolt"][i % 2], titles[i * 7 % 5], ["Pune", "Oslo, NO", ""][i % 3],
             f"u{i}", "d" * (i % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "seq long, posting_id string, company string, title string, "
                                     "location string, url string, description string")
    df = df.withColumns({c: F.lit("") for c in ("posted_at", "employment_type", "salary", "experience_level",
                                                "work_mode")})
    stored = spark.createDataFrame(
        [(1, "p3", "Devops Engineerr", "acme", "Rome", "u", "text", 0, "saved", "acme:devopsengineerr")],
        "id long, posting_id string, title string, company string, location string, url string, "
        "description string, is_reposted int, status string, dedup_key string")
    want = sorted(upsert.upsert(df, stored).select(*COLUMNS).collect())
    for parts in (3,):
        home = new_folder(spark, "test")
        log = jobs.PostingLog(spark, f"{home}/log").start(stored)
        cut = df.withColumn("part", F.floor(F.col("seq") * parts / 30))
        jobs.upsert_stream(staged(spark, cut, parts), log, f"{home}/offsets").awaitTermination()
        assert sorted(log.current().select(*COLUMNS).collect()) == want


def test_first_seen_keeps_its_ids_as_state(spark):
    """Repeats never come back, even with an earlier time; of a micro-batch the first row counts. What a
    batch reads is its own rows, not what was written before."""
    rows = [(i, i * 7 % 25, f"v{i}", i // 10) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, id long, status string, part long").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("event_id")))
    home = new_folder(spark, "test")
    query = jobs.first_seen_stream(staged(spark, df, 6), f"{home}/seen", f"{home}/offsets")
    query.awaitTermination()
    first = {}
    for r in sorted(df.collect(), key=lambda r: (r.part, r.ts)):
        first.setdefault(r.id, (r.part, r.ts, r.event_id, r.status))
    got = {r.id: (r.batch, r.ts, r.event_id, r.status) for r in spark.read.parquet(f"{home}/seen").collect()}
    assert got == first
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [10] * 6
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 25
    assert any(name.startswith("rocksdb") for name in progress[-1]["stateOperators"][0]["customMetrics"])


def test_status_stream_and_first_seen(spark):
    rows = [(i, i % 4, ["Saved", "APPLIED", "new"][i % 3], i // 6) for i in range(18)]
    df = spark.createDataFrame(rows, "event_id long, id long, status string, part long").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") % 5))
    home = new_folder(spark, "test")
    jobs.status_stream(staged(spark, df, 3), f"{home}/status", f"{home}/o1").awaitTermination()
    got = {r.id: r.status for r in jobs.current_status(spark, f"{home}/status").collect()}
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.ts, r.event_id)):
        want[r.id] = r.status.lower()
    assert got == want
    jobs.first_seen_stream(staged(spark, df, 3), f"{home}/seen", f"{home}/o2").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{home}/seen").collect()) == [0, 1, 2, 3]


def test_run_log_moves_no_texts(spark):
    """The log of a merge without texts is that of the merge with them."""
    t = Tables(spark, "/root/testdata/sf0.001")
    runs = []
    for texts in (True, False):
        log, folder = jobs._upsert_once(t, False, texts)
        runs.append(sorted((r.batch, r.keywords, r.jobs_found, r.new_jobs) for r in spark.read.parquet(folder).collect()))
        assert (log.current().where("description <> ''").count() > 0) == texts
    assert runs[0] == runs[1] and len({r[0] for r in runs[0]}) == jobs.LANDINGS


def test_landings_are_thirds_of_the_batch(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    folder = new_folder(spark, "landed")
    jobs._incoming_stream(t, folder)
    landed = spark.read.parquet(folder).select("seq", F.input_file_name().alias("file"))
    last = t.incoming().agg(F.max("seq")).first()[0]
    spans = sorted((r.low, r.high, r.thirds) for r in landed.groupBy("file").agg(
        F.min("seq").alias("low"), F.max("seq").alias("high"), F.count_distinct(
            F.floor(F.col("seq") * jobs.LANDINGS / (last + 1))).alias("thirds")).collect())
    assert {s[2] for s in spans} == {1} and landed.count() == t.incoming().count()

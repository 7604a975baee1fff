"""The scored store: lookups and pages that read few files, and figures that are kept up to date."""

import pytest
from pyspark.sql import functions as F

from vacantia.operators import feed, stats, upsert
from vacantia.session import new_folder
from vacantia.sources.store import ORDERS, ScoredStore
from vacantia.streaming import jobs

from .test_streams import batch_rows, staged

N = 3000


@pytest.fixture(scope="module")
def scored(spark):
    i = F.col("id")
    return spark.range(N).select(
        i, F.concat(F.lit("p"), F.sha2(i.cast("string"), 256)).alias("posting_id"),
        F.element_at(F.array(*[F.lit(p) for p in ("HIGH", "MEDIUM", "LOW")]), (i * 7 % 3 + 1).cast("int")).alias("priority"),
        (i * 37 % 101).cast("double").alias("ats_score"), (i * 11 % 13).cast("double").alias("fit_score"),
        F.element_at(F.array(F.lit("new"), F.lit("saved"), F.lit(None).cast("string")), (i % 3 + 1).cast("int")).alias("status"),
        F.timestamp_seconds(i * 31 % 997).alias("scraped_at"), F.repeat(F.sha2(i.cast("string"), 512), 4).alias("description"))


@pytest.fixture(scope="module")
def store(spark, scored):
    return ScoredStore(spark, new_folder(spark, "store")).write(scored, rows_per_file=700, group_bytes=64 << 10)


def rows_read(df):
    """Rows that the scan of a plan without a shuffle handed on."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("tab", [None, "Saved", "new"])
def test_pages_at_any_depth(scored, store, order, tab):
    rows = scored if tab is None else scored.where(feed.in_tab(tab))
    every = [r.id for r in rows.orderBy(*feed.sort_order(order)).collect()]
    for offset in (0, 13, 690, 1490, 2980, 5000):
        got = store.page(order, 25, offset, tab).collect()
        assert [r.id for r in got] == every[offset:offset + 25]
        assert [r["rank"] for r in got] == list(range(offset + 1, offset + 1 + len(got)))


def test_a_page_opens_few_files(spark, store):
    files = spark.read.parquet(f"{store.folder}/files/ats_desc").where("tab = 'all'").collect()
    assert len(files) >= 5 and sum(r.n for r in files) == N
    spanned = [r for r in files if r["first"] < 1525 and r["first"] + r.n > 1500]
    assert len(spanned) <= 2


def test_long_texts_are_cut_into_files_by_their_bytes(spark, scored, monkeypatch):
    monkeypatch.setattr("vacantia.sources.store.BYTES_PER_FILE", 256 << 10)
    store = ScoredStore(spark, new_folder(spark, "store")).write(scored, orders=("ats_desc",))
    sizes = [r["count"] for r in store.rows().groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == N and max(sizes) < N / 4  # 1.7 MB of texts
    assert [r.id for r in store.page("ats_desc", 25, 690).collect()] == [
        r.id for r in scored.orderBy(*feed.sort_order("ats_desc")).offset(690).limit(25).collect()]


def test_lookups_read_few_row_groups(spark, scored, store):
    assert store.by_id(1234).count() == 1 and store.by_id(N).count() == 0
    assert rows_read(store.rows().where("id = 1234")) < N / 4
    wanted = scored.where("id IN (5, 2900)").select("posting_id")
    found = store.by_posting_ids(wanted.unionByName(spark.createDataFrame([("none",), (None,)], "posting_id string")))
    assert sorted(r.id for r in found.collect()) == [5, 2900]
    assert rows_read(found) < N / 2  # by Bloom filter: the ids are in no order
    every = store.by_posting_ids(scored.select("posting_id"))
    assert every.count() == N


def test_kept_figures(spark):
    """Inserts, new scores of stored postings and repeated batches, against the whole table."""
    df = batch_rows(spark)
    stored = spark.createDataFrame(
        [(k, f"p{k}", f"title{'abcdefg'[k] * 4}", ["acme", "bolt"][k % 2], "Rome", "u", "text", 0, s,
          f"{['acme', 'bolt'][k % 2]}:title{'abcdefg'[k] * 4}", 10.5 * k, 7.0 * k, p)
         for k, s, p in [(1, "saved", "LOW"), (2, None, "HIGH"), (3, "new", "MEDIUM"), (4, "applied", "HIGH")]],
        "id long, posting_id string, title string, company string, location string, url string, "
        "description string, is_reposted int, status string, dedup_key string, ats_score double, "
        "fit_score double, priority string")

    def scores(batch):
        seq = F.col("seq")
        return batch.withColumns({"ats_score": (seq * 7 % 30).cast("double"), "fit_score": (seq % 9).cast("double"),
                                  "priority": F.when(seq % 2 == 0, "HIGH").otherwise("LOW")})

    home = new_folder(spark, "test")
    log = jobs.PostingLog(spark, f"{home}/log", fold_every=2).start(stored)
    cut = df.withColumn("part", F.floor(F.col("seq") / 15))
    jobs.upsert_stream(staged(spark, cut, 2), log, f"{home}/offsets", transform=scores).awaitTermination()
    now = log.current()
    assert now.count() > 4
    assert stats.dashboard_of(log.figures()).collect() == stats.dashboard(now).collect()
    assert sorted(stats.by_priority_of(log.figures()).collect()) == sorted(stats.by_priority(now).collect())
    read = log.figures().inputFiles()
    assert read and all("/figures/" in f for f in read)

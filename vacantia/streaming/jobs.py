"""Continuous ingest, status changes, first-seen filter and run log.

Sinks are folders of the shared file system, one sub-folder per micro-batch, written whole: a
batch that runs again after a failure replaces its own output.
"""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedup, stats, upsert
from ..session import cut_lineage, new_folder
from ..sources.adapter import STATUS_EVENTS, Tables


FOLD_EVERY = 16  # micro-batches after which the log is folded into a new base


class PostingLog:
    """Postings as bases plus the rows each micro-batch changed.

    A batch writes only postings it adds or touches (`changes/batch=<n>`). The current table is the
    newest row per id of the last base (`bases/upto=<n>`) and of the changes after it, so what a
    batch reads of the log stays bounded by FOLD_EVERY batches. Folders are written whole: a batch
    that runs again replaces its own.
    """

    def __init__(self, spark: SparkSession, folder: str, fold_every: int = FOLD_EVERY):
        self.spark, self.folder, self.fold_every = spark, folder, fold_every

    def start(self, base: DataFrame) -> "PostingLog":
        base.write.mode("errorifexists").parquet(f"{self.folder}/bases/upto=-1")
        self.spark.createDataFrame([], base.schema).write.parquet(f"{self.folder}/changes/batch=-1")
        if self.has_scores(base):
            base = self.spark.read.parquet(f"{self.folder}/bases/upto=-1")
            stats.partial(base).write.parquet(f"{self.folder}/figures/batch=-1")
        return self

    @staticmethod
    def has_scores(rows: DataFrame) -> bool:
        return {"ats_score", "fit_score", "priority", "status"} <= set(rows.columns)

    def current(self, before: int | None = None) -> DataFrame:
        bases = self.spark.read.parquet(f"{self.folder}/bases")
        usable = bases if before is None else bases.where(F.col("upto") < before)
        last = usable.agg(F.max("upto")).first()[0]
        base = self.spark.read.parquet(f"{self.folder}/bases/upto={-1 if last is None else last}")
        schema = T.StructType([*base.schema.fields, T.StructField("batch", T.IntegerType())])
        changes = self.spark.read.schema(schema).parquet(
            f"{self.folder}/changes").where(F.col("batch") > (-1 if last is None else last))
        if before is not None:
            changes = changes.where(F.col("batch") < before)
        newest = changes.groupBy("id").agg(F.max("batch").alias("batch"))
        kept = base.join(newest, "id", "left_anti")
        return kept.unionByName(changes.join(newest, ["id", "batch"], "left_semi").drop("batch"))

    def write(self, batch_id: int, changed: DataFrame, before: DataFrame | None = None) -> None:
        """The rows as they are now, and `before` as those that were there already have been: the
        figures of a batch are the difference."""
        folder = f"{self.folder}/changes/batch={batch_id}"
        changed.write.mode("overwrite").parquet(folder)
        if before is not None and self.has_scores(changed):
            now = self.spark.read.schema(changed.schema).parquet(folder)
            both = stats.partial(now).unionByName(stats.partial(before, -1))
            both.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/figures/batch={batch_id}")
        if (batch_id + 1) % self.fold_every == 0:
            self.current(batch_id + 1).write.mode("overwrite").parquet(
                f"{self.folder}/bases/upto={batch_id}")

    def figures(self) -> DataFrame:
        """Partial sums of all changes, for `stats.dashboard_of` and `stats.by_priority_of`; no
        posting is read."""
        return self.spark.read.parquet(f"{self.folder}/figures").drop("batch")

    def compact(self, folder: str) -> "PostingLog":
        return PostingLog(self.spark, folder).start(self.current())


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, on the executors' disks and in the
    checkpoint, so it may outgrow their memory."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def upsert_stream(postings: DataFrame, log: PostingLog, checkpoint: str, fuzzy: bool = True,
                  transform=None, run_log: str | None = None) -> StreamingQuery:
    """Runs the batch merge on every micro-batch of arriving postings and logs each run. `transform`
    may score the batch first."""
    def step(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        stored = log.current(before=batch_id)
        resolved = cut_lineage(upsert.resolve(transform(batch) if transform else batch, stored, fuzzy))
        touched = stored.join(resolved.select(F.col("target_id").alias("id")).distinct(), "id",
                              "left_semi")
        updated = upsert.apply_updates(touched, upsert.updates(resolved))
        fresh = upsert.inserts(resolved, stored)
        log.write(batch_id, updated.unionByName(fresh, allowMissingColumns=True)
                  .select(*stored.columns), touched)
        if run_log:
            (upsert.run_log(resolved, F.current_timestamp(), "keywords")
             .write.mode("overwrite").parquet(f"{run_log}/batch={batch_id}"))

    return (postings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def status_stream(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Last status per posting, kept as streaming state; each micro-batch writes the postings whose
    status it changed."""
    latest = events.groupBy("id").agg(
        F.max(F.struct("ts", "event_id", F.lower("status").alias("status"))).alias("last")).select(
        "id", "last.ts", "last.event_id", "last.status")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    with state_on_disk(events.sparkSession):
        return (latest.writeStream.outputMode("update").foreachBatch(step)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows.groupBy("id").agg(F.max(F.struct("ts", "event_id", "status")).alias("last")).select(
        "id", "last.ts", "last.event_id", "last.status")


def first_seen_stream(sightings: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """First sighting of each posting id, however late a repeat comes, as keyed state: an id's state is
    the first row of the micro-batch it came in with first, and the times of its first and its last
    micro-batch; it is new as long as these are the same. A batch reads and writes only its own ids;
    what it adds goes to `batch=<n>`, so a batch that runs again, at its old time, replaces its rows.
    (Column names must not begin with `_`.)"""
    spark = sightings.sparkSession
    rest = [c for c in sightings.columns if c not in ("id", "ts")]
    now = F.current_timestamp()  # one time for a whole micro-batch
    state = sightings.withColumn("_batch", now).groupBy("id").agg(
        F.min(F.struct("_batch", "ts", *rest)).alias("_first"), F.max("_batch").alias("_last"))
    fresh = state.where(F.col("_first._batch") == F.col("_last")).select(
        "id", "_first.ts", *[f"_first.{c}" for c in rest])

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    with state_on_disk(spark):
        return (fresh.writeStream.outputMode("update").foreachBatch(step)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# The jobs over the given tables, run until the available input is used up -----------------------


def _is_file(spark: SparkSession, path: str) -> bool:
    """Asked of the store that the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getFileStatus(path).isFile()


def _stream(t: Tables, name: str) -> DataFrame:
    """The table as a file stream; a table of a single file is picked out of its folder."""
    reader = t.spark.readStream.schema(t.raw(name).schema)
    path = f"{t.sf_dir}/{name}.parquet"
    if _is_file(t.spark, path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)
    return reader.parquet(path)


LANDINGS = 3  # folders that the incoming crawl arrives in, one per micro-batch


def without_texts(rows: DataFrame) -> DataFrame:
    """The rows with an empty description: ids, keys and what is new do not depend on it."""
    return rows.withColumn("description", F.lit(""))


def _incoming_stream(t: Tables, folder: str, texts: bool = True) -> DataFrame:
    """The incoming crawl as it lands, a third of `seq` after the other: many tasks write each third,
    and a micro-batch takes up the files of one. A third is picked by bounds of `seq`, so that its scan
    can leave out the rest of the table."""
    rows = t.incoming() if texts else without_texts(t.incoming())
    last = rows.agg(F.max("seq")).first()[0] or 0
    starts = [-(-i * (last + 1) // LANDINGS) for i in range(LANDINGS + 1)]
    files = max(1, min(int(t.spark.conf.get("spark.sql.shuffle.partitions")), last // LANDINGS))
    for low, high in zip(starts[:-1], starts[1:]):
        third = rows.where((F.col("seq") >= low) & (F.col("seq") < high))
        third.repartition(files).write.mode("append").parquet(folder)
    return (t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder))


def _event_stream(t: Tables) -> DataFrame:
    events = t.spark.sql(STATUS_EVENTS, events=_stream(t, "events"), documents=t.raw("documents"))
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _upsert_once(t: Tables, fuzzy: bool, texts: bool = True) -> tuple[PostingLog, str]:
    home = new_folder(t.spark, "upsert")
    postings = t.postings() if texts else without_texts(t.postings())
    log = PostingLog(t.spark, f"{home}/postings").start(dedup.dedup_exact(postings))
    upsert_stream(_incoming_stream(t, f"{home}/landed", texts), log, f"{home}/offsets", fuzzy,
                  run_log=f"{home}/runs").awaitTermination()
    return log, f"{home}/runs"


def run_upsert_once(t: Tables, fuzzy: bool = True) -> DataFrame:
    return _upsert_once(t, fuzzy)[0].current()


def run_figures_once(t: Tables, scored: DataFrame) -> DataFrame:
    """Dashboard after the crawl has been merged, from the sums that its micro-batches left."""
    home = new_folder(t.spark, "figures")
    log = PostingLog(t.spark, f"{home}/postings").start(scored)
    upsert_stream(_incoming_stream(t, f"{home}/landed"), log, f"{home}/offsets").awaitTermination()
    return stats.dashboard_of(log.figures())


def run_log_once(t: Tables) -> DataFrame:
    """Found and new rows per search over all micro-batches. No text counts for them, so none is moved."""
    runs = t.spark.read.parquet(_upsert_once(t, fuzzy=False, texts=False)[1])
    return runs.groupBy("keywords").agg(F.sum("jobs_found").alias("jobs_found"),
                                        F.sum("new_jobs").alias("new_jobs"))


def run_status_once(t: Tables) -> DataFrame:
    home = new_folder(t.spark, "status")
    status_stream(_event_stream(t), f"{home}/status", f"{home}/offsets").awaitTermination()
    return current_status(t.spark, f"{home}/status")


def run_first_seen_once(t: Tables) -> DataFrame:
    home = new_folder(t.spark, "seen")
    first_seen_stream(_event_stream(t), f"{home}/seen", f"{home}/offsets").awaitTermination()
    return t.spark.read.parquet(f"{home}/seen")

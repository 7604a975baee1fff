"""Scored postings as files that serve lookups and pages by reading a few of them.

`rows` holds all columns, sorted by id over the whole table, in small row groups, with a Parquet Bloom
filter on the posting id: a lookup reads the row groups that may hold its ids. `feed/<order>` holds the
sort keys alone, cut and sorted in the feed's order for each status tab; `files/<order>` says how many
rows lie before each of its files, so a page, however deep, opens the one or two files it lies in.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.feed import sort_order
from ..session import cut_lineage
from .tables import decoded_json

ORDERS = ("priority_desc", "ats_desc", "fit_desc", "date_desc")
EVERY_TAB = "all"
ROWS_PER_FILE = 1_000_000
BYTES_PER_FILE = 128 << 20  # of the texts of `rows`; a task sorts and writes one file
GROUP_BYTES = 8 << 20   # of a row group
KEYS_IN_FILTER = 1024   # ids of a lookup that are put to the files one by one


def _text_bytes(rows: DataFrame) -> Column:
    """Bytes in a row's text columns, arrays of texts included."""
    kinds = {"string": F.octet_length, "array<string>": lambda c: F.octet_length(F.array_join(c, ""))}
    sizes = [F.coalesce(kinds[kind](F.col(f"`{name}`")), F.lit(0)) for name, kind in rows.dtypes if kind in kinds]
    return sum((size.cast("bigint") for size in sizes), F.lit(0))


class ScoredStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, scored: DataFrame, orders=ORDERS, rows_per_file: int = ROWS_PER_FILE,
              group_bytes: int = GROUP_BYTES) -> "ScoredStore":
        total, size = scored.agg(F.count("*"), F.coalesce(F.sum(_text_bytes(scored)), F.lit(0))).first()
        key_files = max(1, -(-total // rows_per_file))
        files = max(key_files, -(-size // BYTES_PER_FILE))
        (scored.repartitionByRange(files, "id").sortWithinPartitions("id").write
         .option("parquet.bloom.filter.enabled#posting_id", "true")
         .option("parquet.bloom.filter.expected.ndv#posting_id", str(max(1, total // files)))
         .option("parquet.block.size", str(group_bytes)).mode("errorifexists").parquet(f"{self.folder}/rows"))
        stored = self.rows()
        keys = stored.select("id", "priority", "ats_score", "fit_score",
                             "scraped_at" if "scraped_at" in stored.columns else
                             F.lit(None).cast("timestamp").alias("scraped_at"),
                             F.explode(F.array(F.lit(EVERY_TAB), F.coalesce("status", F.lit("new")))).alias("tab"))
        for order in orders:
            place = f"{self.folder}/feed/{order}"
            (keys.repartitionByRange(2 * key_files, "tab", *sort_order(order)).sortWithinPartitions("tab", *sort_order(order))
             .write.partitionBy("tab").mode("errorifexists").parquet(place))
            # Files of a tab follow each other as the tasks that wrote them.
            read = self.spark.read.parquet(place)
            sizes = read.groupBy("tab", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(
                F.count("*").alias("n"))
            before = Window.partitionBy("tab").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
            sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.mode(
                "errorifexists").parquet(f"{self.folder}/files/{order}")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def by_id(self, job_id: int) -> DataFrame:
        """The row of an id, JSON decoded; empty when absent."""
        return decoded_json(self.rows().where(F.col("id") == job_id))

    def by_posting_ids(self, wanted: DataFrame) -> DataFrame:
        """Stored rows that hold one of the posting ids. A few ids are put to the files' Bloom
        filters; more than KEYS_IN_FILTER meet the whole table in a join."""
        ids = wanted.select("posting_id").where("posting_id IS NOT NULL").distinct()
        few = [r.posting_id for r in ids.limit(KEYS_IN_FILTER + 1).collect()]
        if len(few) <= KEYS_IN_FILTER:
            return self.rows().where(F.col("posting_id").isin(few))
        return self.rows().join(ids, "posting_id", "left_semi").select(*self.rows().columns)

    def page(self, order: str = "priority_desc", limit: int = 100, offset: int = 0, tab: str | None = None) -> DataFrame:
        """Rows offset .. offset+limit-1 of a feed order (an unknown one means priority_desc), of all
        postings or of one tab, with `rank` from offset+1 on."""
        order, tab = order if order in ORDERS else "priority_desc", (tab or EVERY_TAB).lower()
        files = self.spark.read.parquet(f"{self.folder}/files/{order}").where(
            (F.col("tab") == tab) & (F.col("first") < offset + limit) & (F.col("first") + F.col("n") > offset))
        hit = files.orderBy("first").collect()  # as many as the page spans
        if not hit:
            return self.rows().limit(0).withColumn("rank", F.lit(None).cast("bigint"))
        keys = self.spark.read.parquet(*[f"{self.folder}/feed/{order}/tab={tab}/{r.file}" for r in hit])
        skip = offset - hit[0]["first"]
        ids = [r.id for r in keys.orderBy(*sort_order(order)).offset(skip).limit(limit).select("id").collect()]
        place = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id")) + F.lit(offset)
        return self.rows().where(F.col("id").isin(ids)).withColumn("rank", place.cast("bigint")).orderBy("rank")


def stored_scores(scored: DataFrame, folder: str) -> ScoredStore:
    """A store of these rows, which are scored once for it."""
    return ScoredStore(scored.sparkSession, folder).write(cut_lineage(scored))

"""Stored tables: snapshots, JSON text columns, lookups, schema growth, resume files."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import resume as R
from ..functions import text as X
from ..schema import BREAKDOWN, POSTING, PROFILE, SCORING_COLUMNS, STRINGS

# Text columns that hold JSON, and what null or '' stands for.
JSON_COLUMNS = {
    "matched_skills": (STRINGS, "[]"), "missing_skills": (STRINGS, "[]"),
    "hard_req_concerns": (STRINGS, "[]"), "score_breakdown": (BREAKDOWN, "{}"),
}

# Columns that older snapshots lack.
ADDED_COLUMNS = {"required_experience": None, "seniority": "", "is_reposted": 0, "dedup_key": ""}


def read_snapshot(spark: SparkSession, path: str, tab: str | None = None) -> DataFrame:
    """The stored postings, or one feed tab of them, which reads only that tab's files."""
    table = spark.read.schema(POSTING).parquet(path)
    if tab is not None:
        table = table.where(F.col("tab") == tab.lower())
    return table.drop("tab")


def write_snapshot(postings: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """A new snapshot folder, split by status so that a feed tab reads only its part."""
    (postings.withColumn("tab", F.coalesce("status", F.lit("new"))).write
     .option("maxRecordsPerFile", rows_per_file).partitionBy("tab").mode("errorifexists")
     .parquet(path))


def decoded_json(table: DataFrame) -> DataFrame:
    """JSON text columns -> arrays and structs."""
    def decoded(name: str, dtype: T.DataType, empty: str) -> Column:
        return F.from_json(F.coalesce(X.present(F.col(name)), F.lit(empty)), dtype)

    return table.withColumns({n: decoded(n, *spec) for n, spec in JSON_COLUMNS.items()
                              if n in table.columns})


def encoded_json(table: DataFrame) -> DataFrame:
    return table.withColumns({n: F.to_json(n) for n in JSON_COLUMNS if n in table.columns})


def scoring_scan(table: DataFrame) -> DataFrame:
    return table.select(*SCORING_COLUMNS)


def by_id(table: DataFrame, job_id: int) -> DataFrame:
    """The row with this id, JSON decoded; empty when absent."""
    return decoded_json(table.where(F.col("id") == job_id))


def grown(table: DataFrame, columns: dict = ADDED_COLUMNS) -> DataFrame:
    """Adds columns the table lacks, with their default."""
    types = {f.name: f.dataType for f in POSTING.fields}
    return table.withColumns({n: F.lit(v).cast(types[n]) for n, v in columns.items()
                              if n not in table.columns})


def read_resume_files(spark: SparkSession, path: str) -> DataFrame:
    """Resume files of a folder as (resume_id, file_name, resume_text); blank files are left out."""
    files = spark.read.format("binaryFile").load(path)
    return (files.select(F.xxhash64("path").alias("resume_id"), F.col("path").alias("file_name"),
                         R.decoded(F.col("content")).alias("resume_text"))
            .where(X.strip(F.col("resume_text")) != ""))


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("errorifexists").json(path)


def read_profiles(spark: SparkSession, path: str, keys: str = "") -> DataFrame:
    """Profiles as written, with further columns (as DDL) in front; fields that the JSON leaves out are
    null."""
    own = T.StructType.fromDDL(keys).fields if keys else []
    return spark.read.schema(T.StructType([*own, *PROFILE.fields])).json(path)


def append_run_log(log: DataFrame, path: str) -> None:
    log.withColumn("day", F.to_date("ts")).write.partitionBy("day").mode("append").parquet(path)

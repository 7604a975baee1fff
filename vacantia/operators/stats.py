"""Dashboard and run aggregates."""

from pyspark.sql import Column, DataFrame, functions as F


def _mean_score(name: str) -> Column:
    """Mean over scored rows at one decimal. Scores have one decimal, so tenths are summed as
    integers and the result does not depend on the order of rows."""
    scored = F.col("ats_score") > 0
    tenths = F.sum(F.when(scored, F.bround(F.col(name) * 10, 0).cast("bigint")))
    return F.coalesce(F.bround(tenths / (F.count_if(scored) * F.lit(10.0)), 1), F.lit(0.0))


def dashboard(postings: DataFrame) -> DataFrame:
    """Eleven figures in one pass."""
    status = F.col("status")
    return postings.agg(
        F.count("*").alias("total"),
        F.countDistinct("posting_id").alias("unique_postings"),
        F.count_if(F.col("ats_score") > 0).alias("scored"),
        F.count_if(F.col("priority") == "HIGH").alias("high_priority"),
        _mean_score("ats_score").alias("avg_ats"),
        _mean_score("fit_score").alias("avg_fit"),
        F.count_if((status == "new") | status.isNull()).alias("count_new"),
        *[F.count_if(status == s).alias(f"count_{s}")
          for s in ("saved", "applied", "rejected", "ignored")])


# Figures kept up to date: partial sums per (priority, status) that a change adds its new rows to and takes
# its old rows from. A few rows per change, whatever the table's size.


def partial(postings: DataFrame, sign: int = 1) -> DataFrame:
    """Sums of these rows by priority and status, counted up or, with sign -1, down."""
    def tenths(name):
        return F.coalesce(F.sum(F.when(F.col("ats_score") > 0, F.bround(F.col(name) * 10, 0).cast("bigint"))),
                          F.lit(0))

    return postings.groupBy("priority", "status").agg(
        (sign * F.count("*")).alias("n"), (sign * F.count_if(F.col("ats_score") > 0)).alias("scored"),
        (sign * tenths("ats_score")).alias("ats"), (sign * tenths("fit_score")).alias("fit"))


def dashboard_of(partials: DataFrame) -> DataFrame:
    """The figures of `dashboard` from partial sums. Postings of a table have an id each, so the
    number of postings is the number of ids."""
    status, n = F.col("status"), F.col("n")

    def total(test):
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("bigint")

    def mean(name):
        return F.coalesce(F.bround(F.sum(name) / (F.sum("scored") * F.lit(10.0)), 1), F.lit(0.0))

    return partials.agg(
        total(F.lit(True)).alias("total"), total(F.lit(True)).alias("unique_postings"),
        F.coalesce(F.sum("scored"), F.lit(0)).cast("bigint").alias("scored"),
        total(F.col("priority") == "HIGH").alias("high_priority"),
        mean("ats").alias("avg_ats"), mean("fit").alias("avg_fit"),
        total((status == "new") | status.isNull()).alias("count_new"),
        *[total(status == s).alias(f"count_{s}") for s in ("saved", "applied", "rejected", "ignored")])


def by_priority_of(partials: DataFrame) -> DataFrame:
    return partials.groupBy("priority").agg(F.sum("n").cast("bigint").alias("postings")).where("postings <> 0")


def by_priority(postings: DataFrame) -> DataFrame:
    return postings.groupBy("priority").agg(F.count("*").alias("postings"))


def run_rollup(resolved: DataFrame, role: str) -> DataFrame:
    """Found, new and reposted rows per role, and the run's totals (role null)."""
    return resolved.rollup(role).agg(
        F.count("*").alias("found"), F.count_if("is_new").alias("new"),
        F.coalesce(F.sum("is_reposted"), F.lit(0)).cast("bigint").alias("reposted"))


def top_high(postings: DataFrame, n: int = 5) -> DataFrame:
    """First n HIGH postings in table order."""
    return postings.where(F.col("priority") == "HIGH").orderBy("id").limit(n)

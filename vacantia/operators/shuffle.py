"""Shuffle helpers: joins that hold under hot keys, and dense ids in a global order."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

SALTS = 16


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, spread: str, how: str = "left",
                salts: int = SALTS) -> DataFrame:
    """rows JOIN lookup ON key, for a narrow lookup with few rows per key. Rows of one key are
    spread over `salts` tasks by a hash of `spread`; the lookup is repeated per salt. It is not
    broadcast: Spark guesses its size from compressed files and before it is repeated."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                               F.lit(salts - 1).cast("bigint"))))
    return salted.join(repeated.hint("merge"), [key, "_salt"], how).drop("_salt")


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds 1, 2, 3, ... in global order without a single-task sort: rows are range partitioned,
    numbered inside their partition, and shifted by the sizes of the partitions before it (one
    number per partition)."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part")
            .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
            .drop("_part", "_inside", "_before"))


def last_before(df: DataFrame, by: str, order: str, value: str, name: str,
                width: int = 1 << 16) -> DataFrame:
    """Adds `name`: the last non-null `value` among the rows of the same `by` strictly before a row in
    `order` (a whole number, no two rows of a `by` alike). A hot `by` is cut into blocks of `width`
    of that order; one value per block is carried on to the next ones."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / width))
    tails = blocked.groupBy(by, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_tail"))
    earlier = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(by, "_block", F.last("_tail", True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (blocked.join(carried, [by, "_block"], "left")
            .withColumn(name, F.coalesce(F.last(value, True).over(inside), "_carried"))
            .drop("_block", "_carried"))


def in_cells(left: DataFrame, right: DataFrame, by: list[str], left_key: str, right_key: str,
             size: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with `_cell`, so that rows of equal `by` (all rows, without one) meet in exactly one
    cell, of about `size` by `size` rows. A side is cut by a hash of its key and repeated for every
    part of the other, so no task gets a whole group."""
    def parts(df, name):
        return df.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    if by:
        grid = cut_lineage(parts(left, "_cols").join(parts(right, "_rows"), by))
        sides = [left.join(grid, by), right.join(grid, by)]
    else:
        counts = [F.lit(max(1, -(-df.count() // size))) for df in (left, right)]
        sides = [df.withColumns({"_cols": counts[0], "_rows": counts[1]}) for df in (left, right)]

    def placed(df, key, mine, other, names):
        own = F.pmod(F.xxhash64(key), F.col(mine)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other).cast("int") - 1))
        return df.withColumn(names[0], own).withColumn(names[1], every).withColumn(
            "_cell", F.struct(*by, "_x", "_y")).drop("_cols", "_rows", "_x", "_y")

    return (placed(sides[0], left_key, "_cols", "_rows", ("_x", "_y")),
            placed(sides[1], right_key, "_rows", "_cols", ("_y", "_x")))

"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark.storage import kept


def with_rank(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """`rows` with `rank`, from 1 in each group by `order`, which must tell all rows of a group apart.

    A group may hold a third of all rows: rows are dealt out by ranges of group and order, so it spans many tasks.
    Each task ranks its own rows, behind the number of the group's rows in the ranges before.
    """
    dealt = kept(rows.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n"))
    before = before.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), "_before")
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    return own.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of"))).withColumn(
        "rank", (F.col("_before") + F.col("_own")).cast("int")).select(*rows.columns, "rank")

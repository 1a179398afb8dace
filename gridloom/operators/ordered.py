"""Places and running sums within groups of any size.

A window over a group puts the group into one task. Here rows are dealt by ranges of (group, order), so that a large group takes as many
tasks as its share of the rows; each range counts its own rows, and what a group has in the ranges before comes from prefix sums
over one row for each range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.shared import written


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """rows with `n`, the place in the group from 1, and a running sum, the row's own included, under each name of `sums`.

    Groups are told apart by the columns `by` (null is a group), rows of equal order stand in some fixed order. Sums of doubles
    may differ from a window's in their last digits; those of integers and decimals don't. The dealt rows are written to the shared
    folder, since ranges and places must not change when a task is repeated.
    """
    sums = sums or {}
    own = rows.withColumns({f"_v_{k}": v for k, v in sums.items()}) if sums else rows
    dealt = own.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, "dealt").withColumn("_range", F.shiftright("_at", 33))
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    each = dealt.groupBy(F.col("_range").alias("_r"), *keys).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"), *[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(by))] or [F.lit(0)]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("_r", *[f"_g{i}" for i in range(len(by))], "_first", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_rows", *[f"_s_{k}" for k in sums])])
    if sums:
        within = Window.partitionBy("_range", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        dealt = dealt.withColumns({f"_v_{k}": F.coalesce(F.sum(f"_v_{k}").over(within), F.lit(0)) for k in sums})
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = dealt.join(each, same).withColumn("n", F.col("_b_rows") + F.col("_at") - F.col("_first") + 1)
    return out.select(*rows.columns, "n", *[(F.col(f"_v_{k}") + F.col(f"_b_s_{k}")).alias(k) for k in sums])

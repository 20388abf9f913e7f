"""Order statistics and neighbours within groups of any size: no group is sorted or gathered in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def nth_value(df: DataFrame, by: str, value: str, place: Callable[[Column], Column]) -> DataFrame:
    """(by, value): per group of n rows its ``place(n)``-th value from 1 on, nulls first.

    Equal values are counted before any shuffle. The values' range is cut into BINS; the
    bins' counts tell in which one the place falls, and only that one's values are sorted.
    """
    v = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("__c"))
    g = v.groupBy(F.col(by).alias("__g")).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum("__c").alias("__n"))
    at = F.when(F.col(value).isNull(), -1).when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * BINS), F.lit(BINS - 1)))
    b = v.join(g, F.col(by).eqNullSafe(F.col("__g"))).withColumn("__bin", at.cast("int")).withColumn("__at", place(F.col("__n")))
    bins = b.groupBy("__g", "__bin").agg(F.sum("__c").alias("__k"), F.first("__at").alias("__at"))
    before = F.coalesce(F.sum("__k").over(Window.partitionBy("__g").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # BINS rows a group
    hit = bins.withColumn("__before", before).filter((F.col("__before") < F.col("__at")) & (F.col("__at") <= F.col("__before") + F.col("__k")))
    hit = hit.select(F.col("__g").alias("__h"), F.col("__bin").alias("__b"), "__before")
    inside = b.join(hit, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__bin") == F.col("__b")))
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy("__g").orderBy(value))
    return inside.withColumn("__upto", upto).filter("__upto >= __at").groupBy("__g").agg(F.min(F.struct(F.col("__upto"), F.col(value).alias("v")))["v"].alias(value)).select(F.col("__g").alias(by), value)


def _ranges(df: DataFrame, by: str, order: str) -> DataFrame:
    """Rows with ``__p``, the range of a group's span that the number ``order`` falls in; it follows from the values alone."""
    g = df.groupBy(F.col(by).alias("__g")).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    x = df.join(g, F.col(by).eqNullSafe(F.col("__g")))
    at = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.floor((F.col(order) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * BINS))
    return x.select(*df.columns, F.coalesce(at, F.lit(0)).cast("int").alias("__p"))


def with_next(df: DataFrame, by: str, order: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with, under new names, columns of the group's next row. ``order`` is unique within a group.

    Within a range it is the next row; the last row of a range gets the first one of the
    group's next range, looked up among one row per range and group.
    """
    x = _ranges(df, by, order)
    inner = Window.partitionBy("__p", by).orderBy(order)
    x = x.withColumns({f"__{new}": F.struct(F.lead(order).over(inner).alias("o"), F.lead(old).over(inner).alias("v")) for old, new in columns.items()})
    edge = x.groupBy("__p", by).agg(F.min(F.struct(order, *columns)).alias("__f"))
    later = Window.partitionBy(by).orderBy("__p")  # one row per range that the group reaches
    edge = edge.withColumn("__next", F.lead("__f").over(later)).select(F.col("__p").alias("__q"), F.col(by).alias("__by"), "__next")
    got = x.join(edge, (F.col("__p") == F.col("__q")) & F.col(by).eqNullSafe(F.col("__by")), "left")
    return got.select(*df.columns, *[F.when(F.col(f"__{new}.o").isNotNull(), F.col(f"__{new}.v")).otherwise(F.col(f"__next.{old}")).alias(new) for old, new in columns.items()])


def running_before(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the group's rows before each, by ranges and their offsets."""
    x = _ranges(df, by, order)
    inner = Window.partitionBy("__p", by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    each = x.groupBy("__p", by).agg(F.sum(value).alias("__s"))
    ahead = F.coalesce(F.sum("__s").over(Window.partitionBy(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("__off", ahead).select(F.col("__p").alias("__q"), F.col(by).alias("__by"), "__off")
    got = x.join(each, (F.col("__p") == F.col("__q")) & F.col(by).eqNullSafe(F.col("__by")))
    return got.select(*df.columns, (F.col("__in") + F.col("__off")).alias("before"))

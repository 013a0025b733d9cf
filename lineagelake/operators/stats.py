"""Tables behind the plots: shares of categories, cross tables, box statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.functions.storage import stored
from lineagelake.operators.abundance import with_sum


def _checked(df: DataFrame, *columns: str | None) -> None:
    for c in columns:
        if c is not None and c not in df.columns:
            raise ValueError(f"no column {c!r}; there are {', '.join(df.columns)}")


def category_percent(obs: DataFrame, groupby: str, order: list[str] | None = None) -> DataFrame:
    """``(groupby, count, percentage)``, by falling percentage, or in ``order``."""
    _checked(obs, groupby)
    out = obs.dropna(subset=[groupby]).groupBy(groupby).agg(F.count("*").alias("count"))
    out = with_sum(out, [], "__sum", "count").withColumn("percentage", F.col("count") / F.col("__sum") * 100).drop("__sum")
    if order:
        return out.where(F.col(groupby).isin(order)).orderBy(F.array_position(F.array(*map(F.lit, order)), F.col(groupby)))
    return out.orderBy(F.desc("percentage"), groupby)


def crosstab_percent(obs: DataFrame, groupby: str, key: str) -> DataFrame:
    """Long cross table ``(groupby, key, count, percentage)``, percentages by row of
    ``groupby``, with 0 for combinations that do not occur."""
    _checked(obs, groupby, key)
    held = stored(obs.dropna(subset=[groupby, key]).groupBy(groupby, F.col(key).cast("string").alias(key)).agg(F.count("*").alias("count")), "cells")
    grid = held.select(groupby).distinct().crossJoin(held.select(key).distinct())  # what the table is: a cell for each pair
    out = grid.join(held, [groupby, key], "left").na.fill(0, ["count"])
    return with_sum(out, [groupby], "__sum", "count").withColumn("percentage", F.col("count") / F.col("__sum") * 100).drop("__sum")


def box_stats(obs: DataFrame, value: str, groupby: str, hue: str | None = None) -> DataFrame:
    """Quartiles, and the furthest values within 1.5 interquartile ranges of the box."""
    _checked(obs, value, groupby, hue)
    keys = [groupby] + ([hue] if hue else [])
    rows = obs.dropna(subset=[*keys, value])
    # Values with their numbers, dealt by ranges: a value's ranks are its range's sum before it
    # and those of the earlier ranges, so no task holds a whole group.
    by = rows.groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    by = stored(by.repartitionByRange(*keys, "__v").withColumn("__range", F.spark_partition_id()), "values")
    sums = by.groupBy(*keys, "__range").agg(F.sum("__c").alias("__s"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__range", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__range").orderBy("__v")
    total = by.groupBy(*keys).agg(F.sum("__c").alias("n"))
    placed = by.withColumn("__in", F.sum("__c").over(within)).join(sums, [*keys, "__range"]).join(total, keys)
    last = F.col("__before") + F.col("__in") - 1  # the rank, from 0, of the value's last row
    at = lambda rank: F.max(F.when((rank <= last) & (rank > last - F.col("__c")), F.col("__v").cast("double")))
    names = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    picks = [x for c, p in names.items() for x in (at(F.floor((F.col("n") - 1) * p)).alias(f"__lo_{c}"), at(F.ceil((F.col("n") - 1) * p)).alias(f"__hi_{c}"))]
    box = placed.groupBy(*keys, "n").agg(*picks)
    part = lambda p: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
    box = box.select(*keys, "n", *[(F.col(f"__lo_{c}") * (1 - part(p)) + F.col(f"__hi_{c}") * part(p)).alias(c) for c, p in names.items()])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.when((F.col("__v") >= F.col("q1") - reach) & (F.col("__v") <= F.col("q3") + reach), F.col("__v"))
    ends = by.join(box, keys).groupBy(*keys).agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"))
    return box.join(ends, keys)

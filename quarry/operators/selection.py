"""Exact order statistics and percentiles by distributed selection: histograms that narrow down to the wanted ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.store import stored


def _matched(names: Sequence[str]) -> Column:
    """That the columns of two sides agree, of which the right one's begin with _."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return out


def order_statistics(values: DataFrame, ranks: DataFrame, groups: Sequence[str], bins: int = 1024) -> DataFrame:
    """ranks (groups, k) with ``value``: the k-th smallest v (from 1) of the group's values (groups, v), which must have as many.

    Each wanted rank has an interval of values that holds it, at first the group's range. A pass cuts every interval into ``bins`` of equal
    width and counts them, combined by task; the bin with the rank, shrunk to the values that occur in it, is the next interval. Its
    least and greatest value never fall into one bin, so each pass leaves fewer values, and it ends when one is left: two or
    three passes as a rule. A task holds counts, never values, however many differ; what a pass leaves is one row a rank.
    Values are doubles without nulls; infinities are in order like others."""
    groups = list(groups)
    ends = values.groupBy(*(F.col(c).alias(f"_{c}") for c in groups)).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    state = stored(ranks.join(ends, _matched(groups)).select(*groups, "k", "low", "high", F.lit(0).cast("long").alias("below")))
    done = None
    while True:
        ready = state.where("low = high")
        done = ready if done is None else done.unionAll(ready)
        left = state.where("low < high")
        if left.isEmpty():
            return done.select(*groups, "k", F.col("low").alias("value"))
        spans = left.select(*(F.col(c).alias(f"_{c}") for c in groups), F.col("low").alias("_low"), F.col("high").alias("_high")).distinct()
        inside = values.join(spans, _matched(groups) & (F.col("v") >= F.col("_low")) & (F.col("v") <= F.col("_high")))
        width = F.col("_high") / 2 - F.col("_low") / 2  # halves, so that no range overflows
        even = F.least(F.floor((F.col("v") / 2 - F.col("_low") / 2) / width * bins), F.lit(bins - 1))
        odd = F.when(F.col("v") == F.col("_low"), 0).when(F.col("v") == F.col("_high"), bins - 1).otherwise(1 % (bins - 1))
        bin_of = F.when((width > 0) & (width < float("inf")), even).otherwise(odd).cast("int")
        keys = [*(f"_{c}" for c in groups), "_low", "_high"]
        counted = inside.groupBy(*keys, bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows
        counted = counted.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        at = F.col("k") - F.col("below") - F.col("before")
        found = left.join(counted, _matched([*groups, "low", "high"])).where((at > 0) & (at <= F.col("n")))
        state = stored(found.select(*groups, "k", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("below") + F.col("before")).alias("below")))


def percentiles(df: DataFrame, column: str, groups: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(groups, n, p0, p1, ...): the number of values of each group of df, and its percentiles with linear interpolation between neighbours.
    Nulls are left out; groups without values have n = 0 and null percentiles; null groups are a group. Without groups: one row."""
    groups = list(groups)
    values = stored(df.select(*groups, F.col(column).cast("double").alias("v")))
    sizes = stored(values.groupBy(*groups).agg(F.count("v").alias("n")))
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    wanted = F.explode(F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)) + 1, F.ceil(place(p)) + 1) for p in shares))).cast("array<bigint>")))
    known = order_statistics(values.where("v is not null"), sizes.where("n > 0").select(*groups, wanted.alias("k")), groups)
    known = known.groupBy(*(F.col(c).alias(f"_{c}") for c in groups)).agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("at"))  # two ranks a percentile
    out = sizes.join(known, _matched(groups), "left").select(*groups, "n", "at")

    def between(p: float) -> Column:
        at = lambda k: F.element_at("at", k.cast("long") + 1)
        low, high, pos = F.floor(place(p)), F.ceil(place(p)), place(p)
        return F.when(F.col("n") == 0, None).when(low == high, at(low)).otherwise((high - pos) * at(low) + (pos - low) * at(high))

    return out.select(*groups, "n", *(between(p).alias(f"p{i}") for i, p in enumerate(shares)))

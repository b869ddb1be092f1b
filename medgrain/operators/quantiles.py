"""Exact quantiles of many values, without all of a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medgrain.operators.skew import join_null_safe, spread_join
from medgrain.session import durable

RANGES, MOST = 256, 100_000


def exact_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, out: str, ranges: int = RANGES,
                   most: int = MOST) -> DataFrame:
    """``by, out``: the value at position ``q * (n - 1)`` of each group, between two values by linear interpolation.

    Equal values are counted first. While the range in question of some group holds more than ``most`` distinct values,
    it is cut into ``ranges`` parts of even width; their counts, which merge, tell the part that holds the position and
    how many values come before it. The position is then found inside one range. Nulls and NaN do not count; a group
    without a value has no row.
    """
    by = list(by)
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(1))
    v = F.col(value).cast("double")
    points = durable(rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*[
        F.coalesce(F.col(k).cast("string"), F.lit("\0null")).alias(f"_k{i}") for i, k in enumerate(keys)
    ], (v + F.lit(0.0)).alias("_v")).agg(F.count(F.lit(1)).alias("_n"), *[F.first(k).alias(k) for k in by]))
    group = [f"_k{i}" for i in range(len(keys))]
    at = F.col("_total") - 1
    state = points.groupBy(*group).agg(
        F.sum("_n").alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_distinct"),
        *[F.first(k).alias(k) for k in by]).select(
        *group, *by, (at * q).alias("_at"), F.explode(F.array_distinct(F.array(F.floor(at * q), F.ceil(at * q)))).alias("_place"),
        "_lo", "_hi", F.lit(0).cast("bigint").alias("_before"), "_distinct")
    state = durable(state)
    asked = [*group, "_place"]

    def inside() -> DataFrame:
        narrow = state.select(*asked, "_lo", "_hi", "_before")
        return spread_join(points.select(*group, "_v", "_n"), narrow, group, everywhere=True).where("_v >= _lo and _v <= _hi")

    upto = Window.partitionBy(*asked)
    while (state.agg(F.max("_distinct")).first()[0] or 0) > most:
        width = F.col("_hi") - F.col("_lo")
        part = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * ranges), F.lit(ranges - 1))).otherwise(0)
        counts = inside().withColumn("_part", part).groupBy(*asked, "_part").agg(
            F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_distinct"),
            F.first("_before").alias("_before"))
        before = F.col("_before") + F.coalesce(
            F.sum("_n").over(upto.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = counts.withColumn("_before", before).where("_before <= _place and _place < _before + _n")
        state = durable(state.select(*asked, *by, "_at").join(
            held.select(*asked, "_lo", "_hi", "_before", "_distinct"), asked))
    before = F.col("_before") + F.coalesce(
        F.sum("_n").over(upto.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = inside().withColumn("_b", before).where("_b <= _place and _place < _b + _n").select(*asked, "_v")
    low, high = F.floor("_at"), F.ceil("_at")
    both = state.select(*asked, *by, "_at").join(found, asked).groupBy(*group).agg(
        F.max("_at").alias("_at"), F.max(F.when(F.col("_place") == low, F.col("_v"))).alias("_low"),
        F.max(F.when(F.col("_place") == high, F.col("_v"))).alias("_high"), *[F.first(k).alias(k) for k in by])
    value_at = F.when(low == high, F.col("_low")).otherwise(
        (high - F.col("_at")) * F.col("_low") + (F.col("_at") - low) * F.col("_high"))
    return both.select(*by, value_at.alias(out))


def with_quantile(grouped: DataFrame, df: DataFrame, by: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """``grouped`` (one row for each group of ``by``) with the exact quantile of ``value`` in ``df``; null without values."""
    found = exact_quantile(df, by, value, q, out)
    if by:
        return join_null_safe(grouped, found, by)
    one = found.withColumn("_all", F.lit(1))  # one row at most
    return grouped.withColumn("_all", F.lit(1)).join(F.broadcast(one), "_all", "left").drop("_all")

"""As-of, prefix and window summaries over long observation tables.

Observations and question times meet in one ordered stream per (key, time bucket); the
prefixes of earlier buckets are carried in. No pair of a base row with each of its
earlier observations is ever formed, and a key with a third of all rows is spread over
its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medgrain.functions.clinical import trend
from medgrain.operators.skew import by_key, join_null_safe, running, spread_join, time_bucket

SUM_TYPE = "decimal(28,6)"  # exact sums: the answer does not depend on partitioning


def _prefix(
    questions: DataFrame, points: DataFrame, keys: Sequence[str], at: str, aggs: dict[str, Column],
    specs: dict[str, tuple[str, Column, bool]], strict: bool, bucket_seconds: int,
) -> DataFrame:
    """Running values of ``points`` at each distinct question ``(keys, at)``; points carry ``at`` as their time.

    Questions and points meet by key once; ``aggs`` makes one step of the points of a time, ``_t`` is a step's time.
    """
    asked = questions.select(*keys, at).dropna().withColumn("_tag", F.lit(0 if strict else 2))
    stream = points.dropna(subset=list(keys)).withColumn("_tag", F.lit(1)).unionByName(asked, allowMissingColumns=True)
    stream, heavy = by_key(stream, keys)
    steps = stream.groupBy(*keys, at, "_tag").agg(*[v.alias(n) for n, v in aggs.items()]).withColumn(
        "_t", F.when(F.col("_tag") == 1, F.col(at)))
    values = running(steps, keys, [at, "_tag"], time_bucket(at, bucket_seconds), specs, heavy)
    return values.where(F.col("_tag") != 1).select(*keys, at, *specs)


def asof_latest(base: DataFrame, obs: DataFrame, keys: Sequence[str], at: str, ts: str, value: str,
                out: str | None = None, strict: bool = False, bucket_seconds: int = 86_400,
                asked: DataFrame | None = None) -> DataFrame:
    """Latest observation at or before (``strict``: before) ``at``, with its time.

    Of several values at one time the largest counts. ``asked`` are the questions where they are at hand in a narrower
    frame than ``base``.
    """
    keys, out = list(keys), out or value
    points = obs.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(
        *keys, F.col(ts).alias(at), F.col(value).alias("_x"))
    specs = {out: ("last", F.col("_v"), True), f"{out}_time": ("last", F.col("_t"), True)}
    found = _prefix(base if asked is None else asked, points, keys, at, {"_v": F.max("_x")}, specs, strict, bucket_seconds)
    return base.join(found, [*keys, at], "left")


def asof_summary(base: DataFrame, obs: DataFrame, keys: Sequence[str], at: str, ts: str, value: str, prefix: str,
                 strict: bool = False, digits: int | None = 3, bucket_seconds: int = 86_400) -> DataFrame:
    """Count, first, last, min, max, mean, delta, trend, first and latest time up to ``at``."""
    return asof_summaries(base, obs, keys, at, ts, {prefix: value}, strict, digits, bucket_seconds)


def asof_summaries(base: DataFrame, obs: DataFrame, keys: Sequence[str], at: str, ts: str, values: dict[str, str],
                   strict: bool = False, digits: int | None = 3, bucket_seconds: int = 86_400,
                   asked: DataFrame | None = None) -> DataFrame:
    """``asof_summary`` of several columns of one observation row in one pass; ``values`` maps prefix to column.

    ``asked`` are the questions where they are at hand in a narrower frame than ``base``.
    """
    keys, c = list(keys), F.col
    points = obs.select(*keys, c(ts).alias(at), *[c(v).alias(f"_x_{p}") for p, v in values.items()]).where(
        c(at).isNotNull() & F.coalesce(*[c(f"_x_{p}") for p in values]).isNotNull())
    aggs, specs, shaped = {}, {}, []
    for p in values:
        x = c(f"_x_{p}")
        aggs |= {f"_n_{p}": F.count(x), f"_s_{p}": F.sum(x.cast(SUM_TYPE)), f"_lo_{p}": F.min(x), f"_hi_{p}": F.max(x)}
        n, lo, hi, when = c(f"_n_{p}"), c(f"_lo_{p}"), c(f"_hi_{p}"), F.when(c(f"_n_{p}") > 0, c("_t"))
        specs |= {
            f"_count_{p}": ("sum", n, True), f"_sum_{p}": ("sum", c(f"_s_{p}"), True), f"_first_{p}": ("first", lo, True),
            f"_last_{p}": ("last", hi, True), f"_min_{p}": ("min", lo, True), f"_max_{p}": ("max", hi, True),
            f"_first_time_{p}": ("first", when, True), f"_latest_time_{p}": ("last", when, True),
        }
        mean = F.when(c(f"_count_{p}") > 0, c(f"_sum_{p}").cast("double") / c(f"_count_{p}"))
        shaped += [
            c(f"_count_{p}").alias(f"{p}_observation_count"),
            *[c(f"_{k}_{p}").alias(f"{p}_{k}") for k in ("first", "last", "min", "max")],
            (mean if digits is None else F.round(mean, digits)).alias(f"{p}_mean"),
            F.round(c(f"_last_{p}") - c(f"_first_{p}"), 3).alias(f"{p}_delta"),
            *[c(f"_{k}_{p}").alias(f"{p}_{k}") for k in ("first_time", "latest_time")],
        ]
    found = _prefix(base if asked is None else asked, points, keys, at, aggs, specs, strict, bucket_seconds)
    joined = base.join(found.select(*keys, at, *shaped), [*keys, at], "left")
    return joined.withColumns({f"{p}_observation_count": F.coalesce(f"{p}_observation_count", F.lit(0)) for p in values}).select(
        "*", *[trend(c(f"{p}_delta")).alias(f"{p}_trend_direction") for p in values])


def prior_counts(base: DataFrame, events: DataFrame, keys: Sequence[str], at: str, ts: str, days: int = 365,
                 prefix: str = "prior", bucket_seconds: int = 86_400 * 7) -> DataFrame:
    """Events strictly before ``at``: all time, within ``days`` (lower bound inclusive), latest time.

    The look-back count is a difference of two prefix counts.
    """
    keys = list(keys)
    points = events.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias(at), F.lit(1).alias("_one"))
    back = F.make_dt_interval(F.lit(days))
    asked = base.select(*keys, at).dropna().distinct()
    floor = asked.withColumn(at, F.col(at) - back)
    specs = {"_count": ("sum", F.col("_n"), True), "_latest": ("last", F.col("_t"), True)}
    values = _prefix(asked.unionByName(floor), points, keys, at, {"_n": F.sum("_one")}, specs, True, bucket_seconds)
    low = values.select(*keys, (F.col(at) + back).alias(at), F.col("_count").alias("_below"))
    pair = join_null_safe(values, low, [*keys, at])
    shaped = pair.select(
        *keys, at, F.col("_count").alias(f"{prefix}_count"),
        (F.col("_count") - F.coalesce("_below", F.lit(0))).alias(f"{prefix}_{days}d_count"),
        F.col("_latest").alias(f"{prefix}_latest_time"),
    )
    counts = [f"{prefix}_count", f"{prefix}_{days}d_count"]
    return base.join(shaped, [*keys, at], "left").fillna(0, counts)


def flags_asof(base: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, ts: str, flags: Sequence[str],
               prefix: str = "prior_", bucket_seconds: int = 86_400 * 7) -> DataFrame:
    """Running maximum of 0/1 flags over rows strictly before ``at`` and the latest such time."""
    keys = list(keys)
    points = rows.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias(at), *[F.col(f).alias(f"_x_{f}") for f in flags])
    specs = {f"{prefix}{f}": ("max", F.col(f), True) for f in flags}
    specs[f"{prefix}window_end"] = ("last", F.col("_t"), True)
    found = _prefix(base, points, keys, at, {f: F.max(f"_x_{f}") for f in flags}, specs, True, bucket_seconds)
    return base.join(found, [*keys, at], "left").fillna(0, [f"{prefix}{f}" for f in flags])


def window_summary(base: DataFrame, obs: DataFrame, key: str, low: str, high: str, ts: str,
                   aggs: dict[str, Column]) -> DataFrame:
    """Aggregate the observations of ``key`` inside ``(low, high]`` of its window.

    ``base`` has one window per key (one review per encounter), so each observation meets at most one window. A key's
    observations are spread over several places and combined there before they meet.
    """
    known = base.select(key, low, high).where(F.col(key).isNotNull())
    inside = spread_join(obs.where(F.col(key).isNotNull()), known, [key]).where(
        (F.col(ts) > F.col(low)) & (F.col(ts) <= F.col(high)))
    summed = inside.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])
    return base.join(summed, key, "left")


def guarded_flags(base: DataFrame, flags: DataFrame, keys: Sequence[str], end: str, at: str,
                  names: Sequence[str]) -> DataFrame:
    """Flags of a stay, kept only when the stay ended at or before ``at``."""
    joined = base.join(flags, list(keys), "left")
    safe = F.coalesce(F.col(end) <= F.col(at), F.lit(False))
    return joined.select(
        *base.columns,
        *[F.when(safe, F.coalesce(F.col(n), F.lit(0))).otherwise(0).alias(n) for n in names],
        F.when(safe, F.col(end)).alias(end),
        safe.cast("int").alias("context_available_flag"),
    )

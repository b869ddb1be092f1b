"""Building blocks that stay balanced when one key holds a large share of the rows.

A window ``partitionBy(key)`` sends a whole key to one task. The helpers here give
the same answers from mergeable aggregates, from windows over (key, bucket) with a
small carry per bucket, or from one range-partitioned sort with offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medgrain.session import durable, stored

_EPOCH_TYPES = (T.TimestampType, T.TimestampNTZType)


def micros(column: Column) -> Column:
    """Microseconds since the epoch, for zoned and zone-less timestamps alike."""
    return F.unix_micros(column.cast("timestamp"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match null keys; the key columns of ``left`` are kept."""
    renamed = {k: f"_rk_{k}" for k in keys}
    right = right.withColumnsRenamed(renamed)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(renamed[k])) for k in keys])
    return left.join(right, on, how).drop(*renamed.values())


SPREAD = 16
PLACES, HEAVY_ROWS, HEAVY_SHARE, HEAVY_LEAST = 1 << 16, 500_000, 64, 500


def place_of(keys: Sequence[str]) -> Column:
    """The hash place of a key, one of ``PLACES``, whatever the integer or string type of its columns."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(PLACES)).cast("int")


def heavy_places(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """Places whose keys hold more than ``HEAVY_ROWS`` rows or a ``HEAVY_SHARE``-th of the table, found in one narrow pass.

    Rows meet as at most ``PLACES`` counts a task. All other keys fit a task as they are; which keys count as heavy decides
    only how the work is dealt, never its result.
    """
    counts = df.select(place_of(keys).alias("_place")).groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))
    every = F.sum("_n").over(Window.partitionBy())  # over at most PLACES rows
    most = F.least(F.lit(HEAVY_ROWS), F.greatest(every / HEAVY_SHARE, F.lit(HEAVY_LEAST)))
    return [r["_place"] for r in counts.withColumn("_most", most).where("_n > _most").select("_place").collect()]


def by_key(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """The rows, and the heavy places of their keys; without any, the rows meet by key once for all that follows."""
    heavy = heavy_places(rows, keys)
    return (rows if heavy else rows.repartition(*keys)), heavy


def spread_join(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], parts: int = SPREAD,
                everywhere: bool = False) -> DataFrame:
    """Inner equi-join of many rows to few, with each heavy key of ``rows`` dealt over ``parts`` places.

    A row's place is a hash of the whole row; ``per_key`` is repeated once for each place of a heavy key. What follows
    may group by ``keys``: each place is then reduced on the map side before the keys meet. With ``everywhere``, for a
    ``per_key`` of a few rows, all keys are dealt without looking for the heavy ones.
    """
    heavy = None if everywhere else heavy_places(rows, keys)
    if heavy == []:
        return rows.join(per_key, list(keys))
    hot = F.lit(True) if everywhere else place_of(keys).isin(heavy)
    place = F.when(hot, F.pmod(F.xxhash64(*rows.columns), F.lit(parts))).otherwise(0).cast("int")
    places = F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    placed = rows.withColumn("_spread", place)
    repeated = per_key.withColumn("_spread", F.explode(places))
    return placed.join(repeated, [*keys, "_spread"]).drop("_spread")


def left_join_known(rows: DataFrame, right: DataFrame, keys: Sequence[str], parts: int = 64) -> DataFrame:
    """Left equi-join in which rows with a null key, which match nothing, are dealt over ``parts`` places."""
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    place = F.when(unknown, F.pmod(F.xxhash64(*rows.columns), F.lit(parts)) + 1).otherwise(0).cast("int")
    # Always zero, but not a constant: the optimizer would take a constant out of the join's keys.
    known = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    joined = rows.withColumn("_spread", place).join(right.withColumn("_spread", known), [*keys, "_spread"], "left")
    return joined.select(*rows.columns, *[c for c in right.columns if c not in keys])


def _ascending_key(df: DataFrame, column: str, descending: bool) -> list[Column]:
    """Struct fields whose ascending order is the wanted order, nulls last."""
    value = F.col(column)
    fields = [value.isNull().cast("int")]
    if not descending:
        return [*fields, value]
    kind = df.schema[column].dataType
    if isinstance(kind, _EPOCH_TYPES):
        return [*fields, F.bitwise_not(micros(value))]
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return [*fields, F.bitwise_not(value.cast("bigint"))]
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return [*fields, -value]
    if isinstance(kind, T.BooleanType):
        return [*fields, F.bitwise_not(value.cast("int"))]
    raise TypeError(f"descending order on {kind.simpleString()} is not supported: {column}")


def order_struct(df: DataFrame, order: Sequence[str]) -> Column:
    """One comparable struct for an order such as ``["-start", "event_id"]`` (nulls last)."""
    fields: list[Column] = []
    for item in order:
        fields += _ascending_key(df, item.lstrip("-"), item.startswith("-"))
    return F.struct(*[f.alias(f"o{i}") for i, f in enumerate(fields)])


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str] | None = None, **aggs: Column
) -> DataFrame:
    """The first row of each key in ``order``, plus further aggregates of the whole key.

    ``min_by`` combines on the map side, so no key is ever gathered in one place.
    """
    payload = [c for c in df.columns if c not in keys] if payload is None else list(payload)
    best = F.min_by(F.struct(*payload), order_struct(df, order)).alias("_best")
    grouped = df.groupBy(*keys).agg(best, *[c.alias(n) for n, c in aggs.items()])
    return grouped.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload], *aggs)


def _sort_columns(order: Sequence[str]) -> list[Column]:
    return [
        F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last() for o in order
    ]


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """``row_number()`` within ``keys`` over a total ``order``, with no task for a heavy key.

    Keys that fit a task are numbered by a window; the rows of heavy keys, and all rows without keys, by position.
    """
    if keys:
        heavy = heavy_places(df, keys)
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*_sort_columns(order))).cast("bigint")
        if not heavy:
            return df.select("*", number.alias(name))
        hot = place_of(keys).isin(heavy)
        return df.where(~hot).select("*", number.alias(name)).unionByName(_ranked_by_position(df.where(hot), keys, order, name))
    return _ranked_by_position(df, keys, order, name)


def _ranked_by_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Row numbers from positions in one sort of all rows.

    One range-partitioned sort spreads a large key over many tasks; the sorted rows are
    cut to the shared folder so that their positions stay fixed, and each row's number is
    its position minus the start of its run plus the rows of earlier partitions. The
    offset tables have at most one row per sort partition and key run.
    """
    keys = list(keys)
    placed = durable(
        df.orderBy(*_sort_columns([*keys, *order])).withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_pos", 33))
    runs = placed.groupBy("_part", *keys).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    if not keys:
        runs = F.broadcast(runs)  # one row per sort partition
    joined = join_null_safe(placed, runs, ["_part", *keys])
    number = (F.col("_pos") - F.col("_start") + F.col("_before") + 1).alias(name)
    return joined.select(*df.columns, number)


def ranked_together(df: DataFrame, ids: Sequence[str],
                    specs: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Several row numbers ``(name, keys, order)``, each of which may use the ones before it, for rows that ``ids`` name.

    Only ``ids``, the keys and the order columns are sorted and cut; the numbers are joined back once.
    """
    names = [name for name, _, _ in specs]
    needed = dict.fromkeys([*ids, *[c for _, keys, order in specs for c in (*keys, *[o.lstrip("-") for o in order])
                                    if c not in names]])
    narrow = df.select(*needed)
    for i, (name, keys, order) in enumerate(specs):
        # The next sort reads its rows several times: to find heavy keys, to sample and to sort.
        narrow = ranked(stored(narrow) if i else narrow, keys, order, name)
    return join_null_safe(df, durable(narrow.select(*ids, *names)), ids)


def _local(kind: str, column: Column) -> Column:
    if kind in ("sum", "count"):
        return F.sum(column)
    return {"max": F.max, "min": F.min}[kind](column) if kind in ("max", "min") else (
        F.first(column, ignorenulls=True) if kind == "first" else F.last(column, ignorenulls=True)
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    specs: dict[str, tuple[str, Column, bool]],
    heavy: Sequence[int] | None = None,
) -> DataFrame:
    """Running aggregates per key: one window for the keys that fit a task, carried prefixes for heavy ones.

    ``heavy`` are the heavy places of ``df`` where the caller knows them. Each spec is as in ``_carried``.
    """
    keys = list(keys)
    if not keys:
        return _carried(df, keys, order, bucket, specs)
    heavy = heavy_places(df, keys) if heavy is None else heavy
    if not heavy:
        return _windowed(df, keys, order, specs)
    hot = place_of(keys).isin(list(heavy))
    return _windowed(df.where(~hot), keys, order, specs).unionByName(_carried(df.where(hot), keys, order, bucket, specs))


def _windowed(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              specs: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """Running aggregates by one window, a key a task."""
    by = Window.partitionBy(*keys).orderBy(*_sort_columns(order))
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    found = {n: _local(k, c).over(upto if now else before) for n, (k, c, now) in specs.items()}
    return df.select("*", *[
        (F.coalesce(v, F.lit(0)) if specs[n][0] in ("sum", "count") else v).alias(n) for n, v in found.items()])


def _carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
             specs: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """Running aggregates computed per (key, bucket) with carried prefixes.

    ``bucket`` must be non-decreasing in ``order``. Each spec is ``(kind, column,
    include_current)`` with kind sum, min, max, first or last. Only the totals of the
    buckets, never the rows of a key, meet in one window.
    """
    keys, part = list(keys), [*keys, "_bucket"]
    work = df.withColumn("_bucket", bucket)
    sort = _sort_columns(order)
    upto = Window.partitionBy(*part).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    local = work.select(
        "*", *[_local(k, c).over(upto if now else before).alias(f"_l_{n}") for n, (k, c, now) in specs.items()]
    )
    at = order_struct(df, order)

    def total(kind: str, column: Column) -> Column:
        if kind == "sum":
            return F.sum(column)
        if kind in ("min", "max"):
            return _local(kind, column)
        pick = F.min_by if kind == "first" else F.max_by
        return pick(column, F.when(column.isNotNull(), at))

    totals = work.groupBy(*part).agg(*[total(k, c).alias(f"_t_{n}") for n, (k, c, _) in specs.items()])
    buckets = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *part, *[_local(k, F.col(f"_t_{n}")).over(buckets).alias(f"_c_{n}") for n, (k, _, _) in specs.items()]
    )
    joined = join_null_safe(local, carried, part)

    def merged(name: str, kind: str) -> Column:
        carry, here = F.col(f"_c_{name}"), F.col(f"_l_{name}")
        if kind == "sum":
            zero = F.lit(0)
            return F.coalesce(carry, zero) + F.coalesce(here, zero)
        if kind == "max":
            return F.greatest(carry, here)
        if kind == "min":
            return F.least(carry, here)
        return F.coalesce(carry, here) if kind == "first" else F.coalesce(here, carry)

    return joined.select(*df.columns, *[merged(n, k).alias(n) for n, (k, _, _) in specs.items()])


def time_bucket(column: str, seconds: int = 86_400) -> Column:
    """Fixed-width time bucket; narrow it when a key is dense in time."""
    return F.floor(micros(F.col(column)) / F.lit(seconds * 1_000_000)).cast("bigint")

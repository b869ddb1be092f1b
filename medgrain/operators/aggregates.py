"""Group summaries. All are mergeable aggregates; none gathers the rows of a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medgrain import constants as K
from medgrain.functions.clinical import diagnosis_flag, trend
from medgrain.operators.asof import SUM_TYPE
from medgrain.operators.skew import join_null_safe, order_struct


def count_if(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, 1)), F.lit(0)).cast("bigint")


def any_flag(test: Column) -> Column:
    return F.coalesce(F.max(F.when(test, 1).otherwise(0)), F.lit(0))


def exact_sum(column: Column) -> Column:
    return F.sum(column.cast(SUM_TYPE)).cast("double")


def exact_mean(column: Column, digits: int | None = 3) -> Column:
    mean = F.sum(column.cast(SUM_TYPE)).cast("double") / F.count(column)
    return mean if digits is None else F.round(mean, digits)


def collapse_linked(df: DataFrame, keys: Sequence[str], start: str, stop: str, first_field: str, last_field: str,
                    row_id: str) -> DataFrame:
    """One row per key from consecutive segments: span, first and last known fields, latest id."""
    by_start = order_struct(df, [start, stop, row_id])
    by_stop = order_struct(df, [stop, start, row_id])
    return df.groupBy(*keys).agg(
        F.min(start).alias(start), F.max(stop).alias(stop),
        F.min_by(first_field, F.when(F.col(first_field).isNotNull(), by_start)).alias(first_field),
        F.max_by(last_field, F.when(F.col(last_field).isNotNull(), by_stop)).alias(last_field),
        F.max_by(row_id, by_stop).alias(row_id),
        F.count(F.lit(1)).alias("linked_segment_count"),
    )


def lab_summary(labs: DataFrame, keys: Sequence[str], ts: str, value: str, item: str, prefix: str,
                digits: int | None = 3) -> DataFrame:
    """First, last, min, max, mean, delta and trend of a value family per key.

    First and last need a time; a value without one still counts for min, max and mean.
    """
    rows = labs.where(F.col(value).isNotNull())
    at = F.when(F.col(ts).isNotNull(), order_struct(rows, [ts, item, value]))
    out = rows.groupBy(*keys).agg(
        F.min_by(value, at).alias(f"{prefix}_first"), F.max_by(value, at).alias(f"{prefix}_last"),
        F.min(value).alias(f"{prefix}_min"), F.max(value).alias(f"{prefix}_max"),
        exact_mean(F.col(value), digits).alias(f"{prefix}_mean"),
    )
    delta = F.round(F.col(f"{prefix}_last") - F.col(f"{prefix}_first"), 3)
    return out.withColumn(f"{prefix}_delta", delta).withColumn(
        f"{prefix}_trend_direction", trend(F.col(f"{prefix}_delta"))
    )


def value_range(df: DataFrame, keys: Sequence[str], columns: dict[str, str], digits: int | None = 3) -> DataFrame:
    """min, max and mean of several columns per key; ``columns`` maps column to prefix."""
    aggs: list[Column] = []
    for column, prefix in columns.items():
        c = F.col(column)
        aggs += [F.min(c).alias(f"{prefix}_min"), F.max(c).alias(f"{prefix}_max"),
                 exact_mean(c, digits).alias(f"{prefix}_mean")]
    return df.groupBy(*keys).agg(*aggs)


def diagnosis_flags(df: DataFrame, keys: Sequence[str], code: str = "icd_code", version: str = "icd_version",
                    prefixes: dict | None = None, groups: dict | None = None) -> DataFrame:
    """0/1 flags per key from code prefixes, and the risk groups over them."""
    prefixes = K.DIAGNOSIS_PREFIXES if prefixes is None else prefixes
    groups = K.DIAGNOSIS_RISK_GROUPS if groups is None else groups
    flags = df.groupBy(*keys).agg(
        *[F.max(diagnosis_flag(F.col(code), F.col(version), p)).alias(n) for n, p in prefixes.items()]
    )
    return flags.select(
        "*", *[(F.greatest(*members) if len(members) > 1 else F.col(members[0])).alias(g)
               for g, members in groups.items()]
    )


def burden_counts(df: DataFrame, keys: Sequence[str], medication: str, medication_class: str, active: str,
                  classes: Sequence[str] = K.SUPPORTED_CLASSES, counted: DataFrame | None = None) -> DataFrame:
    """Attach active-medication counts per key: distinct, per class, supported, own class, duplicates.

    ``counted`` has the same rows as ``df`` where they are at hand in a narrower or stored frame. The rows of a key and
    medication merge before the key's do.
    """
    counts = burden_totals(df if counted is None else counted, keys, medication, medication_class, active, classes)
    return with_burden(join_null_safe(df, counts, keys), medication_class, active, classes)


def burden_totals(rows: DataFrame, keys: Sequence[str], medication: str, medication_class: str, active: str,
                  classes: Sequence[str] = K.SUPPORTED_CLASSES) -> DataFrame:
    """Active medications per key: distinct ones and those of each class."""
    on = F.col(active) == 1
    own = [count_if(on & (F.col(medication_class) == c)).alias(f"current_{c}_count") for c in classes]
    per = rows.groupBy(*keys, medication).agg(
        *own, F.max(F.when(on & F.col(medication).isNotNull(), 1).otherwise(0)).alias("_on"))
    return per.groupBy(*keys).agg(
        *[F.sum(f"current_{c}_count").alias(f"current_{c}_count") for c in classes],
        F.sum("_on").alias("exact_current_medication_count"))


def with_burden(joined: DataFrame, medication_class: str, active: str, classes: Sequence[str] = K.SUPPORTED_CLASSES) -> DataFrame:
    """Rows that have their key's totals, with the counts of their own class and the duplicate flags."""
    on = F.col(active) == 1
    joined = joined.fillna(0, ["exact_current_medication_count"])
    supported = reduce(lambda a, b: a + b, [F.col(f"current_{c}_count") for c in classes])
    same = F.lit(0).cast("bigint")
    for c in classes:
        same = F.when(F.col(medication_class) == c, F.col(f"current_{c}_count")).otherwise(same)
    duplicate = on & (F.col("row_same_class_current_count") > 1)
    return (
        joined.withColumn("current_supported_class_count", supported)
        .withColumn("row_same_class_current_count", same)
        .withColumn("same_class_duplicate_therapy_flag", F.coalesce(duplicate.cast("int"), F.lit(0)))
        .withColumn(
            "same_class_duplicate_therapy_signal_count",
            F.when(duplicate, F.col("row_same_class_current_count")).otherwise(0),
        )
    )


def by_precedence(column: str, order: Sequence[str], default: str | None = None) -> Column:
    """Aggregate: the value present in the group that comes first in ``order``."""
    rank = F.lit(None).cast("int")
    for i, value in reversed(list(enumerate(order))):
        rank = F.when(F.col(column) == value, i).otherwise(rank)
    best = F.min(rank)
    picked = F.get(F.array(*[F.lit(v) for v in order]), best)
    return F.coalesce(picked, F.lit(default)) if default is not None else picked


def single_or(column: str, fallback: Column | str) -> Column:
    """Aggregate: the only distinct value of a group, else the fallback."""
    value = F.nullif(F.col(column), F.lit(""))
    alone = F.min(value).eqNullSafe(F.max(value)) & F.min(value).isNotNull()
    return F.when(alone, F.min(value)).otherwise(F.lit(fallback) if isinstance(fallback, str) else fallback)


def dominant(df: DataFrame, keys: Sequence[str], column: str, out: str, ignore: Sequence[str] = ("unresolved",)) -> DataFrame:
    """Most frequent value per key (ties: alphabetical), ignoring some values."""
    rows = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*ignore))
    counts = rows.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by(column, F.struct((-F.col("_n")).alias("n"), F.col(column))).alias(out)
    )


def reason_rows(df: DataFrame, keys: Sequence[str], score: str, reasons: str, order: Sequence[str]) -> DataFrame:
    """All distinct reasons of the top-score rows, a row each: keys, ``position`` of first appearance from 1, ``reason``."""
    top = df.groupBy(*keys).agg(F.max(score).alias("_top"))
    rows = join_null_safe(df.select(*keys, score, reasons, *[o.lstrip("-") for o in order]), top, keys)
    rows = rows.where(F.col(score) == F.col("_top"))
    long = rows.select(*keys, order_struct(rows, order).alias("_o"), F.posexplode(reasons).alias("_p", "_reason"))
    first = long.groupBy(*keys, "_reason").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "_reason"))
    return first.select(*keys, place.alias("position"), F.col("_reason").alias("reason"))


def first_reasons(df: DataFrame, keys: Sequence[str], score: str, reasons: str, order: Sequence[str],
                  limit: int | None = None) -> DataFrame:
    """``reason_rows`` as one list a key: all of them, or the first ``limit`` where the caller wants a short field."""
    rows = reason_rows(df, keys, score, reasons, order)
    if limit is not None:
        rows = rows.where(F.col("position") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("position", "reason")))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda x: x["reason"]).alias(reasons))


def qc_profile(df: DataFrame, keys: Sequence[str], subject: str, null_columns: Sequence[str]) -> DataFrame:
    """One row: rows, distinct subjects, null counts, rows on duplicated keys (``subject`` is one of the keys)."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[count_if(F.col(c).isNull()).alias(f"_z_{c}") for c in null_columns]
    )
    zero = F.lit(0)
    return per_key.agg(
        F.coalesce(F.sum("_n"), zero).alias("row_count"), F.count_distinct(subject).alias("subject_count"),
        *[F.coalesce(F.sum(f"_z_{c}"), zero).alias(f"{c}_null_count") for c in null_columns],
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), zero).alias("duplicate_key_rows"),
    )


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def json_set_union(df: DataFrame, keys: Sequence[str], column: str, out: str,
                   limit_to: Sequence[str] | None = None) -> DataFrame:
    """``keys, out``: the sorted distinct items of a key's JSON lists, a fixed vocabulary (table names, tags).

    Distinct items are found before the keys meet, so a key is as long as its vocabulary, not as its lists.
    """
    items = df.select(*keys, F.explode_outer(F.from_json(F.col(column), "array<string>")).alias("_item"))
    if limit_to:
        items = items.withColumn("_item", F.when(F.col("_item").isin(*limit_to), F.col("_item")))
    return items.distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("_item")).alias(out))


def top_row_summary(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str], score: str,
                    flagged: Column, encounter: str) -> DataFrame:
    """The top row of each key with its score, the flagged rows and the distinct encounters."""
    from medgrain.operators.skew import first_per_key

    return first_per_key(
        df, keys, order, payload, top=F.max(score), flagged=count_if(flagged), encounters=F.count_distinct(encounter)
    )

"""Time rules: activity at a review time, review-time choice, policies, durations, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medgrain import constants as K
from medgrain.operators.skew import micros

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def fmt_ts(column: Column) -> Column:
    return F.date_format(column, TIMESTAMP_FORMAT)


def parse_ts(column: Column, pattern: str = TIMESTAMP_FORMAT) -> Column:
    """Zone-less timestamp, null when the text does not parse."""
    return F.try_to_timestamp(column, F.lit(pattern)).cast("timestamp_ntz")


def hours_between(start: Column, end: Column, digits: int = 3) -> Column:
    return F.round((micros(end) - micros(start)) / F.lit(3.6e9), digits)


def days_between(start: Column, end: Column, digits: int = 3) -> Column:
    return F.round((micros(end) - micros(start)) / F.lit(8.64e10), digits)


def first_valid(*columns: Column) -> Column:
    return F.coalesce(*columns)


def latest_valid(*columns: Column) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def active_interval(start: Column, stop: Column, at: Column) -> Column:
    """Closed interval test; an open stop stays active, a null start never is."""
    return F.coalesce((start <= at) & (stop.isNull() | (stop >= at)), F.lit(False))


def active_event(kind: Column, start: Column, stop: Column, at: Column, continued: Column) -> Column:
    """Point kinds only at equality, home rows only when continued, other kinds as intervals."""
    interval = active_interval(start, stop, at)
    return (
        F.when(kind.isin(*K.POINT_KINDS), F.coalesce(start == at, F.lit(False)))
        .when(kind == K.KIND_HOME, (F.coalesce(continued, F.lit(0)) == 1) & interval)
        .otherwise(interval)
    )


def in_window(column: Column, low: Column, high: Column) -> Column:
    """``(low, high]``; null never falls in."""
    return F.coalesce((column > low) & (column <= high), F.lit(False))


def encounter_id(hadm: Column, stay: Column, subject: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("hadm:"), hadm.cast("string")),
        F.concat(F.lit("stay:"), stay.cast("string")),
        F.concat(F.lit("subject:"), subject.cast("string")),
    )


def review_choice(admin: Column, order: Column, lab: Column, vitals: Column, boundary: Column) -> tuple[Column, Column]:
    """Review time by source priority (not the latest overall) and the source that won."""
    time = F.coalesce(admin, order, lab, vitals, boundary)
    source = (
        F.when(admin.isNotNull(), K.SOURCE_ADMIN)
        .when(order.isNotNull(), K.SOURCE_ORDER)
        .when(lab.isNotNull(), K.SOURCE_LAB)
        .when(vitals.isNotNull(), K.SOURCE_VITALS)
        .when(boundary.isNotNull(), K.SOURCE_END)
        .otherwise(K.SOURCE_BOUNDARY)
    )
    return time, source


def stay_review_time(strategy: str, intime: Column, outtime: Column, admit: Column, disch: Column,
                     end: Column, start: Column) -> Column:
    """Review time of the ``ed`` and ``hospital`` strategies."""
    if strategy == "ed":
        return F.coalesce(outtime, intime, end, start)
    if strategy == "hospital":
        return F.coalesce(disch, admit, outtime, end, start)
    raise ValueError(f"unknown strategy: {strategy}")


def capped_review(candidate: Column, source: Column, boundary: Column, policy: str) -> dict[str, Column]:
    """Apply a review-time policy; the bounded policy fails on a time after the boundary."""
    if policy not in K.POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    late = F.coalesce(candidate > boundary, F.lit(False))
    if policy == "discharge_capped_latest_available":
        return {
            "review_timestamp": F.when(late, boundary).otherwise(candidate),
            "review_timestamp_source": F.when(late, K.SOURCE_BOUNDARY).otherwise(source),
            "review_time_capped_to_discharge_flag": late.cast("int"),
        }
    if policy == "bounded_latest_available":
        error = F.raise_error(F.lit("review time after discharge boundary")).cast("timestamp_ntz")
        candidate = F.when(late, error).otherwise(candidate)
    return {
        "review_timestamp": candidate,
        "review_timestamp_source": source,
        "review_time_capped_to_discharge_flag": F.lit(0),
    }

"""Small report tables over large frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medgrain.operators.aggregates import count_if


def distribution(df: DataFrame, by: Sequence[str], subject: str) -> DataFrame:
    """Rows and distinct subjects per band, source or other grouping."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(subject).alias("subjects"))


def target_summary(df: DataFrame, level: str, status: str, included: str, subject: str) -> DataFrame:
    """Rows, included rows and subjects per target level and review status."""
    return df.groupBy(F.coalesce(level, F.lit("missing")).alias("level"), F.col(status).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col(included) == 1).alias("included"),
        F.count_distinct(subject).alias("subjects"),
    )


def blind_summary(df: DataFrame, reasons: str, band: str, subject: str) -> DataFrame:
    """Candidate rows and subjects per reason and band."""
    rows = df.select(F.explode(reasons).alias("reason"), F.col(band).alias("band"), subject)
    return rows.groupBy("reason", "band").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(subject).alias("subjects"))

"""Medication-name keys, schedule text and class flags as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medgrain import constants as K


def blank_to_null(column: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(column.cast("string")), F.lit(""))


def _words(column: Column) -> Column:
    return F.split(column, r"\s+")


def normalize_name(column: Column) -> Column:
    """Lower-case matching key without form and unit words; placeholders become null."""
    text = F.lower(F.trim(column.cast("string")))
    text = F.when(~text.isin(*K.NAME_NULL_WORDS), text)
    text = F.regexp_replace(F.regexp_replace(text, r"^\*+", ""), "[^a-z0-9]+", " ")
    kept = F.filter(_words(text), lambda w: (w != "") & ~w.isin(*K.NAME_STOPWORDS))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def match_key(column: Column) -> Column:
    """The name without purely numeric words."""
    kept = F.filter(
        _words(F.trim(column.cast("string"))), lambda w: (w != "") & ~w.rlike(r"^\d+(\.\d+)?$")
    )
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def query_text(raw: Column) -> Column:
    """Raw medication text with single spaces and no leading stars; placeholders become null."""
    text = F.trim(raw.cast("string"))
    text = F.when((text != "") & ~F.lower(text).isin(*K.QUERY_NULL_WORDS), text)
    text = F.regexp_replace(F.regexp_replace(text, r"^\*+", ""), r"\s+", " ")
    return F.nullif(text, F.lit(""))


def query_key(*candidates: Column) -> Column:
    """First candidate with any text in it."""
    return F.coalesce(*[blank_to_null(c) for c in candidates])


def schedule(frequency: Column, status: Column) -> Column:
    """``prn``, ``scheduled`` or ``unknown`` from order text."""

    def clean(c: Column) -> Column:
        return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), F.lit(""))

    text = F.concat_ws(" ", clean(frequency), clean(status))
    return (
        F.when(text == "", "unknown")
        .when(text.rlike(K.PRN_PATTERN), "prn")
        .when(text.rlike(r"^\d+$") | text.rlike(K.SCHEDULED_PATTERN), "scheduled")
        .otherwise("unknown")
    )


def contains_any(column: Column, words: Iterable[str]) -> Column:
    """1 when the lower-cased text contains any of the words."""
    return F.coalesce(F.lower(column).rlike("|".join(words)), F.lit(False)).cast("int")


def keyword_flags(column: Column, keywords: dict[str, Sequence[str]] | None = None) -> dict[str, Column]:
    """One 0/1 column per class from keywords in the drug text."""
    return {
        f"{name}_flag": contains_any(column, words).alias(f"{name}_flag")
        for name, words in (keywords or K.CLASS_KEYWORDS).items()
    }


def first_text(*columns: Column) -> Column:
    """First non-empty of several texts, lower-cased, else the empty string."""
    return F.coalesce(*[F.nullif(F.lower(c.cast("string")), F.lit("")) for c in columns], F.lit(""))


def label_candidates(column: Column) -> Column:
    """The label, its ``/`` parts, and each of these without a salt suffix, in that order."""
    label = F.lower(blank_to_null(column))
    parts = F.when(
        F.contains(label, F.lit("/")),
        F.filter(F.transform(F.split(label, "/"), F.trim), lambda p: p != ""),
    ).otherwise(F.array().cast("array<string>"))
    stems = F.concat(F.array(label), parts)
    suffix = "(" + "|".join(s.strip() for s in K.SALT_SUFFIXES) + ")$"
    with_bare = F.flatten(
        F.transform(
            stems,
            lambda c: F.array(c, F.nullif(F.trim(F.regexp_replace(c, " " + suffix, "")), F.lit(""))),
        )
    )
    return F.array_distinct(F.array_compact(with_bare))


def ingredient_classes(spark: SparkSession, mapping: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The ingredient dictionary as a small table ``(ingredient, class_label)``."""
    rows = [(i, c) for c, items in (mapping or K.CLASS_INGREDIENTS).items() for i in items]
    return spark.createDataFrame(rows, "ingredient string, class_label string")


def class_labels(df: DataFrame, label: str, dictionary: DataFrame, out: str = "class_labels") -> DataFrame:
    """Attach the sorted set of dictionary classes of a label, as ``a|b``, else ``unresolved``.

    Labels repeat, so the dictionary join runs on the distinct labels only.
    """
    labels = df.select(F.col(label).alias("_cl_label")).where(F.col("_cl_label").isNotNull()).distinct()
    hits = (
        labels.select("_cl_label", F.explode(label_candidates(F.col("_cl_label"))).alias("ingredient"))
        .join(dictionary, "ingredient")
        .groupBy("_cl_label")
        .agg(F.array_join(F.array_sort(F.collect_set("class_label")), "|").alias(out))
    )
    joined = df.join(hits, F.col(label) == F.col("_cl_label"), "left").drop("_cl_label")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit("unresolved")))

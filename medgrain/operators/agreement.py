"""Agreement and model metrics from confusion counts and distinct-score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medgrain import constants as K
from medgrain.functions.scoring import level_rank
from medgrain.operators.aggregates import count_if, rate
from medgrain.operators.quantiles import with_quantile
from medgrain.operators.skew import running


def confusion_columns(truth: Column, predicted: Column, levels: Sequence[str] = K.LEVELS) -> dict[str, Column]:
    """Counts ``n_<truth>_<predicted>`` as aggregate columns."""
    return {
        f"n_{a}_{b}": count_if((truth == a) & (predicted == b)).alias(f"n_{a}_{b}") for a in levels for b in levels
    }


def weighted_kappa(levels: Sequence[str] = K.LEVELS) -> Column:
    """Quadratic-weighted kappa over columns ``n_<truth>_<predicted>``; null without spread."""
    cell = {(a, b): F.col(f"n_{a}_{b}") for a in levels for b in levels}
    total = sum(cell.values(), F.lit(0))
    rows = {a: sum((cell[a, b] for b in levels), F.lit(0)) for a in levels}
    cols = {b: sum((cell[a, b] for a in levels), F.lit(0)) for b in levels}
    weight = {(a, b): (i - j) ** 2 for i, a in enumerate(levels) for j, b in enumerate(levels)}
    seen = sum((cell[p] * w for p, w in weight.items() if w), F.lit(0))
    chance = sum((rows[a] * cols[b] * w for (a, b), w in weight.items() if w), F.lit(0))
    return F.when(chance > 0, F.lit(1.0) - (seen * total).cast("double") / chance.cast("double"))


def ordinal_summary(df: DataFrame, left_level: str, right_level: str, left_score: str | None = None,
                    right_score: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Same-level, exact-score, off-by-one and severe rates, errors, confusion and kappa."""
    left, right = F.col(left_level), F.col(right_level)
    distance = F.abs(level_rank(left) - level_rank(right))
    aggs: list[Column] = [
        F.count(F.lit(1)).alias("row_count"), F.count(distance).alias("comparable_level_rows"),
        count_if(distance == 0).alias("same_level_count"), count_if(distance == 1).alias("off_by_one_count"),
        count_if(distance == 2).alias("severe_count"), *confusion_columns(left, right).values(),
    ]
    if left_score and right_score:
        error = F.abs(F.col(left_score).cast("double") - F.col(right_score).cast("double"))
        aggs += [
            F.count(error).alias("comparable_score_rows"), count_if(F.round(error, 12) == 0).alias("exact_score_count"),
            (F.sum(error.cast("decimal(28,6)")).cast("double") / F.count(error)).alias("mean_abs_score_error"),
        ]
    grouped = df.groupBy(*by).agg(*aggs)
    if left_score and right_score:
        grouped = with_quantile(grouped, df.select(*by, error.alias("_error")), by, "_error", 0.5, "median_abs_score_error")
    n = F.col("comparable_level_rows")
    return grouped.select(
        "*", rate(F.col("same_level_count"), n).alias("same_level_rate"),
        rate(F.col("off_by_one_count"), n).alias("off_by_one_rate"),
        rate(F.col("severe_count"), n).alias("severe_rate"), weighted_kappa().alias("weighted_kappa_quadratic"),
    )


def one_vs_rest(df: DataFrame, truth: str, predicted: str, levels: Sequence[str] = K.LEVELS) -> DataFrame:
    """tp, tn, fp, fn and rates per level, from the nine confusion counts."""
    cells = df.agg(*confusion_columns(F.col(truth), F.col(predicted), levels).values())

    def counts(level: str) -> Column:
        def add(test) -> Column:
            return sum((F.col(f"n_{a}_{b}") for a in levels for b in levels if test(a, b)), F.lit(0).cast("bigint"))

        return F.struct(
            F.lit(level).alias("level"),
            add(lambda a, b: a == level and b == level).alias("tp"),
            add(lambda a, b: a != level and b != level).alias("tn"),
            add(lambda a, b: a != level and b == level).alias("fp"),
            add(lambda a, b: a == level and b != level).alias("fn"),
        )

    rows = cells.select(F.inline(F.array(*[counts(v) for v in levels])))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return rows.select(
        "*", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
        rate(tn, tn + fp).alias("specificity"),
    )


def group_agreement(df: DataFrame, column: str, same: str) -> DataFrame:
    """Agreement count and rate per value of any column."""
    name = F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("group_value")
    grouped = df.groupBy(name).agg(
        F.count(F.lit(1)).alias("row_count"), count_if(F.col(same) == 1).alias("same_level_count")
    )
    return grouped.withColumn("same_level_rate", F.col("same_level_count") / F.col("row_count"))


def top_disagreements(df: DataFrame, same: str, order: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` worst disagreements, a report field."""
    from medgrain.operators.ordering import ordered

    return ordered(df.where(F.coalesce(F.col(same), F.lit(0)) == 0), order).limit(k)


def binary_metrics(df: DataFrame, label: str, predicted: str, score: str, bucket: Column,
                   by: Sequence[str] = ()) -> DataFrame:
    """Confusion, balanced accuracy, precision, recall, F1, average precision, ROC AUC, Brier.

    Ranking metrics come from the table of distinct scores: with p and n the positives and
    negatives at one score, walked from the highest score down. ``bucket`` groups scores
    into ranges and must not increase as the score falls; nulls mark undefined metrics.
    """
    y, p, s = F.col(label), F.col(predicted), F.col(score)
    by = list(by)
    points = df.groupBy(*by, score).agg(
        count_if(y == 1).alias("_p"), count_if(y == 0).alias("_n"),
        count_if((y == 1) & (p == 1)).alias("_tp"), count_if((y == 0) & (p == 1)).alias("_fp"),
        F.sum(F.pow(s - y, F.lit(2.0)).cast("decimal(38,12)")).alias("_b"),
    ).withColumn("_down", -s)
    walk = running(points, by, ["_down"], bucket,
                   {"_cp": ("sum", F.col("_p"), True), "_cn": ("sum", F.col("_n"), True)})
    tie = F.col("_n") * (F.col("_cp") - F.col("_p")) + F.col("_n") * F.col("_p") / F.lit(2)
    precision_at = F.col("_p") * F.col("_cp") / (F.col("_cp") + F.col("_cn"))
    out = walk.groupBy(*by).agg(
        F.sum("_p").alias("positive_count"), F.sum("_n").alias("negative_count"), F.sum("_tp").alias("tp"),
        F.sum("_fp").alias("fp"), F.sum(tie.cast("decimal(38,1)")).cast("double").alias("_pairs"),
        F.sum(precision_at.cast("decimal(38,12)")).cast("double").alias("_ap"),
        F.sum("_b").cast("double").alias("_brier"),
    )
    pos, neg, tp, fp = (F.col(c) for c in ("positive_count", "negative_count", "tp", "fp"))
    fn, tn = pos - tp, neg - fp
    both = (pos > 0) & (neg > 0)
    precision, recall = rate(tp, tp + fp), rate(tp, pos)
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(F.lit(2.0) * precision * recall / (precision + recall))
    return out.select(
        *by, "positive_count", "negative_count", "tp", "fp", fn.alias("fn"), tn.alias("tn"),
        F.when(both, (recall + tn / neg) / F.lit(2.0)).alias("balanced_accuracy"), precision.alias("precision"),
        recall.alias("recall"), f1.alias("f1"), F.when(both, F.col("_ap") / pos).alias("pr_auc"),
        F.when(both, F.col("_pairs") / (pos * neg)).alias("roc_auc"),
        rate(F.col("_brier"), (pos + neg).cast("double")).alias("brier_score"),
    )


def ordinal_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = (),
                    levels: Sequence[str] = K.LEVELS) -> DataFrame:
    """Accuracy, balanced accuracy over present levels, macro P/R/F1, kappa and level errors."""
    by = list(by)
    t = df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *confusion_columns(F.col(truth), F.col(predicted)).values())
    n = {(a, b): F.col(f"n_{a}_{b}") for a in levels for b in levels}
    rows = {a: sum((n[a, b] for b in levels), F.lit(0)) for a in levels}
    cols = {b: sum((n[a, b] for a in levels), F.lit(0)) for b in levels}
    zero = F.lit(0.0)
    recall = {a: F.coalesce(rate(n[a, a], rows[a]), zero) for a in levels}
    precision = {a: F.coalesce(rate(n[a, a], cols[a]), zero) for a in levels}
    f1 = {
        a: F.when(precision[a] + recall[a] > 0, F.lit(2.0) * precision[a] * recall[a] / (precision[a] + recall[a]))
        .otherwise(zero)
        for a in levels
    }
    present = sum(((rows[a] > 0).cast("int") for a in levels), F.lit(0))
    mean = lambda d: sum(d.values(), zero) / F.lit(float(len(levels)))
    place = {a: i for i, a in enumerate(levels)}
    err = lambda k: sum((c for (a, b), c in n.items() if abs(place[a] - place[b]) == k), F.lit(0))
    total = F.col("row_count")
    spread = present >= 2
    return t.select(
        *by, "row_count", (sum((n[a, a] for a in levels), F.lit(0)) / total).alias("accuracy"),
        F.when(spread, sum(recall.values(), zero) / present).alias("balanced_accuracy"),
        mean(precision).alias("macro_precision"), mean(recall).alias("macro_recall"), mean(f1).alias("macro_f1"),
        F.when(spread, weighted_kappa(levels)).alias("weighted_kappa_quadratic"),
        ((err(1) + F.lit(2) * err(2)) / total).alias("mean_absolute_level_error"),
        (err(1) / total).alias("off_by_one_rate"), (err(2) / total).alias("severe_disagreement_rate"),
    )

"""Supervised frames and baseline models on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medgrain import constants as K
from medgrain.operators.aggregates import count_if
from medgrain.operators.joins import checked_join
from medgrain.operators.quantiles import exact_quantile
from medgrain.sources.storage import scratch

MISSING = "__missing__"
SUSPICIOUS = ("label__", "benchmark__", "meta__", "prediction__", "score", "outcome")
MIN_CLASS_ROWS = 3
BINARY_C = 0.1


def supervised_frame(data: DataFrame, splits: DataFrame, keys: Sequence[str], row_id: str, eligible: str,
                     features: Sequence[str]) -> DataFrame:
    """Eligible rows with exactly one split, a unique row id and finite features."""
    bad = [f for f in features if any(f.removeprefix("feature__").startswith(s) for s in SUSPICIOUS[:4])]
    if bad:
        raise ValueError(f"suspicious feature names: {bad}")
    joined = checked_join(data.where(F.col(eligible) == 1), splits.select(*keys, "split_partition"), list(keys), "inner")
    numeric = [n for n, t in joined.dtypes if n in features and t in ("double", "float")]
    infinite = F.lit(False)
    for n in numeric:
        infinite = infinite | F.coalesce(F.abs(F.col(n)) == float("inf"), F.lit(False))
    guard = F.when(infinite, F.raise_error(F.lit("infinite feature value")).cast("int")).otherwise(F.lit(1))
    return joined.where(guard == 1)


@dataclass(frozen=True)
class Preparation:
    """Train-only column decisions and the fitted transformers."""

    numeric: list[str]
    categorical: list[str]
    dropped_all_missing: list[str]
    dropped_constant: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    model: PipelineModel | None = field(default=None, compare=False)


def column_profile(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: known count, whether it varies, whether it is numeric; one aggregation."""
    kinds = dict(train.dtypes)
    cols = []
    for i, f in enumerate(features):
        cols += [F.count(f).alias(f"_k{i}"),
                 F.coalesce(F.min(f) != F.max(f), F.lit(False)).cast("int").alias(f"_v{i}"),
                 count_if(F.col(f).isNull()).alias(f"_n{i}")]
    one = train.agg(*cols)
    rows = F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.lit("categorical" if kinds[f] == "string" else "numeric").alias("kind"),
            F.col(f"_k{i}").alias("known_count"), F.col(f"_n{i}").alias("null_count"),
            F.when(F.col(f"_k{i}") == 0, "all_missing")
            .when((F.col(f"_v{i}") == 0) & ((F.col(f"_n{i}") == 0) | F.lit(kinds[f] != "string")), "constant")
            .otherwise("kept").alias("decision"),
        )
        for i, f in enumerate(features)
    ])
    return one.select(F.inline(rows))


def _shape(df: DataFrame, medians: dict[str, float], categorical: Sequence[str]) -> DataFrame:
    return df.select(
        "*", *[F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(f"_num_{c}") for c, m in medians.items()],
        *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(f"_cat_{c}") for c in categorical],
    )


def train_medians(train: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """Exact medians of the known values, all columns in one pass over long rows."""
    if not numeric:
        return {}
    long = train.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in numeric])))
    return {r["name"]: r["m"] for r in exact_quantile(long, ["name"], "v", 0.5, "m").collect()}  # one row per feature


def fit_preparation(train: DataFrame, features: Sequence[str], scale: bool = False) -> Preparation:
    """Median imputation and one-hot encoding learnt from the training rows only."""
    decided = column_profile(train, features).collect()  # one row per feature
    kept = {"numeric": [], "categorical": []}
    for r in decided:
        if r["decision"] == "kept":
            kept[r["kind"]].append(r["feature"])
    numeric, categorical = kept["numeric"], kept["categorical"]
    out = Preparation(
        numeric, categorical, sorted(r["feature"] for r in decided if r["decision"] == "all_missing"),
        sorted(r["feature"] for r in decided if r["decision"] == "constant"),
    )
    if not numeric and not categorical:
        return out
    stages, inputs = [], []
    medians = train_medians(train, numeric)
    inputs += [f"_num_{c}" for c in medians]
    for c in categorical:
        stages += [
            StringIndexer(inputCol=f"_cat_{c}", outputCol=f"_ix_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCol=f"_ix_{c}", outputCol=f"_oh_{c}", dropLast=True, handleInvalid="keep"),
        ]
        inputs.append(f"_oh_{c}")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_raw" if scale else "features_vec"))
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features_vec", withMean=True, withStd=True))
    model = Pipeline(stages=stages).fit(_shape(train, medians, categorical))
    return Preparation(numeric, categorical, out.dropped_all_missing, out.dropped_constant, medians, model)


def prepare(df: DataFrame, prep: Preparation) -> DataFrame:
    made = prep.model.transform(_shape(df, prep.medians, prep.categorical))
    return made.select(*df.columns, "features_vec")


def class_counts(train: DataFrame, label: str) -> dict[int, int]:
    """Rows per class; a label has a handful of classes."""
    return {int(r[0]): r[1] for r in train.where(F.col(label).isNotNull()).groupBy(label).count().collect()}


def skip_reason(name: str, counts: dict[int, int], prep: Preparation | None) -> str | None:
    """Why an estimator cannot be trained on this split, if so."""
    if not counts:
        return "training split has no eligible supervised rows"
    if name == "dummy_stratified" and len(counts) < 2:
        return "stratified dummy requires both classes in the training split"
    if name == "logistic_regression_l2":
        if len(counts) < 2:
            return "logistic regression requires both classes in the training split"
        if min(counts.values()) < MIN_CLASS_ROWS:
            return "logistic regression requires at least three training rows in the minority class"
        if prep is None or prep.model is None:
            return "all trainable features were dropped during train-only preprocessing"
    return None


def balanced_weight(label: str, counts: dict[int, int]) -> Column:
    """Weights under which all classes of the label count alike, with a mean of one."""
    total, weight = sum(counts.values()), F.lit(0.0)
    for k, n in counts.items():
        weight = F.when(F.col(label) == k, total / (len(counts) * float(n))).otherwise(weight)
    return weight


def without_summary(model: LogisticRegressionModel, spark: SparkSession) -> LogisticRegressionModel:
    """The fitted model as saved and read back, which leaves its training summary behind.

    The summary of two classes holds the session, which tasks cannot be sent once anything in it was observed.
    """
    path = scratch(spark, "model")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def fit_binary(train: DataFrame, label: str, prep: Preparation, counts: dict[int, int]) -> LogisticRegressionModel:
    """The balanced L2 logistic model on the prepared training rows."""
    made = prepare(train, prep).withColumn("_w", balanced_weight(label, counts))
    model = LogisticRegression(
        featuresCol="features_vec", labelCol=label, weightCol="_w", regParam=1.0 / (BINARY_C * sum(counts.values())),
        elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-10,
    ).fit(made)
    return without_summary(model, train.sparkSession)


def preparation_report(train: DataFrame, prep: Preparation) -> DataFrame:
    """``check, feature, value``: what the fitted preparation does, read from its vectors on the training rows.

    Medians and dropped columns, the width of each one-hot block, and how many rows have exactly one (known value, not
    the last category) or no entry in it.
    """
    spark = train.sparkSession
    facts = [("median", c, float(m)) for c, m in prep.medians.items()]
    facts += [("all_missing", c, 1.0) for c in prep.dropped_all_missing] + [("constant", c, 1.0) for c in prep.dropped_constant]
    made = prep.model.transform(_shape(train, prep.medians, prep.categorical))
    hot = [vector_to_array(F.col(f"_oh_{c}")) for c in prep.categorical]
    one = made.agg(*[x for i, h in enumerate(hot) for x in (
        F.max(F.size(h)).alias(f"_w{i}"), F.sum(F.aggregate(h, F.lit(0.0), lambda a, b: a + b)).alias(f"_s{i}"))])
    rows = F.array(*[F.struct(F.lit(check).alias("check"), F.lit(c).alias("feature"), F.col(f"_{k}{i}").cast("double").alias("value"))
                     for i, c in enumerate(prep.categorical) for check, k in (("width", "w"), ("entries", "s"))])
    return spark.createDataFrame(facts, "check string, feature string, value double").unionByName(one.select(F.inline(rows)))


def gradient(train: DataFrame, label: str, prep: Preparation, counts: dict[int, int],
             model: LogisticRegressionModel) -> DataFrame:
    """``position, slope``: the objective's slope at the fitted weights, the intercept at position -1.

    Mean weighted loss plus half the squared weights times the regularisation; near zero at the optimum.
    """
    scored = model.transform(prepare(train, prep)).withColumn("_w", balanced_weight(label, counts))
    p = F.get(vector_to_array("probability"), F.lit(1))
    gap = F.col("_w") * (p - F.col(label)) / F.lit(float(sum(counts.values())))
    x = F.concat(F.array(F.lit(1.0)), vector_to_array("features_vec"))
    sums = scored.select(F.posexplode(F.transform(x, lambda v: v * gap)).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    pull = F.array(F.lit(0.0), *[F.lit(float(v) / (BINARY_C * sum(counts.values()))) for v in model.coefficients])
    return sums.select((F.col("k") - 1).alias("position"), (F.col("v") + F.get(pull, F.col("k"))).alias("slope"))


def binary_baselines(rows: DataFrame, label: str, features: Sequence[str], row_id: str, seed: int = 42,
                     part: str = "split_partition") -> tuple[DataFrame, dict[str, str]]:
    """Prior, stratified-random and balanced L2 logistic predictions for all rows, and skip reasons."""
    train = rows.where((F.col(part) == "train") & F.col(label).isNotNull())
    counts = class_counts(train, label)
    total, positive = sum(counts.values()), counts.get(1, 0)
    prior = positive / total if total else 0.0
    prep = fit_preparation(train, features) if total else None
    skipped, frames = {}, []
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    for name, score in (("dummy_majority", F.lit(prior)), ("dummy_stratified", (draw < prior).cast("double"))):
        why = skip_reason(name, counts, prep)
        if why:
            skipped[name] = why
            continue
        frames.append(rows.select(row_id, part, label, F.lit(name).alias("estimator_name"), score.alias("score")))
    why = skip_reason("logistic_regression_l2", counts, prep)
    if why:
        skipped["logistic_regression_l2"] = why
    else:
        scored = fit_binary(train, label, prep, counts).transform(prepare(rows, prep))
        frames.append(scored.select(
            row_id, part, label, F.lit("logistic_regression_l2").alias("estimator_name"),
            F.get(vector_to_array("probability"), F.lit(1)).alias("score"),
        ))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), skipped


def ordinal_model(rows: DataFrame, universe: DataFrame, level_index: str, features: Sequence[str], row_id: str,
                  part: str = "split_partition", reg: float = 0.1) -> DataFrame:
    """Standardised multinomial logistic model; scores the whole universe with three probabilities."""
    train = rows.where((F.col(part) == "train") & F.col(level_index).isNotNull())
    prep = fit_preparation(train, features, scale=True)
    counts = class_counts(train, level_index)
    total, weight = sum(counts.values()), balanced_weight(level_index, counts)
    model = LogisticRegression(
        featuresCol="features_vec", labelCol=level_index, weightCol="_w", family="multinomial", elasticNetParam=0.0,
        regParam=1.0 / (reg * total), maxIter=500,
    ).fit(prepare(train, prep).withColumn("_w", weight))
    model = without_summary(model, train.sparkSession)
    p = vector_to_array("probability")
    probability = [F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i in range(len(K.LEVELS))]
    scored = model.transform(prepare(universe, prep))
    return scored.select(
        row_id, F.get(F.array(*[F.lit(v) for v in K.LEVELS]), F.col("prediction").cast("int")).alias(
            "prediction__ordinal_priority_level"),
        *[c.alias(f"prediction__probability_{v}") for c, v in zip(probability, K.LEVELS)],
        F.abs(probability[2] - probability[1]).alias("prediction__medium_high_margin"),
    )


def level_comparison(df: DataFrame, left: str, right: str, left_family: str, right_family: str,
                     by: Sequence[str] = ()) -> DataFrame:
    """Agreement of two level sources per group, refused when they do not share a meaning or one is empty."""
    from medgrain.operators.agreement import ordinal_summary

    n = F.col("comparable_level_rows")
    if left_family != right_family:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count")).withColumn("status", F.lit("semantic_family_mismatch"))
    out = ordinal_summary(df, left, right, by=by)
    return out.withColumn("status", F.when(n > 0, "available").otherwise("no_comparable_rows"))

"""Model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from medgrain.operators.agreement import binary_metrics, ordinal_metrics
from medgrain.plans import models
from medgrain.queries.aggregates import AGREE_SQL, level_rows
from medgrain.queries.registry import query

c = F.col
FEATURES = ["n_chars", "lang", "source", "empty", "fixed"]


def labelled(t):
    docs = t.documents.select(
        "doc_id", "n_chars", "lang", "source", F.lit(None).cast("double").alias("empty"), F.lit(1).alias("fixed"))
    rows = docs.join(t.labels, "doc_id", "left").withColumn("ok", c("quality").isNotNull().cast("int"))
    part = F.when(c("doc_id") % 5 == 0, "test").when(c("doc_id") % 5 == 1, "validation").otherwise("train")
    return rows, docs.select("doc_id", part.alias("split_partition"))


def supervised(t):
    rows, splits = labelled(t)
    return models.supervised_frame(rows, splits, ["doc_id"], "doc_id", "ok", FEATURES)


PART = "CASE d.doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"


@query("ml_supervised_frame", "doc_id:l quality:i split_partition:s n_chars:l lang:s", f"""
SELECT d.doc_id, quality, {PART} AS split_partition, n_chars, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def ml_supervised_frame(t):
    return supervised(t)


@query("ml_preprocess_profile", "feature:s kind:s known_count:l null_count:l decision:s", f"""
WITH x AS (SELECT d.* FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE {PART} = 'train')
SELECT 'n_chars' AS feature, 'numeric' AS kind, count(n_chars) AS known_count, 0 AS null_count, 'kept' AS decision FROM x
UNION ALL SELECT 'lang', 'categorical', count(lang), 0, 'kept' FROM x UNION ALL SELECT 'source', 'categorical', count(source), 0, 'kept' FROM x
UNION ALL SELECT 'empty', 'numeric', 0, count(*), 'all_missing' FROM x UNION ALL SELECT 'fixed', 'numeric', count(*), 0, 'constant' FROM x""")
def ml_preprocess_profile(t):
    return models.column_profile(supervised(t).where(c("split_partition") == "train"), FEATURES)


@query("ml_binary", "doc_id:l split_partition:s quality:i estimator_name:s score:d predicted:i")
def ml_binary(t):
    rows, _ = models.binary_baselines(supervised(t), "quality", FEATURES, "doc_id")
    return rows


TRAIN_SQL = f"x AS (SELECT d.*, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE {PART} = 'train')"


@query("ml_preparation", "check:s feature:s value:d", f"""
WITH {TRAIN_SQL}
SELECT 'median' AS check, 'n_chars' AS feature, quantile_cont(n_chars, 0.5) AS value FROM x
UNION ALL SELECT 'all_missing', 'empty', 1 UNION ALL SELECT 'constant', 'fixed', 1
UNION ALL SELECT 'width', 'lang', count(DISTINCT coalesce(lang, '__missing__')) + 1 FROM x UNION ALL SELECT 'entries', 'lang', count(*) FROM x
UNION ALL SELECT 'width', 'source', count(DISTINCT coalesce(source, '__missing__')) + 1 FROM x UNION ALL SELECT 'entries', 'source', count(*) FROM x""")
def ml_preparation(t):
    train = supervised(t).where(c("split_partition") == "train")
    return models.preparation_report(train, models.fit_preparation(train, FEATURES))


@query("ml_binary_checks", "check:s n:l passed:l", f"""
WITH {TRAIN_SQL}, w AS (SELECT count(DISTINCT lang) + 1 + count(DISTINCT source) + 1 + 2 AS n FROM x)
SELECT 'slope_near_zero' AS check, n, n AS passed FROM w
UNION ALL SELECT 'probability', count(*), count(*) FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'higher_score_is_predicted', count(*), count(*) FROM documents JOIN labels USING (doc_id)""")
def ml_binary_checks(t):
    """The fitted model's slope at its weights, and its scores, as counts of what holds."""
    rows = supervised(t)
    train = rows.where((c("split_partition") == "train") & c("quality").isNotNull())
    counts, prep = models.class_counts(train, "quality"), models.fit_preparation(train, FEATURES)
    slopes = models.gradient(train, "quality", prep, counts, models.fit_binary(train, "quality", prep, counts))
    scored = models.binary_baselines(rows, "quality", FEATURES, "doc_id")[0].where("estimator_name = 'logistic_regression_l2'")
    held = lambda df, name, test: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"), F.count_if(test).alias("passed"))
    # The column of character counts is not scaled, so its slope is taken per thousand characters.
    near = F.abs(c("slope")) <= F.when(c("position") == 0, 1e-3).otherwise(1e-6)
    return held(slopes, "slope_near_zero", near).unionByName(held(scored, "probability", c("score").between(0, 1))).unionByName(
        held(scored, "higher_score_is_predicted", c("predicted") == (c("score") >= 0.5).cast("int")))


@query("ml_ordinal_checks", "check:s n:l passed:l", """
SELECT unnest(['probabilities_sum_to_one', 'level_is_most_probable', 'margin']) AS check, count(*) AS n, count(*) AS passed FROM documents""")
def ml_ordinal_checks(t):
    rows, p = leveled(t), "prediction__probability_"
    out = models.ordinal_model(rows.where(c("ok") == 1), rows, "level_index", ["n_chars", "lang", "source"], "doc_id")
    low, medium, high = (c(p + x) for x in ("low", "medium", "high"))
    best = F.when(low >= F.greatest(medium, high), "low").when(medium >= high, "medium").otherwise("high")
    tests = {"probabilities_sum_to_one": F.abs(low + medium + high - 1) < 1e-9,
             "level_is_most_probable": c("prediction__ordinal_priority_level") == best,
             "margin": F.abs(c("prediction__medium_high_margin") - F.abs(high - medium)) < 1e-12}
    one = out.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(v).alias(k) for k, v in tests.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), "n", c(k).alias("passed")) for k in tests])))


@query("ml_binary_metrics", "positive_count:l negative_count:l tp:l fp:l fn:l tn:l balanced_accuracy:d precision:d recall:d f1:d pr_auc:d roc_auc:d brier_score:d", """
WITH x AS (SELECT quality AS y, n_chars / 100000 AS s, (n_chars > 500)::INT AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
g AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM x GROUP BY 1),
w AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM g),
a AS (SELECT sum(p) AS ps, sum(n) AS ns, sum(p * cp / (cp + cn)) / sum(p) AS ap, sum(n * (cp - p) + n * p / 2) / (sum(p) * sum(n)) AS auc FROM w),
m AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, avg((s - y) * (s - y)) AS br FROM x),
r AS (SELECT *, ps - tp AS fn, ns - fp AS tn, tp / (tp + fp) AS pre, tp / ps AS rec FROM a JOIN m ON true)
SELECT ps AS positive_count, ns AS negative_count, tp, fp, fn, tn, round((rec + tn / ns) / 2, 9) AS balanced_accuracy, round(pre, 9) AS precision, round(rec, 9) AS recall,
  round(2 * pre * rec / (pre + rec), 9) AS f1, round(ap, 9) AS pr_auc, round(auc, 9) AS roc_auc, round(br, 9) AS brier_score FROM r""")
def ml_binary_metrics(t):
    x = t.labels.join(t.documents, "doc_id").select(
        c("quality").alias("y"), (c("n_chars") / 100000).alias("s"), (c("n_chars") > 500).cast("int").alias("p"))
    m = binary_metrics(x, "y", "p", "s", F.floor(-c("s") * 64))
    rounded = ("balanced_accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc", "brier_score")
    return m.select(*[F.round(n, 9).alias(n) if n in rounded else c(n) for n in m.columns])


def leveled(t):
    rows, splits = labelled(t)
    index = F.when(c("n_chars") < 400, 0).when(c("n_chars") < 1500, 1).otherwise(2)
    return rows.join(splits, "doc_id").withColumn("level_index", F.when(c("ok") == 1, index))


@query("ml_ordinal", "doc_id:l level:s p_low:d p_medium:d p_high:d margin:d")
def ml_ordinal(t):
    rows = leveled(t)
    p = "prediction__probability_"
    out = models.ordinal_model(rows.where(c("ok") == 1), rows, "level_index", ["n_chars", "lang", "source"], "doc_id")
    return out.select("doc_id", c("prediction__ordinal_priority_level").alias("level"), c(p + "low").alias("p_low"),
                      c(p + "medium").alias("p_medium"), c(p + "high").alias("p_high"), c("prediction__medium_high_margin").alias("margin"))


@query("ml_ordinal_metrics", "row_count:l accuracy:d balanced_accuracy:d macro_precision:d macro_recall:d macro_f1:d kappa:d mae:d off_by_one_rate:d severe:d",
       AGREE_SQL.format(by="", group="", mby="", on="true") + """,
v AS (SELECT unnest([0, 1, 2]) AS z), t AS (SELECT z, count(*) FILTER (x = z AND y = z) AS tp, count(*) FILTER (x = z) AS r, count(*) FILTER (y = z) AS q
  FROM i JOIN v ON true WHERE b IS NOT NULL GROUP BY 1),
f AS (SELECT *, tp / r AS rec, tp / q AS pre, 2 * (tp / q) * (tp / r) / (tp / q + tp / r) AS f1 FROM t), h AS (SELECT avg(rec) AS ba, avg(pre) AS mp, avg(f1) AS mf FROM f)
SELECT n AS row_count, round(same / n, 9) AS accuracy, round(ba, 9) AS balanced_accuracy, round(mp, 9) AS macro_precision, round(ba, 9) AS macro_recall, round(mf, 9) AS macro_f1,
  round(1.0 - CAST(obs * n AS DOUBLE) / CAST(exp AS DOUBLE), 9) AS kappa, round((off1 + 2 * sev) / n, 9) AS mae, round(off1 / n, 9) AS off_by_one_rate, round(sev / n, 9) AS severe
FROM g JOIN e ON true JOIN h ON true""")
def ml_ordinal_metrics(t):
    m = ordinal_metrics(level_rows(t).where(c("b").isNotNull()), "a", "b")
    m = m.withColumnsRenamed({"weighted_kappa_quadratic": "kappa", "mean_absolute_level_error": "mae", "severe_disagreement_rate": "severe"})
    return m.select("row_count", *[F.round(n, 9).alias(n) for n in m.columns if n != "row_count"])


@query("ml_level_comparison", "o_orderstatus:s row_count:l n:l same_rate:d kappa:d status:s",
       AGREE_SQL.format(by="o_orderstatus, ", group="GROUP BY 1", mby="m.o_orderstatus, ", on="m.o_orderstatus = k.o_orderstatus") + """
SELECT g.o_orderstatus, row_count, n, same / n AS same_rate, 1.0 - CAST(obs * n AS DOUBLE) / CAST(exp AS DOUBLE) AS kappa, 'available' AS status
FROM g JOIN e ON g.o_orderstatus = e.o_orderstatus""")
def ml_level_comparison(t):
    family = "canonical_priority_score_0_to_10"
    out = models.level_comparison(level_rows(t), "a", "b", family, family, ["o_orderstatus"])
    return out.select("o_orderstatus", "row_count", c("comparable_level_rows").alias("n"), c("same_level_rate").alias("same_rate"),
                      c("weighted_kappa_quadratic").alias("kappa"), "status")

"""Clinician review log, review queue, blind evaluation, ordinal targets, patient summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medgrain import constants as K
from medgrain.functions.jsoncols import row_id
from medgrain.functions.scoring import clean_level, compare_columns, to_level
from medgrain.functions.status import (
    blind_priority, confidence_percent, medium_high_boundary, queue_priority, signal_rank, training_inclusion,
)
from medgrain.operators.agreement import ordinal_summary
from medgrain.operators.aggregates import count_if, dominant, rate
from medgrain.operators.joins import checked_join
from medgrain.operators.ordering import top_up
from medgrain.operators.skew import first_per_key, join_null_safe, ranked, ranked_together
from medgrain.session import release, stored

GRAIN = list(K.GRAIN)
REVIEW_FIELDS = ["review_submission_id", "review_version", "review_submission_timestamp", "reviewer_id",
                 "label__clinician_priority_level", "label__clinician_priority_score",
                 "label__clinician_review_status", "label__clinician_reason_tags"]


def latest_version(log: DataFrame, keys: Sequence[str], version: str, submitted: str, ident: str) -> DataFrame:
    """The last entry per key of an append log: highest version, then submit time, then id."""
    at = F.struct(version, submitted, ident)
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_r"), F.count(F.lit(1)).alias("version_count")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest], "version_count"
    )


def numbered_versions(log: DataFrame, keys: Sequence[str], submitted: str, ident: str) -> DataFrame:
    """Version numbers of a raw log in submit order."""
    return ranked(log, keys, [submitted, ident], "review_version")


def review_universe(scope: DataFrame, dataset: DataFrame) -> DataFrame:
    """Reviewable rows: the scope with the dataset's row id, label and benchmark columns."""
    picked = [c for c in dataset.columns if c.startswith(("benchmark__", "label__primary_action", "meta__", "modeling__"))]
    return checked_join(scope, dataset.select(*GRAIN, *picked), GRAIN)


def coverage(universe: DataFrame, key: str, prefix: str) -> DataFrame:
    """Attach reviewable and reviewed counts of a key and its zero-review flag."""
    counts = universe.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"{prefix}_reviewable_count"), F.sum("current_clinician_reviewed_flag").alias(f"{prefix}_reviewed_count")
    )
    out = join_null_safe(universe, counts, [key])
    return out.withColumn(f"{prefix}_zero_review_flag", (F.col(f"{prefix}_reviewed_count") == 0).cast("int"))


def build_queue(universe: DataFrame, latest: DataFrame, keys: Sequence[str] = GRAIN,
                names: dict[str, str] | None = None) -> DataFrame:
    """Review queue: coverage counts, priority, ranks within subject and class, global rank.

    Counts are aggregates joined back; ranks come from range-partitioned sorts, so neither
    a large class nor the global order meets in one task. ``names`` renames the inputs
    subject, encounter, medication, review_time and class.
    """
    n = {"subject": "subject_id", "encounter": "encounter_id", "medication": "medication_standardized",
         "review_time": "review_timestamp", "class": "medication_class_standardized", **(names or {})}
    c = F.col
    fields = [f for f in REVIEW_FIELDS if f in latest.columns]
    q = checked_join(universe, latest.select(*keys, *fields), list(keys))
    q = q.withColumn("current_clinician_reviewed_flag", c("review_submission_id").isNotNull().cast("int"))
    q = q.withColumn(n["class"], F.coalesce(n["class"], F.lit("unresolved")))
    for key, prefix in ((n["class"], "class"), (n["subject"], "subject"), (n["encounter"], "encounter")):
        q = coverage(q, key, prefix)
    level, given = c("benchmark__current_rule_score_level"), c("label__clinician_priority_level")
    facts = {
        "reviewed": c("current_clinician_reviewed_flag"),
        "disagreement": (given != level).cast("int"),
        "unbenchmarked": (F.coalesce("benchmark__current_rule_available_flag", F.lit(0)) == 0).cast("int"),
        "ambiguous": c("label__primary_action_label").isin(*K.AMBIGUOUS_ACTIONS).cast("int"),
        "excluded": (F.coalesce("meta__dataset_row_eligible_for_training_flag", F.lit(0)) == 0).cast("int"),
        "class_zero": c("class_zero_review_flag"), "subject_zero": c("subject_zero_review_flag"),
        "encounter_zero": c("encounter_zero_review_flag"), "supported": c("first_scope_supported_class_flag"),
        "level": level,
    }
    priority = queue_priority(facts)
    # Read by each sort of the three ranks and by the join of their numbers.
    q = stored(q.select("*", signal_rank(level).alias("rule_signal_strength_rank"), *[v.alias(k) for k, v in priority.items()]))
    release(q.sparkSession)
    tail = [n["subject"], n["encounter"], n["medication"], "-" + n["review_time"]]
    first = ["-queue_priority_score", "-rule_signal_strength_rank", "-class_zero_review_flag", "-subject_zero_review_flag",
             "-encounter_zero_review_flag", "class_reviewable_count", *tail]
    last = ["current_clinician_reviewed_flag", "-queue_priority_score", "queue_rank_within_subject",
            "queue_rank_within_medication_class", "class_reviewed_count", "subject_reviewed_count",
            "class_reviewable_count", *tail]
    return ranked_together(q, keys, [
        ("queue_rank_within_subject", [n["subject"]], first),
        ("queue_rank_within_medication_class", [n["class"]], first), ("queue_rank", [], last)])


def blind_slice(queue: DataFrame, scored: DataFrame, minimum: int = K.BLIND_MINIMUM_ROWS,
                margin: float = K.BLIND_MARGIN, high: float = K.BLIND_HIGH_PROBABILITY) -> DataFrame:
    """Blind-evaluation candidates by disagreement, uncertainty or boundary, topped up to a minimum."""
    c = F.col
    q = checked_join(queue, scored, ["modeling__row_id"], "left", "one_to_one")
    rule, model = c("benchmark__current_rule_score_level"), c("prediction__ordinal_priority_level")
    q = q.select(
        "*", F.coalesce((rule != model).cast("int"), F.lit(0)).alias("model_rule_disagreement_flag"),
        F.coalesce((F.lower("label__clinician_review_status") == "uncertain").cast("int"), F.lit(0)).alias(
            "uncertain_existing_review_flag"),
        medium_high_boundary(model, c("prediction__probability_medium"), c("prediction__probability_high"), margin).alias(
            "medium_high_boundary_flag"),
    )
    flags = ["model_rule_disagreement_flag", "uncertain_existing_review_flag", "medium_high_boundary_flag"]
    q = stored(q)  # read by the selection, its count and the top-up
    release(q.sparkSession)
    selected = F.greatest(*flags) == 1
    eligible = (c("current_clinician_reviewed_flag") == 0) & (model == "high") & (
        F.coalesce("prediction__probability_high", F.lit(0.0)) >= high)
    picked = top_up(q, selected, eligible, ["-prediction__probability_high", "queue_rank"], minimum,
                    "high_signal_unreviewed_fallback_flag")
    p = blind_priority(*[c(f) for f in flags], c("high_signal_unreviewed_fallback_flag"), c("current_clinician_reviewed_flag"))
    out = picked.select("*", p["reasons"].alias("blind_reasons"), p["band"].alias("blind_band"), p["score"].alias("blind_score"))
    order = ["-blind_score", "current_clinician_reviewed_flag", "queue_rank_within_subject",
             "queue_rank_within_medication_class", "class_reviewed_count", "subject_reviewed_count",
             "-prediction__probability_high", "-prediction__probability_medium", "queue_rank"]
    return ranked(out, [], order, "blind_rank")


def ordinal_targets(dataset: DataFrame, latest: DataFrame, splits: DataFrame) -> DataFrame:
    """Reviewed rows with their level, split and inclusion; a review without a dataset row is an error."""
    c = F.col
    features = dataset.select(*GRAIN, "modeling__row_id", "meta__feature_available_as_of_review_time_flag", F.lit(1).alias("_hit"))
    joined = checked_join(latest, features, GRAIN, "left", "one_to_one")
    error = F.raise_error(F.lit("review without dataset row")).cast("int")
    joined = joined.where(F.when(c("_hit").isNull(), error).otherwise(F.lit(1)) == 1).drop("_hit")
    level = F.coalesce(clean_level(c("label__clinician_priority_level")), to_level(c("label__clinician_priority_score")))
    joined = joined.withColumn("ordinal_target_level", level).join(splits.select(*GRAIN, "split_partition"), GRAIN, "left")
    keep, why = training_inclusion(
        c("ordinal_target_level"), c("label__clinician_review_status"), c("meta__feature_available_as_of_review_time_flag"))
    return joined.select("*", signal_rank(c("ordinal_target_level")).alias("_rank"), keep.alias("training_inclusion_flag"),
                         why.alias("training_exclusion_reason")).withColumn(
        "ordinal_target_level_index", F.when(c("_rank") > 0, c("_rank") - 1)).drop("_rank")


def post_blind(queue: DataFrame, left: str, right: str, left_score: str | None = None,
               right_score: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Row-wise comparison of clinician and model levels and its summary."""
    null = F.lit(None).cast("double")
    cols = compare_columns(F.col(left), F.col(right), F.col(left_score) if left_score else null,
                           F.col(right_score) if right_score else null)
    rows = queue.select("*", *[v.alias(f"comparison__{k}") for k, v in cols.items()])
    return rows, ordinal_summary(queue, left, right, left_score, right_score)


def latest_encounters(encounters: DataFrame, reviews: DataFrame) -> DataFrame:
    """Latest encounter per subject, replaced by the latest reviewed one when there is one."""
    rows = encounters.withColumn("_sort", F.coalesce("encounter_end", "encounter_start"))
    latest = first_per_key(rows, ["subject_id"], ["-_sort", "-hadm_id", "-stay_id", "encounter_id"], ["encounter_id"])
    seen = first_per_key(reviews, ["subject_id"], ["-review_timestamp", "-review_submission_timestamp", "encounter_id"], ["encounter_id"])
    known = seen.join(encounters.select("subject_id", "encounter_id"), ["subject_id", "encounter_id"], "left_semi")
    over = known.select("subject_id", F.col("encounter_id").alias("_reviewed"))
    return latest.join(over, "subject_id", "left").select(
        "subject_id", F.coalesce("_reviewed", "encounter_id").alias("encounter_id"),
        F.col("_reviewed").isNotNull().cast("int").alias("reviewed_override_flag"),
    )


def patient_universe(state: DataFrame, predictions: DataFrame, encounters: DataFrame) -> DataFrame:
    """State rows with predictions, encounter context, confidence and priority rank."""
    c = F.col
    p = [f"prediction__probability_{x}" for x in K.LEVELS]
    joined = state.join(predictions.select(*GRAIN, "prediction__ordinal_priority_level", *p), GRAIN, "left").join(
        encounters.select("subject_id", "encounter_id", "sex", "admission_type", "encounter_start", "encounter_end"),
        ["subject_id", "encounter_id"], "left",
    )
    confidence = F.greatest(*p)
    return joined.select(
        "*", confidence.alias("ml_priority_confidence"), confidence_percent(confidence).alias("priority_confidence_percent"),
        signal_rank(c("prediction__ordinal_priority_level")).alias("priority_rank"),
    )


def problem_flags(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Up to three problem labels per key from the classes present."""
    has = {x: F.max((F.col(column) == x).cast("int")) for x in ("opioid", "benzodiazepine", "anticholinergic", "antipsychotic")}
    present = df.groupBy(*keys).agg(*[v.alias(k) for k, v in has.items()])
    on = lambda *names: F.greatest(*[F.coalesce(F.col(x), F.lit(0)) for x in names]) == 1
    labels = F.array_compact(F.array(
        F.when(on("opioid", "benzodiazepine"), F.lit("Oversedation")),
        F.when(on("benzodiazepine", "anticholinergic"), F.lit("Fall risk")),
        F.when(on("anticholinergic", "antipsychotic", "benzodiazepine"), F.lit("Confusion")),
    ))
    return present.select(*keys, labels.alias("problem_flags"))


def patient_summary(universe: DataFrame) -> DataFrame:
    """Per subject: counts, the top-priority row, dominant class and problem flags."""
    c = F.col
    cls = "medication_class_standardized"
    rows = stored(universe.select(  # read three times
        "subject_id", "encounter_id", "medication_standardized", cls, "priority_rank", "ml_priority_confidence",
        "prediction__ordinal_priority_level", F.coalesce("active_at_review_flag", F.lit(0)).alias("_active")))
    top = first_per_key(
        rows, ["subject_id"], ["-_active", "-priority_rank", "-ml_priority_confidence", "medication_standardized", "encounter_id"],
        ["prediction__ordinal_priority_level", "ml_priority_confidence"],
        medication_count=F.count(F.lit(1)), current_medication_count=F.sum("_active"),
        encounter_count=F.count_distinct("encounter_id"),
        flagged_medication_count=count_if(c("prediction__ordinal_priority_level").isin("medium", "high")),
    )
    return top.join(dominant(rows, ["subject_id"], cls, "dominant_medication_class"), "subject_id", "left").join(
        problem_flags(rows, ["subject_id"], cls), "subject_id", "left")


def review_report(universe: DataFrame, latest: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """Coverage, level frequencies and traceability counts in one row."""
    tagged = universe.select(*keys, F.lit(1).alias("_u"), F.lit(0).alias("_r"), F.lit(None).cast("string").alias("_level")).unionByName(
        latest.select(*keys, F.lit(0).alias("_u"), F.lit(1).alias("_r"), F.col(level).alias("_level"))
    )
    g = tagged.groupBy(*keys).agg(F.sum("_u").alias("u"), F.sum("_r").alias("r"), F.max("_level").alias("lv"))
    c = F.col
    one = g.agg(
        F.sum("u").alias("reviewable_rows"), F.sum("r").alias("reviewed_rows"),
        count_if((c("u") > 0) & (c("r") > 0)).alias("matched_keys"), count_if((c("u") == 0) & (c("r") > 0)).alias("unmatched_review_keys"),
        count_if(c("u") > 1).alias("reviewable_duplicate_keys"), count_if(c("r") > 1).alias("review_duplicate_keys"),
        *[count_if(c("lv") == v).alias(f"level_{v}_keys") for v in K.LEVELS],
    )
    return one.select("*", rate(c("matched_keys"), c("reviewable_rows")).alias("coverage_rate"))


def milestones(reviewed: DataFrame, subject: str, encounter: str, group: str, level: str) -> DataFrame:
    """Densification counts, milestone flags and the missing levels in one row."""
    c, m = F.col, K.MILESTONES
    one = reviewed.agg(
        F.count(F.lit(1)).alias("reviewed_rows"), F.count_distinct(subject).alias("reviewed_subjects"),
        F.count_distinct(encounter).alias("reviewed_encounters"), F.count_distinct(group).alias("reviewed_classes"),
        *[count_if(c(level) == v).alias(f"level_{v}") for v in K.LEVELS],
    )
    levels = [c(f"level_{v}") for v in K.LEVELS]
    least = F.least(*levels)
    return one.select(
        "*", (c("reviewed_rows") >= m["rows"]).cast("int").alias("initial_rows_reached"),
        ((c("reviewed_subjects") >= m["subjects"]) & (c("reviewed_encounters") >= m["encounters"]) & (
            c("reviewed_classes") >= m["classes"])).cast("int").alias("diversity_reached"),
        ((c("reviewed_rows") >= m["expanded_rows"]) & (least >= m["per_level"])).cast("int").alias("expanded_reached"),
        (least > 0).cast("int").alias("all_levels_present"),
        F.array_join(F.array_compact(F.array(*[F.when(c(f"level_{v}") == 0, F.lit(v)) for v in K.LEVELS])), ",").alias("missing_levels"),
    )


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    """Rows per tag of an array column."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("tag_count"))


def row_key() -> Column:
    return row_id(*[F.col(k) for k in GRAIN])

"""Case tables: statuses, readiness, exclusions, queue and blind-evaluation priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from medgrain import constants as K



def _is(column: Column, value: int = 1) -> Column:
    return F.coalesce(column == value, F.lit(False))


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """Distinct reason texts whose condition holds, in the order given."""
    items = [F.when(cond, text if isinstance(text, Column) else F.lit(text)) for cond, text in pairs]
    return F.array_distinct(F.array_compact(F.array(*items)))


def class_status(medication_class: Column, ingredient_status: Column) -> Column:
    return (
        F.when(medication_class.isin(*K.SUPPORTED_CLASSES), K.CLASS_STATUS_PRECEDENCE[0])
        .when(ingredient_status.isin(*K.RESOLUTION_PRECEDENCE[:2]), K.CLASS_STATUS_PRECEDENCE[1])
        .when(ingredient_status == K.RESOLUTION_PRECEDENCE[2], K.CLASS_STATUS_PRECEDENCE[2])
        .otherwise(K.CLASS_STATUS_PRECEDENCE[3])
    )


def review_status(active_non_home: Column, has_non_home: Column, latest_non_home: Column, at: Column) -> Column:
    return (
        F.when(_is(active_non_home), K.STATUS_ACTIVE)
        .when(~_is(has_non_home), K.STATUS_PRE_ADMISSION)
        .when(latest_non_home < at, K.STATUS_INACTIVE)
        .otherwise(K.STATUS_UNCERTAIN)
    )


def start_context(continued: Column, started: Column) -> Column:
    return (
        F.when(_is(continued) & _is(started), "mixed_evidence")
        .when(_is(continued), "continued_from_home")
        .when(_is(started), "new_start_during_encounter")
        .otherwise("neither_or_unknown")
    )


def mme_readiness(medication_class: Column, **fields: Column) -> tuple[Column, Column]:
    """Status and missing-field list of the opioid dose conversion; the dose itself stays null."""
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in fields.items()]))
    status = (
        F.when(~F.coalesce(medication_class == "opioid", F.lit(False)), "not_opioid")
        .when(F.size(missing) > 0, "missing_required_fields")
        .otherwise("ready_for_future_conversion")
    )
    listed = F.when(medication_class == "opioid", missing).otherwise(F.array().cast("array<string>"))
    return status, F.to_json(listed)


def renal_dose_readiness(active: Column, dose: Column, unit: Column, route: Column, context: Column) -> Column:
    ready = dose.isNotNull() & unit.isNotNull() & route.isNotNull() & _is(context)
    return (
        F.when(~_is(active), "not_current_medication")
        .when(ready, "ready_for_future_logic")
        .otherwise("insufficient_inputs")
    )


def exclusions(ingredient: Column, route: Column, kind: Column, schedule: Column, medication_class: Column,
               duration_hours: Column, new_start: Column) -> dict[str, Column]:
    acute_context = (
        F.coalesce(route.isin(*K.ACUTE_ROUTES), F.lit(False))
        | F.coalesce(kind == K.KIND_ADMIN, F.lit(False))
        | (_is(new_start) & F.coalesce(duration_hours <= K.ACUTE_NEW_START_HOURS, F.lit(False)))
    )
    acute = F.coalesce(ingredient.isin(*K.ACUTE_INGREDIENTS), F.lit(False)) & acute_context
    different = F.coalesce(ingredient.isin(*K.DIFFERENT_LOGIC_INGREDIENTS), F.lit(False))
    excluded = acute | different
    downweight = (
        ~excluded
        & F.coalesce(schedule == "prn", F.lit(False))
        & F.coalesce(medication_class.isin(*K.PRN_DOWNWEIGHT_CLASSES), F.lit(False))
    )
    return {
        "acute_life_sustaining_medication": acute.cast("int"),
        "fundamentally_different_deprescribing_logic": different.cast("int"),
        "excluded_from_primary_training": excluded.cast("int"),
        "downweight_recommended": downweight.cast("int"),
    }


def signal_rank(level: Column) -> Column:
    text = F.lower(F.trim(level))
    return F.when(text == "low", 1).when(text == "medium", 2).when(text == "high", 3).otherwise(0)


def _weighted(*pairs: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0) for c, w in pairs])


def queue_priority(f: dict[str, Column]) -> dict[str, Column]:
    """Score, band and reasons of a review-queue row from its 0/1 facts.

    Facts: reviewed, disagreement, unbenchmarked, ambiguous, excluded, class_zero,
    subject_zero, encounter_zero, supported, plus the text ``level``.
    """
    w, rank = K.QUEUE_WEIGHTS, signal_rank(f["level"])
    fact = {n: _is(c) for n, c in f.items() if n != "level"}
    score = w["signal_rank"] * rank + _weighted(
        (~fact["reviewed"], w["unreviewed"]),
        *[(fact[n], w[n]) for n in (
            "disagreement", "unbenchmarked", "ambiguous", "excluded", "class_zero", "subject_zero",
            "encounter_zero", "supported",
        )],
    )
    band = (
        F.when(fact["reviewed"] & fact["disagreement"], "reviewed_disagreement_followup")
        .when(fact["reviewed"], "reviewed_backlog")
        .when(fact["disagreement"], "disagreement_candidate")
        .when(rank >= 2, "high_signal_unreviewed")
        .when(fact["class_zero"] | fact["subject_zero"], "coverage_expansion_unreviewed")
        .otherwise("review_backlog")
    )
    why = reasons(
        (~fact["reviewed"], "unreviewed_row"),
        (fact["reviewed"], "already_reviewed"),
        (fact["disagreement"], "clinician_rule_disagreement"),
        (rank > 0, F.concat(F.lit("benchmark_signal_"), F.lower(F.trim(f["level"])))),
        (fact["unbenchmarked"], "benchmark_sparse_but_reviewable"),
        (fact["ambiguous"], "primary_action_ambiguous"),
        (fact["excluded"], "training_excluded_but_reviewable"),
        (fact["class_zero"], "expand_medication_class_coverage"),
        (fact["subject_zero"], "expand_patient_coverage"),
        (fact["encounter_zero"], "expand_encounter_coverage"),
        (fact["supported"], "supported_first_scope_class"),
    )
    return {"queue_priority_score": score, "queue_priority_band": band, "queue_priority_reasons": why}


def medium_high_boundary(level: Column, medium: Column, high: Column, margin: float = K.BLIND_MARGIN) -> Column:
    zero = F.lit(0.0)
    near = F.abs(F.coalesce(high, zero) - F.coalesce(medium, zero)) <= margin
    return (F.coalesce(F.lower(F.trim(level)).isin("medium", "high"), F.lit(False)) & near).cast("int")


def blind_priority(disagreement: Column, uncertain: Column, boundary: Column, fallback: Column,
                   reviewed: Column) -> dict[str, Column]:
    w = K.BLIND_WEIGHTS
    why = reasons(
        (_is(disagreement), "model_rule_disagreement"),
        (_is(uncertain), "uncertain_existing_review"),
        (_is(boundary), "medium_high_boundary"),
        (_is(fallback), "high_signal_unreviewed_fallback"),
    )
    band = (
        F.when(F.size(why) == 0, "not_selected")
        .when(F.size(why) == 1, F.get(why, F.lit(0)))
        .otherwise("mixed_signal_candidate")
    )
    score = _weighted(
        (_is(disagreement), w["disagreement"]), (_is(uncertain), w["uncertain"]), (_is(boundary), w["boundary"]),
        (_is(fallback), w["fallback"]), (~_is(reviewed), w["unreviewed"]),
    )
    return {"reasons": why, "band": band, "score": score}


def training_inclusion(level: Column, status: Column, feature_flag: Column) -> tuple[Column, Column]:
    """0/1 inclusion and the first reason against it."""
    text = F.lower(F.trim(status))
    reason = (
        F.when(level.isNull(), F.lit("missing_priority_level"))
        .when(~_is(feature_flag), F.lit("feature_unavailable_as_of_review_time"))
        .when(
            ~F.coalesce(text == "reviewed", F.lit(False)),
            F.concat(F.lit("review_status_"), F.coalesce(F.nullif(text, F.lit("")), F.lit("missing"))),
        )
    )
    return reason.isNull().cast("int"), reason


def mapping_confidence(strategy: Column, candidates: Column, resolution: Column) -> Column:
    exact = F.startswith(strategy, F.lit("exact_or_normalized"))
    return (
        F.when(F.startswith(resolution, F.lit("unresolved")), "none")
        .when(exact & (candidates == 1), "high")
        .when(exact, "medium")
        .when(resolution == K.RESOLUTION_PRECEDENCE[2], "low")
        .otherwise("medium")
    )


def lookup_status(resolution: Column) -> Column:
    return F.when(resolution.isin(*K.RESOLUTION_PRECEDENCE[:2]), "resolved").otherwise(resolution)


def review_alignment(model_level: Column, clinician_level: Column) -> Column:
    """agreed / off_by_one / corrected by level distance; null when a side has no level."""
    left, right = signal_rank(model_level), signal_rank(clinician_level)
    distance = F.when((left > 0) & (right > 0), F.abs(left - right))
    return (
        F.when(distance == 0, "agreed").when(distance == 1, "off_by_one").when(distance == 2, "corrected")
    )


def merged_labels(*label_arrays: Column) -> Column:
    """Ordered distinct union of label arrays, dropping blanks and ``unresolved``."""
    merged = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in label_arrays])
    return F.array_distinct(F.filter(merged, lambda x: x.isNotNull() & (x != "") & (x != "unresolved")))


def confidence_percent(confidence: Column) -> Column:
    return F.coalesce(F.round(confidence * 100).cast("int"), F.lit(0))

"""Bucketed rule score, priority levels and row-wise ordinal comparison."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medgrain import constants as K


@dataclass(frozen=True)
class Rule:
    """One scoring rule as data; ``test`` is a boolean Column over the scored frame."""

    name: str
    bucket: str
    points: int
    test: Column
    reason: str
    fragment: str
    evidence: tuple[str, ...] = ()


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name) == 1, F.lit(False))


def _safe(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def clinical_rules() -> list[Rule]:
    """The fifteen fixed rules over the processed clinical frame."""
    med, terrain, dynamic = K.BUCKET_CAPS
    num = {c: F.col(c) for c in (
        "current_medication_count", "egfr_ml_min_1_73m2", "age_proxy", "bmi", "potassium_max", "sodium_max",
        "sbp_min", "heart_rate_max", "pain_max",
    )}
    outside = lambda c, lo, hi: _safe((num[c] < lo) | (num[c] > hi))
    return [
        Rule("benzodiazepine_exposure", med, 3, _flag("benzodiazepine_flag"), "benzodiazepine exposure",
             "benzodiazepine risk", ("drug", "benzodiazepine_flag")),
        Rule("opioid_exposure", med, 3, _flag("opioid_flag"), "opioid exposure", "opioid risk",
             ("drug", "opioid_flag")),
        Rule("anticholinergic_exposure", med, 3, _flag("anticholinergic_flag"), "anticholinergic exposure",
             "anticholinergic burden", ("drug", "anticholinergic_flag")),
        Rule("antipsychotic_exposure", med, 3, _flag("antipsychotic_flag"), "antipsychotic exposure",
             "antipsychotic risk", ("drug", "antipsychotic_flag")),
        Rule("ppi_exposure", med, 1, _flag("ppi_flag"), "proton pump inhibitor exposure", "ppi exposure",
             ("drug", "ppi_flag")),
        Rule("very_high_medication_burden", med, 2, _safe(num["current_medication_count"] >= 10),
             "very high current medication burden (10+ active medications)",
             "very high current medication count", ("current_medication_count", "historical_medication_count")),
        Rule("polypharmacy", med, 1, _flag("current_polypharmacy_flag"),
             "current polypharmacy at encounter review time", "polypharmacy",
             ("current_medication_count", "current_peak_concurrent_medication_count", "current_polypharmacy_flag",
              "historical_medication_count")),
        Rule("renal_terrain", terrain, 2,
             _flag("diagnosis_risk_renal_flag") | _flag("renal_risk_flag") | _safe(num["egfr_ml_min_1_73m2"] < 45),
             "reduced renal reserve or renal vulnerability", "renal vulnerability",
             ("ckd_flag", "renal_risk_flag", "egfr_ml_min_1_73m2")),
        Rule("cognitive_terrain", terrain, 2, _flag("diagnosis_risk_cognitive_flag"),
             "cognitive vulnerability from dementia or delirium context", "cognitive vulnerability",
             ("dementia_flag", "delirium_flag", "diagnosis_risk_cognitive_flag")),
        Rule("cardiometabolic_terrain", terrain, 1,
             _flag("diagnosis_risk_cardiac_flag") | _flag("diagnosis_risk_metabolic_flag"),
             "cardiac or metabolic comorbidity may narrow medication tolerance", "cardiometabolic terrain",
             ("heart_failure_flag", "diabetes_flag", "diagnosis_risk_cardiac_flag",
              "diagnosis_risk_metabolic_flag")),
        Rule("frailty_reserve", terrain, 1, _safe(num["age_proxy"] >= 85) | _safe(num["bmi"] < 20),
             "advanced age or low reserve may reduce physiologic tolerance", "reduced baseline reserve",
             ("age_proxy", "bmi", "weight_kg")),
        Rule("rising_creatinine", dynamic, 2, _safe(F.col("creatinine_trend_direction") == "rising"),
             "creatinine is rising during the encounter", "rising creatinine",
             ("creatinine_first", "creatinine_last", "creatinine_delta")),
        Rule("electrolyte_signal", dynamic, 1,
             outside("potassium_max", 3.5, 5.2) | outside("sodium_max", 135, 145),
             "electrolyte abnormality may increase medication-related instability", "electrolyte concern",
             ("potassium_min", "potassium_max", "sodium_min", "sodium_max")),
        Rule("hemodynamic_signal", dynamic, 1, _safe(num["sbp_min"] < 100) | _safe(num["heart_rate_max"] >= 110),
             "blood pressure or heart-rate instability is present", "hemodynamic instability",
             ("sbp_min", "sbp_max", "heart_rate_min", "heart_rate_max")),
        Rule("pain_signal", dynamic, 1, _safe(num["pain_max"] >= 7),
             "high pain burden may complicate deprescribing prioritization", "high pain burden",
             ("pain_min", "pain_max", "pain_mean")),
    ]


CLINICAL_RULE_INPUTS = {
    "drug": "string", "benzodiazepine_flag": "int", "opioid_flag": "int", "anticholinergic_flag": "int",
    "antipsychotic_flag": "int", "ppi_flag": "int", "current_medication_count": "bigint",
    "historical_medication_count": "bigint", "current_polypharmacy_flag": "int",
    "current_peak_concurrent_medication_count": "bigint", "diagnosis_risk_renal_flag": "int",
    "renal_risk_flag": "int", "egfr_ml_min_1_73m2": "double", "ckd_flag": "int",
    "diagnosis_risk_cognitive_flag": "int", "dementia_flag": "int", "delirium_flag": "int",
    "diagnosis_risk_cardiac_flag": "int", "diagnosis_risk_metabolic_flag": "int", "heart_failure_flag": "int",
    "diabetes_flag": "int", "age_proxy": "double", "bmi": "double", "weight_kg": "double",
    "creatinine_trend_direction": "string", "creatinine_first": "double", "creatinine_last": "double",
    "creatinine_delta": "double", "potassium_min": "double", "potassium_max": "double", "sodium_min": "double",
    "sodium_max": "double", "sbp_min": "double", "sbp_max": "double", "heart_rate_min": "double",
    "heart_rate_max": "double", "pain_min": "double", "pain_max": "double", "pain_mean": "double",
}


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add absent columns as typed nulls."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in have])


def rule_score(df: DataFrame, rules: list[Rule], caps: dict[str, int] | None = None,
               stems: dict[str, str] | None = None, fragments: int | None = None,
               labels: dict[str, str] | None = None) -> DataFrame:
    """Capped bucket points, total, level, ordered reasons, alert text and evidence JSON.

    The alert holds all fragments of its bucket, or the first ``fragments``. The evidence holds the values that the
    rules that hit have read, the label of each bucket and its reasons.
    """
    caps, stems, labels = caps or K.BUCKET_CAPS, stems or K.BUCKET_STEMS, labels or K.BUCKET_LABELS
    hits = df.select("*", *[r.test.alias(f"_hit_{r.name}") for r in rules])
    hit = {r.name: F.col(f"_hit_{r.name}") for r in rules}
    bucket = {
        b: F.least(
            reduce(lambda a, c: a + c, [F.when(hit[r.name], r.points).otherwise(0) for r in rules if r.bucket == b]),
            F.lit(cap),
        )
        for b, cap in caps.items()
    }
    scored = hits.select("*", *[c.alias(f"bucket_{b}") for b, c in bucket.items()])
    points = {b: F.col(f"bucket_{b}") for b in caps}
    total = reduce(lambda a, b: a + b, points.values())
    top = F.greatest(*points.values()) if len(points) > 1 else next(iter(points.values()))

    def texts(pick, only: str | None = None) -> Column:
        chosen = [r for r in rules if only is None or r.bucket == only]
        return F.array_compact(F.array(*[F.when(hit[r.name], F.lit(pick(r))) for r in chosen]))

    alert = F.lit(None).cast("string")
    for b in reversed(list(caps)):
        named = texts(lambda r: r.fragment, b)
        line = F.concat(
            F.lit(stems.get(b, "Structured signal") + ": "),
            F.array_join(named if fragments is None else F.slice(named, 1, fragments), ", "),
            F.lit("."),
        )
        alert = F.when(points[b] == top, line).otherwise(alert)
    fields: dict[str, Column] = {}
    for r in rules:
        for name in r.evidence:
            used = fields.get(name, F.lit(False))
            fields[name] = used | hit[r.name]
    parts = {n: F.when(used, F.col(n)) for n, used in fields.items()}
    parts["bucket_labels"] = F.struct(*[F.lit(labels.get(b, b)).alias(b) for b in sorted(caps)])
    parts["bucket_reasons"] = F.struct(*[texts(lambda r: r.reason, b).alias(b) for b in sorted(caps)])
    evidence = F.to_json(F.struct(*[parts[n].alias(n) for n in sorted(parts)]))
    reasons = texts(lambda r: r.reason)
    return scored.select(
        *df.columns,
        *[f"bucket_{b}" for b in caps],
        total.alias("priority_score"),
        to_level(total).alias("priority_level"),
        F.when(total == 0, K.NO_ALERT_TEXT).otherwise(alert).alias("summary_alert"),
        F.when(F.size(reasons) == 0, K.NO_RULE_TEXT).otherwise(F.array_join(reasons, "; ")).alias("explanation"),
        reasons.alias("reasons"),
        evidence.alias("evidence_json"),
    )


def checked_score(score: Column) -> Column:
    """The score, or a runtime error when it leaves the 0-10 range."""
    low, high = K.SCORE_RANGE
    message = F.lit("priority scores must stay within 0 and 10")
    value = score.cast("double")
    return F.when((value < low) | (value > high), F.raise_error(message).cast("double")).otherwise(value)


def to_level(score: Column) -> Column:
    value = checked_score(score)
    medium, high = K.LEVEL_CUTS
    return F.when(value < medium, "low").when(value < high, "medium").when(value.isNotNull(), "high")


def clean_level(level: Column) -> Column:
    """Trimmed lower-case level; an unknown word is a runtime error."""
    text = F.nullif(F.lower(F.trim(level)), F.lit(""))
    error = F.raise_error(F.lit("priority levels must be low, medium or high")).cast("string")
    return F.when(text.isin(*K.LEVELS) | text.isNull(), text).otherwise(error)


def resolve_level(score: Column, level: Column) -> Column:
    """The given level, checked against the score, else the level of the score."""
    given, derived = clean_level(level), to_level(score)
    error = F.raise_error(F.lit("level does not match score")).cast("string")
    return F.when(given != derived, error).otherwise(F.coalesce(given, derived))


def level_rank(level: Column) -> Column:
    return F.when(level == "low", 0).when(level == "medium", 1).when(level == "high", 2)


def compare_columns(left_level: Column, right_level: Column, left_score: Column, right_score: Column) -> dict[str, Column]:
    """Row-wise comparison, null where the two sides cannot be compared."""
    distance = F.abs(level_rank(left_level) - level_rank(right_level))
    both_scores = left_score.isNotNull() & right_score.isNotNull()
    return {
        "status": F.when(distance.isNull(), "unavailable")
        .when(both_scores, "level_and_score_available")
        .otherwise("level_only_available"),
        "same_level": (distance == 0).cast("int"),
        "exact_score": (F.round(left_score.cast("double"), 12) == F.round(right_score.cast("double"), 12)).cast("int"),
        "abs_score_error": F.abs(left_score.cast("double") - right_score.cast("double")),
        "level_distance": distance,
        "off_by_one": (distance == 1).cast("int"),
        "severe": (distance == 2).cast("int"),
    }

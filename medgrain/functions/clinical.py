"""Clinical arithmetic: renal estimates, body measures, trends, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medgrain import constants as K


def _female(sex: Column) -> Column:
    return F.coalesce(F.upper(F.trim(sex)) == "F", F.lit(False))


def egfr(age: Column, sex: Column, creatinine: Column) -> Column:
    """CKD-EPI 2021, rounded to 3 digits; null unless age and a positive creatinine are known."""
    female = _female(sex)
    ratio = creatinine / F.when(female, 0.7).otherwise(0.9)
    low = F.pow(F.least(ratio, F.lit(1.0)), F.when(female, -0.241).otherwise(-0.302))
    high = F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.2))
    value = F.lit(142.0) * low * high * F.pow(F.lit(0.9938), age) * F.when(female, 1.012).otherwise(1.0)
    return F.when(age.isNotNull() & (creatinine > 0), F.round(value, 3))


def cockcroft_gault(age: Column, sex: Column, weight_kg: Column, creatinine: Column) -> Column:
    value = ((F.lit(140.0) - age) * weight_kg) / (F.lit(72.0) * creatinine)
    value = F.when(_female(sex), value * 0.85).otherwise(value)
    return F.when(age.isNotNull() & (weight_kg > 0) & (creatinine > 0), F.round(value, 3))


def egfr_missing_reason(value: Column, age: Column, sex: Column, creatinine: Column) -> Column:
    return (
        F.when(value.isNotNull(), F.lit(None).cast("string"))
        .when(creatinine.isNull(), "missing_creatinine_first")
        .when(age.isNull(), "missing_age")
        .when(sex.isNull(), "missing_sex")
        .otherwise("invalid_egfr_inputs")
    )


def cockcroft_gault_missing_reason(
    value: Column, age: Column, sex: Column, weight_kg: Column, creatinine: Column
) -> Column:
    return (
        F.when(value.isNotNull(), F.lit(None).cast("string"))
        .when(weight_kg.isNull(), "missing_weight")
        .when(creatinine.isNull(), "missing_creatinine_first")
        .when(age.isNull(), "missing_age")
        .when(sex.isNull(), "missing_sex")
        .otherwise("invalid_cockcroft_gault_inputs")
    )


def kilograms(pounds: Column) -> Column:
    return F.round(pounds * K.POUNDS_TO_KG, 3)


def body_mass_index(bmi: Column, weight_kg: Column, height_in: Column) -> Column:
    """The measured index, else derived from weight and height."""
    metres = height_in * K.INCHES_TO_M
    derived = F.when(height_in > 0, F.round(weight_kg / (metres * metres), 3))
    return F.coalesce(bmi, derived)


def trend(delta: Column) -> Column:
    return (
        F.when(delta.isNull(), "unavailable")
        .when(delta >= K.TREND_DELTA, "rising")
        .when(delta <= -K.TREND_DELTA, "falling")
        .otherwise("stable")
    )


def age_band(age: Column) -> Column:
    return (
        F.when(age.isNull(), "unknown")
        .when(age >= 85, "85+")
        .when(age >= 75, "75-84")
        .when(age >= 65, "65-74")
        .otherwise("<65")
    )


def diagnosis_flag(code: Column, version: Column, prefixes: dict[int, tuple[str, ...]]) -> Column:
    """1 when the code starts with one of its version's prefixes."""
    tests = [
        (version == v) & F.startswith(F.upper(F.trim(code)), F.lit(p)) for v, ps in prefixes.items() for p in ps
    ]
    hit = tests[0]
    for test in tests[1:]:
        hit = hit | test
    return F.coalesce(hit, F.lit(False)).cast("int")

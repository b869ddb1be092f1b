"""Word lists, code lists, thresholds, weights and labels.

They must equal the published definitions for the results to agree, so they are stated
here as plain data and nowhere else.
"""

from __future__ import annotations

# -- names -----------------------------------------------------------------
NAME_STOPWORDS = (
    "dr", "er", "xr", "sr", "cr", "ec", "ir", "mg", "mcg", "g", "ml",
    "tablet", "tablets", "tab", "tabs", "capsule", "capsules", "cap", "caps",
)
NAME_NULL_WORDS = ("0", "nan", "none", "___")
QUERY_NULL_WORDS = ("nan", "none", "___")

# -- medication classes ----------------------------------------------------
SUPPORTED_CLASSES = ("benzodiazepine", "opioid", "anticholinergic", "ppi", "antipsychotic")
CLASS_INGREDIENTS = {
    "benzodiazepine": ("alprazolam", "clonazepam", "diazepam", "lorazepam", "midazolam", "temazepam"),
    "opioid": (
        "codeine", "fentanyl", "hydrocodone", "hydromorphone", "methadone", "morphine", "oxycodone", "tramadol",
    ),
    "anticholinergic": (
        "benztropine", "diphenhydramine", "hydroxyzine", "oxybutynin", "promethazine", "scopolamine", "tolterodine",
    ),
    "ppi": ("dexlansoprazole", "esomeprazole", "lansoprazole", "omeprazole", "pantoprazole", "rabeprazole"),
    "antipsychotic": (
        "aripiprazole", "chlorpromazine", "clozapine", "haloperidol", "olanzapine", "quetiapine", "risperidone",
        "ziprasidone",
    ),
}
CLASS_KEYWORDS = CLASS_INGREDIENTS
SALT_SUFFIXES = (" citrate", " hydrochloride", " sodium", " tartrate", " succinate")

# -- diagnoses -------------------------------------------------------------
DIAGNOSIS_PREFIXES = {
    "ckd_flag": {9: ("585",), 10: ("N18",)},
    "dementia_flag": {9: ("290", "2941", "3310"), 10: ("F01", "F02", "F03", "G30")},
    "delirium_flag": {9: ("2930", "2931", "78009"), 10: ("F05", "R410", "R4182")},
    "heart_failure_flag": {9: ("428",), 10: ("I50",)},
    "diabetes_flag": {9: ("250",), 10: ("E08", "E09", "E10", "E11", "E13")},
}
DIAGNOSIS_RISK_GROUPS = {
    "diagnosis_risk_renal_flag": ("ckd_flag",),
    "diagnosis_risk_cognitive_flag": ("dementia_flag", "delirium_flag"),
    "diagnosis_risk_cardiac_flag": ("heart_failure_flag",),
    "diagnosis_risk_metabolic_flag": ("diabetes_flag",),
}

# -- labs and thresholds ---------------------------------------------------
CREATININE_ITEMS = (50912, 51081, 51977, 52546)
POTASSIUM_ITEMS = (50971, 52610, 50822, 52452)
SODIUM_ITEMS = (50983, 52623, 50824, 52455)
RENAL_CREATININE_THRESHOLD = 1.5
OLDER_ADULT_AGE = 65
POLYPHARMACY_COUNT = 5
TREND_DELTA = 0.3
LOOKBACK_DAYS = 365
EPISODE_GAP_HOURS = 12
POUNDS_TO_KG = 0.45359237
INCHES_TO_M = 0.0254

HARM_RENAL_DELTA = 0.3
HARM_RENAL_RATIO = 1.5
HARM_POTASSIUM = (3.0, 5.5)
HARM_SODIUM = (130.0, 150.0)
HARM_SBP_LOW = 90.0
HARM_HEART_RATE_HIGH = 120.0
HARM_RESP_LOW = 8.0
HARM_O2SAT_LOW = 90.0

ACUTE_INGREDIENTS = ("fentanyl", "midazolam")
DIFFERENT_LOGIC_INGREDIENTS = ("methadone",)
ACUTE_ROUTES = ("iv", "intravenous", "im", "intramuscular")
PRN_DOWNWEIGHT_CLASSES = ("benzodiazepine", "opioid")
ACUTE_NEW_START_HOURS = 24.0

# -- event kinds, statuses, policies --------------------------------------
KIND_HOME, KIND_ED, KIND_ORDER, KIND_ADMIN = "home_medrecon", "ed_pyxis", "hospital_order", "hospital_admin"
POINT_KINDS = (KIND_ED, KIND_ADMIN)
STATUS_ACTIVE = "active_at_review_time"
STATUS_INACTIVE = "inactive_before_review_time"
STATUS_PRE_ADMISSION = "pre_admission_only"
STATUS_UNCERTAIN = "activity_uncertain_at_review_time"
SOURCE_ADMIN, SOURCE_ORDER = "medication_administration", "medication_order"
SOURCE_LAB, SOURCE_VITALS = "lab", "vitals"
SOURCE_END, SOURCE_BOUNDARY = "encounter_end", "encounter_boundary"
POLICIES = ("latest_available", "bounded_latest_available", "discharge_capped_latest_available")
RESOLUTION_PRECEDENCE = (
    "resolved_to_ingredient", "resolved_via_related_concept", "resolved_term_only_no_ingredient",
    "unresolved_ambiguous_multi_hit", "unresolved_cache_only_miss", "unresolved_api_error", "unresolved_no_match",
)
CONFIDENCE_PRECEDENCE = ("high", "medium", "low", "none")
CLASS_STATUS_PRECEDENCE = (
    "supported_scope_class_assigned", "supported_scope_unresolved", "no_standardized_ingredient_available",
    "class_enrichment_not_attempted",
)
RETRYABLE_STATUSES = ("unresolved_api_error", "unresolved_cache_only_miss")

# -- schedule text ---------------------------------------------------------
PRN_PATTERN = r"(^|[\s/;,])(prn|as needed|as-needed)($|[\s/;,])"
SCHEDULED_PATTERN = (
    r"(^|[\s/;,])"
    r"(bid|tid|qid|qam|qpm|qhs|hs|daily|weekly|monthly|nightly|scheduled|once|stat|"
    r"q\d+h|q\d+hr|q\d+hrs|every\s+\d+\s*h|every\s+\d+\s*hour|every\s+day|"
    r"\d+\s*x\s*(daily|day))"
    r"($|[\s/;,])"
)

# -- priority levels and queues -------------------------------------------
LEVELS = ("low", "medium", "high")
LEVEL_CUTS = (4.0, 7.0)
SCORE_RANGE = (0.0, 10.0)
BUCKET_CAPS = {
    "base_medication_risk": 4, "terrain_aggravating_context": 3, "dynamic_biologic_vital_evidence": 3,
}
BUCKET_STEMS = {
    "base_medication_risk": "Medication risk signal",
    "terrain_aggravating_context": "Patient context aggravates medication risk",
    "dynamic_biologic_vital_evidence": "Dynamic clinical evidence raises concern",
}
BUCKET_LABELS = {
    "base_medication_risk": "Base Medication Risk",
    "terrain_aggravating_context": "Terrain / Aggravating Patient Context",
    "dynamic_biologic_vital_evidence": "Dynamic Biologic / Vital Evidence",
}
NO_ALERT_TEXT = "No strong immediate deprescribing alert from the current structured evidence."
NO_RULE_TEXT = "no major structured IPD rule triggered"
QUEUE_WEIGHTS = {
    "unreviewed": 1000, "disagreement": 200, "signal_rank": 40, "unbenchmarked": 60, "ambiguous": 30,
    "excluded": 20, "class_zero": 45, "subject_zero": 25, "encounter_zero": 15, "supported": 10,
}
BLIND_WEIGHTS = {"disagreement": 400, "uncertain": 320, "boundary": 240, "fallback": 160, "unreviewed": 20}
BLIND_MARGIN, BLIND_HIGH_PROBABILITY, BLIND_MINIMUM_ROWS = 0.18, 0.60, 24
AMBIGUOUS_ACTIONS = ("action_undetermined", "window_censored")
MILESTONES = {"rows": 24, "subjects": 8, "encounters": 8, "classes": 3, "expanded_rows": 60, "per_level": 5}

# -- labels ----------------------------------------------------------------
ACTION_STOPPED = "stopped_or_deintensified_before_discharge"
ACTION_CONTINUED = "no_clear_stop_or_deintensification_before_discharge"
ACTION_UNDETERMINED = "action_undetermined"
ACTION_CENSORED = "window_censored"

# -- dataset roles ---------------------------------------------------------
GRAIN = ("subject_id", "encounter_id", "medication_standardized", "review_timestamp")
FEATURE_EXACT_EXCLUSIONS = (
    "hadm_id", "stay_id", "review_timestamp_source", "review_time_validated_flag", "review_time_policy_name",
    "review_time_capped_to_discharge_flag", "source_home_medrecon_flag", "source_ed_pyxis_flag",
    "source_hospital_order_flag", "source_hospital_admin_flag", "feature_available_as_of_review_time_flag",
    "feature_window_end_at_or_before_review_time_flag", "state_source_tables_json", "feature_source_tables_json",
    "missingness_profile_json", "first_scope_feature_store_build_run_id", "first_scope_feature_store_contract_version",
)
FEATURE_SUFFIX_EXCLUSIONS = (
    "_provenance", "_missingness", "_unavailable_reason", "_source_tables_json", "_build_run_id",
    "_contract_version", "_window_start", "_window_end", "_latest_time", "_time",
)
FEATURE_CONTAINS_EXCLUSIONS = ("_at_or_before_review_time_flag", "_available_as_of_review_time_flag")

"""Raw table specs: fixed required and optional columns, with types given by name."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

INTEGER_COLUMNS = (
    "subject_id", "hadm_id", "stay_id", "pharmacy_id", "emar_seq", "labevent_id", "specimen_id", "itemid",
    "seq_num", "icd_version", "anchor_age", "anchor_year", "hospital_expire_flag",
)  # emar_id is a composite text id and stays text
FLOAT_COLUMNS = (
    "valuenum", "ref_range_lower", "ref_range_upper", "temperature", "heartrate", "resprate", "o2sat", "sbp",
    "dbp", "pain", "acuity",
)
LINEAGE_COLUMNS = (
    "_source_dataset", "_source_table", "_source_file", "_source_file_size_bytes", "_source_last_modified_at",
    "_ingestion_run_id", "_ingested_at",
)


@dataclass(frozen=True)
class TableSpec:
    """One raw table: where it lies and which columns it must and may have."""

    dataset: str
    name: str
    subdir: str
    required: bool
    required_columns: tuple[str, ...]
    optional_columns: tuple[str, ...] = ()
    types: dict[str, str] = field(default_factory=dict)
    line_ends: bool = True  # quoted fields may hold line ends, so a file cannot be read in splits

    @property
    def expected(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.required_columns, *self.optional_columns)))

    def type_of(self, column: str) -> str:
        """Declared type, else the rule for the column's name."""
        if column in self.types:
            return self.types[column]
        if column in INTEGER_COLUMNS:
            return "bigint"
        if column in FLOAT_COLUMNS:
            return "double"
        if column.endswith(("time", "date")) or column == "dod":
            return "timestamp_ntz"
        return "string"


#: Known tables with free text; all others hold no line ends and are read in splits.
FREE_TEXT = ("triage",)
# Fixed column lists of the fifteen known tables.
SPECS = {
    s.name: replace(s, line_ends=s.name in FREE_TEXT)
    for s in (
        TableSpec("clinical", "patients", "hosp", True, ("subject_id", "gender", "anchor_age"),
                  ("anchor_year", "anchor_year_group", "dod")),
        TableSpec("clinical", "admissions", "hosp", True, ("subject_id", "hadm_id", "admittime", "dischtime"),
                  ("deathtime", "admission_type", "admission_location", "discharge_location", "insurance",
                   "language", "marital_status", "race", "edregtime", "edouttime", "hospital_expire_flag")),
        TableSpec("clinical", "prescriptions", "hosp", True,
                  ("subject_id", "hadm_id", "starttime", "stoptime", "drug"),
                  ("pharmacy_id", "poe_id", "drug_type", "gsn", "ndc", "prod_strength", "form_rx", "dose_val_rx",
                   "dose_unit_rx", "route", "doses_per_24_hrs")),
        TableSpec("clinical", "diagnoses_icd", "hosp", True, ("subject_id", "hadm_id", "icd_code", "icd_version"),
                  ("seq_num",)),
        TableSpec("clinical", "labevents", "hosp", True, ("subject_id", "hadm_id", "itemid", "charttime", "valuenum"),
                  ("labevent_id", "specimen_id", "order_provider_id", "storetime", "value", "valueuom",
                   "ref_range_lower", "ref_range_upper", "flag", "priority", "comments")),
        TableSpec("clinical", "omr", "hosp", False, ("subject_id",),
                  ("chartdate", "seq_num", "result_name", "result_value")),
        TableSpec("clinical", "pharmacy", "hosp", False, ("subject_id", "hadm_id"),
                  ("pharmacy_id", "poe_id", "starttime", "stoptime", "proc_type", "status", "medication",
                   "entertime", "verifiedtime", "route", "frequency", "disp_sched", "infusion_type",
                   "sliding_scale", "lockout_interval", "basal_rate", "one_hr_max", "doses_per_24_hrs", "duration",
                   "duration_interval", "expiration_value", "expiration_unit", "fill_quantity")),
        TableSpec("clinical", "emar", "hosp", False, ("subject_id", "hadm_id"),
                  ("emar_id", "emar_seq", "poe_id", "pharmacy_id", "medication", "event_txt", "charttime",
                   "scheduletime", "storetime")),
        TableSpec("clinical", "emar_detail", "hosp", False, ("subject_id", "emar_id", "emar_seq"),
                  ("parent_field_ordinal", "administration_type", "pharmacy_id", "barcode_type",
                   "reason_for_no_barcode", "complete_dose_not_given", "dose_due", "dose_due_unit", "dose_given",
                   "dose_given_unit", "will_remainder_of_dose_be_given", "product_amount_given", "product_unit",
                   "route", "storetime")),
        TableSpec("ed", "edstays", "ed", True,
                  ("subject_id", "hadm_id", "stay_id", "intime", "outtime", "gender", "race", "arrival_transport",
                   "disposition")),
        TableSpec("ed", "diagnosis", "ed", False, ("subject_id", "stay_id"),
                  ("seq_num", "icd_code", "icd_title", "icd_version")),
        TableSpec("ed", "triage", "ed", False, ("subject_id", "stay_id", "chiefcomplaint", "acuity"),
                  ("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "pain", "arrival_transport",
                   "charttime")),
        TableSpec("ed", "vitalsign", "ed", False, ("subject_id", "stay_id"),
                  ("charttime", "temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "rhythm", "pain")),
        TableSpec("ed", "medrecon", "ed", False, ("subject_id", "stay_id", "name"),
                  ("gsn", "ndc", "etc_rn", "etccode", "etcdescription", "charttime")),
        TableSpec("ed", "pyxis", "ed", False, ("subject_id", "stay_id"),
                  ("charttime", "med_rn", "name", "gsn_rn")),
    )
}

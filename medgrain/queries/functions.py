"""Scalar-function queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from medgrain import constants as K
from medgrain.functions import clinical, jsoncols, names, scoring, status, times
from medgrain.functions.scoring import Rule
from medgrain.plans.review import review_times
from medgrain.queries.aggregates import LEVELS_SQL, TREND_SQL, clinical as clinical_events, level_rows
from medgrain.queries.registry import ENC, EV, LABS, query

c = F.col

STOP = ", ".join(f"'{w}'" for w in K.NAME_STOPWORDS)


def norm_sql(x: str) -> str:
    """The name key in SQL."""
    base = f"regexp_replace(regexp_replace(lower(trim({x})), '^\\*+', ''), '[^a-z0-9]+', ' ', 'g')"
    words = f"[w_ FOR w_ IN string_split_regex({base}, '\\s+') IF w_ <> '' AND w_ NOT IN ({STOP})]"
    return f"CASE WHEN lower(trim({x})) IN ('', '0', 'nan', 'none', '___') THEN NULL ELSE nullif(array_to_string({words}, ' '), '') END"


RAW = "CASE WHEN p_size = 7 THEN 'NaN' WHEN p_size = 8 THEN ' ___ ' ELSE '**' || p_type || '-' || p_name || '  ' || p_size || ' MG Tab XR' END"


def raw_name():
    return (F.when(c("p_size") == 7, "NaN").when(c("p_size") == 8, " ___ ").otherwise(
        F.concat(F.lit("**"), "p_type", F.lit("-"), "p_name", F.lit("  "), c("p_size").cast("string"), F.lit(" MG Tab XR"))))


@query("fn_normalize_name", "id:l kind:s key:s", f"""
SELECT p_partkey AS id, 'part' AS kind, {norm_sql("(" + RAW + ")")} AS key FROM part
UNION ALL SELECT doc_id, 'document', {norm_sql("text")} FROM documents""")
def fn_normalize_name(t):
    p = t.part.select(c("p_partkey").alias("id"), F.lit("part").alias("kind"), names.normalize_name(raw_name()).alias("key"))
    d = t.documents.select(c("doc_id").alias("id"), F.lit("document").alias("kind"), names.normalize_name(c("text")).alias("key"))
    return p.unionByName(d)


@query("fn_match_key", "id:l key:s", """
SELECT p_partkey AS id, nullif(array_to_string([w_ FOR w_ IN string_split_regex(trim(p_name || ' ' || p_size || ' 2.5 x3 ' || p_partkey), '\\s+')
  IF w_ <> '' AND NOT regexp_full_match(w_, '\\d+(\\.\\d+)?')], ' '), '') AS key FROM part""")
def fn_match_key(t):
    text = F.concat_ws(" ", "p_name", c("p_size").cast("string"), F.lit("2.5 x3"), c("p_partkey").cast("string"))
    return t.part.select(c("p_partkey").alias("id"), names.match_key(text).alias("key"))


@query("fn_query_key", "id:l q:s k:s", f"""
SELECT p_partkey AS id, CASE WHEN lower(trim(r)) IN ('', 'nan', 'none', '___') THEN NULL ELSE nullif(regexp_replace(regexp_replace(trim(r), '^\\*+', ''), '\\s+', ' ', 'g'), '') END AS q,
  coalesce(nullif(trim(CASE WHEN p_size > 25 THEN p_brand ELSE '  ' END), ''), nullif(trim(CASE WHEN p_size > 10 THEN p_type END), ''), p_name) AS k
FROM (SELECT *, {RAW} AS r FROM part)""")
def fn_query_key(t):
    a = F.when(c("p_size") > 25, c("p_brand")).otherwise("  ")
    return t.part.select(c("p_partkey").alias("id"), names.query_text(raw_name()).alias("q"),
                         names.query_key(a, F.when(c("p_size") > 10, c("p_type")), c("p_name")).alias("k"))


FREQ = {"1": " Q6H  PRN", "2": "q4h", "3": "12", "5": "As Needed"}


@query("fn_schedule_regex", "o_orderkey:l kind:s", f"""
WITH f AS (SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN ' Q6H  PRN' WHEN '2' THEN 'q4h' WHEN '3' THEN '12' WHEN '5' THEN 'As Needed' END AS fr,
  CASE o_orderstatus WHEN 'F' THEN 'Daily' WHEN 'P' THEN '  ' END AS st FROM orders),
x AS (SELECT o_orderkey, concat_ws(' ', nullif(trim(regexp_replace(lower(fr), '\\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(lower(st), '\\s+', ' ', 'g')), '')) AS tx FROM f)
SELECT o_orderkey, CASE WHEN tx = '' THEN 'unknown' WHEN regexp_matches(tx, '{K.PRN_PATTERN}') THEN 'prn'
  WHEN regexp_matches(tx, '^\\d+$') OR regexp_matches(tx, '{K.SCHEDULED_PATTERN}') THEN 'scheduled' ELSE 'unknown' END AS kind FROM x""")
def fn_schedule_regex(t):
    freq = F.lit(None).cast("string")
    for k, v in FREQ.items():
        freq = F.when(c("o_orderpriority").startswith(k), v).otherwise(freq)
    st = F.when(c("o_orderstatus") == "F", "Daily").when(c("o_orderstatus") == "P", "  ")
    return t.orders.select("o_orderkey", names.schedule(freq, st).alias("kind"))


WORDS = {"alpha": ("tion", "elle"), "beta": ("sch", "ung"), "gamma": ("eron", "thwh")}


@query("fn_keyword_flags", "doc_id:l alpha_flag:i beta_flag:i gamma_flag:i any_flag:i", """
SELECT *, greatest(alpha_flag, beta_flag, gamma_flag) AS any_flag FROM (SELECT doc_id,
  regexp_matches(lower(text), 'tion|elle')::INT AS alpha_flag, regexp_matches(lower(text), 'sch|ung')::INT AS beta_flag,
  regexp_matches(lower(text), 'eron|thwh')::INT AS gamma_flag FROM documents)""")
def fn_keyword_flags(t):
    d = t.documents.select("doc_id", *names.keyword_flags(names.first_text(F.lit(None), c("text"), c("lang")), WORDS).values())
    return d.withColumn("any_flag", F.greatest("alpha_flag", "beta_flag", "gamma_flag"))


DICT_SQL = ", ".join(f"('{i}', '{k}')" for k, v in K.CLASS_INGREDIENTS.items() for i in v)
LABEL = """CASE p_size % 6 WHEN 0 THEN 'Morphine Sodium' WHEN 1 THEN ' fentanyl/omeprazole' WHEN 2 THEN 'haloperidol  / ' || p_name
  WHEN 3 THEN 'diazepam citrate/codeine' WHEN 4 THEN p_name END"""


@query("fn_dictionary_class", "p_partkey:l classes:s", f"""
WITH d(ing, cl) AS (VALUES {DICT_SQL}), p AS (SELECT p_partkey, lower(nullif(trim({LABEL}), '')) AS lab FROM part),
s AS (SELECT DISTINCT lab, unnest(CASE WHEN contains(lab, '/') THEN list_concat([lab], [trim(x_) FOR x_ IN string_split(lab, '/')]) ELSE [lab] END) AS part FROM p WHERE lab IS NOT NULL),
k AS (SELECT lab, part AS cand FROM s UNION SELECT lab, trim(regexp_replace(part, ' (citrate|hydrochloride|sodium|tartrate|succinate)$', '')) FROM s),
h AS (SELECT lab, string_agg(DISTINCT cl, '|' ORDER BY cl) AS classes FROM k JOIN d ON cand = ing GROUP BY 1)
SELECT p_partkey, coalesce(classes, 'unresolved') AS classes FROM p LEFT JOIN h ON p.lab = h.lab""")
def fn_dictionary_class(t):
    s = c("p_size") % 6
    label = (F.when(s == 0, "Morphine Sodium").when(s == 1, " fentanyl/omeprazole")
             .when(s == 2, F.concat(F.lit("haloperidol  / "), "p_name")).when(s == 3, "diazepam citrate/codeine").when(s == 4, c("p_name")))
    return names.class_labels(t.part.withColumn("label", F.lower(names.blank_to_null(label))), "label",
                              names.ingredient_classes(t.spark), "classes")


@query("fn_status_case", "o_orderkey:l cs:s rs:s", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'supported_scope_class_assigned' WHEN o_orderstatus = 'F' THEN 'supported_scope_unresolved'
  WHEN o_orderstatus = 'O' THEN 'no_standardized_ingredient_available' ELSE 'class_enrichment_not_attempted' END AS cs,
  CASE WHEN o_orderstatus = 'F' THEN 'active_at_review_time' WHEN o_custkey % 2 = 0 THEN 'pre_admission_only' WHEN o_totalprice < 200000 THEN 'inactive_before_review_time'
  ELSE 'activity_uncertain_at_review_time' END AS rs FROM orders""")
def fn_status_case(t):
    kind = F.when(c("o_orderpriority") == "1-URGENT", "opioid").otherwise("unresolved")
    ing = F.when(c("o_orderstatus") == "F", K.RESOLUTION_PRECEDENCE[0]).when(c("o_orderstatus") == "O", K.RESOLUTION_PRECEDENCE[2])
    rs = status.review_status((c("o_orderstatus") == "F").cast("int"), (c("o_custkey") % 2).cast("int"), c("o_totalprice"), F.lit(200000))
    return t.orders.select("o_orderkey", status.class_status(kind, ing).alias("cs"), rs.alias("rs"))


@query("fn_egfr", "lab_id:s egfr:d why:s", f"""
WITH {ENC}, {LABS}, x AS (SELECT lab_id, CASE WHEN age_proxy > 3 THEN age_proxy END AS age, CASE WHEN age_proxy % 7 > 0 THEN sex END AS sex,
  CASE WHEN itemid = 3 THEN NULL WHEN itemid = 2 THEN 0.0 ELSE valuenum END AS cr FROM labs JOIN enc ON labs.hadm_id = enc.hadm_id),
y AS (SELECT *, coalesce(sex = 'F', false) AS f FROM x),
z AS (SELECT *, CASE WHEN age IS NOT NULL AND cr > 0 THEN round(142.0::DOUBLE * pow(least(cr / CASE WHEN f THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END, 1.0), CASE WHEN f THEN -0.241::DOUBLE ELSE -0.302::DOUBLE END)
  * pow(greatest(cr / CASE WHEN f THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END, 1.0), -1.2::DOUBLE) * pow(0.9938::DOUBLE, age) * CASE WHEN f THEN 1.012::DOUBLE ELSE 1.0::DOUBLE END, 3) END AS egfr FROM y)
SELECT lab_id, egfr, CASE WHEN egfr IS NOT NULL THEN NULL WHEN cr IS NULL THEN 'missing_creatinine_first' WHEN age IS NULL THEN 'missing_age'
  WHEN sex IS NULL THEN 'missing_sex' ELSE 'invalid_egfr_inputs' END AS why FROM z""")
def fn_egfr(t):
    j = t.labs().drop("subject_id").join(t.encounters(), "hadm_id")
    age, sex = F.when(c("age_proxy") > 3, c("age_proxy")), F.when(c("age_proxy") % 7 > 0, c("sex"))
    cr = F.when(c("itemid") == 3, F.lit(None)).when(c("itemid") == 2, F.lit(0.0)).otherwise(c("valuenum"))
    v = clinical.egfr(age, sex, cr)
    return j.select("lab_id", v.alias("egfr"), clinical.egfr_missing_reason(v, age, sex, cr).alias("why"))


@query("fn_cockcroft_gault", "lab_id:s crcl:d why:s", f"""
WITH {ENC}, {LABS}, x AS (SELECT lab_id, CASE WHEN age_proxy > 3 THEN age_proxy END AS age, sex, CASE WHEN price > 50000 THEN price / 4000 END AS kg,
  CASE WHEN itemid = 3 THEN NULL WHEN itemid = 2 THEN 0.0 ELSE valuenum END AS cr FROM labs JOIN enc ON labs.hadm_id = enc.hadm_id),
z AS (SELECT *, CASE WHEN age IS NOT NULL AND kg > 0 AND cr > 0 THEN round(((140.0::DOUBLE - age) * kg) / (72.0::DOUBLE * cr) * CASE WHEN sex = 'F' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 3) END AS crcl FROM x)
SELECT lab_id, crcl, CASE WHEN crcl IS NOT NULL THEN NULL WHEN kg IS NULL THEN 'missing_weight' WHEN cr IS NULL THEN 'missing_creatinine_first'
  WHEN age IS NULL THEN 'missing_age' WHEN sex IS NULL THEN 'missing_sex' ELSE 'invalid_cockcroft_gault_inputs' END AS why FROM z""")
def fn_cockcroft_gault(t):
    j = t.labs().drop("subject_id").join(t.encounters(), "hadm_id")
    age, kg = F.when(c("age_proxy") > 3, c("age_proxy")), F.when(c("price") > 50000, c("price") / 4000)
    cr = F.when(c("itemid") == 3, F.lit(None)).when(c("itemid") == 2, F.lit(0.0)).otherwise(c("valuenum"))
    v = clinical.cockcroft_gault(age, c("sex"), kg, cr)
    return j.select("lab_id", v.alias("crcl"), clinical.cockcroft_gault_missing_reason(v, age, c("sex"), kg, cr).alias("why"))


@query("fn_bmi", "c_custkey:l kg:d bmi:d", """
WITH x AS (SELECT c_custkey, round((90 + (c_acctbal + 1000) / 50) * 0.45359237::DOUBLE, 3) AS kg, CASE WHEN c_custkey % 9 > 0 THEN 55 + c_custkey % 20 END AS h,
  CASE WHEN c_custkey % 5 = 0 THEN 20 + c_nationkey / 10 END AS b FROM customer)
SELECT c_custkey, kg, coalesce(b, CASE WHEN h > 0 THEN round(kg / ((h * 0.0254::DOUBLE) * (h * 0.0254::DOUBLE)), 3) END) AS bmi FROM x""")
def fn_bmi(t):
    kg = clinical.kilograms((c("c_acctbal") + 1000) / 50 + 90)
    h = F.when(c("c_custkey") % 9 > 0, c("c_custkey") % 20 + 55)
    b = F.when(c("c_custkey") % 5 == 0, c("c_nationkey") / 10 + 20)
    return t.customer.select("c_custkey", kg.alias("kg"), clinical.body_mass_index(b, kg, h).alias("bmi"))


@query("fn_trend", "event_id:l d:d trend:s", f"""
SELECT event_id, d, {TREND_SQL.format("d")} AS trend FROM (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN (value - 50) / 100 END AS d FROM events)""")
def fn_trend(t):
    d = F.when(c("event_id") % 7 > 0, (c("value") - 50) / 100)
    return t.events.select("event_id", d.alias("d"), clinical.trend(d).alias("trend"))


@query("fn_band", "c_custkey:l band:s", """
SELECT c_custkey, CASE WHEN a IS NULL THEN 'unknown' WHEN a >= 85 THEN '85+' WHEN a >= 75 THEN '75-84' WHEN a >= 65 THEN '65-74' ELSE '<65' END AS band
FROM (SELECT c_custkey, CASE WHEN c_acctbal > -500 THEN floor((c_acctbal + 1000) / 110) END AS a FROM customer)""")
def fn_band(t):
    a = F.when(c("c_acctbal") > -500, F.floor((c("c_acctbal") + 1000) / 110))
    return t.customer.select("c_custkey", clinical.age_band(a).alias("band"))


@query("fn_duration", "event_id:l days:d hours:d", """
SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 8.64e10, 3) AS days, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9, 3) AS hours FROM events""")
def fn_duration(t):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return t.events.select("event_id", times.days_between(start, c("ts")).alias("days"), times.hours_between(start, c("ts")).alias("hours"))


@query("fn_ts_format", "o_orderkey:l text:s back:s", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS text, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS back FROM orders""")
def fn_ts_format(t):
    text = times.fmt_ts(c("o_orderdate"))
    broken = F.when(c("o_orderkey") % 4 == 0, F.concat(F.lit("x"), text)).otherwise(text)
    return t.orders.select("o_orderkey", text.alias("text"), times.parse_ts(broken).alias("back"))


@query("fn_first_latest", "id:s f:s l:s", f"""
WITH {EV} SELECT event_id AS id, coalesce(stoptime, CASE WHEN enriched = 1 THEN starttime END, admittime) AS f,
  greatest(stoptime, CASE WHEN enriched = 1 THEN starttime END, admittime) AS l FROM ev""")
def fn_first_latest(t):
    b = F.when(c("enriched") == 1, c("starttime"))
    return t.med_events().select(c("event_id").alias("id"), times.first_valid(c("stoptime"), b, c("admittime")).alias("f"),
                                 times.latest_valid(c("stoptime"), b, c("admittime")).alias("l"))


@query("fn_encounter_id", "k:l id:s", """
SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN 'hadm:' || l_orderkey WHEN l_returnflag = 'A' THEN 'stay:' || l_suppkey ELSE 'subject:' || l_partkey END AS id FROM lineitem""")
def fn_encounter_id(t):
    h, s = F.when(c("l_returnflag") == "R", c("l_orderkey")), F.when(c("l_returnflag") != "N", c("l_suppkey"))
    return t.lineitem.select(c("l_orderkey").alias("k"), times.encounter_id(h, s, c("l_partkey")).alias("id"))


REVIEW_SQL = f"""
WITH {ENC}, {EV}, {LABS},
m AS (SELECT encounter_id, max(CASE WHEN kind IN ('hospital_admin', 'ed_pyxis') THEN a END) AS ad,
  max(CASE WHEN kind = 'hospital_order' THEN greatest(b, a) END) AS od
  FROM (SELECT *, CASE WHEN enriched = 1 THEN starttime END AS a, CASE WHEN enriched = 1 THEN stoptime END AS b FROM ev) GROUP BY 1),
l AS (SELECT hadm_id, max(CASE WHEN itemid = 0 THEN charttime END) AS lb FROM labs GROUP BY 1), v AS (SELECT event_id AS hadm_id, max(ts) AS vt FROM events GROUP BY 1),
x AS (SELECT e.encounter_id, dischtime, ad, od, lb, vt, coalesce(ad, od, lb, vt, dischtime) AS cand,
  CASE WHEN ad IS NOT NULL THEN 'medication_administration' WHEN od IS NOT NULL THEN 'medication_order' WHEN lb IS NOT NULL THEN 'lab' WHEN vt IS NOT NULL THEN 'vitals' ELSE 'encounter_end' END AS src
  FROM enc e LEFT JOIN m ON e.encounter_id = m.encounter_id LEFT JOIN l ON e.hadm_id = l.hadm_id LEFT JOIN v ON e.hadm_id = v.hadm_id)"""


def review_frame(t, policy):
    enc = t.encounters().withColumn("stay_id", c("hadm_id"))
    # Some times are unknown, so that every source decides for some encounter.
    timed = {n: F.when(c("enriched") == 1, c(n)) for n in ("starttime", "stoptime")}
    e = clinical_events(t.med_events().withColumns(timed)).withColumn("event_time", c("starttime"))
    labs = t.labs().withColumn("charttime", F.when(c("itemid") == 0, c("charttime")))
    vitals = t.events.join(t.orders, c("event_id") == c("o_orderkey")).select(
        c("o_custkey").alias("subject_id"), c("event_id").alias("stay_id"), c("ts").alias("charttime"))
    return review_times(enc, e, labs, vitals, policy)


@query("fn_review_time", "encounter_id:s at:s src:s", REVIEW_SQL + " SELECT encounter_id, cand AS at, src FROM x")
def fn_review_time(t):
    r = review_frame(t, "latest_available")
    return r.select("encounter_id", c("review_timestamp").alias("at"), c("review_timestamp_source").alias("src"))


@query("fn_policy_cap", "encounter_id:s at:s src:s cand:s capped:i", REVIEW_SQL + """
SELECT encounter_id, least(cand, dischtime) AS at, CASE WHEN cand > dischtime THEN 'encounter_boundary' ELSE src END AS src, cand, (cand > dischtime)::INT AS capped FROM x""")
def fn_policy_cap(t):
    r = review_frame(t, "discharge_capped_latest_available")
    return r.select("encounter_id", c("review_timestamp").alias("at"), c("review_timestamp_source").alias("src"),
                    c("review_timestamp_candidate").alias("cand"), c("review_time_capped_to_discharge_flag").alias("capped"))


@query("fn_start_context", "k:l ctx:s", """
SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'mixed_evidence' WHEN l_returnflag = 'R' THEN 'continued_from_home'
  WHEN l_linestatus = 'F' THEN 'new_start_during_encounter' ELSE 'neither_or_unknown' END AS ctx FROM lineitem""")
def fn_start_context(t):
    a, b = F.when(c("l_returnflag") == "R", 1), (c("l_linestatus") == "F").cast("int")
    return t.lineitem.select(c("l_orderkey").alias("k"), status.start_context(a, b).alias("ctx"))


@query("fn_missing_fields", "id:s mme:s fields:s renal:s", f"""
WITH {EV}, x AS (SELECT *, [z_ FOR z_ IN [CASE WHEN dose_unit IS NULL THEN '"dose_unit"' END, CASE WHEN route IS NULL THEN '"route"' END] IF z_ IS NOT NULL] AS m FROM ev)
SELECT event_id AS id, CASE WHEN med <> 'small' THEN 'not_opioid' WHEN len(m) > 0 THEN 'missing_required_fields' ELSE 'ready_for_future_conversion' END AS mme,
  '[' || CASE WHEN med = 'small' THEN array_to_string(m, ',') ELSE '' END || ']' AS fields,
  CASE WHEN enriched = 0 THEN 'not_current_medication' WHEN dose_unit IS NOT NULL AND route IS NOT NULL AND continued = 1 THEN 'ready_for_future_logic' ELSE 'insufficient_inputs' END AS renal FROM x""")
def fn_missing_fields(t):
    kind = F.when(c("med") == "small", "opioid").otherwise(c("med"))
    mme, fields = status.mme_readiness(kind, dose_value=c("dose_value"), dose_unit=c("dose_unit"), route=c("route"))
    renal = status.renal_dose_readiness(c("enriched"), c("dose_value"), c("dose_unit"), c("route"), c("continued"))
    return t.med_events().select(c("event_id").alias("id"), mme.alias("mme"), fields.alias("fields"), renal.alias("renal"))


@query("fn_exclusions", "id:s acute:i different:i excluded:i down:i", f"""
WITH {EV}, x AS (SELECT event_id AS id, CASE med WHEN 'small' THEN 'fentanyl' WHEN 'promo' THEN 'methadone' ELSE med END AS ing,
  CASE med WHEN 'large' THEN 'opioid' ELSE 'ppi' END AS cl, lower(route) AS ro, kind, CASE WHEN frequency = 'PRN' THEN 'prn' ELSE 'scheduled' END AS sc,
  dose_value AS h, continued AS n FROM ev),
y AS (SELECT *, (ing = 'fentanyl' AND (coalesce(ro = 'iv', false) OR kind = 'hospital_admin' OR (n = 1 AND h <= 24)))::INT AS acute, (ing = 'methadone')::INT AS different FROM x)
SELECT id, acute, different, greatest(acute, different) AS excluded, (acute = 0 AND different = 0 AND sc = 'prn' AND cl = 'opioid')::INT AS down FROM y""")
def fn_exclusions(t):
    e = t.med_events()
    ing = F.when(c("med") == "small", "fentanyl").when(c("med") == "promo", "methadone").otherwise(c("med"))
    f = status.exclusions(ing, F.lower("route"), c("kind"), F.when(c("frequency") == "PRN", "prn").otherwise("scheduled"),
                          F.when(c("med") == "large", "opioid").otherwise("ppi"), c("dose_value"), c("continued"))
    return e.select(c("event_id").alias("id"), *[v.alias(n) for n, v in zip(("acute", "different", "excluded", "down"), f.values())])


@query("fn_missingness", "id:s profile:s", f"""
WITH {EV} SELECT event_id AS id, '{{"dose_unit_missing":' || CASE WHEN dose_unit IS NULL THEN 'true' ELSE 'false' END || ',"route_missing":' || CASE WHEN route IS NULL THEN 'true' ELSE 'false' END
  || ',"stoptime_missing":' || CASE WHEN stoptime IS NULL THEN 'true' ELSE 'false' END || '}}' AS profile FROM ev""")
def fn_missingness(t):
    return t.med_events().select(c("event_id").alias("id"), jsoncols.missingness(
        route=c("route"), dose_unit=c("dose_unit"), stoptime=c("stoptime")).alias("profile"))


def order_rules():
    p = c("o_orderpriority")
    return [
        Rule("urgent", "med", 3, p.startswith("1"), "urgent order", "urgent", ("o_orderpriority",)),
        Rule("high", "med", 3, p.startswith("2") | p.startswith("1"), "high order", "high", ("o_orderpriority",)),
        Rule("rich", "ctx", 2, c("c_acctbal") > 5000, "rich customer", "rich", ("c_acctbal",)),
        Rule("building", "ctx", 2, c("c_mktsegment") == "BUILDING", "building customer", "building"),
        Rule("large", "dyn", 2, c("o_totalprice") > 300000, "large order", "large", ("o_totalprice",)),
        Rule("pending", "dyn", 1, c("o_orderstatus") == "P", "pending order", "pending"),
    ]


@query("fn_rule_score", "o_orderkey:l bucket_med:i bucket_ctx:i bucket_dyn:i priority_score:i priority_level:s summary_alert:s explanation:s total:d labels:s why:s", """
WITH h AS (SELECT o_orderkey, o_totalprice, left(o_orderpriority, 1) = '1' AS u, left(o_orderpriority, 1) IN ('1', '2') AS hi, c_acctbal > 5000 AS r, c_mktsegment = 'BUILDING' AS b,
  o_totalprice > 300000 AS l, o_orderstatus = 'P' AS p FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT *, least(u::INT * 3 + hi::INT * 3, 4) AS bucket_med, least(r::INT * 2 + b::INT * 2, 3) AS bucket_ctx, least(l::INT * 2 + p::INT, 3) AS bucket_dyn FROM h),
z AS (SELECT *, bucket_med + bucket_ctx + bucket_dyn AS sc FROM s)
SELECT o_orderkey, bucket_med, bucket_ctx, bucket_dyn, sc AS priority_score, CASE WHEN sc < 4 THEN 'low' WHEN sc < 7 THEN 'medium' ELSE 'high' END AS priority_level,
  CASE WHEN sc = 0 THEN 'No strong immediate deprescribing alert from the current structured evidence.'
    WHEN bucket_med >= bucket_ctx AND bucket_med >= bucket_dyn THEN 'Medication: ' || concat_ws(', ', CASE WHEN u THEN 'urgent' END, CASE WHEN hi THEN 'high' END) || '.'
    WHEN bucket_ctx >= bucket_dyn THEN 'Context: ' || concat_ws(', ', CASE WHEN r THEN 'rich' END, CASE WHEN b THEN 'building' END) || '.'
    ELSE 'Dynamic: ' || concat_ws(', ', CASE WHEN l THEN 'large' END, CASE WHEN p THEN 'pending' END) || '.' END AS summary_alert,
  CASE WHEN sc = 0 THEN 'no major structured IPD rule triggered' ELSE concat_ws('; ', CASE WHEN u THEN 'urgent order' END, CASE WHEN hi THEN 'high order' END, CASE WHEN r THEN 'rich customer' END,
    CASE WHEN b THEN 'building customer' END, CASE WHEN l THEN 'large order' END, CASE WHEN p THEN 'pending order' END) END AS explanation,
  CASE WHEN l THEN o_totalprice END AS total, '{"ctx":"Customer","dyn":"dyn","med":"Urgency"}' AS labels,
  '{"ctx":[' || concat_ws(',', CASE WHEN r THEN '"rich customer"' END, CASE WHEN b THEN '"building customer"' END) || '],"dyn":[' ||
    concat_ws(',', CASE WHEN l THEN '"large order"' END, CASE WHEN p THEN '"pending order"' END) || '],"med":[' ||
    concat_ws(',', CASE WHEN u THEN '"urgent order"' END, CASE WHEN hi THEN '"high order"' END) || ']}' AS why FROM z""")
def fn_rule_score(t):
    rows = t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
    out = scoring.rule_score(rows, order_rules(), {"med": 4, "ctx": 3, "dyn": 3},
                             {"med": "Medication", "ctx": "Context", "dyn": "Dynamic"}, labels={"ctx": "Customer", "med": "Urgency"})
    of = lambda path: F.get_json_object("evidence_json", path)
    return out.select("*", of("$.o_totalprice").cast("double").alias("total"), of("$.bucket_labels").alias("labels"),
                      of("$.bucket_reasons").alias("why"))


@query("fn_level_bucket", "k:l lv:s given:s", """
SELECT o_orderkey AS k, CASE WHEN s < 4 THEN 'low' WHEN s < 7 THEN 'medium' ELSE 'high' END AS lv, CASE WHEN s < 4 THEN 'low' WHEN s < 7 THEN 'medium' ELSE 'high' END AS given
FROM (SELECT o_orderkey, o_orderkey % 101 / 10 AS s FROM orders)""")
def fn_level_bucket(t):
    o = t.orders.select(c("o_orderkey").alias("k"), (c("o_orderkey") % 101 / 10).alias("s"))
    given = F.when(c("k") % 2 == 0, F.concat(F.lit(" "), F.upper(scoring.to_level(c("s")))))
    return o.select("k", scoring.to_level(c("s")).alias("lv"), scoring.resolve_level(c("s"), given).alias("given"))


@query("fn_ordinal_compare", "o_orderkey:l status:s same:i exact:i err:d dist:i off1:i severe:i", f"""
WITH {LEVELS_SQL}, i AS (SELECT *, abs(CASE a WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END - CASE b WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END) AS dist FROM lv)
SELECT o_orderkey, CASE WHEN b IS NULL THEN 'unavailable' WHEN sb IS NULL THEN 'level_only_available' ELSE 'level_and_score_available' END AS status,
  (dist = 0)::INT AS same, (sa = sb)::INT AS exact, abs(sa - sb) AS err, dist, (dist = 1)::INT AS off1, (dist = 2)::INT AS severe FROM i""")
def fn_ordinal_compare(t):
    cols = scoring.compare_columns(c("a"), c("b"), c("sa"), c("sb"))
    short = dict(zip(cols, ("status", "same", "exact", "err", "dist", "off1", "severe")))
    return level_rows(t).select("o_orderkey", *[v.alias(short[n]) for n, v in cols.items()])


@query("fn_queue_priority", "k:l score:l band:s first:s n:i", """
WITH f AS (SELECT o_orderkey AS k, (o_orderstatus = 'P')::INT AS rev, (o_custkey % 3 = 0)::INT AS dis, CASE left(o_orderpriority, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END AS rk,
  (o_custkey % 5 = 0)::INT AS z FROM orders)
SELECT k, (1 - rev) * 1000 + dis * 200 + rk * 40 + z * 45 AS score, CASE WHEN rev = 1 AND dis = 1 THEN 'reviewed_disagreement_followup' WHEN rev = 1 THEN 'reviewed_backlog'
  WHEN dis = 1 THEN 'disagreement_candidate' WHEN rk >= 2 THEN 'high_signal_unreviewed' WHEN z = 1 THEN 'coverage_expansion_unreviewed' ELSE 'review_backlog' END AS band,
  CASE WHEN rev = 1 THEN 'already_reviewed' ELSE 'unreviewed_row' END AS first, 1 + dis + (rk > 0)::INT + z AS n FROM f""")
def fn_queue_priority(t):
    p, z = c("o_orderpriority"), F.lit(0)
    facts = {
        "reviewed": (c("o_orderstatus") == "P").cast("int"), "disagreement": (c("o_custkey") % 3 == 0).cast("int"),
        "unbenchmarked": z, "ambiguous": z, "excluded": z, "class_zero": (c("o_custkey") % 5 == 0).cast("int"),
        "subject_zero": z, "encounter_zero": z, "supported": z,
        "level": F.when(p.startswith("1"), "high").when(p.startswith("2"), " Medium ").when(p.startswith("3"), "LOW"),
    }
    q = status.queue_priority(facts)
    why = q["queue_priority_reasons"]
    return t.orders.select(c("o_orderkey").alias("k"), q["queue_priority_score"].alias("score"), q["queue_priority_band"].alias("band"),
                           F.get(why, F.lit(0)).alias("first"), F.size(why).alias("n"))


@query("fn_boundary_band", "k:l near:i band:s score:l", """
WITH f AS (SELECT l_orderkey AS k, (l_returnflag <> 'N' AND abs(l_tax * 10 - l_discount * 10) <= 0.18)::INT AS near, (l_returnflag = 'A')::INT AS dis, (l_linenumber = 1)::INT AS unc, (l_linestatus = 'F')::INT AS rev FROM lineitem)
SELECT k, near, CASE WHEN near + dis + unc = 0 THEN 'not_selected' WHEN near + dis + unc > 1 THEN 'mixed_signal_candidate' WHEN dis = 1 THEN 'model_rule_disagreement'
  WHEN unc = 1 THEN 'uncertain_existing_review' ELSE 'medium_high_boundary' END AS band, dis * 400 + unc * 320 + near * 240 + (1 - rev) * 20 AS score FROM f""")
def fn_boundary_band(t):
    level = F.when(c("l_returnflag") == "N", "low").when(c("l_returnflag") == "A", "High").otherwise("medium")
    near = status.medium_high_boundary(level, c("l_tax") * 10, c("l_discount") * 10)
    b = status.blind_priority((c("l_returnflag") == "A").cast("int"), (c("l_linenumber") == 1).cast("int"), near, F.lit(0), (c("l_linestatus") == "F").cast("int"))
    return t.lineitem.select(c("l_orderkey").alias("k"), near.alias("near"), b["band"].alias("band"), b["score"].alias("score"))


@query("fn_inclusion_reason", "k:l keep:i why:s", """
SELECT o_orderkey AS k, (o_orderpriority <> '5-LOW' AND o_custkey % 4 > 0 AND o_orderstatus = 'F')::INT AS keep, CASE WHEN o_orderpriority = '5-LOW' THEN 'missing_priority_level'
  WHEN o_custkey % 4 = 0 THEN 'feature_unavailable_as_of_review_time' WHEN o_orderstatus = 'O' THEN 'review_status_uncertain' WHEN o_orderstatus = 'P' THEN 'review_status_missing' END AS why FROM orders""")
def fn_inclusion_reason(t):
    level = F.nullif("o_orderpriority", F.lit("5-LOW"))
    st = F.when(c("o_orderstatus") == "F", " Reviewed").when(c("o_orderstatus") == "O", "uncertain")
    keep, why = status.training_inclusion(level, st, (c("o_custkey") % 4 > 0).cast("int"))
    return t.orders.select(c("o_orderkey").alias("k"), keep.alias("keep"), why.alias("why"))


@query("fn_row_id", "rid:s run:s", """
SELECT l_orderkey || '|' || l_linenumber || '|' || coalesce(nullif(l_returnflag, 'N'), '') || '|' || l_partkey AS rid,
  'run-' || sha256('{"a":' || l_partkey || ',"b":' || coalesce('"' || nullif(l_returnflag, 'N') || '"', 'null') || '}') AS run FROM lineitem""")
def fn_row_id(t):
    flag = F.nullif("l_returnflag", F.lit("N"))
    return t.lineitem.select(jsoncols.row_id(c("l_orderkey"), c("l_linenumber"), flag, c("l_partkey")).alias("rid"),
                             jsoncols.run_id("run", jsoncols.sorted_json(b=flag, a=c("l_partkey"))).alias("run"))


@query("fn_json_fields", "event_id:l k:l z:l payload:s", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL AS z, '{"event_type":"' || event_type || '","user_id":' || user_id || ',"zero":null}' AS payload FROM events""")
def fn_json_fields(t):
    return t.events.select("event_id", jsoncols.json_int(c("props"), "$.k").alias("k"), jsoncols.json_int(F.lit("{bad"), "$.k").alias("z"),
                           jsoncols.sorted_json(zero=F.lit(None).cast("int"), user_id=c("user_id"), event_type=c("event_type")).alias("payload"))


@query("fn_confidence_case", "p_partkey:l conf:s st:s", """
WITH x AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'exact_or_normalized_raw_query' ELSE 'approximate_fallback' END AS s, p_size % 2 + 1 AS n,
  CASE p_type WHEN 'SMALL' THEN 'resolved_to_ingredient' WHEN 'PROMO' THEN 'resolved_term_only_no_ingredient' WHEN 'LARGE' THEN 'unresolved_no_match' ELSE 'resolved_via_related_concept' END AS r FROM part)
SELECT p_partkey, CASE WHEN r LIKE 'unresolved%' THEN 'none' WHEN s LIKE 'exact%' AND n = 1 THEN 'high' WHEN s LIKE 'exact%' THEN 'medium' WHEN r = 'resolved_term_only_no_ingredient' THEN 'low' ELSE 'medium' END AS conf,
  CASE WHEN r IN ('resolved_to_ingredient', 'resolved_via_related_concept') THEN 'resolved' ELSE r END AS st FROM x""")
def fn_confidence_case(t):
    s = F.when(c("p_size") % 3 == 0, "exact_or_normalized_raw_query").otherwise("approximate_fallback")
    r = (F.when(c("p_type") == "SMALL", "resolved_to_ingredient").when(c("p_type") == "PROMO", "resolved_term_only_no_ingredient")
         .when(c("p_type") == "LARGE", "unresolved_no_match").otherwise("resolved_via_related_concept"))
    return t.part.select("p_partkey", status.mapping_confidence(s, c("p_size") % 2 + 1, r).alias("conf"), status.lookup_status(r).alias("st"))


@query("fn_alignment", "k:l labels:s al:s pct:i", """
WITH x AS (SELECT l_orderkey AS k, l_linenumber, l_returnflag, l_linestatus, l_tax, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS a, l_linenumber % 4 AS b FROM lineitem)
SELECT k, CASE WHEN l_returnflag = l_linestatus THEN l_returnflag ELSE concat_ws(',', l_returnflag, l_linestatus) END AS labels,
  CASE WHEN a IS NOT NULL AND b > 0 THEN CASE abs(a - b) WHEN 0 THEN 'agreed' WHEN 1 THEN 'off_by_one' ELSE 'corrected' END END AS al,
  CASE WHEN l_linenumber > 6 THEN 0 ELSE CAST(round(l_tax * 100) AS INTEGER) END AS pct FROM x""")
def fn_alignment(t):
    level = F.when(c("l_returnflag") == "A", "low").when(c("l_returnflag") == "R", "medium")
    given = F.get(F.array(F.lit(None), F.lit("low"), F.lit("medium"), F.lit("high")), (c("l_linenumber") % 4).cast("int"))
    labels = status.merged_labels(F.array("l_returnflag", F.lit("unresolved")), F.lit(None).cast("array<string>"), F.array("l_linestatus", "l_returnflag"))
    conf = F.when(c("l_linenumber") <= 6, c("l_tax"))
    return t.lineitem.select(c("l_orderkey").alias("k"), F.array_join(labels, ",").alias("labels"), status.review_alignment(level, given).alias("al"),
                             status.confidence_percent(conf).alias("pct"))

"""Composite jobs on the clinical stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F


from medgrain.plans import dataset as ds
from medgrain.plans import encounters, events, features, labels, mapping, review, reviews, scores, semantics
from medgrain.queries import clinic
from medgrain.queries.aggregates import ACTION_SQL, HARM_SQL, STATUS_SQL, action_events, action_rows, clinical
from medgrain.queries.clinic import LAB_ROWS, LINES, SCOPE, VITAL_SQL
from medgrain.queries.filters import ACTIVE_SQL
from medgrain.queries.registry import ENC, EV, LABS, query
from medgrain.queries.windows import QUEUE, review_queue
from medgrain.session import release, stored

c = F.col

EVENTS_SQL = f"""
WITH {LINES},
home AS (SELECT DISTINCT l_orderkey AS k, word FROM ln WHERE l_returnflag = 'R' AND o_orderstatus <> 'O'),
o0 AS (SELECT subject_id, l_orderkey AS k, word, st AS s, sp, coalesce(sp, st) AS e, l_partkey AS pk, line,
   CASE WHEN l_suppkey % 2 = 0 THEN 'PO' END AS r0,
   EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = ln.l_orderkey AND x.l_partkey = ln.l_partkey AND x.l_linenumber < 5) AS en
   FROM ln WHERE o_orderstatus <> 'P' AND ((l_returnflag = 'A' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linestatus = 'O'))),
o1 AS (SELECT *, coalesce(r0, CASE WHEN en THEN 'IV' END) AS route, 'hospital-order-' || subject_id || '-' || k || '-' ||
   (row_number() OVER (PARTITION BY subject_id, k ORDER BY s, sp NULLS LAST, word, pk, line) - 1) AS id FROM o0),
o2 AS (SELECT *, (sp IS NOT NULL)::INT + (route IS NOT NULL)::INT + en::INT AS filled,
   max(e) OVER (PARTITION BY subject_id, k, word ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o1),
o3 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + INTERVAL 12 HOUR THEN 1 ELSE 0 END)
   OVER (PARTITION BY subject_id, k, word ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS isl FROM o2),
rx AS (SELECT k, word, min(s) AS a, max(e) AS b, count(*) AS n, arg_min(id, (-filled, s, e, id)) AS id, arg_min(coalesce(route, '?'), (-filled, s, e, id)) AS route,
   arg_min(en::INT, (-filled, s, e, id)) AS enr FROM o3 GROUP BY k, word, isl),
u AS (
  SELECT id, 'hospital_order' AS kind, 'hadm:' || k AS enc, k, word, a AS at, a, b, n, route, enr FROM rx
  UNION ALL SELECT 'home-medrecon-' || subject_id || '-' || l_orderkey || '-' || (row_number() OVER (PARTITION BY subject_id, l_orderkey ORDER BY word) - 1), 'home_medrecon',
    CASE WHEN o_orderstatus = 'F' THEN 'hadm:' ELSE 'stay:' END || l_orderkey, l_orderkey, word, o_orderdate - INTERVAL 1 DAY, NULL, NULL, 1, '?', 0
    FROM ln WHERE l_returnflag = 'R' AND o_orderstatus <> 'O'
  UNION ALL SELECT 'ed-pyxis-' || subject_id || '-' || l_orderkey || '-' || (row_number() OVER (PARTITION BY subject_id, l_orderkey ORDER BY l_linenumber, word) - 1), 'ed_pyxis',
    CASE WHEN o_orderstatus = 'F' THEN 'hadm:' ELSE 'stay:' END || l_orderkey, l_orderkey, word, o_orderdate + to_hours(l_linenumber), o_orderdate + to_hours(l_linenumber), NULL, 1, '?', 0
    FROM ln WHERE l_returnflag = 'N' AND l_linestatus = 'F' AND o_orderstatus <> 'O'
  UNION ALL SELECT 'hospital-admin-' || subject_id || '-' || l_orderkey || '-' || line || '-' || l_linenumber, 'hospital_admin', 'hadm:' || l_orderkey, l_orderkey, word,
    o_orderdate + to_days(l_linenumber), o_orderdate + to_days(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber - 1 ELSE l_linenumber END), NULL, 1,
    CASE WHEN l_linenumber > 3 THEN 'IV' ELSE '?' END, 0 FROM ln WHERE l_returnflag = 'A' AND l_linestatus = 'O' AND o_orderstatus <> 'P')
SELECT id, kind, enc, u.word AS med, u."at", a, b, n, route, enr, (kind <> 'home_medrecon' AND h.k IS NOT NULL)::INT AS cont,
  (kind <> 'home_medrecon' AND h.k IS NULL)::INT AS started FROM u LEFT JOIN home h ON u.k = h.k AND u.word = h.word"""


@query("job_events", "id:s kind:s enc:s med:s at:s a:s b:s n:l route:s enr:i cont:i started:i", EVENTS_SQL)
def job_events(t):
    stays = clinic.edstays(t)
    index = encounters.build_encounter_index(clinic.patients(t), clinic.admissions(t), stays)
    out = events.build_events(
        index, stays, clinic.prescriptions(t), clinic.medrecon(t), clinic.pyxis(t), clinic.pharmacy(t), clinic.emar(t), clinic.emar_detail(t))
    return out.select(
        c("medication_event_id").alias("id"), c("medication_event_type").alias("kind"), c("encounter_id").alias("enc"),
        c("medication_normalized").alias("med"), c("event_time").alias("at"), c("starttime").alias("a"), c("stoptime").alias("b"),
        c("prescription_segment_count").alias("n"), F.coalesce("route", F.lit("?")).alias("route"), c("pharmacy_enriched_flag").alias("enr"),
        c("continued_from_home_inferred").alias("cont"), c("newly_started_during_encounter_inferred").alias("started"))


@query("job_cohort", "subject_id:l hadm_id:l drug:s a:s b:s n:l age:l band:s sex:s los:d", f"""
WITH {LINES}, p AS (SELECT c_custkey AS subject_id, CAST(floor((c_acctbal + 1000) / 110) AS BIGINT) AS age, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'F' ELSE 'M' END AS sex FROM customer),
x AS (SELECT ln.subject_id, l_orderkey AS hadm_id, word, st AS s, coalesce(sp, st) AS e, line, age, sex FROM ln JOIN p ON ln.subject_id = p.subject_id
  WHERE age >= 65 AND o_orderstatus <> 'P' AND ((l_returnflag = 'A' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linestatus = 'O'))),
f AS (SELECT *, max(e) OVER (PARTITION BY hadm_id, word ORDER BY s, e, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY hadm_id, word ORDER BY s, e, line ROWS UNBOUNDED PRECEDING) AS isl FROM f)
SELECT subject_id, hadm_id, '*' || word || ' MG' AS drug, min(s) AS a, max(e) AS b, count(*) AS n, age, CASE WHEN age >= 85 THEN '85+' WHEN age >= 75 THEN '75-84' ELSE '65-74' END AS band,
  sex, 30.0 AS los FROM g GROUP BY subject_id, hadm_id, word, isl, age, sex""")
def job_cohort(t):
    out = encounters.build_cohort(clinic.patients(t), clinic.admissions(t), clinic.prescriptions(t))
    return out.select("subject_id", "hadm_id", "drug", c("starttime").alias("a"), c("stoptime").alias("b"),
                      c("prescription_segment_count").alias("n"), c("age_proxy").alias("age"), c("age_group").alias("band"), "sex",
                      c("length_of_stay_days").alias("los"))


def _named(t):
    e = clinical(t.med_events())
    return e.select(
        "*", c("starttime").alias("event_time"), F.lit(None).cast("timestamp_ntz").alias("encounter_start"), c("hadm_id").alias("stay_id"),
        c("medication_standardized").alias("medication_normalized"), c("raw_name").alias("raw_medication_name"),
        c("raw_name").alias("medication_name"), F.lit("lineitem").alias("event_source_table")).drop("medication_standardized")


def _encounters(t):
    from medgrain.functions.clinical import age_band

    return t.encounters().select("*", c("hadm_id").alias("stay_id"), age_band(c("age_proxy")).alias("age_group"))


RANK = "CASE kind WHEN 'hospital_order' THEN 4 WHEN 'home_medrecon' THEN 3 WHEN 'hospital_admin' THEN 2 ELSE 1 END"
PICK = f"(NOT act, -({RANK}), -epoch_us(starttime), -enriched, event_id)"
TIMES = """m AS (SELECT encounter_id, max(starttime) FILTER (kind IN ('hospital_admin', 'ed_pyxis')) AS ad, max(greatest(stoptime, starttime)) FILTER (kind = 'hospital_order') AS od FROM ev GROUP BY 1),
l AS (SELECT hadm_id, max(charttime) AS lt FROM labs GROUP BY 1),
rt AS (SELECT e.*, coalesce(ad, od, lt, e.dischtime) AS cand, CASE WHEN ad IS NOT NULL THEN 'medication_administration' WHEN od IS NOT NULL THEN 'medication_order' WHEN lt IS NOT NULL THEN 'lab' ELSE 'encounter_end' END AS src
  FROM enc e LEFT JOIN m ON e.encounter_id = m.encounter_id LEFT JOIN l ON e.hadm_id = l.hadm_id)"""


@query("job_snapshot", "encounter_id:s med:s at:s src:s event_id:s kind:s n_active:l n:l", f"""
WITH {ENC}, {EV}, {LABS}, {TIMES}, sa AS (SELECT *, coalesce({ACTIVE_SQL}, false) AS act FROM (SELECT ev.*, cand AS rev, src FROM ev JOIN rt ON ev.encounter_id = rt.encounter_id)),
g AS (SELECT encounter_id, med, max(rev) AS at, max(src) AS src, arg_min(event_id, {PICK}) AS event_id, arg_min(kind, {PICK}) AS kind, sum(act::INT) AS n_active, count(*) AS n, {STATUS_SQL} AS status
  FROM sa GROUP BY 1, 2)
SELECT encounter_id, med, g."at", src, event_id, kind, n_active, n FROM g WHERE status = 'active_at_review_time'""")
def job_snapshot(t):
    out = review.build_snapshot(review.build_review(_encounters(t), _named(t), t.labs()))
    return out.select(
        "encounter_id", c("medication_normalized").alias("med"), c("snapshot_time").alias("at"), c("review_timestamp_source").alias("src"),
        c("medication_event_id").alias("event_id"), c("medication_event_type").alias("kind"), c("active_event_count_at_review").alias("n_active"),
        c("candidate_event_count").alias("n"))


# A mapping from the part types: one single-hit opioid, two names with one ppi ingredient.
def _mapping(t):
    key = F.lower("p_type")
    p = t.part.select(key.alias("medication_query_key")).distinct()
    std = F.when(c("medication_query_key") == "small", "fentanyl").when(c("medication_query_key").isin("promo", "large"), "omeprazole")
    hit = std.isNotNull()
    return p.where(c("medication_query_key") != "economy").select(
        "medication_query_key", std.alias("medication_standardized"), F.when(hit, "rxnorm_ingredient").alias("medication_standardized_source"),
        F.when(hit, F.concat(F.lit("rx-"), "medication_query_key")).alias("rxnorm_rxcui"), std.alias("matched_term"), F.lit("IN").alias("matched_term_type"),
        std.alias("ingredient_standardized"), F.when(c("medication_query_key") == "large", "resolved_via_related_concept").when(hit, "resolved_to_ingredient").alias("ingredient_resolution_status"),
        F.when(c("medication_query_key") == "promo", "high").when(hit, "medium").alias("mapping_confidence"), hit.cast("int").alias("ambiguous_match_flag"),
        F.lit(1).alias("candidate_match_count"), F.concat(F.lit("by-"), "medication_query_key").alias("lookup_strategy_used"),
        F.when(hit, "supported_scope_class_assigned").alias("class_assignment_status"),
        F.when(std == "fentanyl", "opioid").when(std == "omeprazole", "ppi").alias("class_labels"))


STATE = f"""{ENC}, {EV}, {LABS}, {TIMES},
rv AS (SELECT *, least(cand, dischtime) AS rev, CASE WHEN cand > dischtime THEN 'encounter_boundary' ELSE src END AS rsrc, (cand > dischtime)::INT AS capped FROM rt),
se AS (SELECT ev.*, rev, rsrc, cand, capped, age_proxy, CASE med WHEN 'small' THEN 'fentanyl' WHEN 'promo' THEN 'omeprazole' WHEN 'large' THEN 'omeprazole' ELSE med END AS std FROM ev JOIN rv ON ev.encounter_id = rv.encounter_id),
sa AS (SELECT *, coalesce({ACTIVE_SQL}, false) AS act FROM se),
state AS (SELECT any_value(subject_id) AS subject_id, encounter_id, std, any_value(hadm_id) AS hadm_id, max(rev) AS rev, max(rsrc) AS rsrc, max(capped) AS capped, max(age_proxy) AS age, max(dischtime) AS fin, {STATUS_SQL} AS status,
  sum(act::INT) AS n_active, count(*) AS n, arg_min(event_id, {PICK}) AS event_id, arg_min(kind, {PICK}) AS kind, arg_min(raw_name, {PICK}) AS raw, arg_min(med, {PICK}) AS med,
  CASE std WHEN 'fentanyl' THEN 'opioid' WHEN 'omeprazole' THEN 'ppi' ELSE 'unresolved' END AS cls,
  CASE WHEN std IN ('fentanyl', 'omeprazole') THEN CASE WHEN max((med <> 'large')::INT) = 1 THEN 'resolved_to_ingredient' ELSE 'resolved_via_related_concept' END ELSE 'unresolved_no_match' END AS ing,
  CASE WHEN max((med = 'promo')::INT) = 1 THEN 'high' WHEN std IN ('fentanyl', 'omeprazole') THEN 'medium' ELSE 'none' END AS conf,
  greatest(CASE WHEN std = 'economy' THEN 0 ELSE 1 END, count(DISTINCT med)) AS cand_n, max(continued) AS cont, 1 - min(continued) AS started,
  max((kind = 'home_medrecon')::INT) AS home, nullif(arg_min(coalesce(route, '?'), {PICK}), '?') AS route0 FROM sa GROUP BY encounter_id, std)"""


def state_of(t, columns=None):
    return review.build_state(_encounters(t), _named(t), _mapping(t), t.labs(), columns=columns)


@query("job_state", "subject_id:l encounter_id:s med:s at:s src:s capped:i status:s active:i n_active:l n:l event_id:s kind:s cls:s ing:s conf:s cand_n:l cont:i started:i home:i", f"""
WITH {STATE} SELECT subject_id, encounter_id, std AS med, rev AS at, rsrc AS src, capped, status, (status = 'active_at_review_time')::INT AS active, n_active, n, event_id, kind, cls, ing, conf,
  cand_n, cont, started, home FROM state""")
def job_state(t):
    state = state_of(t, ["subject_id", "review_timestamp", "review_timestamp_source", "review_time_capped_to_discharge_flag",
                         "medication_event_id", "medication_event_type"])
    return state.select(
        "subject_id", "encounter_id", c("medication_standardized").alias("med"), c("review_timestamp").alias("at"),
        c("review_timestamp_source").alias("src"), c("review_time_capped_to_discharge_flag").alias("capped"),
        c("medication_status_at_review").alias("status"), c("active_at_review_flag").alias("active"),
        c("active_event_count_at_review").alias("n_active"), c("candidate_event_count").alias("n"), c("selected_medication_event_id").alias("event_id"),
        c("selected_medication_event_type").alias("kind"), c("medication_class_standardized").alias("cls"),
        c("ingredient_resolution_status").alias("ing"), c("mapping_confidence").alias("conf"), c("mapping_candidate_count").alias("cand_n"),
        c("continued_from_home_inferred").alias("cont"), c("newly_started_during_encounter_inferred").alias("started"),
        c("source_home_medrecon_flag").alias("home"))


KEYWORDS = {"benzodiazepine": ("eco",), "opioid": ("small", "stand"), "anticholinergic": ("xyz",), "ppi": ("promo",), "antipsychotic": ("med",)}


def semantics_of(t, *columns):
    """Semantics with these columns of the selected event and its review, beside the names that the keywords are looked for in."""
    return semantics.build_semantics(state_of(t, ["medication_normalized", "medication_raw", *columns]), KEYWORDS)


@query("job_semantics", "encounter_id:s med:s cls:s st:s supported:i o:i p:i b:i a:i any_flag:i agree:i", f"""
WITH {STATE}, h AS (SELECT *, (med IN ('small', 'standard'))::INT AS o, (med = 'promo')::INT AS p, (med = 'economy')::INT AS b, (med = 'medium')::INT AS a FROM state)
SELECT encounter_id, std AS med, cls, CASE WHEN cls <> 'unresolved' THEN 'supported_scope_class_assigned' ELSE 'class_enrichment_not_attempted' END AS st, (cls <> 'unresolved')::INT AS supported,
  o, p, b, a, greatest(o, p, b, a) AS any_flag, CASE cls WHEN 'opioid' THEN o WHEN 'ppi' THEN p ELSE 1 - greatest(o, p, b, a) END AS agree FROM h""")
def job_semantics(t):
    s = semantics_of(t)
    f = lambda n: c(f"{n}_heuristic_flag")
    return s.select(
        "encounter_id", c("medication_standardized").alias("med"), c("medication_class_standardized").alias("cls"),
        c("class_assignment_status").alias("st"), c("first_scope_supported_class_flag").alias("supported"), f("opioid").alias("o"),
        f("ppi").alias("p"), f("benzodiazepine").alias("b"), f("antipsychotic").alias("a"),
        c("heuristic_any_supported_class_flag").alias("any_flag"), c("standardized_vs_heuristic_class_agreement_flag").alias("agree"))


@query("job_burden", "encounter_id:s med:s exact_n:l n_op:l n_ppi:l own:l dup:i sched:s hours:d low:i cr:d cr_time:s ctx:s mme:s renal:s", f"""
WITH {STATE}, b AS (SELECT *, (status = 'active_at_review_time')::INT AS active FROM state),
k AS (SELECT encounter_id, count(DISTINCT std) FILTER (active = 1) AS exact_n, count(*) FILTER (active = 1 AND cls = 'opioid') AS n_op, count(*) FILTER (active = 1 AND cls = 'ppi') AS n_ppi FROM b GROUP BY 1),
e AS (SELECT encounter_id, std, CASE WHEN max((frequency = 'PRN')::INT) = 1 THEN 'prn' WHEN max((frequency IN ('BID', '12'))::INT) = 1 THEN 'scheduled' ELSE 'unknown' END AS sched,
  min(starttime) FILTER (starttime <= rev) AS f, max(rev) AS r, max(continued) * max((kind = 'home_medrecon')::INT) AS low FROM sa GROUP BY 1, 2),
x AS (SELECT hadm_id, charttime, max(valuenum) AS v FROM labs WHERE itemid = 0 GROUP BY ALL), y AS (SELECT DISTINCT hadm_id, rev FROM b),
z AS (SELECT y.hadm_id, v, charttime FROM y ASOF LEFT JOIN x ON y.hadm_id = x.hadm_id AND y.rev >= x.charttime), d AS (SELECT event_id, dose_value, dose_unit FROM ev)
SELECT b.encounter_id, b.std AS med, exact_n, n_op, n_ppi, CASE cls WHEN 'opioid' THEN n_op WHEN 'ppi' THEN n_ppi ELSE 0 END AS own,
  (active = 1 AND CASE cls WHEN 'opioid' THEN n_op WHEN 'ppi' THEN n_ppi ELSE 0 END > 1)::INT AS dup, sched, round((epoch_us(r) - epoch_us(f)) / 3.6e9, 3) AS hours,
  CASE WHEN f IS NULL THEN 0 ELSE low END AS low, round(v, 3) AS cr, charttime AS cr_time,
  CASE WHEN cont = 1 AND started = 1 THEN 'mixed_evidence' WHEN cont = 1 THEN 'continued_from_home' WHEN started = 1 THEN 'new_start_during_encounter' ELSE 'neither_or_unknown' END AS ctx,
  CASE WHEN cls <> 'opioid' THEN 'not_opioid' WHEN dose_unit IS NULL OR route0 IS NULL THEN 'missing_required_fields' ELSE 'ready_for_future_conversion' END AS mme,
  CASE WHEN active <> 1 THEN 'not_current_medication' WHEN dose_unit IS NOT NULL AND route0 IS NOT NULL AND charttime IS NOT NULL THEN 'ready_for_future_logic' ELSE 'insufficient_inputs' END AS renal
FROM b JOIN k ON b.encounter_id = k.encounter_id JOIN e ON b.encounter_id = e.encounter_id AND b.std = e.std JOIN z ON b.hadm_id = z.hadm_id JOIN d ON b.event_id = d.event_id""")
def job_burden(t):
    med = c("medication_normalized")
    std = F.when(med == "small", "fentanyl").when(med.isin("promo", "large"), "omeprazole").otherwise(med)
    e = _named(t).withColumn("medication_standardized", std)
    sem = semantics_of(t, "subject_id", "hadm_id", "review_timestamp", "ingredient_standardized", "route", "frequency")
    sem = stored(sem.select(*semantics.BURDEN_INPUTS))
    release(t.spark)
    b = semantics.build_burden(sem, e, _encounters(t), t.labs(), items=(0,))
    return b.select(
        "encounter_id", c("medication_standardized").alias("med"), c("exact_current_medication_count").alias("exact_n"),
        c("current_opioid_count").alias("n_op"), c("current_ppi_count").alias("n_ppi"), c("row_same_class_current_count").alias("own"),
        c("same_class_duplicate_therapy_flag").alias("dup"), c("scheduled_vs_prn").alias("sched"),
        c("duration_before_review_hours").alias("hours"), c("duration_before_review_lower_bound_flag").alias("low"),
        c("renal_context_latest_creatinine_value").alias("cr"), c("renal_context_latest_creatinine_time").alias("cr_time"),
        c("medication_start_context").alias("ctx"), c("opioid_mme_status").alias("mme"), c("renal_dose_mismatch_status").alias("renal"))


MAPPING_COLUMNS = "q:s strategy:s status:s std:s ing:s conf:s amb:i n:i cls:s cls_st:s"
MAPPING_SQL = """
WITH q AS (SELECT DISTINCT p_name AS q FROM part), w AS (SELECT q, split_part(q, ' ', 1) AS w1, split_part(q, ' ', 2) AS w2, length(q) % 3 AS z FROM q),
k AS (SELECT 'c-' || q AS id, CASE z WHEN 0 THEN upper(q) WHEN 1 THEN left(q, length(q) - 1) ELSE 'zz ' || q END AS term, w1 IN ('red', 'blue') AS isin,
  CASE WHEN w1 NOT IN ('red', 'blue') AND w2 = 'ring' THEN 'morphine' END AS ingr FROM w),
s AS (SELECT *, lower(trim(term)) AS key, CASE WHEN NOT isin AND ingr IS NOT NULL THEN ingr ELSE term END AS std, CASE WHEN isin THEN term ELSE ingr END AS ing,
  CASE WHEN isin THEN 'resolved_to_ingredient' WHEN ingr IS NOT NULL THEN 'resolved_via_related_concept' ELSE 'resolved_term_only_no_ingredient' END AS st FROM k),
h AS (SELECT q, s.*, levenshtein(q, key) AS d FROM q JOIN s ON levenshtein(q, key) <= {distance}),
b AS (SELECT * FROM h WHERE d = (SELECT min(d) FROM h x WHERE x.q = h.q)),
g AS (SELECT q, count(*) AS n, count(DISTINCT (std, coalesce(ing, ''), st)) = 1 AS ok, min(d) AS d, arg_min(std, key) AS std, arg_min(coalesce(ing, '?'), key) AS ing, arg_min(st, key) AS st FROM b GROUP BY 1),
r AS (SELECT q.q, CASE WHEN d IS NULL THEN 'approximate_lookup_no_match' WHEN d = 0 THEN 'exact_or_normalized_raw_query' ELSE 'approximate_fallback' END AS strategy,
  CASE WHEN d IS NULL THEN 'unresolved_no_match' WHEN NOT ok THEN 'unresolved_ambiguous_multi_hit' ELSE st END AS st, CASE WHEN ok THEN g.std ELSE q.q END AS std,
  CASE WHEN ok THEN nullif(g.ing, '?') END AS ing, coalesce(n, 0) AS n, ok FROM q LEFT JOIN g ON q.q = g.q)
SELECT q, strategy, CASE WHEN st IN ('resolved_to_ingredient', 'resolved_via_related_concept') THEN 'resolved' ELSE st END AS status, std, ing,
  CASE WHEN st LIKE 'unresolved%' THEN 'none' WHEN strategy LIKE 'exact%' AND n = 1 THEN 'high' WHEN strategy LIKE 'exact%' THEN 'medium' WHEN st = 'resolved_term_only_no_ingredient' THEN 'low' ELSE 'medium' END AS conf,
  CASE WHEN ok THEN (n > 1)::INT WHEN n > 0 THEN 1 ELSE 0 END AS amb, n, CASE WHEN lower(ing) = 'morphine' THEN 'opioid' ELSE 'unresolved' END AS cls,
  CASE WHEN ing IS NULL THEN 'no_standardized_ingredient_available' WHEN lower(ing) = 'morphine' THEN 'supported_scope_class_assigned' ELSE 'supported_scope_unresolved' END AS cls_st FROM r"""


def _mapped(t, distance):
    named = t.part.select(c("p_name").alias("medication_normalized"), c("p_name").alias("raw_medication_name"), c("p_name").alias("medication_name"))
    q = c("p_name")
    w1, w2, z = F.split_part(q, F.lit(" "), F.lit(1)), F.split_part(q, F.lit(" "), F.lit(2)), F.length(q) % 3
    isin = w1.isin("red", "blue")
    term = F.when(z == 0, F.upper(q)).when(z == 1, F.left(q, F.length(q) - 1)).otherwise(F.concat(F.lit("zz "), q))
    ingr = F.when(~isin & (w2 == "ring"), "morphine")
    concepts = t.part.select("p_name").distinct().select(
        F.concat(F.lit("c-"), q).alias("concept_id"), term.alias("term"), F.when(isin, "IN").otherwise("SCD").alias("term_type"),
        F.when(ingr.isNotNull(), "i-morphine").alias("ingredient_id"), ingr.alias("ingredient_name"))
    m = mapping.build_mapping(mapping.mapping_queries(named), concepts, distance=distance)
    return m.select(
        c("medication_query_key").alias("q"), c("lookup_strategy_used").alias("strategy"), c("lookup_status").alias("status"),
        c("medication_standardized").alias("std"), c("ingredient_standardized").alias("ing"), c("mapping_confidence").alias("conf"),
        c("ambiguous_match_flag").alias("amb"), c("candidate_match_count").alias("n"), c("class_labels").alias("cls"), c("class_assignment_status").alias("cls_st"))


@query("job_mapping", MAPPING_COLUMNS, MAPPING_SQL.format(distance=1))
def job_mapping(t):
    return _mapped(t, 1)


@query("job_mapping_far", MAPPING_COLUMNS, MAPPING_SQL.format(distance=3))
def job_mapping_far(t):
    """The approximate look-up up to edit distance three: the terms that begin with two letters more are found too."""
    return _mapped(t, 3)


DX_SQL = """dx AS (SELECT o_custkey AS subject_id, l_orderkey AS k, o_orderstatus AS ward, l_suppkey % 8 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
DX_FLAGS = "max((d IN (0, 4))::INT) AS ckd, max((d = 5)::INT) AS dem, max((d = 1)::INT) AS del, max((d IN (2, 6))::INT) AS hf, max((d IN (3, 7))::INT) AS dm"


@query("job_scores", "hadm_id:l drug:s n_cur:l peak:l egfr:d trend:s score:i level:s alert:s reasons:s", f"""
WITH {ENC}, {EV}, {LABS}, {DX_SQL},
co AS (SELECT ev.subject_id, ev.hadm_id, med, CASE med WHEN 'small' THEN 'Morphine' WHEN 'promo' THEN 'Omeprazole 20' WHEN 'large' THEN 'haloperidol' ELSE med END AS drug, min(starttime) AS a, max(stoptime) AS b,
  max(ev.dischtime) AS fin, max(age_proxy) AS age, max(sex) AS sex, max((kind = 'hospital_order')::INT) AS cur FROM ev JOIN enc ON ev.encounter_id = enc.encounter_id GROUP BY 1, 2, 3, 4),
r AS (SELECT * FROM co WHERE cur = 1), h AS (SELECT hadm_id, count(*) AS n_hist FROM co GROUP BY 1), n AS (SELECT hadm_id, count(*) AS n_cur FROM r GROUP BY 1),
ev2 AS (SELECT hadm_id, a AS tm, 1 AS d, 0 AS o FROM r UNION ALL SELECT hadm_id, coalesce(b, fin), -1, 1 FROM r),
pk2 AS (SELECT hadm_id, greatest(max(q), 0) AS peak FROM (SELECT hadm_id, sum(d) OVER (PARTITION BY hadm_id ORDER BY tm, o ROWS UNBOUNDED PRECEDING) AS q FROM ev2) GROUP BY 1),
f AS (SELECT k AS hadm_id, {DX_FLAGS} FROM dx WHERE ward <> 'P' GROUP BY 1),
c1 AS (SELECT hadm_id, arg_min(valuenum, (charttime, valuenum)) AS c_first, arg_max(valuenum, (charttime, valuenum)) AS c_last, max(valuenum) AS c_max FROM labs WHERE itemid = 0 GROUP BY 1),
c2 AS (SELECT hadm_id, max(valuenum) AS k_max FROM labs WHERE itemid = 1 GROUP BY 1), c3 AS (SELECT hadm_id, max(valuenum) AS na_max FROM labs WHERE itemid = 2 GROUP BY 1),
j AS (SELECT r.*, n_cur, n_hist, peak, coalesce(ckd, 0) AS ckd, coalesce(greatest(dem, del), 0) AS cog, coalesce(greatest(hf, dm), 0) AS cm, c_first, c_max, round(c_last - c_first, 3) AS dl, k_max, na_max,
  CASE WHEN c_first > 0 THEN round(142.0::DOUBLE * pow(least(c_first / CASE WHEN sex = 'F' THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END, 1.0), CASE WHEN sex = 'F' THEN -0.241::DOUBLE ELSE -0.302::DOUBLE END)
   * pow(greatest(c_first / CASE WHEN sex = 'F' THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END, 1.0), -1.2::DOUBLE) * pow(0.9938::DOUBLE, age) * CASE WHEN sex = 'F' THEN 1.012::DOUBLE ELSE 1.0::DOUBLE END, 3) END AS egfr
  FROM r JOIN n USING (hadm_id) JOIN h USING (hadm_id) JOIN pk2 USING (hadm_id) LEFT JOIN f USING (hadm_id) LEFT JOIN c1 USING (hadm_id) LEFT JOIN c2 USING (hadm_id) LEFT JOIN c3 USING (hadm_id)),
t AS (SELECT *, drug = 'Morphine' AS t1, drug = 'haloperidol' AS t2, drug LIKE 'Omep%' AS t3, n_cur >= 10 AS t4, n_cur >= 5 AS t5, ckd = 1 OR coalesce(c_max >= 1.5, false) OR coalesce(egfr < 45, false) AS t6, cog = 1 AS t7, cm = 1 AS t8,
  coalesce(age >= 85, false) AS t9, coalesce(dl >= 0.3, false) AS t10, coalesce(k_max < 3.5 OR k_max > 5.2, false) OR coalesce(na_max < 135 OR na_max > 145, false) AS t11 FROM j),
s AS (SELECT *, least(t1::INT * 3 + t2::INT * 3 + t3::INT + t4::INT * 2 + t5::INT, 4) AS b1, least(t6::INT * 2 + t7::INT * 2 + t8::INT + t9::INT, 3) AS b2, least(t10::INT * 2 + t11::INT, 3) AS b3 FROM t)
SELECT hadm_id, drug, n_cur, peak, egfr, CASE WHEN dl IS NULL THEN NULL WHEN dl >= 0.3 THEN 'rising' WHEN dl <= -0.3 THEN 'falling' ELSE 'stable' END AS trend, b1 + b2 + b3 AS score,
  CASE WHEN b1 + b2 + b3 < 4 THEN 'low' WHEN b1 + b2 + b3 < 7 THEN 'medium' ELSE 'high' END AS level,
  CASE WHEN b1 + b2 + b3 = 0 THEN 'No strong immediate deprescribing alert from the current structured evidence.'
   WHEN b1 >= b2 AND b1 >= b3 THEN 'Medication risk signal: ' || concat_ws(', ', CASE WHEN t1 THEN 'opioid risk' END, CASE WHEN t2 THEN 'antipsychotic risk' END, CASE WHEN t3 THEN 'ppi exposure' END, CASE WHEN t5 AND NOT (t1 OR t2 OR t3) OR t5 THEN 'polypharmacy' END) || '.'
   WHEN b2 >= b3 THEN 'Patient context aggravates medication risk: ' || array_to_string([z_ FOR z_ IN [CASE WHEN t6 THEN 'renal vulnerability' END, CASE WHEN t7 THEN 'cognitive vulnerability' END,
      CASE WHEN t8 THEN 'cardiometabolic terrain' END, CASE WHEN t9 THEN 'reduced baseline reserve' END] IF z_ IS NOT NULL], ', ') || '.'
   ELSE 'Dynamic clinical evidence raises concern: ' || concat_ws(', ', CASE WHEN t10 THEN 'rising creatinine' END, CASE WHEN t11 THEN 'electrolyte concern' END) || '.' END AS alert,
  concat_ws('; ', CASE WHEN t1 THEN 'opioid exposure' END, CASE WHEN t2 THEN 'antipsychotic exposure' END, CASE WHEN t3 THEN 'proton pump inhibitor exposure' END, CASE WHEN t5 THEN 'current polypharmacy at encounter review time' END,
    CASE WHEN t6 THEN 'reduced renal reserve or renal vulnerability' END, CASE WHEN t7 THEN 'cognitive vulnerability from dementia or delirium context' END, CASE WHEN t8 THEN 'cardiac or metabolic comorbidity may narrow medication tolerance' END,
    CASE WHEN t9 THEN 'advanced age or low reserve may reduce physiologic tolerance' END, CASE WHEN t10 THEN 'creatinine is rising during the encounter' END,
    CASE WHEN t11 THEN 'electrolyte abnormality may increase medication-related instability' END) AS reasons FROM s""")
def job_scores(t):
    e = t.med_events().select("subject_id", "hadm_id", "encounter_id", "med", "kind", "starttime", "stoptime")
    e = stored(e.join(t.encounters().select("encounter_id", "age_proxy", "sex", "dischtime"), "encounter_id"))  # read by both sides
    release(t.spark)
    drug = F.when(c("med") == "small", "Morphine").when(c("med") == "promo", "Omeprazole 20").when(c("med") == "large", "haloperidol").otherwise(c("med"))
    cohort = e.groupBy("subject_id", "hadm_id", c("med").alias("drug_normalized"), drug.alias("drug")).agg(
        F.min("starttime").alias("starttime"), F.max("stoptime").alias("stoptime"), F.max("dischtime").alias("dischtime"),
        F.max("age_proxy").alias("age_proxy"), F.max("sex").alias("sex"))
    rv = e.select("subject_id", "hadm_id", "encounter_id", c("med").alias("medication_normalized"), c("starttime").alias("review_timestamp"),
                  F.when(c("kind") == "hospital_order", "active_at_review_time").alias("medication_status_at_review"))
    s = scores.build_scores(scores.build_features(cohort, rv, clinic.diagnoses(t), clinic.labs(t)))
    return s.select("hadm_id", "drug", c("current_medication_count").alias("n_cur"), c("current_peak_concurrent_medication_count").alias("peak"),
                    c("egfr_ml_min_1_73m2").alias("egfr"), c("creatinine_trend_direction").alias("trend"), c("priority_score").alias("score"),
                    c("priority_level").alias("level"), c("summary_alert").alias("alert"), F.array_join("reasons", "; ").alias("reasons"))


CONTEXT_SQL = f"""{SCOPE}, {DX_SQL}, {LABS},
meds AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), sn AS (SELECT * FROM snap WHERE hadm_id IN (SELECT k FROM meds)),
om AS (SELECT o_custkey AS subject_id, o_orderdate AS d, left(o_orderpriority, 1) AS p, CASE left(o_orderpriority, 1) WHEN '1' THEN o_custkey % 100 + 100 WHEN '2' THEN o_custkey % 20 + 55
  WHEN '3' THEN CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 15 + 20 END END AS v FROM orders),
ms AS (SELECT sn.encounter_id, max(v) FILTER (p = '1') AS lbs, max(v) FILTER (p = '2') AS hin, max(v) FILTER (p = '3') AS bmi0 FROM sn LEFT JOIN om ON sn.subject_id = om.subject_id AND d <= rev GROUP BY 1),
cr AS (SELECT sn.encounter_id, arg_max(valuenum, (charttime, valuenum)) AS cr FROM sn JOIN labs ON sn.hadm_id = labs.hadm_id AND itemid = 0 AND charttime <= rev GROUP BY 1),
pa AS (SELECT sn.encounter_id, count(o_orderkey) FILTER (o_orderstatus <> 'P' AND o_orderdate < rev) AS na, count(o_orderkey) FILTER (o_orderstatus <> 'P' AND o_orderdate < rev AND o_orderdate >= rev - INTERVAL 365 DAY) AS na365,
  count(o_orderkey) FILTER (o_orderstatus <> 'O' AND o_orderdate - INTERVAL 1 DAY < rev) AS ne FROM sn LEFT JOIN orders ON o_custkey = subject_id AND o_orderdate < rev + INTERVAL 1 DAY GROUP BY 1),
df AS (SELECT subject_id, k, {DX_FLAGS} FROM dx WHERE ward <> 'P' GROUP BY 1, 2), dd AS (SELECT df.*, o_orderdate + INTERVAL 30 DAY AS fin FROM df JOIN orders ON k = o_orderkey),
pd AS (SELECT sn.encounter_id, coalesce(max(ckd), 0) AS p_ckd, coalesce(max(greatest(dem, del)), 0) AS p_cog, max(fin) AS p_end FROM sn LEFT JOIN dd ON sn.subject_id = dd.subject_id AND fin < rev GROUP BY 1),
ef AS (SELECT k, {DX_FLAGS} FROM dx WHERE ward <> 'O' GROUP BY 1),
cx AS (SELECT sn.*, round(lbs * 0.45359237::DOUBLE, 3) AS kg, bmi0, hin, cr, na, na365, ne, p_ckd, p_cog, p_end, coalesce(ef.ckd, 0) AS e_ckd, coalesce(ef.dm, 0) AS e_dm
  FROM sn JOIN ms USING (encounter_id) LEFT JOIN cr USING (encounter_id) JOIN pa USING (encounter_id) JOIN pd USING (encounter_id) LEFT JOIN ef ON sn.stay_id = ef.k),
ctx AS (SELECT *, coalesce(bmi0, round(kg / ((hin * 0.0254::DOUBLE) * (hin * 0.0254::DOUBLE)), 3)) AS bmi,
  CASE WHEN cr > 0 AND kg > 0 THEN round(((140.0::DOUBLE - age_proxy) * kg) / (72.0::DOUBLE * cr) * CASE WHEN sex = 'F' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 3) END AS crcl FROM cx)"""


def context_of(t, scope=None):
    return features.patient_context(
        clinic.scope(t) if scope is None else scope, clinic.patients(t), clinic.admissions(t), clinic.diagnoses(t), clinic.labs(t), clinic.omr(t), clinic.edstays(t),
        clinic.diagnoses(t, "stay_id"))


@query("job_patient_context", "encounter_id:s at:s age:l sex:s kg:d bmi:d cr:d crcl:d why:s na:l na365:l ne:l p_ckd:i p_cog:i p_end:s e_ckd:i e_dm:i", f"""
WITH {CONTEXT_SQL} SELECT encounter_id, rev AS at, age_proxy AS age, sex, kg, bmi, cr, crcl, CASE WHEN crcl IS NOT NULL THEN NULL WHEN kg IS NULL THEN 'missing_weight' WHEN cr IS NULL THEN 'missing_creatinine_first' ELSE 'x' END AS why,
  na, na365, ne, p_ckd, p_cog, p_end, e_ckd, e_dm FROM ctx""")
def job_patient_context(t):
    x = context_of(t)
    return x.select(
        "encounter_id", c("review_timestamp").alias("at"), c("age_context").alias("age"), c("sex_context").alias("sex"), c("weight_kg").alias("kg"), "bmi",
        c("latest_creatinine").alias("cr"), c("cockcroft_gault_ml_min").alias("crcl"), c("cockcroft_gault_unavailable_reason").alias("why"),
        c("prior_admission_count").alias("na"), c("prior_admission_365d_count").alias("na365"), c("prior_ed_visit_count").alias("ne"),
        c("prior_diagnosis_ckd_flag").alias("p_ckd"), c("prior_diagnosis_diagnosis_risk_cognitive_flag").alias("p_cog"),
        c("prior_diagnosis_window_end").alias("p_end"), c("ed_ckd_flag").alias("e_ckd"), c("ed_diabetes_flag").alias("e_dm"))


def _family_sql(f: str) -> str:
    return (f"count(*) FILTER (fam = '{f}') AS {f}_n, max(valuenum) FILTER (fam = '{f}') AS {f}_max, "
            f"arg_min(valuenum, (charttime, valuenum)) FILTER (fam = '{f}') AS {f}_first, arg_max(valuenum, (charttime, valuenum)) FILTER (fam = '{f}') AS {f}_last, "
            f"max(charttime) FILTER (fam = '{f}') AS {f}_t")


TEMPORAL_SQL = f"""{LAB_ROWS}, {VITAL_SQL},
tl AS (SELECT sn.encounter_id, {_family_sql("creatinine")}, {_family_sql("sodium")}, max(charttime) AS lab_end FROM sn LEFT JOIN lb ON sn.hadm_id = lb.hadm_id AND charttime <= rev GROUP BY 1),
tv AS (SELECT sn.encounter_id, count(sbp) AS sbp_n, min(sbp) AS sbp_min, max(heart_rate) AS hr_max, count(pain) AS pain_n, max(ct) AS v_end FROM sn LEFT JOIN vt ON sn.stay_id = vt.stay_id AND ct <= rev GROUP BY 1),
tf AS (SELECT tl.*, sbp_n, sbp_min, hr_max, pain_n, greatest(lab_end, v_end) AS w_end, round(creatinine_last - creatinine_first, 3) AS dl FROM tl JOIN tv ON tl.encounter_id = tv.encounter_id)"""


def temporal_of(t, scope=None):
    return features.temporal_features(clinic.scope(t) if scope is None else scope, clinic.labs(t), clinic.edstays(t), clinic.triage(t), clinic.vitalsign(t))


@query("job_temporal", "encounter_id:s cr_n:l cr_max:d cr_first:d cr_last:d cr_t:s trend:s na_n:l na_last:d sbp_n:l sbp_min:d hr_max:d pain_n:l w_end:s safe:i", f"""
WITH {CONTEXT_SQL}, {TEMPORAL_SQL} SELECT encounter_id, creatinine_n AS cr_n, creatinine_max AS cr_max, creatinine_first AS cr_first, creatinine_last AS cr_last, creatinine_t AS cr_t,
  CASE WHEN dl IS NULL THEN 'unavailable' WHEN dl >= 0.3 THEN 'rising' WHEN dl <= -0.3 THEN 'falling' ELSE 'stable' END AS trend, sodium_n AS na_n, sodium_last AS na_last, sbp_n, sbp_min, hr_max, pain_n, w_end, 1 AS safe FROM tf""")
def job_temporal(t):
    x = temporal_of(t)
    n = "_observation_count_pre_review"
    return x.select(
        "encounter_id", c("creatinine" + n).alias("cr_n"), c("creatinine_max").alias("cr_max"), c("creatinine_first").alias("cr_first"),
        c("creatinine_last").alias("cr_last"), c("creatinine_latest_time").alias("cr_t"), c("creatinine_trend_direction").alias("trend"),
        c("sodium" + n).alias("na_n"), c("sodium_last").alias("na_last"), c("sbp" + n).alias("sbp_n"), "sbp_min", c("heart_rate_max").alias("hr_max"),
        c("pain" + n).alias("pain_n"), c("temporal_window_end").alias("w_end"), c("feature_window_end_at_or_before_review_time_flag").alias("safe"))


@query("job_feature_store", "encounter_id:s med:s kg:d na:l cr_last:d sbp_min:d ok:i miss_bmi:i miss_cr:i miss_bp:i", f"""
WITH {CONTEXT_SQL}, {TEMPORAL_SQL}, md AS (SELECT DISTINCT 'hadm:' || l_orderkey AS encounter_id, lower(p_type) AS med FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT md.encounter_id, med, kg, na, creatinine_last AS cr_last, sbp_min, 1 AS ok, (bmi IS NULL)::INT AS miss_bmi, (creatinine_n = 0)::INT AS miss_cr, (sbp_n = 0)::INT AS miss_bp
FROM md JOIN ctx ON md.encounter_id = ctx.encounter_id JOIN tf ON md.encounter_id = tf.encounter_id""")
def job_feature_store(t):
    scope = stored(clinic.scope(t))  # read by three blocks
    context = stored(context_of(t, scope))
    release(t.spark)  # the context's shuffles end before those of the temporal features begin
    temporal = stored(temporal_of(t, scope))
    release(t.spark)
    x = features.feature_store(scope.drop("age_proxy", "sex"), context, temporal)
    miss = lambda n: (F.get_json_object("missingness_profile_json", f"$.{n}_missing") == "true").cast("int")
    return x.select(
        "encounter_id", c("medication_standardized").alias("med"), c("weight_kg").alias("kg"), c("prior_admission_count").alias("na"),
        c("creatinine_last").alias("cr_last"), "sbp_min", c("feature_available_as_of_review_time_flag").alias("ok"), miss("bmi").alias("miss_bmi"),
        miss("creatinine").alias("miss_cr"), miss("blood_pressure").alias("miss_bp"))


LABEL_HARMS = HARM_SQL.replace("CASE WHEN ward = 'P' THEN admittime ELSE dischtime END AS fin", "dischtime AS fin")


@query("job_labels", "encounter_id:s med:s label:s reason:s renal:i electro:i hemo:i resp:i acute:i different:i down:i", f"""
SELECT a.encounter_id, a.med, label, reason, renal, electro, hemo, resp, (a.med = 'small' AND e.route = 'iv')::INT AS acute, (a.med = 'promo')::INT AS different,
  (a.med = 'large' AND e.sched = 'prn')::INT AS down
FROM ({ACTION_SQL}) a JOIN ({LABEL_HARMS}) h ON a.encounter_id = h.encounter_id JOIN (
  WITH {EV} SELECT encounter_id, med, coalesce(lower(arg_max(route, event_id) FILTER (route IS NOT NULL)), '?') AS route,
    CASE WHEN max((frequency = 'PRN')::INT) = 1 THEN 'prn' ELSE 'other' END AS sched FROM ev GROUP BY 1, 2) e ON a.encounter_id = e.encounter_id AND a.med = e.med""")
def job_labels(t):
    m = c("medication_standardized")
    e = action_events(t)
    rows = action_rows(e).select(
        "*", F.substring_index("encounter_id", ":", -1).cast("bigint").alias("hadm_id"),
        F.when(m == "small", "fentanyl").when(m == "promo", "methadone").alias("ingredient_standardized"),
        F.when(m == "large", "opioid").otherwise("ppi").alias("medication_class_standardized"), F.lit(None).cast("double").alias("duration_before_review_hours"),
        F.lit("hospital_order").alias("selected_medication_event_type"), F.lit(0).alias("newly_started_during_encounter_inferred"))
    rows = stored(rows).withColumn("stay_id", c("hadm_id"))  # read by the evidence, the windows and the labels
    release(t.spark)
    v = t.lineitem.select(
        c("l_orderkey").alias("stay_id"), c("l_shipdate").alias("charttime"), (c("l_quantity") * 4).alias("sbp"), (c("l_quantity") * 3).alias("heartrate"),
        F.when(c("l_linenumber") > 3, c("l_quantity")).alias("resprate"), F.when(c("l_linenumber") > 4, c("l_quantity") + 80).alias("o2sat"))
    item = F.when(c("itemid") == 0, 50912).when(c("itemid") == 1, 50971).when(c("itemid") == 2, 50983).otherwise(1)
    low = rows.withColumn("route_lower", F.lower("route"))
    out = labels.build_labels(low, e, t.labs().withColumn("itemid", item), v)
    acute = (c("ingredient_standardized") == "fentanyl") & F.coalesce(c("route_lower") == "iv", F.lit(False))
    return out.select(
        "encounter_id", m.alias("med"), c("primary_action_label").alias("label"), c("primary_action_label_reason").alias("reason"),
        c("renal_deterioration").alias("renal"), c("electrolyte_instability").alias("electro"), c("hemodynamic_instability").alias("hemo"),
        c("oversedation_respiratory_risk").alias("resp"), F.coalesce(acute, F.lit(False)).cast("int").alias("acute"),
        c("fundamentally_different_deprescribing_logic").alias("different"), c("downweight_recommended").alias("down"))


@query("job_dataset", "rid:s binary:i trainable:i eligible:i score_flag:i split_partition:s", f"""
WITH {EV}, g AS (SELECT any_value(subject_id) AS s, encounter_id AS e, med, min(admittime) AS rev, count(*) AS n, max(route) AS r, max(dose_value) AS d, max(enriched) AS en FROM ev GROUP BY encounter_id, med),
l AS (SELECT *, CASE WHEN n > 1 THEN 1 WHEN d > 25 THEN 0 END AS y, (r IS NULL)::INT AS ex FROM g), t AS (SELECT *, (y IS NOT NULL AND ex = 0)::INT AS tr FROM l),
st AS (SELECT s, CASE WHEN max(CASE WHEN tr = 1 THEN y END) = 1 THEN 'positive' WHEN max(CASE WHEN tr = 1 THEN y END) = 0 THEN 'negative' ELSE 'unlabeled' END AS k FROM t GROUP BY 1),
h AS (SELECT s, k, row_number() OVER (PARTITION BY k ORDER BY sha256('42:' || s), s) AS nth FROM st), z AS (SELECT k, count(*) AS sz FROM st GROUP BY 1),
f AS (SELECT k, sz, unnest([0, 1, 2]) AS i, unnest([sz * 0.7::DOUBLE, sz * 0.15::DOUBLE, sz * 0.15::DOUBLE]) AS raw FROM z),
o AS (SELECT *, floor(raw) AS w, row_number() OVER (PARTITION BY k ORDER BY raw - floor(raw) DESC, raw DESC, i) AS ord FROM f),
x AS (SELECT k, i, w + CASE WHEN ord <= sz - sum(w) OVER (PARTITION BY k) THEN 1 ELSE 0 END AS cnt FROM o), q AS (SELECT k, sum(cnt) FILTER (i = 0) AS c0, sum(cnt) FILTER (i <= 1) AS c1 FROM x GROUP BY 1)
SELECT t.s || '|' || e || '|' || med || '|' || rev AS rid, y AS binary, tr AS trainable, tr * en AS eligible, (n > 2)::INT AS score_flag, CASE WHEN nth <= c0 THEN 'train' WHEN nth <= c1 THEN 'validation' ELSE 'test' END AS split_partition
FROM t JOIN h ON t.s = h.s JOIN q ON h.k = q.k""")
def job_dataset(t):
    e = t.med_events().withColumnRenamed("med", "medication_standardized")
    g = e.groupBy("encounter_id", "medication_standardized").agg(
        F.min("subject_id").alias("subject_id"), F.min("admittime").alias("review_timestamp"), F.count(F.lit(1)).alias("n"), F.max("route").alias("r"),
        F.max("dose_value").alias("d"), F.max("enriched").alias("en"), F.min("hadm_id").alias("hadm_id"))
    g = stored(g).withColumn("stay_id", c("hadm_id"))  # read by six frames
    release(t.spark)
    keys = ds.GRAIN
    scope = g.select(*keys, "hadm_id", "stay_id", c("r").alias("medication_class_standardized"))
    store = g.select(*keys, "d", c("en").alias("feature_available_as_of_review_time_flag"), c("n").alias("n_window_end"))
    action = F.when(c("n") > 1, "stopped_or_deintensified_before_discharge").when(c("d") > 25, "no_clear_stop_or_deintensification_before_discharge").otherwise("action_undetermined")
    lab = g.select(*keys, action.alias("primary_action_label"), c("r").isNull().cast("int").alias("excluded_from_primary_training"),
                   F.lit(0).alias("unknown_or_insufficient_evidence_flag"), F.lit(0).alias("window_censored_flag"))
    sc = g.where(c("n") > 2).select(*keys, c("d").alias("score"))
    data = stored(ds.build_dataset(scope, store, lab, sc).select(
        *keys, "modeling__row_id", "label__primary_action_binary", "label__trainable_primary_supervision_flag",
        "meta__dataset_row_eligible_for_training_flag", "benchmark__current_rule_available_flag"))  # the splits read it again
    release(t.spark)
    out = data.join(ds.build_splits(data), keys)
    return out.select(c("modeling__row_id").alias("rid"), c("label__primary_action_binary").alias("binary"), c("label__trainable_primary_supervision_flag").alias("trainable"),
                      c("meta__dataset_row_eligible_for_training_flag").alias("eligible"), c("benchmark__current_rule_available_flag").alias("score_flag"), "split_partition")


@query("job_review_queue", "k:l r3:l band:s reason:s", f"""
WITH {QUEUE} SELECT k, r3, band, CASE WHEN rev = 1 THEN 'already_reviewed' ELSE 'unreviewed_row' END AS reason FROM qq""")
def job_review_queue(t):
    return review_queue(t).select("k", c("queue_rank").alias("r3"), c("queue_priority_band").alias("band"), F.get("queue_priority_reasons", F.lit(0)).alias("reason"))


def _slice(t):
    q = review_queue(t).withColumn("modeling__row_id", c("k"))
    p = F.element_at(F.array(F.lit(0.2), F.lit(0.35), F.lit(0.45), F.lit(0.65)), (c("o_orderkey") % 4 + 1).cast("int"))
    m = F.element_at(F.array(F.lit(0.3), F.lit(0.4), F.lit(0.1)), (c("o_custkey") % 3 + 1).cast("int"))
    level = F.when(c("o_custkey") % 2 == 0, F.when(c("o_totalprice") < 200000, "low").when(c("o_totalprice") < 300000, "medium").otherwise("high")).otherwise("high")
    scored = t.orders.select(c("o_orderkey").alias("modeling__row_id"), level.alias("prediction__ordinal_priority_level"),
                             p.alias("prediction__probability_high"), m.alias("prediction__probability_medium"))
    return reviews.blind_slice(q, scored, minimum=12_000)


BLIND_SQL = f"""
WITH {QUEUE}, s AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN o_totalprice < 200000 THEN 'low' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'high' END ELSE 'high' END AS ml,
  CASE o_orderkey % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 0.35 WHEN 2 THEN 0.45 ELSE 0.65 END::DOUBLE AS ph, CASE o_custkey % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.4 ELSE 0.1 END::DOUBLE AS pm FROM orders),
j AS (SELECT qq.*, ml, ph, pm, coalesce(lvl <> ml, false)::INT AS f1, (given IS NOT NULL AND qq.k % 10 = 0)::INT AS f2, (ml IN ('medium', 'high') AND abs(ph - pm) <= 0.18::DOUBLE)::INT AS f3 FROM qq JOIN s ON qq.k = s.k),
sel AS (SELECT *, greatest(f1, f2, f3) AS sl FROM j), x AS (SELECT k, row_number() OVER (ORDER BY ph DESC, r3) AS nth FROM sel WHERE sl = 0 AND rev = 0 AND ml = 'high' AND ph >= 0.6),
pq AS (SELECT sel.*, CASE WHEN sl = 1 THEN 0 ELSE 1 END AS f4 FROM sel LEFT JOIN x ON sel.k = x.k WHERE sl = 1 OR nth <= 12000 - (SELECT sum(sl) FROM sel)),
r AS (SELECT *, CASE WHEN f1 + f2 + f3 + f4 > 1 THEN 'mixed_signal_candidate' WHEN f1 = 1 THEN 'model_rule_disagreement' WHEN f2 = 1 THEN 'uncertain_existing_review' WHEN f3 = 1 THEN 'medium_high_boundary' ELSE 'high_signal_unreviewed_fallback' END AS bb,
  f1 * 400 + f2 * 320 + f3 * 240 + f4 * 160 + (1 - rev) * 20 AS bs FROM pq),
bl AS (SELECT *, row_number() OVER (ORDER BY bs DESC, rev, r1, r2, cr, sr, ph DESC, pm DESC, r3) AS br FROM r)"""


@query("job_blind_slice", "k:l band2:s score2:l rank2:l", BLIND_SQL + " SELECT k, bb AS band2, bs AS score2, br AS rank2 FROM bl")
def job_blind_slice(t):
    return _slice(t).select("k", c("blind_band").alias("band2"), c("blind_score").alias("score2"), c("blind_rank").alias("rank2"))


@query("job_post_blind", "row_count:l n:l same_rate:d severe_rate:d kappa:d", f"""
WITH z AS ({BLIND_SQL} SELECT given AS a, ml AS b FROM bl), i AS (SELECT *, CASE a WHEN 'low' THEN 0 WHEN 'high' THEN 2 END AS x, CASE b WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS y FROM z),
g AS (SELECT count(*) AS row_count, count(a) AS n, count(*) FILTER (x = y) AS same, count(*) FILTER (abs(x - y) = 2) AS sev, sum((x - y) * (x - y)) AS obs FROM i),
m AS (SELECT x, count(*) AS cx FROM i WHERE x IS NOT NULL GROUP BY 1), k AS (SELECT y, count(*) AS cy FROM i WHERE x IS NOT NULL GROUP BY 1), e AS (SELECT sum(cx * cy * (x - y) * (x - y)) AS exp FROM m JOIN k ON true)
SELECT row_count, n, same / n AS same_rate, sev / n AS severe_rate, 1.0 - CAST(obs * n AS DOUBLE) / CAST(exp AS DOUBLE) AS kappa FROM g JOIN e ON true""")
def job_post_blind(t):
    _, s = reviews.post_blind(_slice(t), "label__clinician_priority_level", "prediction__ordinal_priority_level")
    return s.select("row_count", c("comparable_level_rows").alias("n"), c("same_level_rate").alias("same_rate"), "severe_rate", c("weighted_kappa_quadratic").alias("kappa"))


@query("job_patient_universe", "subject_id:l top_level:s conf:d n:l n_active:l n_enc:l flagged:l cls:s problems:s", f"""
WITH {STATE}, p AS (SELECT *, (status = 'active_at_review_time')::INT AS a, CASE WHEN hadm_id % 5 > 0 THEN CASE WHEN std = 'fentanyl' THEN 'high' WHEN std = 'omeprazole' THEN 'medium' ELSE 'low' END END AS lv,
  CASE WHEN hadm_id % 5 > 0 THEN (hadm_id % 7) / 10 END AS pl FROM state),
u AS (SELECT *, CASE lv WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END AS rk, CASE WHEN pl IS NOT NULL THEN greatest(pl, 0.3) END AS cf FROM p),
k AS (SELECT subject_id, cls, count(*) AS n FROM u WHERE cls <> 'unresolved' GROUP BY 1, 2), d AS (SELECT subject_id, arg_min(cls, (-n, cls)) AS cls FROM k GROUP BY 1),
g AS (SELECT subject_id, arg_min(coalesce(lv, '?'), (-a, -rk, -coalesce(cf, -1), std, encounter_id)) AS top_level, arg_min(coalesce(cf, -1), (-a, -rk, -coalesce(cf, -1), std, encounter_id)) AS conf, count(*) AS n, sum(a) AS n_active,
  count(DISTINCT encounter_id) AS n_enc, count(*) FILTER (lv IN ('medium', 'high')) AS flagged, max((cls = 'opioid')::INT) AS op FROM u GROUP BY 1)
SELECT g.subject_id, nullif(top_level, '?') AS top_level, nullif(conf, -1) AS conf, n, n_active, n_enc, flagged, cls, CASE WHEN op = 1 THEN 'Oversedation' ELSE '' END AS problems FROM g LEFT JOIN d ON g.subject_id = d.subject_id""")
def job_patient_universe(t):
    state = stored(state_of(t))  # the predictions are made from it
    m = c("medication_standardized")
    level = F.when(m == "fentanyl", "high").when(m == "omeprazole", "medium").otherwise("low")
    pred = state.where(c("hadm_id") % 5 > 0).select(
        *ds.GRAIN, level.alias("prediction__ordinal_priority_level"), ((c("hadm_id") % 7) / 10).alias("prediction__probability_low"),
        F.lit(0.3).alias("prediction__probability_medium"), F.lit(0.1).alias("prediction__probability_high"))
    enc = t.encounters().withColumn("encounter_start", c("admittime")).withColumn("encounter_end", c("dischtime"))
    s = reviews.patient_summary(reviews.patient_universe(state, pred, enc))
    return s.select(
        "subject_id", c("prediction__ordinal_priority_level").alias("top_level"), c("ml_priority_confidence").alias("conf"), c("medication_count").alias("n"),
        c("current_medication_count").alias("n_active"), c("encounter_count").alias("n_enc"), c("flagged_medication_count").alias("flagged"),
        c("dominant_medication_class").alias("cls"), F.array_join("problem_flags", ",").alias("problems"))

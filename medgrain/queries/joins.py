"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from medgrain.operators import asof
from medgrain.operators import joins as ops
from medgrain.operators.skew import first_per_key
from medgrain.plans.encounters import link_stays
from medgrain.plans.events import infer_continuity
from medgrain.plans.reviews import latest_encounters, ordinal_targets
from medgrain.plans.scores import current_rows
from medgrain.plans.semantics import renal_context
from medgrain.queries.registry import ENC, EV, LABS, LINE_ID, decsum, query

c = F.col

# Admissions are the F and O orders of a customer; line items are the ED stays, linked
# through their order unless the order is pending or the line has number 7.
STAYS = f"""adm AS (
  SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderpriority AS admission_type,
         o_orderdate AS admittime, o_orderdate + INTERVAL 30 DAY AS dischtime FROM orders WHERE o_orderstatus <> 'P'),
ed AS (
  SELECT o_custkey AS subject_id, CASE WHEN l_linenumber <> 7 THEN l_orderkey END AS hadm_id, {LINE_ID} AS stay_id,
         l_shipdate AS intime, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS outtime,
         CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS arrival_transport,
         CASE WHEN l_linestatus = 'F' THEN 'HOME' END AS disposition
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _stays(t):
    adm = t.orders.where(c("o_orderstatus") != "P").select(
        c("o_custkey").alias("subject_id"), c("o_orderkey").alias("hadm_id"), c("o_orderpriority").alias("admission_type"),
        c("o_orderdate").alias("admittime"), (c("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("dischtime"),
    )
    ed = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select(
        c("o_custkey").alias("subject_id"), F.when(c("l_linenumber") != 7, c("l_orderkey")).alias("hadm_id"),
        t.line_id().alias("stay_id"), c("l_shipdate").alias("intime"),
        (c("l_shipdate") + F.make_dt_interval(c("l_quantity").cast("int"))).alias("outtime"),
        F.when(c("l_returnflag") != "N", c("l_returnflag")).alias("arrival_transport"),
        F.when(c("l_linestatus") == "F", F.lit("HOME")).alias("disposition"),
    )
    return adm, ed


@query(
    "join_encounter_index",
    "subject_id:l hadm_id:l stay_id:s encounter_source:s intime:s outtime:s admittime:s arrival_transport:s disposition:s "
    "linked_segment_count:l", f"""
WITH {STAYS}, seg AS (
  SELECT subject_id, hadm_id, min(intime) AS intime, max(outtime) AS outtime, count(*) AS linked_segment_count,
         arg_max(stay_id, (outtime, intime, stay_id)) AS stay_id,
         arg_min(arrival_transport, (intime, outtime, stay_id)) FILTER (arrival_transport IS NOT NULL) AS arrival_transport,
         arg_max(disposition, (outtime, intime, stay_id)) FILTER (disposition IS NOT NULL) AS disposition
  FROM ed WHERE hadm_id IS NOT NULL GROUP BY ALL)
SELECT s.subject_id, s.hadm_id, stay_id, CASE WHEN a.hadm_id IS NULL THEN 'ed_only' ELSE 'ed_to_inpatient' END AS encounter_source,
       intime, outtime, admittime, arrival_transport, disposition, linked_segment_count
FROM seg s LEFT JOIN adm a ON s.subject_id = a.subject_id AND s.hadm_id = a.hadm_id
UNION ALL
SELECT subject_id, hadm_id, NULL, 'hospital_only', NULL, NULL, admittime, NULL, NULL, NULL FROM adm a
WHERE NOT EXISTS (SELECT 1 FROM seg s WHERE s.subject_id = a.subject_id AND s.hadm_id = a.hadm_id)
UNION ALL
SELECT subject_id, hadm_id, stay_id, 'ed_only', intime, outtime, NULL, arrival_transport, disposition, 1 FROM ed
WHERE hadm_id IS NULL""")
def join_encounter_index(t):
    return link_stays(*_stays(t))


@query("join_semi", "l_orderkey:l l_linenumber:i l_partkey:l", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F')""")
def join_semi(t):
    ids = t.orders.where((c("o_orderpriority") == "2-HIGH") & (c("o_orderstatus") == "F"))
    return ops.semi_to(t.lineitem, ids.select(c("o_orderkey").alias("l_orderkey")), ["l_orderkey"])


@query("join_anti", "o_orderkey:l o_custkey:l", """
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def join_anti(t):
    returned = t.lineitem.where(c("l_returnflag") == "R").select(c("l_orderkey").alias("o_orderkey"))
    return ops.anti_to(t.orders, returned, ["o_orderkey"])


@query("join_checked_m1", "l_orderkey:l l_partkey:l p_type:s p_size:i", """
SELECT l_orderkey, l_partkey, p_type, p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def join_checked_m1(t):
    return ops.checked_join(t.lineitem, t.part.withColumnRenamed("p_partkey", "l_partkey"), ["l_partkey"])


@query("join_alignment_counts", "both:l left_only:l right_only:l", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT count(a.k) FILTER (b.k IS NOT NULL) AS both, count(a.k) FILTER (b.k IS NULL) AS left_only,
       count(b.k) FILTER (a.k IS NULL) AS right_only FROM a FULL JOIN b ON a.k = b.k""")
def join_alignment_counts(t):
    o = t.orders.withColumnRenamed("o_custkey", "k")
    return ops.alignment_counts(o.where(c("o_orderstatus") == "F"), o.where(c("o_orderpriority") == "1-URGENT"), ["k"])


@query("join_context_ed", "event_id:l user_id:l enc:s src:i", """
WITH a AS (SELECT o_custkey AS user_id, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey AS user_id, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT event_id, e.user_id, 'hadm:' || coalesce(a.k, b.k) AS enc,
       CASE WHEN a.k IS NOT NULL THEN 0 WHEN b.k IS NOT NULL THEN 1 END AS src
FROM events e LEFT JOIN a ON e.user_id = a.user_id LEFT JOIN b ON e.user_id = b.user_id""")
def join_context_ed(t):
    o = t.orders.select(c("o_custkey").alias("user_id"), "o_orderkey", "o_orderstatus",
                        F.concat(F.lit("hadm:"), c("o_orderkey").cast("string")).alias("enc"))
    first = o.where(c("o_orderstatus") == "F").withColumn("src", F.lit(0))
    second = o.where(c("o_orderstatus") == "O").withColumn("src", F.lit(1))
    return t.events.join(ops.first_lookup([first, second], ["user_id"], ["o_orderkey"]), "user_id", "left")


@query("join_context_hosp", "l_orderkey:l l_linenumber:i o_custkey:l o_orderdate:s", """
SELECT l_orderkey, l_linenumber, o_custkey, o_orderdate FROM lineitem
LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'""")
def join_context_hosp(t):
    o = t.orders.where(c("o_orderstatus") != "P").withColumnRenamed("o_orderkey", "l_orderkey")
    lookup = first_per_key(o, ["l_orderkey"], ["o_orderdate"], ["o_custkey", "o_orderdate"])
    return t.lineitem.join(lookup, "l_orderkey", "left")


# Orders are prescriptions with a blank route for some; line items are the pharmacy rows,
# accepted when their part type matches the order's or is missing (line number 7).
BEST = """o AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS route,
         CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority END AS freq, o_custkey % 3 AS g FROM orders),
p AS (
  SELECT l_orderkey AS k, nullif(l_returnflag, 'N') AS route, CASE WHEN l_linenumber > 2 THEN l_linestatus END AS freq,
         CASE WHEN l_linenumber < 7 THEN l_suppkey % 3 END AS g, l_partkey AS pk, l_suppkey AS sk FROM lineitem)"""


@query("join_best_match", "k:l route:s freq:s order_enrichment_applied_flag:i", f"""
WITH {BEST}, m AS (
  SELECT o.k, p.route AS r, p.freq AS f, (p.route IS NOT NULL)::INT + (p.freq IS NOT NULL)::INT AS n,
         row_number() OVER (PARTITION BY o.k ORDER BY (p.route IS NOT NULL)::INT + (p.freq IS NOT NULL)::INT DESC, pk, sk) AS rn
  FROM o JOIN p ON o.k = p.k AND (p.g IS NULL OR p.g = o.g))
SELECT o.k, coalesce(nullif(route, ''), r) AS route, coalesce(freq, f) AS freq,
       CASE WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END AS order_enrichment_applied_flag
FROM o LEFT JOIN m ON o.k = m.k AND rn = 1""")
def join_best_match(t):
    o = t.orders.select(
        c("o_orderkey").alias("k"), F.when(c("o_orderstatus") == "F", "").otherwise(c("o_orderstatus")).alias("route"),
        F.when(c("o_orderpriority").startswith("1"), c("o_orderpriority")).alias("freq"), (c("o_custkey") % 3).alias("g"),
    )
    p = t.lineitem.select(
        c("l_orderkey").alias("k"), F.nullif("l_returnflag", F.lit("N")).alias("route"),
        F.when(c("l_linenumber") > 2, c("l_linestatus")).alias("freq"),
        F.when(c("l_linenumber") < 7, c("l_suppkey") % 3).alias("g"), c("l_partkey").alias("pk"), c("l_suppkey").alias("sk"),
    )
    accept = c("r.g").isNull() | (c("r.g") == c("l.g"))
    return ops.enrich_best_match(o, p, ["k"], "k", accept, {"route": "route", "freq": "freq"}, ["pk", "sk"])


@query("join_detail_fanout", "k:l cust:l dose:d unit:s detail_match_flag:i", """
SELECT o_orderkey AS k, o_custkey AS cust, dose, unit, CASE WHEN dose IS NOT NULL OR unit IS NOT NULL THEN 1 ELSE 0 END AS detail_match_flag
FROM orders LEFT JOIN (
  SELECT l_orderkey, CASE WHEN l_linenumber < 5 THEN l_quantity END AS dose, CASE WHEN l_returnflag = 'A' THEN 'mg' END AS unit,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS rn FROM lineitem)
ON o_orderkey = l_orderkey AND rn = 1""")
def join_detail_fanout(t):
    admin = t.orders.select(c("o_orderkey").alias("k"), c("o_custkey").alias("cust"))
    detail = t.lineitem.select(
        c("l_orderkey").alias("k"), F.when(c("l_linenumber") < 5, c("l_quantity")).alias("dose"),
        F.when(c("l_returnflag") == "A", "mg").alias("unit"), "l_partkey", "l_suppkey", "l_linenumber",
    )
    return ops.attach_detail(admin, detail, ["k"], ["dose", "unit"], "k", ["l_partkey", "l_suppkey", "l_linenumber"])


@query("join_mapping_defaults", "l_orderkey:l l_partkey:l std:s src:s cnt:i", """
WITH m AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_type END AS std, p_brand AS src, p_size AS cnt FROM part WHERE p_size > 5)
SELECT l_orderkey, l_partkey, coalesce(std, p_name) AS std, coalesce(src, 'unmapped') AS src, coalesce(cnt, 0) AS cnt
FROM lineitem l JOIN part p ON l_partkey = p.p_partkey LEFT JOIN m ON l_partkey = m.p_partkey""")
def join_mapping_defaults(t):
    events = t.lineitem.join(t.part.select("p_partkey", "p_name"), c("l_partkey") == c("p_partkey"))
    m = t.part.where(c("p_size") > 5).select(
        "p_partkey", F.when(c("p_size") > 10, c("p_type")).alias("std"), c("p_brand").alias("src"), c("p_size").alias("cnt"))
    return ops.apply_mapping(events, m, "p_partkey", {"std": "col:p_name", "src": "unmapped", "cnt": 0})


@query("join_non_downgrade", "k:l code:s ing:s mapping_used_flag:i", """
WITH s AS (SELECT l_partkey AS k, max(CASE WHEN l_linenumber > 5 THEN l_returnflag END) AS code, max(l_linestatus) AS ing,
                  max(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS enriched FROM lineitem GROUP BY 1),
m AS (SELECT p_partkey AS k, p_type AS code, p_brand AS ing, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS ok FROM part WHERE p_size > 10)
SELECT s.k, CASE WHEN u THEN m_code ELSE code END AS code, CASE WHEN u THEN m_ing ELSE ing END AS ing, u::INT AS mapping_used_flag
FROM (SELECT s.*, m.code AS m_code, m.ing AS m_ing, (coalesce(ok = 1, false) OR enriched = 0) AND ok IS NOT NULL AS u
      FROM s LEFT JOIN m ON s.k = m.k) s""")
def join_non_downgrade(t):
    s = t.lineitem.groupBy(c("l_partkey").alias("k")).agg(
        F.max(F.when(c("l_linenumber") > 5, c("l_returnflag"))).alias("code"), F.max("l_linestatus").alias("ing"),
        F.max((c("l_linenumber") == 7).cast("int")).alias("enriched"))
    m = t.part.where(c("p_size") > 10).select(
        c("p_partkey").alias("k"), c("p_type").alias("code"), c("p_brand").alias("ing"), (c("p_size") > 25).cast("int").alias("ok"))
    return ops.reenrich(s, m, "k", ["code", "ing"], c("enriched") == 1, "ok")


SNAP = "snap AS (SELECT event_id, user_id, ts AS rev FROM events WHERE event_type = 'purchase')"


def _snapshots(t):
    return t.events.where(c("event_type") == "purchase").select("event_id", "user_id", c("ts").alias("rev"))


@query("join_asof", "event_id:l user_id:l rev:s value:d value_time:s", f"""
WITH {SNAP}, obs AS (SELECT user_id, ts, value FROM events WHERE event_type <> 'purchase')
SELECT event_id, snap.user_id, rev, value, obs.ts AS value_time
FROM snap ASOF LEFT JOIN obs ON snap.user_id = obs.user_id AND snap.rev >= obs.ts""")
def join_asof(t):
    obs = t.events.where(c("event_type") != "purchase").select("user_id", "ts", "value")
    return asof.asof_latest(_snapshots(t), obs, ["user_id"], "rev", "ts", "value")


@query("join_latest_before", "subject_id:l dischtime:s price:d price_time:s", """
WITH adm AS (SELECT o_custkey AS subject_id, max(o_orderdate) + INTERVAL 30 DAY AS dischtime FROM orders
             WHERE o_orderstatus = 'F' GROUP BY 1),
obs AS (SELECT o_custkey AS subject_id, o_orderdate AS d, max(o_totalprice) AS price FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)
SELECT a.subject_id, dischtime, price, d AS price_time FROM adm a ASOF LEFT JOIN obs ON a.subject_id = obs.subject_id AND a.dischtime >= obs.d""")
def join_latest_before(t):
    o = t.orders.select(c("o_custkey").alias("subject_id"), "o_orderdate", c("o_totalprice").alias("price"), "o_orderstatus")
    adm = o.where(c("o_orderstatus") == "F").groupBy("subject_id").agg(
        (F.max("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("dischtime"))
    obs = o.where(c("o_orderstatus") != "F")
    return asof.asof_latest(adm, obs, ["subject_id"], "dischtime", "o_orderdate", "price", bucket_seconds=86_400 * 30)


@query("join_asof_flags",
       "encounter_id:s value:d time:s age_flag:i sex_flag:i context_flag:i", f"""
WITH {ENC}, {LABS}, cr AS (SELECT hadm_id, charttime, max(valuenum) AS v FROM labs WHERE itemid IN (0, 1) GROUP BY ALL),
r AS (SELECT encounter_id, hadm_id, admittime + INTERVAL 10 DAY AS at, sex, nullif(age_proxy, 7) AS age FROM enc)
SELECT encounter_id, round(v, 3) AS value, charttime AS time, CASE WHEN age IS NULL THEN 0 ELSE 1 END AS age_flag, 1 AS sex_flag,
       CASE WHEN age IS NOT NULL AND charttime IS NOT NULL THEN 1 ELSE 0 END AS context_flag
FROM r ASOF LEFT JOIN cr ON r.hadm_id = cr.hadm_id AND r.at >= cr.charttime""")
def join_asof_flags(t):
    enc = t.encounters().withColumn("age_proxy", F.nullif("age_proxy", F.lit(7)))
    rows = enc.select("encounter_id", "hadm_id", (c("admittime") + F.make_dt_interval(F.lit(10))).alias("review_timestamp"))
    out = renal_context(rows, t.labs(), enc, items=(0, 1))
    p = "renal_context_"
    return out.select(
        "encounter_id", c(p + "latest_creatinine_value").alias("value"), c(p + "latest_creatinine_time").alias("time"),
        c(p + "age_available_flag").alias("age_flag"), c(p + "sex_available_flag").alias("sex_flag"),
        c(p + "available_flag").alias("context_flag"))


@query("join_continuity_or", "event_id:s kind:s cont:i started:i", f"""
WITH {EV}, e AS (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN hadm_id END AS h, hash_stay AS s FROM (
  SELECT *, CAST(dose_value AS INTEGER) % 5 AS hash_stay FROM ev)),
home AS (SELECT * FROM e WHERE kind = 'home_medrecon')
SELECT event_id, kind, CASE WHEN kind <> 'home_medrecon' AND f THEN 1 ELSE 0 END AS cont,
       CASE WHEN kind <> 'home_medrecon' AND NOT f THEN 1 ELSE 0 END AS started
FROM (SELECT e.*, EXISTS (SELECT 1 FROM home x WHERE x.subject_id = e.subject_id AND x.h = e.h AND x.med = e.med)
      OR EXISTS (SELECT 1 FROM home x WHERE x.subject_id = e.subject_id AND x.s = e.s AND x.med = e.med) AS f FROM e)""")
def join_continuity_or(t):
    li = t.lineitem.select(t.line_id().alias("event_id"), "l_linenumber")
    e = t.med_events().join(li, "event_id").select(
        "event_id", "subject_id", F.when(c("l_linenumber") % 3 != 0, c("hadm_id")).alias("hadm_id"),
        (c("dose_value").cast("int") % 5).alias("stay_id"), c("med").alias("medication_normalized"),
        c("kind").alias("medication_event_type"))
    out = infer_continuity(e)
    return out.select("event_id", c("medication_event_type").alias("kind"), c("continued_from_home_inferred").alias("cont"),
                      c("newly_started_during_encounter_inferred").alias("started"))


@query("join_current_only", "hadm_id:l drug_normalized:s review_timestamp:s n:l", f"""
WITH {EV}, rv AS (SELECT subject_id, hadm_id, med, max(starttime) AS review_timestamp FROM ev WHERE kind = 'hospital_order' GROUP BY ALL),
co AS (SELECT subject_id, hadm_id, med, count(*) AS n FROM ev GROUP BY ALL)
SELECT co.hadm_id, co.med AS drug_normalized, review_timestamp, n FROM co JOIN rv
ON co.subject_id = rv.subject_id AND co.hadm_id = rv.hadm_id AND co.med = rv.med""")
def join_current_only(t):
    e = t.med_events()
    review = e.select(
        "subject_id", "hadm_id", "encounter_id", c("med").alias("medication_normalized"), c("starttime").alias("review_timestamp"),
        F.when(c("kind") == "hospital_order", "active_at_review_time").alias("medication_status_at_review"))
    cohort = e.groupBy("subject_id", "hadm_id", c("med").alias("drug_normalized")).agg(F.count(F.lit(1)).alias("n"))
    return current_rows(cohort, review)


@query("join_assemble", "k:l med:s benchmark__n:l label__flag:s score__v:d score_available_flag:i", f"""
WITH {EV}, g AS (SELECT hadm_id AS k, med, count(*) AS n, max(route) AS r FROM ev GROUP BY ALL),
s AS (SELECT hadm_id AS k, med, max(dose_value) AS v FROM ev WHERE kind = 'home_medrecon' GROUP BY ALL)
SELECT g.k, g.med, n AS benchmark__n, r AS label__flag, v AS score__v, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS score_available_flag
FROM g LEFT JOIN s ON g.k = s.k AND g.med = s.med""")
def join_assemble(t):
    e = t.med_events().withColumnRenamed("hadm_id", "k")
    keys = ["k", "med"]
    base = e.select(*keys).distinct()
    bench = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("benchmark__n"))
    labels = e.groupBy(*keys).agg(F.max("route").alias("label__flag"))
    scores = e.where(c("kind") == "home_medrecon").groupBy(*keys).agg(F.max("dose_value").alias("score__v"))
    return ops.assemble(base, {"bench": bench, "labels": labels}, {"score": scores}, keys)


@query("join_latest_override", "subject_id:l encounter_id:s reviewed_override_flag:i", f"""
WITH {ENC}, l AS (SELECT subject_id, arg_max(encounter_id, (dischtime, hadm_id)) AS e FROM enc GROUP BY 1),
r AS (SELECT subject_id, arg_max(encounter_id, (admittime, price, encounter_id)) AS e FROM enc WHERE ward = 'P' AND age_proxy > 50 GROUP BY 1)
SELECT l.subject_id, coalesce(r.e, l.e) AS encounter_id, CASE WHEN r.e IS NULL THEN 0 ELSE 1 END AS reviewed_override_flag
FROM l LEFT JOIN r ON l.subject_id = r.subject_id""")
def join_latest_override(t):
    enc = t.encounters().withColumn("encounter_end", c("dischtime")).withColumn("encounter_start", c("admittime")).withColumn(
        "stay_id", F.lit(None).cast("bigint"))
    reviews = enc.where((c("ward") == "P") & (c("age_proxy") > 50)).select(
        "subject_id", "encounter_id", c("admittime").alias("review_timestamp"), c("price").alias("review_submission_timestamp"))
    return latest_encounters(enc, reviews)


@query("join_fallback", "k:l match_pass:i best:d best_id:l", """
WITH r AS (SELECT p_name, p_type, p_retailprice AS best, p_partkey AS best_id FROM part WHERE p_size > 20),
a AS (SELECT p_name, p_type, arg_max(best_id, (best, -best_id)) AS best_id, max(best) AS best FROM r GROUP BY ALL),
b AS (SELECT p_type, arg_max(best_id, (best, -best_id)) AS best_id, max(best) AS best FROM r GROUP BY ALL)
SELECT p_partkey AS k, CASE WHEN a.best IS NOT NULL THEN 1 WHEN b.best IS NOT NULL THEN 2 END AS match_pass,
       coalesce(a.best, b.best) AS best, coalesce(a.best_id, b.best_id) AS best_id
FROM part p LEFT JOIN a ON p.p_name = a.p_name AND p.p_type = a.p_type LEFT JOIN b ON p.p_type = b.p_type""")
def join_fallback(t):
    left = t.part.select(c("p_partkey").alias("k"), "p_name", "p_type")
    right = t.part.where(c("p_size") > 20).select(
        c("p_name").alias("rn"), c("p_type").alias("rt"), c("p_retailprice").alias("best"), c("p_partkey").alias("best_id"))
    return ops.fallback_match(left, right, "k", [(["p_name", "p_type"], ["rn", "rt"]), (["p_type"], ["rt"])],
                              ["-best", "best_id"], ["best", "best_id"])


@query("join_overlay", "conv_id:l first_turn:l role:s text_length:l reviewed:i", """
SELECT q.conv_id, first_turn, role, text_length, CASE WHEN role IS NULL THEN 0 ELSE 1 END AS reviewed
FROM (SELECT conv_id, min(turn) AS first_turn FROM conversations GROUP BY 1) q LEFT JOIN (
  SELECT conv_id, arg_max(role, turn) AS role, arg_max(length(text), turn) AS text_length FROM conversations
  WHERE role = 'assistant' GROUP BY 1) l ON q.conv_id = l.conv_id""")
def join_overlay(t):
    v = t.conversations
    queue = v.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.min("role").alias("role"), F.lit(0).alias("reviewed"))
    said = v.where(c("role") == "assistant").withColumn("text_length", F.length("text"))
    latest = first_per_key(said, ["conv_id"], ["-turn"], ["role", "text_length"])
    return ops.overlay(queue, latest, ["conv_id"], ["role", "text_length"], "reviewed")


@query("join_interval_window", "hadm_id:l n:l hi:d lo:d total:d", f"""
WITH {ENC}, {LABS}, w AS (SELECT hadm_id, admittime + INTERVAL 5 DAY AS a, dischtime AS b FROM enc)
SELECT w.hadm_id, nullif(count(l.hadm_id), 0) AS n, max(valuenum) AS hi, min(valuenum) AS lo, {decsum("valuenum")} AS total
FROM w LEFT JOIN labs l ON w.hadm_id = l.hadm_id AND charttime > a AND charttime <= b GROUP BY 1""")
def join_interval_window(t):
    w = t.encounters().select("hadm_id", (c("admittime") + F.make_dt_interval(F.lit(5))).alias("a"), c("dischtime").alias("b"))
    return asof.window_summary(w, t.labs(), "hadm_id", "a", "b", "charttime", {
        "n": F.count(F.lit(1)), "hi": F.max("valuenum"), "lo": F.min("valuenum"),
        "total": F.sum(c("valuenum").cast("decimal(28,6)")).cast("double")})


@query("join_sidecar", "doc_id:l level:s idx:i split_partition:s flag:i why:s", """
SELECT l.doc_id, lv AS level, CASE lv WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END AS idx,
       sp AS split_partition, CASE WHEN lv IS NOT NULL AND f = 1 AND st = 'reviewed' THEN 1 ELSE 0 END AS flag,
       CASE WHEN lv IS NULL THEN 'missing_priority_level' WHEN f <> 1 THEN 'feature_unavailable_as_of_review_time'
            WHEN st <> 'reviewed' THEN 'review_status_' || st END AS why
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS lv,
             CASE WHEN quality = 1 THEN 'reviewed' ELSE 'uncertain' END AS st FROM labels) l
JOIN (SELECT doc_id, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS f,
             CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS sp FROM documents) d ON l.doc_id = d.doc_id""")
def join_sidecar(t):
    grain = [c("doc_id").alias("subject_id"), F.lit("e").alias("encounter_id"), F.lit("m").alias("medication_standardized"),
             F.lit("2020-01-01").cast("timestamp_ntz").alias("review_timestamp")]
    data = t.documents.select(
        *grain, c("doc_id").cast("string").alias("modeling__row_id"),
        (c("n_chars") > 300).cast("int").alias("meta__feature_available_as_of_review_time_flag"))
    splits = t.documents.select(*grain, F.when(c("doc_id") % 5 == 0, "test").otherwise("train").alias("split_partition"))
    latest = t.labels.select(
        *grain, F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit(None)), (c("doc_id") % 4 + 1).cast("int")).alias(
            "label__clinician_priority_level"), F.lit(None).cast("double").alias("label__clinician_priority_score"),
        F.when(c("quality") == 1, "reviewed").otherwise("uncertain").alias("label__clinician_review_status"))
    out = ordinal_targets(data, latest, splits)
    return out.select(c("subject_id").alias("doc_id"), c("ordinal_target_level").alias("level"),
                      c("ordinal_target_level_index").alias("idx"), "split_partition",
                      c("training_inclusion_flag").alias("flag"), c("training_exclusion_reason").alias("why"))


@query("join_unique_resolution", "k:l resolved_key:l resolution_method:s", """
WITH u AS (SELECT p_brand AS b, p_name AS nm, p_size AS sz, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part GROUP BY ALL),
a AS (SELECT b, sz, min(lo) AS lo, max(hi) AS hi FROM u GROUP BY ALL), n AS (SELECT b, nm, min(lo) AS lo, max(hi) AS hi FROM u GROUP BY ALL)
SELECT p_partkey AS k, CASE WHEN a.lo = a.hi THEN a.lo WHEN a.lo IS NULL AND n.lo = n.hi THEN n.lo END AS resolved_key,
       CASE WHEN a.lo = a.hi THEN 'size' WHEN a.lo IS NULL AND n.lo = n.hi THEN 'name' ELSE 'unresolved' END AS resolution_method
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS wanted FROM part) p
LEFT JOIN a ON a.b = p.p_brand AND a.sz = p.wanted LEFT JOIN n ON n.b = p.p_brand AND n.nm = p.p_name""")
def join_unique_resolution(t):
    rows = t.part.select(c("p_partkey").alias("k"), c("p_brand").alias("b"), c("p_name").alias("nm"),
                         F.when(c("p_partkey") % 3 == 0, c("p_size")).alias("wanted"))
    universe = t.part.select(c("p_brand").alias("b"), c("p_name").alias("unm"), c("p_size").alias("usz"), c("p_partkey").alias("grain"))
    return ops.resolve_unique(rows, universe, "k", ["b"], "grain", [("size", "wanted", "usz"), ("name", "nm", "unm")])

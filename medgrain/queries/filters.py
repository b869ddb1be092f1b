"""Filter and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from medgrain.functions import times
from medgrain.operators import filters as ops
from medgrain.operators.ordering import first_subjects, page
from medgrain.queries.registry import ENC, EV, query


@query("flt_eligibility", "subject_id:l age_proxy:l age_group:s eligibility_flag:i rule:s min_age:l", """
SELECT c_custkey AS subject_id, age_proxy,
       CASE WHEN age_proxy >= 85 THEN '85+' WHEN age_proxy >= 75 THEN '75-84' ELSE '65-74' END AS age_group,
       1 AS eligibility_flag, 'age_proxy_at_least_65' AS rule, 65 AS min_age
FROM (SELECT c_custkey, CAST(floor((c_acctbal + 1000) / 110) AS BIGINT) AS age_proxy FROM customer)
WHERE age_proxy >= 65""")
def flt_eligibility(t):
    people = t.customer.select(
        F.col("c_custkey").alias("subject_id"), F.floor((F.col("c_acctbal") + 1000) / 110).cast("bigint").alias("age_proxy")
    )
    out = ops.eligible(people, "age_proxy")
    return out.withColumn("rule", F.col("eligibility_rule_name")).withColumn(
        "min_age", F.get_json_object("eligibility_criteria_json", "$.minimum_age_proxy_years")
    )


@query("flt_first_n_subjects", "o_orderkey:l o_custkey:l", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 100)""")
def flt_first_n_subjects(t):
    return first_subjects(t.orders, "o_custkey", 100)


@query("flt_active_interval", "event_id:s starttime:s stoptime:s", f"""
WITH {EV}
SELECT event_id, starttime, stoptime FROM ev
WHERE starttime <= dischtime AND (stoptime IS NULL OR stoptime >= dischtime)""")
def flt_active_interval(t):
    e = t.med_events()
    return e.where(times.active_interval(F.col("starttime"), F.col("stoptime"), F.col("dischtime")))


ACTIVE_SQL = """CASE WHEN kind IN ('ed_pyxis', 'hospital_admin') THEN starttime = rev
     WHEN kind = 'home_medrecon' THEN continued = 1 AND starttime <= rev AND (stoptime IS NULL OR stoptime >= rev)
     ELSE starttime <= rev AND (stoptime IS NULL OR stoptime >= rev) END"""


@query("flt_active_event_by_kind", "kind:s event_id:s", f"""
WITH {EV} SELECT kind, event_id FROM (SELECT *, admittime + INTERVAL 20 DAY AS rev FROM ev) WHERE {ACTIVE_SQL}""")
def flt_active_event_by_kind(t):
    e = t.med_events().withColumn("rev", F.col("admittime") + F.make_dt_interval(F.lit(20)))
    c = F.col
    return e.where(times.active_event(c("kind"), c("starttime"), c("stoptime"), c("rev"), c("continued")))


@query("flt_post_window", "event_id:s starttime:s stoptime:s", f"""
WITH {EV} SELECT event_id, starttime, stoptime FROM (SELECT *, admittime + INTERVAL 20 DAY AS rev FROM ev)
WHERE (starttime > rev AND starttime <= dischtime) OR (stoptime > rev AND stoptime <= dischtime)""")
def flt_post_window(t):
    c = F.col
    e = t.med_events().withColumn("rev", c("admittime") + F.make_dt_interval(F.lit(20)))
    return e.where(
        times.in_window(c("starttime"), c("rev"), c("dischtime")) | times.in_window(c("stoptime"), c("rev"), c("dischtime"))
    )


@query("flt_item_family", "event_id:l user_id:l event_type:s value:d", """
SELECT event_id, user_id, event_type, nullif(value, 0.01) AS value FROM events
WHERE event_type IN ('purchase', 'view') AND nullif(value, 0.01) IS NOT NULL AND ts IS NOT NULL""")
def flt_item_family(t):
    e = t.events.withColumn("value", F.nullif("value", F.lit(0.01)))
    return ops.filter_items(e, "event_type", ["purchase", "view"], ["user_id", "ts", "value"])


@query("flt_anti_support", "c_custkey:l c_mktsegment:s", """
SELECT c_custkey, c_mktsegment FROM customer
WHERE c_nationkey < 15 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def flt_anti_support(t):
    wanted = t.customer.where(F.col("c_nationkey") < 15)
    evidence = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return ops.needs_support(wanted, evidence, ["c_custkey"])


@query("flt_queue", "conv_id:l turn:l role:s", """
SELECT conv_id, turn, role FROM conversations
WHERE role = 'user' AND turn > 0 AND len(list_distinct(string_split(lower(text), ' '))) > 5""")
def flt_queue(t):
    q = t.conversations.select(
        "*", F.array_distinct(F.split(F.lower("text"), " ")).alias("tags"), (F.col("turn") == 0).cast("int").alias("reviewed")
    ).where(F.size("tags") > 5)
    return ops.filter_queue(q, unreviewed="reviewed", equals={"role": "user"}, tags="tags", has_tags=True)


@query("flt_column_roles", "role:s column_name:s known_count:l", """
SELECT 'feature' AS role, 'feature__quantity' AS column_name, count(l_quantity) AS known_count FROM lineitem
UNION ALL SELECT 'feature', 'feature__price', count(l_extendedprice) FROM lineitem
UNION ALL SELECT 'label', 'label__flag', count(nullif(l_returnflag, 'R')) FROM lineitem
UNION ALL SELECT 'meta', 'meta__order', count(l_orderkey) FROM lineitem""")
def flt_column_roles(t):
    c = F.col
    wide = t.lineitem.select(
        c("l_quantity").alias("feature__quantity"), c("l_extendedprice").alias("feature__price"),
        c("l_shipdate").alias("feature__ship_latest_time"), F.nullif(c("l_returnflag"), F.lit("R")).alias("label__flag"),
        c("l_orderkey").alias("meta__order"),
    )
    names = ops.trainable_columns(wide.columns)
    return ops.role_profile(wide.select(*names), ("feature", "label", "benchmark", "meta"))


@query("flt_supported_subset", "hadm_id:l med:s n_events:l dose:d", f"""
WITH {EV}, s AS (SELECT hadm_id, med, count(*) AS n_events FROM ev GROUP BY ALL),
b AS (SELECT hadm_id, med, max(dose_value) AS dose FROM ev GROUP BY ALL)
SELECT s.hadm_id, s.med, n_events, dose FROM s JOIN b ON s.hadm_id = b.hadm_id AND s.med = b.med
WHERE s.med IN ('small', 'promo')""")
def flt_supported_subset(t):
    e = t.med_events()
    sem = e.groupBy("hadm_id", "med").agg(F.count(F.lit(1)).alias("n_events"))
    bur = e.groupBy("hadm_id", "med").agg(F.max("dose_value").alias("dose"))
    return ops.supported_subset(sem, bur, ["hadm_id", "med"], "med", ["small", "promo"])


@query("flt_paged_listing", "o_orderkey:l o_totalprice:d total_rows:l", """
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total_rows
FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def flt_paged_listing(t):
    return page(t.orders, {"o_orderstatus": "F", "o_orderpriority": None}, ["-o_totalprice", "o_orderkey"], 50, 100)

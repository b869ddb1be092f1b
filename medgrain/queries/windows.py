"""Window, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from medgrain.operators import asof, ordering
from medgrain.operators.agreement import top_disagreements
from medgrain.operators.intervals import collapse_intervals, episode_segments
from medgrain.operators.skew import first_per_key
from medgrain.plans import reviews
from medgrain.queries.aggregates import ACT, LEVELS_SQL, TREND_SQL, level_rows, status_rows
from medgrain.queries.joins import SNAP, _snapshots
from medgrain.queries.registry import EV, LINE_ID, decsum, query

c = F.col

# Line items per (supplier, part name) as prescriptions; number 7 has an open stop and
# number 6 an open start.
RX = f"""rx0 AS (
  SELECT l_suppkey AS sup, p_name AS nm, {LINE_ID} AS id, CASE WHEN l_linenumber <> 6 THEN l_shipdate END AS a,
         CASE WHEN l_linenumber <> 7 THEN l_shipdate + to_days(CAST(l_quantity AS INTEGER)) END AS b,
         nullif(l_returnflag, 'N') AS rf, l_tax AS tx FROM lineitem JOIN part ON l_partkey = p_partkey),
rx AS (SELECT *, coalesce(a, b) AS s, greatest(coalesce(b, a), coalesce(a, b)) AS e,
         6 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (rf IS NOT NULL)::INT AS filled FROM rx0),
f AS (SELECT *, max(e) OVER (PARTITION BY sup, nm ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rx),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + INTERVAL 12 HOUR THEN 1 ELSE 0 END)
         OVER (PARTITION BY sup, nm ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS isl FROM f)"""


def prescriptions(t):
    return t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(
        c("l_suppkey").alias("sup"), c("p_name").alias("nm"), t.line_id().alias("id"),
        F.when(c("l_linenumber") != 6, c("l_shipdate")).alias("a"),
        F.when(c("l_linenumber") != 7, c("l_shipdate") + F.make_dt_interval(c("l_quantity").cast("int"))).alias("b"),
        F.nullif("l_returnflag", F.lit("N")).alias("rf"), c("l_tax").alias("tx"))


@query("win_collapse_intervals", "sup:l nm:s a:s b:s n:l id:s rf:s segs:s", f"""
WITH {RX} SELECT sup, nm, min(s) AS a, max(e) AS b, count(*) AS n, arg_min(id, (-filled, s, e, id)) AS id,
  arg_min(coalesce(rf, '?'), (-filled, s, e, id)) AS rf,
  to_json(list(struct_pack(a := strftime(g.a, '%Y-%m-%d %H:%M:%S'), b := strftime(g.b, '%Y-%m-%d %H:%M:%S'), id := g.id, rf := g.rf) ORDER BY s, e, id)) AS segs
  FROM g GROUP BY sup, nm, isl""")
def win_collapse_intervals(t):
    out = collapse_intervals(prescriptions(t), ["sup", "nm"], "a", "b", ["id", "rf"], ["id"], segments=["a", "b", "id", "rf"])
    return out.select("sup", "nm", "a", "b", c("prescription_segment_count").alias("n"), "id",
                      F.coalesce("rf", F.lit("?")).alias("rf"), c("prescription_segments_json").alias("segs"))


@query("win_episode_segments", "sup:l nm:s id:s episode_start:s", f"""
WITH {RX} SELECT sup, nm, id, min(s) OVER (PARTITION BY sup, nm, isl) AS episode_start FROM g""")
def win_episode_segments(t):
    return episode_segments(prescriptions(t), ["sup", "nm"], "a", "b")


@query("win_representative", "subject_id:l med:s event_id:s kind:s", f"""
WITH {EV}, {ACT} SELECT subject_id, med, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, med ORDER BY act DESC,
  CASE kind WHEN 'hospital_order' THEN 4 WHEN 'home_medrecon' THEN 3 WHEN 'hospital_admin' THEN 2 ELSE 1 END DESC,
  starttime DESC, enriched DESC, event_id) AS rn FROM act) WHERE rn = 1""")
def win_representative(t):
    return status_rows(t, "medication_event_type").select(
        "subject_id", c("medication_standardized").alias("med"), c("medication_event_id").alias("event_id"),
        c("medication_event_type").alias("kind"))


@query("win_latest_version", "conv_id:l turn:l role:s version_count:l", """
SELECT conv_id, max(turn) AS turn, arg_max(role, (turn, length(text), role)) AS role, count(*) AS version_count FROM conversations GROUP BY 1""")
def win_latest_version(t):
    log = t.conversations.withColumn("size", F.length("text"))
    return reviews.latest_version(log, ["conv_id"], "turn", "size", "role")


@query("win_asof_summary", "event_id:l n:l v_first:d v_last:d v_min:d v_max:d v_mean:d v_delta:d v_trend_direction:s f_time:s l_time:s", f"""
WITH {SNAP}, o AS (SELECT user_id, ts, value FROM events WHERE event_type <> 'purchase'),
g AS (SELECT event_id, count(value) AS n, arg_min(value, ts) AS v_first, arg_max(value, ts) AS v_last, min(value) AS v_min, max(value) AS v_max,
  {decsum("value")} / nullif(count(value), 0) AS v_mean, min(ts) AS f_time, max(ts) AS l_time
  FROM snap LEFT JOIN o ON snap.user_id = o.user_id AND ts <= rev GROUP BY 1)
SELECT *, round(v_last - v_first, 3) AS v_delta, {TREND_SQL.format("round(v_last - v_first, 3)")} AS v_trend_direction FROM g""")
def win_asof_summary(t):
    obs = t.events.where(c("event_type") != "purchase").select("user_id", "ts", "value")
    out = asof.asof_summary(_snapshots(t), obs, ["user_id"], "rev", "ts", "value", "v", digits=None)
    return out.withColumnsRenamed({"v_observation_count": "n", "v_first_time": "f_time", "v_latest_time": "l_time"})


@query("win_prior_counts", "o_orderkey:l prior_count:l prior_365d_count:l prior_latest_time:s", """
SELECT a.o_orderkey, count(b.o_orderkey) AS prior_count, count(b.o_orderkey) FILTER (b.o_orderdate >= a.o_orderdate - INTERVAL 365 DAY) AS prior_365d_count,
  max(b.o_orderdate) AS prior_latest_time
FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY 1""")
def win_prior_counts(t):
    o = t.orders.select("o_orderkey", "o_custkey", c("o_orderdate").alias("at"))
    e = t.orders.select("o_custkey", c("o_orderdate").alias("d"))
    return asof.prior_counts(o, e, ["o_custkey"], "at", "d")


@query("win_cummax_asof", "o_orderkey:l prior_f:i prior_u:i prior_window_end:s", """
SELECT a.o_orderkey, coalesce(max((b.o_orderstatus = 'F')::INT), 0) AS prior_f, coalesce(max((b.o_orderpriority = '1-URGENT')::INT), 0) AS prior_u,
  max(b.o_orderdate) AS prior_window_end FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY 1""")
def win_cummax_asof(t):
    o = t.orders.select("o_orderkey", "o_custkey", c("o_orderdate").alias("at"))
    rows = t.orders.select("o_custkey", c("o_orderdate").alias("d"), (c("o_orderstatus") == "F").cast("int").alias("f"),
                           (c("o_orderpriority") == "1-URGENT").cast("int").alias("u"))
    return asof.flags_asof(o, rows, ["o_custkey"], "at", "d", ["f", "u"])


@query("win_guarded_flags", "o_orderkey:l r:i a:i fin:s context_available_flag:i", """
WITH f AS (SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS r, max((l_returnflag = 'A')::INT) AS a, max(l_shipdate) AS fin FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN fin <= rev THEN r ELSE 0 END AS r, CASE WHEN fin <= rev THEN a ELSE 0 END AS a, CASE WHEN fin <= rev THEN fin END AS fin,
  coalesce(fin <= rev, false)::INT AS context_available_flag
FROM (SELECT o_orderkey, o_orderdate + INTERVAL 400 DAY AS rev FROM orders) LEFT JOIN f ON o_orderkey = l_orderkey""")
def win_guarded_flags(t):
    base = t.orders.select("o_orderkey", (c("o_orderdate") + F.make_dt_interval(F.lit(400))).alias("rev"))
    f = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(
        F.max((c("l_returnflag") == "R").cast("int")).alias("r"), F.max((c("l_returnflag") == "A").cast("int")).alias("a"),
        F.max("l_shipdate").alias("fin"))
    return asof.guarded_flags(base, f, ["o_orderkey"], "fin", "rev", ["r", "a"])


# Review queue: orders are the universe, a part of them has a review.
QUEUE = """u AS (
  SELECT o_orderkey AS k, o_custkey AS subject, o_orderdate AS ts, o_orderpriority AS cls, o_orderstatus AS enc,
    CASE WHEN o_totalprice < 100000 THEN NULL WHEN o_totalprice < 200000 THEN 'low' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'high' END AS lvl,
    (o_totalprice >= 100000)::INT AS avail, CASE o_orderkey % 3 WHEN 0 THEN 'action_undetermined' ELSE 'x' END AS act,
    (o_orderkey % 5 > 0)::INT AS elig, (o_orderpriority < '3')::INT AS sup,
    CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 6 < 3 THEN 'low' ELSE 'high' END END AS given FROM orders),
cc AS (SELECT cls, count(*) AS n, count(given) AS r FROM u GROUP BY 1), sc AS (SELECT subject, count(*) AS n, count(given) AS r FROM u GROUP BY 1),
ec AS (SELECT enc, count(*) AS n, count(given) AS r FROM u GROUP BY 1),
p AS (SELECT u.*, cc.n AS cn, cc.r AS cr, sc.n AS sn, sc.r AS sr, ec.n AS en, ec.r AS er, (given IS NOT NULL)::INT AS rev,
    coalesce(given <> lvl, false)::INT AS dis, CASE lvl WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END AS rk
  FROM u JOIN cc ON u.cls = cc.cls JOIN sc ON u.subject = sc.subject JOIN ec ON u.enc = ec.enc),
q AS (SELECT *, (1 - rev) * 1000 + dis * 200 + 40 * rk + (1 - avail) * 60 + (act = 'action_undetermined')::INT * 30 + (1 - elig) * 20 + (cr = 0)::INT * 45
    + (sr = 0)::INT * 25 + (er = 0)::INT * 15 + sup * 10 AS score FROM p),
w AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, rk DESC, cr = 0 DESC, sr = 0 DESC, er = 0 DESC, cn, subject, enc, k, ts DESC) AS r1,
    row_number() OVER (PARTITION BY cls ORDER BY score DESC, rk DESC, cr = 0 DESC, sr = 0 DESC, er = 0 DESC, cn, subject, enc, k, ts DESC) AS r2 FROM q),
qq AS (SELECT *, row_number() OVER (ORDER BY rev, score DESC, r1, r2, cr, sr, cn, subject, enc, k, ts DESC) AS r3,
    CASE WHEN rev = 1 AND dis = 1 THEN 'reviewed_disagreement_followup' WHEN rev = 1 THEN 'reviewed_backlog' WHEN dis = 1 THEN 'disagreement_candidate'
      WHEN rk >= 2 THEN 'high_signal_unreviewed' WHEN cr = 0 OR sr = 0 THEN 'coverage_expansion_unreviewed' ELSE 'review_backlog' END AS band FROM w)"""


def review_queue(t):
    o = t.orders
    price = c("o_totalprice")
    level = F.when(price < 100000, F.lit(None)).when(price < 200000, "low").when(price < 300000, "medium").otherwise("high")
    universe = o.select(
        c("o_orderkey").alias("k"), c("o_custkey").alias("subject"), c("o_orderdate").alias("ts"), c("o_orderpriority").alias("cls"),
        c("o_orderstatus").alias("enc"), level.alias("benchmark__current_rule_score_level"),
        (price >= 100000).cast("int").alias("benchmark__current_rule_available_flag"),
        F.when(c("o_orderkey") % 3 == 0, "action_undetermined").otherwise("x").alias("label__primary_action_label"),
        (c("o_orderkey") % 5 > 0).cast("int").alias("meta__dataset_row_eligible_for_training_flag"),
        (c("o_orderpriority") < "3").cast("int").alias("first_scope_supported_class_flag"))
    latest = o.where((c("o_custkey") % 4 == 0) & (c("o_orderkey") % 2 == 0)).select(
        c("o_orderkey").alias("k"), c("o_orderkey").alias("review_submission_id"),
        F.when(c("o_orderkey") % 6 < 3, "low").otherwise("high").alias("label__clinician_priority_level"),
        F.when(c("o_orderkey") % 10 == 0, "uncertain").otherwise("reviewed").alias("label__clinician_review_status"))
    names = {"subject": "subject", "encounter": "enc", "medication": "k", "review_time": "ts", "class": "cls"}
    return reviews.build_queue(universe, latest, ["k"], names)


@query("win_review_queue", "k:l score:l band:s cn:l cr:l sn:l sr:l r1:l r2:l r3:l reasons:i", f"""
WITH {QUEUE} SELECT k, score, band, cn, cr, sn, sr, r1, r2, r3, 1 + dis + (rk > 0)::INT + (1 - avail) + (act = 'action_undetermined')::INT + (1 - elig)
  + (cr = 0)::INT + (sr = 0)::INT + (er = 0)::INT + sup AS reasons FROM qq""")
def win_review_queue(t):
    q = review_queue(t)
    return q.select(
        "k", c("queue_priority_score").alias("score"), c("queue_priority_band").alias("band"), c("class_reviewable_count").alias("cn"),
        c("class_reviewed_count").alias("cr"), c("subject_reviewable_count").alias("sn"), c("subject_reviewed_count").alias("sr"),
        c("queue_rank_within_subject").alias("r1"), c("queue_rank_within_medication_class").alias("r2"), c("queue_rank").alias("r3"),
        F.size("queue_priority_reasons").alias("reasons"))


@query("win_event_id", "l_suppkey:l id:s eid:s", f"""
SELECT l_suppkey, {LINE_ID} AS id, concat_ws('-', 'ev', l_suppkey, l_returnflag,
  row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, {LINE_ID}) - 1) AS eid FROM lineitem""")
def win_event_id(t):
    li = t.lineitem.select("l_suppkey", "l_returnflag", "l_shipdate", t.line_id().alias("id"))
    return ordering.event_ids(li, "ev", ["l_suppkey", "l_returnflag"], ["l_shipdate", "id"], "eid")


@query("win_dedupe", "p_name:s first_key:l last_key:l", """
SELECT p_name, arg_min(p_partkey, (p_retailprice, p_partkey)) AS first_key, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS last_key FROM part GROUP BY 1""")
def win_dedupe(t):
    p = t.part.select("p_name", "p_partkey", "p_retailprice")
    first = first_per_key(p, ["p_name"], ["p_retailprice", "p_partkey"], ["p_partkey"]).withColumnRenamed("p_partkey", "first_key")
    last = first_per_key(p, ["p_name"], ["-p_retailprice", "p_partkey"], ["p_partkey"]).withColumnRenamed("p_partkey", "last_key")
    return first.join(last, "p_name")


@query("win_interleave", "o_orderkey:l position:l", """
WITH a AS (SELECT o_orderkey, o_orderstatus AS lv, o_orderpriority AS g, o_totalprice AS s FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY lv, g ORDER BY s DESC, o_orderkey) AS turn FROM a),
d AS (SELECT *, row_number() OVER (PARTITION BY lv ORDER BY turn, s DESC, o_orderkey) AS rnd FROM b)
SELECT o_orderkey, row_number() OVER (ORDER BY rnd, CASE lv WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, s DESC, o_orderkey) AS position FROM d""")
def win_interleave(t):
    return ordering.interleaved(t.orders, "o_orderstatus", "o_orderpriority", ["-o_totalprice", "o_orderkey"], ["P", "O", "F"],
                                ["o_orderkey"])


@query("win_subject_split", "c_custkey:l c_mktsegment:s split_partition:s", """
WITH h AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42:' || c_custkey), c_custkey) AS nth FROM customer),
n AS (SELECT c_mktsegment, count(*) AS sz FROM customer GROUP BY 1),
f AS (SELECT c_mktsegment, sz, unnest([0, 1, 2]) AS i, unnest([sz * 0.7::DOUBLE, sz * 0.15::DOUBLE, sz * 0.15::DOUBLE]) AS raw FROM n),
r AS (SELECT *, floor(raw) AS w, row_number() OVER (PARTITION BY c_mktsegment ORDER BY raw - floor(raw) DESC, raw DESC, i) AS ord FROM f),
x AS (SELECT c_mktsegment, i, w + CASE WHEN ord <= sz - sum(w) OVER (PARTITION BY c_mktsegment) THEN 1 ELSE 0 END AS cnt FROM r),
k AS (SELECT c_mktsegment, sum(cnt) FILTER (i = 0) AS c0, sum(cnt) FILTER (i <= 1) AS c1 FROM x GROUP BY 1)
SELECT c_custkey, h.c_mktsegment, CASE WHEN nth <= c0 THEN 'train' WHEN nth <= c1 THEN 'validation' ELSE 'test' END AS split_partition
FROM h JOIN k ON h.c_mktsegment = k.c_mktsegment""")
def win_subject_split(t):
    people = t.customer.select("c_custkey", "c_mktsegment")
    return ordering.split_subjects(people, "c_custkey", "c_mktsegment", {"train": 0.7, "validation": 0.15, "test": 0.15}, 42)


@query("srt_nulls_last", "l_rank:l o_orderkey:l", """
SELECT row_number() OVER (ORDER BY nullif(o_orderpriority, '1-URGENT') NULLS LAST, o_totalprice DESC, o_orderkey) AS l_rank, o_orderkey FROM orders""")
def srt_nulls_last(t):
    from medgrain.operators.skew import ranked

    o = t.orders.withColumn("p", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return ordering.ordered(ranked(o, [], ["p", "-o_totalprice", "o_orderkey"], "l_rank"), ["l_rank"])


@query("srt_topk_frequency", "word:s n:l", """
SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 20""")
def srt_topk_frequency(t):
    words = t.documents.select(F.explode(F.split("text", r"\s+")).alias("word"))
    return ordering.top_frequencies(words, "word", 20)


@query("srt_top_disagreements", "o_orderkey:l dist:i margin:l", f"""
WITH {LEVELS_SQL} SELECT o_orderkey, abs(CASE a WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END - CASE b WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS dist,
  abs(sa - sb) AS margin FROM lv WHERE b IS NOT NULL AND a <> b ORDER BY dist DESC, margin NULLS LAST, o_orderkey LIMIT 10""")
def srt_top_disagreements(t):
    from medgrain.functions.scoring import level_rank

    r = level_rows(t).where(c("b").isNotNull()).select(
        "o_orderkey", (c("a") == c("b")).cast("int").alias("same"), F.abs(level_rank(c("a")) - level_rank(c("b"))).alias("dist"),
        F.abs(c("sa") - c("sb")).alias("margin"))
    return top_disagreements(r, "same", ["-dist", "margin", "o_orderkey"], 10)


@query("srt_top_up", "c_custkey:l fallback_flag:i", """
WITH s AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9900),
x AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WHERE c_acctbal <= 9900 AND c_mktsegment = 'BUILDING')
SELECT c_custkey, 0 AS fallback_flag FROM s UNION ALL SELECT c_custkey, 1 FROM x WHERE n <= 60 - (SELECT count(*) FROM s)""")
def srt_top_up(t):
    return ordering.top_up(t.customer, c("c_acctbal") > 9900, c("c_mktsegment") == "BUILDING", ["-c_acctbal", "c_custkey"], 60)


@query("set_union_sources", "source:s subject:l at:s value:d", """
SELECT 'orders' AS source, o_custkey AS subject, o_orderdate AS at, o_totalprice AS value FROM orders
UNION ALL SELECT 'lineitem', l_suppkey, l_shipdate, NULL FROM lineitem UNION ALL SELECT 'events', user_id, ts, value FROM events""")
def set_union_sources(t):
    frames = [
        t.orders.select(F.lit("orders").alias("source"), c("o_custkey").alias("subject"), c("o_orderdate").alias("at"), c("o_totalprice").alias("value")),
        t.lineitem.select(F.lit("lineitem").alias("source"), c("l_suppkey").alias("subject"), c("l_shipdate").alias("at")),
        t.events.select(F.lit("events").alias("source"), c("user_id").alias("subject"), c("ts").alias("at"), "value"),
    ]
    return ordering.union_sources(frames, {"source": "string", "subject": "bigint", "at": "timestamp_ntz", "value": "double"})


@query("set_distinct", "l_suppkey:l l_returnflag:s", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def set_distinct(t):
    return ordering.distinct_keys(t.lineitem, ["l_suppkey", "l_returnflag"])


@query("set_key_diff", "k:l side:s", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT k, 'left_only' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right_only' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def set_key_diff(t):
    o = t.orders.withColumnRenamed("o_custkey", "k")
    return ordering.key_difference(o.where(c("o_orderstatus") == "F"), o.where(c("o_orderstatus") == "O"), ["k"])


@query("set_overlap", "o_custkey:l first_part:s last_part:s", """
SELECT o_custkey, min(o_orderpriority) AS first_part, max(o_orderpriority) AS last_part FROM orders GROUP BY 1 HAVING min(o_orderpriority) <> max(o_orderpriority)""")
def set_overlap(t):
    return ordering.subject_overlap(t.orders, "o_custkey", "o_orderpriority")

"""Source, sink, quality and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from medgrain.operators import quality as dq
from medgrain.operators.joins import semi_to
from medgrain.queries.registry import EV, query
from medgrain.sources import artifacts, raw
from medgrain.sources.specs import TableSpec
from medgrain.sources.storage import scratch
from medgrain.streaming.ingest import ingest_stream
from medgrain.streaming.reviews import append_changes, latest_snapshot, latest_stream

c = F.col
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")
ORDERS = TableSpec("clinical", "orders", "hosp", True, ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), ("o_note",),
                   {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}, line_ends=False)


def _orders_csv(t) -> str:
    root = scratch(t.spark, "raw")
    artifacts.write_csv(t.orders, f"{root}/hosp/orders.csv")
    return root


@query("src_csv_scan", "o_orderkey:l o_custkey:l o_orderdate:s o_totalprice:d o_note:s o_orderstatus:s", """
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, NULL AS o_note, o_orderstatus FROM orders""")
def src_csv_scan(t):
    path = raw.locate(t.spark, ORDERS, _orders_csv(t))
    return raw.cast_columns(raw.conform(raw.scan_raw(t.spark, path), ORDERS), ORDERS)


@query("src_header_normalize", "cust_name:s cust_name__duplicate_2:s c_custkey:l", """
SELECT c_name AS cust_name, c_mktsegment AS cust_name__duplicate_2, c_custkey FROM customer""")
def src_header_normalize(t):
    return raw.normalize_columns(t.customer.select("c_name", "c_mktsegment", "c_custkey").toDF(" Cust Name", "CUST_NAME ", "C_CustKey"))


@query("src_conform", "p_partkey:l p_missing:s p_name:s p_brand:s", """
SELECT p_partkey, NULL AS p_missing, p_name, p_brand FROM part""")
def src_conform(t):
    spec = TableSpec("x", "part", "hosp", True, ("p_partkey", "p_missing"), ("p_name",))
    return raw.conform(t.part.select("p_brand", "p_name", "p_partkey"), spec)


@query("src_lenient_cast", "event_id:l value:d k:l ts:s", """
SELECT event_id, CASE WHEN event_id % 5 > 0 THEN value END AS value, CASE WHEN event_id % 3 > 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 7 > 0 THEN ts END AS ts FROM events""")
def src_lenient_cast(t):
    bad = lambda n, x, y: F.when(c("event_id") % n == 0, y).otherwise(x)
    k = F.get_json_object("props", "$.k")
    e = t.events.select(
        "event_id", bad(5, c("value").cast("string"), F.lit("n/a")).alias("value"),
        bad(3, F.concat(F.lit(" "), k, F.when(c("event_id") % 2 == 0, ".0").otherwise("")), F.concat(k, F.lit(".5"))).alias("k"),
        bad(7, c("ts").cast("string"), F.lit("yesterday")).alias("ts"))
    spec = TableSpec("x", "events", "hosp", True, ("event_id",), (), {"event_id": "bigint", "value": "double", "k": "bigint", "ts": "timestamp_ntz"})
    return raw.cast_columns(e, spec)


@query("src_lineage", "o_orderkey:l source_dataset:s source_table:s has_file:i has_size:i run_id:s", """
SELECT o_orderkey, 'clinical' AS source_dataset, 'orders' AS source_table, 1 AS has_file, 1 AS has_size, 'run-1' AS run_id FROM orders""")
def src_lineage(t):
    path = raw.locate(t.spark, ORDERS, _orders_csv(t))
    df = raw.standardize(t.spark, ORDERS, path, "run-1")
    return df.select("o_orderkey", c("_source_dataset").alias("source_dataset"), c("_source_table").alias("source_table"),
                     c("_source_file").isNotNull().cast("int").alias("has_file"), (c("_source_file_size_bytes") > 0).cast("int").alias("has_size"),
                     c("_ingestion_run_id").alias("run_id"))


@query("src_discovery", "dataset:s table:s status:s n_missing:i", """
SELECT 'clinical' AS dataset, 'orders' AS "table", 'found' AS status, 0 AS n_missing UNION ALL SELECT 'clinical', 'lineitem', 'found', 0
UNION ALL SELECT 'ed', 'absent', 'missing_optional', 0""")
def src_discovery(t):
    root = _orders_csv(t)
    artifacts.write_csv(t.lineitem, f"{root}/hosp/lineitem.csv")
    specs = [ORDERS, TableSpec("clinical", "lineitem", "hosp", True, ("l_orderkey",)), TableSpec("ed", "absent", "ed", False, ("x",))]
    return raw.discover(t.spark, specs, root).withColumn("n_missing", F.size("missing_columns"))


REQUIRED = {"orders": ("o_orderkey", "o_comment"), "lineitem": ("l_orderkey",)}


@query("src_table_manifest", "table_name:s present_flag:i row_count:l column_count:i missing_columns:s", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, 1 AS present_flag, (SELECT count(*) FROM {n}) AS row_count, "
    f"(SELECT count(*) FROM (DESCRIBE {n})) AS column_count, '{'o_comment' if n == 'orders' else ''}' AS missing_columns" for n in TABLES))
def src_table_manifest(t):
    return artifacts.table_manifest({n: getattr(t, n) for n in TABLES}, REQUIRED)


@query("src_incremental_plan", "table:s action:s", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", CASE WHEN (SELECT count(*) FROM {n}) % 3 = 0 THEN 'ingest' ELSE 'skipped_incremental' END AS action" for n in TABLES))
def src_incremental_plan(t):
    m = artifacts.table_manifest({n: getattr(t, n) for n in TABLES}, {}).select(
        F.lit("d").alias("dataset"), c("table_name").alias("table"), c("row_count").cast("string").alias("signature"), "row_count")
    moved = F.when(c("row_count") % 3 == 0, F.lit("old")).otherwise(c("signature"))
    at = F.lit("2024-01-02").cast("timestamp")
    last = m.select("dataset", "table", moved.alias("signature"), at.alias("started_at"), F.lit("b").alias("run_id"), F.lit("p").alias("output_path"))
    older = last.withColumn("signature", F.lit("older")).withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))
    return artifacts.plan_incremental(m, last.unionByName(older))


@query("src_parquet_roundtrip", "l_returnflag:s n:l q:d", """
SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) AS q FROM lineitem GROUP BY 1""")
def src_parquet_roundtrip(t):
    path = scratch(t.spark, "artifact")
    artifacts.write_artifact(t.lineitem, path)
    back = artifacts.read_artifact(t.spark, path, ["l_returnflag", "l_quantity"])
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(c("l_quantity").cast("decimal(28,6)")).cast("double").alias("q"))


@query("src_projected_scan", "l_orderkey:l l_quantity:d", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def src_projected_scan(t):
    return artifacts.read_artifact(t.spark, f"{t.dir}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where(c("l_quantity") > 45)


@query("src_membership_scan", "l_orderkey:l l_partkey:l l_suppkey:l", """
SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')""")
def src_membership_scan(t):
    keys = t.orders.where(c("o_orderpriority") == "2-HIGH").select(c("o_orderkey").alias("l_orderkey"))
    return semi_to(t.lineitem, keys, ["l_orderkey"])


LOG_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _log(t, parts: int = 1) -> str:
    path = scratch(t.spark, "log")
    for even in (0, 1):
        half = t.conversations.where(c("turn") % 2 == even)
        artifacts.append_events(half.repartition(parts) if parts > 1 else half, path)
    return path


@query("src_jsonl_log", "conv_id:l turn:l role:s text:s", "SELECT conv_id, turn, role, text FROM conversations")
def src_jsonl_log(t):
    return artifacts.read_events(t.spark, _log(t), LOG_SCHEMA)


@query("str_file_ingest", "o_orderstatus:s n:l price:d", """
SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS price FROM orders GROUP BY 1""")
def str_file_ingest(t):
    source = f"{_orders_csv(t)}/hosp/orders.csv"
    rows = ingest_stream(t.spark, ORDERS, source, scratch(t.spark, "stream"), scratch(t.spark, "state"), "run-1")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(c("o_totalprice").cast("decimal(28,6)")).cast("double").alias("price"))


@query("str_latest_snapshot", "conv_id:l turn:l role:s text:s", """
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def str_latest_snapshot(t):
    log = t.spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 2).json(_log(t, 2))
    out, state = scratch(t.spark, "latest"), scratch(t.spark, "state")
    latest_stream(log.where(c("conv_id") % 3 > 0), ["conv_id"], ["turn"], out, state, compact_after=2)
    # A later stream over the same log: its changes lie over the compacted snapshot.
    append_changes(log.where(c("conv_id") % 3 == 0), ["conv_id"], ["turn"], out, scratch(t.spark, "state"), first_batch=1000)
    return latest_snapshot(t.spark, out, ["conv_id"])


@query("dq_expectations", "rule:s violations:l", """
WITH o AS (SELECT *, nullif(o_orderpriority, '5-LOW') AS p, CASE WHEN o_custkey % 9 = 0 THEN '{bad' ELSE '{"a":1}' END AS j, o_custkey % 3 AS f, CASE WHEN o_custkey % 3 < 2 THEN o_custkey % 3 END AS nf,
  o_orderdate + to_days(CAST(o_custkey % 5 - 3 AS INTEGER)) AS e FROM orders)
SELECT 'required:o_orderkey,o_missing' AS rule, 1 AS violations UNION ALL SELECT 'not_null:p', count(*) FILTER (p IS NULL) FROM o
UNION ALL SELECT 'allowed:o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM o UNION ALL SELECT 'json:j', count(*) FILTER (o_custkey % 9 = 0) FROM o
UNION ALL SELECT 'flag:f', count(*) FILTER (f > 1) FROM o UNION ALL SELECT 'nullable_flag:nf', 0 UNION ALL SELECT 'not_after:o_orderdate<=e', count(*) FILTER (o_orderdate > e) FROM o
UNION ALL SELECT 'equals:o_orderstatus', count(*) FILTER (o_orderstatus <> 'F') FROM o UNION ALL SELECT 'unique:o_orderkey', 0
UNION ALL SELECT 'unique:o_custkey,o_orderstatus', (SELECT sum(n) FROM (SELECT count(*) AS n FROM o GROUP BY o_custkey, o_orderstatus) WHERE n > 1)""")
def dq_expectations(t):
    k = c("o_custkey")
    o = t.orders.select(
        "*", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"), F.when(k % 9 == 0, "{bad").otherwise('{"a":1}').alias("j"), (k % 3).alias("f"),
        F.when(k % 3 < 2, k % 3).alias("nf"), (c("o_orderdate") + F.make_dt_interval((k % 5 - 3).cast("int"))).alias("e"))
    return dq.expect(o, [
        dq.required("o_orderkey", "o_missing"), dq.not_null("p"), dq.allowed("o_orderstatus", ["F", "O"]), dq.valid_json("j"), dq.flag("f"),
        dq.flag("nf", nullable=True), dq.not_after("o_orderdate", "e"), dq.equals("o_orderstatus", "F"), dq.unique("o_orderkey"),
        dq.unique("o_custkey", "o_orderstatus")])


@query("dq_contract_orders", "rule:s violations:l", """
SELECT 'required:subject_id,encounter_id,encounter_source,source_tables_json,linked_ed_stay_flag' AS rule, 0 AS violations
UNION ALL SELECT 'not_null:subject_id', 0 UNION ALL SELECT 'not_null:encounter_id', count(*) FILTER (o_custkey % 11 = 0) FROM orders
UNION ALL SELECT 'not_null:encounter_source', count(*) FILTER (o_orderpriority = '5-LOW') FROM orders
UNION ALL SELECT 'unique:encounter_id', count(*) FILTER (o_custkey % 11 = 0) FROM orders
UNION ALL SELECT 'allowed:encounter_source', count(*) FILTER (o_orderpriority LIKE '4%') FROM orders
UNION ALL SELECT 'json:source_tables_json', 0 UNION ALL SELECT 'flag:linked_ed_stay_flag', count(*) FILTER (o_custkey % 4 > 1) FROM orders""")
def dq_contract_orders(t):
    from medgrain.sources.contracts import CONTRACTS

    kind = c("o_orderpriority").substr(1, 1)
    source = (F.when(kind == "1", "ed_only").when(kind == "2", "ed_to_inpatient").when(kind == "3", "hospital_only").when(kind == "4", "other"))
    enc = t.orders.select(
        c("o_custkey").alias("subject_id"), F.when(c("o_custkey") % 11 > 0, F.concat(F.lit("hadm:"), c("o_orderkey").cast("string"))).alias("encounter_id"),
        source.alias("encounter_source"), F.lit('["orders"]').alias("source_tables_json"), (c("o_custkey") % 4).alias("linked_ed_stay_flag"))
    wanted = ["subject_id", "encounter_id", "encounter_source", "source_tables_json", "linked_ed_stay_flag"]
    return dq.expect(enc, CONTRACTS["encounter_index"].rules(wanted))


@query("dq_leakage", "window_column:s row_count:l window_count:l after_review_count:l", f"""
WITH {EV}, x AS (SELECT *, admittime + INTERVAL 10 DAY AS rev FROM ev)
SELECT 'starttime' AS window_column, count(*) AS row_count, count(starttime) AS window_count, count(*) FILTER (starttime > rev) AS after_review_count FROM x
UNION ALL SELECT 'stoptime', count(*), count(stoptime), count(*) FILTER (stoptime > rev) FROM x""")
def dq_leakage(t):
    e = t.med_events().withColumn("rev", c("admittime") + F.make_dt_interval(F.lit(10)))
    return dq.leakage_audit(e, "rev", ["starttime", "stoptime"])


@query("dq_registry_coverage", "feature:s family:s feature_present:i provenance_present:i row_count:l null_count:l provenance_mismatch_count:l", f"""
WITH {EV}, x AS (SELECT *, CASE WHEN route IS NULL THEN 'unavailable' ELSE 'orders' END AS route_p, CASE WHEN enriched = 1 THEN 'orders' ELSE 'unavailable' END AS stop_p FROM ev)
SELECT 'route' AS feature, 'orders' AS family, 1 AS feature_present, 1 AS provenance_present, count(*) AS row_count, count(*) FILTER (route IS NULL) AS null_count, 0 AS provenance_mismatch_count FROM x
UNION ALL SELECT 'stoptime', 'time', 1, 1, count(*), count(*) FILTER (stoptime IS NULL), count(*) FILTER ((stoptime IS NOT NULL) <> (stop_p <> 'unavailable')) FROM x
UNION ALL SELECT 'absent', 'none', 0, 0, count(*), count(*), 0 FROM x""")
def dq_registry_coverage(t):
    e = t.med_events().select(
        "*", F.when(c("route").isNull(), "unavailable").otherwise("orders").alias("route_p"),
        F.when(c("enriched") == 1, "orders").otherwise("unavailable").alias("stop_p"))
    registry = t.spark.createDataFrame([("route", "orders"), ("stoptime", "time"), ("absent", "none")], "feature string, family string")
    return dq.registry_coverage(e, registry, [("route", "route_p"), ("stoptime", "stop_p"), ("absent", "absent_p")])

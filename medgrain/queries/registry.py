"""Registry of the driver queries: a Spark plan, its column types and the equal SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medgrain.session import even_partitions

TYPES = {"l": ("bigint", "BIGINT"), "i": ("int", "INTEGER"), "s": ("string", "VARCHAR"), "d": ("double", "DOUBLE")}


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[["Tables"], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        even_partitions(spark)
        df = self.build(Tables(spark, sf_dir))
        return df.select(*[F.col(c).cast(TYPES[t][0]).alias(c) for c, t in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        casts = ", ".join(f'CAST("{c}" AS {TYPES[t][1]}) AS "{c}"' for c, t in self.columns)
        return f"SELECT {casts} FROM ({self.sql.strip()}) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register a query; ``columns`` reads ``"name:type ..."`` with types l, i, s and d."""

    def wrap(build: Callable[["Tables"], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        pairs = tuple(tuple(c.split(":")) for c in columns.split())
        REGISTRY[name] = Query(name, build, pairs, sql)
        return build

    return wrap


class Tables:
    """The driver's tables and the clinical stand-ins derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def encounters(self) -> DataFrame:
        """Orders as encounters: a 30-day stay per order, age and sex from the customer."""
        joined = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(
            F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
            F.concat(F.lit("hadm:"), F.col("o_orderkey").cast("string")).alias("encounter_id"),
            F.col("o_orderdate").alias("admittime"),
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("dischtime"),
            F.floor((F.col("c_acctbal") + 1000) / 110).cast("bigint").alias("age_proxy"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "F").otherwise("M").alias("sex"),
            F.col("o_orderpriority").alias("admission_type"), F.col("o_orderstatus").alias("ward"),
            F.col("o_totalprice").alias("price"),
        )

    def med_events(self) -> DataFrame:
        """Line items as medication events of four kinds around their order's stay."""
        c = F.col
        joined = (
            self.lineitem.join(self.orders, c("l_orderkey") == c("o_orderkey"))
            .join(self.part, c("l_partkey") == c("p_partkey"))
        )
        kind = (
            F.when(c("l_returnflag") == "R", "home_medrecon")
            .when((c("l_returnflag") == "A") & (c("l_linestatus") == "O"), "hospital_admin")
            .when((c("l_returnflag") == "N") & (c("l_linestatus") == "F"), "ed_pyxis")
            .otherwise("hospital_order")
        )
        shift = ((c("l_partkey") * 7 + c("l_linenumber") * 3) % 40 - 5).cast("int")
        start = c("o_orderdate") + F.make_dt_interval(shift)
        length = (c("l_quantity").cast("int") % 15).cast("int")
        return joined.select(
            c("o_custkey").alias("subject_id"), c("l_orderkey").alias("hadm_id"),
            F.concat(F.lit("hadm:"), c("l_orderkey").cast("string")).alias("encounter_id"),
            self.line_id().alias("event_id"), kind.alias("kind"), c("p_name").alias("raw_name"),
            F.lower(c("p_type")).alias("med"), c("p_brand").alias("brand"), start.alias("starttime"),
            F.when(c("l_linenumber") != 7, start + F.make_dt_interval(length)).alias("stoptime"),
            c("o_orderdate").alias("admittime"),
            (c("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("dischtime"),
            c("l_quantity").alias("dose_value"),
            F.when(c("l_linenumber") < 6, "mg").alias("dose_unit"),
            F.when(c("l_suppkey") % 3 == 0, "IV").when(c("l_suppkey") % 3 == 1, "PO").alias("route"),
            F.when(c("o_orderpriority").startswith("1"), "PRN").when(c("o_orderpriority").startswith("2"), "BID")
            .when(c("o_orderpriority").startswith("3"), "12").otherwise("see note").alias("frequency"),
            (c("l_returnflag") == "R").cast("int").alias("source_home"),
            (c("l_linenumber") % 2).cast("int").alias("enriched"),
            (c("l_suppkey") % 2).cast("int").alias("continued"),
        )

    @staticmethod
    def line_id():
        c = F.col
        return F.concat_ws(
            "-", *[c(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.date_format(c("l_shipdate"), "yyyyMMdd"),
        )

    def labs(self) -> DataFrame:
        """Line items as lab values of their order's stay."""
        c = F.col
        shift = ((c("l_partkey") * 7 + c("l_linenumber") * 3) % 40 - 5).cast("int")
        return self.lineitem.join(self.orders, c("l_orderkey") == c("o_orderkey")).select(
            c("o_custkey").alias("subject_id"), c("l_orderkey").alias("hadm_id"), (c("l_suppkey") % 4).alias("itemid"),
            (c("o_orderdate") + F.make_dt_interval(shift)).alias("charttime"),
            (c("l_quantity") / 10).alias("valuenum"), self.line_id().alias("lab_id"),
        )


# The same stand-ins in SQL.
LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"
SHIFT = "to_days(CAST((l_partkey * 7 + l_linenumber * 3) % 40 - 5 AS INTEGER))"
ENC = """enc AS (
  SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, 'hadm:' || o_orderkey AS encounter_id,
         o_orderdate AS admittime, o_orderdate + INTERVAL 30 DAY AS dischtime,
         CAST(floor((c_acctbal + 1000) / 110) AS BIGINT) AS age_proxy,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'F' ELSE 'M' END AS sex,
         o_orderpriority AS admission_type, o_orderstatus AS ward, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
EV = f"""ev0 AS (
  SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, 'hadm:' || l_orderkey AS encounter_id,
         {LINE_ID} AS event_id,
         CASE WHEN l_returnflag = 'R' THEN 'home_medrecon'
              WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'hospital_admin'
              WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'ed_pyxis' ELSE 'hospital_order' END AS kind,
         p_name AS raw_name, lower(p_type) AS med, p_brand AS brand, o_orderdate + {SHIFT} AS starttime,
         CAST(l_quantity AS INTEGER) % 15 AS len, l_linenumber, o_orderdate AS admittime,
         o_orderdate + INTERVAL 30 DAY AS dischtime, l_quantity AS dose_value,
         CASE WHEN l_linenumber < 6 THEN 'mg' END AS dose_unit,
         CASE l_suppkey % 3 WHEN 0 THEN 'IV' WHEN 1 THEN 'PO' END AS route,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'PRN' WHEN '2' THEN 'BID' WHEN '3' THEN '12'
              ELSE 'see note' END AS frequency,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS source_home,
         l_linenumber % 2 AS enriched, CAST(l_suppkey % 2 AS INTEGER) AS continued
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
ev AS (SELECT *, CASE WHEN l_linenumber <> 7 THEN starttime + to_days(len) END AS stoptime FROM ev0)"""
LABS = f"""labs AS (
  SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_suppkey % 4 AS itemid,
         o_orderdate + {SHIFT} AS charttime, l_quantity / 10 AS valuenum, {LINE_ID} AS lab_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def decsum(expr: str) -> str:
    """The exact decimal sum used on the Spark side, as a double."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(28,6))) AS DOUBLE)"

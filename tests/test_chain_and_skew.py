"""Artifact versions and contracts, hot keys, near terms, exact quantiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from medgrain.operators.asof import window_summary
from medgrain.operators.joins import exists_either
from medgrain.operators.quality import ContractError
from medgrain.operators.quantiles import exact_quantile, with_quantile
from medgrain.operators.skew import left_join_known, spread_join
from medgrain.plans.labels import action_evidence
from medgrain.plans.mapping import near_pairs
from medgrain.sources.artifacts import current_version, read_artifact, write_artifact
from medgrain.sources.contracts import ArtifactStore


@pytest.fixture
def fixed_partitions(spark):
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def tasks_of(df, test) -> int:
    return df.where(test).select(F.spark_partition_id().alias("p")).distinct().count()


def test_a_failing_write_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "a")
    assert current_version(spark, path) is None
    assert write_artifact(spark.range(5), path)[0] == 5
    bad = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        write_artifact(bad, path)

    def refuse(df):
        raise ContractError(f"{df.count()} rows")

    with pytest.raises(ContractError, match="7 rows"):
        write_artifact(spark.range(7), path, check=refuse)
    assert read_artifact(spark, path).count() == 5
    early = read_artifact(spark, path)
    write_artifact(spark.range(3), path)
    assert read_artifact(spark, path).count() == 3
    assert early.count() == 5  # a reader that began before
    for n in range(4):
        write_artifact(spark.range(n), path)
    assert len([p for p in (tmp_path / "a").iterdir() if p.name.startswith("version-")]) == 2
    assert read_artifact(spark, path).count() == 3


def test_plain_parquet_is_read_as_it_is(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "p"))
    assert read_artifact(spark, str(tmp_path / "p"), ["id"]).count() == 4
    with pytest.raises(FileNotFoundError):
        read_artifact(spark, str(tmp_path / "none"))
    assert read_artifact(spark, str(tmp_path / "none"), required=False, schema="id long").count() == 0


def test_a_store_publishes_only_what_keeps_its_contract(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path), "run-1")
    grain = "subject_id long, encounter_id string, medication_standardized string, review_timestamp timestamp_ntz"
    columns = ("hadm_id long, stay_id long, age_proxy long, age_group string, medication_class_standardized string, "
               "medication_status_at_review string, active_at_review_flag int")
    at = __import__("datetime").datetime(2020, 1, 1)
    row = (1, "hadm:1", "morphine", at, 1, None, 70, "65-74", "opioid", "active_at_review_time", 1)
    name = "encounter_medication_first_scope"
    out = store.publish(name, spark.createDataFrame([row], f"{grain}, {columns}"))
    assert "build_run_id" not in out.columns
    assert store.read(name, stamped=True).first().contract_version == f"{name}.v1"
    for broken, rule in (([row, row], "unique"), ([row[:8] + ("statin",) + row[9:]], "allowed"), ([(None, *row[1:])], "not_null")):
        with pytest.raises(ContractError, match=rule):
            store.publish(name, spark.createDataFrame(broken, f"{grain}, {columns}"))
    assert store.read(name).collect() == out.collect()


def hot(spark, n: int = 3000):
    """A third of the rows on key 0."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("k"), F.col("id").alias("t"),
        (F.col("id") * 7 % 101).alias("v"))


def test_a_hot_key_is_spread_in_window_summaries(spark, fixed_partitions):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        base = spark.range(60).select(F.col("id").alias("k"), F.lit(100).alias("a"), F.lit(2000).alias("b"))
        joined = spread_join(hot(spark), base, ["k"])
        assert tasks_of(joined, F.col("k") == 0) >= 8
        got = window_summary(base, hot(spark), "k", "a", "b", "t", {"n": F.count(F.lit(1)), "top": F.max("v")})
        want = {}
        for r in hot(spark).collect():
            if 100 < r.t <= 2000:
                n, top = want.get(r.k, (0, 0))
                want[r.k] = (n + 1, max(top, r.v))
        assert {r.k: (r.n, r.top) for r in got.collect() if r.n} == want
        assert got.count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_null_keys_are_spread_in_existence_joins(spark, fixed_partitions):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(900).select(
            "id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("x"), F.when(F.col("id") % 2 > 0, F.col("id") % 5).alias("y"))
        right = spark.createDataFrame([(1, 1), (2, 3)], "x long, y long")
        assert tasks_of(left_join_known(rows, right.select("x", F.lit(1).alias("hit")), ["x"]), F.col("x").isNull()) >= 8
        got = exists_either(rows, right, right, ["x"], ["x", "y"])
        for r in got.collect():
            assert (r.in_first, r.in_second) == (int(r.x in (1, 2)), int((r.x, r.y) in ((1, 1), (2, 3))))
        assert got.count() == 900 and got.columns == ["id", "x", "y", "in_first", "in_second"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_action_evidence_joins_once(spark):
    from datetime import datetime, timedelta

    at = datetime(2020, 1, 1)
    rows = spark.createDataFrame([("e", m, at, at + timedelta(days=9), "5", "mg", "iv", "scheduled") for m in "abc"],
                                 "encounter_id string, medication_standardized string, review_timestamp timestamp_ntz, "
                                 "discharge_boundary timestamp_ntz, dose_value string, dose_unit string, route string, scheduled_vs_prn string")
    day = timedelta(days=1)
    events = [("a", at - day, at + 2 * day), ("a", at + 3 * day, None), ("b", at - day, at + 2 * day), ("b", at + day, at + 2 * day),
              ("b", at + 10 * day, None), ("c", at - day, None)]
    ev = spark.createDataFrame([("e", m, "hospital_order", s, t, 0, "5", "mg", "iv", "BID", None) for m, s, t in events],
                               "encounter_id string, medication_standardized string, medication_event_type string, starttime timestamp_ntz, "
                               "stoptime timestamp_ntz, continued_from_home_inferred int, dose_value string, dose_unit string, route string, "
                               "frequency string, status string").withColumns(
        {"event_time": F.col("starttime"), "encounter_start": F.lit(None).cast("timestamp_ntz")})
    out = action_evidence(rows, ev)
    got = {r.medication_standardized: (r.candidate_stop, r.reappears) for r in out.collect()}
    assert got == {"a": (at + 2 * day, 1), "b": (at + 2 * day, 0), "c": (None, 0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_near_pairs_equal_all_pairs(spark, distance):
    rng = np.random.default_rng(distance)
    words = {"", "a", "ab", "abcd"} | {"".join(rng.choice(list("abc"), int(rng.integers(0, 12)))) for _ in range(60)}
    names, terms = sorted(words)[::2], sorted(words)
    got = near_pairs(spark.createDataFrame([(w,) for w in names], "n string"), "n",
                     spark.createDataFrame([(w,) for w in terms], "t string"), "t", distance)
    want = {(a, b, edit_distance(a, b)) for a in names for b in terms if edit_distance(a, b) <= distance}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("ranges, most", [(256, 100_000), (4, 3), (2, 1)])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantiles(spark, q, ranges, most):
    rng = np.random.default_rng(9)
    values = {"a": rng.normal(size=41), "b": np.round(rng.exponential(size=80), 1), "c": np.array([2.5]), None: rng.normal(size=8) * 1e6,
              "d": np.array([-1e300, 0.0, 1.0, 1e300])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("e", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.x for r in exact_quantile(df, ["k"], "v", q, "x", ranges, most).collect()}
    assert got.keys() == values.keys()
    for k, v in values.items():
        assert got[k] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12), k
    if q == 0.5:
        every = np.concatenate(list(values.values()))
        assert exact_quantile(df, [], "v", q, "x", ranges, most).first().x == pytest.approx(np.quantile(every, q), rel=1e-12)


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert exact_quantile(df, ["k"], "v", 0.5, "x").collect() == []
    one = with_quantile(df.agg(F.count("*").alias("n")), df, [], "v", 0.5, "x").first()
    assert (one.n, one.x) == (0, None)

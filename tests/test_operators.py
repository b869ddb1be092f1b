"""Operators on small literal frames, including skewed and degenerate ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from medgrain.functions import clinical, names, scoring, times
from medgrain.operators import asof, intervals, ordering, quality
from medgrain.operators.joins import checked_join, resolve_unique
from medgrain.operators.skew import first_per_key, ranked

c = F.col
TS = "timestamp_ntz"


def frame(spark, rows, schema, *stamps):
    df = spark.createDataFrame(rows, schema)
    for s in stamps:
        df = df.withColumn(s, c(s).cast(TS))
    return df


def test_touching_intervals_become_one_episode(spark):
    df = frame(spark, [
        (1, "a", "2135-01-06 00:00:00", "2135-01-08 00:00:00"), (1, "b", "2135-01-08 00:00:00", "2135-01-12 00:00:00"),
        (1, "c", "2135-01-12 06:00:00", "2135-01-16 00:00:00"), (1, "d", "2135-03-01 00:00:00", None),
    ], "k int, id string, a string, b string", "a", "b")
    out = {str(r["a"]): r for r in intervals.collapse_intervals(df, ["k"], "a", "b", ["id"], ["id"]).collect()}
    first = out["2135-01-06 00:00:00"]
    assert (str(first["b"]), first["prescription_segment_count"], first["id"]) == ("2135-01-16 00:00:00", 3, "a")
    assert str(out["2135-03-01 00:00:00"]["b"]) == "2135-03-01 00:00:00"


def test_missing_stop_continues_into_next_segment(spark):
    df = frame(spark, [(1, "a", "2020-01-01 00:00:00", None), (1, "b", "2020-01-01 06:00:00", "2020-01-03 00:00:00")],
               "k int, id string, a string, b string", "a", "b")
    (row,) = intervals.collapse_intervals(df, ["k"], "a", "b", ["id"], ["id"]).collect()
    assert str(row["b"]) == "2020-01-03 00:00:00" and row["prescription_segment_count"] == 2


def test_collapse_matches_brute_force_over_bucket_edges(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        day = rng.randrange(0, 400)
        rows.append((1 if i < 200 else 2, f"r{i:03d}", day, day + rng.randrange(0, 4)))
    df = spark.createDataFrame(rows, "k int, id string, x int, y int")
    base = F.lit("2020-01-01").cast(TS)
    df = df.select("k", "id", (base + F.make_dt_interval("x")).alias("a"), (base + F.make_dt_interval("y")).alias("b"))
    got = {(r["k"], str(r["a"]), str(r["b"]), r["prescription_segment_count"])
           for r in intervals.collapse_intervals(df, ["k"], "a", "b", ["id"], ["id"], bucket_seconds=86_400 * 3).collect()}
    want = set()
    for k in (1, 2):
        mine = sorted((x, y) for kk, _, x, y in rows if kk == k)
        start, stop, n = mine[0][0], mine[0][1], 1
        for x, y in mine[1:]:
            if x <= stop:  # whole days: the 12 hour gap never bridges two days
                stop, n = max(stop, y), n + 1
            else:
                want.add((k, start, stop, n))
                start, stop, n = x, y, 1
        want.add((k, start, stop, n))
    import datetime as dt

    at = lambda d: str(dt.datetime(2020, 1, 1) + dt.timedelta(days=d))
    assert got == {(k, at(a), at(b), n) for k, a, b, n in want}


def test_peak_concurrency_counts_starts_before_stops(spark):
    df = frame(spark, [(1, "2020-01-01 00:00:00", "2020-01-02 00:00:00"), (1, "2020-01-02 00:00:00", "2020-01-03 00:00:00"),
                       (1, "2020-01-05 00:00:00", None)], "k int, a string, b string", "a", "b")
    (row,) = intervals.peak_concurrency(df, ["k"], "a", "b").collect()
    assert row["peak_concurrent_count"] == 2


def test_asof_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(5)
    obs = [(0 if rng.random() < 0.5 else rng.randrange(5), rng.randrange(2000), round(rng.random(), 2)) for _ in range(400)]
    asked = sorted({(rng.randrange(5), rng.randrange(2000)) for _ in range(80)})
    base = F.lit("2020-01-01").cast(TS)
    at = lambda x: base + F.make_dt_interval(F.lit(0), c(x))
    o = spark.createDataFrame(obs, "k int, h int, v double").withColumn("ts", at("h"))
    q = spark.createDataFrame(asked, "k int, g int").withColumn("at", at("g"))
    for strict in (False, True):
        out = asof.asof_summary(q, o, ["k"], "at", "ts", "v", "p", strict=strict, bucket_seconds=86_400).collect()
        for r in out:
            seen = [(h, v) for k, h, v in obs if k == r["k"] and (h < r["g"] or (h == r["g"] and not strict))]
            assert r["p_observation_count"] == len(seen)
            assert r["p_max"] == (max(v for _, v in seen) if seen else None)
            assert r["p_last"] == (max(seen)[1] if seen else None)


def test_ranked_numbers_a_single_huge_group(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.xxhash64("id").alias("h"), "id")
    out = ranked(df.repartition(8), ["k"], ["h", "id"], "n").select("h", "n").orderBy("h").collect()
    assert [r["n"] for r in out] == list(range(1, 5001))


def test_first_per_key_orders_nulls_last_and_descending(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (1, 9, "c"), (2, None, "d")], "k int, v int, id string")
    out = {r["k"]: r["id"] for r in first_per_key(df, ["k"], ["-v", "id"]).collect()}
    assert out == {1: "c", 2: "d"}


def test_checked_join_refuses_duplicate_right_keys(spark):
    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        checked_join(left, right, ["k"]).collect()


def test_resolution_needs_one_grain_key(spark):
    rows = spark.createDataFrame([(1, "e", "n1"), (2, "e", "n2")], "id int, enc string, nm string")
    uni = spark.createDataFrame([("e", "n1", 10), ("e", "n2", 20), ("e", "n2", 21)], "enc string, un string, g int")
    out = {r["id"]: (r["resolved_key"], r["resolution_method"])
           for r in resolve_unique(rows, uni, "id", ["enc"], "g", [("name", "nm", "un")]).collect()}
    assert out == {1: (10, "name"), 2: (None, "unresolved")}


def test_split_keeps_largest_remainder_counts(spark):
    people = spark.range(101).select(c("id").alias("s"), F.when(c("id") < 7, "a").otherwise("b").alias("g"))
    parts = ordering.split_subjects(people, "s", "g", {"train": 0.7, "validation": 0.15, "test": 0.15}, 1)
    counts = {(r["g"], r["split_partition"]): r["count"] for r in parts.groupBy("g", "split_partition").count().collect()}
    assert counts == {("a", "train"): 5, ("a", "validation"): 1, ("a", "test"): 1,
                      ("b", "train"): 66, ("b", "validation"): 14, ("b", "test"): 14}


def test_names_and_point_events(spark):
    df = spark.createDataFrame([("**Metoprolol XL 25 mg Tab",), (" ___ ",), ("0",)], "n string")
    assert [r[0] for r in df.select(names.normalize_name(c("n"))).collect()] == ["metoprolol xl 25", None, None]
    e = frame(spark, [("ed_pyxis", "2020-01-01 00:00:00", None), ("hospital_order", "2019-01-01 00:00:00", None),
                      ("home_medrecon", "2019-01-01 00:00:00", None)], "k string, a string, b string", "a", "b")
    at = F.lit("2020-01-01 00:00:00").cast(TS)
    got = [r[0] for r in e.select(times.active_event(c("k"), c("a"), c("b"), at, F.lit(0))).collect()]
    assert got == [True, True, False]


def test_renal_estimate_and_levels(spark):
    one = spark.range(1)
    value = one.select(clinical.egfr(F.lit(70), F.lit("F"), F.lit(1.2))).head()[0]
    assert value == pytest.approx(142 * (1.2 / 0.7) ** -1.2 * 0.9938**70 * 1.012, abs=1e-3)
    levels = one.select(*[scoring.to_level(F.lit(x)) for x in (0.0, 3.9, 4.0, 6.9, 7.0, 10.0)]).head()
    assert list(levels) == ["low", "low", "medium", "medium", "high", "high"]
    with pytest.raises(Exception, match="between|within"):
        one.select(scoring.to_level(F.lit(11.0))).collect()


def test_expectations_raise_together(spark):
    df = spark.createDataFrame([(1, None), (1, "x")], "k int, v string")
    with pytest.raises(quality.ContractError, match=r"not_null:v.*unique:k"):
        quality.enforce(df, [quality.not_null("v"), quality.unique("k")], "frame")

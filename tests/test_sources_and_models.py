"""CSV in splits, the compacted snapshot, narrow ranks, evidence, JSON unions, the fitted preparation."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from medgrain.functions.scoring import Rule, rule_score
from medgrain.operators.aggregates import json_set_union
from medgrain.operators.ordering import interleaved
from medgrain.operators.skew import ranked, ranked_together
from medgrain.plans import models
from medgrain.sources.raw import scan_raw, standardize
from medgrain.sources.specs import TableSpec
from medgrain.streaming.reviews import append_changes, compact, latest_snapshot, waiting


def test_a_table_without_line_ends_is_read_in_splits(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,text\n" + "".join(f'{i},"a, ""quoted"" text {i}"\n' for i in range(20_000)))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        df = scan_raw(spark, str(path), line_ends=False)
        assert df.rdd.getNumPartitions() > 5
        assert df.count() == 20_000 and df.where("text = 'a, \"quoted\" text 77'").count() == 1
        assert scan_raw(spark, str(path)).drop("_metadata").exceptAll(df.drop("_metadata")).count() == 0
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("lines", ['1,"two\nlines"\n2,b\n', '1,a\n2,"x\ny\nz"\n', '"1\n",b\n2,c\n'])
def test_a_line_end_in_a_split_table_fails(spark, tmp_path, lines):
    path = tmp_path / "t.csv"
    path.write_text("id,text\n" + lines)
    assert scan_raw(spark, str(path)).count() == 2
    with pytest.raises(Exception, match="line_ends"):
        scan_raw(spark, str(path), line_ends=False).collect()
    spec = TableSpec("d", "t", "s", True, ("id", "text"), line_ends=False)
    with pytest.raises(Exception, match="line_ends"):
        standardize(spark, spec, str(path), "run").select("id").collect()


def test_short_rows_of_a_split_table_stay(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2,3\n4,5\n")
    rows = scan_raw(spark, str(tmp_path / "t.csv"), line_ends=False).drop("_metadata").collect()
    assert sorted(map(tuple, rows)) == [("1", "2", "3"), ("4", "5", None)]


def test_snapshot_is_compacted_and_not_grouped_again(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    want = {}
    for n in range(6):
        rows = [(k, n, f"{k}-{n}") for k in range(20) if (k + n) % 3 == 0] + [(None, n, f"none-{n}")]
        want.update({k: (v, t) for k, v, t in rows})
        spark.createDataFrame(rows, "k long, v long, t string").coalesce(1).write.mode("append").json(log)
        append_changes(spark.readStream.schema("k long, v long, t string").json(log), ["k"], ["v"], out, str(tmp_path / "state"))
        assert {r.k: (r.v, r.t) for r in latest_snapshot(spark, out, ["k"]).collect()} == want
        if n in (2, 4):
            assert waiting(spark, out)
            compact(spark, out, ["k"], buckets=4)
            assert waiting(spark, out) == []
            got = latest_snapshot(spark, out, ["k"])
            assert {r.k: (r.v, r.t) for r in got.collect()} == want
            assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_in_one_pass_equal_ranks_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [None, "a", "b"][rng.integers(3)], int(rng.integers(5)), "payload" * 9) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, v int, wide string")
    got = ranked_together(df, ["id"], [("r1", ["g"], ["-v", "id"]), ("r2", [], ["r1", "g", "id"])])
    want = ranked(ranked(df, ["g"], ["-v", "id"], "r1"), [], ["r1", "g", "id"], "r2")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    levels = interleaved(df, "g", "v", ["id"], ["b", "a"], ["id"])
    assert sorted(r.position for r in levels.collect()) == list(range(1, df.where("g is not null").count() + 1))


def test_evidence_names_buckets_and_their_reasons(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0)], "k long, x double")
    rules = [Rule("big", "med", 2, F.col("x") > 3, "x is big", "big", ("x",)), Rule("any", "ctx", 1, F.col("x") > 0, "some x", "x")]
    out = {r.k: json.loads(r.evidence_json) for r in rule_score(
        df, rules, {"med": 4, "ctx": 3}, {"med": "M", "ctx": "C"}, labels={"med": "Medication"}).collect()}
    assert out[1] == {"x": 5.0, "bucket_labels": {"ctx": "ctx", "med": "Medication"}, "bucket_reasons": {"ctx": ["some x"], "med": ["x is big"]}}
    assert out[2] == {"bucket_labels": {"ctx": "ctx", "med": "Medication"}, "bucket_reasons": {"ctx": ["some x"], "med": []}}


def test_json_unions(spark):
    df = spark.createDataFrame([(1, '["b","a"]'), (1, '["b"]'), (1, "bad"), (2, None), (2, "[]")], "k long, j string")
    assert {r.k: r.u for r in json_set_union(df, ["k"], "j", "u").collect()} == {1: ["a", "b"], 2: []}
    assert {r.k: r.u for r in json_set_union(df, ["k"], "j", "u", ["a"]).collect()} == {1: ["a"], 2: []}


def test_preparation_learns_from_the_training_rows_alone(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, None), (None, "b"), (10.0, "a")], "x double, s string")
    prep = models.fit_preparation(train, ["x", "s"])
    assert prep.medians == {"x": 2.0}
    other = spark.createDataFrame([(None, "a"), (99.0, "new"), (5.0, None)], "x double, s string")
    vectors = [list(r.features_vec.toArray()) for r in models.prepare(other, prep).collect()]
    assert [v[0] for v in vectors] == [2.0, 99.0, 5.0]
    assert len({tuple(v[1:]) for v in vectors}) == 3 and all(sum(v[1:]) <= 1 for v in vectors)
    report = {(r.check, r.feature): r.value for r in models.preparation_report(train, prep).collect()}
    assert report["median", "x"] == 2.0 and report["entries", "s"] == 4.0

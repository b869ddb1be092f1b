"""A test for each mended finding of the fourth round."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from medgrain.operators import skew
from medgrain.operators.intervals import collapse_intervals
from medgrain.plans import encounters, events, labels
from medgrain.queries import REGISTRY, clinic, jobs
from medgrain.queries.registry import Tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("heavy", [False, True])
def test_f13_episodes_list_their_segments(spark, monkeypatch, heavy):
    if heavy:
        monkeypatch.setattr(skew, "HEAVY_LEAST", 1)
        monkeypatch.setattr(skew, "HEAVY_SHARE", 4)
    rows = [(1, "2020-01-03", "2020-01-04", 3, None), (1, "2020-01-01", "2020-01-03", 1, "x"), (1, None, "2020-01-02", 2, "y"),
            (1, "2020-02-01", None, 4, None), (1, None, None, 5, "z"), (None, "2020-01-01", "2020-01-02", 6, "w")]
    df = spark.createDataFrame(rows, "k int, a string, b string, id int, v string").withColumns(
        {n: F.col(n).cast("timestamp_ntz") for n in ("a", "b")})
    out = collapse_intervals(df, ["k"], "a", "b", ["id"], ["id"], segments=["v", "id", "a", "b"]).collect()
    found = sorted(((r.k or 0, r.prescription_segment_count, json.loads(r.prescription_segments_json)) for r in out), key=str)
    assert [(k, n, [(s["id"], s["v"], s["a"], s["b"]) for s in segments]) for k, n, segments in found] == [
        (0, 1, [(6, "w", "2020-01-01 00:00:00", "2020-01-02 00:00:00")]),
        (1, 1, [(4, None, "2020-02-01 00:00:00", None)]),
        (1, 1, [(5, "z", None, None)]),
        (1, 3, [(1, "x", "2020-01-01 00:00:00", "2020-01-03 00:00:00"), (2, "y", None, "2020-01-02 00:00:00"),
                (3, None, "2020-01-03 00:00:00", "2020-01-04 00:00:00")])]
    assert out[0].prescription_segments_json.startswith('[{"a":')


def reads(df, table: str) -> bool:
    return any(f"/{table}.parquet" in f for f in df.inputFiles())


def test_f5_dataset_frames_are_cut_once(spark):
    assert not reads(REGISTRY["job_dataset"].run(spark, SF), "lineitem")


@pytest.mark.parametrize("name, table", [("job_review_queue", "orders"), ("job_blind_slice", "orders"), ("job_scores", "part")])
def test_f9_f10_f12_shared_rows_are_cut_once(spark, name, table):
    assert not reads(REGISTRY[name].run(spark, SF), table)


def test_f3_a_state_of_some_columns_has_the_same_rows(spark):
    t = Tables(spark, SF)
    some = jobs.state_of(t, ["subject_id", "review_timestamp", "medication_event_type"])
    every = jobs.state_of(t)
    assert {"subject_id", "review_timestamp", "selected_medication_event_type"} < set(some.columns) < set(every.columns)
    assert sorted(map(str, some.collect())) == sorted(map(str, every.select(*some.columns).collect()))


def test_f11_the_windows_of_the_harms_are_cut_once(spark, monkeypatch):
    seen = []
    found = labels.auxiliary_harms
    monkeypatch.setattr(labels, "auxiliary_harms", lambda windows, *rest: seen.append(windows) or found(windows, *rest))
    REGISTRY["job_labels"].run(spark, SF)
    assert all("/cut-" in f for f in seen[0].inputFiles()) and "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_f6_the_events_of_the_burden_are_read_before_the_reviews(spark):
    burden = REGISTRY["job_burden"].run(spark, SF)
    assert not reads(burden, "part")


def test_f8_feature_blocks_are_cut_one_after_the_other(spark):
    t = Tables(spark, SF)
    for out in (jobs.context_of(t), jobs.temporal_of(t)):
        assert any("/cut-" in f for f in out.inputFiles())
    assert not reads(jobs.context_of(t), "lineitem")  # creatinine and diagnoses
    temporal = jobs.temporal_of(t)._jdf.queryExecution().optimizedPlan().toString()
    assert temporal.count("Relation [l_orderkey") == 2  # triage and vital signs, no longer the labs


def test_f7_the_episodes_are_cut_before_the_other_sources(spark):
    t = Tables(spark, SF)
    index = encounters.build_encounter_index(clinic.patients(t), clinic.admissions(t), clinic.edstays(t))
    episodes = events.order_events(clinic.prescriptions(t), clinic.pharmacy(t), events.hospital_lookup(index))
    assert all("/cut-" in f for f in episodes.inputFiles())
    assert "Window" not in episodes._jdf.queryExecution().optimizedPlan().toString()

"""CSV dialect and headers, the join guard, paging past the end, ingestion run twice."""

from __future__ import annotations

import gzip

import pytest

from medgrain.functions.scoring import Rule, rule_score
from medgrain.operators.aggregates import first_reasons, reason_rows
from medgrain.operators.joins import checked_join
from medgrain.operators.ordering import page
from medgrain.sources.artifacts import ingest, read_csv, write_csv
from medgrain.sources.raw import scan_raw
from medgrain.sources.specs import TableSpec

LINES = 'Id,Free Text,n\n1,"chest ""tight"" pain, nausea",3\n2,"two\nlines",4\n3,,5\n'
WANT = [("1", 'chest "tight" pain, nausea', "3"), ("2", "two\nlines", "4"), ("3", None, "5")]


@pytest.mark.parametrize("name", ["t.csv", "t.csv.gz"])
def test_quoted_fields_and_gzip(spark, tmp_path, name):
    opened = gzip.open if name.endswith("gz") else open
    with opened(tmp_path / name, "wt") as f:
        f.write(LINES)
    df = scan_raw(spark, str(tmp_path / name)).drop("_metadata")
    assert df.columns == ["id", "free_text", "n"]
    assert sorted(map(tuple, df.collect())) == WANT


def test_files_with_another_header_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        scan_raw(spark, str(tmp_path)).collect()
    (tmp_path / "b.csv").write_text("a,b\n3,4\n")
    assert sorted(r.a for r in scan_raw(spark, str(tmp_path)).collect()) == ["1", "3"]


def test_repeated_names_are_bound_by_position(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,a,\n1,2,3\n")
    assert scan_raw(spark, str(tmp_path / "a.csv")).drop("_metadata").columns == ["a", "a__duplicate_2", ""]


def test_csv_sink_reads_back(spark, tmp_path):
    df = spark.createDataFrame(WANT, "id string, t string, n string")
    write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out"), df.schema.simpleString()[7:-1].replace(":", " ")).collect())) == WANT


@pytest.mark.parametrize("use", [
    lambda j: j.count(), lambda j: j.select("k", "a").collect(), lambda j: j.groupBy("a").count().collect(),
    lambda j: j.collect()])
def test_a_repeated_right_key_always_fails(spark, use):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string")
    right = spark.createDataFrame([(1, "p"), (1, "q")], "k long, b string")
    with pytest.raises(Exception, match="duplicate key"):
        use(checked_join(left, right, ["k"]))
    once = checked_join(left, right.where("b = 'p'"), ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "x", "p"), (2, "y", None)]


def test_a_page_past_the_end_keeps_the_total(spark):
    df = spark.range(10).withColumnRenamed("id", "v")
    assert [tuple(r) for r in page(df, {}, ["-v"], 3, 2).collect()] == [(7, 10), (6, 10), (5, 10)]
    assert [tuple(r) for r in page(df, {}, ["v"], 3, 50).collect()] == [(None, 10)]


def test_a_second_ingestion_skips_and_keeps_counts(spark, tmp_path):
    (tmp_path / "in" / "hosp").mkdir(parents=True)
    with gzip.open(tmp_path / "in" / "hosp" / "notes.csv.gz", "wt") as f:
        f.write(LINES)
    spec = TableSpec(name="notes", dataset="d", subdir="hosp", required=True, required_columns=("id",))
    first, second = [ingest(spark, [spec], str(tmp_path / "in"), str(tmp_path / "out"), r).collect()[0] for r in "ab"]
    assert (first.status, first.row_count) == ("ingested", 3)
    assert (second.status, second.row_count) == ("skipped_incremental", 3)


def test_all_reasons_of_the_top_rows(spark):
    rows = [("a", 2, 1, ["r1", "r2", "r3"]), ("a", 2, 2, ["r2", "r4", "r5", "r6"]), ("a", 1, 0, ["low"]), (None, 1, 3, ["n"])]
    df = spark.createDataFrame(rows, "k string, sc int, id int, reasons array<string>")
    want = ["r1", "r2", "r3", "r4", "r5", "r6"]
    args = (df, ["k"], "sc", "reasons", ["id"])
    assert {r.k: r.reasons for r in first_reasons(*args).collect()} == {"a": want, None: ["n"]}
    assert {r.k: r.reasons for r in first_reasons(*args, limit=2).collect()} == {"a": want[:2], None: ["n"]}
    found = sorted((r.position, r.reason) for r in reason_rows(*args).where("k = 'a'").collect())
    assert found == list(enumerate(want, 1))


def test_alert_holds_all_fragments(spark):
    df = spark.createDataFrame([(1,)], "x int")
    rules = [Rule(f"r{i}", "b", 1, df["x"] == 1, f"reason {i}", f"f{i}") for i in range(3)]
    alert = lambda **k: rule_score(df, rules, {"b": 3}, {"b": "B"}, **k).first().summary_alert
    assert (alert(), alert(fragments=2)) == ("B: f0, f1, f2.", "B: f0, f1.")

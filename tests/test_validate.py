"""Format, coverage, manifest and split-output checks."""

import pytest
from pyspark.sql import functions as F

from worthrank.operators.validate import (check_coverage, coverage_violations, file_validity,
                                          line_violations_2019, line_violations_2020, manifest_check,
                                          split_output_check)

LINES = "doc_id string, pos long, line string"


def _rules(df):
    return sorted((r["doc_id"], r["pos"], r["rule"]) for r in df.collect())


@pytest.mark.parametrize("line", ["1\t0.5", "1\t5", "1\t.5", "1\t+0.25", "1\t0.5\r", "  1\t0.5  "])
def test_2019_good_lines(spark, line):
    df = spark.createDataFrame([("d", 1, line)], LINES)
    assert line_violations_2019(df).count() == 0


@pytest.mark.parametrize("line", ["1\t-5", "1\t1.", "1\t1e-5", "0\t.1", "10000\t.1", "1 0.5", "x\t.5"])
def test_2019_bad_lines(spark, line):
    df = spark.createDataFrame([("d", 1, line)], LINES)
    assert _rules(line_violations_2019(df)) == [("d", 1, "bad_format")]


def test_2019_numbering_and_blank_lines(spark):
    rows = [("a", 1, "1\t.5"), ("a", 2, "3\t.4"), ("a", 3, "3\t.3"),
            # leading/trailing blank lines are stripped with the file; numbering starts after them
            ("b", 1, ""), ("b", 2, "1\t.9"), ("b", 3, "2\t.8"), ("b", 4, "   "),
            # a blank line inside the content is a violation
            ("c", 1, "1\t.9"), ("c", 2, ""), ("c", 3, "3\t.8"),
            # 9999 is a valid number but not at line 1
            ("e", 1, "9999\t-.1"),
            # an empty file fails like the reference (one empty line)
            ("f", 1, "")]
    df = spark.createDataFrame(rows, LINES)
    assert _rules(line_violations_2019(df)) == [("a", 2, "not_consecutive"), ("c", 2, "bad_format"),
                                                ("e", 1, "not_consecutive"), ("f", 1, "bad_format")]
    valid = {r["doc_id"]: r["valid"] for r in file_validity(df.select("doc_id").distinct(),
                                                            line_violations_2019(df)).collect()}
    assert valid == {"a": False, "b": True, "c": False, "e": False, "f": False}


def test_2020_lines(spark):
    tid = "1237160250513522688"
    rows = [("t", 1, f"covid\t{tid}\t0.5\tModel_1"),
            ("t", 2, f"covid\t{tid}\t0.5"),                  # three fields
            ("t", 3, "covid\t123\t0.5\tModel_1"),            # id too short
            ("t", 4, f"covid\t{tid}\t1e-5\tModel_1"),        # bad score
            ("t", 5, f"covid\t{tid}\t.5\tModel_1\textra")]   # five fields
    df = spark.createDataFrame(rows, LINES)
    assert _rules(line_violations_2020(df)) == [("t", 2, "field_count"), ("t", 3, "bad_format"),
                                                ("t", 4, "bad_format"), ("t", 5, "field_count")]


def test_coverage(spark):
    gold = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc_id string, line_number int")
    pred = spark.createDataFrame([("d", 1), ("d", 2), ("d", 2), ("d", 9)], "doc_id string, line_number int")
    got = sorted((r["line_number"], r["rule"]) for r in
                 coverage_violations(gold, pred, ["doc_id", "line_number"]).collect())
    assert got == [(2, "duplicate_prediction"), (3, "missing_prediction"), (9, "unknown_prediction")]
    with pytest.raises(ValueError):
        check_coverage(gold, pred, ["doc_id", "line_number"], strict=True)
    assert check_coverage(gold, gold, ["doc_id", "line_number"]).count() == 0


def test_manifest_and_split_checks(spark):
    manifest = spark.createDataFrame([(1, "g1", "p1"), (2, "g2", "p1"), (3, "g3", None)],
                                     "pos int, gold_path string, pred_path string")
    validity = spark.createDataFrame([("p1", True)], "pred_path string, valid boolean")
    r = manifest_check(manifest, validity).first()
    assert (r["n_gold"], r["n_pred"], r["n_distinct_pred"], r["valid"]) == (3, 2, 1, False)
    orig = spark.createDataFrame([(1, 3), (2, 2)], "doc_no long, n_original long")
    prod = spark.createDataFrame([(1, 3, 1), (2, 2, 2), (3, 1, 1)], "doc_no long, n_produced long, first_id long")
    ok = {r["doc_no"]: r["ok"] for r in split_output_check(orig, prod).collect()}
    assert ok == {1: True, 2: False, 3: False}
    assert F is not None


def test_repeated_files(spark):
    from worthrank.operators.validate import repeated_files

    m = spark.createDataFrame([("p1",), ("p2",), ("p1",)], "pred_path string")
    assert [(r["pred_path"], r["times"]) for r in repeated_files(m).collect()] == [("p1", 2)]

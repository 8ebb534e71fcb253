import pytest
from conftest import day
from pyspark.sql import functions as F

from spindlescope.operators import history as hs


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("serial_number", "date").collect()]


def test_spine_adds_only_days_between_a_drives_own_ends(drives):
    df = drives({"a": [(0, 0, 1), (3, 0, 4)], "b": [(10, 0, 7)]})
    got = rows(hs.daily_spine(df), "serial_number", "date", "smart_5_raw")
    assert got == [("a", day(0), 1.0), ("a", day(1), None), ("a", day(2), None), ("a", day(3), 4.0), ("b", day(10), 7.0)]


def test_interpolation_is_linear_inside_and_flat_at_the_ends(drives):
    df = drives({"a": [(0, 0, None), (1, 0, 2), (4, 1, 8), (5, 0, None)], "b": [(0, 0, 100)]})
    got = rows(hs.interpolate(df), "serial_number", "smart_5_raw", "failure", "model")
    assert [g[1] for g in got] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0, 100.0]
    assert [g[2] for g in got] == [0, 0, 0, 1, 1, 0, 0]
    assert {g[3] for g in got} == {"ST1"}


def test_half_way_labels_round_to_even(drives):
    got = rows(hs.interpolate(drives({"a": [(0, 0, 1), (2, 1, 1), (4, 0, 1)]})), "failure")
    assert [g[0] for g in got] == [0, 0, 1, 0, 0]


def test_all_null_column_stays_null(drives):
    got = rows(hs.interpolate(drives({"a": [(0, 0, None), (2, 0, None)]})), "smart_5_raw")
    assert got == [(None,)] * 3


def test_unknown_method_is_refused(drives):
    with pytest.raises(ValueError):
        hs.interpolate(drives({"a": [(0, 0, 1)]}), "cubic")


def test_exact_gap_rule_rejects_any_gap_at_tolerance_two_and_none_at_the_window_length(drives):
    df = drives({"gap": [(d, 0, d) for d in range(12) if d != 6], "whole": [(d, 0, d) for d in range(12)],
                 "short": [(d, 0, d) for d in range(3)]})
    kept, gappy, short = hs.filter_drives(df, 5, 7, 2)
    assert {r[0] for r in kept.select("serial_number").distinct().collect()} == {"whole"}
    assert [r[0] for r in gappy.collect()] == ["gap"]
    assert [r[0] for r in short.collect()] == ["short"]
    kept, gappy, _ = hs.filter_drives(df, 5, 7, 7)
    assert kept.select("serial_number").distinct().count() == 2 and gappy.count() == 0


def test_max_missing_counts_days_in_the_window(drives):
    two = [d for d in range(20) if d not in (5, 9)]
    three = [d for d in range(20) if d not in (5, 7, 9)]
    df = drives({"two": [(d, 0, 1) for d in two], "three": [(d, 0, 1) for d in three]})
    kept, gappy, _ = hs.filter_drives(df, 5, 7, 2, max_missing=2)
    assert {r[0] for r in kept.select("serial_number").distinct().collect()} == {"two"}
    assert kept.count() == len(two)
    assert [r[0] for r in gappy.collect()] == ["three"]


def test_horizon_labels_need_one_more_row_than_days_plus_window(drives):
    exact = [(d, int(d == 4), 1) for d in range(5)]
    longer = [(d, int(d == 5), 1) for d in range(6)]
    healthy = [(d, 0, 1) for d in range(6)]
    got = hs.failure_horizon_labels(drives({"a": exact, "b": longer, "c": healthy}), 2, 3)
    assert rows(got, "serial_number", "predict_val", "validate_val") == [
        ("b", 0, 0), ("b", 0, 1), ("b", 0, 1), ("b", 0, 1), ("b", 1, 1), ("b", 1, 1)] + [("c", 0, 0)] * 6


def test_failure_on_the_first_day_still_marks_the_last_rows(drives):
    got = hs.failure_horizon_labels(drives({"a": [(d, int(d == 0), 1) for d in range(4)]}), 1, 1)
    assert [r[0] for r in rows(got, "predict_val")] == [0, 0, 0, 1]


def test_fills_do_not_cross_drives(drives):
    df = drives({"a": [(0, 0, 1), (1, 0, None)], "b": [(0, 0, None), (1, 0, 5)]})
    assert [r[0] for r in rows(hs.fill_nulls(df, "ffill", ["smart_5_raw"]), "smart_5_raw")] == [1.0, 1.0, None, 5.0]
    assert [r[0] for r in rows(hs.fill_nulls(df, "bfill", ["smart_5_raw"]), "smart_5_raw")] == [1.0, None, 5.0, 5.0]


def test_interpolation_report_counts_filled_cells(drives):
    df = drives({"a": [(0, 0, 1), (3, 0, None)]})
    r = hs.interpolation_report(df).first()
    filled = hs.interpolate(df)
    left = filled.agg(*[F.count_if(F.col(c).isNull()) for c in ("capacity_bytes", "failure", "smart_5_raw")]).first()
    assert sum(left) == 0 and r["filled_cells"] == 2 + 2 + 3 and r["cells"] == 16


def test_one_shuffle_by_serial_serves_spine_rule_labels_and_fill(drives):
    df = drives({"a": [(d, 0, d) for d in range(9)]})
    chain = hs.interpolate(hs.failure_horizon_labels(hs.filter_drives(df, 2, 7, 7)[0], 1, 2))
    assert chain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

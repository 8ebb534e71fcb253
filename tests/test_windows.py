import numpy as np
import pytest
from conftest import day

from spindlescope.functions.names import prime_factors
from spindlescope.operators import scaling as sc
from spindlescope.operators import windows as wn


def thin(items, factor, tail=7):
    n = len(items)
    off = (n - 1) % factor
    return items[off:max(n - tail, 0):factor]


@pytest.mark.parametrize("n,factors", [(1, []), (2, [2]), (8, [2, 2, 2]), (6, [2, 3]), (5, [5]), (45, [3, 3, 5]), (97, [97])])
def test_prime_factors(n, factors):
    assert prime_factors(n) == factors


def test_dilated_lags():
    assert wn.dilated_lags(8) == [0, 1, 3, 7]
    assert wn.dilated_lags(6) == [0, 1, 3, 5]
    assert wn.dilated_lags(8, "literal") == [0, 1, 1, 1]
    assert wn.warmup_rows(8, "dilated") == 3 and wn.warmup_rows(8) == 7


def test_full_windows_are_chronological_and_stay_in_their_drive(drives):
    df = drives({"a": [(d, 0, d) for d in range(4)], "b": [(d, 0, 1000 + d) for d in range(3)]})
    got = wn.lag_windows(df, ["smart_5_raw"], 3).orderBy("serial_number", "date").collect()
    assert [r["features"] for r in got] == [[[0.0, 1.0, 2.0]], [[1.0, 2.0, 3.0]], [[1000.0, 1001.0, 1002.0]]]


def test_windows_keep_nulls_and_pad_on_request(drives):
    df = drives({"a": [(0, 0, 5), (1, 0, None), (2, 0, 7)]})
    assert wn.lag_windows(df, ["smart_5_raw"], 3).collect()[0]["features"] == [[5.0, None, 7.0]]
    padded = wn.lag_windows(df, ["smart_5_raw"], 3, pad="bfill").orderBy("date").collect()
    assert [r["features"][0] for r in padded] == [[5.0, 5.0, 5.0], [5.0, 5.0, None], [5.0, None, 7.0]]
    empty = wn.lag_windows(df, ["smart_5_raw"], 3, pad="null").orderBy("date").collect()
    assert empty[0]["features"] == [[None, None, 5.0]]


def test_window_label_includes_the_oldest_day_unless_excluded(spark):
    rows = [("a", day(d), int(d == 0), float(d)) for d in range(3)]
    df = spark.createDataFrame(rows, "serial_number string, date date, predict_val int, smart_5_raw double")
    assert wn.lag_windows(df, ["smart_5_raw"], 3).collect()[0]["window_label"] == 1
    assert wn.lag_windows(df, ["smart_5_raw"], 3, exclude_oldest=True).collect()[0]["window_label"] == 0


@pytest.mark.parametrize("n", [5, 7, 8, 20, 33])
@pytest.mark.parametrize("factor", [2, 3, 5])
def test_thinning_matches_slices(drives, n, factor):
    got = wn.thin_rows(drives({"a": [(d, 0, d) for d in range(n)]}), factor).orderBy("date").collect()
    assert [int(r["smart_5_raw"]) for r in got] == thin(list(range(n)), factor)


@pytest.mark.parametrize("pad", [None, "bfill", "null"])
@pytest.mark.parametrize("lags", ["cumulative", "literal"])
def test_hybrid_windows_are_full_and_dilated_ones_from_one_sort(spark, lags, pad):
    rows = [(s, day(d), int(d > n - 8), int(d > n - 16), None if d % 11 == 0 else float(d)) for s, n in (("a", 160), ("b", 10), ("c", 3)) for d in range(n)]
    df = spark.createDataFrame(rows, "serial_number string, date date, predict_val int, validate_val int, smart_5_raw double")

    def run(kind, **more):
        return wn.lag_windows(df, ["smart_5_raw"], 8, kind, lags, pad=pad, **more)
    got = run("hybrid")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Union" not in plan
    assert got.columns == [*df.columns, "features", "window_label", "window_kind"]
    keep = ("serial_number", "date", "features", "window_label")
    full = [(*(r[c] for c in keep), "full") for r in run("full").where("validate_val = 1").collect()]
    thinned = [(*(r[c] for c in keep), "dilated") for r in run("dilated").collect()]
    assert sorted(map(repr, (tuple(r[c] for c in (*keep, "window_kind")) for r in got.collect()))) == sorted(map(repr, full + thinned)) and full and thinned


@pytest.mark.parametrize("window", [8, 6, 5])
def test_dilated_windows_match_a_plain_model(drives, window):
    n = 60
    got = wn.lag_windows(drives({"a": [(d, 0, d) for d in range(n)], "b": [(d, 0, -d) for d in range(10)]}), ["smart_5_raw"], window, "dilated")
    left = list(range(n))
    for f in prime_factors(window):
        left = thin(left, f)
    lags = wn.dilated_lags(window)
    want = [[float(i - lag) for lag in sorted(lags, reverse=True)] for i in left if i >= max(lags)]
    assert [r["features"][0] for r in got.filter("serial_number = 'a'").orderBy("date").collect()] == want
    assert len(lags) == sum(f - 1 for f in prime_factors(window)) + 1


def test_duplicate_extension_repeats_and_trims(drives):
    df = drives({"a": [(d, 0, d) for d in range(3)], "b": [(d, 0, d) for d in range(9)]})
    got = wn.extend_short_history(df, 7).orderBy("serial_number", "position").collect()
    assert [int(r["smart_5_raw"]) for r in got if r["serial_number"] == "a"] == [0, 1, 2, 0, 1, 2, 0]
    assert sum(r["serial_number"] == "b" for r in got) == 9


def test_interpolated_extension_is_a_line(drives):
    got = wn.extend_short_history(drives({"a": [(d, 0, d) for d in range(4)]}), 7, "interpolate").orderBy("position").collect()
    want = [min(j * 4 / 7, 3.0) for j in range(7)]
    assert [r["smart_5_raw"] for r in got] == pytest.approx(want)


def test_series_samples_cut_before_failure_and_before_the_tail(drives):
    df = drives({"bad": [(d, int(d == 10), d) for d in range(12)], "long": [(d, 0, d) for d in range(20)], "mid": [(d, 0, d) for d in range(15)]})
    got = wn.drive_series_samples(df, ["smart_5_raw"])
    per = {r["serial_number"]: r["count"] for r in got.groupBy("serial_number").count().collect()}
    assert per == {"bad": 10, "long": 13, "mid": 7}
    assert got.filter("serial_number = 'bad' AND label = 1").count() == 7


def test_padding_keeps_true_length(drives):
    lists = wn.grouped_lists(drives({"a": [(0, 0, 1)], "b": [(0, 0, 3), (1, 0, 4)]}))
    got = {r["serial_number"]: (r["length"], r["smart_5_raw"]) for r in wn.pad_series(lists, ["smart_5_raw"]).collect()}
    assert got == {"a": (1, [1.0, 2.0]), "b": (2, [3.0, 4.0])}


def test_constant_column_scales_to_zero(drives):
    df = drives({"a": [(0, 0, 5), (1, 0, 5)]})
    assert [r[0] for r in sc.min_max_scale(df, ["smart_5_raw"]).select("smart_5_raw").collect()] == [0.0, 0.0]


def test_smoothing_restarts_per_drive(drives):
    df = drives({"a": [(0, 0, 10), (1, 0, 20), (2, 0, 0)], "b": [(0, 0, 1), (1, 0, 1)]})
    got = [r["smart_5_raw"] for r in sc.exp_smooth(df, ["smart_5_raw"], 0.5).orderBy("serial_number", "date").collect()]
    assert got == [10.0, 10.0, 15.0, 1.0, 1.0]


def test_least_squares_start_minimises_one_step_error(drives):
    x = [3.0, 5.0, 4.0, 9.0, 1.0]
    alpha = 0.3

    def error(first):
        level, total = first, 0.0
        for v in x:
            total += (v - level) ** 2
            level = alpha * v + (1 - alpha) * level
        return total

    got = sc.exp_smooth(drives({"a": [(i, 0, v) for i, v in enumerate(x)]}), ["smart_5_raw"], alpha, "least_squares")
    first = got.orderBy("date").first()["smart_5_raw"]
    assert all(error(first) <= error(first + d) for d in np.linspace(-1, 1, 41))


def test_wavelet_matches_a_direct_sum(drives):
    x = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0]
    got = sc.wavelet(drives({"a": [(i, 0, v) for i, v in enumerate(x)]}), ["smart_5_raw"], max_scale=4)
    for r in got.collect():
        b, a = (r["date"] - day(0)).days, r["scale"]
        want = sum(v * np.conj(np.exp(-((t - b) / a) ** 2) * np.exp(1j * np.pi * (t - b) / a)) for t, v in enumerate(x)) / np.sqrt(np.pi * a)
        assert (r["re"], r["im"]) == pytest.approx((want.real, want.imag))

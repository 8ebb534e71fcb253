"""Queries over tests, rankings, divergence, neighbours, sampling and window summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindlescope.operators import features as ft
from spindlescope.operators import reports as rp
from spindlescope.operators import sampling as sp
from spindlescope.operators import statistics as st
from spindlescope.operators import window_axes as wx
from spindlescope.operators import windows as wn
from spindlescope.operators.neighbours import knn_join
from spindlescope.plans import fixtures as fx
from spindlescope.plans.registry import query, view
from spindlescope.plans.reports import rounded

# ---- tests and rankings ------------------------------------------------------------------------


def _moments_sql(c: str) -> str:
    sides = ", ".join(f"""COUNT({c}) FILTER (predict_val = {k}) AS n{k}, AVG({c}) FILTER (predict_val = {k}) AS m{k},
      VAR_SAMP({c}) FILTER (predict_val = {k}) AS v{k}""" for k in (0, 1))
    return f"SELECT '{c}' AS feature, {sides} FROM labelled_day"


view("label_moments", " UNION ALL ".join(_moments_sql(c) for c in fx.FULL_RAW), ("labelled_day",))
_POOLED = "(m0 - m1) / SQRT(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1))"


@query("t_test", f"SELECT feature, ROUND({_POOLED}, 6) AS t, CAST(n0 + n1 - 2 AS DOUBLE) AS dof FROM label_moments", ("label_moments",))
def t_test(spark, sf_dir):
    return rounded(st.t_test(fx.labelled_days(spark, sf_dir), fx.FULL_RAW).drop("p_value"))


def _integral(value: str, low: str, high: str, steps: int = 4000) -> str:
    """Simpson's rule in SQL; ``value`` is an expression of x."""
    at = f"({low} + i * ({high} - {low}) / {steps})"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * {value.replace('x', at)})) * ({high} - {low}) / {3 * steps})"


#: Two-sided tail of the t distribution: with t = sqrt(dof) tan(x) the density becomes a power of the cosine.
_T_TAIL = ("2 * EXP(LGAMMA((dof + 1) / 2) - LGAMMA(dof / 2)) / SQRT(PI()) * "
           + _integral("POW(COS(x), dof - 1)", "ATAN(ABS(t) / SQRT(dof))", "LEAST(PI() / 2, ATAN(ABS(t) / SQRT(dof)) + 60 / SQRT(dof))"))
_NORMAL_TAIL = "2 / SQRT(2 * PI()) * " + _integral("EEE(-x * x / 2)", "ABS(z)", "(ABS(z) + 12)").replace("EEE", "EXP")


@query("t_test_p_values", f"""SELECT feature, ROUND(t, 6) AS t, dof, ROUND({_T_TAIL}, 6) AS p_value
  FROM (SELECT feature, {_POOLED} AS t, CAST(n0 + n1 - 2 AS DOUBLE) AS dof FROM label_moments)""", ("label_moments",))
def t_test_p_values(spark, sf_dir):
    return rounded(st.t_test(fx.labelled_days(spark, sf_dir), fx.FULL_RAW))


@query("welch_test", """SELECT feature, ROUND((m0 - m1) / SQRT(v0 / n0 + v1 / n1), 6) AS t,
  ROUND(POW(v0 / n0 + v1 / n1, 2) / (POW(v0 / n0, 2) / (n0 - 1) + POW(v1 / n1, 2) / (n1 - 1)), 6) AS dof FROM label_moments""",
       ("label_moments",))
def welch_test(spark, sf_dir):
    return rounded(st.welch_test(fx.labelled_days(spark, sf_dir), fx.FULL_RAW).drop("p_value"))


view("label_ranks", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, predict_val, RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r,
    CAST(COUNT(*) OVER (PARTITION BY {c}) AS DOUBLE) AS t FROM labelled_day""" for c in fx.FULL_RAW), ("labelled_day",))
view("label_u", """SELECT feature, n0, n1, n0 + n1 AS n, r0 - n0 * (n0 + 1) / 2.0 AS u, ties FROM (
    SELECT feature, CAST(COUNT(*) FILTER (predict_val = 0) AS DOUBLE) AS n0, CAST(COUNT(*) FILTER (predict_val = 1) AS DOUBLE) AS n1,
      SUM(r) FILTER (predict_val = 0) AS r0, SUM(t * t - 1) AS ties FROM label_ranks GROUP BY 1)""", ("label_ranks",))
_Z = "(GREATEST(u, n0 * n1 - u) - n0 * n1 / 2.0 - 0.5) / SQRT(n0 * n1 / 12.0 * ((n + 1) - ties / (n * (n - 1))))"


@query("mann_whitney", f"SELECT feature, ROUND(u, 6) AS u, ROUND({_Z}, 6) AS z FROM label_u", ("label_u",))
def mann_whitney(spark, sf_dir):
    return rounded(st.mann_whitney(fx.labelled_days(spark, sf_dir), fx.FULL_RAW).drop("p_value"))


@query("mann_whitney_p_values", f"""SELECT feature, ROUND(u, 6) AS u, ROUND(z, 6) AS z, ROUND({_NORMAL_TAIL}, 6) AS p_value
  FROM (SELECT feature, u, {_Z} AS z FROM label_u)""", ("label_u",))
def mann_whitney_p_values(spark, sf_dir):
    return rounded(st.mann_whitney(fx.labelled_days(spark, sf_dir), fx.FULL_RAW))


@query("raw_normalized_corr", """SELECT 'smart_5_raw' AS feature, ROUND(CORR(smart_5_raw, smart_5_normalized), 6) AS r FROM drive_day""")
def raw_normalized_corr(spark, sf_dir):
    return rounded(st.raw_normalized_corr(fx.drive_day(spark, sf_dir)))


@query("rank_features", f"""SELECT feature, ROW_NUMBER() OVER (ORDER BY ABS({_POOLED}) DESC) AS place FROM label_moments
  ORDER BY place LIMIT 2""", ("label_moments",))
def rank_features(spark, sf_dir):
    _, chosen = st.rank_features(fx.labelled_days(spark, sf_dir).drop("smart_5_normalized"), 2)
    return spark.createDataFrame([(c, i) for i, c in enumerate(chosen, start=1)], "feature string, place long")


@query("rank_features_mann_whitney", f"""SELECT feature, ROW_NUMBER() OVER (ORDER BY ABS({_Z}) DESC) AS place FROM label_u
  ORDER BY place LIMIT 2""", ("label_u",))
def rank_features_mann_whitney(spark, sf_dir):
    _, chosen = st.rank_features(fx.labelled_days(spark, sf_dir), 2, "mannwhitneyu")
    return spark.createDataFrame([(c, i) for i, c in enumerate(chosen, start=1)], "feature string, place long")


@query("top_features", f"SELECT feature, ROUND({_POOLED}, 6) AS t FROM label_moments ORDER BY ABS({_POOLED}) DESC LIMIT 3", ("label_moments",))
def top_features(spark, sf_dir):
    return rounded(rp.top_features(st.t_test(fx.labelled_days(spark, sf_dir), fx.FULL_RAW), 3).select("feature", "t"))


@query("feature_weights")
def feature_weights(spark, sf_dir):
    weights = st.feature_weights(st.t_test(fx.labelled_days(spark, sf_dir), fx.FULL_RAW))
    return rounded(spark.createDataFrame(sorted(weights.items()), "feature string, weight double"))


@query("kl_divergence", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, ROUND(SUM((a.{c} + 1e-10::DOUBLE) * LN((a.{c} + 1e-10::DOUBLE) / (b.{c} + 1e-10::DOUBLE))), 4) AS kl
    FROM drive_day a JOIN drive_day b ON b.serial_number = a.serial_number AND b.date = a.date + INTERVAL 1 DAY"""
    for c in ("smart_9_raw", "smart_187_raw")))
def kl_divergence(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    before = days.withColumn("date", F.date_sub("date", 1))
    return rounded(st.kl_divergence(days, before, ["serial_number", "date"], ["smart_9_raw", "smart_187_raw"]), 4)


_BIN_SQL = " UNION ALL ".join(
    f"""SELECT model, '{c}' AS feature, GREATEST(0, LEAST(FLOOR(({c} - lo) / ((hi - lo) / 20)), 19)) AS bin, COUNT(*) AS n
    FROM drive_day, (SELECT LEAST(MIN({c}), 0) AS lo, GREATEST(MAX({c}), 0) AS hi FROM drive_day) GROUP BY 1, 2, 3"""
    for c in ("smart_9_raw", "smart_187_raw"))


@query("model_divergence", f""", bins AS ({_BIN_SQL}), tot AS (SELECT model, feature, SUM(n) AS rows_in FROM bins GROUP BY 1, 2),
  grid AS (SELECT t.model, t.feature, g.bin, COALESCE(b.n, 0) / t.rows_in AS p FROM tot t CROSS JOIN (SELECT UNNEST(range(0, 20)) AS bin) g
    LEFT JOIN bins b ON b.model = t.model AND b.feature = t.feature AND b.bin = g.bin)
  SELECT a.model AS model_a, b.model AS model_b, a.feature, ROUND(SUM((a.p + 1e-10::DOUBLE) * LN((a.p + 1e-10::DOUBLE) / (b.p + 1e-10::DOUBLE))), 6) AS kl
  FROM grid a JOIN grid b ON a.feature = b.feature AND a.bin = b.bin AND a.model <> b.model GROUP BY 1, 2, 3""")
def model_divergence(spark, sf_dir):
    pairs = st.model_divergence(fx.drive_day(spark, sf_dir), ["smart_9_raw", "smart_187_raw"])
    return rounded(pairs.select("model_a", "model_b", "feature", "kl"))


@query("partition_models_by_divergence")
def partition_models_by_divergence(spark, sf_dir):
    return rounded(st.partition_models_by_divergence(fx.drive_day(spark, sf_dir), ["smart_9_raw", "smart_187_raw"]))


# ---- neighbours --------------------------------------------------------------------------------

_KNN = """SELECT vec_id, neighbour, CAST(rank AS INTEGER) AS rank, ROUND(distance, 6) AS distance{extra} FROM (
  SELECT a.vec_id, b.vec_id AS neighbour, d AS distance{pick}, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id {on}, LATERAL (SELECT list_distance(a.vec, b.vec) AS d)) WHERE rank <= 5"""


@query("knn_join", _KNN.format(extra="", pick="", on=""), ("v",))
def knn(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    return rounded(knn_join(v, v, 5, exclude_self=True))


@query("knn_join_within", _KNN.format(extra=", label", pick=", a.label", on="AND a.label = b.label"), ("v",))
def knn_within(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    return rounded(knn_join(v, v, 5, "label", exclude_self=True))


# ---- splits and balancing ----------------------------------------------------------------------

_MD5 = "md5('42|' || serial_number || '|' || CAST(date AS VARCHAR))"


@query("split_random", f"""SELECT serial_number, date, predict_val, ROW_NUMBER() OVER (PARTITION BY predict_val ORDER BY {_MD5})
    <= CEIL(COUNT(*) OVER (PARTITION BY predict_val) * 0.3::DOUBLE) AS is_test FROM labelled_day""", ("labelled_day",), dates=("date",))
def split_random(spark, sf_dir):
    return sp.split_random(fx.labelled_days(spark, sf_dir)).select("serial_number", "date", "predict_val", "is_test")


view("drive_split", """SELECT serial_number, ever, ROW_NUMBER() OVER (PARTITION BY ever ORDER BY md5('42|' || serial_number))
    <= FLOOR(COUNT(*) OVER (PARTITION BY ever) * 0.3::DOUBLE) AS is_test FROM (
    SELECT serial_number, MAX(failure) AS ever FROM drive_day GROUP BY 1)""", ("drive_day",))


@query("split_by_drive", "SELECT serial_number, date, is_test FROM drive_day JOIN drive_split USING (serial_number)", ("drive_split",), dates=("date",))
def split_by_drive(spark, sf_dir):
    return sp.split_by_drive(fx.drive_day(spark, sf_dir)).select("serial_number", "date", "is_test")


@query("split_by_time", f"""SELECT serial_number, date, ROW_NUMBER() OVER (ORDER BY date, {_MD5}) > FLOOR((SELECT COUNT(*) FROM drive_day) * 0.7::DOUBLE) AS is_test
  FROM drive_day""", dates=("date",))
def split_by_time(spark, sf_dir):
    return sp.split_by_time(fx.drive_day(spark, sf_dir)).select("serial_number", "date", "is_test")


@query("split_drives_stratified", """SELECT ever AS failed, COUNT(*) AS drives, CAST(SUM(CASE WHEN is_test THEN 1 ELSE 0 END) AS BIGINT) AS test_drives FROM (
  SELECT ever, ROW_NUMBER() OVER (PARTITION BY ever ORDER BY md5('42|' || serial_number)) <= CEIL(ROUND(COUNT(*) OVER (PARTITION BY ever) * 0.3, 9)) AS is_test
  FROM drive_split) GROUP BY 1""", ("drive_split",))
def split_drives_stratified(spark, sf_dir):
    marked = sp.split_drives_stratified(fx.drive_day(spark, sf_dir))
    drives = marked.groupBy("serial_number").agg(F.max("failure").alias("failed"), F.max(F.col("is_test").cast("int")).alias("t"))
    return drives.groupBy("failed").agg(F.count(F.lit(1)).alias("drives"), F.sum("t").alias("test_drives"))


@query("undersample", f"""SELECT serial_number, date, predict_val FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY predict_val ORDER BY {_MD5}) AS rn FROM labelled_day)
  WHERE rn <= (SELECT MIN(n) FROM (SELECT COUNT(*) AS n FROM labelled_day GROUP BY predict_val))""", ("labelled_day",), dates=("date",))
def undersample(spark, sf_dir):
    return sp.undersample(fx.labelled_days(spark, sf_dir)).select("serial_number", "date", "predict_val")


@query("undersample_ratio", """SELECT predict_val, LEAST(n, FLOOR(MIN(n) OVER () / 0.5::DOUBLE)::BIGINT) AS records FROM (
  SELECT predict_val, COUNT(*) AS n FROM labelled_day GROUP BY 1)""", ("labelled_day",))
def undersample_ratio(spark, sf_dir):
    return rp.class_counts(sp.undersample(fx.labelled_days(spark, sf_dir), 0.5))


_SMOTE = """, m AS (SELECT vec_id, vec, COUNT(*) OVER () AS n, ROW_NUMBER() OVER (ORDER BY md5('42|' || vec_id)) AS place FROM v WHERE label = 0),
  g AS (SELECT (SELECT COUNT(*) FROM v WHERE label <> 0) - (SELECT COUNT(*) FROM m) AS new_rows),
  c AS (SELECT vec_id, vec, UNNEST(range(1, CAST(new_rows // n + CASE WHEN place <= new_rows % n THEN 1 ELSE 0 END + 1 AS BIGINT))) AS copy FROM m, g),
  k AS (SELECT a.vec_id, b.vec_id AS neighbour, b.vec AS other, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.vec, b.vec), b.vec_id) AS rank
    FROM m a JOIN m b ON a.vec_id <> b.vec_id)
  SELECT c.vec_id AS parent, k.neighbour, CAST(c.copy AS INTEGER) AS copy, CAST(1 AS INTEGER) AS positive,
    ROUND(c.vec[1] + ('0x' || substr(md5('42-step|' || c.vec_id || '|' || c.copy), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (k.other[1] - c.vec[1]), 6) AS first_value
  FROM c JOIN k ON k.vec_id = c.vec_id
    AND k.rank = ('0x' || substr(md5('42-neighbour|' || c.vec_id || '|' || c.copy), 1, 8))::BIGINT % 5 + 1"""


@query("smote", _SMOTE, ("v",))
def smote(spark, sf_dir):
    made = sp.smote(fx.vectors(spark, sf_dir), label="positive")
    return made.select("parent", "neighbour", "copy", "positive", F.round(F.col("vec")[0], 6).alias("first_value"))


@query("smote_counts", """SELECT CAST(1 AS INTEGER) AS positive, CAST(COUNT(*) FILTER (label <> 0) - COUNT(*) FILTER (label = 0) AS BIGINT) AS made FROM embeddings""", ())
def smote_counts(spark, sf_dir):
    return sp.smote(fx.vectors(spark, sf_dir), label="positive").groupBy("positive").agg(F.count(F.lit(1)).alias("made"))


@query("balance", """SELECT CAST(label = 0 AS INTEGER) AS positive, CAST(CASE WHEN label = 0 THEN t ELSE FLOOR(t / 0.8::DOUBLE) END AS BIGINT) AS records
  FROM (SELECT DISTINCT CAST(CASE WHEN label = 0 THEN 0 ELSE 1 END AS INTEGER) AS label FROM embeddings), (SELECT FLOOR(0.5::DOUBLE * COUNT(*) FILTER (label <> 0)) AS t FROM embeddings)""", ())
def balance(spark, sf_dir):
    even = sp.balance(fx.vectors(spark, sf_dir), over=0.5, under=0.8, label="positive")
    return even.groupBy("positive").agg(F.count(F.lit(1)).alias("records"))


@query("time_slices", """, e AS (SELECT """ + ", ".join(f"QUANTILE_CONT(date - DATE '1970-01-01', {i / 10}) AS e{i}" for i in range(1, 10)) + """ FROM drive_day)
  SELECT serial_number, date, """ + " + ".join(f"CASE WHEN date - DATE '1970-01-01' >= e{i} THEN 1 ELSE 0 END" for i in range(1, 10)) +
       " AS slice FROM drive_day, e", dates=("date",))
def time_slices(spark, sf_dir):
    return sp.time_slices(fx.drive_day(spark, sf_dir)).select("serial_number", "date", "slice")


@query("time_smote", """, e AS (SELECT """ + ", ".join(f"QUANTILE_CONT(vec_id, {i / 5}) AS e{i}" for i in range(1, 5)) + """ FROM v),
  s AS (SELECT CAST(label = 0 AS INTEGER) AS positive, """ + " + ".join(f"CASE WHEN vec_id >= e{i} THEN 1 ELSE 0 END" for i in range(1, 5)) + """ AS slice FROM v, e),
  n AS (SELECT positive, COUNT(*) AS n FROM s GROUP BY 1)
  SELECT slice, positive, CAST(ANY_VALUE(((SELECT MAX(n) FROM n) - n.n) // 2) AS BIGINT) AS made FROM s JOIN n USING (positive)
  GROUP BY 1, 2 HAVING COUNT(*) > 3 AND made > 0""", ("v",))
def time_smote(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).withColumn("day", F.col("vec_id").cast("double"))
    made = sp.time_smote(v, "day", k=3, n_slices=5, label="positive")
    return made.groupBy("slice", "positive").agg(F.count(F.lit(1)).alias("made"))


@query("sampling_targets", "SELECT label, MAX(n) OVER () - n AS new_rows FROM (SELECT label, COUNT(*) AS n FROM embeddings GROUP BY 1)", ())
def sampling_targets(spark, sf_dir):
    return sp.sampling_target_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "all")


@query("sample_rows", f"SELECT serial_number, date, smart_9_raw FROM drive_day ORDER BY {_MD5} LIMIT 1000", dates=("date",))
def sample_rows(spark, sf_dir):
    return rp.sample_rows(fx.drive_day(spark, sf_dir), 1000, ["serial_number", "date"]).select("serial_number", "date", "smart_9_raw")


@query("shuffle", "SELECT serial_number, date FROM drive_day", dates=("date",))
def shuffle(spark, sf_dir):
    return sp.shuffle(fx.drive_day(spark, sf_dir)).select("serial_number", "date")


@query("stratified_kfold", f""", r AS (SELECT serial_number, date, predict_val, ROW_NUMBER() OVER (PARTITION BY predict_val ORDER BY {_MD5}) AS rn,
    COUNT(*) OVER (PARTITION BY predict_val) AS n FROM labelled_day)
  SELECT serial_number, date, predict_val, CAST((rn > n * 1 // 5)::INT + (rn > n * 2 // 5)::INT + (rn > n * 3 // 5)::INT + (rn > n * 4 // 5)::INT AS INTEGER) AS fold
  FROM r""", ("labelled_day",), dates=("date",))
def stratified_kfold(spark, sf_dir):
    return sp.stratified_kfold(fx.labelled_days(spark, sf_dir)).select("serial_number", "date", "predict_val", "fold")


@query("class_weights", """SELECT predict_val, ROUND(SUM(CASE predict_val WHEN 0 THEN 1.7 ELSE 0.3 END), 6)::DOUBLE AS weight FROM labelled_day GROUP BY 1""",
       ("labelled_day",))
def class_weights(spark, sf_dir):
    weighted = sp.class_weights(fx.labelled_days(spark, sf_dir), {0: 1.7, 1: 0.3})
    return weighted.groupBy("predict_val").agg(F.round(F.sum("weight"), 6).alias("weight"))


# ---- window summaries --------------------------------------------------------------------------


def _summary_sql(kinds) -> str:
    out = {
        "sum": "ROUND(SUM(x), 6)", "min": "MIN(x)", "max": "MAX(x)", "slope": "ROUND((MAX(x) - MIN(x)) / COUNT(*), 6)",
        "std": "ROUND(STDDEV_POP(x), 6)", "rms": "ROUND(SQRT(AVG(x * x)), 6)",
        "autocorr": "CASE WHEN STDDEV_POP(x) FILTER (step < 4) > 0 AND STDDEV_POP(x) FILTER (step > 0) > 0 THEN ROUND(CORR(x, nx), 6) END",
        "skew": "CASE WHEN MIN(x) < MAX(x) THEN ROUND(AVG(POW(x - mu, 3)) / POW(AVG(POW(x - mu, 2)), 1.5), 6) END",
    }
    parts = " UNION ALL ".join(
        f"SELECT serial_number, date, '{c}' AS feature, UNNEST(range(0, 5)) AS step, UNNEST(LIST({c}) OVER w) AS x, "
        f"UNNEST(LIST_CONCAT((LIST({c}) OVER w)[2:], [NULL])) AS nx, AVG({c}) OVER w AS mu FROM labelled_day "
        "WINDOW w AS (PARTITION BY serial_number ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) "
        "QUALIFY ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) >= 5" for c in ("smart_5_raw", "smart_9_raw"))
    return f""", long AS ({parts}) SELECT serial_number, date, feature, {", ".join(f"{out[k]} AS {k}" for k in kinds)} FROM long GROUP BY 1, 2, 3"""


def _summary_rows(df, kinds):
    cols = ["smart_5_raw", "smart_9_raw"]
    named = F.arrays_zip(F.array(*[F.lit(c) for c in cols]).alias("feature"), F.col("summary").alias("s"))
    rows = df.select("serial_number", "date", F.inline(named))
    return rounded(rows.select("serial_number", "date", "feature", *[F.col(f"s.{k}").alias(k) for k in kinds]))


@query("window_features", _summary_sql(ft.SUMMARIES), ("labelled_day",), dates=("date",))
def window_features(spark, sf_dir):
    windows = wn.lag_windows(fx.labelled_days(spark, sf_dir), ["smart_5_raw", "smart_9_raw"], fx.WINDOW)
    return _summary_rows(ft.window_features(windows), ft.SUMMARIES)


@query("window_features_basic", _summary_sql(ft.BASIC), ("labelled_day",), dates=("date",))
def window_features_basic(spark, sf_dir):
    windows = wn.lag_windows(fx.labelled_days(spark, sf_dir), ["smart_5_raw", "smart_9_raw"], fx.WINDOW)
    return _summary_rows(ft.window_features_basic(windows), ft.BASIC)


_AXIS_COLS = ["smart_9_raw", "smart_187_raw"]
view("window_run", " UNION ALL ".join(f"""SELECT serial_number, date, '{c}' AS feature, LIST({c}) OVER w AS run FROM labelled_day
  WINDOW w AS (PARTITION BY serial_number ORDER BY date ROWS BETWEEN {fx.WINDOW - 1} PRECEDING AND CURRENT ROW)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) >= {fx.WINDOW} AND COUNT({c}) OVER w = {fx.WINDOW}""" for c in _AXIS_COLS), ("labelled_day",))
view("mean_run", "SELECT feature, " + ", ".join(f"AVG(run[{i + 1}]) AS m{i}" for i in range(fx.WINDOW)) + " FROM window_run GROUP BY 1", ("window_run",))


@query("window_covariance", f"""SELECT feature, i, j, COUNT(*) AS windows, ROUND(COVAR_SAMP(run[i + 1], run[j + 1]), 6) AS covariance
  FROM window_run, (SELECT CAST(UNNEST(range(0, {fx.WINDOW})) AS INT) AS i), (SELECT CAST(UNNEST(range(0, {fx.WINDOW})) AS INT) AS j)
  GROUP BY 1, 2, 3""", ("window_run",))
def window_covariance(spark, sf_dir):
    return rounded(wx.window_covariance(fx.labelled_days(spark, sf_dir), _AXIS_COLS, fx.WINDOW))


def _placed_windows(spark, sf_dir):
    days = fx.labelled_days(spark, sf_dir)
    axes = wx.fit_window_pca_of_days(days, _AXIS_COLS, fx.WINDOW, fx.WINDOW)
    return wx.window_pca(wn.lag_windows(days, _AXIS_COLS, fx.WINDOW), axes)


@query("window_pca")
def window_pca(spark, sf_dir):
    placed = _placed_windows(spark, sf_dir)
    return rounded(placed.select("serial_number", "date", *[F.abs(F.col("components")[i][0]).alias(f"first_{i}") for i in range(2)]), 4)


@query("window_pca_distances", "SELECT serial_number, date, feature, ROUND(" + " + ".join(f"POW(run[{i + 1}] - m{i}, 2)" for i in range(fx.WINDOW)) +
       ", 4) AS distance FROM window_run JOIN mean_run USING (feature)", ("window_run", "mean_run"), dates=("date",))
def window_pca_distances(spark, sf_dir):
    """Squared length of a window's whole projection: its squared distance from the mean window, whatever the axes' order."""
    named = F.arrays_zip(F.array(*[F.lit(c) for c in _AXIS_COLS]).alias("feature"), F.col("components").alias("p"))
    length = F.aggregate("p", F.lit(0.0), lambda total, v: total + v * v)
    rows = _placed_windows(spark, sf_dir).select("serial_number", "date", F.inline(named))
    return rounded(rows.filter("p[0] IS NOT NULL").select("serial_number", "date", "feature", length.alias("distance")), 4)


@query("drive_pca")
def drive_pca(spark, sf_dir):
    stats = rp.drive_stats(fx.drive_day(spark, sf_dir).drop("smart_188_raw"))
    cols = [c for c in stats.columns if c.startswith(("mean_", "std_"))]
    placed, _ = ft.drive_pca(stats, cols)
    return rounded(placed.withColumns({f"pc{i}": F.abs(f"pc{i}") for i in (1, 2, 3)}), 4)


@query("feature_rank")
def feature_rank(spark, sf_dir):
    windows = wn.lag_windows(fx.labelled_days(spark, sf_dir), ["smart_9_raw", "smart_187_raw"], fx.WINDOW)
    return ft.feature_rank(ft.summary_vector(ft.window_features(windows)))


@query("genetic_feature_select")
def genetic_feature_select(spark, sf_dir):
    _, _, history = ft.genetic_feature_select(fx.labelled_days(spark, sf_dir), fx.FULL_SMART)
    return rounded(history)

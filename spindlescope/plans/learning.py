"""Queries over metrics, learners, saved runs, scoring and transfer."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spindlescope.config import RunConfig
from spindlescope.ml import kernels as kn
from spindlescope.ml import metrics as mt
from spindlescope.ml import networks as nw
from spindlescope.ml import neighbour_models as nm
from spindlescope.ml import training as tr
from spindlescope.ml import trees as fr
from spindlescope.ml.passes import block_sums, stored_rows
from spindlescope.operators import sampling as sp
from spindlescope.operators import statistics as st
from spindlescope.plans import fixtures as fx
from spindlescope.plans.registry import query, view
from spindlescope.plans.reports import rounded

CFG = RunConfig(min_days=fx.MIN_DAYS, gap_window=fx.GAP_WINDOW, max_missing=fx.MAX_MISSING, horizon=fx.HORIZON,
                window=fx.WINDOW, num_features=4, learner="random_forest", split="hdd", under_ratio=0.5)


def judged(spark, sf_dir):
    """Two 0/1 columns of the labels table as truth and prediction."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rows.select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


view("cells", """SELECT CAST(COUNT(*) FILTER (quality = 1 AND toxic = 1) AS DOUBLE) AS tp, CAST(COUNT(*) FILTER (quality = 0 AND toxic = 1) AS DOUBLE) AS fp,
  CAST(COUNT(*) FILTER (quality = 0 AND toxic = 0) AS DOUBLE) AS tn, CAST(COUNT(*) FILTER (quality = 1 AND toxic = 0) AS DOUBLE) AS fn FROM labels""")


@query("confusion", "SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn FROM cells", ("cells",))
def confusion(spark, sf_dir):
    return mt.confusion(judged(spark, sf_dir))


def _safe(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0.0 ELSE ({top}) / ({bottom}) END"


@query("report_metrics", f"""SELECT ROUND(SQRT((fp + fn) / (tp + fp + tn + fn)), 6) AS rmse, ROUND((fp + fn) / (tp + fp + tn + fn), 6) AS mae,
  ROUND({_safe('fp', 'fp + tp')}, 6) AS fdr, ROUND({_safe('fp', 'fp + tn')}, 6) AS far, ROUND({_safe('2 * tp', '2 * tp + fp + fn')}, 6) AS f1,
  ROUND({_safe('tp', 'tp + fn')}, 6) AS recall, ROUND({_safe('tp', 'tp + fp')}, 6) AS precision,
  ROUND((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
  ROUND(({_safe('tp', 'tp + fn')} + {_safe('tn', 'fp + tn')}) / 2, 6) AS auc_hard FROM cells""", ("cells",))
def report_metrics(spark, sf_dir):
    return rounded(mt.report_metrics(judged(spark, sf_dir)))


@query("accuracy", "SELECT ROUND(AVG(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels", ())
def accuracy(spark, sf_dir):
    return rounded(mt.accuracy(judged(spark, sf_dir)))


@query("log_loss", """SELECT ROUND(AVG(-CASE WHEN quality = 1 THEN LN(p) ELSE LN(1 - p) END), 6) AS log_loss
  FROM (SELECT quality, GREATEST(1e-15, LEAST(1 - 1e-15, (doc_id % 11) / 10.0::DOUBLE)) AS p FROM labels)""", ())
def log_loss(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("p1", F.pmod("doc_id", F.lit(11)) / F.lit(10.0))
    return rounded(mt.log_loss(rows))


def embedding_sides(spark, sf_dir):
    """Training and test vectors: class 1 is embedding label 0."""
    v = fx.vectors(spark, sf_dir).select("vec_id", "vec", F.col("positive").alias("label"))
    marked = sp.split_random(v, 0.3, label="label", keys=["vec_id"])
    return marked.filter("NOT is_test").drop("is_test"), marked.filter("is_test").drop("is_test")


def _as_vectors(df):
    return df.select("vec_id", array_to_vector("vec").alias("vector"), "label")


def _fit(spark, sf_dir, learner, params, **kw):
    train, test = embedding_sides(spark, sf_dir)
    done = tr.train_and_evaluate(_as_vectors(train), _as_vectors(test), learner, params, keys=["vec_id"], folds=None, **kw)
    return rounded(mt.report_metrics(done.predictions), 4)


for _name in ("random_forest", "extra_trees", "decision_tree", "logistic_regression", "svm", "xgb", "gradient_boosting", "naive_bayes", "mlp", "dense_net"):
    query(f"learn_{_name}")(lambda spark, sf_dir, n=_name: _fit(spark, sf_dir, n, None))


@query("learn_with_class_weights")
def learn_with_class_weights(spark, sf_dir):
    return _fit(spark, sf_dir, "logistic_regression", None, weights={0: 0.3, 1: 1.7})


@query("learn_network_with_class_weights")
def learn_network_with_class_weights(spark, sf_dir):
    return _fit(spark, sf_dir, "mlp", None, weights={0: 0.3, 1: 1.7})


@query("learn_svm_kernels")
def learn_svm_kernels(spark, sf_dir):
    """One row of metrics per kernel, default strength and gamma."""
    out = None
    for kernel in kn.KERNELS:
        row = _fit(spark, sf_dir, "svm", {"kernel": kernel}).withColumn("kernel", F.lit(kernel))
        out = row if out is None else out.unionByName(row)
    return out


#: What a kernel value from 4,096 mapped features may be off by; gamma is 1 / (columns * variance), so the values are about 1 at most.
KERNEL_ERROR = 0.25


@query("kernel_values", f""", g AS (SELECT 1 / (COUNT(*) / (SELECT COUNT(*) FROM v) * VAR_POP(x)) AS gamma FROM (SELECT UNNEST(vec) AS x FROM v)),
  p AS (SELECT a.vec_id, gamma * list_dot_product(a.vec, b.vec) AS z, gamma * list_distance(a.vec, b.vec) ** 2 AS d FROM v a JOIN v b ON b.vec_id = a.vec_id + 1, g)
  SELECT vec_id, 'poly' AS kernel, ROUND(z ** 3, 6) AS exact, TRUE AS close FROM p
  UNION ALL SELECT vec_id, 'rbf', ROUND(EXP(-d), 6), TRUE FROM p
  UNION ALL SELECT vec_id, 'sigmoid', ROUND((EXP(2 * z) - 1) / (EXP(2 * z) + 1), 6), TRUE FROM p WHERE ABS(z) <= 1""", ("v",))
def kernel_values(spark, sf_dir):
    """Exact kernel values of neighbouring rows, and whether the mapped rows give them within KERNEL_ERROR."""
    v = fx.vectors(spark, sf_dir)
    gamma = kn.scale_gamma(stored_rows(v.select(array_to_vector("vec").alias("vector"))))
    pairs = v.select("vec_id", F.col("vec").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("b")), "vec_id")
    both = F.zip_with("a", "b", lambda x, y: x * y)
    apart = F.zip_with("a", "b", lambda x, y: (x - y) * (x - y))
    z, d = (F.lit(gamma) * F.aggregate(c, F.lit(0.0), lambda s, x: s + x) for c in (both, apart))
    pairs = pairs.withColumns({"z": z, "d": d})
    out = None
    for kernel, exact in (("poly", F.pow("z", F.lit(3.0))), ("rbf", F.exp(-F.col("d"))), ("sigmoid", F.tanh("z"))):
        rows = pairs.where(F.abs("z") <= 1) if kernel == "sigmoid" else pairs
        facts = {"kernel": kernel, "gamma": gamma, "degree": 3, "coef0": 0.0, "features": 4096, "seed": 42}
        rows = kn.kernel_values(rows.withColumn("exact", exact), "a", "b", facts)
        rows = rows.select("vec_id", F.lit(kernel).alias("kernel"), F.round("exact", 6).alias("exact"), (F.abs(F.col("approximate") - F.col("exact")) <= KERNEL_ERROR).alias("close"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("network_gradient", """, r AS (SELECT CASE WHEN label = 0 THEN 1.7 ELSE 0.3 END::DOUBLE AS w, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, vec FROM v)
  SELECT p::BIGINT AS position, ROUND(SUM(w * (0.5 - y) * x), 6) AS slope FROM (SELECT w, y, UNNEST(vec) AS x, generate_subscripts(vec, 1) - 1 AS p FROM r) GROUP BY 1
  UNION ALL SELECT 64, ROUND(SUM(w * (0.5 - y)), 6) FROM r""", ("v",))
def network_gradient(spark, sf_dir):
    """Weighted gradient, summed over the tasks, of a network without hidden layers whose weights are 0: one number per input, then the bias."""
    v = fx.vectors(spark, sf_dir).select(array_to_vector("vec").alias("vector"), F.col("positive").alias("label"), F.when(F.col("positive") == 1, 1.7).otherwise(0.3).alias("w"))
    rows = stored_rows(v, "label", "w")
    layers = [len(rows.first()["x"]), 1]
    flat = 0.0 * nw.initial(layers, 1)
    sums = block_sums(rows, lambda x, rest: nw.weighted_gradient(flat, layers, x, rest["label"], rest["w"]), 2 + len(flat))
    return rounded(spark.createDataFrame([(i, float(s)) for i, s in enumerate(sums[2:])], "position long, slope double"))


@query("grid_search")
def grid_search(spark, sf_dir):
    return _fit(spark, sf_dir, "logistic_regression", None, method="grid")


@query("random_search")
def random_search(spark, sf_dir):
    return _fit(spark, sf_dir, "decision_tree", None, method="randomized")


_SIDE = """SELECT vec_id, vec, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, ROW_NUMBER() OVER (PARTITION BY label = 0 ORDER BY md5('42|' || vec_id))
  <= CEIL(COUNT(*) OVER (PARTITION BY label = 0) * 0.3::DOUBLE) AS is_test FROM v"""
view("sides", _SIDE, ("v",))


@query("learn_nearest_neighbours", """, n AS (SELECT a.vec_id, b.label, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.vec, b.vec), b.vec_id) AS rank
    FROM sides a JOIN sides b ON a.is_test AND NOT b.is_test),
  s AS (SELECT vec_id, CAST(SUM(label) AS BIGINT) AS ones FROM n WHERE rank <= 5 GROUP BY 1)
  SELECT vec_id, CASE WHEN ones > 2 THEN 1 ELSE 0 END AS prediction, ROUND(ones / 5.0, 6) AS p1 FROM s""", ("sides",))
def learn_nearest_neighbours(spark, sf_dir):
    train, test = embedding_sides(spark, sf_dir)
    return rounded(nm.knn_classify(train, test))


@query("learn_nearest_neighbours_distance", """, n AS (SELECT a.vec_id, b.label, list_distance(a.vec, b.vec) AS d,
      ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.vec, b.vec), b.vec_id) AS rank FROM sides a JOIN sides b ON a.is_test AND NOT b.is_test),
  s AS (SELECT vec_id, SUM(CASE WHEN label = 1 THEN 1 / d ELSE 0 END) AS one, SUM(1 / d) AS whole FROM n WHERE rank <= 5 GROUP BY 1)
  SELECT vec_id, CASE WHEN one > whole - one THEN 1 ELSE 0 END AS prediction, ROUND(one / whole, 6) AS p1 FROM s""", ("sides",))
def learn_nearest_neighbours_distance(spark, sf_dir):
    train, test = embedding_sides(spark, sf_dir)
    return rounded(nm.knn_classify(train, test, weights="distance"))


@query("learn_k_nearest", f""", n AS (SELECT a.vec_id, a.label AS truth, b.label, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.vec, b.vec), b.vec_id) AS rank
    FROM sides a JOIN sides b ON a.is_test AND NOT b.is_test),
  p AS (SELECT vec_id, MAX(truth) AS truth, CASE WHEN SUM(label) > 2 THEN 1 ELSE 0 END AS said FROM n WHERE rank <= 5 GROUP BY 1),
  c AS (SELECT (COUNT(*) FILTER (truth = 1 AND said = 1))::DOUBLE AS tp, (COUNT(*) FILTER (truth = 0 AND said = 1))::DOUBLE AS fp,
    (COUNT(*) FILTER (truth = 0 AND said = 0))::DOUBLE AS tn, (COUNT(*) FILTER (truth = 1 AND said = 0))::DOUBLE AS fn FROM p)
  SELECT ROUND(SQRT((fp + fn) / (tp + fp + tn + fn)), 4) AS rmse, ROUND((fp + fn) / (tp + fp + tn + fn), 4) AS mae,
  ROUND({_safe('fp', 'fp + tp')}, 4) AS fdr, ROUND({_safe('fp', 'fp + tn')}, 4) AS far, ROUND({_safe('2 * tp', '2 * tp + fp + fn')}, 4) AS f1,
  ROUND({_safe('tp', 'tp + fn')}, 4) AS recall, ROUND({_safe('tp', 'tp + fp')}, 4) AS precision,
  ROUND((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy, ROUND(({_safe('tp', 'tp + fn')} + {_safe('tn', 'fp + tn')}) / 2, 4) AS auc_hard FROM c""", ("sides",))
def learn_k_nearest(spark, sf_dir):
    return _fit(spark, sf_dir, "k_nearest", None)


@query("learn_unsupervised")
def learn_unsupervised(spark, sf_dir):
    """Isolation forest and density clusters through the runner: their metrics against the labels, and the silhouette of what they find."""
    points = drive_points(spark, sf_dir).join(drive_facts(spark, sf_dir).select("vec_id", "label"), "vec_id")
    marked = tr.written(sp.split_random(points, 0.3, label="label", keys=["vec_id"]))
    train, test = (_as_vectors(marked.filter(c)) for c in ("NOT is_test", "is_test"))
    rows = []
    for learner, params in (("isolation_forest", None), ("dbscan", {"eps": 0.15})):
        done = tr.train_and_evaluate(train, test, learner, params, keys=["vec_id"])
        rows += [(learner, k, float(v)) for k, v in sorted(done.metrics.items()) if v is not None]
    return rounded(spark.createDataFrame(rows, "learner string, metric string, value double"), 4)


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    model = nm.isolation_forest(v)
    return rounded(model.predict(v).select("vec_id", "anomaly", "prediction"))


view("drive_point", """SELECT serial_number, ROUND(AVG(smart_187_raw), 4) / 20.0 AS x, ROUND(AVG(smart_197_raw), 4) / 5.0 AS y FROM drive_day GROUP BY 1""",
     ("drive_day",))


def drive_points(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir).groupBy("serial_number").agg(
        (F.round(F.avg("smart_187_raw"), 4) / 20.0).alias("x"), (F.round(F.avg("smart_197_raw"), 4) / 5.0).alias("y"))
    return days.select(F.col("serial_number").alias("vec_id"), F.array("x", "y").alias("vec"))


@query("dbscan", """, e AS (SELECT a.serial_number AS a, b.serial_number AS b FROM drive_point a JOIN drive_point b
    ON SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.15),
  c AS (SELECT a FROM e GROUP BY 1 HAVING COUNT(*) >= 5),
  reach AS (SELECT a AS node, a AS root FROM c UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node AND e.b IN (SELECT a FROM c)),
  lab AS (SELECT node, MIN(root) AS root FROM reach GROUP BY 1)
  SELECT p.serial_number AS vec_id, c.a IS NOT NULL AS core FROM drive_point p LEFT JOIN c ON c.a = p.serial_number""", ("drive_point",))
def dbscan(spark, sf_dir):
    return nm.dbscan(drive_points(spark, sf_dir), 0.15, 5).select("vec_id", "core")


@query("dbscan_core_clusters", """, e AS (SELECT a.serial_number AS a, b.serial_number AS b FROM drive_point a JOIN drive_point b
    ON SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.15),
  c AS (SELECT a FROM e GROUP BY 1 HAVING COUNT(*) >= 5), ce AS (SELECT e.a, e.b FROM e SEMI JOIN c ON e.a = c.a WHERE e.b IN (SELECT a FROM c)),
  reach AS (SELECT a AS node, a AS root FROM c UNION SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.node)
  SELECT node AS vec_id, MIN(root) AS first_core FROM reach GROUP BY 1""", ("drive_point",))
def dbscan_core_clusters(spark, sf_dir):
    from pyspark.sql.window import Window
    core = nm.dbscan(drive_points(spark, sf_dir), 0.15, 5).filter("core")
    firsts = core.groupBy("cluster").agg(F.min("vec_id").alias("first_core"))
    return core.join(firsts, "cluster").select("vec_id", "first_core")


@query("silhouette")
def silhouette(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).select(array_to_vector("vec").alias("vector"), F.col("label").alias("prediction"))
    value = mt.silhouette(v)
    return rounded(v.agg(F.count(F.lit(1)).alias("records"), F.lit(value).alias("silhouette")), 4)


@query("silhouette_euclidean", """, pair AS (SELECT a.vec_id, a.label AS own, b.label AS other, AVG(list_distance(a.vec, b.vec)) AS mean, SUM(list_distance(a.vec, b.vec)) AS total, COUNT(*) AS n
    FROM v a JOIN v b ON TRUE GROUP BY ALL),
  s AS (SELECT vec_id, MAX(CASE WHEN own = other THEN n END) AS n, MAX(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a, MIN(CASE WHEN own <> other THEN mean END) AS b
    FROM pair GROUP BY 1)
  SELECT COUNT(*)::BIGINT AS records, ROUND(AVG(CASE WHEN n = 1 THEN 0 ELSE (b - a) / GREATEST(a, b) END), 6) AS silhouette FROM s""", ("v",))
def silhouette_euclidean(spark, sf_dir):
    return rounded(mt.euclidean_silhouette(fx.vectors(spark, sf_dir).select("vec", F.col("label").alias("prediction")), vector="vec"))


@query("train_and_evaluate")
def train_and_evaluate(spark, sf_dir):
    run = tr.fit_run(fx.drive_day(spark, sf_dir), CFG)
    return rounded(spark.createDataFrame(sorted((k, float(v)) for k, v in run.metrics.items() if v is not None), "metric string, value double"), 4)


@query("score_saved_model")
def score_saved_model(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    folder = fx.shared_folder(spark, f"models-{uuid.uuid4().hex}")
    tr.save_model(tr.fit_run(days, CFG), folder)
    return tr.score(days, tr.load_model(spark, folder))


@query("score_drive")
def score_drive(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    run = tr.fit_run(days, CFG)
    worst = days.filter("failure = 1").agg(F.min("serial_number").alias("s")).first()["s"]
    return tr.score_drive(days, worst, run)


@query("transfer_train")
def transfer_train(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    parts = st.partition_models_by_divergence(days, ["smart_9_raw", "smart_187_raw"])
    near = [r["model"] for r in parts.filter("relevant").collect()]
    windows, _, _, _ = tr.prepare(days, CFG)
    rows = tr.cut_lineage(tr.vectors_of(windows, CFG).select(
        F.concat_ws("|", "serial_number", "date").alias("vec_id"), "vector", F.col("window_label").alias("label"), "model", "is_test"))
    train, test = rows.filter("NOT is_test"), rows.filter("is_test")
    done = tr.transfer_train(train.filter(F.col("model").isin(near)), train.filter(~F.col("model").isin(near)), test, "mlp")
    return rounded(mt.report_metrics(done.predictions), 4)


def _level_sql(number: int, source: str) -> str:
    """Best cuts of a level's nodes (``best``) and the rows below them (``member``), first tree of second-order boosting."""
    return f""", sums{number} AS (SELECT m.node, c.f, c.cut, SUM(CASE WHEN l.v < c.cut THEN 0.5 - m.y ELSE 0 END)::DOUBLE AS gl,
      SUM(CASE WHEN l.v < c.cut THEN 0.25 ELSE 0 END)::DOUBLE AS hl, SUM(0.5 - m.y)::DOUBLE AS g, SUM(0.25)::DOUBLE AS h
    FROM {source} m JOIN long l ON l.id = m.id JOIN places c ON c.f = l.f GROUP BY 1, 2, 3),
  best{number} AS (SELECT node, f, cut, gain FROM (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM sums{number}
      WHERE hl >= 1 AND h - hl >= 1) WHERE gain > 1e-6 QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) = 1),
  member{number + 1} AS (SELECT m.id, m.y, 2 * m.node + CASE WHEN l.v < b.cut THEN 1 ELSE 2 END AS node
    FROM {source} m JOIN best{number} b ON b.node = m.node JOIN long l ON l.id = m.id AND l.f = b.f)"""


view("drive_fact", """SELECT serial_number AS id, MAX(failure)::DOUBLE AS y, [MAX(smart_187_raw), SUM(smart_5_raw), COUNT(*)::DOUBLE, MIN(smart_197_raw)] AS x
  FROM drive_day GROUP BY 1""", ("drive_day",))


def drive_facts(spark, sf_dir):
    """Per drive four numbers and whether it failed."""
    days = fx.drive_day(spark, sf_dir).groupBy("serial_number").agg(
        F.max("failure").alias("label"), F.array(F.max("smart_187_raw"), F.sum("smart_5_raw"), F.count(F.lit(1)).cast("double"), F.min("smart_197_raw")).alias("x"))
    return days.select(F.col("serial_number").alias("vec_id"), array_to_vector("x").alias("vector"), "label")


@query("boosted_tree_nodes", f""", long AS (SELECT id, UNNEST(x) AS v, generate_subscripts(x, 1) - 1 AS f FROM drive_fact),
  places AS (SELECT DISTINCT f, v AS cut FROM long QUALIFY v > MIN(v) OVER (PARTITION BY f)),
  member0 AS (SELECT id, y, 0 AS node FROM drive_fact){_level_sql(0, "member0")}{_level_sql(1, "member1")},
  low AS (SELECT * FROM best1 WHERE gain >= 0.1), top AS (SELECT * FROM best0 WHERE gain >= 0.1 OR EXISTS (FROM low)),
  kept AS (SELECT * FROM top UNION ALL SELECT * FROM low),
  alive AS (SELECT id, y, node FROM member0 UNION ALL SELECT id, y, node FROM member1 WHERE EXISTS (FROM top)
    UNION ALL SELECT id, y, node FROM member2 WHERE (node - 1) // 2 IN (SELECT node FROM low)),
  total AS (SELECT node, SUM(0.5 - y)::DOUBLE AS g, SUM(0.25)::DOUBLE AS h FROM alive GROUP BY 1)
  SELECT t.node::BIGINT AS node, COALESCE(k.f, -1)::BIGINT AS feature, k.cut, t.g, t.h, CASE WHEN k.f IS NULL THEN ROUND(-0.1 * t.g / (t.h + 1), 9) END AS weight
  FROM total t LEFT JOIN kept k ON k.node = t.node""", ("drive_fact",))
def boosted_tree_nodes(spark, sf_dir):
    rows = fr.stored(drive_facts(spark, sf_dir), None)
    found = fr.tree_table(fr.BoostedTrees(maxIter=1, maxDepth=2, maxBins=4096).boost(rows))
    table = spark.createDataFrame([r[1:] for r in found], "node long, feature long, cut double, g double, h double, weight double")
    return table.withColumns({"feature": F.coalesce("feature", F.lit(-1)), "weight": F.round("weight", 9)})


_TREES, _LEVELS = 4, 3


def _drawn_sql(level: int) -> str:
    """Drawn cuts and class counts of the nodes of one level, and the rows below them."""
    return f""", span{level} AS (SELECT m.tree, m.node, l.f, MIN(l.v) AS lo, MAX(l.v) AS hi, md5('42|' || m.tree || '|' || m.node || '|' || l.f) AS h
    FROM member{level} m JOIN long l ON l.id = m.id GROUP BY 1, 2, 3 HAVING MIN(l.v) < MAX(l.v) AND MIN(m.y) < MAX(m.y)),
  offer{level} AS (SELECT tree, node, f, rank, CASE WHEN spot < hi THEN spot ELSE lo END AS cut FROM (
    SELECT *, lo + (hi - lo) * (CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS spot,
      ROW_NUMBER() OVER (PARTITION BY tree, node ORDER BY CAST('0x' || substr(h, 1, 8) AS BIGINT), f) AS rank FROM span{level}) WHERE rank <= 8),
  side{level} AS (SELECT o.tree, o.node, o.f, o.cut, o.rank, SUM((l.v <= o.cut AND m.y = 0)::INT)::DOUBLE AS l0, SUM((l.v <= o.cut AND m.y = 1)::INT)::DOUBLE AS l1,
    SUM((l.v > o.cut AND m.y = 0)::INT)::DOUBLE AS r0, SUM((l.v > o.cut AND m.y = 1)::INT)::DOUBLE AS r1
    FROM offer{level} o JOIN member{level} m ON m.tree = o.tree AND m.node = o.node JOIN long l ON l.id = m.id AND l.f = o.f GROUP BY ALL),
  split{level} AS (SELECT tree, node, f, cut FROM side{level}
    QUALIFY ROW_NUMBER() OVER (PARTITION BY tree, node ORDER BY (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1) DESC, rank) = 1),
  member{level + 1} AS (SELECT m.tree, m.id, m.y, 2 * m.node + CASE WHEN l.v <= s.cut THEN 1 ELSE 2 END AS node
    FROM member{level} m JOIN split{level} s ON s.tree = m.tree AND s.node = m.node JOIN long l ON l.id = m.id AND l.f = s.f)"""


@query("extra_trees_nodes", f""", long AS (SELECT vec_id AS id, UNNEST(vec) AS v, generate_subscripts(vec, 1) - 1 AS f FROM v),
  member0 AS (SELECT t.tree, vec_id AS id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, 0 AS node FROM v, (SELECT UNNEST(range({_TREES})) AS tree) t)
  {"".join(_drawn_sql(i) for i in range(_LEVELS))},
  every AS ({" UNION ALL ".join(f"SELECT * FROM member{i}" for i in range(_LEVELS + 1))}),
  split AS ({" UNION ALL ".join(f"SELECT * FROM split{i}" for i in range(_LEVELS))})
  SELECT e.tree::BIGINT AS tree, e.node::BIGINT AS node, COALESCE(s.f, -1)::BIGINT AS feature, s.cut, SUM((y = 0)::INT)::DOUBLE AS n0, SUM((y = 1)::INT)::DOUBLE AS n1
  FROM every e LEFT JOIN split s ON s.tree = e.tree AND s.node = e.node GROUP BY ALL""", ("v",))
def extra_trees_nodes(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).select(array_to_vector("vec").alias("vector"), F.col("positive").alias("label"))
    rows = fr.stored(v, None)
    found = fr.node_table(fr.ExtraTrees(numTrees=_TREES, maxDepth=_LEVELS).grow(rows, len(rows.first()["x"])))
    return spark.createDataFrame(found, "tree long, node long, feature long, cut double, n0 double, n1 double").withColumn("feature", F.coalesce("feature", F.lit(-1)))

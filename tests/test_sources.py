import datetime as dt

import pytest
from pyspark.sql import functions as F

from spindlescope.config import CRITICAL_COLUMNS, PRESETS, RunConfig
from spindlescope.operators import selection as sel
from spindlescope.sources import snapshots as snap
from spindlescope.sources import stages


@pytest.fixture
def folder(tmp_path):
    files = {
        "2022/2022-12-31.csv": "date,serial_number,model,capacity_bytes,failure,smart_5_raw,smart_22_raw\n2022-12-31,A,ST1,10,0,1,7\n",
        "2023/2023-02-01.csv": "date,serial_number,model,capacity_bytes,failure,smart_5_raw,smart_9_normalized\n"
                               "2023-02-01,A,ST1,10,0,,100\n2023-02-01,B,HGST X,10,1,NaN,99\n",
        "2023/2023-08-01.csv": "date,serial_number,model,capacity_bytes,failure,smart_5_raw,smart_22_raw\n2023-08-01,B,HGST X,10,0,3,8\n",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return f"{tmp_path}/*/*.csv"


def test_headers_that_differ_are_stacked_by_name(spark, folder):
    df = snap.read_snapshots(spark, folder)
    assert set(df.columns) == {"date", "serial_number", "model", "capacity_bytes", "failure", "smart_5_raw", "smart_22_raw", "smart_9_normalized"}
    got = {(r["serial_number"], r["date"]): r for r in df.collect()}
    assert len(got) == 4
    assert got[("B", dt.date(2023, 2, 1))]["smart_5_raw"] is None and got[("B", dt.date(2023, 2, 1))]["smart_9_normalized"] == 99.0
    assert got[("A", dt.date(2022, 12, 31))]["smart_22_raw"] == 7.0
    assert dict(df.dtypes)["failure"] == "int" and dict(df.dtypes)["date"] == "date"


def test_years_quarters_and_columns_prune_before_reading(spark, folder):
    df = snap.read_snapshots(spark, folder, years=[2023], quarters=["Q1"], columns="raw")
    assert df.count() == 2 and "smart_9_normalized" not in df.columns
    assert len(df.inputFiles()) == 1
    with pytest.raises(FileNotFoundError):
        snap.read_snapshots(spark, folder, years=[2019])


def test_nonstandard_attributes_go(spark, folder):
    assert "smart_22_raw" not in snap.drop_nonstandard_smart(snap.read_snapshots(spark, folder)).columns


def test_presets_have_the_published_sizes():
    assert len(PRESETS["total_features"]) == 4 + 19 and len(PRESETS["iSTEP"]) == 4 + 13 and len(CRITICAL_COLUMNS) == 18


def test_finished_stage_is_not_built_again(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert stages.materialize(spark, str(tmp_path), "imported", RunConfig().digest("x"), build).count() == 3
    assert len(calls) == 1
    (tmp_path / f"imported-{RunConfig().digest('x')}" / "_SUCCESS").unlink()
    stages.materialize(spark, str(tmp_path), "imported", RunConfig().digest("x"), build)
    assert len(calls) == 2


def test_config_survives_json():
    cfg = RunConfig(years=("2022", "2023"), models="A, B", over_ratio=0.5)
    assert RunConfig.from_json(cfg.to_json()) == cfg
    assert cfg.digest() != RunConfig().digest()


def test_model_lists_are_trimmed_and_vendors_follow_prefixes(spark):
    names = ["ST1", "HGST X", "Hitachi Y", "TOSHIBA Z", "WDC W", "Other", "hgst"]
    df = spark.createDataFrame([(n,) for n in names], "model string")
    assert sel.filter_models(df, " ST1 ,WDC W,").count() == 2
    assert sel.filter_manufacturer(df, "custom", "Other").count() == 1
    got = {r["model"]: r["vendor"] for r in sel.assign_vendor(df).collect()}
    assert got == {"ST1": "Seagate", "HGST X": "HGST", "Hitachi Y": "Hitachi", "TOSHIBA Z": "Toshiba", "WDC W": "WDC", "Other": "Unknown", "hgst": "Unknown"}


def test_sparse_limit_is_a_share_of_all_rows(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 45, 1).alias("at"), F.when(F.col("id") < 44, 1).alias("below"))
    assert sel.drop_sparse_columns(df).columns == ["id", "at"]
    assert sel.drop_null_columns(df).columns == ["id"]


def test_year_choice_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("date_add(DATE'2023-12-27', cast(id AS int)) AS date", "id").write.parquet(str(tmp_path / "days"))
    cut = snap.prune_days(spark.read.parquet(str(tmp_path / "days")), years=[2024], quarters=["Q1"])
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2024-01-01)" in plan and "LessThanOrEqual(date,2024-03-31)" in plan and cut.count() == 5


def test_headers_are_read_in_tasks_with_quotes(spark, tmp_path):
    plain = "date,serial_number,model,capacity_bytes,failure,smart_5_raw\n"
    files = {"2023-01-01.csv": plain + "2023-01-01,A,ST1,10,0,1\n" * 500,
             "2023-01-02.csv": '\ufeff"date","serial_number","model","capacity_bytes","failure","smart_5_raw"\r\n2023-01-02,A,ST1,10,0,2\r\n',
             "2023-01-03.csv": 'date,serial_number,model,capacity_bytes,failure,"smart_9, hours"\n2023-01-03,"B, x",ST1,10,0,3\n',
             "2023-01-04.csv": "", "2023-01-05.csv": "\n"}
    folder = tmp_path / "a day"
    folder.mkdir()
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())
    groups = snap._headers(spark, [f"file:{folder}/{name}" for name in files])
    assert {h: [p.rsplit("/", 1)[1] for p in paths] for h, paths in groups.items()} == {
        tuple(plain.strip().split(",")): ["2023-01-01.csv", "2023-01-02.csv"],
        ("date", "serial_number", "model", "capacity_bytes", "failure", "smart_9, hours"): ["2023-01-03.csv"]}
    df = snap.read_snapshots(spark, f"{folder}/*.csv")
    assert df.count() == 502 and df.where("smart_5_raw = 2").count() == 1
    assert [(r["serial_number"], r["smart_9, hours"]) for r in df.where("date = '2023-01-03'").collect()] == [("B, x", 3.0)]

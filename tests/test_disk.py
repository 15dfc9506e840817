"""What is written in several steps: the retained log, published models, the split intake."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cvengine.plans import modeling
from cvengine.plans.medians import MedianImputer, MedianModel
from cvengine.sources import generators, published, schemas
from cvengine.sources.retained_log import RetainedLog
from cvengine.streaming import action_log


def entries(spark, first, last):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "view", {"k": "1"}, "s", f"{i:04d}") for i in range(first, last)]
    return spark.createDataFrame(rows, schemas.ACTION)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_log_keeps_the_newest(spark, tmp_path):
    log = RetainedLog(spark, str(tmp_path), schemas.ACTION, keep=30)
    assert log.read().count() == 0
    log.append(entries(spark, 0, 50))
    log.compact()
    assert log.stored_rows() == 30
    log.append(entries(spark, 50, 60))
    assert ids(log.read()) == [f"{i:04d}" for i in range(59, 29, -1)]
    log.compact()
    log.clean()
    assert log.stored_rows() == 30
    assert ids(log.read()) == [f"{i:04d}" for i in range(59, 29, -1)]


def test_killed_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    log = RetainedLog(spark, str(tmp_path), schemas.ACTION, keep=10)
    log.append(entries(spark, 0, 8))
    log.compact()
    log.append(entries(spark, 8, 12))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr("cvengine.sources.retained_log.announce", killed)
        with pytest.raises(KeyboardInterrupt):
            log.compact()
    # an announcement that was begun and not finished is not read either
    (tmp_path / "announced" / f"{2:012d}" / "_temporary").mkdir(parents=True)
    log.append(entries(spark, 12, 13))
    want = [f"{i:04d}" for i in range(12, 2, -1)]
    assert ids(log.read()) == want
    log.compact()
    assert ids(log.read()) == want and log.stored_rows() == 10


def test_append_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    log = RetainedLog(spark, str(tmp_path), schemas.ACTION, keep=10)
    log.append(entries(spark, 0, 5))
    real = published.announce

    def late(*args):
        log.append(entries(spark, 5, 7))
        real(*args)

    with monkeypatch.context() as patch:
        patch.setattr("cvengine.sources.retained_log.announce", late)
        log.compact()
    assert ids(log.read()) == [f"{i:04d}" for i in range(6, -1, -1)]
    log.clean()
    assert ids(log.read()) == [f"{i:04d}" for i in range(6, -1, -1)]


def test_only_one_of_two_writers_publishes(spark, tmp_path):
    published.announce(spark, str(tmp_path / "v"), 1, {"a": 1})
    with pytest.raises(Exception, match="(?i)exists"):
        published.announce(spark, str(tmp_path / "v"), 1, {"a": 2})
    assert published.latest(spark, str(tmp_path / "v")) == (1, {"a": 1})


@pytest.fixture(scope="module")
def model(spark):
    frame = generators.sample_customers(spark, 120, "2024-06-01").drop("invoice_date")
    frame = frame.withColumn("predicted_clv", F.col("total_purchases") * F.col("avg_order_value"))
    columns = modeling.feature_columns(frame)
    config = modeling.TrainConfig(models=("Linear_Regression",))
    return modeling.train_models(modeling.model_input(frame, columns, "predicted_clv"), columns, config)


def test_half_written_version_is_not_read(spark, tmp_path, model, monkeypatch):
    path = str(tmp_path / "model")
    with pytest.raises(ValueError, match="no model"):
        modeling.load_model(spark, path)
    assert modeling.save_model(model, spark, path) == 1

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr("cvengine.plans.modeling.announce", killed)
        with pytest.raises(KeyboardInterrupt):
            modeling.save_model(model, spark, path)
    assert modeling.load_model(spark, path).performance == json.loads(json.dumps(model.performance))
    assert modeling.save_model(model, spark, path) == 2


def test_damaged_version_is_refused(spark, tmp_path, model):
    path = tmp_path / "model"
    modeling.save_model(model, spark, str(path))
    part = next(p for p in path.rglob("part-*.parquet") if "parts" in str(p))
    part.write_bytes(part.read_bytes()[:-1])
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="damaged"):
        modeling.load_model(spark, str(path))


@pytest.mark.parametrize("cell_rows", [1000, 5])
def test_median_stage(spark, tmp_path, cell_rows):
    rows = [(float(v), None if v % 3 == 0 else float(v * v)) for v in range(20)] + [(float("nan"), float("inf")), (None, -1.0)]
    df = spark.createDataFrame([(*r, None) for r in rows], "a double, b double, c double")
    fitted = MedianImputer(["a", "b", "c"], ["a2", "b2", "c2"], cell_rows).fit(df)
    squares = sorted([float(v * v) for v in range(20) if v % 3] + [-1.0])
    want = [9.5, (squares[6] + squares[7]) / 2 if len(squares) % 2 == 0 else squares[len(squares) // 2], 0.0]
    assert fitted.getMedians() == want
    fitted.write().save(str(tmp_path / "stage"))
    loaded = MedianModel.load(str(tmp_path / "stage"))
    assert loaded.getMedians() == want
    out = loaded.transform(df).select("a2", "b2", "c2").collect()
    assert tuple(out[20]) == (9.5, want[1], 0.0) and tuple(out[21]) == (9.5, -1.0, 0.0) and tuple(out[4]) == (4.0, 16.0, 0.0)


def line(i, minute, action="view"):
    return json.dumps({"timestamp": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "action": action, "id": str(i)})


def test_split_intake_is_whole_and_repeatable(spark, tmp_path):
    source, sink, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    (source / "a.json").write_text("\n".join([line(1, 600), line(2, 610), line(1, 605), "{no json", line(3, 620, None)]))
    take = lambda: action_log.split_intake(spark, str(source), sink, progress, "1 hour")
    got = {(r["kind"], r["id"]) for r in take().collect()}
    assert got == {("taken", "1"), ("taken", "2"), ("repeated", "1"), ("malformed", None), ("malformed", "3")}
    (source / "b.json").write_text("\n".join([line(2, 610), line(4, 500), line(5, 700), line(5, 700)]))
    rows = take().collect()
    second = sorted((r["kind"], r["id"]) for r in rows if r["batch"] == 1)
    assert second == [("late", "4"), ("repeated", "2"), ("repeated", "5"), ("taken", "5")]
    assert len(rows) == 9
    # run the second batch again as after a crash before its commit
    (tmp_path / "progress" / "commits" / "1").unlink()
    (tmp_path / "progress" / "commits" / ".1.crc").unlink(missing_ok=True)
    again = take().collect()
    assert sorted((r["kind"], r["id"] or "") for r in again) == sorted((r["kind"], r["id"] or "") for r in rows)


def test_split_intake_without_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    parts = action_log.split_intake(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert parts.count() == 0 and "kind" in parts.columns


def test_staging_scope_deletes_its_tables(spark):
    import os

    from cvengine.session import stage, stage_bucketed, staging

    def place(df):
        return df.inputFiles()[0].split("://")[-1].removeprefix("file:").rsplit("/", 1)[0]

    kept = stage(spark.range(5))
    with staging(spark):
        inner, bucketed = stage(spark.range(3)), stage_bucketed(spark.range(9), "id")
        inside = [place(inner), place(bucketed)]
        assert all(map(os.path.exists, inside)) and bucketed.count() == 9
    assert not any(map(os.path.exists, inside)) and kept.count() == 5
    assert "Exchange" not in stage_bucketed(spark.range(9), "id").groupBy("id").count()._jdf.queryExecution().executedPlan().toString()

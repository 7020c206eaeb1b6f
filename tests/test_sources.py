"""Sources, sinks and the manifest stream on files."""

from __future__ import annotations

import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks import session
from gaugeworks.operators import gate, jobs
from gaugeworks.sources import lists, records
from gaugeworks.streaming import manifest


def test_records(spark, tmp_path):
    good = {"status": "ok", "dataset": "core:a", "protocol": "cv", "model": "m", "seed": 0, "task_type": "binclass", "y_true": [0, 1], "pred": [0.2, 0.7], "metrics": {"auc": 1.0, "ece": float("nan"), "has_predictive_sigma": False}}
    (tmp_path / "core:a(1)__cv__m__seed0.json").write_text(json.dumps(good))
    (tmp_path / "b__cv__m__seed0.json").write_text(json.dumps(good | {"status": "error:X", "metrics": None}, indent=1))
    (tmp_path / "c__cv__m__seed0.json").write_text(json.dumps(good)[:40])
    (tmp_path / "other.json").write_text("{}")
    assert records.units(spark, str(tmp_path)).count() == 3
    (r,) = records.ok_records(spark, str(tmp_path)).collect()
    assert r["metrics"]["auc"] == 1 and r["metrics"]["ece"] is None and r["file"] == "core:a(1)__cv__m__seed0.json"
    assert tuple(records.unreadable(spark, str(tmp_path)).collect()[0]) == (3, 1)
    assert records.predictions(records.ok_records(spark, str(tmp_path))).count() == 2


def test_manifest(spark, tmp_path):
    line = {"unit": "u", "status": "ok", "seed": 1, "started": "2024-01-01T00:00:00Z"}
    (tmp_path / "m.jsonl").write_text(json.dumps(line) + "\n\n" + '{"unit": "v", "stat')
    assert records.manifest(spark, str(tmp_path / "m.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception):
        records.manifest(spark, str(tmp_path / "m.jsonl")).collect()


def test_arrays(spark, tmp_path):
    for fold, n in (("train", 3), ("test", 2)):
        np.save(tmp_path / f"N_{fold}.npy", np.arange(2.0 * n).reshape(n, 2))
        np.save(tmp_path / f"C_{fold}.npy", np.array([["x"]] * n))
        np.save(tmp_path / f"y_{fold}.npy", np.arange(n))
    got = {(r["fold"], r["row"]): (r["num"], r["cat"], r["y"]) for r in records.arrays(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and got["test", 1] == ([2.0, 3.0], ["x"], 1.0)


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"unit": u, "dataset": "core:a", "protocol": "cv", "model": "m", "seed": 0, "status": "ok", "started": "2024-01-01T00:00:00Z", "wall_s": 1.0} for u in ("a", "a", "b")]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    q = manifest.read(spark, str(src)).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 2


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("core", "cv", "m", 0), ("tabred", "temporal", "n", 1)], "family string, protocol string, model string, seed int")
    records.write_records(df, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert "PartitionFilters: [isnotnull(family" in back.where("family = 'core'")._jdf.queryExecution().toString()
    one = spark.createDataFrame([("u", "ok")], "unit string, status string")
    records.append_manifest(one, str(tmp_path / "m"))
    records.append_manifest(one, str(tmp_path / "m"))
    assert records.manifest(spark, str(tmp_path / "m")).count() == 2
    records.write_table(df, str(tmp_path / "t"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2
    records.dump(spark, f"file://{tmp_path}/run_meta.json", {"run_started": "t", "hostname": "h", "units": ["u"], "timeout_s": 5})
    (r,) = records.run_meta(spark, str(tmp_path)).collect()
    assert (r["hostname"], r["units"], r["timeout_s"]) == ("h", ["u"], 5)
    with pytest.raises(Exception):
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "run_meta_1.json").write_text("{")
        records.run_meta(spark, str(tmp_path / "bad")).collect()
    assert records.run_meta(spark, str(tmp_path / "bad"), strict=False).count() == 0
    told = gate.guarded(spark, "A1", lambda: gate.metric_present(records.run_meta(spark, str(tmp_path / "bad")), "timeout_s", "A1")).first()
    assert (told["id"], told["passed"]) == ("A1", False) and told["message"].startswith("unreadable")


def test_id_tables_and_snapshots(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("name,resolved_id,candidate_name,match_type,score,status\na,1,A,exact,1.0,ok\nb,,,,,missing_VERIFY\n")
    assert jobs.unresolved(records.id_table(spark, str(tmp_path / "ids.csv"))).first().asDict() == {"n": 2, "n_ok": 1, "n_missing": 1}
    (tmp_path / "s.json").write_text(json.dumps({"kept": [{"task_id": 3, "dataset_id": 30, "dropped": False}, {"task_id": 2, "dataset_id": 20, "dropped": False}]}))
    s = records.snapshot(spark, str(tmp_path / "s.json")).select("place", F.col("task_id").alias("member"))
    got = jobs.expand("suite", {"resolve": "static_snapshot", "max_datasets": 1}, s)
    assert [r["dataset"] for r in got.collect()] == ["suite:3"] and jobs.expand("x", {}, None) == ["x"]


YAML = """
# a list
family: core_twenty   # renamed
emit_as: core
k: 20
ok: true
none: ~
sizes: [1, 2.5, "a, b"]
map: {a: 1, b: 'it''s'}
datasets:
  - adult
  - "b # not a comment"
nested:
  claims:
    - id: c1
      a: x
      tests: [p, q]
    - id: c2
  empty:
"""


def test_yaml(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    assert lists.minimal(YAML) == yaml.safe_load(YAML) == lists.load(YAML)
    (tmp_path / "c.yaml").write_text(YAML)
    c = lists.config(spark, f"file://{tmp_path}/c.yaml")
    assert lists.config(spark, f"file://{tmp_path}/none.yaml") == {} and [r["member"] for r in lists.members(spark, c).collect()] == ["adult", "b # not a comment"]
    lists.write_subset(spark, f"file://{tmp_path}/sub.yaml", ["b", "a"], {"family": "core_twenty", "emit_as": "core", "k": 2}, ["drawn"])
    assert lists.config(spark, f"file://{tmp_path}/sub.yaml") == {"family": "core_twenty", "emit_as": "core", "k": 2, "datasets": ["a", "b"]}
    lists.write_snapshot(spark, f"file://{tmp_path}/snap.yaml", "suite", "2024-01-01", "0.1", 3, [(5, 50, "x"), (6, 60, "y")])
    snap = lists.config(spark, f"file://{tmp_path}/snap.yaml")
    assert [r["member"] for r in lists.members(spark, snap, "tasks").collect()] == ["5", "6"]
    assert snap["n_tasks_in_suite"] == 3 and snap["n_tasks_after_core_dedup"] == 2 and [t["task_id"] for t in snap["tasks"]] == [5, 6]


def test_reports(spark):
    df = spark.createDataFrame([("A1", True, "fine"), ("ALL", False, "G1"), ("G1", False, "2 left")], "id string, passed boolean, message string")
    assert lists.report(df, "Gate").splitlines()[:3] == ["Gate", "====", "id   passed  message"]
    assert lists.verdict_report(df) == "[PASS] A1   fine\n[FAIL] G1   2 left\nGATE FAILED: G1\n"


def test_a_cluster_needs_a_shared_folder(spark):
    none = SimpleNamespace(get=lambda *_: None)
    of = lambda master: SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master=master, getConf=lambda: none, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(of(master))
    assert session.shared_dir(spark) == session.shared_dir(spark) and session.stored(spark.range(3)).count() == 3


def test_one_array_file_is_read_by_several_tasks(spark, tmp_path):
    import numpy as np

    from gaugeworks.sources import arrays

    folder = tmp_path / "toy:one"
    folder.mkdir()
    x, y = np.arange(700.0).reshape(100, 7), np.array(["a", "bé"] * 50)
    np.save(folder / "N_train.npy", x)
    np.save(folder / "N_val.npy", np.asfortranarray(x))
    np.save(folder / "C_train.npy", y.reshape(-1, 1))
    np.save(folder / "y_train.npy", np.arange(100) % 3)
    np.save(folder / "y_val.npy", y)
    np.save(folder / "N_test.npy", x[:0])
    parts = arrays.read(spark, f"file://{tmp_path}", rows=30)
    assert parts.rdd.getNumPartitions() == 4 + 1 + 4 + 4 + 4
    rows, _ = records.members(spark, str(tmp_path), rows_a_task=30)
    got = {(r["fold"], r["row"]): r for r in rows.collect()}
    assert len(got) == 200 and got["train", 99]["num"] == x[99].tolist() == got["val", 99]["num"]
    assert got["train", 1]["cat"] == ["bé"] and got["train", 5]["y"] == 2 and got["train", 5]["label"] == "2" and got["val", 3]["label"] == "bé" and got["val", 3]["y"] is None
    (tmp_path / "none").mkdir()
    assert arrays.read(spark, f"file://{tmp_path}/none").count() == 0
    np.save(folder / "C_val.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="Python objects"):
        arrays.read(spark, str(tmp_path)).count()

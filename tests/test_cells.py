"""A split's whole way to a record: folders, splits, boosting, searches, records."""

from __future__ import annotations

import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import boosting, cells, pareto, search
from gaugeworks.sources import records


def write(root, name, info, num, cat, y):
    folder = root / name
    folder.mkdir(parents=True)
    n = len(y)
    for fold, at in (("train", slice(0, int(0.64 * n))), ("val", slice(int(0.64 * n), int(0.8 * n))), ("test", slice(int(0.8 * n), n))):
        for kind, a in (("N", num), ("C", cat), ("y", y)):
            if a is not None:
                np.save(folder / f"{kind}_{fold}.npy", a[at])
    if info is not None:
        (folder / "info.json").write_text(json.dumps(info))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Toy folders: several classes, two classes with categories and missing values, a regression with a column target, labels whose info says regression."""
    top = tmp_path_factory.mktemp("folders")
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    write(top, "toy_cls", {"task_type": "multiclass", "n_classes": 3, "openml_id": 111}, x, None, np.digitize(x[:, 0] + x[:, 1], [-0.7, 0.7]))
    num, cat = rng.normal(size=(300, 4)), rng.integers(0, 5, size=(300, 2)).astype(str)
    y = (num[:, 0] + (cat[:, 0] == "3") + rng.normal(scale=0.5, size=300) > 0.5).astype(int)
    num[::17, 1] = np.nan
    write(top, "toy_cat", {"task_type": "binclass", "n_classes": 2}, num, cat, y)
    write(top, "toy_reg", {"task_type": "regression"}, x, None, (x @ np.arange(6.0) + 0.1 * rng.normal(size=300)).reshape(-1, 1) * 50 + 7)
    write(top, "toy_over", {"task_type": "regression"}, num, None, y.astype(np.uint8))
    write(top, "toy_bad", {"task_type": "regression"}, x, None, np.arange(300.0))
    write(top, "toy_bare", None, x, None, np.where(y > 0, "yes", "no"))
    return top


@pytest.fixture(scope="module")
def loaded(spark, root):
    return cells.load(spark, f"file://{root}", "core", (0, 1), {"toy_over": "binclass", "toy_bad": "binclass"})


def test_splits(spark, loaded, root):
    rows, told = (df.toPandas() for df in loaded)
    t = told.set_index(["dataset", "seed"]).loc[lambda d: d.index.get_level_values("seed") == 0].droplevel("seed")
    assert t["task_type"].to_dict() == {"core:toy_cls": "classification", "core:toy_cat": "classification", "core:toy_reg": "regression", "core:toy_over": "classification", "core:toy_bad": "classification", "core:toy_bare": "classification"}
    assert t["n_classes"][["core:toy_cls", "core:toy_over", "core:toy_reg", "core:toy_bare"]].tolist() == [3, 2, 1, 2]
    assert t["task_type_source"]["core:toy_over"] == "dataset_yaml_override" and t["task_type_shipped"]["core:toy_over"] == "regression" and t["task_type_source"]["core:toy_cat"] == "info_json"
    assert t["error"]["core:toy_bad"].startswith("error:ValueError") and t["error"].notna().sum() == 1
    own = rows[(rows["dataset"] == "core:toy_cat") & (rows["seed"] == 0)]
    shares = own["fold"].value_counts(normalize=True)
    assert shares["train"] == pytest.approx(0.64, abs=0.01) and shares["val"] == pytest.approx(0.16, abs=0.01)
    # the training rows have mean 0 and deviation 1, with missing numbers at the mean
    train = np.stack(own[own["fold"] == "train"]["num"])
    assert np.allclose(train.mean(axis=0), 0, atol=1e-9) and np.allclose(train.std(axis=0), 1, atol=1e-9)
    other = rows[(rows["dataset"] == "core:toy_cat") & (rows["seed"] == 1)]
    assert (own.set_index("row")["fold"].sort_index() != other.set_index("row")["fold"].sort_index()).any()
    reg = rows[(rows["dataset"] == "core:toy_reg") & (rows["seed"] == 1) & (rows["fold"] == "train")]
    assert reg["y"].mean() == pytest.approx(0, abs=1e-9) and reg["y"].std(ddof=0) == pytest.approx(1, abs=1e-9)


def test_shipped_folds_stand(spark, root):
    rows, _ = cells.load(spark, f"file://{root}", "tabred", (3,))
    got = rows.where("dataset = 'tabred:toy_reg'").groupBy("fold").count().collect()
    assert {r["fold"]: r["count"] for r in got} == {"train": 192, "val": 48, "test": 60}


def test_splits_are_packed_in_bounded_chunks(loaded, monkeypatch):
    """No row, and no part of a task's input, is a whole split; its rows come back in the seed's order, whatever order the chunks come in."""
    rows = loaded[0].where("dataset = 'core:toy_cat' and seed = 1")
    want = sorted(rows.collect(), key=lambda r: (r["draw"], r["row"]))
    monkeypatch.setattr(cells, "CHUNK", 40)
    blobs = sorted(((r["chunk"], bytes(r["data"])) for r in cells.packed(rows).collect()), reverse=True)
    assert len(blobs) == 8 and max(len(np.load(io.BytesIO(b))["y"]) for _, b in blobs) < 80
    for folds in (records.FOLDS, ["train"]):
        own = [r for r in want if r["fold"] in folds]
        d = cells._unpacked(blobs, folds)
        assert d["row"].tolist() == [r["row"] for r in own] and d["y"].tolist() == [r["y"] for r in own] and d["num"].tolist() == [r["num"] for r in own]
        assert [records.FOLDS[f] for f in d["fold"]] == [r["fold"] for r in own]
        names = sorted({c for r in want for c in r["cat"]})
        assert [[names[c] for c in r] for r in d["cat"]] == [r["cat"] for r in own]
        bins = boosting.binned(d["num"], d["cat"])
        plain = boosting.binned(d["num"], np.array([r["cat"] for r in own]))
        codes = bins.codes(d["num"], d["cat"])
        assert codes.dtype == np.uint8 and (codes == plain.codes(d["num"], np.array([r["cat"] for r in own]))).all()


@pytest.fixture(scope="module")
def got(spark, loaded):
    datasets = ["core:toy_cls", "core:toy_cat", "core:toy_reg"]
    asked = [(d, p, m, 0) for d in datasets for p in ("cv_standard", "matched_hpo") for m in cells.SYSTEMS]
    asked += [("core:toy_cat", "pareto_hpo", "boosted_depth", 0), ("core:toy_reg", "pareto_hpo", "boosted_depth", 0), ("core:toy_reg", "cv_standard", "tabicl", 0), ("core:toy_cat", "cv_standard", "tabicl", 0)]
    asked += [("core:toy_bad", "cv_standard", "boosted_depth", 0), ("core:nowhere", "cv_standard", "boosted_depth", 0), ("core:toy_over", "cv_standard", "boosted_leaves", 1)]
    out = cells.run(spark.createDataFrame(asked, "dataset string, protocol string, model string, seed int"), *loaded, trials=4, batch=2, search_rounds=6, full_rounds=40)
    return {(r["dataset"], r["protocol"], r["model"]): r.asDict(recursive=True) for r in out.collect()}


def test_three_tasks_under_two_protocols(got):
    for (dataset, protocol, model), r in got.items():
        if protocol not in ("cv_standard", "matched_hpo") or model not in cells.SYSTEMS or dataset not in ("core:toy_cls", "core:toy_cat", "core:toy_reg"):
            continue
        assert r["status"] == "ok", r["msg"]
        assert r["gbdt_es"]["full_iter"] == 40 and r["gbdt_es"]["best_iter"] is not None and r["gbdt_es"]["best_iter"] < 40
        assert (r["optimism_gap"] is not None) == (protocol == "matched_hpo")
        if dataset == "core:toy_reg":
            assert r["metrics"]["rmse"] < (0.6 if protocol == "cv_standard" else 1.0) and r["test_score"] == -r["metrics"]["rmse"] and r["proba"] is None and not r["metrics"]["has_predictive_sigma"]
        else:
            assert r["metrics"]["auc"] > (0.75 if protocol == "cv_standard" else 0.65) and len(r["proba"]) == len(r["y_true"]) and len(r["proba"][0]) == r["n_classes"]
            assert r["metrics"]["acc"] == pytest.approx(np.mean([np.argmax(p) == y for p, y in zip(r["proba"], r["y_true"], strict=True)]))
            assert r["proba_max_sum_deviation"] < 1e-9 and not r["proba_renormalised"]
    assert got["core:toy_over", "cv_standard", "boosted_leaves"]["task_type_source"] == "dataset_yaml_override"


def test_cells_that_are_not_fitted_tell_why(got):
    of = lambda *k: got[k]["status"]
    assert of("core:toy_reg", "cv_standard", "tabicl") == "skipped_no_regression" and of("core:toy_cat", "cv_standard", "tabicl") == "skipped_missing_backend:tabicl"
    assert of("core:toy_reg", "pareto_hpo", "boosted_depth") == "skipped_no_pareto_for_regression"
    assert of("core:toy_bad", "cv_standard", "boosted_depth") == "error:ValueError" and of("core:nowhere", "cv_standard", "boosted_depth") == "error:FileNotFoundError"
    assert got["core:toy_reg", "cv_standard", "tabicl"]["y_true"] is None


def test_a_front_of_settings(spark, got):
    r = got["core:toy_cat", "pareto_hpo", "boosted_depth"]
    front = r["pareto_front"]
    assert r["status"] == "ok" and front and all(0 <= p["test_ece"] <= 1 and set(p["params"]) == set(cells.SYSTEMS["boosted_depth"].space) for p in front)
    assert r["metrics"]["acc"] == pytest.approx(max(p["test_acc"] for p in front))
    inner = [(p["inner_acc"], p["inner_ece"]) for p in front]
    assert not any(a[0] >= b[0] and a[1] <= b[1] and a != b for a in inner for b in inner)
    table = spark.createDataFrame([(r["unit"], r["model"], r["protocol"], [{k: p[k] for k in ("params", "inner_acc", "inner_ece", "test_acc", "test_ece", "test_auc")} for p in front])], "unit string, model string, protocol string, pareto_front array<struct<params: map<string,double>, inner_acc: double, inner_ece: double, test_acc: double, test_ece: double, test_auc: double>>")
    told = pareto.per_system(pareto.pooled(table)).first()
    assert told["n_points"] == len(front) and told["front_hypervolume"] > 0


def test_record_is_the_inverse_of_predictions(spark):
    rows = [("a", k, float(k % 2), None, None, [0.4, 0.4] if k == 3 else [0.25, 0.75], None) for k in (4, 3, 2, 1, 0)]
    rows += [("b", k, float(k % 3), None, None, [0.5, 0.5], [0, 2]) for k in range(6)] + [("e", k, float(k % 3), None, None, [0.5, 0.5], None) for k in range(6)]
    rows += [("r", k, float(k), k + 0.5, 0.3, None, None) for k in range(3)]
    p = spark.createDataFrame(rows, "cell string, row long, y double, pred double, sigma double, proba array<double>, ids array<int>")
    c = spark.createDataFrame([("a", "classification", 2, "d", "p", "m", 0), ("b", "classification", 3, "d", "p", "m", 1), ("e", "classification", 3, "d", "p", "m", 4), ("r", "regression", 1, "d", "p", "m", 2), ("none", "regression", 1, "d", "p", "m", 3)], "cell string, task_type string, n_classes int, dataset string, protocol string, model string, seed int")
    out = cells.record(p, c)
    got = {r["cell"]: r for r in out.collect()}
    a = got["a"]
    assert a["y_true"] == [0, 1, 0, 1, 0] and a["proba"][3] == [0.4, 0.4] and a["proba_renormalised"] and a["proba_max_sum_deviation"] == pytest.approx(0.2) and a["notes"] == []
    assert a["metrics"]["log_loss"] == pytest.approx(np.mean([-math.log(x) for x in (0.25, 0.75, 0.25, 0.5, 0.25)]))
    assert got["b"]["proba"][0] == [0.5, 0.0, 0.5] and got["b"]["notes"] == ["proba padded 2->3 (unobserved class)"] and got["e"]["proba"][0] == [0.5, 0.5, 0.0]
    assert got["r"]["metrics"]["rmse"] == pytest.approx(0.5) and got["r"]["pred_sigma"] == [0.3] * 3 and got["r"]["metrics"]["has_predictive_sigma"] and got["r"]["notes"] == []
    assert got["none"]["metrics"] is None and got["none"]["y_true"] is None
    back = records.predictions(out.where("y_true is not null")).join(c.select("cell", "seed"), "seed")
    assert {(r["cell"], r["row"], r["y"], r["pred"]) for r in back.collect()} == {(r[0], r[1], r[2], r[3]) for r in rows}


# ---- boosting


def test_boosting_splits_by_the_best_gain():
    """The first split of one tree against all splits tried one by one."""
    rng = np.random.default_rng(5)
    num, cat = rng.normal(size=(60, 3)).round(1), rng.integers(0, 4, (60, 1)).astype(str)
    y = num[:, 1] + (cat[:, 0] == "2") + 0.1 * rng.normal(size=60)
    bins = boosting.binned(num, cat)
    codes = bins.codes(num, cat)
    for grow in ("depth", "leaves", "symmetric"):
        m = boosting.fit(codes, y, bins.categorical, 1, boosting.Settings(grow, depth=1, leaves=2, rate=1.0, ridge=0.5), 1)
        g = y.mean() - y
        score = lambda s: g[s].sum() ** 2 / (s.sum() + 0.5)
        tried = [num[:, j] <= v for j in range(3) for v in np.unique(num[:, j])[:-1]] + [np.isin(cat[:, 0], own) for own in (["0"], ["1"], ["2"], ["3"], ["0", "1"], ["0", "2"], ["0", "3"])]
        best = max(score(s) + score(~s) for s in tried)
        t = m.rounds[0][0]
        left = t.left[0][codes[:, t.column[0]]]
        assert score(left) + score(~left) == pytest.approx(best)
        assert m.predict(codes)[left] == pytest.approx(np.full(left.sum(), y.mean() - g[left].sum() / (left.sum() + 0.5)))


def test_boosting_edges():
    one = boosting.fit(np.zeros((5, 1), int), np.zeros(5), np.array([False]), 2, boosting.Settings(), 5)
    assert one.predict(np.zeros((2, 1), int))[:, 0] == pytest.approx([1, 1], abs=1e-5)
    none = boosting.fit(np.zeros((4, 0), int), np.arange(4.0), np.zeros(0, bool), 1, boosting.Settings(), 5)
    assert none.predict(np.zeros((2, 0), int)).tolist() == [1.5, 1.5]
    bins = boosting.binned(np.zeros((3, 0)), np.array([["a"], ["b"], ["b"]]))
    assert bins.codes(np.zeros((3, 0)), np.array([["b"], ["zz"], ["a"]]))[:, 0].tolist() == [2, 0, 1]


def test_early_stopping_keeps_the_best_round():
    rng = np.random.default_rng(1)
    x, noise = rng.normal(size=(200, 3)), rng.normal(size=200)
    bins = boosting.binned(x[:100], x[:100, :0].astype(str))
    codes = bins.codes(x, x[:, :0].astype(str))
    y = x[:, 0] + 2 * noise
    m = boosting.fit(codes[:100], y[:100], bins.categorical, 1, boosting.Settings(rate=0.3), 300, (codes[100:], y[100:]), 10)
    assert len(m.rounds) == m.best + 1 < 100
    losses = [np.mean((boosting.Model(m.base, m.rounds[:k], None, True).predict(codes[100:]) - y[100:]) ** 2) for k in range(1, len(m.rounds) + 1)]
    assert int(np.argmin(losses)) == m.best


# ---- searches


SPACE = {"a": search.Range(1e-3, 0.3, log=True), "b": search.Range(3, 10, whole=True), "c": search.Range(0.5, 1.0)}


def test_parzen_beats_a_grid_and_chance():
    value = lambda p: -(math.log(p["a"] / 0.03) ** 2) - (p["b"] - 7) ** 2 / 4 - 10 * (p["c"] - 0.8) ** 2
    grid = max(value({"a": a, "b": b, "c": c}) for a in np.geomspace(1e-3, 0.3, 5) for b in (3, 5, 8, 10) for c in np.linspace(0.5, 1, 5))
    found, chance = [], []
    for seed in range(5):
        rng, trials = np.random.default_rng(seed), []
        while len(trials) < 100:
            new = search.parzen(SPACE, trials, rng, 10)
            assert all(1e-3 <= p["a"] <= 0.3 and p["b"] in range(3, 11) and 0.5 <= p["c"] <= 1 for p in new)
            trials += [(p, value(p)) for p in new]
        found.append(max(v for _, v in trials))
        chance.append(max(value(search.random(SPACE, rng)) for _ in range(100)))
    assert min(found) > grid and np.mean(found) > np.mean(chance)


def test_fronts_and_crowding():
    rng = np.random.default_rng(2)
    points = rng.random((40, 2)).round(1)
    rank = search.fronts(points)
    beats = lambda a, b: a[0] >= b[0] and a[1] <= b[1] and tuple(a) != tuple(b)
    for k, p in enumerate(points):
        above = [rank[j] for j, q in enumerate(points) if beats(q, p)]
        assert rank[k] == (max(above) + 1 if above else 0)
    line = np.array([[0.0, 0.0], [0.1, 0.1], [0.5, 0.5], [1.0, 1.0]])
    assert search.fronts(line).tolist() == [0, 0, 0, 0] and search.crowding(line, np.zeros(4, int)).tolist() == pytest.approx([math.inf, 1.0, 1.8, math.inf])


def test_generations_approach_the_front():
    aims = lambda p: (-((p["c"] - 0.6) ** 2) - math.log(p["a"] / 0.03) ** 2, (p["c"] - 0.9) ** 2 + math.log(p["a"] / 0.03) ** 2)
    rng, trials = np.random.default_rng(1), []
    for _ in range(8):
        trials += [(p, aims(p)) for p in search.evolved(SPACE, trials, rng, 20)]
    value = np.array([v for _, v in trials])
    assert value[-20:, 0].mean() > value[:20, 0].mean() and value[-20:, 1].mean() < value[:20, 1].mean()


def test_proposals_repeat_and_differ_by_cell(spark):
    c = spark.createDataFrame([("x", "boosted_depth", 0), ("y", "boosted_depth", 1)], "cell string, model string, seed int")
    spaces = {"boosted_depth": cells.SYSTEMS["boosted_depth"].space}
    first = search.proposed(c, None, spaces, 0, 12)
    rows = sorted(map(tuple, first.collect()))
    assert rows == sorted(map(tuple, first.repartition(3).collect())) and len({r[3] for r in rows}) == 24
    done = first.withColumns({"value": F.col("trial").cast("double"), "error": F.lit(None).cast("double")})
    after = search.proposed(c, done, spaces, 12, 2)
    assert after.count() == 4 and search.best(done).count() == 2 and {r["inner_score"] for r in search.best(done).collect()} == {11.0}

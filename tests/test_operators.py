"""Operators on hand-made fixtures and properties."""

from __future__ import annotations

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import scalars
from gaugeworks.operators import artefacts, charts, gate, grid, jobs, metrics, models, pareto, preprocess, ranks, resample, significance, splits
from gaugeworks.sources import records


def one(df):
    (r,) = df.collect()
    return r


def test_auc_with_ties_and_one_class(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.5), ("a", 0, 0.1), ("b", 1, 0.3), ("b", 1, 0.4)]
    got = {r["k"]: r for r in metrics.ranking(spark.createDataFrame(rows, "k string, y int, score double"), ["k"]).collect()}
    assert got["a"]["auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert got["a"]["pr_auc"] == pytest.approx((0.5 + 2 / 3) / 2)
    assert got["b"]["auc"] is None and got["b"]["pr_auc"] == 1


def test_auc_is_antisymmetric(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), rng.randrange(5) / 4) for _ in range(60)]
    df = spark.createDataFrame(rows, "y int, score double").withColumn("k", F.lit(1))
    a = one(metrics.ranking(df, ["k"]))["auc"]
    b = one(metrics.ranking(df.withColumn("score", -F.col("score")), ["k"]))["auc"]
    assert a + b == pytest.approx(1)


def test_bins_are_left_open(spark):
    edge = 11 * (1.0 / 15)
    rows = [(0.0,), (1e-300,), (edge,), (math.nextafter(edge, 1),), (1.0,)]
    got = [r["b"] for r in spark.createDataFrame(rows, "v double").select(scalars.bin_of(F.col("v"), 15).alias("b")).collect()]
    assert got == [None, 0, 10, 11, 14]


def test_erf_normal_chi2(spark):
    xs = [(x / 4,) for x in range(-24, 25)]
    for r in spark.createDataFrame(xs, "x double").select("x", scalars.erf(F.col("x")).alias("e"), scalars.normal_tail(F.abs("x")).alias("t")).collect():
        assert r["e"] == pytest.approx(math.erf(r["x"]), abs=2e-12)
        assert r["t"] == pytest.approx(math.erfc(abs(r["x"]) / math.sqrt(2)) / 2, rel=1e-8)
    cases = [(3.0, 2, math.exp(-1.5)), (3.0, 4, math.exp(-1.5) * 2.5), (4.0, 1, math.erfc(math.sqrt(2))), (5.0, 3, math.erfc(math.sqrt(2.5)) + math.sqrt(10 / math.pi) * math.exp(-2.5))]
    for x, df, want in cases:
        assert one(spark.range(1).select(scalars.chi2_tail(F.lit(x), F.lit(df)).alias("p")))["p"] == pytest.approx(want, rel=1e-8)


def test_crps_against_integration(spark):
    y, mu, s = 1.3, 0.4, 0.7
    step, cdf = 1e-3, lambda v: (1 + math.erf((v - mu) / s / math.sqrt(2))) / 2
    want = sum((cdf(v := -8 + k * step) - (v >= y)) ** 2 for k in range(16000)) * step
    assert one(spark.range(1).select(metrics.crps(F.lit((y - mu) / s), F.lit(s)).alias("c")))["c"] == pytest.approx(want, abs=1e-3)


def test_ranks_sum_and_ties(spark):
    rows = [("a", "d", 3.0), ("b", "d", 3.0), ("c", "d", 1.0), ("a", "e", 1.0), ("b", "e", 2.0), ("c", "e", 3.0)]
    got = ranks.average_rank(spark.createDataFrame(rows, "model string, dataset string, score double"), ["dataset"]).collect()
    assert {(r["model"], r["dataset"]): r["rank"] for r in got} == {("a", "d"): 1.5, ("b", "d"): 1.5, ("c", "d"): 3.0, ("a", "e"): 3.0, ("b", "e"): 2.0, ("c", "e"): 1.0}


@pytest.mark.parametrize("gaps,want", [
    ([], (list("abcd"), list("wxyz"))), ([("a", "w"), ("a", "x")], (list("bcd"), list("wxyz"))), ([("a", "w"), ("b", "w")], (list("abcd"), list("xyz"))), ([("a", "w")], (list("bcd"), list("wxyz"))),
])
def test_greedy_block(gaps, want):
    assert ranks.greedy_block({(m, d) for m in "abcd" for d in "wxyz"} - set(gaps)) == want


def test_greedy_block_of_three_models_drops_datasets():
    assert ranks.greedy_block({(m, d) for m in "abc" for d in "xy"} - {("a", "x")}) == (list("abc"), ["y"])


def wilcoxon_brute(d):
    d = [x for x in d if x]
    order = sorted(abs(x) for x in d)
    w = sum(order.index(abs(x)) + 1 for x in d if x > 0)
    n = len(d)
    sums = [sum(k + 1 for k in range(n) if m >> k & 1) for m in range(1 << n)]
    up, down = (sum(s >= w for s in sums) / 2**n, sum(s <= w for s in sums) / 2**n)
    return w, min(1, 2 * min(up, down)), up


def test_wilcoxon_exact_normal_and_empty(spark):
    exact = [0.5, -1.0, 2.0, 3.0, -4.0, 5.0, 6.5]
    rows = [("e", x) for x in exact] + [("z", 0.0), ("z", 0.0)] + [("t", x) for x in (1.0, 1.0, -1.0, 2.0, 0.0, 3.0)]
    got = {r["k"]: r for r in significance.wilcoxon(spark.createDataFrame(rows, "k string, d double"), ["k"]).collect()}
    w, two, up = wilcoxon_brute(exact)
    assert (got["e"]["w_plus"], got["e"]["p_two"], got["e"]["p_greater"]) == (w, pytest.approx(two), pytest.approx(up))
    assert got["z"]["p_two"] == 1 and got["z"]["n_nonzero"] == 0
    mean, sd = 5 * 6 / 4, math.sqrt((5 * 6 * 11 - (27 - 3) / 2) / 24)
    assert got["t"]["p_greater"] == pytest.approx(math.erfc((13 - mean) / sd / math.sqrt(2)) / 2)


def test_holm_is_monotone_and_no_smaller(spark):
    rows = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.03), ("e", 1.0)]
    got = significance.holm(spark.createDataFrame(rows, "id string, p double"), "p", ["id"]).orderBy("p", "id").collect()
    assert [r["holm_p"] for r in got] == pytest.approx([0.05, 0.12, 0.12, 0.12, 1.0])
    assert all(r["holm_p"] >= r["p"] for r in got)


def test_kendall_exact_and_ties(spark):
    rows = [("a", 1.0, 1.0), ("b", 2.0, 3.0), ("c", 3.0, 2.0), ("d", 4.0, 4.0)]
    r = one(significance.kendall(spark.createDataFrame(rows, "model string, x double, y double"), [], "x", "y"))
    assert (r["tau"], r["tau_p"]) == (pytest.approx(4 / 6), pytest.approx(8 / 24))
    tied = one(significance.kendall(spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 2.0, 3.0)], "model string, x double, y double"), [], "x", "y"))
    assert tied["tau"] == pytest.approx(2 / math.sqrt(2 * 3))


def test_friedman_needs_three(spark):
    rows = [(m, d, float(ord(m))) for m in "ab" for d in "xyz"]
    assert one(significance.friedman(spark.createDataFrame(rows, "model string, dataset string, score double")))["status"] == "insufficient_block"
    with pytest.raises(ValueError):
        significance.nemenyi_quantile(F.lit(3), 0.01)


def test_bootstrap_is_deterministic(spark):
    rows = [("a", f"d{k}", float(k)) for k in range(8)]
    df = spark.createDataFrame(rows, "g string, dataset string, v double")
    a, b = (one(resample.mean_interval(x, ["g"], "v", b=200)) for x in (df, df.repartition(3)))
    assert a == b and a["lo"] <= a["mean"] <= a["hi"]


def test_front_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"d{k % 3}", k, rng.randrange(6) / 5, rng.randrange(6) / 5) for k in range(60)]
    got = {r["i"] for r in pareto.front(spark.createDataFrame(rows, "dataset string, i int, acc double, ece double"), ["dataset"]).collect()}
    want = {i for d, i, a, e in rows if not any(x == d and b >= a and f <= e and (b > a or f < e) for x, _, b, f in rows)}
    assert got == want


def test_hypervolume(spark):
    df = spark.createDataFrame([(0.9, 0.3), (0.5, 0.1), (0.4, 0.2), (0.95, 2.0)], "acc double, ece double")
    assert one(pareto.hypervolume(df, [], F.lit(1.0)))["hypervolume"] == pytest.approx(0.7 * 0.9 + 0.2 * 0.5)


def test_quota_and_draw(spark):
    rows = [("a", f"a{k}") for k in range(5)] + [("b", f"b{k}") for k in range(3)] + [("c", "c0")]
    df = spark.createDataFrame(rows, "stratum string, name string")
    assert {r["stratum"]: r["quota"] for r in splits.quota(df, "stratum", 4).collect()} == {"a": 2, "b": 1, "c": 1}
    assert splits.draw(df, "stratum", "name", 4, 1).count() == 4


def test_preprocess(spark):
    df = spark.createDataFrame([("train", 1.0, "x", None), ("train", None, None, None), ("train", 3.0, "y", None), ("test", None, "new", 1.0)], "fold string, v double, c string, w double")
    got = preprocess.impute_standardise(df, ["v", "w"])
    assert "w" not in got.columns
    assert [r["v"] for r in got.collect()] == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5), 0])
    codes = {(r["fold"], r["c"]): r["c_code"] for r in preprocess.ordinal(df, "c").collect()}
    assert codes == {("train", "x"): 1, ("train", None): 0, ("train", "y"): 2, ("test", "new"): -1}
    assert [r["c_onehot"] for r in preprocess.onehot(df, "c").where("c = 'new'").collect()] == [[0, 0, 0]]


def test_gate_clean_and_broken(spark):
    clean = spark.createDataFrame([("core:a", "cv", "m", 0, "ok"), ("core:b", "cv", "m", 1, "ok")], "dataset string, protocol string, model string, seed int, status string")
    broken = clean.unionByName(spark.createDataFrame([("core:c", "cv", "n", 0, "error:X")], clean.schema))
    none = spark.createDataFrame([], "model string, dataset string, protocol string")
    allow = spark.createDataFrame([("n", None, None)], none.schema)
    manifest = clean.withColumn("unit", F.concat_ws("__", "dataset", "model"))
    failed = manifest.withColumn("status", F.when(F.col("model") == "m", "timeout").otherwise("ok"))
    assert one(gate.documented(manifest, clean, none))["passed"] and not one(gate.documented(manifest, broken, none))["passed"] and one(gate.documented(manifest, broken, allow))["passed"]
    assert not one(gate.documented(failed, clean, allow))["passed"]
    assert one(gate.alive(clean))["passed"] and not one(gate.alive(broken))["passed"]
    assert one(gate.backends(clean))["passed"]
    got = {r["id"]: r for r in gate.verdict(gate.documented(manifest, broken, none), gate.backends(clean)).collect()}
    assert not got["ALL"]["passed"] and got["ALL"]["message"] == "G1"
    assert not one(gate.config(spark, {"x": 1, "allowlist": [{"model": "a"}]}, {"allowlist"}, {"F1"}))["passed"]


def test_grid_and_shards_cover(spark):
    ax = lambda n, v, t="string": spark.createDataFrame([(x,) for x in v], f"{n} {t}")
    g = grid.build(ax("dataset", ["core:a", "tabred:b"]), ax("protocol", ["cv_standard", "temporal"]), ax("model", ["m", "n"]), ax("seed", [0, 1, 2], "int"), spark.createDataFrame(grid.VALID_PAIRS, "family string, protocol string"))
    assert g.count() == 12
    assert sum(grid.shard(g, k, 5).count() for k in range(5)) == 12


def test_units_round_trip(spark):
    df = spark.createDataFrame([("core:a", "cv", "m", 3)], "dataset string, protocol string, model string, seed int")
    u = df.select(scalars.unit(*map(F.col, df.columns)).alias("u"))
    r = one(u.select("u", *[c.alias(k) for k, c in scalars.parse_unit(F.col("u")).items()]))
    assert tuple(r) == ("core:a__cv__m__seed3", "core:a", "cv", "m", 3)


def test_gate_run_follows_its_configuration(spark):
    cells = spark.createDataFrame([("core:a", "cv", "m", 0, "ok")], "dataset string, protocol string, model string, seed int, status string").withColumns({"metrics": F.struct(F.lit(0.1).alias("ece")), "context_reduced": F.lit(False)})
    manifest = cells.select(F.lit("core:a__cv__m__seed0").alias("unit"), "dataset", "protocol", "model", "status", F.lit("t0").alias("started"))
    legs = spark.createDataFrame([("t0", "h", True, ["core:a__cv__m__seed0"])], "run_started string, hostname string, no_resume boolean, units array<string>")
    env = spark.createDataFrame([("h", "abc", "/p")], "host string, code_sha256 string, prefix string")
    claims = spark.createDataFrame([("c", ["core"])], "id string, independent_datasets array<string>")
    none = spark.createDataFrame([], "model string, dataset string, protocol string")
    known = {"require_calibration", "require_optimism_gap", "coverage", "claims"}
    ids = lambda given: {r["id"]: r["passed"] for r in gate.run(spark, given, manifest, legs, cells, env, claims, none, known).collect()}
    assert ids({}) == dict.fromkeys(["A0", "A1", "B1", "F1", "F2", "G1", "H1", "ALL"], True)
    more = ids({"require_calibration": True, "require_optimism_gap": True, "coverage": {"require_ok_per_system": True}})
    assert more["C1"] and more["F3"] and not more["D1"] and not more["ALL"]


def test_thin_pairs_stay_in_flips(spark):
    rows = [(m, f"d{k}", float(k * (1 if m == "a" else -1) + 0.1 * k * k)) for m in "abc" for k in range(6) if m != "c" or k < 2]
    g = spark.createDataFrame(rows, "model string, dataset string, score double")
    h = g.withColumn("score", -F.col("score") * F.col("score"))
    told = {(r["a"], r["b"]): r for r in charts.axis_flips(g, h, lambda d, k, v: resample.mean_interval(d, k, v, b=50)).collect()}
    assert told["a", "b"]["status"] == "ok" and told["a", "b"]["n_datasets"] == 6 and told["a", "b"]["lo_a"] <= told["a", "b"]["mean_a"] <= told["a", "b"]["hi_a"]
    assert told["a", "c"]["status"] == "insufficient_shared_datasets" and told["a", "c"]["n_datasets"] == 2 and told["a", "c"]["sign_flip"] is None


def test_holdout_shares_and_places(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("y"), (F.col("id") * 7919 % 3001).cast("double").alias("t"))
    for got in (splits.holdout(df, "y", "id", 1), splits.holdout(df, "t", "id", 1, continuous=True)):
        n = {r["fold"]: r["n"] for r in got.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert abs(n["train"] - 1920) < 8 and abs(n["val"] - 480) < 8 and sum(n.values()) == 3000 and got.select("id").distinct().count() == 3000
    at = splits.places(df, "y", "id", 5).collect()
    assert all(sorted(r["__at"] for r in at if r["y"] == y) == list(range(1, 1001)) and {r["__n"] for r in at} == {1000} for y in range(3))
    shipped = df.withColumn("fold", F.lit("val"))
    assert {r["fold"] for r in splits.honoured(shipped, splits.holdout(df, "y", "id", 1), "id").collect()} == {"val"}
    part = df.withColumn("fold", F.when(F.col("id") > 0, "val"))
    assert {r["fold"] for r in splits.honoured(part, splits.holdout(df, "y", "id", 1), "id").collect()} == {"train", "val", "test"}


def test_labels_that_training_lacks_are_an_error(spark):
    df = spark.createDataFrame([("train", "a"), ("test", "b")], "fold string, c string")
    with pytest.raises(ValueError, match="b"):
        preprocess.labels(df, "c")


def test_cells_run_to_a_status(spark):
    import time

    cells = spark.createDataFrame([(f"u{k}", "core:a", "cv", "m", k) for k in range(4)], "unit string, dataset string, protocol string, model string, seed int")

    def work(cell):
        if cell["seed"] == 1:
            raise KeyError("x")
        if cell["seed"] == 2:
            time.sleep(5)
        return {"status": "skipped_x"} if cell["seed"] == 3 else {"score": 1}

    got = {r["unit"]: r["status"] for r in jobs.execute(spark, cells, work, timeout_s=1).collect()}
    assert got == {"u0": "ok", "u1": "error:KeyError", "u2": "error:Timeout", "u3": "skipped_x"}

    def harsh(cell):
        if cell["seed"] == 0:  # native code that doesn't see signals handled in Python
            import ctypes

            ctypes.PyDLL(None).sleep(20)
        if cell["seed"] == 1:
            os.kill(os.getpid(), 9)
        if cell["seed"] == 2:
            os._exit(7)
        return {"own": os.getpid(), "beside": cell["beside"], "long": "x" * 300_000}

    ran = {r["unit"]: r for r in jobs.execute(spark, cells.withColumn("beside", F.lit(5)), harsh, timeout_s=2).collect()}
    assert [(ran[f"u{k}"]["status"], ran[f"u{k}"]["exit_code"]) for k in range(4)] == [("error:Timeout", -9), ("error:Killed", -9), ("error:Exit", 7), ("ok", 0)]
    assert ran["u0"]["wall_s"] < 10 and "memory" in json.loads(ran["u1"]["record"])["msg"] and json.loads(ran["u3"]["record"])["beside"] == 5
    assert not [r for r in jobs.execute(spark, cells.limit(0), work).collect()]
    assert jobs.memory_hint(None, -9) and jobs.memory_hint("ok", 0) is None
    assert jobs.todo(spark, cells, spark.createDataFrame([("u0", "ok"), ("u1", "error:X")], "unit string, status string")).count() == 3
    env = jobs.fingerprint(("pyspark", "no-such-package"), (__file__,))
    assert env["versions"]["no-such-package"] is None and len(env["code_sha256"]) == 16
    assert jobs.leg({"seeds": [0]}, ["u0"], 60, env, now="t")["run_started"] == "t"


def test_dispatcher_tells_a_status(spark):
    """Three toy tasks: a fit, its search, and what a system can't take."""
    rng = random.Random(0)
    rows = []
    for k in range(120):
        x = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((k, "train" if k < 80 else "val" if k < 95 else "test", *x, rng.choice("pqr"), x[0] + x[1]))
    df = spark.createDataFrame(rows, "row int, fold string, a double, b double, c double, k string, t double").coalesce(1)
    binary = models.Split(df.withColumn("y", (F.col("t") > 0).cast("int")), "binclass", 2, ["a", "b", "c"], ["k"])
    real = models.Split(df.withColumn("y", F.col("t")), "regression", 1, ["a", "b", "c"], [])
    got = models.predict(binary, "forest")
    assert got["status"] == "ok" and got["predictions"].count() == 25
    assert sum(r["pred"] == r["y"] for r in got["predictions"].collect()) >= 18 and all(abs(sum(r["proba"]) - 1) < 1e-9 for r in got["predictions"].collect())
    found = models.predict(real, "linear", "matched_hpo")
    assert found["status"] == "ok" and found["inner_score"] > -0.2 and all(abs(r["pred"] - r["y"]) < 0.2 for r in found["predictions"].collect())
    assert models.predict(real, "perceptron")["status"] == "skipped_no_regression"
    assert models.predict(real, "tabicl")["status"] == "skipped_no_regression" and models.predict(binary, "tabicl")["status"] == "skipped_missing_backend:tabicl"
    assert models.predict(binary, "nobody")["status"] == "skipped_unknown_model" and models.predict(binary, "tabpfnv2", "pareto_hpo")["status"] == "skipped_pareto_tunable_only"
    assert models.predict(models.Split(df, "binclass", 2, ["zz"], []), "forest")["status"].startswith("error:")


def test_documents(spark, tmp_path):
    """All documents of a small run with gaps, both tasks, a search leg and a front leg."""
    rng = random.Random(1)
    metric = lambda **m: {k: m.get(k) for k in records.METRICS}
    rows = []
    for mi, model in enumerate(("alpha", "beta_tuned", "gamma", "delta")):
        for d in range(6):
            for seed in (0, 1):
                if model == "delta" and d > 3:
                    continue
                e = mi * 0.03 + rng.random() * 0.02
                if d < 4:
                    rows.append(("core", "cv_standard", model, f"core:d{d}", seed, "binclass", metric(auc=0.9 - e, acc=0.85 - e, ece=0.05 + rng.random() * 0.05, log_loss=0.3 + rng.random() * 0.1)))
                else:
                    rows.append(("core", "cv_standard", model, f"core:d{d}", seed, "regression", metric(rmse=1 + e, mae=0.8 + rng.random() * 0.1, crps_gaussian=None if model == "gamma" else 0.6 + rng.random() * 0.1)))
                if d < 3:
                    rows.append(("tabred", "temporal", model, f"tabred:t{d}", seed, "binclass", metric(auc=0.8 - rng.random() * 0.1)))
    df = spark.createDataFrame([(*r[:6], None, None, None, None, r[6]) for r in rows] + [("core", "matched_hpo", "beta_tuned", f"core:d{d}", s, "binclass", 0.01 * d, None, None, None, metric(auc=0.9)) for d in range(3) for s in (0, 1)]
        + [("core", "pareto_hpo", "beta_tuned", "core:d0", 0, "binclass", None, None, None, [(0.8, 0.1), (0.7, 0.05), (0.6, 0.2)], metric(acc=0.8))],
        "family string, protocol string, model string, dataset string, seed int, task_type string, optimism_gap double, inner_score double, test_score double, pareto_front array<struct<test_acc: double, test_ece: double>>, metrics struct<" + ", ".join(f"{m}: double" for m in records.METRICS) + ">")
    docs = artefacts.Statistics(artefacts.flat(df), b=40).all()
    assert len(docs) == 12 and len(docs["summary"]) == 20
    fn = docs["friedman_nemenyi"]
    assert fn["status"] == "ok" and fn["best_system"] == "alpha" and len(fn["pairwise"]) == len(fn["models"]) * (len(fn["models"]) - 1) // 2 and fn["dropped_for_completeness"] == sorted({"alpha", "beta_tuned", "gamma", "delta"} - set(fn["models"]))
    assert docs["wilcoxon_survival"]["n_claims"] >= 3 and set(docs["wilcoxon_survival"]["claims"][0]) >= {"id", "a", "b", "delta_ci", "survives", "holm_p"}
    assert docs["metric_reorder"]["proper_score_fallback"]["units"] == {"gamma|regression|mae": 4}
    assert docs["pairwise_proper_scoring"]["n_pairs"] == 6 and docs["calibration_rank"]["status"] == "ok" and docs["temporal_reorder"]["n_datasets_temporal"] == 3
    assert docs["optimism_gap"]["per_model"]["beta_tuned"]["n"] == 6 and docs["optimism_gap"]["per_model_task_type"]["beta_tuned"]["binclass"]["mean_optimism_gap"] == pytest.approx(0.01)
    system = docs["pareto_front"]["per_system_mo"]["systems"]["beta_tuned"]
    assert system["n_points"] == 3 and system["front_points"] == [{"acc": 0.8, "ece": 0.1}, {"acc": 0.7, "ece": 0.05}]
    assert set(docs["pareto_front"]["cross_system"]["tfm_dominated_by_tuned_front"]) == {"alpha", "gamma", "delta"}
    artefacts.write(spark, docs, f"file://{tmp_path}")
    assert records.artefact(spark, f"file://{tmp_path}/summary.json") == json.loads(json.dumps(docs["summary"])) and records.artefact(spark, f"file://{tmp_path}/none.json") == {}

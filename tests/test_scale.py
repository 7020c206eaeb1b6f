"""Sums over ranges, refined quantiles, thresholds, stamps of workers, counts beside scans, and a manifest followed with state."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import bin_of
from gaugeworks.operators import gate, grid, jobs, metrics, prefix, splits
from gaugeworks.sources import records
from gaugeworks.streaming import manifest


def test_running_sums_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), k, rng.randrange(9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    got = prefix.running(df, ["g"], ["k"], {"s": F.col("v"), "n": F.lit(1)}, parts=7).collect()
    seen, total = {}, {}
    for g, _, v in rows:
        total[g] = total.get(g, 0) + v
    want = set()
    for g, k, v in rows:
        s, n = seen.get(g, (0, 0))
        seen[g] = s + v, n + 1
        want.add((g, k, v, s + v, total[g], n + 1))
    assert {(r["g"], r["k"], r["v"], r["s"], r["s_all"], r["n"]) for r in got} == want and len(got) == 3000
    whole = prefix.running(df.select("k"), [], ["k"], {"n": F.lit(1)}, parts=4)
    assert whole.where("n <> k + 1").count() == 0
    assert prefix.running(df.limit(0), ["g"], ["k"], {"n": F.lit(1)}).count() == 0


def test_metrics_by_ranges_are_the_same(spark):
    rng = random.Random(2)
    rows = [("hot" if k % 2 else f"c{k % 6}", rng.randrange(2), rng.choice([rng.random(), 0.5])) for k in range(2000)]
    df = spark.createDataFrame(rows, "cell string, y int, score double")
    one, two = ({r["cell"]: r for r in metrics.binary(df, ["cell"], spread=s).collect()} for s in (False, True))
    assert one.keys() == two.keys()
    for k, r in one.items():
        assert [r[c] for c in r.asDict() if c != "cell"] == pytest.approx([two[k][c] for c in r.asDict() if c != "cell"])


@pytest.mark.parametrize("few", [3, 100_000])
def test_quantiles_are_exact(spark, few):
    rng = np.random.default_rng(3)
    shares = [0.0, 0.1, 0.25, 0.5, 0.64, 0.8, 0.999, 1.0]
    for x in (rng.normal(size=501), np.exp(rng.normal(size=400) * 8), np.repeat([1.0, 2.0, 5.0], [1, 300, 2]), np.array([7.0]), np.concatenate([rng.random(300) * 1e-9, [1e9]]), np.full(50, 3.0)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        assert prefix.quantiles(df, "v", shares, bins=16, few=few) == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12)
    assert prefix.quantiles(df.limit(0), "v", [0.5]) is None and prefix.quantiles(df.where("v is null"), "v", [0.5]) is None


def test_cuts_are_places_in_md5_order(spark):
    rng = random.Random(4)
    rows = [(k, "hot" if rng.random() < 0.8 else rng.choice(["a", None]), k % 3) for k in range(700)] + [(1000, "one", 0)]
    df = spark.createDataFrame(rows, "row int, g string, seed int")
    for ends in (lambda n: [F.round(n * 0.3)], lambda n: [F.lit(0), F.round(n * 0.5), n]):
        got = {(r["g"], r["seed"], r["row"]): r["__part"] for r in splits.cuts(df, ["g", "seed"], "row", F.col("seed"), ends).collect()}
        at = splits.places(df.withColumn("by", F.concat_ws("#", F.coalesce("g", F.lit("none")), "seed")), "by", "row", F.col("seed")).select("*", F.array(*[(F.col("__at") > e).cast("int") for e in ends(F.col("__n"))]).alias("late"))
        assert got == {(r["g"], r["seed"], r["row"]): sum(r["late"]) for r in at.collect()}
    assert splits.cuts(df.limit(0), ["g"], "row", 1, lambda n: [n]).count() == 0


def test_stamps_of_workers_feed_the_gate(spark):
    own = jobs.worker_stamps(spark, slots=2).cache()
    rows = own.collect()
    assert len(rows) == 2 and all(len(r["code_sha256"]) == 16 and r["versions"]["pyspark"] for r in rows)
    assert gate.homogeneous(own).first()["passed"]
    other = own.withColumn("code_sha256", F.when(F.col("slot") == 0, "0" * 16).otherwise(F.col("code_sha256")))
    assert not gate.homogeneous(other).first()["passed"]
    assert jobs.package_digest() == rows[0]["code_sha256"]


def test_counts_beside_one_read(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"core:a__cv__m__seed{k}.json").write_text(json.dumps({"status": "ok" if k else "error:X", "dataset": "core:a"}))
    (tmp_path / "core:b__cv__m__seed0.json").write_text("{torn")
    rows, seen = records.units_counted(spark, f"file://{tmp_path}")
    kept = rows.where("_corrupt_record is null").select("dataset", "status").collect()
    assert len(kept) == 5 and seen.after(kept) == {"n_files": 6, "n_unreadable": 1, "n_ok": 4}


# ---- a manifest as a stream


def leg(k, status, started, finished="2024-01-02T00:00:00Z"):
    return {"unit": f"core:a__cv__m__seed{k}", "dataset": "core:a", "protocol": "cv", "model": "m", "seed": k, "status": status, "started": started, "finished": finished, "wall_s": 1.0}


def run(spark, top):
    q = manifest.follow(spark, str(top / "in"), str(top / "out"), str(top / "state"))
    assert q.awaitTermination(120)
    return sorted((r["unit"], r["status"], r["started"]) for r in manifest.current(spark, str(top / "out")).collect())


def test_a_cell_belongs_to_its_latest_leg(spark, tmp_path):
    (tmp_path / "in").mkdir()
    legs = [
        [leg(0, "error:Timeout", "2024-01-01T00:00:00Z"), leg(1, "ok", "2024-01-01T00:00:00Z"), leg(1, "ok", "2024-01-01T00:00:00Z")],
        [leg(0, "ok", "2024-01-01T05:00:00Z"), leg(2, "ok", "2024-01-01T06:00:00Z")],
        [leg(2, "error:KeyError", "2024-01-01T03:00:00Z"), leg(1, "skipped_feature_cap", "2024-01-01T07:00:00Z")],  # an older leg of cell 2 comes late
    ]
    for k, rows in enumerate(legs):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        got = run(spark, tmp_path)
        every = [r for part in legs[: k + 1] for r in part]
        newest = {u: max((r for r in every if r["unit"] == u), key=lambda r: (r["started"], r["finished"], r["status"])) for u in {r["unit"] for r in every}}
        assert got == sorted((u, r["status"], r["started"]) for u, r in newest.items())
    # coverage of the stream is that of a batch run over the latest legs
    batch = spark.createDataFrame([tuple(r[c] for c in ("dataset", "protocol", "model", "seed", "status")) for r in newest.values()], "dataset string, protocol string, model string, seed int, status string")
    assert grid.coverage(manifest.current(spark, str(tmp_path / "out"))).collect() == grid.coverage(batch).collect()


def test_a_batch_that_is_run_again_is_there_once(spark, tmp_path):
    sink = manifest.batch_sink(str(tmp_path / "out"))
    rows = spark.createDataFrame([tuple(leg(k, "ok", "2024-01-01T00:00:00Z")[c] for c in ("unit", *manifest._LEG)) for k in range(3)], manifest.LEG)
    for _ in range(2):
        sink(rows, 7)
    sink(rows.limit(1), 8)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4 and manifest.current(spark, str(tmp_path / "out")).count() == 3


def test_four_significant_digits(spark):
    from gaugeworks.functions.scalars import four_digits

    values = [0.0, 1.0, 0.05, 0.012345, 1e-4, 9.9996e-5, 0.99996, 1234.6, 12346.0, 9999.6, 1e-9, 3.14159e-12, -0.5, 100.0, 1e10, 0.1 + 0.2]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(four_digits(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in got] == [f"{v:.4g}" for v in values]


def test_gaps_of_all_records(spark, tmp_path):
    """Every cell that ended well under the protocol counts, whatever its number."""
    from gaugeworks.plans import queries_grid

    rows = [(k, k // 7, "F" if k % 4 else "P", "1-URGENT") for k in range(1, 800)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    units = {(k % 7, k // 7 % 3, k // 7 % 20, k % 5) for k, _, status, _ in rows if status == "F" and k % 3}
    gaps = queries_grid.optimism_gap(spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in gaps if r["task_type"] is None) == sum(r["n"] for r in gaps if r["task_type"] is not None) == len(units)
    assert sum(r["n"] for r in queries_grid.gap_table(spark, str(tmp_path)).collect()) == len(units)


def test_bins_are_no_condition_on_rows(spark):
    """A curve's bin isn't written out in a filter below the join that makes the predictions; rows without one are left out."""
    rows = [("a", k, k % 2) for k in range(1, 100)] + [("b", None, 1)] * 6
    made = spark.createDataFrame(rows, "model string, k int, y int").join(spark.range(100).select(F.col("id").alias("k")), "k", "left").select("model", "y", (0.02 + F.col("k") / 110.0).alias("score"))
    curve = metrics.reliability(made, ["model"])
    assert not [x for x in curve._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "CASE" in x]
    want = {}
    for _, k, y in rows[:99]:
        s = 0.02 + k / 110.0
        c = max(s, 1 - s)
        at = next(b for b in range(12) if c <= (1.0 if b == 11 else (b + 1) * (1.0 / 12)))
        n, conf, right = want.get(at, (0, 0.0, 0))
        want[at] = n + 1, conf + c, right + ((s > 0.5) == (y == 1))
    assert {r["bin"]: (r["n"], pytest.approx(r["mean_conf"]), pytest.approx(r["mean_acc"])) for r in curve.collect()} == {b: (n, c / n, a / n) for b, (n, c, a) in want.items() if n >= 5}
    edges = [-1.0, -0.0, 0.0, 1e-300, *[k * (1.0 / 15) for k in range(1, 16)], np.nextafter(5 * (1.0 / 15), 2), 1.0, np.nextafter(1.0, 2), math.nan, math.inf, None]
    own = [k * (1.0 / 15) for k in range(15)] + [1.0]
    place = lambda v: None if v is None or math.isnan(v) or v <= 0 or v > 1 else sum(e < v for e in own) - 1
    assert [r["b"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(map(lambda v: None if v is None else float(v), edges))], "k int, v double").orderBy("k").select(bin_of(F.col("v"), 15).alias("b")).collect()] == [place(v) for v in edges]

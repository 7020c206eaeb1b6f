"""Rows behind reports and figures: comparisons of two axes, leaders, gaps and checklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import four_digits, known

from . import ranks
from .significance import kendall, pairs, wilcoxon


def axis_flips(grid_a: DataFrame, grid_b: DataFrame, intervals, alpha: float = 0.05, least: int = 3) -> DataFrame:
    """Every pair of systems that both axes have, compared on the datasets that both have on both axes; zero never flips.

    (a, b, n_datasets, status, mean_a, lo_a, hi_a, p_a, mean_b, lo_b, hi_b, p_b, sign_flip, significant). intervals: what resample.mean_interval is.
    Pairs with fewer than `least` shared datasets stay, with a status and nothing else.
    """
    names = grid_a.select("model").intersect(grid_b.select("model"))
    every = names.withColumnRenamed("model", "a").join(names.withColumnRenamed("model", "b"), F.col("a") < F.col("b"))
    both = pairs(grid_a).withColumnRenamed("d", "da").join(pairs(grid_b).withColumnRenamed("d", "db"), ["a", "b", "dataset"])
    out = every.join(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_datasets")), ["a", "b"], "left")
    for x in "ab":
        own = both.select("a", "b", "dataset", F.col(f"d{x}").alias("d"))
        out = out.join(wilcoxon(own, ["a", "b"]).select("a", "b", F.col("p_two").alias(f"p_{x}")), ["a", "b"], "left")
        out = out.join(intervals(own, ["a", "b"], "d").select("a", "b", F.col("mean").alias(f"mean_{x}"), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}")), ["a", "b"], "left")
    n = F.coalesce("n_datasets", F.lit(0))
    enough = n >= least
    flip = (F.signum("mean_a") != F.signum("mean_b")) & (F.col("mean_a") != 0) & (F.col("mean_b") != 0)
    sure = (F.col("p_a") < alpha).cast("int") + (F.col("p_b") < alpha).cast("int")
    shown = [F.when(enough, F.col(f"{k}_{x}")).alias(f"{k}_{x}") for x in "ab" for k in ("mean", "lo", "hi", "p")]
    word = F.element_at(F.array(F.lit("neither"), F.lit("one"), F.lit("both")), sure + 1)
    return out.select("a", "b", n.alias("n_datasets"), F.when(enough, "ok").otherwise("insufficient_shared_datasets").alias("status"), *shown, F.when(enough, flip).alias("sign_flip"), F.when(enough, word).alias("significant"))


def flip_summary(flips: DataFrame) -> DataFrame:
    """One row of counts: pairs, those with too few datasets, flips, and flips by how many axes are significant."""
    f = F.coalesce("sign_flip", F.lit(False))
    thin = F.count_if(F.col("status") != "ok").alias("n_pairs_insufficient")
    return flips.agg(F.count(F.lit(1)).alias("n_pairs"), thin, F.count_if(f).alias("n_sign_flips"), *[F.count_if(f & (F.col("significant") == k)).alias(f"n_sign_flips_{k}_significant") for k in ("both", "one", "neither")])


def complete_on(*grids: DataFrame) -> list[DataFrame]:
    """The grids on the datasets that all of them have, and of these the systems that all grids have on every one."""
    datasets, models = grids[0].select("dataset"), None
    for g in grids[1:]:
        datasets = datasets.intersect(g.select("dataset"))
    datasets = datasets.distinct()
    n = F.broadcast(datasets.agg(F.count(F.lit(1)).alias("__n")))  # one row
    for g in grids:
        own = g.join(datasets, "dataset", "left_semi").groupBy("model").agg(F.count_distinct("dataset").alias("__c")).join(n, F.col("__c") == F.col("__n")).select("model")
        models = own if models is None else models.intersect(own)
    return [g.join(datasets, "dataset", "left_semi").join(models, "model", "left_semi") for g in grids]


def calibration_rank(accuracy: DataFrame, calibration: DataFrame) -> DataFrame:
    """One row (status, n_models, n_datasets, accuracy_leader, calibration_leader, leader_disagrees, kendall_tau): datasets that both axes have, then the
    systems that are complete on them; needs three systems and two datasets."""
    a, b = complete_on(accuracy, calibration)
    size = a.agg(F.count_distinct("model").alias("n_models"), F.count_distinct("dataset").alias("n_datasets"))
    a, b = (ranks.mean_ranks(ranks.average_rank(g, ["dataset"])) for g in (a, b))
    both = a.select("model", F.round("mean_rank", 9).alias("p")).join(b.select("model", F.round("mean_rank", 9).alias("q")), "model")
    lead = both.agg(F.min_by("model", F.struct("p", "model")).alias("accuracy_leader"), F.min_by("model", F.struct("q", "model")).alias("calibration_leader"))
    enough = (F.col("n_models") >= 3) & (F.col("n_datasets") >= 2)
    told = {"accuracy_leader": F.col("accuracy_leader"), "calibration_leader": F.col("calibration_leader"), "leader_disagrees": F.col("accuracy_leader") != F.col("calibration_leader"), "kendall_tau": F.col("tau")}
    return size.crossJoin(lead).join(kendall(both, [], "p", "q").select("tau"), how="left").select(F.when(enough, "ok").otherwise("insufficient_block").alias("status"), "n_models", "n_datasets", *[F.when(enough, v).alias(k) for k, v in told.items()])


def optimism(records: DataFrame, intervals, protocol: str = "matched_hpo", unit: str = "unit") -> DataFrame:
    """(model, task_type, n, mean_optimism_gap, lo, hi) of the protocol's records: by task, and over mixed units (task_type null), with intervals of the mean over cells.

    The gap is the record's own; a record without one is left out. intervals: what resample.mean_interval is, with item.
    """
    gap = records.where(F.col("protocol") == protocol).withColumn("gap", known(F.col("optimism_gap"))).where("gap is not null")
    gap = gap.select("model", F.coalesce("task_type", F.lit("unknown")).alias("task_type"), "gap", F.col(unit).alias("unit"))
    parts = []
    for keys in (["model", "task_type"], ["model"]):
        told = gap.groupBy(*keys).agg(F.count("gap").alias("n")).join(intervals(gap, keys, "gap", item="unit"), keys)
        parts.append(told.select("model", F.col("task_type") if len(keys) > 1 else F.lit(None).cast("string").alias("task_type"), "n", F.col("mean").alias("mean_optimism_gap"), "lo", "hi"))
    return parts[0].unionByName(parts[1])


CHECKLIST = ("paired_significance_test", "confidence_interval", "proper_scoring_or_calibration", "calibrated_outputs")


def reporting(claims: DataFrame) -> DataFrame:
    """(id, missing, flagged): the checklist's items that a claim lacks."""
    items = F.array(*[F.when(~F.coalesce(F.col(k), F.lit(False)), F.lit(k)) for k in CHECKLIST])
    return claims.select("id", F.filter(items, lambda x: x.isNotNull()).alias("missing")).withColumn("flagged", F.size("missing") > 0)


def temporal_reorder(random_split: DataFrame, temporal_split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(movers, tau): mean ranks of the systems that both sides' blocks have, each over its own datasets. Blocks are made of the systems that both sides
    have at all, and are complete before ranks are taken.

    tau has n_items, tau, tau_p, n_datasets_random, n_datasets_temporal, dropped (systems of both sides that a block lacks, sorted) and coverage_note.
    """
    common = random_split.select("model").intersect(temporal_split.select("model"))
    a, b = (ranks.complete_block(g.join(common, "model", "left_semi")) for g in (random_split, temporal_split))
    both = a.select("model").intersect(b.select("model"))
    ra, rb = (ranks.mean_ranks(ranks.average_rank(g.join(both, "model", "left_semi"), ["dataset"])) for g in (a, b))
    moved = ranks.movers(ra, rb)
    lost = common.join(both, "model", "left_anti").agg(F.array_sort(F.collect_set("model")).alias("dropped"))
    counts = a.agg(F.count_distinct("dataset").alias("n_datasets_random")).crossJoin(b.agg(F.count_distinct("dataset").alias("n_datasets_temporal"))).crossJoin(lost)
    note = F.concat(F.lit("ranks of the "), F.col("n_items"), F.lit(" systems that are complete under both split policies, each side over its own datasets"))
    return moved, kendall(moved, [], "rank_a", "rank_b").crossJoin(counts).withColumn("coverage_note", note)


def rank_band_rows(bands: DataFrame, size: int = 3) -> DataFrame:
    """Rows of a band chart: (model, median_rank, below, above, in_top_cluster) in order of median rank."""
    from .resample import top_cluster

    top = top_cluster(bands, size).select("model", F.lit(True).alias("top"))
    return bands.join(top, "model", "left").select("model", "median_rank", (F.col("median_rank") - F.col("lo")).alias("below"), (F.col("hi") - F.col("median_rank")).alias("above"), F.coalesce("top", F.lit(False)).alias("in_top_cluster")).orderBy("median_rank", "model")


def slope_rows(moved: DataFrame, least: float = 1.0) -> DataFrame:
    """Rows of a slope chart: both ranks, and whether they differ by `least` or more."""
    return moved.select("model", "rank_a", "rank_b", (F.round(F.abs("shift"), 9) >= least).alias("moved"))


def mean_calibration(records: DataFrame, block: DataFrame) -> DataFrame:
    """(model, ece): over records, not datasets, of the block's systems."""
    return records.join(block.select("model").distinct(), "model", "left_semi").groupBy("model").agg(F.avg("ece").alias("ece"))


def display(rows: DataFrame, names: dict[str, str], column: str = "model") -> DataFrame:
    """rows with shown names where there are any."""
    if not names:
        return rows
    shown = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.withColumn(column, F.coalesce(F.try_element_at(shown, F.col(column)), F.col(column)))


def summary(**parts: DataFrame) -> DataFrame:
    """One row out of one-row tables, columns named part_column."""
    out = None
    for name, df in parts.items():
        one = df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])
        out = one if out is None else out.crossJoin(one)
    return out


def cd_axis(ranked: DataFrame, margin: float = 0.3) -> DataFrame:
    """One row (low, high): limits of a rank axis."""
    return ranked.agg(F.floor(F.min("mean_rank") - margin).cast("int").alias("low"), F.ceil(F.max("mean_rank") + margin).cast("int").alias("high"))


def classification_grid(records: DataFrame, family: str = "core", protocol: str = "cv_standard") -> DataFrame:
    """Mean AUC over seeds of one family's classification records under one protocol, on the datasets that all its systems have."""
    own = records.where((F.col("family") == family) & (F.col("protocol") == protocol) & (F.col("task_type") != "regression"))
    return ranks.strict_block(ranks.mean_over_seeds(own, F.col("auc")))


def leaders_curves(records: DataFrame, leaders: DataFrame, curves) -> DataFrame:
    """(model, bin, n, mean_conf, mean_acc) of the first record, by unit, of the accuracy leader and of the calibration leader; once if they are one.

    records: unit, model; leaders: one row (accuracy_leader, calibration_leader); curves: gives the curve rows of a table of (model, unit).
    """
    names = leaders.select(F.explode(F.array_distinct(F.array("accuracy_leader", "calibration_leader"))).alias("model"))
    return curves(records.join(names, "model", "left_semi").groupBy("model").agg(F.min("unit").alias("unit")))


def scatter_rows(told: DataFrame) -> DataFrame:
    """Rows of an accuracy against calibration scatter, best accuracy first, with the place of those on the front along its line."""
    line = F.when(F.col("on_front"), F.row_number().over(Window.partitionBy("on_front").orderBy(F.desc("acc"), "model")))
    return told.select("model", "acc", "ece", "on_front", (~F.col("tuned")).alias("pretrained"), F.coalesce("dominated_by_tuned", F.lit(False)).alias("dominated"), line.alias("line_place")).orderBy(F.desc("acc"), "model")


def claims_table(claims: DataFrame) -> DataFrame:
    """Claims with a verdict as a table of text, by id: deltas and ends to four places, probabilities to four digits."""
    place = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    told = claims.where("survives is not null").orderBy("id")
    return told.select(F.col("id").alias("claim_id"), F.col("a").alias("A"), F.col("b").alias("B"), F.col("n_datasets").cast("string").alias("n_datasets"), place("mean_delta").alias("mean_delta"), four_digits(F.col("wilcoxon_p_onesided")).alias("wilcoxon_p_onesided"), F.coalesce(four_digits(F.col("holm_p")), F.lit("nan")).alias("holm_p"), place("ci_lo").alias("ci_lo"), place("ci_hi").alias("ci_hi"), F.initcap(F.col("survives").cast("string")).alias("survives"))


def checklist_table(told: DataFrame, source: str) -> DataFrame:
    """(place, reporting_standard_item, checklist): the checklist's items, the counts of claims and of flagged ones, their source, and each flagged claim with what it lacks; told is what reporting() gives."""
    spark = told.sparkSession
    items = spark.createDataFrame([(0, k, item, "required") for k, item in enumerate(CHECKLIST)], "part int, at long, item string, checklist string")
    n = told.agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("f"))
    line = lambda item, value: F.struct(F.lit(item).alias("item"), value.cast("string").alias("checklist"))
    lines = F.array(line("n_claims_audited", F.col("n")), line("n_flagged_by_standard", F.col("f")), line("source", F.lit(source)))
    counts = n.select(F.posexplode(lines).alias("at", "l")).select(F.lit(1).alias("part"), F.col("at").cast("long").alias("at"), "l.item", "l.checklist")
    flagged = told.where("flagged").select(F.lit(2).alias("part"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("id")).cast("long").alias("at"), F.lit("flagged").alias("item"), F.to_json(F.struct("id", "missing")).alias("checklist"))
    place = (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("part", "at")) - 1).alias("place")
    return items.unionByName(counts).unionByName(flagged).select(place, F.col("item").alias("reporting_standard_item"), "checklist")


def gap_table(gaps: DataFrame, units: dict[str, str]) -> DataFrame:
    """Gap rows by system and task with the unit of the gap; where a system has no split by task, its pooled row, named so."""
    of = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    split = gaps.where("task_type is not null")
    group = F.when(F.col("task_type") == "regression", "regression").otherwise("classification")
    pooled = gaps.where("task_type is null").join(split.where("task_type <> 'unknown'").select("model"), "model", "left_anti")
    rows = split.where("task_type <> 'unknown'").withColumn("unit", F.try_element_at(of, group)).unionByName(pooled.withColumns({"task_type": F.lit("pooled_MIXED_UNITS"), "unit": F.lit(None).cast("string")}))
    return rows.orderBy("model", "task_type")

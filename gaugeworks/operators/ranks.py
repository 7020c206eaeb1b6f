"""Score grids, ranks and complete blocks. A grid is (model, dataset, score), higher better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_over_seeds(cells: DataFrame, score: Column, keys: tuple[str, ...] = ("model", "dataset")) -> DataFrame:
    """The mean of the known scores of each (model, dataset); pairs without one are gaps."""
    return cells.where(score.isNotNull()).groupBy(*keys).agg(F.avg(score).alias("score"))


def average_rank(rows: DataFrame, by: list[str], score: str = "score", out: str = "rank", ascending: bool = False) -> DataFrame:
    """rows with the rank of the score within `by`, 1 the best (or the smallest), ties their average."""
    order = F.col(score) if ascending else F.desc(score)
    place, tied = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by, score)
    return rows.withColumn(out, F.rank().over(place) + (F.count(F.lit(1)).over(tied) - 1) / 2.0)


def mean_ranks(ranked: DataFrame) -> DataFrame:
    """(model, mean_rank, n_datasets)."""
    return ranked.groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n_datasets"))


def greedy_block(present: set[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Models and datasets of a block without gaps: while there are any, the model with most gaps goes if it has as many as the worst
    dataset and more than three are left, else the dataset with most; the first by name of equals."""
    models, datasets = sorted({m for m, _ in present}), sorted({d for _, d in present})
    while models and datasets:
        by_model = [sum((m, d) not in present for d in datasets) for m in models]
        by_data = [sum((m, d) not in present for m in models) for d in datasets]
        if not max(by_model):
            break
        if max(by_model) >= max(by_data) and len(models) > 3:
            models.pop(by_model.index(max(by_model)))
        else:
            datasets.pop(by_data.index(max(by_data)))
    return models, datasets


def complete_block(grid: DataFrame) -> DataFrame:
    """The grid restricted to a greedy block. Only the presence of pairs comes to the driver: as many as there are systems times datasets."""
    models, datasets = greedy_block({(r["model"], r["dataset"]) for r in grid.select("model", "dataset").distinct().collect()})
    return grid.where(F.col("model").isin(models) & F.col("dataset").isin(datasets))


def strict_block(grid: DataFrame) -> DataFrame:
    """The grid restricted to datasets that all models have."""
    wanted = grid.agg(F.count_distinct("model").alias("k"))
    full = grid.groupBy("dataset").agg(F.count_distinct("model").alias("c")).join(F.broadcast(wanted), F.col("c") == F.col("k")).select("dataset")
    return grid.join(full, "dataset", "left_semi")


def leaderboard(grid: DataFrame) -> DataFrame:
    """(model, mean_rank, n_datasets, mean_score) over each dataset's own systems, best first."""
    ranked = average_rank(grid, ["dataset"])
    return ranked.groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n_datasets"), F.avg("score").alias("mean_score")).orderBy("mean_rank", "model")


def movers(a: DataFrame, b: DataFrame, top: int = 3) -> DataFrame:
    """(model, rank_a, rank_b, shift, place) by absolute shift of mean ranks, then name; `place` up to top are the largest movers."""
    both = a.select("model", F.col("mean_rank").alias("rank_a")).join(b.select("model", F.col("mean_rank").alias("rank_b")), "model").withColumn("shift", F.col("rank_b") - F.col("rank_a"))
    # mean ranks carry rounding noise: equal shifts must tie
    return both.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round(F.abs("shift"), 9)), "model"))).withColumn("largest", F.col("place") <= top)

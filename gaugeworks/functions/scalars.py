"""Scalar expressions: orientation of metrics, tokens, counter-based draws, normal and chi-square tails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics by the direction that is better.
HIGHER = ("auc", "acc", "pr_auc", "r2")
LOWER = ("log_loss", "brier", "ece", "rmse", "mae", "crps_gaussian")
#: Primary and proper metric by task, and what stands in for one that is missing.
PRIMARY = {"classification": "auc", "regression": "rmse"}
PROPER = {"classification": "log_loss", "regression": "crps_gaussian"}
FALLBACK = {"crps_gaussian": "mae"}
EPS = 2.220446049250313e-16


def known(x: Column) -> Column:
    """NaN counts as missing."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def oriented(metric: str, value: Column) -> Column:
    """value so that higher is better."""
    if metric not in HIGHER + LOWER:
        raise ValueError(f"unknown metric {metric}")
    return known(value) if metric in HIGHER else -known(value)


def task_group(task_type: Column) -> Column:
    return F.when(task_type == "regression", "regression").otherwise("classification")


def score_of(task_type: Column, names: dict[str, str]) -> Column:
    """The oriented value of the metric that `names` has for the task's group, from columns of the metrics' names; the fallback where it is missing."""
    group = task_group(task_type)
    value = lambda m: F.coalesce(oriented(m, F.col(m)), *[oriented(f, F.col(f)) for f in [FALLBACK.get(m)] if f])
    return F.when(group == "regression", value(names["regression"])).otherwise(value(names["classification"]))


def four_digits(x: Column) -> Column:
    """Text with four significant digits at most, ties away from zero, without zeros at the end; powers of ten below the fourth place or from the fifth digit on."""
    parts = F.split(F.format_string("%.3e", x.cast("double")), "e")
    power = F.get(parts, F.lit(1)).cast("int")
    short = lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    plain = F.coalesce(*[F.when(power == k, F.format_string(f"%.{3 - k}f", x.cast("double"))) for k in range(-4, 4)])
    far = F.concat(short(F.get(parts, F.lit(0))), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(F.isnan(x), "nan").when(x == 0, "0").when(power.between(-4, 3), short(plain)).otherwise(far)


def family(dataset: Column) -> Column:
    return F.split_part(dataset, F.lit(":"), F.lit(1))


def unit(dataset: Column, protocol: Column, model: Column, seed: Column) -> Column:
    """dataset__protocol__model__seedN."""
    return F.concat(dataset, F.lit("__"), protocol, F.lit("__"), model, F.lit("__seed"), seed.cast("string"))


def parse_unit(u: Column) -> dict[str, Column]:
    part = F.split(u, "__")
    at = lambda k: F.try_element_at(part, F.lit(k))
    return {"dataset": at(1), "protocol": at(2), "model": at(3), "seed": F.regexp_extract(at(4), r"^seed(\d+)$", 1).try_cast("int")}


def draw(n: Column, *key: Column | str | int) -> Column:
    """A number from 0 to n - 1 by the md5 of the key: the same in any order, engine and run."""
    text = F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


def erf(x: Column) -> Column:
    """The error function by a series of positive terms, exp(-x^2) * sum of x^(2n+1) / gamma(n + 3/2); 1 or -1 beyond 5.

    x stands some hundred times in the result: give a column, not an expression, so that it is computed once.
    """
    a = F.lit(1.0)
    # Horner's scheme from the last term: built-in arithmetic, so it stays in generated code
    for n in range(70, 0, -1):
        a = 1 + x * x * (2.0 / (2 * n + 1)) * a
    return F.when(F.abs(x) > 5, F.signum(x)).otherwise(a * x * F.exp(-x * x) * (2 / math.sqrt(math.pi)))


def normal_cdf(z: Column, scaled: Column | None = None) -> Column:
    """scaled: z over the root of 2 as a column of its own, so that it is computed once."""
    return (1 + erf(z / math.sqrt(2) if scaled is None else scaled)) / 2


def normal_tail(z: Column) -> Column:
    """P(Z > z) by the complement; for large z by a continued fraction, which keeps its relative precision. z: a column, as for erf."""
    b = F.lit(0.0)
    for k in range(40, 0, -1):
        b = F.lit(float(k)) / (z + b)
    far = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (z + b)
    return F.when(z > 3, far).otherwise(1 - normal_cdf(z))


def chi2_tail(x: Column, df: Column, most: int = 64) -> Column:
    """P(X > x) for whole degrees of freedom up to `most`, in closed form."""
    half = x / 2
    even = F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(df / 2).cast("int") - 1, F.lit(1))), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, j: F.struct((a.t * half / j).alias("t"), F.when(j <= F.floor(df / 2) - 1, a.s + a.t * half / j).otherwise(a.s).alias("s")), lambda a: a.s) * F.exp(-half)
    term = F.sqrt(half) * (2 / math.sqrt(math.pi))
    odd = F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor((df - 1) / 2).cast("int"), F.lit(1))), F.struct(term.alias("t"), F.lit(0.0).alias("s")), lambda a, j: F.struct((a.t * half / (j + 0.5)).alias("t"), F.when(j <= F.floor((df - 1) / 2), a.s + a.t).otherwise(a.s).alias("s")), lambda a: a.s) * F.exp(-half)
    return F.when(df.isNull() | x.isNull() | (df > most), None).when(df % 2 == 0, even).otherwise(2 * normal_tail(F.sqrt(x)) + odd)


def bin_of(value: Column, bins: int) -> Column:
    """The bin of value among `bins` equal ones of 0 to 1, left-open and right-closed; null for 0. Edges are k * (1 / bins)."""
    at = F.when(value <= 0.0, F.lit(None).cast("int"))
    for k, edge in enumerate([*[k * (1.0 / bins) for k in range(1, bins)], 1.0]):
        at = at.when(value <= edge, k)
    return at

"""Log-price regression with location fixed effects, fitted from distributed sums.

The fixed effects are absorbed rather than expanded: sums and products per location give the
within-location normal equations, whose size depends on the number of features only. Executors
return those sums; the driver solves a p x p system; locations stay a DataFrame throughout.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerband.functions.buckets import quoted
from peerband.operators import student
from peerband.operators.distribution import join_same, selected_quantiles
from peerband.operators.features import dot
from peerband.operators.gram import Factors, design_moments, group_levels, solve, vif_values
from peerband.session import stage

COEFFICIENTS = (
    "feature string, effect double, std_err double, p_value double, ci_low double, ci_high double"
)


@dataclass(frozen=True)
class HedonicFit:
    """Everything needed to score. Vectors are as long as the model is wide."""

    names: tuple[str, ...]
    effects: tuple[float, ...]
    coefficients: DataFrame  # feature, effect, std_err, p_value, ci_low, ci_high
    fixed_effects: DataFrame  # neighbourhood, n, fixed_effect (baseline level at 0)
    vif: DataFrame  # feature, vif
    intercept: float
    n_rows: int
    n_levels: int
    rank: int
    r2: float | None  # None where the target is constant or no freedom is left
    adj_r2: float | None
    sse: float
    model_mae: float
    baseline_median_mae: float
    baseline_group_mae: float
    smearing: float
    factors: Factors = field(default_factory=dict)

    def summary(self) -> DataFrame:
        return self.coefficients.sparkSession.createDataFrame(
            [(
                self.n_rows, self.n_levels, self.rank, self.intercept, self.r2, self.adj_r2,
                self.model_mae, self.baseline_median_mae, self.baseline_group_mae, self.smearing,
            )],
            "n_rows long, n_levels long, rank long, intercept double, r2 double, adj_r2 double,"
            " model_mae double, baseline_median_mae double, baseline_group_mae double,"
            " smearing double",
        )


def _coefficient_rows(names, effects, variances, df):
    t95 = student.critical_value(df) if df > 0 else None
    rows = []
    for name, b, var in zip(names, effects, variances, strict=True):
        if df <= 0 or not var > 0:
            rows.append((name, float(b), None, None, None, None))
            continue
        b, se = float(b), math.sqrt(var)
        rows.append(
            (name, b, se, student.two_sided_p(b / se, df), b - t95 * se, b + t95 * se)
        )
    return rows


def vif_table(features: DataFrame, names: Sequence[str],
              factors: Factors | None = None) -> DataFrame:
    """VIF of each named column with a constant, from one scan of sums."""
    moments = design_moments(features, names, F.lit(0.0), F.lit("all"), factors)
    rows = list(zip(names, vif_values(moments.total[:-1, :-1]), strict=True))
    return features.sparkSession.createDataFrame(rows, "feature string, vif double")


def linear_part(df: DataFrame, names: Sequence[str], effects: Sequence[float],
                factors: Factors | None = None) -> tuple[DataFrame, Column]:
    """The columns' contribution to the target, and the rows it can be computed on.

    A factor's effects are joined by level; they are at most as many as the model is wide.
    """
    weights = dict(zip(names, effects, strict=True))
    total = None
    for k, (factor, levels) in enumerate((factors or {}).items()):
        table = df.sparkSession.createDataFrame(
            [(level, float(weights.pop(name))) for level, name in levels.items()],
            f"_level{k} string, _effect{k} double",
        )
        df = df.join(F.broadcast(table), quoted(factor) == F.col(f"_level{k}"), "left")
        own = F.coalesce(F.col(f"_effect{k}"), F.lit(0.0))
        total = own if total is None else total + own
    numbers = dot(list(weights), list(weights.values()))
    return df, numbers if total is None else numbers + total


def fit_hedonic(features: DataFrame, names: Sequence[str], group: str = "neighbourhood",
                target: str = "log_price", factors: Factors | None = None) -> HedonicFit:
    """Fit ``target ~ names + group``. ``features`` is read four times: pass a stored table.

    A name is a column of numbers or an indicator of ``factors``, which has no column. The
    coefficients, errors and adjusted R2 equal those of the regression on explicit dummies of
    groups and levels; degrees of freedom count the groups.
    """
    spark = features.sparkSession
    names, y = list(names), F.col(target)
    moments = design_moments(features, names, y, F.col(group), factors)
    solved = solve(moments)
    effects = solved.effects
    levels = stage(group_levels(moments, effects), "group_levels")
    base = levels.where(F.col("neighbourhood").eqNullSafe(F.lit(moments.first_group))).first()
    intercept = float(base["level"])
    fixed = levels.select(
        "neighbourhood", "n", (F.col("level") - F.lit(intercept)).alias("fixed_effect")
    )

    # Both medians, of each group and (under ``_whole``) of all rows, from the same passes.
    kinds = F.array(
        F.struct(F.lit(False).alias("_whole"), F.col(group).alias(group)),
        F.struct(F.lit(True).alias("_whole"),
                 F.lit(None).cast(features.schema[group].dataType).alias(group)),
    )
    medians = stage(selected_quantiles(
        features.select(F.explode(kinds).alias("k"), y.alias("y")).select("k.*", "y"),
        ["_whole", group], F.col("y"), {"median": 0.5},
    ), "medians")
    whole = medians.where("_whole").first()
    overall = whole["median"] if whole else None
    medians = medians.where("not _whole").drop("_whole", "n")
    # Stored, so that its size is known and a small one is broadcast: features stay where they are.
    per_group = stage(join_same(
        levels, medians.withColumnRenamed(group, "neighbourhood"), ["neighbourhood"], ["median"]
    ).withColumnRenamed("neighbourhood", group), "group_medians")
    scored, explained = linear_part(
        join_same(features, per_group, [group], ["level", "median"]), names, effects, factors
    )
    residual = y - (F.col("level") + explained)
    row = scored.select(
        residual.alias("r"), F.abs(y - overall).alias("d"), F.abs(y - F.col("median")).alias("dg")
    ).agg(
        F.sum(F.col("r") * F.col("r")).alias("sse"),
        F.avg(F.abs("r")).alias("mae"),
        F.avg("d").alias("mae_median"),
        F.avg("dg").alias("mae_group"),
        F.avg(F.exp("r")).alias("smearing"),
    ).first()

    solved = solve(moments, row["sse"])
    df = solved.freedom
    variances = np.diag(solved.inverse) * (row["sse"] / df) if df > 0 else np.zeros(len(names))
    vif = list(zip(names, vif_values(moments.total[:-1, :-1]), strict=True))
    return HedonicFit(
        names=tuple(names),
        effects=tuple(float(b) for b in effects),
        coefficients=spark.createDataFrame(
            _coefficient_rows(names, effects, variances, df), COEFFICIENTS
        ),
        fixed_effects=fixed,
        vif=spark.createDataFrame(vif, "feature string, vif double"),
        intercept=intercept,
        n_rows=moments.n,
        n_levels=moments.groups,
        rank=solved.rank,
        r2=solved.r2,
        adj_r2=solved.adj_r2,
        sse=row["sse"],
        model_mae=row["mae"],
        baseline_median_mae=row["mae_median"],
        baseline_group_mae=row["mae_group"],
        smearing=row["smearing"],
        factors=factors or {},
    )


def predict(features: DataFrame, fit: HedonicFit, group: str = "neighbourhood") -> DataFrame:
    """Add ``predicted_log_price`` and the smearing-corrected ``predicted_price``.

    A location the model has not seen is scored at the baseline location.
    """
    known = fit.fixed_effects.withColumnRenamed("neighbourhood", group)
    joined, explained = linear_part(
        join_same(features, known, [group], ["fixed_effect"]), fit.names, fit.effects, fit.factors
    )
    log_price = F.lit(fit.intercept) + explained + F.coalesce("fixed_effect", F.lit(0.0))
    return joined.select(
        *[quoted(c) for c in features.columns], log_price.alias("predicted_log_price")
    ).withColumn("predicted_price", F.exp("predicted_log_price") * F.lit(fit.smearing))


def top_drivers(coefficients: DataFrame, k: int) -> DataFrame:
    """The k largest absolute effects, with the implied percentage change."""
    return (
        coefficients.orderBy(F.desc(F.abs("effect")), "feature")
        .limit(k)
        .select("feature", "effect", F.expm1("effect").alias("percent_effect"))
    )

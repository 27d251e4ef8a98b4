"""Statistics over tables of experiment results.

These tables have one row per configuration and stay small; numeric routines
that SQL can't express run per group in pandas.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idforge.operators.lineage import cut
from idforge.operators.ordering import dense_index
from idforge.operators.student import normal_p_value, t_p_value, t_quantile


def run_statistics(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, minimum, maximum, count and 95 % t interval; no interval for a single run."""
    s = runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("runs"))
    half = F.when(F.col("runs") > 1, t_quantile(F.col("runs") - 1) * F.col("std") / F.sqrt("runs"))
    return s.select("*", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def paired_test(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Paired t test and Wilcoxon's signed-rank test of a - b, both two-sided.

    ``pairs``, ``difference``, ``t``, ``t_p``, ``w_plus``, ``w_minus``, ``z``,
    ``w_p``. Wilcoxon leaves out differences of 0, gives ties their mean rank
    and takes the normal approximation with the variance that ties leave.
    p values are null where a test has nothing to go on. The differences are
    numbered over range partitions, so a pair per query is no matter.
    """
    j = cut(a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys).select((F.col("x") - F.col("y")).alias("d")), "differences")
    placed = dense_index(j.where("d <> 0").select(F.abs("d").alias("a"), "d"), ["a"], "i", 1)
    ties = placed.groupBy("a").agg(F.avg("i").alias("r"), F.count("*").alias("k"), F.count_if(F.col("d") > 0).alias("up"))
    k, n = F.col("k"), F.sum("k")
    ranks = ties.agg(
        F.coalesce(F.sum(F.col("r") * F.col("up")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("r") * (k - F.col("up"))), F.lit(0.0)).alias("w_minus"),
        (n * (n + 1) / 4).alias("middle"), ((n * (n + 1) * (2 * n + 1) - F.sum(k * k * k - k) / 2) / 24).alias("variance"),
    ).first()
    z = (min(ranks["w_plus"], ranks["w_minus"]) - ranks["middle"]) / ranks["variance"] ** 0.5 if ranks["variance"] else None
    t = j.agg(F.count("*").alias("pairs"), F.avg("d").alias("difference"), F.stddev_samp("d").alias("std"))
    t = t.select("pairs", "difference", F.when(F.col("std") > 0, F.col("difference") / (F.col("std") / F.sqrt("pairs"))).alias("t"))
    z = F.lit(z).cast("double")
    return t.select("*", t_p_value(F.col("t"), F.col("pairs") - 1).alias("t_p"), F.lit(ranks["w_plus"]).alias("w_plus"), F.lit(ranks["w_minus"]).alias("w_minus"), z.alias("z"), normal_p_value(z).alias("w_p"))


def kendall(df: DataFrame, keys: list[str], x: str, y: str, fewest: int = 4, most: int = 5_000) -> DataFrame:
    """Kendall's tau-b and R squared within each group of at least ``fewest`` rows: keys, ``tau``, ``r2``, ``n``.

    ``keys`` may be empty for the pooled figures. Pairs are formed within a
    group of configurations; a group of more than ``most`` raises, as this is
    no operator for rows that grow with the data.
    """
    large = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if large > most:
        raise ValueError(f"{large} configurations in a group, more than {most}")
    base = df.withColumn("_i", F.xxhash64(*df.columns))
    k = keys or ["_all"]
    base = base if keys else base.withColumn("_all", F.lit(0))
    a, b = base.select(*k, "_i", F.col(x).alias("x"), F.col(y).alias("y")), base.select(*k, F.col("_i").alias("_j"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    p = a.join(b, k).where("_i < _j").select(*k, F.signum(F.col("x") - F.col("x2")).alias("sx"), F.signum(F.col("y") - F.col("y2")).alias("sy"))
    tau = F.sum(F.col("sx") * F.col("sy")) / F.sqrt(F.sum(F.abs("sx")) * F.sum(F.abs("sy")))
    t = p.groupBy(*k).agg(tau.alias("tau"))
    r = base.groupBy(*k).agg(F.pow(F.corr(x, y), 2).alias("r2"), F.count("*").alias("n")).where(F.col("n") >= fewest)
    return t.join(r, k).select(*keys, "tau", "r2", "n")


def grid_pivot(df: DataFrame, row: str, column: str, values: list, metric: str) -> DataFrame:
    """One row per ``row`` value and one column per given value of ``column``."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(metric))


def full_grid(df: DataFrame, row: str, column: str, metric: str, most: int = 10_000) -> DataFrame:
    """Every combination of the two keys with its mean metric, null where there is none. More than ``most`` values of ``column`` raise."""
    values = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"more than {most} values of {column}")
    kind = df.schema[column].dataType
    cells = df.select(row).distinct().withColumn(column, F.explode(F.array(*(F.lit(v).cast(kind) for v in values)) if values else F.array().cast(f"array<{kind.simpleString()}>")))
    return cells.join(df.groupBy(row, column).agg(F.avg(metric).alias(metric)), [row, column], "left")


def winners(df: DataFrame, keys: list[str], name: str, metric: str) -> DataFrame:
    """Best configuration of each cell, the second, and the gap: keys, ``winner``, ``best``, ``runner_up``, ``gap``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(metric), name)
    r = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2)
    pick = lambda c, k: F.max(F.when(F.col("_r") == k, F.col(c)))
    return r.groupBy(*keys).agg(pick(name, 1).alias("winner"), pick(metric, 1).alias("best"), pick(name, 2).alias("runner_up"), (pick(metric, 1) - pick(metric, 2)).alias("gap"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.median(value).alias("median"))


def linear_fit(df: DataFrame, x: str, y: str, keep: Column) -> DataFrame:
    """Slope, intercept and R squared over the rows to keep, and how many were set aside."""
    k = df.withColumn("_k", keep)
    return k.agg(F.regr_slope(F.when(F.col("_k"), F.col(y)), F.col(x)).alias("slope"), F.regr_intercept(F.when(F.col("_k"), F.col(y)), F.col(x)).alias("intercept"), F.regr_r2(F.when(F.col("_k"), F.col(y)), F.col(x)).alias("r2"), F.count_if(~F.col("_k")).alias("set_aside"))


def value_census(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, mean, maximum, null and NaN counts of each column."""
    stack = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    v = df.selectExpr(f"stack({len(columns)}, {stack}) as (name, v)")
    return v.groupBy("name").agg(F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.isnan("v")).alias("nans"))


def length_statistics(df: DataFrame, column: str) -> DataFrame:
    n = F.length(column)
    return df.agg(F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"))


def token_sort(df: DataFrame, column: str) -> DataFrame:
    """Numeric tokens by value first, then the others by text: ``place`` from 1."""
    number = F.col(column).try_cast("int")
    keyed = df.withColumn("_text", number.isNull()).withColumn("_number", number)
    return dense_index(keyed, ["_text", "_number", column], "place", 1).drop("_text", "_number")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows updated by new ones with the same keys: a null in the new row keeps the old value, new columns are added."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    values = [c for c in both.columns if c not in (*keys, "_new")]
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_new"))).alias(c) for c in values]
    return both.groupBy(*keys).agg(*latest)


def joined_results(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that first makes sure the right side has one row per key."""
    if not right.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("the right side has several rows for a key")
    return left.join(right, keys)


def parameter_grid(spark, parts: list[list[dict]]) -> DataFrame:
    """Cartesian product of parameter lists; parameters of one list vary together. Numbered from 0."""
    rows = reduce(lambda done, part: [a | b for a in done for b in part], parts, [{}])
    return spark.createDataFrame([{"number": k} | r for k, r in enumerate(rows)])


def resume(grid: DataFrame, checkpoints: DataFrame, stages: DataFrame, keys: list[str]) -> DataFrame:
    """Where each experiment of a grid goes on: keys, ``done`` (the last stage with a checkpoint), ``next``; null where there is none.

    ``checkpoints`` has keys and ``stage``; ``stages`` (``stage``, ``step``) is
    the short list of stages in order.
    """
    steps = stages.select("stage", "step")
    last = checkpoints.join(F.broadcast(steps), "stage").groupBy(*keys).agg(F.max_by("stage", "step").alias("done"), F.max("step").alias("_at"))
    each = grid.select(*keys).distinct().join(last, keys, "left").withColumn("_at", F.coalesce("_at", F.lit(0)) + 1)
    return each.join(F.broadcast(steps.select(F.col("step").alias("_at"), F.col("stage").alias("next"))), "_at", "left").select(*keys, "done", "next")


def _ranks(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rank().to_numpy()


def _residual(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return y - z @ np.linalg.lstsq(z, y, rcond=None)[0]


def partial_spearman(df: DataFrame, group: str, x: str, y: str, controls: list[str], dummies: list[str] = (), draws: int = 2000, seed: int = 42) -> DataFrame:
    """Spearman correlation with the controls' ranks and the dummies' categories taken out, and its bootstrap interval.

    A category gives an indicator column (the first one of each dummy is the
    base). Without any spread left the correlation is NaN.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([x, y, *controls, *dummies]).reset_index(drop=True)
        marks = [pd.get_dummies(g[c].astype(str), drop_first=True).to_numpy(float) for c in dummies]
        z = np.column_stack([np.ones(len(g)), *(_ranks(g[c].to_numpy(float)) for c in controls), *marks])

        def r(rows: np.ndarray) -> float:
            a, b = (_residual(_ranks(g[c].to_numpy(float)[rows]), z[rows]) for c in (x, y))
            n = np.sqrt((a @ a) * (b @ b))
            return float(a @ b / n) if n > 1e-12 else float("nan")

        rng = np.random.default_rng(seed)
        boot = [r(rng.integers(0, len(g), len(g))) for _ in range(draws)] if len(g) > 3 else [float("nan")]
        low, high = np.nanpercentile(boot, [2.5, 97.5]) if not np.isnan(boot).all() else (float("nan"),) * 2
        return pd.DataFrame({group: [g[group].iloc[0]], "rho": [r(np.arange(len(g)))], "low": [low], "high": [high], "n": [len(g)]})

    kind = df.schema[group].dataType.simpleString()
    return df.groupBy(group).applyInPandas(run, f"{group} {kind}, rho double, low double, high double, n bigint")


def leave_one_out(df: DataFrame, group: str, features: list[str], y: str) -> DataFrame:
    """R squared of a linear model whose every prediction leaves its row out (by the hat matrix)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(g)), g[features].to_numpy(float)])
        t = g[y].to_numpy(float)
        hat = x @ np.linalg.pinv(x)
        e = (t - hat @ t) / np.maximum(1 - np.diag(hat), 1e-12)
        total = ((t - t.mean()) ** 2).sum()
        return pd.DataFrame({group: [g[group].iloc[0]], "r2": [1 - (e**2).sum() / total if total else float("nan")], "n": [len(g)]})

    kind = df.schema[group].dataType.simpleString()
    return df.groupBy(group).applyInPandas(run, f"{group} {kind}, r2 double, n bigint")


def regression_band(df: DataFrame, group: str, x: str, y: str, points: int = 10, draws: int = 200, seed: int = 42) -> DataFrame:
    """Bootstrap band of a fitted line at evenly spaced points."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([x, y]).reset_index(drop=True)
        a, b = g[x].to_numpy(float), g[y].to_numpy(float)
        at = np.linspace(a.min(), a.max(), points)
        rng = np.random.default_rng(seed)
        lines = []
        for _ in range(draws):
            k = rng.integers(0, len(a), len(a))
            if np.ptp(a[k]) > 0:
                lines.append(np.polyval(np.polyfit(a[k], b[k], 1), at))
        lines = np.array(lines) if lines else np.full((1, points), np.nan)
        return pd.DataFrame({group: g[group].iloc[0], "x": at, "low": np.percentile(lines, 2.5, axis=0), "high": np.percentile(lines, 97.5, axis=0)})

    kind = df.schema[group].dataType.simpleString()
    return df.groupBy(group).applyInPandas(run, f"{group} {kind}, x double, low double, high double")

"""Log-ratio coordinates and covariate adjustment of composition vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compovec.functions import arrays as A


def add_coordinates(df: DataFrame, dim: int, prop: str = "prop", eps: float | Column = A.PSEUDOCOUNT) -> DataFrame:
    """Add ``clr`` (dim) and ``ilr`` (dim - 1); narrow."""
    d = df.withColumn("clr", A.clr(F.col(prop), eps))
    return d.withColumn("ilr", A.ilr(F.col("clr"), dim))


def vector_means(df: DataFrame, cols: dict[str, int], by: list[str]) -> DataFrame:
    """Mean vector per group: one aggregation of partial sums."""
    means = [F.array(*[F.avg(F.get(F.col(c), F.lit(i))) for i in range(d)]).alias(f"mean_{c}") for c, d in cols.items()]
    return df.groupBy(*by).agg(F.count("*").alias("_n"), *means)


def residualise(df: DataFrame, cols: dict[str, int], by: list[str] = ["report_type"], means: DataFrame | None = None) -> DataFrame:
    """Residuals on an intercept and group indicators: value minus group mean.

    Least squares on indicators fits exactly the group means, so no solve is
    needed.  ``means`` applies another cohort's coefficients to outside rows.
    The mean table has one row per group of a fixed categorical design, hence
    the broadcast.
    """
    m = vector_means(df, cols, by) if means is None else means
    j = df.join(F.broadcast(m), by)
    for c in cols:
        j = j.withColumn(f"{c}_res", A.subtract(F.col(c), F.col(f"mean_{c}")))
    return j.drop("_n", *[f"mean_{c}" for c in cols])


def ols_residuals(df: DataFrame, design: list[str], cols: dict[str, int]) -> DataFrame:
    """Residuals on a general small design: normal-equation sums in Spark, a p-by-p solve on the driver."""
    import numpy as np

    x = [F.lit(1.0)] + [F.col(c).cast("double") for c in design]
    p = len(x)
    gram = [F.sum(x[i] * x[j]) for i in range(p) for j in range(p)]
    cross = [F.array(*[F.sum(xi * F.get(F.col(c), F.lit(k))) for xi in x for k in range(d)]).alias(c) for c, d in cols.items()]
    row = df.agg(F.array(*gram).alias("_g"), *cross).first()
    g = np.array(row["_g"]).reshape(p, p)
    out = df
    for c, d in cols.items():
        beta = np.linalg.lstsq(g, np.array(row[c]).reshape(p, d), rcond=None)[0]
        fit = [sum((float(beta[i, k]) * x[i] for i in range(1, p)), F.lit(float(beta[0, k]))) for k in range(d)]
        out = out.withColumn(f"{c}_res", A.subtract(F.col(c), F.array(*fit)))
    return out


def zscore(df: DataFrame, col: str, dim: int, population: bool = False, by: list[str] = []) -> DataFrame:
    """Add ``z``: column z-scores; a constant column gives null (sample) or zero (population).

    The moments are one row per group, so they are broadcast.
    """
    sd = F.stddev_pop if population else F.stddev_samp
    m = df.groupBy(*by).agg(F.array(*[F.avg(F.get(F.col(col), F.lit(i))) for i in range(dim)]).alias("_m"),
                            F.array(*[sd(F.get(F.col(col), F.lit(i))) for i in range(dim)]).alias("_s"))
    if by:
        j = df.join(F.broadcast(m), by)
    else:
        j = df.withColumn("_k", F.lit(1)).join(F.broadcast(m.withColumn("_k", F.lit(1))), "_k").drop("_k")
    s = F.transform("_s", lambda x: F.when(x == 0, F.lit(1.0) if population else F.lit(None)).otherwise(x))
    d = A.subtract(F.col(col), F.col("_m"))
    return j.withColumn("z", F.zip_with(d, s, lambda x, y: x / y)).drop("_m", "_s")


def variants(df: DataFrame, names: list[str], drops: dict[str, set[str]], weights: dict[str, dict[str, float]],
             prop: str = "prop") -> DataFrame:
    """One row per input row and variant with the parts that remain.

    Dropped parts shorten the vector, weights multiply it; a handful of literal
    variants is exploded in-row.
    """
    items = []
    for v, dropped in drops.items():
        keep = [i for i, n in enumerate(names) if n not in dropped]
        items.append(F.struct(F.lit(v).alias("variant"), F.array(*[F.get(F.col(prop), F.lit(i)) for i in keep]).alias("parts")))
    for v, w in weights.items():
        parts = [F.get(F.col(prop), F.lit(i)) * F.lit(float(w.get(n, 1.0))) for i, n in enumerate(names)]
        items.append(F.struct(F.lit(v).alias("variant"), F.array(*parts).alias("parts")))
    return df.withColumn("_v", F.explode(F.array(*items))).select(*df.columns, "_v.variant", "_v.parts")


def sweep_pseudocounts(df: DataFrame, values: list[float], dim: int, prop: str = "prop") -> DataFrame:
    """Coordinates under every pseudocount, keyed by ``eps``; one plan for all settings."""
    d = df.withColumn("eps", F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return add_coordinates(d, dim, prop, F.col("eps"))


def helmert(dim: int):
    """The basis as a matrix, for the driver."""
    import numpy as np

    i = np.arange(dim - 1)
    rows = np.arange(dim)[:, None]
    scale = np.sqrt((i + 1.0) / (i + 2.0))
    return np.where(rows <= i, 1.0 / (i + 1.0), np.where(rows == i + 1, -1.0, 0.0)) * scale

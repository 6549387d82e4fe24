"""Vector arithmetic on ``array<double>`` columns, all JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PSEUDOCOUNT = 1e-6   # fixed value: zero replacement of the log-ratio coordinates


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    An expression used inside a lambda is otherwise computed again for every
    element, which makes a row total quadratic.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def closure(a: Column) -> Column:
    """Divide by the row total; an all-zero row stays zero."""
    return let(a, lambda v: let(total(v), lambda s: F.transform(
        v, lambda x: F.when(s == 0, F.lit(0.0)).otherwise(x / s))))


def clr(p: Column, eps: float | Column = PSEUDOCOUNT) -> Column:
    """Centred log-ratio after zero replacement and re-closure.

    Re-closing divides every part by the same total, which the centring removes
    again, so one logarithm per part is enough.
    """
    e = eps if isinstance(eps, Column) else F.lit(eps)
    logs = F.transform(p, lambda x: F.ln(x + e))
    return let(logs, lambda v: let(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m)))


def ilr(clr_col: Column, dim: int) -> Column:
    """Orthonormal (Helmert) coordinates of a CLR vector, one expression per coordinate.

    Coordinate ``i`` contrasts the mean of parts ``0..i`` with part ``i+1``.
    """
    out = []
    run = clr_col[0]
    for i in range(dim - 1):
        scale = math.sqrt((i + 1) / (i + 2))
        out.append(F.lit(scale) * (run / F.lit(float(i + 1)) - clr_col[i + 1]))
        run = run + clr_col[i + 1]
    return F.array(*out)


def ilr_of_any_length(clr_col: Column) -> Column:
    """The coordinates of ``ilr`` where rows differ in the number of parts; fewer than two parts have none."""
    def coordinate(v: Column, i: Column) -> Column:
        n = i.cast("double")
        return F.sqrt(n / (n + 1)) * (total(F.slice(v, F.lit(1), i)) / n - F.get(v, i))

    return let(clr_col, lambda v: F.when(F.size(v) > 1, F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: coordinate(v, i)))
               .otherwise(F.array().cast("array<double>")))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is missing or zero."""
    return let(norm(a) * norm(b), lambda n: dot(a, b) / F.when(n > 0, n))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def quadratic_form(d: Column, matrix) -> Column:
    """``d' M d`` for a small fixed matrix passed as nested Python lists."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in matrix])
    return dot(d, F.transform(rows, lambda r: dot(r, d)))


def project(d: Column, loadings) -> Column:
    """``L d`` for a small fixed matrix, one output per row of ``L``."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in loadings])
    return F.transform(rows, lambda r: dot(r, d))


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def correlation(x, y) -> Column:
    """Pearson correlation as an aggregate; null for a constant column instead of a division error."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy))

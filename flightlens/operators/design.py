"""Treatment-coded designs and their sufficient statistics.

A design is an explicit term list (intercept, factors with an ordered level
list whose first level is the reference, boolean flags, numeric columns).
Two ways to use it:

* ``linear_predictor`` -- the fitted model as ONE Catalyst expression
  (CASE per factor), so scoring stays JVM-side and needs no join;
* the fits. ``moments`` groups the rows by the factors only, whose level
  lists bound the number of cells whatever the number of rows, and keeps
  power sums of the numeric column and of y; ``moment_products`` turns cells
  into X'WX and X'r, added up per task with numpy; only p*p + p*k numbers reach
  the driver. Logistic fits take the design's columns as Spark ML vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package


@dataclass(frozen=True)
class Factor:
    column: str
    levels: tuple  # first level = reference, no column of its own
    label: str | None = None

    @property
    def prefix(self) -> str:
        return self.label or f"C({self.column})"

    def names(self) -> list[str]:
        return [f"{self.prefix}[T.{lv}]" for lv in self.levels[1:]]


@dataclass(frozen=True)
class Flag:
    column: str

    def names(self) -> list[str]:
        return [f"{self.column}[T.True]"]


@dataclass(frozen=True)
class Numeric:
    column: str

    def names(self) -> list[str]:
        return [self.column]


@dataclass(frozen=True)
class Design:
    terms: tuple
    intercept: bool = True

    @property
    def names(self) -> list[str]:
        out = ["Intercept"] if self.intercept else []
        for t in self.terms:
            out.extend(t.names())
        return out

    @property
    def width(self) -> int:
        return len(self.names)

    @property
    def source_columns(self) -> list[str]:
        return [t.column for t in self.terms]

    def term_family(self) -> list[str]:
        out = ["Intercept"] if self.intercept else []
        for t in self.terms:
            fam = t.prefix if isinstance(t, Factor) else t.column
            out.extend([fam] * len(t.names()))
        return out

    def term_level(self) -> list:
        out = [None] if self.intercept else []
        for t in self.terms:
            out.extend(list(t.levels[1:]) if isinstance(t, Factor) else [None])
        return out

    def term_column(self) -> list:
        out = [None] if self.intercept else []
        for t in self.terms:
            out.extend([t.column] * len(t.names()))
        return out

    # -- Spark side -------------------------------------------------------------
    def indicator_columns(self) -> list[Column]:
        """One double column per non-intercept design column (for Spark ML)."""
        cols = []
        for t in self.terms:
            c = F.col(t.column)
            if isinstance(t, Factor):
                cols.extend(F.when(c == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0)) for lv in t.levels[1:])
            elif isinstance(t, Flag):
                cols.append(F.when(c, F.lit(1.0)).otherwise(F.lit(0.0)))
            else:
                cols.append(c.cast("double"))
        return cols

    def linear_predictor(self, coef: Sequence[float], intercept: float | None = None) -> Column:
        """x'b as one expression; an unseen level contributes 0 (all-zero row)."""
        coef = list(map(float, coef))
        k = 0
        if self.intercept and intercept is None:
            intercept = coef[0]
            k = 1
        expr = F.lit(float(intercept or 0.0))
        for t in self.terms:
            c = F.col(t.column)
            if isinstance(t, Factor):
                n = len(t.levels) - 1
                case = F.lit(0.0)
                if n:
                    case = F.when(c == F.lit(t.levels[1]), F.lit(coef[k]))
                    for lv, b in zip(t.levels[2:], coef[k + 1:k + n]):
                        case = case.when(c == F.lit(lv), F.lit(b))
                    case = case.otherwise(F.lit(0.0))
                expr = expr + case
                k += n
            elif isinstance(t, Flag):
                expr = expr + F.when(c, F.lit(coef[k])).otherwise(F.lit(0.0))
                k += 1
            else:
                expr = expr + F.lit(coef[k]) * c.cast("double")
                k += 1
        return expr

    # -- numpy side -------------------------------------------------------------
    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        n = len(pdf)
        blocks = [np.ones((n, 1))] if self.intercept else []
        for t in self.terms:
            v = pdf[t.column]
            if isinstance(t, Factor):
                codes = pd.Categorical(v, categories=list(t.levels)).codes
                m = np.zeros((n, len(t.levels)))
                ok = codes >= 0
                m[np.nonzero(ok)[0], codes[ok]] = 1.0
                blocks.append(m[:, 1:])
            elif isinstance(t, Flag):
                blocks.append(v.astype(bool).to_numpy(dtype=float).reshape(-1, 1))
            else:
                blocks.append(v.to_numpy(dtype=float).reshape(-1, 1))
        return np.hstack(blocks) if blocks else np.zeros((n, 0))


def _numeric(design: Design) -> Numeric | None:
    found = [t for t in design.terms if isinstance(t, Numeric)]
    if len(found) > 1:
        raise ValueError("power sums are kept for one numeric column at most")
    return found[0] if found else None


def _powers(numeric: bool, degree: int) -> set[tuple[int, int]]:
    """(power of x, power of y) of the sums that squared (and fourth-power) residuals need."""
    need = {(a, 0) for a in range(3 if numeric else 1)}
    if degree:
        for a in range(3 if numeric else 1):
            need |= {(a, 0), (a, 1), (a, 2)}
            if numeric:
                need |= {(a + 1, 0), (a + 2, 0), (a + 1, 1)}
    if degree == 4:
        need |= {(a, b) for a in range(5 if numeric else 1) for b in range(5 - a)}
    return need


def power_name(prefix: str, a: int, b: int) -> str:
    return f"{prefix}_{a}_{b}" if b else f"x{a}"


def moments(df: DataFrame, design: Design, targets: dict[str, tuple[Column, int]] | None = None) -> DataFrame:
    """Cells of equal factor values with power sums: one scan, partial sums before the shuffle.

    ``targets``: prefix -> (y, degree); degree 2 serves the fit and its
    errors, 4 also Breusch-Pagan. Columns: the factors, ``x{a}`` = sum of x^a
    (``x0`` = rows) and ``{prefix}_{a}_{b}`` = sum of x^a y^b.
    """
    num = _numeric(design)
    x = F.col(num.column).cast("double") if num else None

    def power(c, k):
        out = F.lit(1.0)
        for i in range(k):
            out = c if i == 0 else out * c
        return out

    sums = {}
    for prefix, (y, degree) in {**(targets or {}), "": (None, 0)}.items():
        for a, b in sorted(_powers(num is not None, degree)):
            term = power(x, a) if not b else power(y, b) if not a else power(x, a) * power(y, b)
            sums[power_name(prefix, a, b)] = F.sum(term)
    keys = [t.column for t in design.terms if t is not num]
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])


Prep = Callable[[pd.DataFrame, np.ndarray], tuple]


def _sum_by_position(parts: DataFrame, shapes: Sequence[tuple]) -> list[np.ndarray]:
    """Adds the ``k, v`` rows of all tasks and cuts the total into arrays."""
    sizes = [int(np.prod(s)) for s in shapes]
    total = np.zeros(sum(sizes))
    for r in parts.groupBy("k").agg(F.sum("v").alias("v")).collect():
        total[r["k"]] = r["v"]
    return [x.reshape(s) for x, s in zip(np.split(total, np.cumsum(sizes)[:-1]), shapes)]


def moment_products(cell_df: DataFrame, design: Design, prep: Prep, n_rhs: int,
                    n_scalars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'WX, X'R and scalars from cells of ``moments``.

    ``prep(pdf, F)`` gets the cells and their factor columns and gives
    ``(W, R, s)``: ``W[a]`` the per-cell sums of w x^a (a = 0..2; a = 0 only
    without a numeric column), ``R`` a list of n_rhs such sums (a = 0..1),
    ``s`` n_scalars numbers.
    """
    num = _numeric(design)
    factors = Design(tuple(t for t in design.terms if t is not num), design.intercept)
    p, q = design.width, factors.width

    def per_partition(batches):
        G, B, S = np.zeros((p, p)), np.zeros((p, n_rhs)), np.zeros(n_scalars)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = factors.matrix(pdf)
            W, R, s = prep(pdf, X)
            G[:q, :q] += (X.T * W[0]) @ X
            for k, r in enumerate(R):
                B[:q, k] += X.T @ r[0]
            if num:
                side = X.T @ W[1]
                G[:q, q] += side
                G[q, :q] += side
                G[q, q] += W[2].sum()
                for k, r in enumerate(R):
                    B[q, k] += r[1].sum()
            S += s
        acc = np.concatenate([G.ravel(), B.ravel(), S])
        yield pd.DataFrame({"k": np.arange(len(acc), dtype=np.int64), "v": acc})

    ship_package(cell_df.sparkSession)
    G, B, S = _sum_by_position(cell_df.mapInPandas(per_partition, "k long, v double"),
                               [(p, p), (p, n_rhs), (n_scalars,)])
    at = order(design)
    return G[np.ix_(at, at)], B[at], S


def order(design: Design) -> np.ndarray:
    """Position of each design column among (factor columns, numeric column)."""
    num, at, k = _numeric(design), [0] if design.intercept else [], int(design.intercept)
    for t in design.terms:
        n = 0 if t is num else len(t.names())
        at += [design.width - 1] if t is num else list(range(k, k + n))
        k += n
    return np.array(at, dtype=int)

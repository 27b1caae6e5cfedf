"""Iterative solvers on sparse matrices (i, j, a) and vectors (i, x): each vector is a table, each dot product one row."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.mathx import d
from tidewatch.operators.graph import laplacian
from tidewatch.operators.grid import cut


def _ready(matrix: DataFrame) -> DataFrame:
    """The matrix by column, kept in that partitioning for all rounds; lost parts are read again from the stored table."""
    n = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(matrix.groupBy("i", "j").agg(F.sum("a").alias("a"))).repartition(n, "j").persist()


def _times(ready: DataFrame, vector: DataFrame, column: str) -> DataFrame:
    """(i, ap): the kept matrix times a column of a vector; only the vector and the partial sums are shuffled."""
    return ready.join(vector.select(F.col("i").alias("j"), F.col(column).alias("_x")), "j").groupBy("i").agg(F.sum(F.col("a") * F.col("_x")).alias("ap"))


@dataclass(frozen=True)
class Solved:
    """The solution (i, x, residual), the relative residual norm, the rounds, and whether the norm got below the tolerance."""

    x: DataFrame
    residual: float
    rounds: int
    converged: bool


def sines(df: DataFrame, along: str, by: str, n: int, value: str) -> DataFrame:
    """(r, q, value): the sine transform of each line of ``n`` cells, a line in one group. Missing cells are 0."""

    def line(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(n)
        x[pdf[along].to_numpy()] = pdf[value].to_numpy()
        out = -np.fft.rfft(np.r_[0.0, x, 0.0, -x[::-1]]).imag[1 : n + 1] / 2
        return pd.DataFrame({along: np.arange(n), by: pdf[by].iloc[0], value: out})[["r", "q", value]]

    return df.select("r", "q", value).groupBy(by).applyInPandas(line, f"r long, q long, {value} double")


def sine_inverse(height: int, width: int, dx: float = 1.0, dy: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """The inverse of the negative five-point Laplacian with zero borders on a full raster, as a map of (i, r) to (i, z).

    The sine transforms of rows and columns make the matrix diagonal, so a call is four shuffles by lines, whatever the
    size; i is row * width + column.
    """
    wave = lambda c, n, step: (d(2) - d(2) * F.cos((F.col(c) + 1) * d(math.pi / (n + 1)))) / d(step * step)

    def apply(residual: DataFrame) -> DataFrame:
        at = residual.select(F.floor(F.col("i") / width).alias("r"), (F.col("i") % width).alias("q"), F.col("r").alias("z"))
        both = sines(sines(at, "q", "r", width, "z"), "r", "q", height, "z")
        even = both.withColumn("z", F.col("z") * d(4 / ((height + 1) * (width + 1))) / (wave("r", height, dy) + wave("q", width, dx)))
        back = sines(sines(even, "r", "q", height, "z"), "q", "r", width, "z")
        return back.select((F.col("r") * width + F.col("q")).alias("i"), "z")

    return apply


def conjugate_gradients(matrix: DataFrame, rhs: DataFrame, tol: float = 1e-10, most: int = 1000, precondition: Callable[[DataFrame], DataFrame] | None = None) -> Solved:
    """Solves a symmetric positive definite system by conjugate gradients with the diagonal as preconditioner, or another.

    ``precondition`` maps residuals (i, r) to (i, z) by a symmetric positive definite approximation of the inverse; the
    rounds follow how near it is. Rows that it leaves out take the diagonal.

    The iteration ends when the norm of the residual is ``tol`` of the right side's, or after ``most`` rounds, which the
    result tells. The residuals returned are b - A x of the solution itself, not the iteration's. Rows that only the
    matrix or only ``rhs`` names take part; the latter have no diagonal. A missing or non-positive diagonal, or a
    direction of no positive energy, raises ValueError. A right side of zeros has the solution zero.
    """
    ready = _ready(matrix)
    try:
        diagonal = ready.where("i = j").select("i", F.col("a").alias("dg"))
        nodes = ready.select("i").unionByName(rhs.select("i")).distinct()
        state = cut(
            nodes.join(diagonal, "i", "left").join(rhs.select("i", F.col("x").cast("double").alias("b")), "i", "left").select("i", F.coalesce("dg", d(0)).alias("dg"), F.coalesce("b", d(0)).alias("b"))
        ).withColumns({"x": d(0), "r": F.col("b"), "p": F.col("b") / F.col("dg")})
        bad, bb = state.agg(F.count_if(~(F.col("dg") > 0)), F.sum(F.col("b") * F.col("b"))).first()
        if bad:
            raise ValueError(f"{bad} rows have no positive diagonal")
        rr, rounds = bb, 0
        r, ap = F.col("r"), F.col("ap")
        ready_for = lambda s: cut(s.join(precondition(s.select("i", "r")), "i", "left").withColumn("z", F.coalesce("z", F.col("r") / F.col("dg"))))
        if precondition and bb:
            state = ready_for(state.drop("p")).withColumn("p", F.col("z"))
            zr = state.agg(F.sum(F.col("z") * r)).first()[0]
        while precondition and bb and math.sqrt(rr / bb) > tol and rounds < most:
            held = cut(state.join(_times(ready, state, "p"), "i", "left").withColumn("ap", F.coalesce("ap", d(0))))
            energy = held.agg(F.sum(F.col("p") * ap)).first()[0]
            if not (energy > 0 and zr > 0):
                raise ValueError("the matrix or its preconditioner is not positive definite")
            step = d(zr / energy)
            state = ready_for(cut(held.select("i", "dg", "b", (F.col("x") + step * F.col("p")).alias("x"), (r - step * ap).alias("r"), "p")))
            rr, fresh = state.agg(F.sum(r * r), F.sum(F.col("z") * r)).first()
            state, zr = state.withColumn("p", F.col("z") + d(fresh / zr) * F.col("p")), fresh
            rounds += 1
        while not precondition and bb and math.sqrt(rr / bb) > tol and rounds < most:
            held = cut(state.join(_times(ready, state, "p"), "i", "left").withColumn("ap", F.coalesce("ap", d(0))))
            # the sums of this round's residual, and by them those of the next
            sums = [F.col("p") * ap, r * r, r * ap, ap * ap, r * r / F.col("dg"), r * ap / F.col("dg"), ap * ap / F.col("dg")]
            energy, rr, ra, aa, zr, za, zz = held.agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(sums)]).first()
            if not energy > 0:
                raise ValueError("the matrix is not positive definite")
            step = zr / energy
            rr, turn = max(rr - 2 * step * ra + step * step * aa, 0.0), max(zr - 2 * step * za + step * step * zz, 0.0) / zr
            left = r - d(step) * ap
            state = held.select("i", "dg", "b", (F.col("x") + d(step) * F.col("p")).alias("x"), left.alias("r"), (left / F.col("dg") + d(turn) * F.col("p")).alias("p"))
            rounds += 1
        done = cut(state.select("i", "b", "x"))
        true = cut(done.join(_times(ready, done, "x"), "i", "left").select("i", "x", (F.col("b") - F.coalesce("ap", d(0))).alias("residual")))
        norm = math.sqrt(true.agg(F.sum(F.col("residual") * F.col("residual"))).first()[0] / bb) if bb else 0.0
        return Solved(true, norm, rounds, not bb or math.sqrt(rr / bb) <= tol)
    finally:
        ready.unpersist()


def shifted(matrix: DataFrame, identity: float, factor: float) -> DataFrame:
    """identity * I + factor * matrix, on the rows of the matrix."""
    own = matrix.select("i").distinct().select("i", F.col("i").alias("j"), d(identity).alias("a"))
    return matrix.select("i", "j", (F.col("a") * d(factor)).alias("a")).unionByName(own).groupBy("i", "j").agg(F.sum("a").alias("a"))


def implicit_step(cells: DataFrame, state: DataFrame, forcing: DataFrame, dt: float, boundary: str = "neumann", tol: float = 1e-12) -> Solved:
    """One implicit Euler step of diffusion on a raster: (I - dt L) new = state + dt forcing, vectors as (i, x)."""
    right = state.select("i", "x").unionByName(forcing.select("i", (F.col("x") * d(dt)).alias("x"))).groupBy("i").agg(F.sum("x").alias("x"))
    return conjugate_gradients(shifted(laplacian(cells, boundary=boundary), 1.0, -dt), right, tol)


@dataclass(frozen=True)
class Dominant:
    """The eigenvalue of largest size, its vector (i, x) of norm 1, |A x - value x|, the rounds, and whether it settled."""

    value: float
    vector: DataFrame
    residual: float
    rounds: int
    converged: bool


def dominant_eigenvalue(matrix: DataFrame, tol: float = 1e-9, most: int = 1000) -> Dominant:
    """Power iteration with Rayleigh quotients, from a start that a hash of the row's number gives.

    Each round is one product and one row of sums (x.y, y.y). It ends when |A x - value x|, of a vector of norm 1, is
    ``tol`` of the value, or after ``most`` rounds. Two eigenvalues of one size and opposite signs don't settle: shift the
    matrix first. A matrix without entries has the value 0.
    """
    ready = _ready(matrix)
    try:
        nodes = ready.select("i").unionByName(ready.select(F.col("j").alias("i"))).distinct()
        start = cut(nodes.select("i", (0.5 + F.pmod(F.xxhash64(F.col("i")), F.lit(1_000_003)) / 2_000_006).alias("x")))
        size = start.agg(F.sum(F.col("x") * F.col("x"))).first()[0]
        x, rounds = start.select("i", (F.col("x") / d(math.sqrt(size or 1.0))).alias("x")), 0
        value, residual, converged = 0.0, 0.0, not size
        while not converged and rounds < most:
            held = cut(x.join(_times(ready, x, "x"), "i", "left").select("i", "x", F.coalesce("ap", d(0)).alias("y")))
            value, yy = held.agg(F.sum(F.col("x") * F.col("y")), F.sum(F.col("y") * F.col("y"))).first()
            rounds += 1
            residual = math.sqrt(max(yy - value * value, 0.0))
            if yy == 0:
                converged = True
                break
            if residual <= 1e-6 * abs(value):  # the difference of squares has no more digits: add up the residuals
                residual = math.sqrt(held.agg(F.sum(F.pow(F.col("y") - d(value) * F.col("x"), 2))).first()[0])
            converged = residual <= tol * abs(value)
            x = held.select("i", (F.col("y") / d(math.sqrt(yy))).alias("x"))
        return Dominant(value, x, residual, rounds, converged)
    finally:
        ready.unpersist()

"""Varimax rotation and alignment of multi-dimensional loadings (B6 for d > 1).

The rotation of a draw needs only the sums of products of two and of four coordinates of its
loadings, which are partial aggregates by draw; the plane rotations themselves work on these
few numbers, one row per draw.  Rotated draws still differ by the order and the signs of their
axes: every draw takes the signed permutation nearest to the mean loading of all draws, in
rounds until none changes."""

from __future__ import annotations

from itertools import combinations_with_replacement, permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast, cut_lineage, forget, keep_bucketed, scalar_row

#: Plane rotations stop when no angle of a sweep is larger, or after so many sweeps.
ANGLE, SWEEPS = 1e-10, 200


def _products(d: int, degree: int):
    return list(combinations_with_replacement(range(d), degree))


def _moments(d: int, degree: int) -> F.Column:
    """Array of the sums of all products of ``degree`` elements of ``x``."""
    def product(at):
        out = F.col("x")[at[0]]
        for k in at[1:]:
            out = out * F.col("x")[k]
        return out

    return F.array(*[F.coalesce(F.sum(product(at)), F.lit(0.0)) for at in _products(d, degree)])


def _tensor(values, d: int, degree: int) -> np.ndarray:
    out = np.zeros((d,) * degree)
    for at, v in zip(_products(d, degree), values):
        for p in set(permutations(at)):
            out[p] = v
    return out


def rotation(n: float, second, fourth, d: int) -> np.ndarray:
    """d x d rotation R such that x R has the largest varimax criterion (sum over axes of the
    variance of the squared loadings), its axes by decreasing sum of squares, from the sums
    of products of two and four coordinates of n loadings.  Planes are turned one after the
    other by the angle that is best in closed form."""
    s, q, r = _tensor(second, d, 2), _tensor(fourth, d, 4), np.eye(d)
    for _ in range(SWEEPS if n else 0):
        most = 0.0
        for i in range(d):
            for j in range(i + 1, d):
                # u = x_i^2 - x_j^2, v = 2 x_i x_j
                u, v = s[i, i] - s[j, j], 2 * s[i, j]
                uu, vv = q[i, i, i, i] - 2 * q[i, i, j, j] + q[j, j, j, j], 4 * q[i, i, j, j]
                uv = 2 * (q[i, i, i, j] - q[i, j, j, j])
                angle = np.arctan2(2 * (uv - u * v / n), uu - vv - (u * u - v * v) / n) / 4
                turn = np.eye(d)
                turn[i, i] = turn[j, j] = np.cos(angle)
                turn[i, j], turn[j, i] = -np.sin(angle), np.sin(angle)
                s = turn.T @ s @ turn
                q = np.einsum("abcd,ai,bj,ck,dl->ijkl", q, turn, turn, turn, turn, optimize=True)
                r, most = r @ turn, max(most, abs(angle))
        if most < ANGLE:
            break
    return r[:, np.argsort(-np.diag(s), kind="stable")]


def rotation_of(loadings: DataFrame, d: int) -> np.ndarray:
    """The rotation of one table of loadings (``x``: array of d numbers)."""
    row = scalar_row(loadings, F.count(F.lit(1)).alias("n"), _moments(d, 2).alias("second"), _moments(d, 4).alias("fourth"))
    return rotation(row["n"], row["second"], row["fourth"], d)


def loadings_of(draws: DataFrame, variable: str, d: int) -> DataFrame:
    """(draw, idx, x) from long draws of ``variable`` whose second index is the dimension
    (from 1); dimensions that a parameter lacks are 0."""
    one = [F.coalesce(F.sum(F.when(F.col("idx2") == k + 1, F.col("value"))), F.lit(0.0)) for k in range(d)]
    return draws.where(F.col("variable") == variable).groupBy("draw", "idx").agg(F.array(*one).alias("x"))


def rotations(loadings: DataFrame, d: int) -> DataFrame:
    """(draw, by): for each draw the varimax rotation, row by row, from (draw, idx, x).  The
    rows that leave the JVM are one per draw."""
    @F.pandas_udf("array<double>")
    def best(n: pd.Series, second: pd.Series, fourth: pd.Series) -> pd.Series:
        return pd.Series([rotation(*row, d).ravel() for row in zip(n, second, fourth)])

    sums = loadings.groupBy("draw").agg(F.count(F.lit(1)).alias("n"), _moments(d, 2).alias("second"), _moments(d, 4).alias("fourth"))
    return sums.select("draw", best("n", "second", "fourth").alias("by"))


def times(x: str, by: str, d: int) -> F.Column:
    """The row vector x times the d x d matrix by."""
    return F.array(*[sum((F.col(x)[i] * F.col(by)[i * d + k] for i in range(1, d)), F.col(x)[0] * F.col(by)[k]) for k in range(d)])


def signed_permutations(d: int) -> F.Column:
    """Column that gives, from the array ``cross`` (sums of x_i ref_k, row by row), the signed
    permutation matrix, row by row, that brings x nearest to ref: the order of axes with the
    largest sum of absolute products, each with the sign of its product; the identity wins
    ties, then the first in lexicographic order."""
    candidates = []
    for number, p in enumerate(permutations(range(d))):
        # axis p[k] of x becomes axis k
        value = sum((F.abs(F.col("cross")[p[k] * d + k]) for k in range(1, d)), F.abs(F.col("cross")[p[0] * d]))
        matrix = F.array(*[F.when(F.col("cross")[i * d + k] < 0, -1.0).otherwise(1.0) if p[k] == i else F.lit(0.0)
                           for i in range(d) for k in range(d)])
        candidates.append(F.struct(value.alias("value"), F.lit(-number).alias("order"), matrix.alias("by")))
    return F.array_max(F.array(*candidates))["by"] if len(candidates) > 1 else candidates[0]["by"]


def alignment_round(loadings: DataFrame, turns: DataFrame, d: int) -> DataFrame:
    """(draw, by): one round from rotated loadings (draw, idx, x) and the signed permutations
    (draw, by) of the last round: mean loading of all draws, then the nearest signed
    permutation of each draw."""
    turned = loadings.join(turns, "draw").select("idx", times("x", "by", d).alias("x"))
    ref = turned.groupBy("idx").agg(F.array(*[F.avg(F.col("x")[k]) for k in range(d)]).alias("ref"))
    return _nearest(loadings, ref, d)


def _nearest(loadings: DataFrame, ref: DataFrame, d: int) -> DataFrame:
    cross = F.array(*[F.sum(F.col("x")[i] * F.col("ref")[k]) for i in range(d) for k in range(d)])
    return (loadings.join(ref, "idx").groupBy("draw").agg(cross.alias("cross"))
            .select("draw", signed_permutations(d).alias("by")))


def align(loadings: DataFrame, d: int, max_iter: int = 500, rotate: bool = True):
    """B6 for d > 1: (turns, rounds, converged), turns (draw, by): the d x d matrix, row by
    row, that takes the loadings of a draw to the common axes; from (draw, idx, x).

    Each draw is turned by varimax (unless ``rotate`` is off); then in every round it takes
    the signed permutation nearest to the mean loading, until none changes or ``max_iter``
    rounds.  Loadings are written once, bucketed by draw, and the mean loading (one row per
    parameter) is broadcast while it is small, so loadings do not move."""
    spark = loadings.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = keep_bucketed(loadings.select("draw", "idx", "x").repartition(n, "draw"), "draw", n)
    eye = F.array(*[F.lit(float(i == k)) for i in range(d) for k in range(d)])
    first = rotations(raw, d) if rotate else raw.select("draw").distinct().withColumn("by", eye)
    first = keep_bucketed(first, "draw", n)
    x = keep_bucketed(raw.join(first, "draw").select("draw", "idx", times("x", "by", d).alias("x")), "draw", n)
    # the first round is nearest to one draw: means of draws whose axes are in any order would be blurred
    one = scalar_row(first, F.min("draw").alias("draw"))["draw"]
    ref = cut_lineage(x.where(F.col("draw") == one).select("idx", F.col("x").alias("ref")))
    turns = keep_bucketed(_nearest(x, bounded_broadcast(ref, 16 + 8 * d), d), "draw", n)
    forget(ref)
    rounds, converged = 0, False
    while rounds < max_iter and not converged:
        rounds += 1
        turned = x.join(turns, "draw").select("idx", times("x", "by", d).alias("x"))
        ref = cut_lineage(turned.groupBy("idx").agg(F.array(*[F.avg(F.col("x")[k]) for k in range(d)]).alias("ref")))
        new = _nearest(x, bounded_broadcast(ref, 16 + 8 * d), d).join(turns.withColumnRenamed("by", "old"), "draw")
        kept = keep_bucketed(new.select("draw", "by", (F.col("by") != F.col("old")).alias("moved")), "draw", n)
        converged = kept.where("moved").limit(1).count() == 0
        forget(ref, turns)
        turns = kept.select("draw", "by")
        turns._kept = kept._kept
    both = first.join(turns.withColumnRenamed("by", "then"), "draw")
    product = [sum((F.col("by")[i * d + m] * F.col("then")[m * d + k] for m in range(1, d)), F.col("by")[i * d] * F.col("then")[k])
               for i in range(d) for k in range(d)]
    out = cut_lineage(both.select("draw", F.array(*product).alias("by")))
    forget(raw, first, x, turns)
    return out, rounds, converged


def apply_turns(loadings: DataFrame, turns: DataFrame, d: int) -> DataFrame:
    """(draw, idx, x) with each draw's matrix applied; positions take the same matrix as the
    loadings, since it is orthogonal."""
    return loadings.join(turns, "draw").select("draw", "idx", times("x", "by", d).alias("x"))

"""Array expressions for per-contest utilities (softmax, log-sum-exp, dot products)
and hash-seeded random numbers.  All are higher-order SQL functions that run
inside whole-stage code generation; nothing leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _beside(u: Column, scalar: Column) -> Column:
    """``scalar`` repeated once per element of ``u``.  A lambda body is evaluated
    per element with no common-subexpression sharing, so a per-row scalar
    (an array max, a log-sum-exp) is computed once here and zipped in instead
    of being referenced inside the lambda, which would recompute it (and the
    utilities under it) for every element."""
    return F.array_repeat(scalar, F.size(u))


def log_sum_exp(u: Column) -> Column:
    """max-shifted log(sum(exp(u))) of a double array."""
    m = F.array_max(u)
    shifted = F.zip_with(u, _beside(u, m), lambda x, mx: F.exp(x - mx))
    return m + F.log(F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x))


def softmax(u: Column) -> Column:
    """probabilities of a utility array."""
    return F.zip_with(u, _beside(u, log_sum_exp(u)), lambda x, lse: F.exp(x - lse))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equal-length double arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def inv_logit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def hash_uniform(*cols) -> Column:
    """Uniform(0,1) number that depends only on the given columns (not on
    partitioning or task retries), from 53 bits of xxhash64."""
    h = F.xxhash64(*cols)
    bits = F.shiftrightunsigned(h, 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2 ** 53))


def hash_normal(*cols) -> Column:
    """Standard normal number by Box-Muller over two hash uniforms."""
    u1 = hash_uniform(*cols, F.lit("u1"))
    u2 = hash_uniform(*cols, F.lit("u2"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def normal_lpdf(x: Column, mu, sigma) -> Column:
    mu = mu if isinstance(mu, Column) else F.lit(float(mu))
    sigma = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    z = (x - mu) / sigma
    return F.lit(-0.5 * math.log(2 * math.pi)) - F.log(sigma) - F.lit(0.5) * z * z


def student_t_lpdf_value(x: float, nu: float, mu: float, sigma: float) -> float:
    """Student-t log density of a scalar (used for the few scalar hyper-parameters)."""
    z = (x - mu) / sigma
    return (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
            - math.log(sigma) - (nu + 1) / 2 * math.log1p(z * z / nu))


def cauchy_lpdf_value(x: float, mu: float, sigma: float) -> float:
    z = (x - mu) / sigma
    return -math.log(math.pi) - math.log(sigma) - math.log1p(z * z)

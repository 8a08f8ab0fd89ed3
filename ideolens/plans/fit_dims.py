"""Posterior mode of the categorical 2PL in several dimensions (M10 on M4).

    u_c = disc_c . alpha_j - diff_c = theta_c . x_j,   theta = (disc, diff), x = (alpha, -1)

with alpha ~ N(0, I), disc ~ N(0, sigma_disc^2 I), diff ~ N(mean_diff, sigma_diff^2) and the
reference candidate at 0.  Voters and candidates have small blocks of second derivatives,
kept as packed lower triangles (row by row) in arrays and solved by a Cholesky factor in array
expressions, so nothing leaves the JVM.

The layout is that of ``fit``: votes and voter states bucketed by ``voter_id``, one array row
per contest that is broadcast or salted by its size.  A few alternating rounds estimate the
scales; joint Newton steps follow, in which each voter is eliminated by its own block and the
candidates are solved by conjugate gradients whose matrix product is a sum over votes.

The posterior is the same for all rotations of the axes (a flat direction, along which the
gradient has no part, so the conjugate gradients do not need it).  The axes of the result
are those of the varimax rotation of the discriminations (``varimax``)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import hash_normal
from ..session import BROADCAST_BYTES, cut_lineage, forget, keep_bucketed, scalar_row
from . import ballots as B
from . import fit as FT
from . import joint as J
from . import varimax as VX
from .model import with_voters

KEY = ["race_id", "candidate_id"]
#: Largest dimension: the sums over votes are written out for each pair of dimensions.
MAX_DIMS = 8
WARM_ROUNDS = 8


@dataclass
class DimsFit:
    """alpha: voter_id, alpha (array), var (array: posterior variances of its elements);
    params: race_id, candidate_id, disc (array), diff."""
    alpha: DataFrame
    params: DataFrame
    history: list = field(default_factory=list)
    mean_diff: float = 0.0
    sigma_diff: float = 1.0
    sigma_disc: float = 1.0
    iterations: int = 0
    converged: bool = False


# ---------------------------------------------------------------- small matrices in arrays

def _at(i: int, j: int) -> int:
    """Position of (i, j), j <= i, in a packed lower triangle."""
    return i * (i + 1) // 2 + j


def _lower(n: int):
    return [(i, j) for i in range(n) for j in range(i + 1)]


def _dot(x: str, y: str) -> str:
    return f"aggregate(zip_with({x}, {y}, (q, r) -> q * r), 0D, (q, r) -> q + r)"


def _vector(values) -> str:
    return f"array({', '.join(values)})"


def _axpy(x: str, a: str, y: str) -> str:
    """x + a y, a a constant."""
    return f"zip_with({x}, {y}, (q, r) -> q + {a} * r)"


def _fold(steps: str, start: dict, name: str, value: str, finish: str) -> str:
    """Array built one element a step; what a step reads is carried in the state, so that
    the columns it comes from are evaluated once."""
    state = ", ".join(f"'{k}', {v}" for k, v in start.items())
    carried = ", ".join(f"'{k}', s.{k}" for k in start)
    return (f"aggregate({steps}, named_struct({state}, '{name}', cast(array() AS array<double>)), "
            f"(s, e) -> named_struct({carried}, '{name}', concat(s.{name}, array({value}))), s -> {finish})")


def cholesky(a: str, n: int) -> str:
    """SQL text: the lower factor of the positive definite n x n matrix ``a``, both packed."""
    steps = ", ".join(f"named_struct('at', {_at(i, j)}, 'row', {_at(i, 0) + 1}, 'col', {_at(j, 0) + 1}, 'n', {j}, "
                      f"'by', {_at(j, j)}, 'diagonal', {str(i == j).lower()})" for i, j in _lower(n))
    rest = f"(get(s.a, e.at) - {_dot('slice(s.l, e.row, e.n)', 'slice(s.l, e.col, e.n)')})"
    return _fold(f"array({steps})", {"a": a}, "l", f"CASE WHEN e.diagonal THEN sqrt{rest} ELSE {rest} / get(s.l, e.by) END", "s.l")


def forward(l: str, b: str, n: int) -> str:
    """SQL text: y with L y = b."""
    steps = ", ".join(f"named_struct('i', {i}, 'row', {_at(i, 0) + 1}, 'by', {_at(i, i)})" for i in range(n))
    value = f"(get(s.b, e.i) - {_dot('slice(s.l, e.row, e.i)', 's.y')}) / get(s.l, e.by)"
    return _fold(f"array({steps})", {"l": l, "b": b}, "y", value, "s.y")


def solve(l: str, b: str, n: int) -> str:
    """SQL text: x with L L' x = b."""
    def below(i):
        at = ", ".join(str(_at(k, i)) for k in range(n - 1, i, -1))
        return f"cast(array({at}) AS array<int>)"

    steps = ", ".join(f"named_struct('i', {i}, 'by', {_at(i, i)}, 'below', {below(i)})" for i in range(n - 1, -1, -1))
    value = f"(get(s.y, e.i) - {_dot('transform(e.below, k -> get(s.l, k))', 's.x')}) / get(s.l, e.by)"
    return _fold(f"array({steps})", {"l": l, "y": forward(l, b, n)}, "x", value, "reverse(s.x)")


def inverse_diagonal(l: str, n: int) -> str:
    """SQL text: the diagonal of the inverse of L L'."""
    units = [_vector("1D" if i == k else "0D" for i in range(n)) for k in range(n)]
    return _vector(f"aggregate({forward(l, u, n)}, 0D, (q, r) -> q + r * r)" for u in units)


# ---------------------------------------------------------------- sums over votes

_PROBABILITIES = f"""
utilities AS (SELECT *, transform(p, s -> {_dot('s.theta', 'x')}) AS u FROM {{t}}),
sums AS (SELECT *, {J._LSE} AS lse FROM utilities),
probabilities AS (SELECT *, zip_with(u, {J._beside('lse', 'u')}, (a, m) -> exp(a - m)) AS prob, {J._chosen('u')} - lse AS term FROM sums)"""


def _fields(name: str, prefix: str, d: int) -> str:
    return ", ".join(f"transform(p, s -> get(s.{name}, {k})) AS {prefix}{k}" for k in range(d))


def _pulls(d: int) -> str:
    """``moved``: change of the utilities by the candidates' direction; ``pull``: the vote's
    share of its voter's rows of the product with that direction."""
    pull = _vector(f"weight * ({J._total(J._mul(f't{k}', 'bent'))} - {J._chosen(f'd{k}')} + {J._total(J._mul('prob', f'd{k}'))})" for k in range(d))
    return f"""
moves AS (SELECT *, transform(p, s -> {_dot('s.dir', 'x')}) AS moved, {_fields('theta', 't', d)}, {_fields('dir', 'd', d)} FROM probabilities),
bends AS (SELECT *, {J._curved('moved')} AS bent FROM moves),
pulls AS (SELECT *, {pull} AS pull FROM bends)"""


def _met(votes: DataFrame, voters: DataFrame, arrays: DataFrame, spread: bool) -> DataFrame:
    return FT.with_contest_arrays(with_voters(votes, voters), arrays, spread)


def contest_thetas(params: DataFrame, direction: DataFrame | None = None, name: str = "dir") -> DataFrame:
    """One row per contest: ``p``, the candidates in order with theta and, if a ``direction``
    (race_id, candidate_id, ``name``) is given, dir; candidates without one do not move."""
    if direction is None:
        rows = params.select(*KEY, "theta")
    else:
        still = F.transform("theta", lambda _: F.lit(0.0))
        rows = params.select(*KEY, "theta").join(direction.select(*KEY, F.col(name).alias("dir")), KEY, "left") \
                     .withColumn("dir", F.coalesce("dir", still))
    return rows.groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != "race_id"]))).alias("p"))


def voter_system(votes: DataFrame, voters: DataFrame, arrays: DataFrame, d: int, spread: bool = False) -> DataFrame:
    """voter_id, x, grad, curv (packed), its factor chol and term: gradient and negative
    second derivative of the log posterior in alpha, and the voter's log-likelihood, from
    votes (with weight) and voters (voter_id, x)."""
    means = ", ".join(f"{J._total(J._mul('prob', f't{k}'))} AS e{k}" for k in range(d))
    grads = ", ".join(f"{J._chosen(f't{k}')} - e{k} AS g{k}" for k in range(d))
    blocks = ", ".join(f"{J._total(J._mul('prob', J._mul(f't{i}', f't{j}')))} - e{i} * e{j} AS h{i}_{j}" for i, j in _lower(d))
    g = _vector(f"sum(weight * g{k}) - max(x[{k}])" for k in range(d))
    curv = _vector(f"sum(weight * h{i}_{j}) + {float(i == j)!r}D" for i, j in _lower(d))
    return votes.sparkSession.sql(f"""WITH {_PROBABILITIES},
parts AS (SELECT *, {_fields('theta', 't', d)} FROM probabilities),
means AS (SELECT *, {means} FROM parts),
each AS (SELECT voter_id, x, weight, term, {grads}, {blocks} FROM means),
summed AS (SELECT voter_id, max(x) AS x, {g} AS grad, {curv} AS curv, sum(weight * term) AS term FROM each GROUP BY voter_id)
SELECT *, {cholesky('curv', d)} AS chol FROM summed""", t=_met(votes, voters.select("voter_id", "x"), arrays, spread))


def _prior(d: int, scales):
    """Means and precisions of theta."""
    mean_diff, sigma_diff, sigma_disc = scales
    return [0.0] * d + [float(mean_diff)], [1.0 / sigma_disc ** 2] * d + [1.0 / sigma_diff ** 2]


def candidate_system(votes: DataFrame, voters: DataFrame, params: DataFrame, arrays: DataFrame, d: int, scales,
                     spread: bool = False) -> DataFrame:
    """Free candidates with theta, the gradient of the log posterior in it and the factor chol
    of their own block (Fisher information plus prior precision, packed as info)."""
    n = d + 1
    mean, precision = _prior(d, scales)
    sums = votes.sparkSession.sql(f"""WITH {_PROBABILITIES},
each AS (SELECT race_id, candidate_id AS chosen, x, weight, posexplode(prob) AS (pos, pr) FROM probabilities),
parts AS (SELECT race_id, cast(pos + 1 AS bigint) AS candidate_id, x,
  weight * (CASE WHEN pos + 1 = chosen THEN 1D ELSE 0D END - pr) AS r, weight * pr * (1 - pr) AS q FROM each)
SELECT race_id, candidate_id, {_vector(f'sum(r * x[{k}])' for k in range(n))} AS g,
  {_vector(f'sum(q * x[{i}] * x[{j}])' for i, j in _lower(n))} AS i
FROM parts GROUP BY race_id, candidate_id""", t=_met(votes, voters.select("voter_id", "x"), arrays, spread))
    grad = _vector(f"coalesce(g[{k}], 0D) - (theta[{k}] - {mean[k]!r}D) * {precision[k]!r}D" for k in range(n))
    info = _vector(f"coalesce(i[{_at(i, j)}], 0D) + {precision[i] if i == j else 0.0!r}D" for i, j in _lower(n))
    return votes.sparkSession.sql(f"""
WITH blocks AS (SELECT a.race_id, a.candidate_id, theta, {grad} AS grad, {info} AS info
  FROM {{params}} a LEFT JOIN {{sums}} b ON a.race_id = b.race_id AND a.candidate_id = b.candidate_id WHERE a.candidate_id > 1)
SELECT *, {cholesky('info', n)} AS chol FROM blocks""", params=params.select(*KEY, "theta"), sums=sums)


def voter_pull(votes: DataFrame, voters: DataFrame, arrays: DataFrame, d: int, spread: bool = False) -> DataFrame:
    """voter_id and pull (array): the voters' rows of the product with the direction in
    ``arrays``."""
    return votes.sparkSession.sql(
        f"WITH {_PROBABILITIES}, {_pulls(d)} SELECT voter_id, {_vector(f'sum(pull[{k}])' for k in range(d))} AS pull FROM pulls GROUP BY voter_id",
        t=_met(votes, voters.select("voter_id", "x"), arrays, spread))


def candidate_product(votes: DataFrame, voters: DataFrame, arrays: DataFrame, d: int, spread: bool = False,
                      eliminate: bool = True) -> DataFrame:
    """race_id, candidate_id, y (array): the candidates' rows of the product with the direction
    in ``arrays``, priors not included.  Voters (voter_id, x, chol) move by minus their block's
    solution of the pull, which eliminates them, or by their column ``step``."""
    total = _vector(f"sum(pull[{k}]) OVER (PARTITION BY voter_id)" for k in range(d))
    step = f"SELECT *, transform({solve('chol', 'total', d)}, v -> -v) AS by FROM totals" if eliminate else "SELECT *, step AS by FROM pulls"
    totals = f"totals AS (SELECT *, {total} AS total FROM pulls)," if eliminate else ""
    du = f"zip_with(moved, transform(p, s -> {_dot(f'slice(s.theta, 1, {d})', 'by')}), (a, b) -> a + b)"
    y = _vector([*(f"sum(weight * (x[{k}] * z.g - (CASE WHEN pos + 1 = chosen THEN 1D ELSE 0D END - z.prob) * by[{k}]))" for k in range(d)),
                 "sum(-weight * z.g)"])
    names = ["voter_id", "x", "chol" if eliminate else "step"]
    return votes.sparkSession.sql(f"""WITH {_PROBABILITIES}, {_pulls(d)}, {totals}
stepped AS ({step}),
shifted AS (SELECT *, {du} AS du FROM stepped),
curved AS (SELECT race_id, candidate_id AS chosen, x, by, weight, prob, {J._curved('du')} AS g FROM shifted),
each AS (SELECT race_id, chosen, x, by, weight, posexplode(arrays_zip(g, prob)) AS (pos, z) FROM curved)
SELECT race_id, cast(pos + 1 AS bigint) AS candidate_id, {y} AS y FROM each GROUP BY race_id, pos""",
                                  t=_met(votes, voters.select(*names), arrays, spread))


# ---------------------------------------------------------------- steps

def _product(votes, voters, params, state, d, scales, name, spread, eliminate=True) -> DataFrame:
    """``state`` with q: the product with its column ``name``, priors included."""
    got = candidate_product(votes, voters, contest_thetas(params, state, name), d, spread, eliminate)
    _, precision = _prior(d, scales)
    q = _vector(f"coalesce(y[{k}], 0D) + {name}[{k}] * {precision[k]!r}D" for k in range(d + 1))
    return state.sparkSession.sql(f"""SELECT s.*, {q} AS q FROM {{state}} s
LEFT JOIN {{got}} g ON s.race_id = g.race_id AND s.candidate_id = g.candidate_id""", state=state, got=got)


def newton_step(votes: DataFrame, voters: DataFrame, params: DataFrame, system: DataFrame, d: int, scales,
                tol: float = J.INNER_TOL, most: int = J.MAX_PRODUCTS, spread: bool = False):
    """The candidates' part ``step`` (array) of the joint Newton step, by conjugate gradients
    with their own blocks as preconditioner, and the number of products.  A direction of
    negative curvature ends the iteration."""
    n = d + 1
    zero = _vector("0D" for _ in range(n))
    # right side: the gradient less what the eliminated voters take of it
    still = voters.select("voter_id", "x", F.expr(solve("chol", "grad", d)).alias("step"))
    taken = _product(votes, still, params, system.withColumn("d", F.expr(zero)), d, scales, "d", spread, eliminate=False)
    right = taken.withColumn("r", F.expr(_axpy("grad", "-1D", "q"))).select(*KEY, "chol", "r")
    here = state = cut_lineage(right.withColumns({"x": F.expr(zero), "p": F.expr(solve("chol", "r", n))}))
    rz = scalar_row(state, F.sum(F.expr(_dot("r", "p"))).alias("s"))["s"] or 0.0
    first, k = rz, 0
    while rz > 0 and k < most:
        k += 1
        new = cut_lineage(_product(votes, voters, params, here, d, scales, "p", spread).withColumn("v", F.expr(solve("chol", "q", n))))
        s = scalar_row(new, *(F.sum(F.expr(_dot(a, b))).alias(a + b) for a, b in (("p", "q"), ("r", "v"), ("q", "v"))))
        forget(state)
        state = new
        if s["pq"] <= 0:
            here = state.withColumn("x", F.col("p")) if k == 1 else state
            break
        a = rz / s["pq"]
        left = max(rz - 2 * a * s["rv"] + a * a * s["qv"], 0.0)
        here = state.select(*KEY, "chol", F.expr(_axpy("x", f"{a!r}D", "p")).alias("x"), F.expr(_axpy("r", f"{-a!r}D", "q")).alias("r"), "p")
        here = here.withColumn("p", F.expr(_axpy(solve("chol", "r", n), f"{left / rz!r}D", "p")))
        rz = left
        if rz <= tol * tol * first:
            break
    out = cut_lineage(here.select(*KEY, F.col("x").alias("step")))
    forget(state)
    return out, k


def _most(name: str) -> str:
    return f"array_max(transform({name}, v -> abs(v)))"


def log_posterior(voters: DataFrame, params: DataFrame, d: int, scales) -> float:
    """Log posterior up to a constant at a voter system and the parameters it was made with."""
    mean, precision = _prior(d, scales)
    a = scalar_row(voters, F.sum(F.expr(f"term - ({_dot('x', 'x')} - 1) / 2")).alias("s"))["s"] or 0.0
    lp = " + ".join(f"{q!r}D * power(theta[{k}] - {m!r}D, 2)" for k, (m, q) in enumerate(zip(mean, precision)))
    return a - (scalar_row(params.where("candidate_id > 1"), F.sum(F.expr(lp)).alias("s"))["s"] or 0.0) / 2


def start(votes: DataFrame, ids: DataFrame, d: int, seed: int):
    """Voters (voter_id, x) at deterministic normal positions and params (theta) at the
    contests' vote shares, discriminations 0."""
    alpha = [hash_normal(F.lit(seed), F.lit(k), F.col("voter_id")) for k in range(d)]
    voters = votes.groupBy("voter_id").agg(F.count(F.lit(1)).alias("_n")).select("voter_id", F.array(*alpha, F.lit(-1.0)).alias("x"))
    return voters, FT.init_params(votes, ids).select(*KEY, F.array(*[F.lit(0.0)] * d, F.col("diff")).alias("theta"))


def _clip(name: str) -> str:
    return f"transform({name}, v -> greatest(least(v, 1D), -1D))"


def alternating_step(votes, voters, params, d: int, scales, buckets: int, spread: bool = False):
    """One step of the candidates given the voters, then of the voters given the candidates,
    each by its own block and clipped; new states with what the scales need."""
    n = d + 1
    system = cut_lineage(candidate_system(votes, voters, params, contest_thetas(params), d, scales, spread)
                         .withColumns({"step": F.expr(solve("chol", "grad", n)), "var": F.expr(inverse_diagonal("chol", n))}))
    moved = params.select(*KEY, "theta").join(system.select(*KEY, F.expr(_clip("step")).alias("step"), "var"), KEY, "left")
    new_params = cut_lineage(moved.select(*KEY, F.expr("CASE WHEN step IS NULL THEN theta ELSE zip_with(theta, step, (a, b) -> a + b) END").alias("theta"),
                                          "step", "var"))
    made = voter_system(votes, voters, contest_thetas(new_params), d, spread)
    made = made.withColumns({"step": F.expr(solve("chol", "grad", d)), "var": F.expr(inverse_diagonal("chol", d))})
    new_voters = keep_bucketed(made.select("voter_id", F.expr(f"zip_with(x, concat({_clip('step')}, array(0D)), (a, b) -> a + b)").alias("x"),
                                           "step", "var"), "voter_id", buckets)
    forget(system)
    return new_voters, new_params


def _sums(voters, params, d: int) -> tuple[dict, dict]:
    a = scalar_row(voters, F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"{_dot('x', 'x')} - 1")).alias("ss"),
                   F.sum(F.expr(J._total("var"))).alias("var"), F.max(F.expr(_most("step"))).alias("most"))
    disc = f"slice(theta, 1, {d})"
    p = scalar_row(params.where("candidate_id > 1"), F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"theta[{d}]")).alias("f"),
                   F.sum(F.expr(f"power(theta[{d}], 2)")).alias("ff"), F.sum(F.expr(_dot(disc, disc))).alias("dd"),
                   F.sum(F.expr(J._total(f"slice(var, 1, {d})"))).alias("var_disc"), F.sum(F.expr(f"var[{d}]")).alias("var_diff"),
                   F.max(F.expr(_most("step"))).alias("most"))
    return tuple({k: v or 0.0 for k, v in r.asDict().items()} for r in (a, p))


def _turned(voters: DataFrame, params: DataFrame, d: int, by: np.ndarray, sd: float = 1.0):
    """alpha' = by' alpha / sd, disc' = by' disc sd: every utility keeps its value."""
    def times(name, factor):
        return [f"({' + '.join(f'{name}[{i}] * {float(by[i, k]) * factor!r}D' for i in range(d))})" for k in range(d)]

    return (voters.select("voter_id", F.expr(_vector([*times("x", 1 / sd), "-1D"])).alias("x")),
            params.select(*KEY, F.expr(_vector([*times("theta", sd), f"theta[{d}]"])).alias("theta")))


def newton_rounds(votes, voters, params, d: int, scales, tol: float, most: int, buckets: int, spread: bool = False, verbose: bool = False):
    """Joint Newton steps from written states until none moves a voter or candidate by ``tol``
    or more, at most ``most``; a step that lowers the log posterior is halved.  Returns the
    voter system and params at the end, the history and whether it converged.  The given
    states are deleted."""
    def system_at(voters, params):
        return keep_bucketed(voter_system(votes, voters, contest_thetas(params), d, spread), "voter_id", buckets)

    history, done, old = [], False, voters
    voters = system_at(voters, params)
    forget(old)
    value = log_posterior(voters, params, d, scales)
    while len(history) < most and not done:
        system = cut_lineage(candidate_system(votes, voters, params, contest_thetas(params), d, scales, spread))
        near = bool(history) and history[-1]["max_change"] < J.NEAR
        step, products = newton_step(votes, voters, params, system, d, scales, J.INNER_TOL if near else J.LOOSE_TOL, spread=spread)
        pull = voter_pull(votes, voters, contest_thetas(params, step, "step"), d, spread)
        moves = keep_bucketed(voters.join(pull, "voter_id").withColumn("b", F.expr(_axpy("grad", "-1D", "pull")))
                              .select("voter_id", "x", F.expr(solve("chol", "b", d)).alias("move")), "voter_id", buckets)
        change = max(scalar_row(moves, F.max(F.expr(_most("move"))).alias("m"))["m"] or 0.0,
                     scalar_row(step, F.max(F.expr(_most("step"))).alias("m"))["m"] or 0.0)
        joined = params.select(*KEY, "theta").join(step, KEY, "left")
        share, halved = min(1.0, 2.0 / change) if change else 1.0, 0
        while True:
            theta = f"CASE WHEN step IS NULL THEN theta ELSE {_axpy('theta', f'{share!r}D', 'step')} END"
            new_params = cut_lineage(joined.select(*KEY, F.expr(theta).alias("theta")))
            x = _axpy("x", f"{share!r}D", "concat(move, array(0D))")
            new_voters = system_at(moves.select("voter_id", F.expr(x).alias("x")), new_params)
            new_value = log_posterior(new_voters, new_params, d, scales)
            if new_value >= value - 1e-9 * abs(value) or halved == J.MAX_HALVINGS:
                break
            forget(new_params, new_voters)
            share, halved = share / 2, halved + 1
        forget(system, step, moves, voters, params)
        voters, params, value = new_voters, new_params, new_value
        done = near and change < tol
        history.append({"max_change": change, "products": products, "share": share, "log_posterior": value})
        if verbose:
            print(f"joint {len(history)}: change {change:.6f}, {products} products, share {share:.3f}, log posterior {value:.6f}", flush=True)
    return voters, params, history, done


def _fit_ballots(v, ids, keys, d: int, scales, rounds: int, max_iter: int, tol: float, update_hyper: bool, seed: int, verbose: bool):
    """The rounds of ``fit_map_dims`` on whole ballots: their state, the candidates and theta,
    the scales, the history and whether it converged."""
    cands = B.Candidates(keys, d)
    theta = cands.thetas({(r["race_id"], r["candidate_id"]): [0.0] * d + [r["diff"]] for r in FT.init_params(v, ids).collect()})
    state = B.make(v, cands, [hash_normal(F.lit(seed), F.lit(k), F.col("voter_id")) for k in range(d)])
    forget(v)
    state, theta, scales, shift, sd, history = B.alternating_rounds(state, cands, theta, scales, rounds, update_hyper, verbose)
    theta, at, converged, it = B.rescaled(theta, shift, sd), (0.0, shift, sd), False, len(history)
    if it < max_iter:
        state, theta, _, more, converged = B.newton_rounds(state, cands, theta, at, scales, tol, max_iter - it, verbose)
        history += [{"iteration": it + k, "scales": scales, **h} for k, h in enumerate(more, 1)]
    else:
        placed = B.positions(state, cands, theta, at)
        forget(state)
        state = placed
    return state, cands, theta, scales, history, converged


def fit_map_dims(votes: DataFrame, ids: DataFrame, dims: int = 2, max_iter: int = 200, tol: float = 1e-3, mean_diff: float = 0.0,
                 sigma_diff: float = 2.0, sigma_disc: float = 1.0, update_hyper: bool = True, seed: int = 2139,
                 weight_col: str | None = None, right_voters: DataFrame | None = None, max_bytes: int = BROADCAST_BYTES,
                 verbose: bool = False) -> DimsFit:
    """Posterior mode with ``dims`` dimensions.  ``update_hyper`` estimates mean_diff and the
    scales in the alternating rounds (EM; alpha is held to the second moment of its prior) and
    then keeps them.  The axes are turned by varimax and ordered by their sums of squared
    discriminations, the largest first; an axis points to where ``right_voters`` (voter_id)
    have the larger mean, or to the side with the positive sum of discriminations.
    ``converged`` is False if ``max_iter`` rounds came first."""
    d = dims
    if not 1 <= d <= MAX_DIMS:
        raise ValueError(f"dims must be 1 to {MAX_DIMS}")
    v = FT.prepare_votes(votes, weight_col)
    n = FT.buckets_of(votes)
    scales = (mean_diff, sigma_diff, sigma_disc)
    history, converged, it = [], False, 0
    rounds = min(FT.SCALE_ROUNDS if update_hyper else WARM_ROUNDS, max_iter)
    keys = FT.few_candidates(ids, d + 1, max_bytes)
    spread = False
    if keys:
        state, cands, theta, scales, history, converged = _fit_ballots(v, ids, keys, d, scales, rounds, max_iter, tol, update_hyper, seed, verbose)
        it = len(history)
        voters = state.select("voter_id", F.array(*[f"x{k}" for k in range(d)], F.lit(-1.0)).alias("x"))
        types = ", ".join(f"{n} {ids.schema[n].dataType.simpleString()}" for n in KEY)
        params = cut_lineage(ids.sparkSession.createDataFrame([(*key, theta[cands.place[key]].tolist()) for key in cands.keys], f"{types}, theta array<double>"))
    else:
        voters, params = start(v, ids, d, seed)
        voters, params = keep_bucketed(voters, "voter_id", n), cut_lineage(params)
        spread = params.count() * (FT.CANDIDATE_BYTES + 16 * d) > max_bytes
        for it in range(1, rounds + 1):
            new_voters, new_params = alternating_step(v, voters, params, d, scales, n, spread)
            forget(voters, params)
            voters, params = new_voters, new_params
            a, p = _sums(voters, params, d)
            sd = 1.0
            if update_hyper:
                scales = FT.update_scales(p, *scales, dims=d)
                sd = min(max(((a["ss"] + a["var"]) / max(a["n"] * d, 1)) ** 0.5, 0.5), 2.0)
            history.append({"iteration": it, "max_change": max(a["most"], p["most"]), "scales": scales, "sd": sd})
            if verbose:
                print(f"fit_map_dims {it}: change {history[-1]['max_change']:.5f}, scales {scales}, sd {sd:.5f}", flush=True)
            new_voters, new_params = _turned(voters, params, d, np.eye(d), sd)
            new_voters, new_params = keep_bucketed(new_voters, "voter_id", n), cut_lineage(new_params)
            forget(voters, params)
            voters, params = new_voters, new_params
        if it < max_iter:
            voters, params, more, converged = newton_rounds(v, voters, params, d, scales, tol, max_iter - it, n, spread, verbose)
            history += [{"iteration": it + k, "scales": scales, **h} for k, h in enumerate(more, 1)]
            it += len(more)
    by = VX.rotation_of(params.where("candidate_id > 1").select(F.slice("theta", 1, d).alias("x")), d)
    turned, thetas = _turned(voters, params, d, by)
    if right_voters is not None:
        flag = turned.join(right_voters.select("voter_id").distinct().withColumn("_r", F.lit(1)), "voter_id", "left")
        r = scalar_row(flag, *(F.avg(F.when(F.col("_r") == 1, F.col("x")[k])).alias(f"a{k}") for k in range(d)),
                       *(F.avg(F.when(F.col("_r").isNull(), F.col("x")[k])).alias(f"b{k}") for k in range(d)))
        sides = [(r[f"a{k}"] or 0.0) - (r[f"b{k}"] or 0.0) for k in range(d)]
    else:
        r = scalar_row(thetas, *(F.sum(F.col("theta")[k]).alias(f"a{k}") for k in range(d)))
        sides = [r[f"a{k}"] or 0.0 for k in range(d)]
    by = by * np.where(np.array(sides) < 0, -1.0, 1.0)
    turned, thetas = _turned(voters, params, d, by)
    thetas = cut_lineage(thetas)
    if keys:
        # the ballots on the new axes: one more pass, for the variances there
        theta[..., :d] = theta[..., :d] @ by
        x = [" + ".join(f"x{i} * {float(by[i, k])!r}D" for i in range(d)) for k in range(d)]
        final = B.positions(state.withColumns({f"x{k}": F.expr(e) for k, e in enumerate(x)}), cands, theta, (0.0, 0.0, 1.0))
        alpha = cut_lineage(final.select("voter_id", *(F.array(*[f"{c}{k}" for k in range(d)]).alias(n) for c, n in (("x", "alpha"), ("v", "var")))))
        forget(state, final)
    else:
        final = voter_system(v, turned, contest_thetas(thetas), d, spread)
        alpha = cut_lineage(final.select("voter_id", F.slice("x", 1, d).alias("alpha"), F.expr(inverse_diagonal("chol", d)).alias("var")))
    out = cut_lineage(thetas.select(*KEY, F.slice("theta", 1, d).alias("disc"), F.col("theta")[d].alias("diff")))
    forget(v, voters, params, thetas)
    return DimsFit(alpha, out, history, *scales, it, converged)

"""Registered queries of the multi-dimensional model: steps of its fit at fixed parameters,
the fit itself (checked by ``tests/test_fit_dims.py``), varimax and the alignment of axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import fit as FT
from ..plans import fit_dims as FD
from ..plans import model as M
from ..plans import varimax as VX
from ..session import cut_lineage
from . import inputs as I
from .draws_queries import EXTRA, _model
from .inputs import round_doubles, with_ctes
from .model_queries import _DIMS_EXTRA

Q: dict = {}
SQL: dict = {}

DIMS = M.FIXED_DIMS
SCALES = (M.FIXED_MEAN_DIFF, M.FIXED_SIGMA_DIFF, M.FIXED_SIGMA_DISC)


def q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# one row per vote and candidate of its contest, with the probability of the candidate
_PROB2 = {
    "alpha2": _DIMS_EXTRA["alpha2"], "params2": _DIMS_EXTRA["params2"],
    "ex2": ("""
SELECT v.voter_id, v.race_id, v.candidate_id AS y, p.candidate_id AS c, a.alpha0 AS a0, a.alpha1 AS a1, p.disc0 AS d0, p.disc1 AS d1, p.diff,
  exp(p.disc0 * a.alpha0 + p.disc1 * a.alpha1 - p.diff) AS e
FROM votes v JOIN alpha2 a ON a.voter_id = v.voter_id JOIN params2 p ON p.race_id = v.race_id""", ["votes", "alpha2", "params2"]),
    "pp2": ("SELECT *, e / sum(e) OVER (PARTITION BY voter_id, race_id) AS prob FROM ex2", ["ex2"]),
}


def _fixed(spark, d):
    votes, ids, voters, _ = I.encoded(spark, d)
    x = M.fixed_alpha_dims(voters).select("voter_id", F.concat("alpha", F.array(F.lit(-1.0))).alias("x"))
    params = cut_lineage(M.fixed_candidate_params_dims(ids).select("race_id", "candidate_id", F.concat("disc", F.array("diff")).alias("theta")))
    return votes.withColumn("weight", F.lit(1.0)), x, params


@q("fit_dims_voter_step", with_ctes("""
SELECT voter_id, round(a0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), 4) AS alpha0,
  round(a1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), 4) AS alpha1
FROM (SELECT voter_id, any_value(a0) AS a0, any_value(a1) AS a1, sum(y0 - e0) - any_value(a0) AS g0, sum(y1 - e1) - any_value(a1) AS g1,
        1 + sum(e00 - e0 * e0) AS h00, sum(e01 - e0 * e1) AS h01, 1 + sum(e11 - e1 * e1) AS h11
      FROM (SELECT voter_id, race_id, any_value(a0) AS a0, any_value(a1) AS a1, sum(CASE WHEN c = y THEN d0 END) AS y0,
              sum(CASE WHEN c = y THEN d1 END) AS y1, sum(prob * d0) AS e0, sum(prob * d1) AS e1,
              sum(prob * d0 * d0) AS e00, sum(prob * d0 * d1) AS e01, sum(prob * d1 * d1) AS e11
            FROM pp2 GROUP BY voter_id, race_id) v GROUP BY voter_id) s""", extra=_PROB2))
def fit_dims_voter_step(spark, d):
    """One Newton step of every voter in two dimensions at the fixed parameters."""
    votes, x, params = _fixed(spark, d)
    system = FD.voter_system(votes, x, FD.contest_thetas(params), DIMS)
    new = system.withColumn("step", F.expr(FD.solve("chol", "grad", DIMS)))
    return round_doubles(new.select("voter_id", *((F.col("x")[k] + F.col("step")[k]).alias(f"alpha{k}") for k in range(DIMS))))


def _x(k: int) -> str:
    return ("a0", "a1", "-1.0")[k]


_SUMS = ", ".join([f"sum(({'CASE WHEN c = y THEN 1.0 ELSE 0.0 END'} - prob) * {_x(k)}) AS s{k}" for k in range(3)]
                  + [f"sum(prob * (1 - prob) * {_x(i)} * {_x(j)}) AS i{i}{j}" for i, j in FD._lower(3)])
_W_DISC, _W_DIFF = 1 / M.FIXED_SIGMA_DISC ** 2, 1 / M.FIXED_SIGMA_DIFF ** 2


@q("fit_dims_candidate_step", with_ctes("""
SELECT race_id, c AS candidate_id, round(d0 + x0, 4) AS disc0, round(d1 + x1, 4) AS disc1, round(diff + x2, 4) AS diff
FROM (SELECT *, (y0 - l10 * x1 - l20 * x2) / l00 AS x0
  FROM (SELECT *, (y1 - l21 * x2) / l11 AS x1
    FROM (SELECT *, y2 / l22 AS x2 FROM forward3) a) b) s""", extra={**_PROB2,
    "block3": (f"""
SELECT race_id, c, d0, d1, diff, s0 - d0 * {_W_DISC!r} AS g0, s1 - d1 * {_W_DISC!r} AS g1, s2 - (diff - {M.FIXED_MEAN_DIFF!r}) * {_W_DIFF!r} AS g2,
  i00 + {_W_DISC!r} AS k00, i10 AS k10, i11 + {_W_DISC!r} AS k11, i20 AS k20, i21 AS k21, i22 + {_W_DIFF!r} AS k22
FROM (SELECT race_id, c, any_value(d0) AS d0, any_value(d1) AS d1, any_value(diff) AS diff, {_SUMS} FROM pp2 WHERE c > 1 GROUP BY race_id, c) x""", ["pp2"]),
    "factor1": ("SELECT *, sqrt(k00) AS l00, k10 / sqrt(k00) AS l10, k20 / sqrt(k00) AS l20 FROM block3", ["block3"]),
    "factor2": ("SELECT *, sqrt(k11 - l10 * l10) AS l11, (k21 - l20 * l10) / sqrt(k11 - l10 * l10) AS l21 FROM factor1", ["factor1"]),
    "factor3": ("SELECT *, sqrt(k22 - l20 * l20 - l21 * l21) AS l22 FROM factor2", ["factor2"]),
    "forward1": ("SELECT *, g0 / l00 AS y0 FROM factor3", ["factor3"]),
    "forward2": ("SELECT *, (g1 - l10 * y0) / l11 AS y1 FROM forward1", ["forward1"]),
    "forward3": ("SELECT *, (g2 - l20 * y0 - l21 * y1) / l22 AS y2 FROM forward2", ["forward2"])}))
def fit_dims_candidate_step(spark, d):
    """One Fisher-scoring step of every free candidate in two dimensions at the fixed
    parameters."""
    votes, x, params = _fixed(spark, d)
    system = FD.candidate_system(votes, x, params, FD.contest_thetas(params), DIMS, SCALES)
    new = system.withColumn("step", F.expr(FD.solve("chol", "grad", DIMS + 1)))
    return round_doubles(new.select("race_id", "candidate_id", *(
        (F.col("theta")[k] + F.col("step")[k]).alias(n) for k, n in enumerate(("disc0", "disc1", "diff")))))


@q("fit_map_dims")
def fit_map_dims(spark, d):
    """Posterior-mode voter positions in two dimensions with their variances, on the axes of
    the varimax rotation, Republican-choosers positive, with the convergence of the fit."""
    choices, ids, _ = I.choices_and_ids(spark, d)
    right = choices.where(F.col("party") == "republican").select("voter_id").distinct()
    fit = FD.fit_map_dims(choices, ids, DIMS, right_voters=right)
    both = [F.col(c)[k].alias(f"{c}{k}") for c in ("alpha", "var") for k in range(DIMS)]
    return round_doubles(fit.alpha.select("voter_id", *both, F.lit(fit.converged).alias("converged")))


# ---------------------------------------------------------------- varimax and axes

# Signed permutations planted by draw modulo four, row by row.
TURNS = ((1, 0, 0, 1), (0, 1, 1, 0), (-1, 0, 0, 1), (0, -1, 1, 0))


def _loadings(spark, d):
    """(draw, idx, x): disc and diff of the stand-in draws as a loading in two dimensions."""
    draws, _, _ = _model(spark, d)
    one = [F.sum(F.when(F.col("variable") == v, F.col("value"))) for v in ("disc", "diff")]
    return draws.where(F.col("variable").isin("disc", "diff")).groupBy("draw", "idx").agg(F.array(*one).alias("x"))


def _planted(draw) -> F.Column:
    k = (draw % 4).cast("int")
    return F.get(F.array(*[F.array(*[F.lit(float(x)) for x in t]) for t in TURNS]), k)


def _turn_sql(draw: str) -> str:
    return ", ".join(f"CASE {draw} % 4 {' '.join(f'WHEN {k} THEN {float(t[i])!r}' for k, t in enumerate(TURNS))} END AS p{i}" for i in range(4))


_LOADINGS = {
    **EXTRA,
    "loads": ("""SELECT draw, idx, sum(CASE WHEN variable = 'disc' THEN value END) AS x0, sum(CASE WHEN variable = 'diff' THEN value END) AS x1
FROM mdraws WHERE variable IN ('disc', 'diff') GROUP BY draw, idx""", ["mdraws"]),
    "planted": (f"SELECT *, x0 * p0 + x1 * p2 AS t0, x0 * p1 + x1 * p3 AS t1 FROM (SELECT *, {_turn_sql('draw')} FROM loads) l", ["loads"]),
}


def _flat(df):
    return round_doubles(df.select("draw", *(F.col("by")[k].alias(f"by{k}") for k in range(DIMS * DIMS))))


@q("varimax_rotation", with_ctes("""
SELECT draw, round(CASE WHEN first THEN cos(t) ELSE -sin(t) END, 4) AS by0, round(CASE WHEN first THEN -sin(t) ELSE cos(t) END, 4) AS by1,
  round(CASE WHEN first THEN sin(t) ELSE cos(t) END, 4) AS by2, round(CASE WHEN first THEN cos(t) ELSE sin(t) END, 4) AS by3
FROM (SELECT draw, t, s00 * cos(t) * cos(t) + 2 * s01 * sin(t) * cos(t) + s11 * sin(t) * sin(t)
        >= s00 * sin(t) * sin(t) - 2 * s01 * sin(t) * cos(t) + s11 * cos(t) * cos(t) AS first
  FROM (SELECT draw, s00, s01, s11, atan2(2 * (uv - u * v / n), uu - vv - (u * u - v * v) / n) / 4 AS t
    FROM (SELECT draw, count(*) AS n, sum(x0 * x0) AS s00, sum(x0 * x1) AS s01, sum(x1 * x1) AS s11,
            sum(x0 * x0 - x1 * x1) AS u, sum(2 * x0 * x1) AS v, sum(pow(x0 * x0 - x1 * x1, 2)) AS uu,
            sum(pow(2 * x0 * x1, 2)) AS vv, sum((x0 * x0 - x1 * x1) * 2 * x0 * x1) AS uv FROM loads GROUP BY draw) a) b) c""",
    "loads", extra=_LOADINGS))
def varimax_rotation(spark, d):
    """The varimax rotation of every draw's loadings."""
    return _flat(VX.rotations(_loadings(spark, d), DIMS))


@q("alignment_round_dims", with_ctes("""
SELECT draw, CASE WHEN swap THEN 0.0 WHEN c00 < 0 THEN -1.0 ELSE 1.0 END AS by0, CASE WHEN NOT swap THEN 0.0 WHEN c01 < 0 THEN -1.0 ELSE 1.0 END AS by1,
  CASE WHEN NOT swap THEN 0.0 WHEN c10 < 0 THEN -1.0 ELSE 1.0 END AS by2, CASE WHEN swap THEN 0.0 WHEN c11 < 0 THEN -1.0 ELSE 1.0 END AS by3
FROM (SELECT *, abs(c10) + abs(c01) > abs(c00) + abs(c11) AS swap FROM (
  SELECT draw, sum(x0 * r0) AS c00, sum(x0 * r1) AS c01, sum(x1 * r0) AS c10, sum(x1 * r1) AS c11
  FROM planted JOIN (SELECT idx, avg(t0) AS r0, avg(t1) AS r1 FROM planted GROUP BY idx) r USING (idx) GROUP BY draw) a) b""",
    "planted", extra=_LOADINGS))
def alignment_round_dims(spark, d):
    """One round of the alignment from fixed signed permutations."""
    x = cut_lineage(_loadings(spark, d))
    return _flat(VX.alignment_round(x, x.select("draw").distinct().withColumn("by", _planted(F.col("draw"))), DIMS))


@q("align_dims_planted", with_ctes(f"""
SELECT draw, p0 * f0 + p2 * f2 AS by0, p0 * f1 + p2 * f3 AS by1, p1 * f0 + p3 * f2 AS by2, p1 * f1 + p3 * f3 AS by3, true AS converged
FROM (SELECT DISTINCT draw, p0, p1, p2, p3 FROM planted) a,
  (SELECT {_turn_sql('first').replace('AS p', 'AS f')} FROM (SELECT min(draw) AS first FROM planted) m) b""", "planted", extra=_LOADINGS))
def align_dims_planted(spark, d):
    """Signed permutations planted in the draws are undone, up to that of the first draw."""
    x = _loadings(spark, d).withColumn("turn", _planted(F.col("draw")))
    turns, _, converged = VX.align(x.select("draw", "idx", VX.times("x", "turn", DIMS).alias("x")), DIMS, rotate=False)
    return _flat(turns).withColumn("converged", F.lit(converged))

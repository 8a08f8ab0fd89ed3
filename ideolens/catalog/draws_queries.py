"""Registered posterior-table queries (B1-B25, A5) over the ``draws`` stand-in,
joined where needed with the encoded votes and external scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import encode as E
from ..operators import sampling as S
from ..plans import diagnostics as D
from ..plans import draws as DR
from ..plans import scores as SC
from ..session import cut_lineage
from ..sources import fixtures as fx
from . import inputs as I
from .inputs import round_doubles, with_ctes

Q: dict = {}
SQL: dict = {}

MAIN_CHOICES = ("cand_0", "cand_1")
# The stand-in draws are centred near 0 (parameter means within +-0.02), so the
# trace filter uses a smaller |mean| threshold than the default 0.1.
TRACE_THRESHOLD = 0.005
SCORE_OFFICE = "standard"


def q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _draws(spark, d):
    return fx.draws(spark, d)


def _flat(spark, d):
    return E.flat_parameter_index(E.candidate_ids(I.all_valid(spark, d), "democrat"))


def _model(spark, d, flipped=False):
    """(draws of all voters and candidates, choices, flat candidate index), encoded once."""
    choices, ids, voters = I.choices_and_ids(spark, d)
    flat = cut_lineage(E.flat_parameter_index(ids))
    return cut_lineage(fx.model_draws(voters, flat, flipped)), choices, flat


EXTRA = {
    "flat": ("""SELECT race, candidate, candidate_id, race_id,
        CAST(row_number() OVER (ORDER BY race_id, candidate_id) AS BIGINT) AS param_idx FROM cand_ids""",
             ["cand_ids"]),
    "vs": ("""SELECT idx AS voter_id, -1.0 * avg(value) AS mean, 1.0 / var_samp(value) AS precision
        FROM mdraws WHERE variable = 'alpha' GROUP BY idx""", ["mdraws"]),
    "mdraws": (fx.MODEL_DRAWS_SQL, ["voter_ids", "flat"]),
    "wide": (fx.WIDE_LONG_SQL, []),
    "rh": ("""
SELECT variable, idx, CASE WHEN W > 0 THEN sqrt(((n - 1) / n * W + var_m) / W) END AS rhat FROM (
  SELECT variable, idx, avg(v) AS W, var_samp(m) AS var_m, CAST(min(nn) AS DOUBLE) AS n FROM (
    SELECT variable, idx, chain, half, avg(value) AS m, var_samp(value) AS v, count(*) AS nn FROM (
      SELECT *, CASE WHEN iteration < n // 2 THEN 0 WHEN iteration >= n - n // 2 THEN 1 END AS half FROM (
        SELECT variable, idx, chain, iteration, value,
               count(*) OVER (PARTITION BY variable, idx, chain) AS n FROM draws) a) b
    WHERE half IS NOT NULL GROUP BY variable, idx, chain, half) c
  GROUP BY variable, idx) d""", ["draws"]),
    "vchoice": (f"""SELECT voter_id,
        min(CASE WHEN office = '{SCORE_OFFICE}' THEN trim(regexp_replace(candidate, '\\s+', ' ', 'g')) END) AS choice
        FROM choices GROUP BY voter_id""", ["choices"]),
    "ext_scores": ("""
SELECT race, candidate, cfscore, dime_score FROM (
  SELECT *, count(*) OVER (PARTITION BY race) AS nr FROM (
    SELECT concat(office, '_', district) AS race, candidate, min(cfscore) AS cfscore,
           min(dime_score) AS dime_score
    FROM (SELECT *, (cfscore - avg(cfscore) OVER ()) / stddev_samp(cfscore) OVER () AS dime_score
          FROM ext WHERE cycle = 2020 AND cfscore IS NOT NULL) z
    GROUP BY office, district, candidate) y
  WHERE race IN (SELECT race FROM choices)) x WHERE nr >= 2""", ["ext", "choices"]),
    "cand_scores": ("""
SELECT race, candidate, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS bayes_ideal, n_voters FROM (
  SELECT race, candidate, sum(mean * precision) / sum(precision) AS b, count(*) AS n_voters FROM (
    SELECT vs.*, c.race, c.candidate FROM vs JOIN choices c ON c.voter_id = vs.voter_id
    WHERE c.candidate IN (SELECT c2.candidate FROM vs v2 JOIN choices c2 ON c2.voter_id = v2.voter_id
                          GROUP BY c2.candidate HAVING count(*) >= 5)) k
  GROUP BY race, candidate) cs""", ["vs", "choices"]),
    "sbc": (f"""
SELECT * FROM (
  SELECT vs.voter_id, vs.mean, vs.precision, v.choice, 'main' AS "group"
  FROM vs JOIN vchoice v ON v.voter_id = vs.voter_id
  WHERE v.choice IN ({", ".join(f"'{c}'" for c in MAIN_CHOICES)})
  UNION ALL
  SELECT vs.voter_id, vs.mean, vs.precision, v.choice, 'other' AS "group"
  FROM vs JOIN vchoice v ON v.voter_id = vs.voter_id
  WHERE v.choice IS NOT NULL AND v.choice NOT IN ({", ".join(f"'{c}'" for c in MAIN_CHOICES)})
    AND v.choice IN (SELECT v2.choice FROM vs s2 JOIN vchoice v2 ON v2.voter_id = s2.voter_id
                     WHERE v2.choice IS NOT NULL
                       AND v2.choice NOT IN ({", ".join(f"'{c}'" for c in MAIN_CHOICES)})
                     GROUP BY v2.choice HAVING count(*) > 5)) u""", ["vs", "vchoice"]),
    "st": ("""SELECT choice, min(mean) AS lo, max(mean) AS hi, stddev_samp(mean) AS sd, count(*) AS n, sum(precision) AS wsum
        FROM sbc GROUP BY choice""", ["sbc"]),
    "scored": ("""SELECT e.race, e.candidate, e.cfscore AS dime_ideal, c.bayes_ideal
        FROM ext_scores e JOIN cand_scores c ON c.race = e.race AND c.candidate = e.candidate""",
               ["ext_scores", "cand_scores"]),
    "modal": ("""SELECT draw, CAST(s * (CASE WHEN sum(s) OVER () < 0 THEN -1 ELSE 1 END) AS BIGINT) AS sign FROM (
        SELECT draw, CASE WHEN sum(value) < 0 THEN -1 ELSE 1 END AS s FROM draws WHERE variable = 'gamma'
        GROUP BY draw) p""", ["draws"]),
}


def W(final, *names):
    return with_ctes(final, *names, extra=EXTRA)


@q("spread_draws", W("""
SELECT chain, iteration, draw, idx AS id, value AS gamma FROM draws WHERE variable = 'gamma'""", "draws"))
def spread_draws(spark, d):
    return DR.spread_draws(_draws(spark, d), "gamma")


@q("summarise_draws", W("""
SELECT s.variable, s.idx, round(mean, 4) AS mean, round(median, 4) AS median, round(sd, 4) AS sd,
       round(mad, 4) AS mad, round(q5, 4) AS q5, round(q95, 4) AS q95
FROM (SELECT variable, idx, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS sd,
        quantile_cont(value, 0.05) AS q5, quantile_cont(value, 0.95) AS q95 FROM draws GROUP BY variable, idx) s
JOIN (SELECT d.variable, d.idx, quantile_cont(abs(d.value - m.med), 0.5) * 1.4826 AS mad
      FROM draws d JOIN (SELECT variable, idx, quantile_cont(value, 0.5) AS med FROM draws GROUP BY variable, idx) m
        ON m.variable = d.variable AND m.idx = d.idx GROUP BY d.variable, d.idx) t
  ON s.variable = t.variable AND s.idx = t.idx""", "draws"))
def summarise_draws(spark, d):
    return round_doubles(D.summarise_draws(_draws(spark, d)))


@q("split_rhat", W("SELECT variable, idx, round(rhat, 4) AS rhat FROM rh", "rh"))
def split_rhat(spark, d):
    return round_doubles(D.split_rhat(_draws(spark, d)))


@q("rhat_table", W("""
SELECT variable, round(avg(rhat), 4) AS mean, round(quantile_cont(rhat, 0.5), 4) AS median,
  round(max(rhat), 4) AS max, round(stddev_samp(rhat), 4) AS sd,
  round(sum(CASE WHEN rhat < 1.1 THEN 1 ELSE 0 END) / count(*), 4) AS share_below_1_1
FROM rh WHERE rhat IS NOT NULL GROUP BY variable""", "rh"))
def rhat_table(spark, d):
    return round_doubles(D.rhat_table(D.split_rhat(_draws(spark, d))))


@q("box_summary", W("""
SELECT variable, round(min(rhat), 4) AS min, round(quantile_cont(rhat, 0.25), 4) AS q1,
  round(quantile_cont(rhat, 0.5), 4) AS median, round(quantile_cont(rhat, 0.75), 4) AS q3,
  round(max(rhat), 4) AS max
FROM rh WHERE rhat IS NOT NULL GROUP BY variable""", "rh"))
def box_summary(spark, d):
    return round_doubles(D.box_summary(D.split_rhat(_draws(spark, d))))


@q("standardise_by_draw", W("""
SELECT g.chain, g.iteration, g.draw, g.variable, g.idx, round(g.value / s.sd, 4) AS value
FROM draws g JOIN (SELECT draw, stddev_samp(value) AS sd FROM draws WHERE variable = 'alpha' GROUP BY draw) s
  ON s.draw = g.draw WHERE g.variable = 'gamma'""", "draws"))
def standardise_by_draw(spark, d):
    return round_doubles(DR.standardise_by_draw(_draws(spark, d), "gamma"))


@q("voter_scores", W("SELECT voter_id, round(mean, 4) AS mean, round(precision, 4) AS precision FROM vs", "vs"))
def voter_scores(spark, d):
    return round_doubles(SC.voter_scores(_model(spark, d)[0], orient=-1))


def _cand_scores(model):
    draws, choices, _ = model
    return SC.candidate_scores(SC.voter_scores(draws, orient=-1), choices, 5)


@q("candidate_scores", W("""
SELECT race, candidate, round(bayes_ideal, 4) AS bayes_ideal, n_voters FROM cand_scores""", "cand_scores"))
def candidate_scores(spark, d):
    return round_doubles(_cand_scores(_model(spark, d)))


def _sbc(spark, d):
    from ..operators import votes as V
    draws, ch, _ = _model(spark, d)
    vc = V.voter_choice(ch, SCORE_OFFICE, key=["voter_id"])
    return SC.scores_by_choice(SC.voter_scores(draws, orient=-1), vc, MAIN_CHOICES, 5)


@q("scores_by_choice", W("""
SELECT voter_id, round(mean, 4) AS mean, round(precision, 4) AS precision, choice, "group" FROM sbc""", "sbc"))
def scores_by_choice(spark, d):
    return round_doubles(_sbc(spark, d))


@q("weighted_density", W("""
SELECT choice, g, round(any_value(x), 4) AS x, round(sum(k), 4) AS density FROM (
  SELECT r.choice, gs.g, (lo - 3 * sp) + gs.g * ((hi - lo + 6 * sp) / 63) AS x,
    r.w * exp(-0.5 * (((lo - 3 * sp) + gs.g * ((hi - lo + 6 * sp) / 63) - r.v) / bw)
                   * (((lo - 3 * sp) + gs.g * ((hi - lo + 6 * sp) / 63) - r.v) / bw))
      / (bw * wsum * 2.5066282746310002) AS k
  FROM (SELECT b.choice, bin, sum(b.precision) AS w, sum(b.precision * b.mean) / sum(b.precision) AS v
        FROM (SELECT q.*, CASE WHEN hi > lo THEN least(floor((mean - lo) / (hi - lo) * 512), 511) ELSE 0 END AS bin
              FROM sbc q JOIN st ON st.choice = q.choice) b GROUP BY b.choice, bin) r
  JOIN (SELECT *, CASE WHEN 1.06 * sd * pow(CAST(n AS DOUBLE), -0.2) > 0 THEN 1.06 * sd * pow(CAST(n AS DOUBLE), -0.2) END AS bw,
               coalesce(CASE WHEN 1.06 * sd * pow(CAST(n AS DOUBLE), -0.2) > 0 THEN 1.06 * sd * pow(CAST(n AS DOUBLE), -0.2) END, 0.0) AS sp
        FROM st) s ON s.choice = r.choice
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS g FROM range(64)) gs) t GROUP BY choice, g""", "sbc", "st"))
def weighted_density(spark, d):
    return round_doubles(SC.weighted_density(_sbc(spark, d), "choice", grid=64))


@q("interval_summary", W("""
SELECT variable, idx, round(quantile_cont(value, 0.5), 4) AS median,
  round(quantile_cont(value, 0.17), 4) AS lower66, round(quantile_cont(value, 0.83), 4) AS upper66,
  round(quantile_cont(value, 0.025), 4) AS lower95, round(quantile_cont(value, 0.975), 4) AS upper95,
  count(*) AS n FROM draws GROUP BY variable, idx""", "draws"))
def interval_summary(spark, d):
    return round_doubles(D.interval_summary(_draws(spark, d)))


@q("trace_table", W(f"""
SELECT d.variable, d.idx, d.chain, d.iteration, d.value FROM draws d JOIN (
  SELECT variable, idx FROM (SELECT variable, idx, avg(value) AS mean FROM draws GROUP BY variable, idx) s
  WHERE abs(mean) > {TRACE_THRESHOLD} AND NOT regexp_matches(variable, 'raw')
  ORDER BY md5(concat_ws('|', '{fx.SAMPLE_SEED}', variable, CAST(idx AS VARCHAR))), variable, idx LIMIT 24) p
ON p.variable = d.variable AND p.idx = d.idx""", "draws"))
def trace_table(spark, d):
    return D.trace_table(_draws(spark, d), 24, fx.SAMPLE_SEED, threshold=TRACE_THRESHOLD)


@q("sample_parameter_names", W(f"""
SELECT d.* FROM draws d JOIN (
  SELECT idx FROM (SELECT DISTINCT idx FROM draws WHERE variable = 'alpha') a
  ORDER BY md5(concat_ws('|', '{fx.SAMPLE_SEED}', CAST(idx AS VARCHAR))), idx LIMIT 20) p
ON p.idx = d.idx WHERE d.variable = 'alpha'""", "draws"))
def sample_parameter_names(spark, d):
    return S.sample_parameter_names(_draws(spark, d), "alpha", 20, fx.SAMPLE_SEED)


_TITLE = """regexp_replace(array_to_string(list_transform(string_split(race, ' '),
         lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' '), '^Us', 'US')"""


@q("race_parameter_table", W(f"""
SELECT {_TITLE} AS race,
  round(avg(CASE WHEN variable = 'diff' THEN value END), 4) AS mean_diff,
  round(quantile_cont(CASE WHEN variable = 'diff' THEN value END, 0.5), 4) AS median_diff,
  round(stddev_samp(CASE WHEN variable = 'diff' THEN value END), 4) AS sd_diff,
  round(avg(CASE WHEN variable = 'disc' THEN value END), 4) AS mean_disc,
  round(quantile_cont(CASE WHEN variable = 'disc' THEN value END, 0.5), 4) AS median_disc,
  round(stddev_samp(CASE WHEN variable = 'disc' THEN value END), 4) AS sd_disc
FROM mdraws d JOIN flat f ON f.param_idx = d.idx WHERE d.variable IN ('diff', 'disc') GROUP BY race""",
    "mdraws", "flat"))
def race_parameter_table(spark, d):
    draws, _, flat = _model(spark, d)
    return round_doubles(SC.race_parameter_table(draws, flat))


@q("scaled_discrimination", W("""
SELECT f.race, round(avg(exp(d.value) / s.sd), 4) AS mean, round(quantile_cont(exp(d.value) / s.sd, 0.5), 4) AS median, count(*) AS n_draws
FROM mdraws d JOIN flat f ON f.param_idx = d.idx
JOIN (SELECT draw, stddev_samp(value) AS sd FROM mdraws WHERE variable = 'alpha' GROUP BY draw) s ON s.draw = d.draw
WHERE d.variable = 'diff' GROUP BY f.race""", "mdraws", "flat"))
def scaled_discrimination(spark, d):
    draws, _, flat = _model(spark, d)
    return round_doubles(SC.scaled_discrimination(draws, flat, "diff"))


@q("discrimination_by_type", W("""
SELECT partisan, race_type, round(quantile_cont(a, 0.5), 4) AS median,
  round(quantile_cont(a, 0.17), 4) AS lower66, round(quantile_cont(a, 0.83), 4) AS upper66,
  round(quantile_cont(a, 0.025), 4) AS lower95, round(quantile_cont(a, 0.975), 4) AS upper95, count(*) AS n
FROM (SELECT abs(d.value) AS a, regexp_replace(f.race, '_.*$', '') AS race_type,
        CASE WHEN p.party IS NULL THEN 'UNKNOWN' WHEN regexp_matches(p.party, 'nonpartisan', 'i') THEN 'NONPARTISAN'
             ELSE 'PARTISAN' END AS partisan
      FROM mdraws d JOIN flat f ON f.param_idx = d.idx
      LEFT JOIN (SELECT race, candidate,
                   CASE WHEN bool_or(party = 'democrat') THEN 'democrat' ELSE min(party) END AS party
                 FROM all_valid GROUP BY race, candidate) p ON p.race = f.race AND p.candidate = f.candidate
      WHERE d.variable = 'disc' AND (f.race, f.candidate) IN (
        SELECT (f2.race, f2.candidate) FROM mdraws d2 JOIN flat f2 ON f2.param_idx = d2.idx
        WHERE d2.variable = 'disc' GROUP BY f2.race, f2.candidate HAVING avg(d2.value) <> 0)) x
GROUP BY partisan, race_type""", "mdraws", "flat", "all_valid"))
def discrimination_by_type(spark, d):
    draws, choices, flat = _model(spark, d)
    return round_doubles(SC.discrimination_by_type(draws, flat, SC.candidate_party(choices)))


def _district_attrs(spark, d):
    o = fx.table(spark, d, "orders").select(F.substring("o_orderpriority", 3, 100).alias("District_1"))
    return o.groupBy("District_1").agg(F.count(F.lit(1)).alias("n_orders"))


@q("district_scores", W(f"""
SELECT a.District_1, a.n_orders, round(s.ideal_mean, 4) AS ideal_mean, s.n_draws FROM (
  SELECT substr(o_orderpriority, 3) AS District_1, count(*) AS n_orders FROM orders GROUP BY 1) a
JOIN (SELECT c.district, avg(d.value) AS ideal_mean, count(*) AS n_draws
      FROM mdraws d JOIN choices c ON c.voter_id = d.idx
      WHERE d.variable = 'alpha' AND c.office = '{SCORE_OFFICE}' AND c.district IS NOT NULL
      GROUP BY c.district) s ON s.district = a.District_1""", "mdraws", "choices"))
def district_scores(spark, d):
    draws, choices, _ = _model(spark, d)
    return round_doubles(SC.district_scores(draws, choices, SCORE_OFFICE, _district_attrs(spark, d)))


_FITS_SQL = """
SELECT a.variable, a.idx, a.value_x, b.value_y FROM
  (SELECT variable, idx, avg(value) AS value_x FROM draws GROUP BY variable, idx) a
LEFT JOIN (SELECT variable, idx, avg(value) AS value_y FROM draws WHERE draw = (SELECT min(draw) FROM draws)
           GROUP BY variable, idx) b ON a.variable = b.variable AND a.idx = b.idx
WHERE NOT regexp_matches(a.variable, '^lp|raw|\\.')"""


@q("compare_fits", W(f"""
SELECT variable, idx, variable AS type,
  round((value_x - min(value_x) OVER w) / (max(value_x) OVER w - min(value_x) OVER w), 4) AS value_x,
  round((value_y - min(value_y) OVER w) / (max(value_y) OVER w - min(value_y) OVER w), 4) AS value_y
FROM ({_FITS_SQL}) f WINDOW w AS (PARTITION BY variable)""", "draws"))
def compare_fits(spark, d):
    dr = _draws(spark, d)
    first = dr.join(dr.agg(F.min("draw").alias("draw")), "draw", "left_semi")
    return round_doubles(SC.compare_fits(dr, first))


@q("compare_fits_correlation", W(f"""
SELECT round(corr(value_x, value_y), 4) AS correlation, count(*) AS n FROM ({_FITS_SQL}) f
WHERE value_y IS NOT NULL""", "draws"))
def compare_fits_correlation(spark, d):
    dr = _draws(spark, d)
    first = dr.join(dr.agg(F.min("draw").alias("draw")), "draw", "left_semi")
    return round_doubles(SC.fits_correlation(dr, first))


def _ext_scores(spark, d, choices=None):
    return SC.external_scores(fx.external_raw(spark, d), I.all_valid(spark, d) if choices is None else choices, 2020)


@q("external_scores", W("""
SELECT race, candidate, round(cfscore, 6) AS cfscore, round(dime_score, 4) AS dime_score FROM ext_scores""",
    "ext_scores"))
def external_scores(spark, d):
    # scores carry five decimals: six-digit rounding keeps them off the half-way point
    return round_doubles(_ext_scores(spark, d), cfscore=6)


@q("external_scores_prepared", W(f"""
SELECT race, candidate, round(cfscore, 6) AS cfscore, round(dime_score, 4) AS dime_score FROM (
  SELECT *, count(*) OVER (PARTITION BY race) AS nr FROM (
    SELECT concat(office, '_', CASE WHEN length(district) >= 6 THEN district ELSE lpad(district, 6, '0') END) AS race, candidate,
           min(cfscore) AS cfscore, min(dime_score) AS dime_score
    FROM (SELECT *, (cfscore - avg(cfscore) OVER ()) / stddev_samp(cfscore) OVER () AS dime_score
          FROM ({{fx_rows}}) r WHERE cycle = 2020 AND office IS NOT NULL AND pwinner <> 'L' AND state IN ('CO', '00')) z
    GROUP BY office, district, candidate) y
  WHERE race IN (SELECT concat(office, '_', CASE WHEN length(district) >= 6 THEN district ELSE lpad(district, 6, '0') END)
                 FROM all_valid WHERE district IS NOT NULL)) x WHERE nr >= 2""".replace("{fx_rows}", fx.SEAT_ROWS_SQL), "all_valid"))
def external_scores_prepared(spark, d):
    """External scores from published rows: seats recoded, losers and other states left
    out, districts padded as the contest dictionary pads them."""
    rows = SC.external_seats(fx.external_seat_rows(spark, d), 2020, ("CO", "00"), fx.STANDIN_SEATS)
    races = I.all_valid(spark, d).select(tx.str_c(F.col("office"), tx.pad_left("district", 6), sep="_").alias("race"))
    return round_doubles(SC.external_scores(rows, races, None, pad_width=6), cfscore=6)


@q("voters_vs_external", W("""
SELECT race, candidate, round(dime_score, 4) AS dime_score, draw, count(*) AS n_voters, round(avg(x), 4) AS mean_alpha,
  round(stddev_samp(x), 4) AS sd_alpha
FROM (SELECT e.race, e.candidate, e.dime_score, d.draw,
        d.value / (SELECT stddev_samp(value) FROM mdraws WHERE variable = 'alpha') AS x
      FROM ext_scores e JOIN choices c ON c.race = e.race AND c.candidate = e.candidate
      JOIN mdraws d ON d.idx = c.voter_id AND d.variable = 'alpha') j
GROUP BY race, candidate, dime_score, draw""", "ext_scores", "choices", "mdraws"))
def voters_vs_external(spark, d):
    draws, choices, _ = _model(spark, d)
    return round_doubles(SC.voters_vs_external(draws, _ext_scores(spark, d, choices), choices))


def _scored(spark, d):
    model = _model(spark, d)
    return SC.scored_candidates(_ext_scores(spark, d, model[1]), _cand_scores(model))


@q("cutpoints", W("""
SELECT DISTINCT race, round(cut_bayes, 4) AS cut_bayes, round(cut_dime, 7) AS cut_dime FROM (
  SELECT a.race, (a.bayes_ideal + b.bayes_ideal) / 2 AS cut_bayes, (a.dime_ideal + b.dime_ideal) / 2 AS cut_dime
  FROM scored a JOIN scored b ON a.race = b.race AND a.candidate < b.candidate) p""", "scored"))
def cutpoints(spark, d):
    # the external scores carry five decimals, so their midpoints have six
    return round_doubles(SC.cutpoints(_scored(spark, d)), cut_dime=7).distinct()


@q("cutpoint_correlation", W("""
SELECT round(corr(cut_bayes, cut_dime), 4) AS correlation, count(*) AS n_pairs FROM (
  SELECT (a.bayes_ideal + b.bayes_ideal) / 2 AS cut_bayes, (a.dime_ideal + b.dime_ideal) / 2 AS cut_dime
  FROM scored a JOIN scored b ON a.race = b.race AND a.candidate < b.candidate) p""", "scored"))
def cutpoint_correlation(spark, d):
    return round_doubles(SC.cutpoint_correlation(_scored(spark, d), same_race=True))


@q("normality_check", W("""
SELECT round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, count(*) AS n
FROM draws WHERE variable = 'alpha'""", "draws"))
def normality_check(spark, d):
    return round_doubles(DR.normality_check(_draws(spark, d)))


@q("modal_sign", W("SELECT * FROM modal", "modal"))
def modal_sign(spark, d):
    return DR.modal_sign(_draws(spark, d), "gamma")


# In the flipped stand-in the draws divisible by three are turned around, fewer than half, so
# the alignment must find exactly these.
_FLIP = "CASE WHEN draw % 3 = 0 THEN -1 ELSE 1 END"


@q("align_signs_flipped", W(f"""
SELECT DISTINCT draw, CAST({_FLIP} AS BIGINT) AS sign, true AS converged FROM mdraws""", "mdraws"))
def align_signs_flipped(spark, d):
    draws, _, _ = _model(spark, d, flipped=True)
    signs, _, converged = DR.align_signs(draws, "disc")
    return signs.withColumn("converged", F.lit(converged))


@q("alignment_round", W("""
SELECT x.draw, CAST(CASE WHEN sum(x.value * r.ref) < 0 THEN -1 ELSE 1 END AS BIGINT) AS sign
FROM draws x JOIN (SELECT idx, avg(value * CASE WHEN draw % 2 = 0 THEN 1 ELSE -1 END) AS ref FROM draws
                   WHERE variable = 'gamma' GROUP BY idx) r ON r.idx = x.idx
WHERE x.variable = 'gamma' GROUP BY x.draw""", "draws"))
def alignment_round(spark, d):
    """One round from fixed signs (even draws +1, odd draws -1)."""
    x = _draws(spark, d).where(F.col("variable") == "gamma").select("draw", "idx", "value")
    signs = x.select("draw", F.when(F.col("draw") % 2 == 0, 1).otherwise(-1).alias("sign")).distinct()
    return DR.alignment_round(x, signs)


@q("before_after_alignment", W(f"""
SELECT t.type, d.draw, d.idx,
  CASE WHEN f.candidate_id = 1 THEN 0.0
       ELSE round(d.value * (CASE WHEN t.type = 'Before alignment' THEN {_FLIP} ELSE 1 END), 4) END AS value
FROM mdraws d JOIN flat f ON f.param_idx = d.idx
CROSS JOIN (SELECT 'Before alignment' AS type UNION ALL SELECT 'After alignment') t
WHERE d.variable = 'disc'""", "mdraws", "flat"))
def before_after_alignment(spark, d):
    draws, _, flat = _model(spark, d, flipped=True)
    refs = flat.where(F.col("candidate_id") == 1).select(F.col("param_idx").alias("idx"))
    signs, _, _ = DR.align_signs(draws, "disc")
    return round_doubles(DR.before_after(draws, signs, refs))


@q("candidate_parameters", W("""
SELECT f.race, f.candidate, f.candidate_id, d.variable AS parameter,
  round(avg(CASE WHEN f.candidate_id = 1 THEN 0.0 ELSE d.value END), 4) AS value, count(*) AS n_draws
FROM mdraws d JOIN flat f ON f.param_idx = d.idx WHERE d.variable IN ('disc', 'diff')
GROUP BY f.race, f.candidate, f.candidate_id, d.variable""", "mdraws", "flat"))
def candidate_parameters(spark, d):
    draws, _, flat = _model(spark, d)
    return round_doubles(DR.candidate_parameters(draws, flat))


_NAME = """concat(s.variable, CASE WHEN s.idx2 IS NOT NULL THEN concat('[', s.idx, ',', s.idx2, ']')
  WHEN s.idx IS NOT NULL THEN concat('[', s.idx, ']') ELSE '' END)"""


def _named(df):
    """Parameters by their full name instead of variable and indices, which may be NULL."""
    return df.withColumn("parameter", tx.parameter_name("variable", "idx", "idx2")).drop("variable", "idx", "idx2")


@q("draws_from_wide", W(f"SELECT chain, iteration, draw, {_NAME} AS parameter, value FROM wide s", "wide"))
def draws_from_wide(spark, d):
    return _named(DR.draws_from_wide(fx.wide_draws(spark, d)))


def _phi(p: str) -> str:
    """Inverse normal CDF of a SQL expression, by the same rational formula."""
    def poly(x, c):
        out = repr(c[0])
        for k in c[1:]:
            out = f"({out} * {x} + {k!r})"
        return out
    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"

    def tail(x):
        t = f"sqrt(-2 * ln({x}))"
        return f"({poly(t, D._C)} / ({poly(t, D._D)} * {t} + 1))"
    return (f"CASE WHEN {p} < {D._LOW} THEN {tail(p)} WHEN {p} > 1 - {D._LOW} THEN -{tail(f'(1 - {p})')} "
            f"ELSE {poly(r, D._A)} * {q} / ({poly(r, D._B)} * {r} + 1) END")


def _rank_rhat_sql(source: str) -> dict:
    """CTEs of the rank-normalised split R-hat of a draws CTE with idx2; ``rank_rh`` last."""
    key = "variable, idx, idx2"
    same = " AND ".join(f"{{a}}.{k} IS NOT DISTINCT FROM {{b}}.{k}" for k in ("variable", "idx", "idx2"))
    rhat = lambda v: f"""
      SELECT {key}, sqrt(((min(n) - 1.0) / min(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat FROM (
        SELECT {key}, chain, half, avg({v}) AS m, var_samp({v}) AS v, count(*) AS n FROM rscore GROUP BY {key}, chain, half) h
      GROUP BY {key}"""
    return {
        "rhalf": (f"""
SELECT *, abs(value - med) AS folded FROM (
  SELECT *, CASE WHEN rn <= n // 2 THEN 0 WHEN rn > n - n // 2 THEN 1 END AS half FROM (
    SELECT *, row_number() OVER (PARTITION BY {key}, chain ORDER BY iteration) AS rn, count(*) OVER (PARTITION BY {key}, chain) AS n,
           quantile_cont(value, 0.5) OVER (PARTITION BY {key}) AS med FROM {source}) a) b WHERE half IS NOT NULL""", [source]),
        "rscore": (f"""
SELECT *, {_phi('p1')} AS z, {_phi('p2')} AS zf FROM (
  SELECT *, (r1 + (t1 - 1) / 2.0 - 0.375) / (s + 0.25) AS p1, (r2 + (t2 - 1) / 2.0 - 0.375) / (s + 0.25) AS p2 FROM (
    SELECT *, rank() OVER (PARTITION BY {key} ORDER BY value) AS r1, count(*) OVER (PARTITION BY {key}, value) AS t1,
           rank() OVER (PARTITION BY {key} ORDER BY folded) AS r2, count(*) OVER (PARTITION BY {key}, folded) AS t2,
           count(*) OVER (PARTITION BY {key}) AS s FROM rhalf) a) b""", ["rhalf"]),
        "rank_rh": (f"""
SELECT a.variable, a.idx, a.idx2, greatest(a.rhat, b.rhat) AS rhat FROM ({rhat('z')}) a JOIN ({rhat('zf')}) b
  ON {same.format(a='a', b='b')}""", ["rscore"]),
    }


@q("rank_rhat", with_ctes("SELECT variable, idx, round(rhat, 4) AS rhat FROM rank_rh", extra={
    "d3": ("SELECT *, CAST(NULL AS BIGINT) AS idx2 FROM draws", ["draws"]), **_rank_rhat_sql("d3")}))
def rank_rhat(spark, d):
    """Rank-normalised split R-hat per parameter."""
    return round_doubles(D.rank_rhat(_draws(spark, d)))


@q("summarise_wide_draws", with_ctes(f"""
SELECT {_NAME} AS parameter, round(mean, 4) AS mean, round(median, 4) AS median, round(sd, 4) AS sd,
       round(mad, 4) AS mad, round(q5, 4) AS q5, round(q95, 4) AS q95, round(r.rhat, 4) AS rhat
FROM (SELECT variable, idx, idx2, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS sd,
        quantile_cont(value, 0.05) AS q5, quantile_cont(value, 0.95) AS q95 FROM wide GROUP BY variable, idx, idx2) s
JOIN (SELECT variable, idx, idx2, quantile_cont(abs(value - med), 0.5) * 1.4826 AS mad
      FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY variable, idx, idx2) AS med FROM wide) m
      GROUP BY variable, idx, idx2) t
  ON s.variable = t.variable AND s.idx IS NOT DISTINCT FROM t.idx AND s.idx2 IS NOT DISTINCT FROM t.idx2
JOIN rank_rh r ON s.variable = r.variable AND s.idx IS NOT DISTINCT FROM r.idx AND s.idx2 IS NOT DISTINCT FROM r.idx2""",
    extra={"wide": (fx.WIDE_LONG_SQL, []), **_rank_rhat_sql("wide")}))
def summarise_wide_draws(spark, d):
    """Complete summary of draws that hold scalars and parameters of one and two indices."""
    return round_doubles(_named(D.summarise_all(DR.draws_from_wide(fx.wide_draws(spark, d)))))


@q("ess")
def ess(spark, d):
    """Rows-only: bulk and tail effective sample sizes per parameter."""
    return round_doubles(D.ess(_draws(spark, d)))


@q("align_signs")
def align_signs(spark, d):
    """Rows-only: per-draw signs from the iterative alignment of the loadings."""
    signs, rounds, converged = DR.align_signs(_draws(spark, d), "gamma")
    return signs.select("draw", "sign", F.lit(rounds).cast("long").alias("rounds"), F.lit(converged).alias("converged"))

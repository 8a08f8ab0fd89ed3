"""Voter and candidate scores from posterior draws, and comparison with external
candidate scores (B9-B12, B16-B22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.relational import distinct_on, join_keys
from ..session import bounded_broadcast, cut_lineage, scalar_row
from .diagnostics import param_keys


def external_candidates(ext: DataFrame, cycle: int | None = 2020, sep: str = "_",
                        pad_width: int | None = None) -> DataFrame:
    """B20 (first half): scored candidates of one cycle keyed by (race, candidate).
    NULL scores dropped; one row per (office, district, candidate), the smallest
    score when the source repeats a candidate."""
    df = ext
    if cycle is not None:
        df = df.where(F.col("cycle") == cycle)
    df = df.where(F.col("cfscore").isNotNull())
    df = distinct_on(df.select("office", "district", "candidate", "cfscore"),
                     ["office", "district", "candidate"], ["cfscore"])
    district = tx.pad_left("district", pad_width) if pad_width else F.col("district")
    return df.select(tx.str_c(F.col("office"), district, sep=sep).alias("race"), "candidate", "cfscore")


def external_seats(raw: DataFrame, cycle: int = 2020, states=None, seats: dict = tx.SEAT_OFFICES) -> DataFrame:
    """B20, first step: rows of one cycle in the known seats, without losers (``pwinner``
    'L'; a NULL result stays out too), in the wanted states, the seat recoded to its
    office name."""
    df = raw.where((F.col("cycle") == cycle) & F.col("seat").isin(list(seats)) & (F.col("pwinner") != "L"))
    if states is not None:
        df = df.where(F.col("state").isin(list(states)))
    return df.select(tx.recode("seat", seats).alias("office"), "district", "candidate", "cfscore")


def external_scores(ext: DataFrame, votes_races: DataFrame, cycle: int | None = 2020,
                    sep: str = "_", min_scored: int = 2, pad_width: int | None = None) -> DataFrame:
    """External candidate scores: z-scored over the cycle's scored rows
    (proper ``(x - mean) / sd``), one row per candidate, the district padded to
    ``pad_width``, restricted to races that appear in the votes and have at least
    ``min_scored`` scored candidates."""
    from ..operators.relational import group_size_filter, zscore
    df = ext
    if cycle is not None:
        df = df.where(F.col("cycle") == cycle)
    df = zscore(df.where(F.col("cfscore").isNotNull()), "cfscore", "dime_score")
    cands = distinct_on(df.select("office", "district", "candidate", "cfscore", "dime_score"),
                        ["office", "district", "candidate"], ["cfscore", "dime_score"])
    district = tx.pad_left("district", pad_width) if pad_width else F.col("district")
    cands = cands.select(tx.str_c(F.col("office"), district, sep=sep).alias("race"),
                         "candidate", "cfscore", "dime_score")
    cands = cands.join(votes_races.select("race").distinct(), "race", "left_semi")
    return group_size_filter(cands, ["race"], ">=", min_scored)


def voter_scores(draws: DataFrame, variable: str = "alpha", orient: int = 1) -> DataFrame:
    """Per voter posterior mean (times ``orient``, -1 flips the scale) and
    precision 1 / var."""
    return draws.where(F.col("variable") == variable).groupBy(F.col("idx").alias("voter_id")).agg(
        (F.lit(float(orient)) * F.avg("value")).alias("mean"),
        (F.lit(1.0) / F.var_samp("value")).alias("precision"))


def candidate_scores(scores: DataFrame, choices: DataFrame, min_voters: int = 5,
                     standardise: bool = True) -> DataFrame:
    """Precision-weighted mean voter score of each (race, candidate)'s
    choosers; candidates (by name) with fewer than ``min_voters`` joined rows are
    dropped; scores z-scored over candidates."""
    from ..operators.relational import group_size_filter, zscore
    joined = scores.join(choices.select("voter_id", "race", "candidate"), "voter_id") \
                   .where(F.col("candidate").isNotNull())
    kept = group_size_filter(joined, ["candidate"], ">=", min_voters)
    out = kept.groupBy("race", "candidate").agg(
        (F.sum(F.col("mean") * F.col("precision")) / F.sum("precision")).alias("bayes_ideal"),
        F.count(F.lit(1)).alias("n_voters"))
    if not standardise:
        return out
    # one row per candidate: written once to the checkpoint folder so the z-score's
    # two numbers and the result read it instead of re-running the voter joins
    return zscore(cut_lineage(out), "bayes_ideal")


def scores_by_choice(scores: DataFrame, voter_choice: DataFrame, main=(), min_other: int = 5) -> DataFrame:
    """Voter scores beside their choice in one office; ``group`` is 'main'
    for the listed candidates, otherwise 'other' (others need more than
    ``min_other`` voters)."""
    from ..operators.relational import group_size_filter
    j = scores.join(voter_choice.select("voter_id", "choice"), "voter_id").where(F.col("choice").isNotNull())
    is_main = F.col("choice").isin(list(main)) if main else F.lit(False)
    mains = j.where(is_main).withColumn("group", F.lit("main"))
    others = group_size_filter(j.where(~is_main), ["choice"], ">", min_other).withColumn("group", F.lit("other"))
    return mains.unionByName(others)


def weighted_density(df: DataFrame, group_col: str, value_col: str = "mean", weight_col: str = "precision",
                     grid: int = 64, bins: int = 512) -> DataFrame:
    """Weighted Gaussian kernel density of ``value_col`` on a ``grid``-point
    grid per group.  Bandwidth 1.06 sd n^(-1/5) (normal reference); the grid spans
    the group's range +- 3 bandwidths.

    Rows are first reduced to ``bins`` equal bins of the group's range, each kept as
    its weight and weighted mean (a partial aggregate); kernels are summed over grid x
    bins, so the fan-out does not grow with the rows.  A group with one row or
    without spread has no density: its grid rows hold NULL."""
    stats = cut_lineage(df.groupBy(group_col).agg(
        F.min(value_col).alias("_lo"), F.max(value_col).alias("_hi"),
        F.stddev_samp(value_col).alias("_sd"), F.count(F.lit(1)).alias("_n"),
        F.sum(weight_col).alias("_wsum")))
    stats_b = bounded_broadcast(stats, 80)
    width = F.col("_hi") - F.col("_lo")
    pos = F.when(width > 0, F.least(F.floor((F.col(value_col) - F.col("_lo")) / width * bins), F.lit(bins - 1))).otherwise(0)
    binned = join_keys(df.select(group_col, value_col, weight_col), stats_b.select(group_col, "_lo", "_hi"), [group_col]) \
        .groupBy(group_col, pos.alias("_bin")).agg(
            F.sum(weight_col).alias("_w"), (F.sum(F.col(weight_col) * F.col(value_col)) / F.sum(weight_col)).alias("_v"))
    bw = F.lit(1.06) * F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    j = join_keys(binned, stats_b, [group_col]).withColumn("_bw", F.when(bw > 0, bw))
    spread = F.coalesce("_bw", F.lit(0.0))
    start = F.col("_lo") - 3 * spread
    step = (width + 6 * spread) / F.lit(grid - 1)
    ex = j.select(group_col, "_v", "_w", "_bw", "_wsum", start.alias("_start"), step.alias("_step"),
                  F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    x = F.col("_start") + F.col("g") * F.col("_step")
    z = (x - F.col("_v")) / F.col("_bw")
    k = F.col("_w") * F.exp(-0.5 * z * z) / (F.col("_bw") * F.col("_wsum") * F.lit(2.5066282746310002))
    return ex.groupBy(group_col, "g").agg(F.first(x).alias("x"), F.sum(k).alias("density"))


def race_parameter_table(draws: DataFrame, flat_ids: DataFrame, difficulty: str = "diff",
                         discrimination: str = "disc") -> DataFrame:
    """Mean, median and sd of the difficulty and discrimination draws per race,
    race names title-cased with a leading 'Us' written 'US'.  A race's draws are bounded
    by its candidates and the sampler settings."""
    j = draws.where(F.col("variable").isin(difficulty, discrimination)) \
             .join(flat_ids.select("race", F.col("param_idx").alias("idx")), "idx")
    aggs = []
    for name in (difficulty, discrimination):
        v = F.when(F.col("variable") == name, F.col("value"))
        aggs += [F.avg(v).alias(f"mean_{name}"), F.percentile(v, 0.5).alias(f"median_{name}"), F.stddev_samp(v).alias(f"sd_{name}")]
    out = j.groupBy("race").agg(*aggs)
    return out.withColumn("race", F.regexp_replace(tx.title_case("race"), "^Us", "US"))


def scaled_discrimination(draws: DataFrame, flat_ids: DataFrame, variable: str = "loggamma",
                          scale_by: str = "alpha") -> DataFrame:
    """B16, exp form: discrimination exp(variable) / sd of each draw's ``scale_by``, its
    mean and median per race."""
    sds = draws.where(F.col("variable") == scale_by).groupBy("draw").agg(F.stddev_samp("value").alias("_sd"))
    v = draws.where(F.col("variable") == variable).join(sds, "draw")
    j = v.join(flat_ids.select("race", F.col("param_idx").alias("idx")), "idx")
    x = F.exp("value") / F.col("_sd")
    return j.groupBy("race").agg(F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.count(F.lit(1)).alias("n_draws"))


def candidate_party(data: DataFrame) -> DataFrame:
    """One party label per (race, candidate): 'democrat' if any row says so,
    otherwise the smallest label."""
    return data.groupBy("race", "candidate").agg(
        F.when(F.max(F.col("party") == "democrat"), F.lit("democrat")).otherwise(F.min("party")).alias("party"))


def discrimination_by_type(draws: DataFrame, flat_ids: DataFrame, parties: DataFrame,
                           type_pattern: str = "_.*$", variable: str = "disc") -> DataFrame:
    """|discrimination| by partisan / non-partisan contest and race type
    (race name with the district part removed); candidates whose mean
    discrimination is exactly 0 (reference candidates) are dropped."""
    from .diagnostics import interval_summary
    g = draws.where(F.col("variable") == variable) \
             .join(flat_ids.select("race", "candidate", F.col("param_idx").alias("idx")), "idx")
    nonzero = g.groupBy("race", "candidate").agg(F.avg("value").alias("_m")).where(F.col("_m") != 0)
    g = g.join(nonzero.select("race", "candidate"), ["race", "candidate"], "left_semi") \
         .join(parties, ["race", "candidate"], "left")
    partisan = F.when(F.col("party").isNull(), F.lit("UNKNOWN")) \
                .when(F.col("party").rlike(tx.NONPARTISAN_PATTERN), F.lit("NONPARTISAN")) \
                .otherwise(F.lit("PARTISAN"))
    g = g.withColumn("partisan", partisan) \
         .withColumn("race_type", F.regexp_replace("race", type_pattern, "")) \
         .withColumn("abs_gamma", F.abs("value"))
    return interval_summary(g, ["partisan", "race_type"], "abs_gamma")


def district_scores(draws: DataFrame, choices: DataFrame, office: str, districts: DataFrame,
                    district_key: str = "District_1") -> DataFrame:
    """Mean voter score per district of one office's voters, joined to a
    district attribute table whose key column has another name."""
    res = draws.where(F.col("variable") == "alpha") \
               .join(choices.where((F.col("office") == office) & F.col("district").isNotNull())
                     .select(F.col("voter_id").alias("idx"), "district"), "idx")
    summ = res.groupBy("district").agg(F.avg("value").alias("ideal_mean"), F.count(F.lit(1)).alias("n_draws"))
    attrs = districts.join(summ.select(F.col("district").alias(district_key)), district_key, "left_semi")
    return attrs.join(summ, F.col(district_key) == F.col("district"), "left").drop("district")


def compare_fits(fit_a: DataFrame, fit_b: DataFrame, exclude_pattern: str = r"^lp|raw|\.") -> DataFrame:
    """Per parameter the two fits' values (a = posterior means, b = a single
    draw or another fit's means), typed by variable and min-max rescaled per type."""
    from ..operators.relational import rescale01
    keys = param_keys(fit_a)
    a = fit_a.groupBy(*keys).agg(F.avg("value").alias("value_x"))
    b = fit_b.groupBy(*keys).agg(F.avg("value").alias("value_y"))
    j = join_keys(a, b, keys, "left").where(~F.col("variable").rlike(exclude_pattern))
    j = j.withColumn("type", F.col("variable"))
    return rescale01(j, ["value_x", "value_y"], ["type"])


def fits_correlation(fit_a: DataFrame, fit_b: DataFrame, exclude_pattern: str = r"^lp|raw|\.") -> DataFrame:
    """Pearson correlation of the two fits' parameter values."""
    keys = param_keys(fit_a)
    a = fit_a.groupBy(*keys).agg(F.avg("value").alias("value_x"))
    b = fit_b.groupBy(*keys).agg(F.avg("value").alias("value_y"))
    j = join_keys(a, b, keys).where(~F.col("variable").rlike(exclude_pattern))
    return j.agg(F.corr("value_x", "value_y").alias("correlation"), F.count(F.lit(1)).alias("n"))


def voters_vs_external(draws: DataFrame, ext_scores: DataFrame, choices: DataFrame) -> DataFrame:
    """For each scored candidate and draw, the choosers' positions (alpha divided by
    the sd of all alpha draws) beside the candidate's external score: their number, mean
    and sd.  Choosers x draws meet only inside the partial aggregate and are not returned."""
    alpha = draws.where(F.col("variable") == "alpha").select("draw", F.col("idx").alias("voter_id"), "value")
    sd = scalar_row(alpha, F.stddev_samp("value").alias("s"))["s"]
    pick = ext_scores.join(choices.select("race", "candidate", "voter_id"), ["race", "candidate"])
    x = F.col("value") / F.lit(sd)
    return pick.join(alpha, "voter_id").groupBy("race", "candidate", "dime_score", "draw").agg(
        F.count(F.lit(1)).alias("n_voters"), F.avg(x).alias("mean_alpha"), F.stddev_samp(x).alias("sd_alpha"))


def scored_candidates(ext_scores: DataFrame, cand_scores: DataFrame) -> DataFrame:
    """Candidates with both an external score (``dime_ideal``) and a model score."""
    return ext_scores.select("race", "candidate", F.col("cfscore").alias("dime_ideal")) \
        .join(cand_scores.select("race", "candidate", "bayes_ideal"), ["race", "candidate"])


def cutpoints(scored: DataFrame) -> DataFrame:
    """Midpoints of every pair of scored candidates of the same race on both
    scales, deduplicated.  A race's scored candidates are a handful (bounded by
    the ballot), so the pairs stay within that contest's short list."""
    a = scored.select("race", F.col("candidate").alias("c1"), F.col("bayes_ideal").alias("b1"),
                      F.col("dime_ideal").alias("d1"))
    b = scored.select("race", F.col("candidate").alias("c2"), F.col("bayes_ideal").alias("b2"),
                      F.col("dime_ideal").alias("d2"))
    pairs = a.join(b, "race").where(F.col("c1") < F.col("c2"))
    return pairs.select("race", ((F.col("b1") + F.col("b2")) / 2).alias("cut_bayes"),
                        ((F.col("d1") + F.col("d2")) / 2).alias("cut_dime")).distinct()


def cutpoint_correlation(scored: DataFrame, same_race: bool = True) -> DataFrame:
    """Pearson correlation of the cutpoints over all unordered candidate
    pairs, computed from per-race moment sums without forming the pairs:
    for n candidates with scores x, y the pair midpoints satisfy
    sum a = (n-1)/2 sum x, sum a^2 = ((n-2) sum x^2 + (sum x)^2)/4,
    sum ab = ((n-2) sum xy + sum x sum y)/4, count = n(n-1)/2.
    ``same_race=False`` pools every candidate into one group (the reference's
    cross-race pairs)."""
    g = scored.withColumn("_g", F.col("race") if same_race else F.lit("all"))
    per = g.groupBy("_g").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("bayes_ideal").alias("sx"),
        F.sum("dime_ideal").alias("sy"), F.sum(F.col("bayes_ideal") ** 2).alias("sxx"),
        F.sum(F.col("dime_ideal") ** 2).alias("syy"),
        F.sum(F.col("bayes_ideal") * F.col("dime_ideal")).alias("sxy"))
    n = F.col("n")
    m = per.select(
        (n * (n - 1) / 2).alias("k"), ((n - 1) / 2 * F.col("sx")).alias("a"), ((n - 1) / 2 * F.col("sy")).alias("b"),
        (((n - 2) * F.col("sxx") + F.col("sx") ** 2) / 4).alias("aa"),
        (((n - 2) * F.col("syy") + F.col("sy") ** 2) / 4).alias("bb"),
        (((n - 2) * F.col("sxy") + F.col("sx") * F.col("sy")) / 4).alias("ab"))
    t = m.agg(*[F.sum(c).alias(c) for c in ("k", "a", "b", "aa", "bb", "ab")])
    k = F.col("k")
    cov = F.col("ab") - F.col("a") * F.col("b") / k
    vx = F.col("aa") - F.col("a") ** 2 / k
    vy = F.col("bb") - F.col("b") ** 2 / k
    return t.select((cov / F.sqrt(vx * vy)).alias("correlation"),
                    F.coalesce(k, F.lit(0.0)).cast("long").alias("n_pairs"))

"""Vote-record operators (C1-C7, C13-C18): the sampling query and the tables
built directly on cast vote records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from .relational import group_keys_where
from .sampling import sample_fraction, sample_global, sample_n

VOTER_KEY = ["state", "county_name", "cvr_id"]
OUTPUT_COLUMNS = ["state", "precinct", "cvr_id", "county_name", "candidate", "district",
                  "office", "party", "race"]


def race_key(office="office", district="district") -> F.Column:
    """D3: contest key ``office_district`` with NULL parts written as ``NA``."""
    return tx.paste(office, district, sep="_")


def valid_votes(cvr: DataFrame, compare: DataFrame | None = None, state: str | None = None) -> DataFrame:
    """Single-seat contests with a named office, no under/over/write-in votes,
    released counties only, plus the contest key ``race``.

    ``state=None`` keeps every state.  The registry holds one row per county, so
    the semi join is planned as a broadcast by AQE from its runtime size."""
    df = cvr
    if state is not None:
        df = df.where(F.col("state") == F.lit(state))
    df = df.where((F.col("magnitude") == 1) & F.col("office").isNotNull()
                  & ~F.col("candidate").rlike(tx.NON_CANDIDATE_PATTERN))
    if compare is not None:
        df = df.join(compare.select("state", "county_name"), ["state", "county_name"], "left_semi")
    return df.drop("magnitude").withColumn("race", race_key()).select(OUTPUT_COLUMNS)


def sample_precincts(base: DataFrame, prop: float = 0.1, seed=2139) -> DataFrame:
    """C2 step 1: ``floor(prop * n)`` precincts of each county (stratum = state, county)."""
    precincts = base.select("state", "county_name", "precinct").distinct()
    return sample_fraction(precincts, ["state", "county_name"], ["precinct"], prop, seed)


def sample_voters(base: DataFrame, precincts: DataFrame, n: int = 500, seed=2139) -> DataFrame:
    """C2 step 2: up to ``n`` voters of each sampled precinct, then distinct voters."""
    in_precincts = base.join(precincts, ["state", "county_name", "precinct"], "inner") \
                       .select("state", "county_name", "precinct", "cvr_id").distinct()
    picked = sample_n(in_precincts, ["state", "county_name", "precinct"], ["cvr_id"], n, seed,
                      hash_cols=["cvr_id"])
    return picked.select(*VOTER_KEY).distinct()


def small_candidates(rows: DataFrame, min_votes: int = 10) -> DataFrame:
    """(race, candidate) pairs with at most ``min_votes`` rows."""
    return group_keys_where(rows, ["race", "candidate"], "<=", min_votes)


def contested_races(base: DataFrame, small: DataFrame) -> DataFrame:
    """C4: races with more than one candidate once small candidates are removed.

    The anti join runs on the distinct (race, candidate) dimension, not on the
    vote rows, so a statewide contest never piles up in one join task."""
    cands = base.select("race", "candidate").distinct()
    kept = cands.join(small, ["race", "candidate"], "left_anti")
    return group_keys_where(kept, ["race"], ">", 1)


def partisan_races(base: DataFrame) -> DataFrame:
    """Races with at least one party label that is not 'nonpartisan'
    (NULL labels do not count)."""
    return (base.select("race", "party").distinct()
                .where(~F.col("party").rlike(tx.NONPARTISAN_PATTERN))
                .select("race").distinct())


def get_votes(cvr: DataFrame, compare: DataFrame | None, state: str | None,
              prop: float = 0.1, n: int = 500, min_votes: int = 10, seed=2139,
              partisan_only: bool = False, max_voters: int | None = None) -> DataFrame:
    """The sampling query.  Sampled voters' choices in contested races.

    Small candidates are counted on the *sample*, contestedness is tested on the
    *full* base; small candidates stay in the output (only ``filter_county``
    drops them).  ``max_voters`` (off by default) caps the voter sample.

    The records are scanned once: the valid votes are written, and the precincts and
    voters come from one aggregate of them, candidates and parties from another."""
    base = cut_lineage(valid_votes(cvr, compare, state))
    people = cut_lineage(base.select("state", "county_name", "precinct", "cvr_id").distinct())
    labels = cut_lineage(base.select("race", "candidate", "party").distinct())
    precincts = sample_precincts(people, prop, seed)
    voters = sample_voters(people, precincts, n, seed)
    if max_voters is not None:
        voters = sample_global(voters, VOTER_KEY, max_voters, seed)
    sampled = cut_lineage(base.join(voters, VOTER_KEY, "inner"))
    small = small_candidates(sampled, min_votes)
    races = contested_races(labels, small)
    if partisan_only:
        races = races.join(partisan_races(labels), "race", "left_semi")
    # races is the contest dimension: a semi join keeps the vote rows where they
    # are (AQE broadcasts it from its runtime size; otherwise the skew-join split
    # cuts a statewide contest into several tasks)
    return sampled.join(races, "race", "left_semi").select(OUTPUT_COLUMNS)


def filter_county(data: DataFrame, county: str, min_votes: int = 10) -> DataFrame:
    """One county's rows without its own small candidates (contestedness is
    not re-tested)."""
    rows = data.where(F.col("county_name") == F.lit(county))
    small = small_candidates(rows, min_votes)
    return rows.join(small, ["race", "candidate"], "left_anti").select(data.columns)


def voter_choice(data: DataFrame, office: str, mapping: dict | None = None,
                 key=VOTER_KEY) -> DataFrame:
    """Each voter's (whitespace-squished, recoded) choice in one office.
    One row per voter of ``data``; NULL when the voter skipped that office."""
    cand = tx.recode(tx.squish("candidate"), mapping or {})
    return data.groupBy(*key).agg(F.min(F.when(F.col("office") == F.lit(office), cand)).alias("choice"))


def attach_voter_choice(data: DataFrame, office: str, mapping: dict | None = None,
                        key=VOTER_KEY, name: str = "choice") -> DataFrame:
    """C13, row form: the voter's choice attached to every row of the voter."""
    w = Window.partitionBy(*key)
    cand = tx.recode(tx.squish("candidate"), mapping or {})
    return data.withColumn(name, F.min(F.when(F.col("office") == F.lit(office), cand)).over(w))


def choosers(choices: DataFrame, pairs: DataFrame, voter_col: str = "voter_id") -> DataFrame:
    """C14: voters who chose each (race, candidate) of ``pairs``, all pairs in one join."""
    return pairs.join(choices.select("race", "candidate", voter_col), ["race", "candidate"], "inner")


def largest_office(data: DataFrame) -> DataFrame:
    """The office with most rows (ties by name) among those in which both parties stand, as a
    table of at most one row."""
    sides = [F.count(F.when(F.col("party") == side, 1)) for side in ("democrat", "republican")]
    counts = data.where(F.col("office").isNotNull()).groupBy("office").agg(
        F.count(F.lit(1)).alias("_n"), F.least(*sides).alias("_both")).where(F.col("_both") > 0)
    w = Window.orderBy(F.desc("_n"), F.asc("office"))
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("office")


def party_delta(data: DataFrame, reference_office: str | None = None, key=VOTER_KEY) -> DataFrame:
    """For each candidate |P(c | Democratic voter) - P(c | Republican voter)|
    and the race maximum.  A voter's side is the party of their choice in the
    reference office (default: the office with the most rows in which both parties stand)."""
    if reference_office is None:
        # at most one row (row_number = 1), so the broadcast size is fixed; a shuffle
        # join on ``office`` would put the largest office, by definition the
        # hottest key, in one task
        ref_rows = data.join(F.broadcast(largest_office(data)), "office", "left_semi")
    else:
        ref_rows = data.where(F.col("office") == F.lit(reference_office))
    side = (ref_rows.groupBy(*key)
            .agg(F.max(F.when(F.col("party") == "democrat", 1).when(F.col("party") == "republican", 2))
                 .alias("_side"))
            .where(F.col("_side").isNotNull()))
    rows = data.join(side, list(key), "inner")
    per_cand = rows.groupBy("race", "candidate").agg(
        F.sum(F.when(F.col("_side") == 1, 1).otherwise(0)).alias("n_dem"),
        F.sum(F.when(F.col("_side") == 2, 1).otherwise(0)).alias("n_rep"))
    w = Window.partitionBy("race")
    out = (per_cand
           .withColumn("dem_total", F.sum("n_dem").over(w))
           .withColumn("rep_total", F.sum("n_rep").over(w))
           .withColumn("p_dem", F.when(F.col("dem_total") > 0, F.col("n_dem") / F.col("dem_total")))
           .withColumn("p_rep", F.when(F.col("rep_total") > 0, F.col("n_rep") / F.col("rep_total")))
           .withColumn("delta", F.abs(F.col("p_dem") - F.col("p_rep"))))
    return out.withColumn("max_delta", F.max("delta").over(w)) \
              .select("race", "candidate", "n_dem", "n_rep", "p_dem", "p_rep", "delta", "max_delta")


def contest_dictionary(contests: DataFrame, pad_offices=tx.PADDED_OFFICES) -> DataFrame:
    """Normalised contest dictionary: rows without a contest dropped, upper
    case, district numbers of some offices zero-padded, the placeholders
    COUNTY_NAME / STATEWIDE replaced by the county / state, non-ASCII removed."""
    df = contests.where(F.col("contest").isNotNull())
    for c in df.columns:
        if c != "contest":
            df = df.withColumn(c, F.upper(F.col(c)))
    district = F.when(F.col("office").isin(list(pad_offices)), tx.pad_left("district", 3)) \
                .otherwise(F.col("district"))
    df = df.withColumn("district", district)
    df = df.withColumn("district", tx.replace_fixed("district", "COUNTY_NAME", F.col("county_name")))
    df = df.withColumn("district", tx.replace_fixed("district", "STATEWIDE", F.col("state")))
    return df.withColumn("contest", tx.ascii_only("contest"))


def contests_per_county(dictionary: DataFrame, county: str | None = None) -> DataFrame:
    """Mean number of distinct (office, district) contests per county."""
    df = dictionary.select("state", "county_name", "office", "district").distinct()
    if county is not None:
        df = df.where(F.col("county_name") == F.lit(county))
    per = df.groupBy("state", "county_name").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.avg("n").alias("mean_contests"), F.count(F.lit(1)).alias("n_counties"))


def area_profile(wide: DataFrame, area_col: str, areas, strip_pattern: str,
                 name_col: str = "name", first_area: str | None = None) -> DataFrame:
    """C17: transpose a wide table of measures (one row per area) so that areas
    become columns, then clean the measure names.  ``areas`` is the list of area
    values (the area dimension) and fixes the column order; ``first_area`` is
    moved to the front."""
    value_cols = [c for c in wide.columns if c != area_col]
    long = wide.unpivot([area_col], value_cols, name_col, "value")
    order = list(areas)
    if first_area is not None and first_area in order:
        order = [first_area] + [a for a in order if a != first_area]
    t = long.groupBy(name_col).pivot(area_col, order).agg(F.first("value"))
    return t.withColumn(name_col, F.regexp_replace(F.col(name_col), strip_pattern, ""))


def sample_report(votes: DataFrame) -> DataFrame:
    """Voters, contests, candidates and choices of an encoded sample."""
    return votes.agg(
        F.countDistinct("voter_id").alias("n_voters"),
        F.countDistinct("race_id").alias("n_contests"),
        F.countDistinct("race_id", "candidate_id").alias("n_cands"),
        F.count(F.lit(1)).alias("n_votes"))

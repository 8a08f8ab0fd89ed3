"""Integer encodings of vote records (C8-C12, M14): candidate and voter ids,
ragged (long) votes, contest sizes and offsets, dense matrix, ballot groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import merged_beyond
from .relational import dense_ids, running_offset
from .votes import VOTER_KEY

#: Largest table of voters that a join may copy to every executor, and the bytes of one of its rows there.
VOTERS_BYTES, VOTER_ROW = 16 << 20, 100


def _party_rank(party: F.Column) -> F.Column:
    # democrat first, other parties next, unknown party last
    return F.when(party == "democrat", 0).when(party.isNull(), 2).otherwise(1)


def race_ids(cands: DataFrame) -> DataFrame:
    """Race ordinal 1..K in race order (a window over the race dimension only)."""
    races = cands.select("race").distinct()
    return races.withColumn("race_id", F.row_number().over(Window.orderBy("race")).cast("long"))


def candidate_ids(data: DataFrame, reference: str = "democrat",
                  proposition_pattern: str = tx.PROPOSITION_PATTERN) -> DataFrame:
    """(race, candidate) -> candidate_id (1..s within the race) and race_id.

    ``reference='democrat'``: the Democrat is candidate 1, then other parties,
    unknown party last, then by name; propositions carry no party.  When a
    candidate has several party labels the Democratic one wins, then the smallest
    label.  ``reference='plurality'``: most rows first, ties by name."""
    if reference == "democrat":
        party = F.when(F.col("race").rlike(proposition_pattern), F.lit(None).cast("string")) \
                 .otherwise(F.col("party"))
        labelled = data.select("race", "candidate", party.alias("party")).distinct()
        one = (labelled.groupBy("race", "candidate")
               .agg(F.min(F.struct(_party_rank(F.col("party")).alias("r"), F.col("party"))).alias("m"))
               .select("race", "candidate", F.col("m.r").alias("_rank")))
        w = Window.partitionBy("race").orderBy("_rank", "candidate")
        cands = one.withColumn("candidate_id", F.row_number().over(w).cast("long")).drop("_rank")
    elif reference == "plurality":
        counts = data.groupBy("race", "candidate").agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy("race").orderBy(F.desc("_n"), "candidate")
        cands = counts.withColumn("candidate_id", F.row_number().over(w).cast("long")).drop("_n")
    else:
        raise ValueError("reference must be 'democrat' or 'plurality'")
    return cands.join(race_ids(cands), "race").select("race", "candidate", "candidate_id", "race_id")


def voter_ids(data: DataFrame, key=VOTER_KEY) -> DataFrame:
    """Dense voter ids 1..N in (state, county_name, cvr_id) order.  Many voters are joined
    by sort and merge, and so is what is selected from them."""
    voters = data.select(*key).distinct()
    return merged_beyond(dense_ids(voters, list(key), "voter_id"), VOTER_ROW, VOTERS_BYTES)


def ragged_votes(data: DataFrame, ids: DataFrame, voters: DataFrame, key=VOTER_KEY) -> DataFrame:
    """Long form of the ragged arrays: (voter_id, race_id, candidate_id).

    The candidate map is a dimension (AQE broadcasts it from its runtime size);
    the voter map joins on the voter key, which has no hot values."""
    return (data.join(ids, ["race", "candidate"], "left")
                .join(voters, list(key), "left")
                .select("voter_id", "race_id", "candidate_id"))


def contest_sizes(ids: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """Per contest its number of candidates, votes, and the offsets of
    its first parameter and first vote in the flat (contest-ordered) arrays."""
    sizes = ids.groupBy("race_id").agg(F.count(F.lit(1)).alias("size"))
    if votes is not None:
        nv = votes.groupBy("race_id").agg(F.count(F.lit(1)).alias("n_votes"))
        sizes = sizes.join(nv, "race_id", "left").fillna(0, ["n_votes"])
    else:
        sizes = sizes.withColumn("n_votes", F.lit(0).cast("long"))
    sizes = running_offset(sizes, "race_id", "size", "param_offset")
    return running_offset(sizes, "race_id", "n_votes", "vote_offset") \
        .select("race_id", "size", "n_votes", "param_offset", "vote_offset")


def flat_parameter_index(ids: DataFrame) -> DataFrame:
    """Position of each candidate in the flat parameter vector
    (contest offset + candidate id)."""
    offs = contest_sizes(ids).select("race_id", "param_offset")
    return ids.join(offs, "race_id").withColumn(
        "param_idx", (F.col("param_offset") + F.col("candidate_id")).cast("long")).drop("param_offset")


def dense_votes(votes: DataFrame, ids: DataFrame) -> DataFrame:
    """C11: voter x contest matrix as one array column ``choices``: entry k is the
    candidate id of the voter's choice in the k-th contest of ``ids``, 0 where the
    voter did not vote.

    The width comes from the contest dimension without naming a column for each
    contest, so it can hold any number of contests.  Contest ids are 1..K (W2);
    the entries of a voter are merged as a map, whose size is bounded by the
    ballot, and spread over the array by one pass per voter."""
    width = ids.agg(F.coalesce(F.max("race_id"), F.lit(0)).cast("int").alias("_k"))
    per = votes.groupBy("voter_id").agg(F.array_sort(F.collect_set(F.struct("race_id", "candidate_id"))).alias("_v"))
    # one row: the number of contests
    t = per.join(F.broadcast(width))

    def fill(state, x):
        """Zeros up to the contest of x, then its choice; a second choice is left out."""
        gap = (x["race_id"] - F.size(state) - 1).cast("int")
        return F.when(gap < 0, state).otherwise(F.concat(state, F.array_repeat(F.lit(0).cast("long"), gap), F.array(x["candidate_id"])))

    head = F.aggregate("_v", F.array().cast("array<bigint>"), fill)
    return t.withColumn("_h", head).select("voter_id", F.concat(
        "_h", F.array_repeat(F.lit(0).cast("long"), (F.col("_k") - F.size("_h")).cast("int"))).alias("choices"))


def all_choice_ids(data: DataFrame, undervote: str = "UNDERVOTE") -> DataFrame:
    """Candidate ids over every recorded choice but exact undervotes (write-ins
    and overvotes stay), most frequent first within a race, ties by name."""
    return candidate_ids(data.where(F.col("candidate") != undervote), "plurality")


def vote_sequence(data: DataFrame, key=VOTER_KEY) -> DataFrame:
    """Number of each choice within its voter, in the order of race and candidate."""
    w = Window.partitionBy(*key).orderBy("race", "candidate")
    return data.withColumn("seq", F.row_number().over(w).cast("long"))


def ballots(data: DataFrame, key=VOTER_KEY) -> DataFrame:
    """Each voter's ballot as a sorted array of (race, candidate)."""
    return data.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("race", "candidate"))).alias("ballot"))


def ballot_groups(data: DataFrame, key=VOTER_KEY) -> DataFrame:
    """Identical ballots of a county collapsed with their multiplicity;
    group ids 1..G in (state, county_name, ballot) order.

    A ballot is bounded by the number of contests on it; the count per distinct
    ballot is a partial aggregate, so a very common ballot does not skew it."""
    groups = (ballots(data, key).groupBy("state", "county_name", "ballot")
              .agg(F.count(F.lit(1)).alias("n_group")))
    return dense_ids(groups, ["state", "county_name", "ballot"], "group_id") \
        .withColumn("n_choices", F.size("ballot").cast("long"))


def ballot_groups_long(groups: DataFrame) -> DataFrame:
    """C12 back to long form: one row per group and choice."""
    return groups.select("group_id", "state", "county_name", "n_group",
                         F.explode("ballot").alias("c")) \
        .select("group_id", "state", "county_name", F.col("c.race").alias("race"),
                F.col("c.candidate").alias("candidate"), "n_group")


def encode(data: DataFrame, reference: str = "democrat"):
    """C8 + C9 + C10 in one call: (votes, ids, voters)."""
    ids = candidate_ids(data, reference)
    voters = voter_ids(data)
    return ragged_votes(data, ids, voters), ids, voters

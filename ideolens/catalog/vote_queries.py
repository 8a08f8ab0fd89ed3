"""Registered queries over vote records (C1-C18, samplers, encodings) with their
DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import encode as E
from ..operators import relational as R
from ..operators import sampling as S
from ..operators import votes as V
from ..session import cut_lineage
from ..sources import fixtures as fx
from . import inputs as I
from .inputs import round_doubles, with_ctes

Q: dict = {}
SQL: dict = {}

# Fixed value: recode table used on the stand-in candidate names.
STANDIN_NAMES = {"cand_0": "CAND ZERO", "cand_1": "CAND ONE"}
CHOICE_OFFICE = "standard"
FILTER_COUNTY = "NATION_1"


def q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@q("valid_votes", with_ctes("SELECT * FROM base", "base"))
def valid_votes(spark, d):
    return I.base(spark, d)


@q("sample_precincts", with_ctes("SELECT * FROM prec", "prec"))
def sample_precincts(spark, d):
    return V.sample_precincts(I.base(spark, d), fx.SAMPLE_PROP, fx.SAMPLE_SEED)


@q("sample_voters", with_ctes("SELECT * FROM svoters", "svoters"))
def sample_voters(spark, d):
    b = I.base(spark, d)
    return V.sample_voters(b, V.sample_precincts(b, fx.SAMPLE_PROP, fx.SAMPLE_SEED), fx.SAMPLE_N, fx.SAMPLE_SEED)


@q("sample_voters_capped", with_ctes("SELECT * FROM svoters_tight", "svoters_tight"))
def sample_voters_capped(spark, d):
    b = I.base(spark, d)
    return V.sample_voters(b, V.sample_precincts(b, fx.SAMPLE_PROP, fx.SAMPLE_SEED),
                           fx.SAMPLE_N_TIGHT, fx.SAMPLE_SEED)


@q("small_candidates", with_ctes("SELECT * FROM small", "small"))
def small_candidates(spark, d):
    b = I.base(spark, d)
    voters = V.sample_voters(b, V.sample_precincts(b, fx.SAMPLE_PROP, fx.SAMPLE_SEED), fx.SAMPLE_N, fx.SAMPLE_SEED)
    return V.small_candidates(b.join(voters, V.VOTER_KEY), fx.SAMPLE_MIN_VOTES)


@q("contested_races", with_ctes("SELECT * FROM contested", "contested"))
def contested_races(spark, d):
    b = I.base(spark, d)
    voters = V.sample_voters(b, V.sample_precincts(b, fx.SAMPLE_PROP, fx.SAMPLE_SEED), fx.SAMPLE_N, fx.SAMPLE_SEED)
    small = V.small_candidates(b.join(voters, V.VOTER_KEY), fx.SAMPLE_MIN_VOTES)
    return V.contested_races(b, small)


@q("partisan_races", with_ctes("SELECT * FROM partisan", "partisan"))
def partisan_races(spark, d):
    return V.partisan_races(I.base(spark, d))


@q("get_votes", with_ctes("SELECT * FROM get_votes", "get_votes"))
def get_votes(spark, d):
    return I.sample(spark, d)


@q("get_votes_partisan", with_ctes(
    "SELECT g.* FROM get_votes g WHERE g.race IN (SELECT race FROM partisan)", "get_votes", "partisan"))
def get_votes_partisan(spark, d):
    return I.sample(spark, d, partisan_only=True)


@q("get_votes_capped", with_ctes(f"""
SELECT s.* FROM base s
JOIN svoters_tight v ON s.state = v.state AND s.county_name = v.county_name AND s.cvr_id = v.cvr_id
JOIN (SELECT race FROM (SELECT DISTINCT race, candidate FROM base) c
      WHERE NOT EXISTS (SELECT 1 FROM (
          SELECT race, candidate FROM base b2
          JOIN svoters_tight v2 ON b2.state = v2.state AND b2.county_name = v2.county_name AND b2.cvr_id = v2.cvr_id
          GROUP BY race, candidate HAVING count(*) <= {fx.CAPPED_MIN_VOTES}) s2
        WHERE s2.race = c.race AND s2.candidate = c.candidate)
      GROUP BY race HAVING count(*) > 1) k ON s.race = k.race""", "base", "svoters_tight"))
def get_votes_capped(spark, d):
    return I.sample(spark, d, n=fx.SAMPLE_N_TIGHT, min_votes=fx.CAPPED_MIN_VOTES)


@q("filter_county", with_ctes(f"""
SELECT a.* FROM all_valid a
WHERE a.county_name = '{FILTER_COUNTY}' AND NOT EXISTS (
  SELECT 1 FROM (SELECT race, candidate FROM all_valid WHERE county_name = '{FILTER_COUNTY}'
                 GROUP BY race, candidate HAVING count(*) <= 10) s
  WHERE s.race = a.race AND s.candidate = a.candidate)""", "all_valid"))
def filter_county(spark, d):
    return V.filter_county(I.all_valid(spark, d), FILTER_COUNTY, 10)


@q("candidate_ids_democrat", with_ctes("SELECT * FROM cand_ids", "cand_ids"))
def candidate_ids_democrat(spark, d):
    return E.candidate_ids(I.all_valid(spark, d), "democrat")


@q("candidate_ids_plurality", with_ctes("""
SELECT race, candidate,
  CAST(row_number() OVER (PARTITION BY race ORDER BY n DESC, candidate) AS BIGINT) AS candidate_id,
  CAST(dense_rank() OVER (ORDER BY race) AS BIGINT) AS race_id
FROM (SELECT race, candidate, count(*) AS n FROM all_valid GROUP BY race, candidate) c""", "all_valid"))
def candidate_ids_plurality(spark, d):
    return E.candidate_ids(I.all_valid(spark, d), "plurality")


@q("voter_ids", with_ctes("SELECT * FROM voter_ids", "voter_ids"))
def voter_ids(spark, d):
    return E.voter_ids(I.all_valid(spark, d))


@q("ragged_votes", with_ctes("SELECT * FROM votes", "votes"))
def ragged_votes(spark, d):
    data = cut_lineage(I.all_valid(spark, d))
    votes, _, _ = E.encode(data)
    return votes


@q("contest_sizes", with_ctes("""
SELECT race_id, size, n_votes,
  CAST(coalesce(sum(size) OVER (ORDER BY race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS param_offset,
  CAST(coalesce(sum(n_votes) OVER (ORDER BY race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS vote_offset
FROM (SELECT i.race_id, count(*) AS size,
        (SELECT count(*) FROM votes v WHERE v.race_id = i.race_id) AS n_votes
      FROM cand_ids i GROUP BY i.race_id) s""", "cand_ids", "votes"))
def contest_sizes(spark, d):
    votes, ids, _, _ = I.encoded(spark, d)
    return E.contest_sizes(ids, votes)


@q("dense_votes", with_ctes("""
SELECT v.voter_id, string_agg(CAST(coalesce(x.candidate_id, 0) AS VARCHAR), ',' ORDER BY r.race_id) AS choices
FROM (SELECT DISTINCT voter_id FROM votes) v CROSS JOIN (SELECT DISTINCT race_id FROM cand_ids) r
LEFT JOIN (SELECT voter_id, race_id, min(candidate_id) AS candidate_id FROM votes GROUP BY voter_id, race_id) x
  ON x.voter_id = v.voter_id AND x.race_id = r.race_id
GROUP BY v.voter_id""", "votes", "cand_ids"))
def dense_votes(spark, d):
    votes, ids, _, _ = I.encoded(spark, d)
    dense = E.dense_votes(votes, ids)
    return dense.select("voter_id", F.array_join(F.transform("choices", lambda x: x.cast("string")), ",").alias("choices"))


_BALLOTS_SQL = """
SELECT state, county_name, ballot, count(*) AS n_group FROM (
  SELECT state, county_name, cvr_id,
         list(struct_pack(race := race, candidate := candidate) ORDER BY race, candidate) AS ballot
  FROM all_valid GROUP BY state, county_name, cvr_id) b
GROUP BY state, county_name, ballot"""


@q("ballot_groups", with_ctes("""
SELECT state, county_name, n_group,
  CAST(row_number() OVER (ORDER BY state, county_name, ballot) AS BIGINT) AS group_id,
  CAST(len(ballot) AS BIGINT) AS n_choices
FROM groups""", "all_valid", extra={"groups": (_BALLOTS_SQL, ["all_valid"])}))
def ballot_groups(spark, d):
    return E.ballot_groups(I.all_valid(spark, d)).drop("ballot")


@q("ballot_groups_long", with_ctes("""
SELECT group_id, state, county_name, c.race AS race, c.candidate AS candidate, n_group FROM (
  SELECT state, county_name, n_group, unnest(ballot) AS c,
    CAST(row_number() OVER (ORDER BY state, county_name, ballot) AS BIGINT) AS group_id
  FROM groups) x""", "all_valid", extra={"groups": (_BALLOTS_SQL, ["all_valid"])}))
def ballot_groups_long(spark, d):
    return E.ballot_groups_long(E.ballot_groups(I.all_valid(spark, d)))


def _recode_sql(expr: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {expr} END"


_SQUISH = "trim(regexp_replace(candidate, '\\s+', ' ', 'g'))"


@q("voter_choice", with_ctes(f"""
SELECT state, county_name, cvr_id,
  min(CASE WHEN office = '{CHOICE_OFFICE}' THEN {_recode_sql(_SQUISH, STANDIN_NAMES)} END) AS choice
FROM all_valid GROUP BY state, county_name, cvr_id""", "all_valid"))
def voter_choice(spark, d):
    return V.voter_choice(I.all_valid(spark, d), CHOICE_OFFICE, STANDIN_NAMES)


@q("recode_names", with_ctes(f"""
SELECT DISTINCT candidate, {_recode_sql(_SQUISH, STANDIN_NAMES)} AS name FROM all_valid""", "all_valid"))
def recode_names(spark, d):
    return I.all_valid(spark, d).select(
        "candidate", tx.recode(tx.squish("candidate"), STANDIN_NAMES).alias("name")).distinct()


@q("republican_choice", with_ctes("""
SELECT state, county_name, cvr_id, race,
  CASE WHEN party IS NULL THEN NULL WHEN party IN ('republican', 'REPUBLICAN') THEN 1.0 ELSE 0.0 END AS choice_rep
FROM all_valid""", "all_valid"))
def republican_choice(spark, d):
    return I.all_valid(spark, d).select("state", "county_name", "cvr_id", "race",
                                        tx.republican_choice().alias("choice_rep"))


_EXT_RACE_SQL = """
SELECT concat(office, '_', district) AS race, candidate, min(cfscore) AS cfscore
FROM ext WHERE cycle = 2020 AND cfscore IS NOT NULL GROUP BY office, district, candidate"""


@q("choosers", with_ctes("""
SELECT e.race, e.candidate, c.voter_id FROM ext_scores e
JOIN choices c ON c.race = e.race AND c.candidate = e.candidate""", "ext", "choices",
    extra={"ext_scores": (_EXT_RACE_SQL, ["ext"])}))
def choosers(spark, d):
    from ..plans.scores import external_candidates
    pairs = external_candidates(I.fx.external_raw(spark, d), cycle=2020).select("race", "candidate")
    return V.choosers(I.choices(spark, d), pairs)


@q("party_delta", with_ctes("""
SELECT race, candidate, n_dem, n_rep, round(p_dem, 4) AS p_dem, round(p_rep, 4) AS p_rep,
  round(delta, 4) AS delta, round(max(delta) OVER (PARTITION BY race), 4) AS max_delta
FROM (SELECT *, abs(p_dem - p_rep) AS delta FROM (
  SELECT race, candidate, n_dem, n_rep,
    CASE WHEN sum(n_dem) OVER (PARTITION BY race) > 0 THEN n_dem / sum(n_dem) OVER (PARTITION BY race) END AS p_dem,
    CASE WHEN sum(n_rep) OVER (PARTITION BY race) > 0 THEN n_rep / sum(n_rep) OVER (PARTITION BY race) END AS p_rep
  FROM (SELECT a.race, a.candidate,
          CAST(sum(CASE WHEN s.side = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_dem,
          CAST(sum(CASE WHEN s.side = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_rep
        FROM all_valid a JOIN side s ON a.state = s.state AND a.county_name = s.county_name AND a.cvr_id = s.cvr_id
        GROUP BY a.race, a.candidate) x) y) z""", "all_valid", extra={
    "refoffice": ("""SELECT office FROM all_valid WHERE office IS NOT NULL GROUP BY office
      HAVING count(*) FILTER (party = 'democrat') > 0 AND count(*) FILTER (party = 'republican') > 0
      ORDER BY count(*) DESC, office LIMIT 1""",
                  ["all_valid"]),
    "side": ("""SELECT state, county_name, cvr_id,
        max(CASE WHEN party = 'democrat' THEN 1 WHEN party = 'republican' THEN 2 END) AS side
      FROM all_valid WHERE office IN (SELECT office FROM refoffice)
      GROUP BY state, county_name, cvr_id
      HAVING max(CASE WHEN party = 'democrat' THEN 1 WHEN party = 'republican' THEN 2 END) IS NOT NULL""",
             ["all_valid", "refoffice"])}))
def party_delta(spark, d):
    return round_doubles(V.party_delta(I.all_valid(spark, d)))


def _contests_spark(spark, d):
    """Contest dictionary stand-in: distinct contests of the records, NULL
    districts recorded as the STATEWIDE placeholder, some as COUNTY_NAME."""
    c = I.cvr(spark, d).where(F.col("office").isNotNull())
    district = (F.when(F.col("district").isNull(), F.lit("STATEWIDE"))
                 .when(F.col("district") == "MEDIUM", F.lit("COUNTY_NAME"))
                 .otherwise(F.col("district")))
    # large offices are written with a character that the dictionary drops
    contest = F.concat(V.race_key(), F.when(F.col("office") == "large", F.lit("\u00e9")).otherwise(F.lit("")))
    return c.select("state", "county_name", contest.alias("contest"),
                    F.col("office"), district.alias("district")).distinct()


_CONTESTS_SQL = f"""
SELECT DISTINCT state, county_name, concat({I.RACE_SQL}, CASE WHEN office = 'large' THEN chr(233) ELSE '' END) AS contest, office,
  CASE WHEN district IS NULL THEN 'STATEWIDE' WHEN district = 'MEDIUM' THEN 'COUNTY_NAME' ELSE district END AS district
FROM cvr WHERE office IS NOT NULL"""
PAD_STANDIN = ("SMALL", "LARGE")
_DICT_SQL = f"""
SELECT state, county_name, regexp_replace(contest, '[^\\x00-\\x7F]', '', 'g') AS contest, office,
  CASE WHEN strpos(d1, 'STATEWIDE') > 0
       THEN concat(substr(d1, 1, strpos(d1, 'STATEWIDE') - 1), state, substr(d1, strpos(d1, 'STATEWIDE') + 9))
       ELSE d1 END AS district
FROM (SELECT *, CASE WHEN strpos(d0, 'COUNTY_NAME') > 0
       THEN concat(substr(d0, 1, strpos(d0, 'COUNTY_NAME') - 1), county_name, substr(d0, strpos(d0, 'COUNTY_NAME') + 11))
       ELSE d0 END AS d1
  FROM (SELECT upper(state) AS state, upper(county_name) AS county_name, contest, upper(office) AS office,
          CASE WHEN upper(office) IN ({", ".join(f"'{o}'" for o in PAD_STANDIN)}) AND length(upper(district)) < 3
               THEN lpad(upper(district), 3, '0') ELSE upper(district) END AS d0
        FROM contests WHERE contest IS NOT NULL) a) b"""


@q("contest_dictionary", with_ctes("SELECT * FROM dict", "cvr", extra={
    "contests": (_CONTESTS_SQL, ["cvr"]), "dict": (_DICT_SQL, ["contests"])}))
def contest_dictionary(spark, d):
    return V.contest_dictionary(_contests_spark(spark, d), PAD_STANDIN)


@q("contests_per_county", with_ctes("""
SELECT round(avg(n), 4) AS mean_contests, count(*) AS n_counties FROM (
  SELECT state, county_name, count(*) AS n FROM (SELECT DISTINCT state, county_name, office, district FROM dict) x
  GROUP BY state, county_name) y""", "cvr", extra={
    "contests": (_CONTESTS_SQL, ["cvr"]), "dict": (_DICT_SQL, ["contests"])}))
def contests_per_county(spark, d):
    return round_doubles(V.contests_per_county(V.contest_dictionary(_contests_spark(spark, d), PAD_STANDIN)))


# The five regions of the stand-in area profile, in column order.
AREAS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
AREA_STRIP = "Percent|!!|Selected Age Categories|One Race"


def _area_wide(spark, d):
    cu = I.fx.table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    na = F.broadcast(I.fx.table(spark, d, "nation").select("n_nationkey", "n_regionkey"))
    rg = F.broadcast(I.fx.table(spark, d, "region").select("r_regionkey", "r_name"))
    j = cu.join(na, F.col("c_nationkey") == F.col("n_nationkey")).join(rg, F.col("n_regionkey") == F.col("r_regionkey"))
    aggs = [(F.avg(F.when(F.col("c_mktsegment") == s, 100.0).otherwise(0.0))).alias(f"Percent!!SEGMENT!!{s}")
            for s in SEGMENTS]
    aggs.append(F.avg(F.when(F.col("c_acctbal") < 0, 100.0).otherwise(0.0)).alias("Percent!!BALANCE!!Negative"))
    return j.groupBy(F.col("r_name").alias("Geographic Area Name")).agg(*aggs)


_AREA_LONG_SQL = " UNION ALL ".join(
    [f"SELECT r_name AS area, 'Percent!!SEGMENT!!{s}' AS name, "
     f"avg(CASE WHEN c_mktsegment = '{s}' THEN 100.0 ELSE 0.0 END) AS value "
     f"FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
     f"GROUP BY r_name" for s in SEGMENTS]
    + ["SELECT r_name AS area, 'Percent!!BALANCE!!Negative' AS name, "
       "avg(CASE WHEN c_acctbal < 0 THEN 100.0 ELSE 0.0 END) AS value "
       "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
       "GROUP BY r_name"])
_AREA_COLS = ", ".join(f"round(CAST(max(CASE WHEN area = '{a}' THEN value END) AS DOUBLE), 4) AS \"{a}\""
                       for a in AREAS)


@q("area_profile", f"""
SELECT regexp_replace(name, '{AREA_STRIP}', '', 'g') AS name, {_AREA_COLS}
FROM ({_AREA_LONG_SQL}) long GROUP BY name""")
def area_profile(spark, d):
    return round_doubles(V.area_profile(_area_wide(spark, d), "Geographic Area Name", AREAS, AREA_STRIP,
                                        first_area="AMERICA"))


@q("sample_report", with_ctes("""
SELECT count(DISTINCT voter_id) AS n_voters, count(DISTINCT race_id) AS n_contests,
  count(DISTINCT (race_id, candidate_id)) AS n_cands, count(*) AS n_votes FROM votes""", "votes"))
def sample_report(spark, d):
    return V.sample_report(I.encoded(spark, d)[0])


_ALL_CHOICES = f"""SELECT *, {I.RACE_SQL} AS race FROM cvr WHERE office IS NOT NULL"""


@q("all_choice_ids", with_ctes("""
SELECT race, candidate, CAST(row_number() OVER (PARTITION BY race ORDER BY n DESC, candidate) AS BIGINT) AS candidate_id,
  CAST(dense_rank() OVER (ORDER BY race) AS BIGINT) AS race_id
FROM (SELECT race, candidate, count(*) AS n FROM allc WHERE candidate <> 'UNDERVOTE' GROUP BY race, candidate) c""", "cvr",
    extra={"allc": (_ALL_CHOICES, ["cvr"])}))
def all_choice_ids(spark, d):
    rows = I.cvr(spark, d).where(F.col("office").isNotNull()).withColumn("race", V.race_key())
    return E.all_choice_ids(rows)


@q("vote_sequence", with_ctes("""
SELECT state, county_name, cvr_id, race, candidate,
  CAST(row_number() OVER (PARTITION BY state, county_name, cvr_id ORDER BY race, candidate) AS BIGINT) AS seq FROM all_valid""", "all_valid"))
def vote_sequence(spark, d):
    return E.vote_sequence(I.all_valid(spark, d).select("state", "county_name", "cvr_id", "race", "candidate"))


@q("candidate_numbers", with_ctes("""
SELECT DISTINCT candidate, CAST(regexp_extract(candidate, '[0-9]+') AS BIGINT) AS number FROM all_valid""", "all_valid"))
def candidate_numbers(spark, d):
    return I.all_valid(spark, d).select("candidate", tx.extract_int("candidate").alias("number")).distinct()


@q("group_size_filter", with_ctes("""
SELECT a.state, a.county_name, a.cvr_id, a.race, a.candidate FROM all_valid a
WHERE (a.race, a.candidate) IN (SELECT (race, candidate) FROM all_valid GROUP BY race, candidate HAVING count(*) > 100)""",
    "all_valid"))
def group_size_filter(spark, d):
    rows = I.all_valid(spark, d).select("state", "county_name", "cvr_id", "race", "candidate")
    return R.group_size_filter(rows, ["race", "candidate"], ">", 100)


@q("sample_global", with_ctes(f"""
SELECT state, county_name, cvr_id FROM voter_ids
ORDER BY md5(concat_ws('|', '{fx.SAMPLE_SEED}', state, county_name, cvr_id)), state, county_name, cvr_id LIMIT 24""",
    "voter_ids"))
def sample_global(spark, d):
    voters = I.all_valid(spark, d).select(*V.VOTER_KEY).distinct()
    return S.sample_global(voters, V.VOTER_KEY, 24, fx.SAMPLE_SEED)


@q("sample_with_forced", with_ctes(f"""
SELECT DISTINCT * FROM (
  (SELECT state, county_name, cvr_id FROM voter_ids
   ORDER BY md5(concat_ws('|', '{fx.SAMPLE_SEED}', state, county_name, cvr_id)), state, county_name, cvr_id LIMIT 24)
  UNION ALL
  (SELECT state, county_name, cvr_id FROM voter_ids ORDER BY voter_id LIMIT 2)) x""", "voter_ids"))
def sample_with_forced(spark, d):
    voters = I.all_valid(spark, d).select(*V.VOTER_KEY).distinct()
    forced = E.voter_ids(I.all_valid(spark, d)).where(F.col("voter_id") <= 2).select(*V.VOTER_KEY)
    return S.sample_with_forced(voters, V.VOTER_KEY, 24, fx.SAMPLE_SEED, forced)

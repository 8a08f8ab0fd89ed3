"""Standard derived inputs of the registered queries, in Spark and in DuckDB SQL.

Spark side: functions of (spark, sf_dir) built from the stand-in views.
SQL side: named CTE fragments; ``with_ctes`` puts the needed ones (and what
they depend on) in front of a final SELECT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import encode as E
from ..operators import votes as V
from ..session import cut_lineage
from ..sources import fixtures as fx


def round_doubles(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round every double column (the oracle rounds the same columns);
    ``special`` gives other digit counts per column."""
    return df.select([F.round(F.col(f.name), special.get(f.name, digits)).alias(f.name)
                      if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                      for f in df.schema.fields])


def cvr(spark: SparkSession, d: str) -> DataFrame:
    return fx.cvr(spark, d)


def base(spark: SparkSession, d: str) -> DataFrame:
    """Valid votes of the sampled state in released counties."""
    return V.valid_votes(cvr(spark, d), fx.compare(spark, d), fx.SAMPLE_STATE)


def all_valid(spark: SparkSession, d: str) -> DataFrame:
    """Valid votes of every state, no registry (the model tables' input)."""
    return V.valid_votes(cvr(spark, d))


def sample(spark: SparkSession, d: str, n: int = fx.SAMPLE_N, partisan_only: bool = False,
           min_votes: int = fx.SAMPLE_MIN_VOTES) -> DataFrame:
    return V.get_votes(cvr(spark, d), fx.compare(spark, d), fx.SAMPLE_STATE, fx.SAMPLE_PROP, n,
                       min_votes, fx.SAMPLE_SEED, partisan_only=partisan_only)


def choices_and_ids(spark: SparkSession, d: str):
    """(choices, ids, voters): valid votes with voter and candidate ids, encoded once and
    written, so that everything built on them reads the same table."""
    data = cut_lineage(all_valid(spark, d))
    ids = cut_lineage(E.candidate_ids(data, "democrat"))
    voters = E.voter_ids(data)
    rows = (data.join(voters, V.VOTER_KEY).join(ids, ["race", "candidate"])
                .select("voter_id", "state", "county_name", "cvr_id", "race", "office", "district",
                        "candidate", "party", "race_id", "candidate_id"))
    return cut_lineage(rows), ids, voters


def encoded(spark: SparkSession, d: str):
    """(votes, ids, voters, choices) for all valid votes."""
    rows, ids, voters = choices_and_ids(spark, d)
    return rows.select("voter_id", "race_id", "candidate_id"), ids, voters, rows


def choices(spark: SparkSession, d: str) -> DataFrame:
    """Valid votes with voter ids and candidate ids attached."""
    return choices_and_ids(spark, d)[0]


# ----------------------------------------------------------------- SQL side

RACE_SQL = "concat(coalesce(office, 'NA'), '_', coalesce(district, 'NA'))"
VALID_WHERE = ("magnitude = 1 AND office IS NOT NULL "
               "AND NOT regexp_matches(candidate, 'undervote|overvote|writein', 'i')")

SQL_FRAGMENTS: dict[str, tuple[str, list[str]]] = {}


def _frag(name: str, sql: str, deps=()):
    SQL_FRAGMENTS[name] = (sql, list(deps))


_frag("cvr", fx.CVR_SQL)
_frag("compare", fx.COMPARE_SQL)
_frag("draws", fx.DRAWS_SQL)
_frag("ext_raw", fx.EXT_SQL)
_frag("base", f"""
SELECT state, precinct, cvr_id, county_name, candidate, district, office, party, {RACE_SQL} AS race
FROM cvr WHERE state = '{fx.SAMPLE_STATE}' AND {VALID_WHERE}
  AND EXISTS (SELECT 1 FROM compare c WHERE c.state = cvr.state AND c.county_name = cvr.county_name)""",
      ["cvr", "compare"])
_frag("all_valid", f"""
SELECT state, precinct, cvr_id, county_name, candidate, district, office, party, {RACE_SQL} AS race
FROM cvr WHERE {VALID_WHERE}""", ["cvr"])
_frag("prec", f"""
SELECT state, county_name, precinct FROM (
  SELECT state, county_name, precinct,
    row_number() OVER (PARTITION BY state, county_name
                       ORDER BY md5(concat_ws('|', '{fx.SAMPLE_SEED}', state, county_name, precinct)), precinct) AS rn,
    count(*) OVER (PARTITION BY state, county_name) AS n
  FROM (SELECT DISTINCT state, county_name, precinct FROM base) p) q
WHERE rn <= floor(n * CAST({fx.SAMPLE_PROP} AS DOUBLE))""", ["base"])


def _voters_sql(n: int) -> str:
    return f"""
SELECT DISTINCT state, county_name, cvr_id FROM (
  SELECT state, county_name, precinct, cvr_id,
    row_number() OVER (PARTITION BY state, county_name, precinct
                       ORDER BY md5(concat_ws('|', '{fx.SAMPLE_SEED}', cvr_id)), cvr_id) AS rn
  FROM (SELECT DISTINCT b.state, b.county_name, b.precinct, b.cvr_id
        FROM base b JOIN prec p ON b.state = p.state AND b.county_name = p.county_name
                                AND b.precinct = p.precinct) v) q
WHERE rn <= {n}"""


_frag("svoters", _voters_sql(fx.SAMPLE_N), ["base", "prec"])
_frag("svoters_tight", _voters_sql(fx.SAMPLE_N_TIGHT), ["base", "prec"])
_frag("sampled", """
SELECT b.* FROM base b JOIN svoters v ON b.state = v.state AND b.county_name = v.county_name
  AND b.cvr_id = v.cvr_id""", ["base", "svoters"])
_frag("small", f"""
SELECT race, candidate FROM sampled GROUP BY race, candidate HAVING count(*) <= {fx.SAMPLE_MIN_VOTES}""",
      ["sampled"])
_frag("contested", """
SELECT race FROM (SELECT DISTINCT race, candidate FROM base) c
WHERE NOT EXISTS (SELECT 1 FROM small s WHERE s.race = c.race AND s.candidate = c.candidate)
GROUP BY race HAVING count(*) > 1""", ["base", "small"])
_frag("partisan", """
SELECT DISTINCT race FROM (SELECT DISTINCT race, party FROM base) p
WHERE NOT regexp_matches(party, 'nonpartisan', 'i')""", ["base"])
_frag("get_votes", """
SELECT s.* FROM sampled s JOIN contested c ON s.race = c.race""", ["sampled", "contested"])
# candidate ids, Democrat first (propositions carry no party)
_frag("cand_ids", """
SELECT race, candidate,
  CAST(row_number() OVER (PARTITION BY race ORDER BY prank, candidate) AS BIGINT) AS candidate_id,
  CAST(dense_rank() OVER (ORDER BY race) AS BIGINT) AS race_id
FROM (SELECT race, candidate,
        min(CASE WHEN party2 = 'democrat' THEN 0 WHEN party2 IS NULL THEN 2 ELSE 1 END) AS prank
      FROM (SELECT DISTINCT race, candidate,
              CASE WHEN regexp_matches(race, '^prop_|_prop_') THEN NULL ELSE party END AS party2
            FROM all_valid) x
      GROUP BY race, candidate) y""", ["all_valid"])
_frag("voter_ids", """
SELECT state, county_name, cvr_id,
  CAST(row_number() OVER (ORDER BY state, county_name, cvr_id) AS BIGINT) AS voter_id
FROM (SELECT DISTINCT state, county_name, cvr_id FROM all_valid) v""", ["all_valid"])
_frag("choices", """
SELECT v.voter_id, a.state, a.county_name, a.cvr_id, a.race, a.office, a.district, a.candidate, a.party,
       i.race_id, i.candidate_id
FROM all_valid a JOIN voter_ids v ON a.state = v.state AND a.county_name = v.county_name AND a.cvr_id = v.cvr_id
JOIN cand_ids i ON a.race = i.race AND a.candidate = i.candidate""", ["all_valid", "voter_ids", "cand_ids"])
_frag("votes", "SELECT voter_id, race_id, candidate_id FROM choices", ["choices"])
_frag("params", """
SELECT race_id, candidate_id,
  CASE WHEN candidate_id = 1 THEN 0.0 ELSE CAST((race_id * 7 + candidate_id * 13) % 21 - 10 AS DOUBLE) / 10 END AS disc,
  CASE WHEN candidate_id = 1 THEN 0.0 ELSE CAST((race_id * 5 + candidate_id * 11) % 17 - 8 AS DOUBLE) / 8 END AS diff
FROM cand_ids""", ["cand_ids"])
_frag("alpha", """
SELECT voter_id, CAST((voter_id * 37) % 201 - 100 AS DOUBLE) / 50 AS alpha FROM voter_ids""", ["voter_ids"])
_frag("ext", """
SELECT office, district, candidate, cfscore, cycle FROM ext_raw""", ["ext_raw"])


def with_ctes(final_sql: str, *names: str, extra: dict | None = None) -> str:
    """``WITH`` clause holding ``names`` and their dependencies (in dependency
    order), then ``final_sql``.  ``extra`` adds query-specific fragments
    ``name -> (sql, deps)``."""
    frags = dict(SQL_FRAGMENTS)
    if extra:
        frags.update(extra)
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in frags[n][1]:
            visit(dep)
        order.append(n)

    for n in list(names) + list(extra or {}):
        visit(n)
    body = ",\n".join(f"{n} AS ({frags[n][0].strip()})" for n in order)
    return f"WITH {body}\n{final_sql.strip()}"

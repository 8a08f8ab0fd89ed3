"""Stand-in views over the driver's TPC-H-style tables.

The engine's real inputs (cast vote records, registry, draws, external scores)
are not shipped with the test data, so the views below derive them from the
driver tables.  Every view is a Spark job over the whole table; the DuckDB text
of the same views is kept here too so that oracle SQL can inline them as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the sampling stand-in (see FIXTURES.md).
SAMPLE_STATE = "AMERICA"
SAMPLE_PROP = 0.4
SAMPLE_N = 500
SAMPLE_N_TIGHT = 8
SAMPLE_MIN_VOTES = 10
SAMPLE_SEED = 2139
CAPPED_MIN_VOTES = 1
DRAWS_PER_CHAIN = 125
#: Largest table that a join of the stand-in views copies to every executor, and the bytes
#: one of its rows takes there.
SIDE_BYTES, SIDE_ROW = 16 << 20, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def side(df: DataFrame) -> DataFrame:
    """``df``, a table of the input, as one side of a join: broadcast when its rows are counted
    to fit SIDE_BYTES, else joined by sort and merge.  The size of its file says little: a
    compressed table below Spark's threshold takes many times as much in the driver."""
    return F.broadcast(df) if df.count() * SIDE_ROW <= SIDE_BYTES else df.hint("merge")


def _brand_mod(col="p_brand"):
    return F.substring(F.col(col), 7, 100).cast("int") % 7


def cvr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cast vote records derived from lineitem x orders x part (x customer x nation x region).

    One choice per (voter, contest) is kept: the lineitem with the smallest
    (orderkey, linenumber, partkey, quantity, extendedprice).  This is written as a
    grouped ``min(struct)`` so it is a partial + final aggregate (map-side combine,
    no per-key window), which stays balanced when one key is hot.  The customer,
    nation and region attributes depend only on the customer key, which is part
    of the grouping key, so they are joined after the aggregate, on one row per
    (voter, contest) instead of one per lineitem."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation (25 rows) and region (5 rows) have a fixed size: safe to broadcast.
    na = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    rg = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))

    j = (li.join(side(od), F.col("l_orderkey") == F.col("o_orderkey"))
           .join(side(pa), F.col("l_partkey") == F.col("p_partkey")))
    # the brand follows the part key, so ties on the five ordering fields share it
    picked = (j.groupBy(F.col("o_custkey").alias("c_custkey"), "p_type",
                        (F.col("p_size") == 50).alias("_nulloffice"), "o_orderpriority")
               .agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                   "l_extendedprice", "p_brand")).alias("r")))
    g = (picked.join(side(cu), "c_custkey")
               .join(na, F.col("c_nationkey") == F.col("n_nationkey"))
               .join(rg, F.col("n_regionkey") == F.col("r_regionkey")))

    bm = _brand_mod("r.p_brand")
    qty = F.col("r.l_quantity")
    office = (F.when(F.col("_nulloffice"), F.lit(None).cast("string"))
               .when(F.col("p_type") == "PROMO", F.lit("prop_promo"))
               .otherwise(F.lower("p_type")))
    district = (F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
                 .otherwise(F.substring("o_orderpriority", 3, 100)))
    candidate = (F.when(qty == 50, F.lit("UNDERVOTE"))
                  .when(qty == 49, F.lit("Overvote"))
                  .when(qty == 48, F.lit("WriteIn 1"))
                  .otherwise(F.concat(F.lit("cand_"), bm.cast("string"))))
    # the medium offices are nonpartisan contests
    party = (F.when(F.col("p_type") == "MEDIUM", F.lit("nonpartisan"))
              .when(F.col("r.p_brand") == "Brand#7", F.lit("green"))
              .when(bm == 0, F.lit("democrat"))
              .when(bm == 1, F.lit("republican"))
              .when(bm == 2, F.lit("libertarian"))
              .when(bm.isin(3, 4), F.lit("nonpartisan"))
              .otherwise(F.lit(None).cast("string")))
    magnitude = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(2)).otherwise(F.lit(1))
    return g.select(
        F.col("r_name").alias("state"), F.col("n_name").alias("county_name"),
        F.col("c_mktsegment").alias("precinct"), F.col("c_custkey").cast("string").alias("cvr_id"),
        office.alias("office"), district.alias("district"), candidate.alias("candidate"),
        party.alias("party"), magnitude.cast(T.ByteType()).alias("magnitude"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of all counties with their release state (0 or 1)."""
    na = table(spark, sf_dir, "nation")
    rg = table(spark, sf_dir, "region")
    return (na.join(rg, F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("r_name").alias("state"), F.col("n_name").alias("county_name"),
                      (F.col("n_nationkey") % 7 != 0).cast("int").alias("release")))


def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released counties, by the registry operator."""
    from .io import released_counties
    return released_counties(registry(spark, sf_dir))


def draws(spark: SparkSession, sf_dir: str, per_chain: int = DRAWS_PER_CHAIN) -> DataFrame:
    """Posterior draws in long form from ``embeddings``: vec_id is the draw, positions
    0-31 are alpha[1..32], 32-47 gamma[1..16], 48-63 beta[1..16]."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ex = emb.select("vec_id", F.posexplode("embedding").alias("p", "v"))
    p = F.col("p")
    return ex.select(
        F.expr(f"vec_id div {per_chain}").cast("long").alias("chain"),
        (F.col("vec_id") % per_chain).cast("long").alias("iteration"),
        F.col("vec_id").cast("long").alias("draw"),
        F.when(p < 32, "alpha").when(p < 48, "gamma").otherwise("beta").alias("variable"),
        F.when(p < 32, p + 1).when(p < 48, p - 31).otherwise(p - 47).cast("long").alias("idx"),
        F.col("v").cast("double").alias("value"))


#: Sampler settings of the model-draws stand-in.
MODEL_CHAINS, MODEL_PER_CHAIN = 4, 10


def model_draws(voters: DataFrame, flat: DataFrame, flipped: bool = False) -> DataFrame:
    """Posterior draws of every voter (``voters``: voter_id) and every candidate (``flat``:
    param_idx, candidate_id), as formulas of the ids and the 1-based draw number: alpha per
    voter, disc and diff per candidate, disc of reference candidates 0.  ``flipped`` turns
    alpha and disc around in the draws divisible by three, as an unaligned sampler does."""
    m = F.col("draw")
    draws = F.explode(F.sequence(F.lit(1), F.lit(MODEL_CHAINS * MODEL_PER_CHAIN))).alias("draw")
    j, i = F.col("voter_id"), F.col("param_idx")
    flip = F.when((m % 3 == 0) & F.lit(flipped), F.lit(-1.0)).otherwise(F.lit(1.0))
    a = voters.select("voter_id", draws).select("draw", F.lit("alpha").alias("variable"), j.cast("long").alias("idx"), (
        flip * (((j * 37) % 201 - 100) / 50.3 + ((j * 13 + m * 29) % 41 - 20) / 41.7)).alias("value"))
    disc = F.when(F.col("candidate_id") == 1, F.lit(0.0)).otherwise(
        flip * (((i * 7) % 21 - 10) / 10.3 + ((i * 17 + m * 23) % 31 - 15) / 61.3))
    diff = ((i * 11) % 17 - 8) / 8.7 + ((i * 19 + m * 31) % 37 - 18) / 53.9
    both = F.explode(F.array(F.struct(F.lit("disc").alias("variable"), disc.alias("value")),
                             F.struct(F.lit("diff").alias("variable"), diff.alias("value")))).alias("x")
    c = flat.select("param_idx", "candidate_id", draws).select("draw", i.cast("long").alias("idx"), both) \
            .select("draw", "x.variable", "idx", "x.value")
    return a.unionByName(c).select(
        (F.floor((m - 1) / MODEL_PER_CHAIN) + 1).cast("long").alias("chain"),
        ((m - 1) % MODEL_PER_CHAIN + 1).cast("long").alias("iteration"), m.cast("long").alias("draw"), "variable", "idx", "value")


def wide_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws as a sampler writes them, one column per parameter: scalars, one and two
    indices, 1-based numbers; from the first entries of ``embeddings``."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    names = ("lp__", "sigma_disc", "alpha[1]", "alpha[2]", "disc[1,1]", "disc[1,2]", "disc[2,1]")
    return e.select(
        (F.floor(F.col("vec_id") / DRAWS_PER_CHAIN) + 1).alias(".chain"), (F.col("vec_id") % DRAWS_PER_CHAIN + 1).alias(".iteration"),
        (F.col("vec_id") + 1).alias(".draw"), *[F.get("embedding", F.lit(k)).alias(n) for k, n in enumerate(names)])


#: Stand-in for the seat recode: codes and the offices of the stand-in contests.
STANDIN_SEATS = {"federal:house": "economy", "federal:senate": "large", "state:upper": "medium", "state:lower": "small",
                 "state:education": "standard"}


def external_seat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External candidate scores as published: seat codes, election results, states and
    unpadded districts; from ``supplier``."""
    k = F.col("s_suppkey")
    codes = F.array(*[F.lit(x) for x in (*STANDIN_SEATS, "local:council")])
    districts = F.array(*[F.lit(x) for x in ("HIGH", "URGENT", "MEDIUM")])
    return table(spark, sf_dir, "supplier").select(
        F.get(codes, (k % 6).cast("int")).alias("seat"), F.get(districts, (F.floor(k / 6) % 3).cast("int")).alias("district"),
        F.concat(F.lit("cand_"), (k % 7).cast("string")).alias("candidate"), (F.col("s_acctbal") / 1000.0).alias("cfscore"),
        F.when(k % 5 == 0, 2018).otherwise(2020).alias("cycle"), F.when(k % 4 == 1, "L").when(k % 11 != 3, "W").alias("pwinner"),
        F.when(k % 9 == 2, "XX").otherwise("CO").alias("state"))


def external_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External candidate scores (all cycles) from ``supplier``."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    k = F.col("s_suppkey")
    office = (F.when(k % 6 == 0, "economy").when(k % 6 == 1, "large").when(k % 6 == 2, "medium")
               .when(k % 6 == 3, "prop_promo").when(k % 6 == 4, "small").otherwise("standard"))
    dmod = F.floor(k / 6).cast("int") % 3
    district = F.when(dmod == 0, "HIGH").when(dmod == 1, "URGENT").otherwise("MEDIUM")
    return s.select(
        office.alias("office"), district.alias("district"),
        F.concat(F.lit("cand_"), (k % 7).cast("string")).alias("candidate"),
        (F.col("s_acctbal") / 1000.0).alias("cfscore"),
        F.when(k % 5 == 0, 2018).otherwise(2020).alias("cycle"))


# ---------------------------------------------------------------------------
# DuckDB text of the same views, inlined by the oracle SQL as CTEs.
# ---------------------------------------------------------------------------

CVR_SQL = """
SELECT state, county_name, precinct, cvr_id, office, district, candidate, party, magnitude FROM (
 SELECT r_name AS state, n_name AS county_name, c_mktsegment AS precinct,
  CAST(c_custkey AS VARCHAR) AS cvr_id,
  CASE WHEN p_size = 50 THEN NULL WHEN p_type = 'PROMO' THEN 'prop_promo' ELSE lower(p_type) END AS office,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE substr(o_orderpriority, 3) END AS district,
  CASE WHEN l_quantity = 50 THEN 'UNDERVOTE' WHEN l_quantity = 49 THEN 'Overvote'
       WHEN l_quantity = 48 THEN 'WriteIn 1'
       ELSE concat('cand_', CAST(CAST(substr(p_brand, 7) AS INT) % 7 AS VARCHAR)) END AS candidate,
  CASE WHEN p_type = 'MEDIUM' THEN 'nonpartisan' WHEN p_brand = 'Brand#7' THEN 'green'
       WHEN CAST(substr(p_brand, 7) AS INT) % 7 = 0 THEN 'democrat'
       WHEN CAST(substr(p_brand, 7) AS INT) % 7 = 1 THEN 'republican'
       WHEN CAST(substr(p_brand, 7) AS INT) % 7 = 2 THEN 'libertarian'
       WHEN CAST(substr(p_brand, 7) AS INT) % 7 IN (3, 4) THEN 'nonpartisan' ELSE NULL END AS party,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 2 ELSE 1 END AS magnitude,
  ROW_NUMBER() OVER (PARTITION BY c_custkey, p_type, p_size = 50, o_orderpriority
     ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey) raw WHERE rn = 1
"""

REGISTRY_SQL = """
SELECT r_name AS state, n_name AS county_name, CASE WHEN n_nationkey % 7 <> 0 THEN 1 ELSE 0 END AS release
FROM nation JOIN region ON n_regionkey = r_regionkey
"""

COMPARE_SQL = f"""
SELECT DISTINCT state, county_name FROM ({REGISTRY_SQL}) reg WHERE release = 1
"""

DRAWS_SQL = f"""
SELECT CAST(vec_id // {DRAWS_PER_CHAIN} AS BIGINT) AS chain,
       CAST(vec_id % {DRAWS_PER_CHAIN} AS BIGINT) AS iteration,
       CAST(vec_id AS BIGINT) AS draw,
       CASE WHEN p < 32 THEN 'alpha' WHEN p < 48 THEN 'gamma' ELSE 'beta' END AS variable,
       CAST(CASE WHEN p < 32 THEN p + 1 WHEN p < 48 THEN p - 31 ELSE p - 47 END AS BIGINT) AS idx,
       CAST(v AS DOUBLE) AS value
FROM (SELECT vec_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS v FROM embeddings) e
"""

MODEL_DRAWS_SQL = f"""
SELECT CAST((draw - 1) // {MODEL_PER_CHAIN} + 1 AS BIGINT) AS chain, CAST((draw - 1) % {MODEL_PER_CHAIN} + 1 AS BIGINT) AS iteration,
       draw, variable, idx, value FROM (
  SELECT m AS draw, 'alpha' AS variable, voter_id AS idx,
    CAST((voter_id * 37) % 201 - 100 AS DOUBLE) / 50.3 + CAST((voter_id * 13 + m * 29) % 41 - 20 AS DOUBLE) / 41.7 AS value
  FROM voter_ids, range(1, {MODEL_CHAINS * MODEL_PER_CHAIN + 1}) t(m)
  UNION ALL
  SELECT m, 'disc', param_idx, CASE WHEN candidate_id = 1 THEN 0.0 ELSE
    CAST((param_idx * 7) % 21 - 10 AS DOUBLE) / 10.3 + CAST((param_idx * 17 + m * 23) % 31 - 15 AS DOUBLE) / 61.3 END
  FROM flat, range(1, {MODEL_CHAINS * MODEL_PER_CHAIN + 1}) t(m)
  UNION ALL
  SELECT m, 'diff', param_idx,
    CAST((param_idx * 11) % 17 - 8 AS DOUBLE) / 8.7 + CAST((param_idx * 19 + m * 31) % 37 - 18 AS DOUBLE) / 53.9
  FROM flat, range(1, {MODEL_CHAINS * MODEL_PER_CHAIN + 1}) t(m)) x
"""

WIDE_LONG_SQL = f"""
SELECT CAST(vec_id // {DRAWS_PER_CHAIN} + 1 AS BIGINT) AS chain, CAST(vec_id % {DRAWS_PER_CHAIN} + 1 AS BIGINT) AS iteration,
       CAST(vec_id + 1 AS BIGINT) AS draw, n.variable, CAST(n.idx AS BIGINT) AS idx, CAST(n.idx2 AS BIGINT) AS idx2,
       CAST(embedding[n.pos] AS DOUBLE) AS value
FROM embeddings, (VALUES (1, 'lp__', NULL, NULL), (2, 'sigma_disc', NULL, NULL), (3, 'alpha', 1, NULL), (4, 'alpha', 2, NULL),
                         (5, 'disc', 1, 1), (6, 'disc', 1, 2), (7, 'disc', 2, 1)) n(pos, variable, idx, idx2)
"""

SEAT_ROWS_SQL = """
SELECT (['federal:house', 'federal:senate', 'state:upper', 'state:lower', 'state:education', 'local:council'])[s_suppkey % 6 + 1] AS seat,
  (['economy', 'large', 'medium', 'small', 'standard', NULL])[s_suppkey % 6 + 1] AS office,
  (['HIGH', 'URGENT', 'MEDIUM'])[CAST(floor(s_suppkey / 6) AS INT) % 3 + 1] AS district,
  concat('cand_', CAST(s_suppkey % 7 AS VARCHAR)) AS candidate, s_acctbal / 1000.0 AS cfscore,
  CASE WHEN s_suppkey % 5 = 0 THEN 2018 ELSE 2020 END AS cycle,
  CASE WHEN s_suppkey % 4 = 1 THEN 'L' WHEN s_suppkey % 11 <> 3 THEN 'W' END AS pwinner,
  CASE WHEN s_suppkey % 9 = 2 THEN 'XX' ELSE 'CO' END AS state
FROM supplier
"""

EXT_SQL = """
SELECT CASE s_suppkey % 6 WHEN 0 THEN 'economy' WHEN 1 THEN 'large' WHEN 2 THEN 'medium'
         WHEN 3 THEN 'prop_promo' WHEN 4 THEN 'small' ELSE 'standard' END AS office,
  CASE CAST(floor(s_suppkey / 6) AS INT) % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'URGENT' ELSE 'MEDIUM' END AS district,
  concat('cand_', CAST(s_suppkey % 7 AS VARCHAR)) AS candidate, s_acctbal / 1000.0 AS cfscore,
  CASE WHEN s_suppkey % 5 = 0 THEN 2018 ELSE 2020 END AS cycle
FROM supplier
"""

VIEW_SQL = {"cvr": CVR_SQL, "compare": COMPARE_SQL, "draws": DRAWS_SQL, "ext": EXT_SQL}

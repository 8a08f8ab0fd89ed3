"""DuckDB SQL for the queries that SQL can express, over the same tables."""

MIX = r"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS uid, doc_id, source, coalesce('s' || source, 'n') AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS pick, coalesce(doc_id::VARCHAR, '') AS did
  FROM documents),
sizes AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM base GROUP BY skey),
src AS (SELECT *, [1.0, 2.0, 3.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight FROM sizes),
fill(round, level) AS (
  SELECT 0, 0::DOUBLE
  UNION ALL
  SELECT round + 1, (SELECT ((SELECT sum(source_size) FROM src)
                             - coalesce(sum(3.0 * source_size) FILTER (weight * level > 3.0 * source_size), 0))
                            / nullif(sum(weight) FILTER (weight * level <= 3.0 * source_size), 0) FROM src)
  FROM fill WHERE round < (SELECT count(*) + 1 FROM src) AND level IS NOT NULL),
water AS (SELECT max(level) AS level FROM fill),
filled AS (SELECT skey, source_size, least(weight * level, 3.0 * source_size)::DOUBLE AS target FROM src, water),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM filled),
room0 AS (SELECT skey, floor(target - whole * source_size + 1e-6)::BIGINT AS room FROM epochs),
pass1 AS (SELECT uid, skey, size FROM (
  SELECT b.*, room, sum(size) OVER (PARTITION BY skey ORDER BY pick, did, size, uid) AS upto
  FROM base b JOIN room0 USING (skey) WHERE size > 0) WHERE upto <= room),
room1 AS (SELECT skey, any_value(room) - coalesce(sum(size), 0) AS room FROM room0 LEFT JOIN pass1 USING (skey) GROUP BY skey),
pass2 AS (SELECT uid, skey, size FROM (
  SELECT b.*, room, sum(size) OVER (PARTITION BY skey ORDER BY pick, did, size, uid) AS upto
  FROM base b JOIN room1 USING (skey) WHERE size > 0 AND size <= room AND uid NOT IN (SELECT uid FROM pass1)) WHERE upto <= room),
room2 AS (SELECT skey, any_value(room) - coalesce(sum(size), 0) AS room FROM room1 LEFT JOIN pass2 USING (skey) GROUP BY skey),
pass3 AS (SELECT uid, skey, size FROM (
  SELECT b.*, room, sum(size) OVER (PARTITION BY skey ORDER BY pick, did, size, uid) AS upto
  FROM base b JOIN room2 USING (skey) WHERE size > 0 AND size <= room AND uid NOT IN (SELECT uid FROM pass1)
    AND uid NOT IN (SELECT uid FROM pass2)) WHERE upto <= room),
extra AS (SELECT uid FROM pass1 UNION ALL SELECT uid FROM pass2 UNION ALL SELECT uid FROM pass3)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN extra.uid IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM base JOIN epochs USING (skey) LEFT JOIN extra USING (uid)
"""

DECONTAMINATE = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT uid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT uid, i, n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT uid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT uid, i, n FROM hit)) GROUP BY uid),
ids AS (SELECT uid, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM (SELECT DISTINCT uid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (uid) LEFT JOIN ids USING (uid)
"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT uid, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lkey FROM x),
common AS (SELECT lkey, max(doc_id) AS keeper FROM k WHERE length(lkey) >= 20 GROUP BY lkey
           HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'none')) >= 3),
m AS (SELECT k.*, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN common USING (lkey))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY uid
"""

SQL = {"op1_mix_sources": MIX, "op3_decontaminate": DECONTAMINATE, "op4_drop_common_lines": LINES}

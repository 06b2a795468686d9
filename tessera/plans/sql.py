"""Common table expressions of the DuckDB oracles: the star schema in the operators' roles."""

INTER = """inter AS (
  SELECT l_orderkey AS session_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS session_date,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS turn, l_partkey AS track_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

TRACKS = """tracks AS (
  SELECT p_partkey AS track_id, p_brand AS artist, p_brand || '::' || p_type AS album,
    list_distinct(list_append(string_split(p_name, ' '), lower(p_type))) AS tags, p_retailprice AS popularity,
    CASE WHEN p_size % 10 <> 0 THEN CAST(1950 + p_size AS BIGINT) END AS year, CAST(p_size * 10000 AS BIGINT) AS duration
  FROM part)"""

SESSIONS = """sessions AS (
  SELECT o_orderkey AS session_id, o_custkey AS user_id, substr(o_orderpriority, 1, 1) AS category, o_orderstatus AS specificity,
    CAST(c_nationkey AS BIGINT) AS country, c_mktsegment AS segment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

CONTEXT = """gt AS (
  SELECT session_id, max(turn) AS target_turn, max_by(track_id, turn) AS gt_track_id FROM inter GROUP BY 1 HAVING max(turn) >= 2),
ctx AS (SELECT i.* FROM inter i JOIN (SELECT session_id, max(turn) AS last FROM inter GROUP BY 1) m USING (session_id) WHERE turn < last)"""

LIFT = """p AS (SELECT category, tag, count(*) AS n FROM (SELECT session_id, unnest(tags) AS tag FROM inter JOIN tracks USING (track_id)) JOIN sessions USING (session_id) GROUP BY 1, 2),
lift AS (SELECT category, tag, least((n / sum(n) OVER (PARTITION BY category)) / (sum(n) OVER (PARTITION BY tag) / sum(n) OVER ()), 20) AS lift FROM p)"""


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body

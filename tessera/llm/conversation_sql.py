"""DuckDB SQL of the conversation repair: the cheapest edits phase by phase, one turn at a time.

A phase's state is one string, nine digits of its cost and its audit, so that least() takes the
cheaper and, among equals, the smaller audit.
"""

from __future__ import annotations

#: Phases: nothing yet, after an s, user due (may end), assistant due. Letter due in a phase and the phase after it.
_DUE = {0: ("u", 3), 1: ("u", 3), 2: ("u", 3), 3: ("a", 2)}


def _edit(state: str, cost: str, letter: str) -> str:
    return f"printf('%09d', CAST(substr({state}, 1, 9) AS BIGINT) + {cost}) || substr({state}, 10) || {letter}"


def _with_inserts(source: str) -> str:
    into = {p: [f"p{p}", *[_edit(f"p{q}", "3", "'I'") for q, (_, to) in _DUE.items() if to == p]] for p in range(4)}
    return f"SELECT * REPLACE ({', '.join(f'least({", ".join(x)}) AS p{p}' if len(x) > 1 else f'{x[0]} AS p{p}' for p, x in into.items())}) FROM {source}"


def _next() -> str:
    out = []
    for p in range(4):
        ways = [f"({_edit(f'p{p}', '4', chr(39) + 'D' + chr(39))})"]
        for q, (c, to) in _DUE.items():
            if to == p:
                cost, letter = f"CASE WHEN initial = '{c}' THEN 0 ELSE 3 END + broken", f"CASE WHEN initial = '{c}' THEN 'K' ELSE 'R' END"
                ways.append(f"CASE WHEN NOT must_go THEN {_edit(f'p{q}', cost, letter)} END")
        if p == 1:
            ways.append(f"CASE WHEN NOT must_go AND initial = 's' THEN {_edit('p0', 'broken', chr(39) + 'K' + chr(39))} END")
        out.append(f"least({', '.join(ways)}) AS p{p}" if len(ways) > 1 else f"{ways[0]} AS p{p}")
    return ", ".join(out)


CONVERSATION_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT) AS bytes
  FROM conversations),
faulty AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END)), 4294967295::BIGINT) % 20 AS fault
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faulty, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
numbered AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS initial,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS open,
    lag(left(role, 1)) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
turns AS (
  SELECT *, blank OR again AS must_go, CASE WHEN open AND NOT blank AND NOT again THEN 3 ELSE 0 END AS broken
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM numbered)),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (broken > 0) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY conv_id),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, n, '000000000' AS p0, NULL::VARCHAR AS p1, NULL::VARCHAR AS p2, NULL::VARCHAR AS p3 FROM counted
  UNION ALL
  SELECT conv_id, i, n, {_next()}
  FROM (SELECT s.* REPLACE (s.i + 1 AS i), t.initial, t.must_go, t.broken
    FROM ({_with_inserts("(" + _with_inserts("steps") + ")")}) AS s JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i + 1)),
audits AS (
  SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit
  FROM (SELECT conv_id, least(p0, p2) AS best FROM ({_with_inserts("(" + _with_inserts("steps") + ")")}) WHERE i = n)),
edits AS (SELECT conv_id, k, audit[k] AS edit, length(replace(audit[:k], 'I', '')) AS i, length(replace(audit[:k], 'D', '')) - 1 + length(replace(audit, 'D', '')) AS due
  FROM audits, unnest(range(1, length(audit) + 1)) AS u(k)),
lines AS (
  SELECT e.conv_id, e.k, CASE WHEN edit = 'K' THEN t.role WHEN due % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE t.text END AS line
  FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i WHERE edit <> 'D'),
hashed AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS h FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""

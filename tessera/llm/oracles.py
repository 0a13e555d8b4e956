"""SQL that gives the rows of op11 to op13 by plainer ways: all strings in a dictionary, a recursion over turns, lists of turns as keys."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII text: bit by bit, eight shifts after each byte."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384::BIGINT) ELSE acc >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT)"


#: Each string of 100 bytes by its digest; removed starts join to spans when they are 100 apart at most. Ids are unique in the tables.
OP11 = """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS k, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT k, p, md5(substr(x, 2 * p + 1, 200)) AS m FROM (SELECT k, x, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
later AS (SELECT k, p FROM (SELECT k, p, row_number() OVER (PARTITION BY m ORDER BY k, p) AS r FROM w) WHERE r > 1),
cut AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY k ORDER BY p) <= 100 THEN 0 ELSE 1 END AS begins FROM later),
runs AS (SELECT *, sum(begins) OVER (PARTITION BY k ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM cut),
spans AS (SELECT k, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY k, run),
kept AS (SELECT k, b AS f, lead(a) OVER (PARTITION BY k ORDER BY a) AS t FROM (SELECT k, a, b FROM spans UNION ALL SELECT k, -1, 0 FROM d)),
left_over AS (SELECT k, string_agg(substr(x, 2 * f + 1, 2 * (coalesce(t, n) - f)), '' ORDER BY f) AS y, sum(coalesce(t, n) - f) AS n_kept, count(*) - 1 AS n_spans FROM kept JOIN d USING (k) GROUP BY k)
SELECT doc_id, n AS n_bytes, (n - n_kept)::BIGINT AS n_removed, n_spans, sha256(unhex(y)) AS kept_sha256 FROM d JOIN left_over USING (k)"""

_TURNS = "row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)"

OP13 = f"""
WITH n AS (SELECT conv_id, role, text, {_TURNS} AS n FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY n) AS turns, ({crc32("CAST(conv_id AS VARCHAR)")} % 9)::INT AS h FROM n GROUP BY conv_id),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
prefixes AS (SELECT conv_id, d AS depth, turns[1:d] AS key, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY key, depth),
children AS (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN depth > 0 THEN strlen(n.key[depth].t) ELSE 0 END AS saved FROM nodes n LEFT JOIN children c USING (key)),
below AS (SELECT key[1:j] AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM whole) GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves, b.saved_tokens, w.ends_sha256
FROM whole w JOIN below b USING (key) LEFT JOIN nodes p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.key = w.key[1:w.depth - 1]"""


def _op12() -> str:
    """A recursion over a conversation's turns with the cheapest (cost, audit) of each state of the grammar."""

    def entry(cost: str, audit: str) -> str:
        return f"{{'c': {cost}, 'a': {audit}}}"

    far = entry("1000000000::BIGINT", "''")

    def moved(s: str, cost: str, letter: str, when: str = "") -> str:
        made = entry(f"({s}).c + {cost}", f"({s}).a || '{letter}'")
        return f"CASE WHEN {when} THEN {made} ELSE {far} END" if when else made

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def edits(to_initial: str, sources: str) -> list[str]:
        kept = [moved(f"s{k}", "late", "K", f"alive AND initial = '{to_initial}'") for k in sources]
        return kept + ([moved(f"s{k}", "2 + late", "R", "alive") for k in sources] if to_initial in "ua" else [])

    stepped = f"{moved('s0', '3', 'D')} AS n0, {least(moved('s1', '3', 'D'), *edits('s', '0'))} AS n1, {least(moved('s2', '3', 'D'), *edits('u', '013'))} AS n2, {least(moved('s3', '3', 'D'), *edits('a', '2'))} AS n3"
    two = least("n2", *(moved(f"n{k}", "2", "I") for k in "013"))
    code = crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")
    start = f"{entry('0::BIGINT', chr(39) * 2)} AS s0, {far} AS s1, {entry('2::BIGINT', repr('I'))} AS s2, {entry('4::BIGINT', repr('II'))} AS s3"
    blank = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {code} % 20 AS code FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(0, CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE code <> 0),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM damaged),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS pos, left(role, 1) AS initial,
  CASE WHEN NOT regexp_matches(text, '{blank}') THEN 1 WHEN seen > 1 THEN 2 WHEN regexp_extract(text, '({blank})[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM again),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (SELECT conv_id, 0::BIGINT AS pos, {start} FROM ids
  UNION ALL SELECT conv_id, pos, n0 AS s0, n1 AS s1, two AS s2, {least("n3", moved("two", "2", "I"))} AS s3 FROM (SELECT *, {two} AS two FROM (SELECT conv_id, next_pos AS pos, {stepped}
    FROM (SELECT w.*, t.pos AS next_pos, t.initial, t.fault NOT IN (1, 2) AS alive, (t.fault = 3)::INT AS late FROM walk w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1)))),
best AS (SELECT conv_id, {least("s0", "s3")} AS e FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS r FROM walk) WHERE r = 1),
letters AS (SELECT conv_id, e.a[i] AS x, len(translate(e.a[1:i], 'I', '')) AS pos, len(translate(e.a[1:i], 'D', '')) AS place, len(translate(e.a, 'D', '')) AS size FROM (SELECT *, unnest(range(1, len(e.a) + 1)) AS i FROM best)),
said AS (SELECT l.conv_id, place, CASE WHEN x = 'K' THEN t.role WHEN (place + size) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE t.text END AS line
  FROM letters l LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.pos = l.pos WHERE x <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS body FROM said GROUP BY conv_id),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM told),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  e.c AS cost, e.a AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id"""


OP12 = _op12()

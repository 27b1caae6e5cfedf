"""DuckDB SQL for those queries of the subpackage that SQL can express: plain all-pairs versions, for small tables."""

from __future__ import annotations

from tidewatch.llm.chat import CONTROLS, END, ROLES, TEXT, TURN

#: Everything that links reach, and the smallest of it; ``nodes`` (id) and ``links`` (a, b in both directions) come before.
REACHED = """
reach(id, other) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
),
comps AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

MINHASH = f"""
WITH RECURSIVE
split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
runs AS (
  SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS s
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
single AS (
  SELECT doc_id AS id, s FROM runs WHERE s IS NOT NULL
  UNION
  SELECT doc_id, array_to_string(w, ' ') FROM split WHERE len(w) BETWEEN 1 AND 4
),
nodes AS (SELECT doc_id AS id, count(s) AS n FROM split LEFT JOIN single ON doc_id = id GROUP BY doc_id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM single x JOIN single y ON x.s = y.s AND x.id <> y.id GROUP BY x.id, y.id),
links AS (
  SELECT a, b FROM shared h JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b
  WHERE 100 * h.n >= 85 * (x.n + y.n - h.n)
),
{REACHED}
SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM nodes JOIN comps USING (id)
"""

VECTORS = f"""
WITH RECURSIVE
nodes AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
sound AS (
  SELECT id, label, v FROM nodes
  WHERE label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.id AS a, y.id AS b FROM sound x JOIN sound y ON x.label = y.label AND len(x.v) = len(y.v) AND x.id <> y.id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98
),
degrees AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a),
{REACHED}
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
FROM nodes JOIN comps USING (id) LEFT JOIN degrees USING (id)
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def escaped_length(column: str) -> str:
    """The length of an escaped text: its code points, one for each backslash and each control string."""
    sql = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        sql = f"replace({sql}, {quoted(c)}, {quoted(c[0] + chr(92) + c[1:])})"
    return f"length({sql})"


def chats(control_turns: tuple) -> str:
    """The SQL of the chat query; ``control_turns``: the rows that the query adds."""
    extra = ", ".join(f"({c}, {t}, {quoted(r)}, {quoted(x)})" for c, t, r, x in control_turns)
    role = "CASE role " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in ROLES.items()) + " ELSE coalesce(role, '') END"
    order = "ORDER BY turn NULLS FIRST, raw, text"
    return f"""
WITH own AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {extra}) AS t(conv_id, turn, role, text)),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS raw, {role} AS role, coalesce(text, '') AS text FROM own)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(TURN) + len(TEXT) + len(END)} + {escaped_length("role")} + {escaped_length("text")})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

#: Vectors whose components are all finite numbers.
FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

PRODUCTS = f"""
WITH sound AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {FINITE}),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10
"""


def codes(rounds: int = 6, parts: int = 8, entries: int = 16, scale: int = 4096) -> str:
    """All rounds one after another, each with all distances of its vectors to its entries."""
    steps = [f"""
sound AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {FINITE}),
cells AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(v) // {parts}) AS part, (i - 1) % (len(v) // {parts}) AS pos, v[i] AS x
  FROM (SELECT vec_id, v, unnest(generate_series(1, len(v))) AS i FROM sound)
),
heads AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM sound ORDER BY vec_id LIMIT {entries}),
book0 AS MATERIALIZED (SELECT part, entry, pos, x AS e FROM cells JOIN heads USING (vec_id))"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, part, entry, far FROM (
    SELECT vec_id, part, entry, sum((x - e) * (x - e)) AS far, row_number() OVER (PARTITION BY vec_id, part ORDER BY sum((x - e) * (x - e)), entry) AS place
    FROM cells JOIN book{k} USING (part, pos) GROUP BY vec_id, part, entry
  ) WHERE place = 1
)""")
        if k < rounds:
            steps.append(f"""
sums{k} AS (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM cells JOIN near{k} USING (vec_id, part) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, CAST(CASE WHEN n IS NULL THEN e ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS e
  FROM book{k} LEFT JOIN sums{k} USING (part, entry, pos)
)""")
    return f"""
WITH {",".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(e AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN sound USING (vec_id)
"""

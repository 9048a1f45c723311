"""DuckDB SQL for the queries that SQL can express: every row against every row, without sketches or filters."""

from __future__ import annotations

from .codes import ENTRIES, PARTS, ROUNDS, SCALE
from .phrases import COVERED, LEAST, TOP
from .phrases import SCALE as SCORE_SCALE

_SOUND = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _round(i: int) -> str:
    return f"""near{i} AS (SELECT vec_id, part, arg_min(entry, struct_pack(d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM parts p JOIN book{i} b USING (part, pos) GROUP BY ALL) GROUP BY vec_id, part),
"""


def _book(i: int) -> str:
    return f"""book{i + 1} AS (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN (
  SELECT part, entry, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM parts JOIN near{i} USING (vec_id, part) GROUP BY ALL) m USING (part, entry, pos)),
"""


CODES_SQL = (
    f"""WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE {_SOUND}),
places AS (SELECT vec_id, unnest(range(len(embedding))) AS i, embedding, len(embedding) // {PARTS} AS width FROM kept),
parts AS (SELECT vec_id, i // width AS part, i % width AS pos, CAST(floor({SCALE} * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS x FROM places),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}),
book0 AS (SELECT part, entry, pos, x FROM parts JOIN first USING (vec_id)),
"""
    + "".join(_round(i) + _book(i) for i in range(ROUNDS))
    + _round(ROUNDS)
    + f"""coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
)

NEAR_COPIES_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN degree USING (vec_id)"""

PHRASES_SQL = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
spelled AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM spelled, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
sizes AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
counts AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
inner_ AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, f FROM (
  SELECT lang, w, f, k, m, unnest(range(1, k - m + 2)) AS i FROM counts, (SELECT unnest([2, 3]) AS m) WHERE k > m)),
around AS (SELECT lang, phrase, max(f) AS longer FROM inner_ GROUP BY lang, phrase),
kept AS (SELECT c.* FROM counts c LEFT JOIN around a USING (lang, phrase) WHERE k > 1 AND (longer IS NULL OR 100 * CAST(longer AS HUGEINT) < {COVERED} * CAST(f AS HUGEINT))),
cuts AS (SELECT lang, phrase, f, c, array_to_string(w[1:c], ' ') AS lhs, array_to_string(w[c + 1:], ' ') AS rhs FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (SELECT x.lang, x.phrase, x.f AS a, x.c, l.f AS l, r.f AS r, CAST({SCORE_SCALE} * CAST(x.f AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cuts x JOIN counts l ON l.lang = x.lang AND l.phrase = x.lhs JOIN counts r ON r.lang = x.lang AND r.phrase = x.rhs),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best QUALIFY rank <= {TOP})
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang)"""

"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from .decontam import UNITS
from .licenses import TEMPLATES

_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _substring(width: int) -> str:
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + {width - 1}], ' ') AS k FROM w, unnest(range(1, len(words) - {width - 2})) AS u(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, range({width}) AS t(j)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w)
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def _jaccard(n: int, percent: int) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS words FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + {n - 1}], ' ') AS s FROM w, unnest(range(1, greatest(len(words) - {n - 2}, 2))) AS u(i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= {percent} * (x.n + y.n - c.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN sizes s ON s.doc_id = r.a GROUP BY r.a"""


def _list(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def _licenses(containment: float) -> str:
    rows = ", ".join(f"({_list(x)})" for x in sorted(TEMPLATES.items()))
    words = lambda text: f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""WITH t AS (SELECT license, {words('body')} AS w FROM (VALUES {rows}) AS v(license, body)),
ours AS (SELECT DISTINCT license, array_to_string(w[i:i + 2], ' ') AS s FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
total AS (SELECT license, count(*) AS n FROM ours GROUP BY license),
d AS (SELECT doc_id, {words('text')} AS w FROM documents),
theirs AS (SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS s, min(i) - 1 AS i FROM d, unnest(range(1, len(w) - 1)) AS u(i) GROUP BY ALL)
SELECT doc_id, license, count(*) AS n_shingles, count(*) / any_value(total.n)::DOUBLE AS containment, min(i) AS first_word
FROM theirs JOIN ours USING (s) JOIN total USING (license) GROUP BY doc_id, license HAVING count(*) / any_value(total.n)::DOUBLE >= {containment}"""


def _leaks(width: int, literal: int, coverage: float, consistency: float, run_words: int, shortest: int) -> str:
    units = _list(sorted(set(UNITS)))
    number = lambda x: f"({x} >= '0' AND {x} < ':')"
    slot = "('<num>', '<unit>', '<name>')"
    solid = lambda x: f"len(list_filter({x}, lambda v: v NOT IN {slot}))"

    def side(table: str, key: str) -> str:
        return f"""{table}_words AS (SELECT {key} AS key, x, i, lag(x) OVER (PARTITION BY {key} ORDER BY i) AS ahead FROM (
  SELECT {key}, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT {key}, list_filter(regexp_split_to_array(
    regexp_replace(coalesce(text, ''), '([0-9])[.,]([0-9])', '\\1\\2', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}))),
{table}_folded AS (SELECT key, i, x, CASE WHEN {number('x')} THEN '<num>' WHEN ahead IS NOT NULL AND {number('ahead')} AND lower(x) IN ({units}) THEN '<unit>'
  ELSE lower(x) END AS f FROM {table}_words),
{table}_canon AS (SELECT key, i, x, f, CASE WHEN x = f OR f LIKE '<%' THEN f ELSE '<name>' END AS c FROM {table}_folded),
{table}_lists AS (SELECT key, list(c ORDER BY i) AS c, list(f ORDER BY i) AS f FROM {table}_canon GROUP BY key)"""

    return f"""WITH {side('documents', 'doc_id')}, {side('benchmark', 'item_id')},
item_windows AS (SELECT key, q, width, c[q:q + width - 1] AS c, f[q:q + width - 1] AS f FROM (SELECT *, least(len(c), {width}) AS width FROM benchmark_lists
  WHERE len(c) >= {shortest}), unnest(range(1, len(c) - width + 2)) AS u(q)),
enough AS (SELECT *, least({literal}, max({solid('c')}) OVER (PARTITION BY key)) AS c_least, least({literal}, max({solid('f')}) OVER (PARTITION BY key)) AS f_least
  FROM item_windows),
fit AS (SELECT *, {solid('c')} >= c_least AND c_least >= 2 AS c_fits, {solid('f')} >= f_least AND f_least >= 2 AS f_fits FROM enough),
totals AS (SELECT *, count(*) FILTER (WHERE c_fits) OVER (PARTITION BY key) AS typed, count(*) FILTER (WHERE f_fits) OVER (PARTITION BY key) AS plain FROM fit),
usable AS (SELECT key, q, width, CASE WHEN typed > 0 THEN typed ELSE plain END AS total, unnest([CASE WHEN c_fits THEN array_to_string(c, ' ') END,
  CASE WHEN f_fits THEN array_to_string(f, ' ') END]) AS k FROM totals WHERE c_fits OR typed = 0 AND f_fits),
widths AS (SELECT DISTINCT width AS n FROM usable),
doc_windows AS (SELECT key, p, array_to_string(c[p:p + n - 1], ' ') AS c, array_to_string(f[p:p + n - 1], ' ') AS f FROM documents_lists, widths,
  unnest(range(1, len(documents_lists.c) - n + 2)) AS u(p)),
doc_keys AS (SELECT DISTINCT key, p, unnest([c, f]) AS k FROM doc_windows),
hits AS (SELECT DISTINCT d.key AS doc_id, b.key AS item_id, d.p, b.q, width, total FROM doc_keys d JOIN usable b USING (k)),
counted AS (SELECT doc_id, item_id, count(DISTINCT q) AS n_windows, count(DISTINCT q) / any_value(total)::DOUBLE AS coverage FROM hits GROUP BY doc_id, item_id),
spots AS (SELECT DISTINCT doc_id, item_id, p - q AS shift, q FROM hits),
runs AS (SELECT doc_id, item_id, shift, min(q) AS first, count(*) AS n FROM (
  SELECT *, q - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY q) AS run FROM spots) GROUP BY doc_id, item_id, shift, run HAVING count(*) >= {run_words - width + 1}),
pairs AS (SELECT doc_id, item_id, '' AS part, NULL AS shift, NULL AS first, NULL AS n FROM counted WHERE coverage >= {coverage}
  UNION ALL SELECT doc_id, item_id, shift || ':' || (first - 1), shift, first, n FROM runs),
aligned AS (SELECT DISTINCT doc_id, item_id, '' AS part, p - q AS shift, q + j AS pos FROM hits SEMI JOIN (FROM pairs WHERE part = '') USING (doc_id, item_id), range({width}) AS t(j) WHERE j < width
  UNION ALL SELECT doc_id, item_id, part, shift, unnest(range(first, first + n + {width - 1})) FROM pairs WHERE part <> ''),
values_of AS (SELECT doc_id, item_id, part, shift, lower(b.x) AS ours, lower(d.x) AS theirs, count(*) AS n FROM aligned a
  JOIN benchmark_canon b ON b.key = item_id AND b.i = pos AND b.c IN {slot}
  JOIN documents_canon d ON d.key = doc_id AND d.i = pos + shift AND d.c IN {slot} GROUP BY ALL),
mapped AS (SELECT doc_id, item_id, part, shift, ours, max(n) AS most, sum(n) AS n, coalesce(sum(n) FILTER (WHERE ours <> theirs), 0) AS other FROM values_of GROUP BY ALL),
checked AS (SELECT doc_id, item_id, part, sum(most) / sum(n)::DOUBLE AS consistency, sum(other) / sum(n)::DOUBLE AS changed FROM mapped GROUP BY ALL),
told AS (SELECT doc_id, item_id, part, n, coalesce(consistency, 1.0::DOUBLE) AS consistency, coalesce(changed, 0.0::DOUBLE) AS changed FROM pairs LEFT JOIN checked USING (doc_id, item_id, part)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY part = '' DESC, n DESC, consistency DESC, part DESC) AS r FROM told WHERE consistency >= {consistency})
SELECT doc_id, item_id, n_windows, coverage, consistency, changed FROM best JOIN counted USING (doc_id, item_id) WHERE r = 1"""


def _bytes(length: int) -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT r, j, substring(h, {2 * length} * j + 1, {4 * length}) AS s FROM d, unnest(range(0, len(h) // {2 * length})) AS u(j)),
starts AS MATERIALIZED (SELECT r, {length} * j + o AS i, md5_number(substring(s, 2 * o + 1, {2 * length})) AS k FROM parts,
  range({length}) AS t(o) WHERE len(s) >= 2 * o + {2 * length}),
again AS (SELECT r, i FROM starts SEMI JOIN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1) USING (k)),
fresh AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {length} THEN 1 ELSE 0 END AS new FROM again),
spans AS (SELECT r, min(i) AS a, max(i) + {length} AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM fresh) GROUP BY r, span),
gaps AS (SELECT r, b AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS b FROM (SELECT r, a, b FROM spans UNION ALL SELECT r, -1, 0 FROM d)),
kept AS (SELECT r, string_agg(substring(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS body FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, len(h) // 2 - len(body) // 2 AS n_removed, (SELECT count(*) FROM spans s WHERE s.r = d.r) AS n_spans,
  sha256(unhex(body)) AS kept_sha256 FROM d JOIN kept USING (r)"""


ORACLES: dict[str, str] = {
    "op3_suffix_array_dedup": _bytes(200),
    "op5_license_scans": _licenses(0.8),
    "op7_substring_dedup": _substring(20),
    "op9_benchmark_decontamination": _leaks(8, 5, 0.5, 0.8, 13, 3),
    "op10_ngram_jaccard_join": _jaccard(3, 90),
}

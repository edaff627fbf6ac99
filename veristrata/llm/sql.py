"""SQL for DuckDB that gives the same rows as the queries of the same name."""

from __future__ import annotations

_WORDS = r"trim(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_N_WORDS = r"len(regexp_extract_all(text, '[\p{L}\p{N}]+'))"
_PIECES = r"list_filter(regexp_split_to_array(text, '[;|\n\r\x{85}\x{2028}\x{2029}]'), lambda p: regexp_matches(p, '[^\s\p{Z}]'))"

_FORMS = rf"""
WITH pieces AS (SELECT DISTINCT id, text, {_PIECES} AS ps FROM claims WHERE id IS NOT NULL AND text IS NOT NULL),
forms AS (
  SELECT id, CASE WHEN {_N_WORDS} < 3 THEN NULL
    WHEN len(ps) >= 2 AND len(list_filter(ps, lambda p: NOT regexp_matches(p, '(?s)^[\s\p{{Z}}]*[\p{{L}}\p{{N}}]+[\s\p{{Z}}]*[:=].*[\p{{L}}\p{{N}}].*$'))) = 0
    THEN chr(10) || array_to_string(list_sort(list_distinct(list_transform(ps, lambda p: lower({_WORDS.format('p')})))), chr(10))
    ELSE lower({_WORDS.format('text')}) END AS form
  FROM pieces
), sets AS (SELECT form, min(id) AS first_id, count(DISTINCT id) AS n_copies FROM forms WHERE form IS NOT NULL GROUP BY form)
"""

_LINE = r"regexp_replace(trim(regexp_replace(lower(line), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '[0-9]+', '0', 'g')"

_SETS = r"""
WITH w AS (SELECT DISTINCT id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS ws FROM claims WHERE id IS NOT NULL AND text IS NOT NULL),
items AS (
  SELECT DISTINCT 'claims' AS tab, id, unnest(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) AS item FROM w WHERE len(ws) >= 8
  UNION ALL
  SELECT DISTINCT 'peer_groups', id, lower(trim(m, chr(9) || chr(10) || chr(13) || ' ')) FROM (SELECT id, unnest(CAST(members AS VARCHAR[])) AS m FROM peer_groups WHERE id IS NOT NULL) WHERE trim(m) <> ''
), sizes AS (SELECT tab, id, count(*) AS n FROM items GROUP BY ALL),
common AS (SELECT a.tab, a.id AS id_a, b.id AS id_b, count(*) AS c FROM items a JOIN items b ON a.tab = b.tab AND a.item = b.item AND a.id < b.id GROUP BY ALL)
"""

_P6 = rf"""
WITH one AS (SELECT id, min(text) AS text, min(json_extract_string(meta, '$.source_uri')) AS uri FROM claims WHERE text IS NOT NULL GROUP BY id),
typed AS (SELECT one.id, text, source_type FROM one JOIN (SELECT uri, min(source_type) AS source_type FROM sources GROUP BY uri) USING (uri)),
lines AS (SELECT id, source_type, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM typed),
forms AS (SELECT id, source_type, line_no, {_LINE} AS form FROM lines WHERE regexp_matches(line, '[\p{{L}}\p{{N}}]')),
inside AS (SELECT source_type, form, count(DISTINCT id) AS inside FROM forms GROUP BY ALL),
counted AS (SELECT source_type, form, inside, sum(inside) OVER (PARTITION BY form) - inside AS outside FROM inside QUALIFY inside >= 10)
"""
_FRACTION = "x"
for _k in range(12, 0, -1):
    _FRACTION = f"x + {_k / 2} / ({_FRACTION})"
_part = lambda k, n, share: f"CASE WHEN {k} > 0 THEN {k} * ln({k} / ({n} * {share})) ELSE 0 END"
_TESTED = f""", sizes AS (SELECT source_type, count(*) AS n_in FROM typed GROUP BY 1),
g AS (SELECT *, (SELECT sum(n_in) FROM sizes) - n_in AS n_out, (inside + outside) / (n_in + (SELECT sum(n_in) FROM sizes) - n_in) AS share FROM counted JOIN sizes USING (source_type)),
scored AS (SELECT *, 2 * ({_part('inside', 'n_in', 'share')} + {_part('outside', 'n_out', 'share')} + {_part('(n_in - inside)', 'n_in', '(1 - share)')} + {_part('(n_out - outside)', 'n_out', '(1 - share)')}) AS g2 FROM g),
roots AS (SELECT *, sqrt(greatest(g2, 0) / 2) AS x, 1 / (1 + 0.3275911 * sqrt(greatest(g2, 0) / 2)) AS t FROM scored),
valued AS (SELECT *, CASE WHEN inside * n_out < outside * n_in THEN 1.0 WHEN x < 2.5 THEN t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x)
  ELSE exp(-x * x) / (({_FRACTION}) * 1.7724538509055159) END AS p FROM roots),
stepped AS (SELECT *, CASE WHEN p <= 1e-300 THEN -30000 ELSE CAST(ceil(log10(p) * 100) AS INT) END AS step FROM valued),
ranks AS (SELECT step, sum(count(*)) OVER (ORDER BY step) AS rank, sum(count(*)) OVER () AS m FROM stepped GROUP BY step),
bound AS (SELECT max(step) AS cut FROM ranks WHERE pow(10.0, step / 100) <= 0.05 * rank / m)
"""

_SPANS = """
WITH rec AS (SELECT 'claims' AS tab, id AS record_id, min(text) AS t FROM claims WHERE id IS NOT NULL GROUP BY id UNION ALL SELECT 'sources', id, min(content) FROM sources WHERE id IS NOT NULL GROUP BY id),
win AS (SELECT tab, record_id, a, substr(t, a + 1, 80) AS w FROM (SELECT tab, record_id, t, unnest(range(0, len(t) - 79)) AS a FROM rec WHERE len(t) >= 80)),
sh AS (SELECT tab, record_id, a FROM win JOIN (SELECT tab, w FROM win GROUP BY tab, w HAVING count(DISTINCT record_id) > 1) USING (tab, w)),
isl AS (SELECT *, sum(CASE WHEN a <= before + 80 THEN 0 ELSE 1 END) OVER (PARTITION BY tab, record_id ORDER BY a) AS g FROM (SELECT *, lag(a) OVER (PARTITION BY tab, record_id ORDER BY a) AS before FROM sh))
SELECT tab, record_id, CAST(min(a) AS INT) AS start_offset, CAST(max(a) + 80 AS INT) AS end_offset FROM isl GROUP BY tab, record_id, g"""

ORACLES = {
    "p5_found": _SPANS,
    "p2_classes": _SETS + """, cls AS (SELECT tab, id, list_sort(list(item)) AS s FROM items GROUP BY ALL),
reps AS (SELECT tab, s, min(id) AS class_id, count(*) AS n_copies FROM cls GROUP BY ALL),
near AS (SELECT common.tab, id_a, id_b FROM common
  JOIN sizes x ON x.tab = common.tab AND x.id = id_a JOIN sizes y ON y.tab = common.tab AND y.id = id_b
  JOIN reps p ON p.tab = common.tab AND p.class_id = id_a JOIN reps q ON q.tab = common.tab AND q.class_id = id_b WHERE 10 * c >= 7 * (x.n + y.n - c) AND p.s <> q.s),
ends AS (SELECT tab, id, count(*) AS n_links FROM (SELECT tab, id_a AS id FROM near UNION ALL SELECT tab, id_b FROM near) GROUP BY ALL)
SELECT cls.tab, cls.id, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM cls JOIN reps USING (tab, s) LEFT JOIN ends ON ends.tab = cls.tab AND ends.id = class_id""",
    "p2_found": _SETS + """SELECT common.tab, id_a, id_b FROM common
JOIN sizes x ON x.tab = common.tab AND x.id = id_a JOIN sizes y ON y.tab = common.tab AND y.id = id_b WHERE 10 * c >= 7 * (x.n + y.n - c)""",
    "p1_found": _FORMS + "SELECT DISTINCT id AS claim_id, first_id FROM forms JOIN sets USING (form) WHERE n_copies > 1",
    "p1_collapsed": _FORMS + """SELECT first_id, n_copies FROM sets UNION ALL
SELECT DISTINCT id, 1 FROM claims LEFT JOIN (SELECT id, form FROM forms WHERE form IS NOT NULL) USING (id) WHERE form IS NULL AND id IS NOT NULL""",
    "p6_found": _P6 + "SELECT id AS claim_id, CAST(line_no AS INT) AS line_no FROM forms JOIN counted USING (source_type, form)",
    "p6_lines": _P6 + _TESTED + "SELECT source_type, inside, CAST(outside AS BIGINT) AS outside, round(g2, 4) AS g2, CAST(step <= (SELECT cut FROM bound) AND p < 1 AS INT) AS significant, count(*) AS n_lines FROM stepped GROUP BY ALL",
    "p6_cleaned": _P6 + _TESTED + """, gone AS (SELECT id, line_no FROM forms JOIN stepped USING (source_type, form) WHERE step <= (SELECT cut FROM bound) AND p < 1),
every AS (SELECT id, min(text) AS text FROM claims WHERE id IS NOT NULL GROUP BY id),
pieces AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM every WHERE id IN (SELECT id FROM gone)),
kept AS (SELECT id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM pieces ANTI JOIN gone USING (id, line_no) GROUP BY id)
SELECT every.id AS claim_id, CASE WHEN g.n IS NULL THEN every.text ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(g.n, 0) AS INT) AS n_removed
FROM every LEFT JOIN (SELECT id, count(*) AS n FROM gone GROUP BY id) g ON g.id = every.id LEFT JOIN kept ON kept.id = every.id""",
}

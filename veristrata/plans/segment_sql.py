"""SQL for DuckDB that segments documents by the rules of operators.segment, and what follows from the segments."""

from __future__ import annotations

from veristrata.functions import text as T
from veristrata.operators.segment import ABBREVIATIONS, CLOSERS, TERMINATORS
from veristrata.plans.text_queries import QUESTION

_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CONTROL = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{85}\x{9f}"
_CLOSE = "".join("\\" + c if c in "])}" else c for c in CLOSERS).replace("'", "''")
_IND = r"[ \t\x{a0}]"
_HEAD = rf"^{_IND}*#{{1,6}}{_IND}[^{_SPACE}]"
_RULE = rf"^{_IND}*(-{{3,}}|\*{{3,}}|_{{3,}})[{_SPACE.replace(r'\t-\r', r'\t\x0b-\r')}]*$"
_FENCE = rf"^{_IND}*(```|~~~)"
_PIECE = rf"[^{TERMINATORS}{_CONTROL}]*([{TERMINATORS}][{TERMINATORS}{_CLOSE}]*|[{_CONTROL}])|[^{TERMINATORS}{_CONTROL}]+$"
_LIST = "[" + ", ".join(f"'{w}'" for w in sorted(ABBREVIATIONS)) + "]"
_words = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def json_string(x: str) -> str:
    """A JSON string literal of a column, with every control character escaped."""
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    out = f"replace(replace({x}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
    for i in range(32):
        out = f"replace({out}, chr({i}), chr(92) || '{short.get(i, f'u{i:04x}')}')"
    return f"'\"' || {out} || '\"'"


SEGMENTS = rf"""
WITH docs AS (SELECT doc_id AS k, text, source FROM documents WHERE text <> ''),
ln AS (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM docs),
lo AS (SELECT *, coalesce(sum(len(line) + 1) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM ln),
bl AS (SELECT k, a AS s, a + len(line) AS e, line, regexp_matches(line, '{_HEAD}') AS head FROM lo WHERE regexp_matches(line, '{_HEAD}') OR regexp_matches(line, '{_RULE}') OR regexp_matches(line, '{_FENCE}')),
st AS (SELECT k, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS a, s AS b, false AS is_last FROM bl
  UNION ALL SELECT docs.k, coalesce(m.e, 0), len(text), true FROM docs LEFT JOIN (SELECT k, max(e) AS e FROM bl GROUP BY k) m ON m.k = docs.k),
pl AS (SELECT st.k, a, b, is_last, regexp_extract_all(substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)), '{_PIECE}') AS ps FROM st JOIN docs ON docs.k = st.k),
pc AS (SELECT k, a, b, is_last, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pl),
po AS (SELECT *, a + coalesce(sum(len(p)) OVER (PARTITION BY k, a, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, regexp_extract(p, '[{TERMINATORS}][{TERMINATORS}{_CLOSE}]*$') AS run, regexp_matches(p, '[{_CONTROL}]$') AS ctl FROM pc),
pt AS (SELECT po.*, pos + len(p) - len(run) AS dot, docs.text FROM po JOIN docs ON docs.k = po.k),
pf AS (SELECT *, run LIKE '.%' AND len(regexp_replace(run, '[^{TERMINATORS}]', '', 'g')) = 1
  AND list_contains({_LIST}, lower(regexp_extract(substr(text, CAST(greatest(dot - 8, 0) AS BIGINT) + 1, CAST(least(dot, 8) AS BIGINT)), '[\p{{L}}\p{{N}}._'']{{1,8}}$'))) AS flagged FROM pt),
pg AS (SELECT *, coalesce(sum(CASE WHEN (run <> '' AND NOT flagged) OR ctl THEN 1 ELSE 0 END) OVER (PARTITION BY k, a, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM pf),
raw AS (SELECT k, min(pos) AS s, max(pos + len(p)) - max(CAST(ctl AS INT)) AS e, bool_or(is_last AND flagged AND run = '.' AND pos + len(p) = b) AS lost FROM pg GROUP BY k, a, b, grp
  UNION ALL SELECT k, s + len(regexp_extract(line, '^{_IND}*#{{1,6}}')), e, false FROM bl WHERE head),
cut AS (SELECT raw.k, s, substr(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)) AS piece FROM raw JOIN docs ON docs.k = raw.k WHERE NOT lost),
trimmed AS (SELECT k, s + len(regexp_extract(piece, '^[{_SPACE}]*')) AS s, regexp_replace(piece, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS text FROM cut),
seg AS (SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS INT) AS ordinal, CAST(s AS INT) AS start_offset, CAST(s + len(text) AS INT) AS end_offset, text FROM trimmed WHERE text <> ''),
prop AS (SELECT *, len(text) >= {T.MIN_PROPOSITION} AND NOT regexp_matches(text, '[{_CONTROL}]') AND regexp_matches(text, '\p{{L}}') AS ok FROM seg)
"""
_ID = "'{prefix}-' || sha256('veristrata/v1' || chr(0) || {json})"


def _id(prefix: str, json: str) -> str:
    return _ID.format(prefix=prefix, json=json)


_SRC = _id("src", "'{\"content\":' || " + json_string("docs.text") + " || ',\"source_type\":' || " + json_string("coalesce(source, ''document'')".replace("''", "'")) + " || ',\"uri\":\"' || docs.k || '\"}'")
_EV = _id("ev", "'{\"end_offset\":' || end_offset || ',\"meta\":{},\"source_id\":\"' || source_id || '\",\"start_offset\":' || start_offset || ',\"text\":' || " + json_string("text") + " || '}'")
_CLM = _id("clm", "'{\"evidence_ids\":[\"' || evidence_id || '\"],\"investigation_id\":null,\"meta\":{\"ordinal\":' || ordinal || ',\"origin\":\"extracted\",\"source_uri\":\"' || doc_id || '\"},\"state\":\"unexamined\",\"text\":' || " + json_string("text") + " || ',\"valid_time\":null}'")
_SHAPE = r"trim(regexp_replace(regexp_replace(lower(text), '[-.,;:!?\"''`()\[\]{}—–*…]', ' ', 'g'), '[" + _SPACE + r"]+', ' ', 'g'))"
COMPILED = SEGMENTS + f""", src AS (SELECT k, {_SRC} AS source_id FROM docs),
ev AS (SELECT prop.*, source_id, {_EV} AS evidence_id FROM prop JOIN src ON src.k = doc_id WHERE ok),
cl AS (SELECT *, {_CLM} AS claim_id, {_SHAPE} AS shape FROM ev),
shapes AS (SELECT shape, count(DISTINCT source_id) AS n_sources FROM cl WHERE shape <> '' GROUP BY shape HAVING count(DISTINCT source_id) >= 3),
texts AS (SELECT *, 'The sentence shape ''' || replace(shape, chr(92), chr(92) || chr(92)) || ''' occurs in ' || n_sources || ' distinct sources.' AS text FROM shapes),
mined AS (SELECT *, {_id('clm', "'{\"text\":' || " + json_string('text') + " || '}'")} AS id FROM texts)
"""
_TOKENS = SEGMENTS + f""", tk AS (SELECT doc_id, ordinal, start_offset, end_offset, text, list_filter(regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '[a-z0-9]+'), lambda w: NOT list_contains({_words(T.FUNCTION_WORDS)}, w)) AS tokens FROM prop WHERE ok),
terms AS (SELECT doc_id, ordinal, unnest(list_distinct(tokens)) AS term FROM tk)
"""
ORACLES = {
    "segments": SEGMENTS + "SELECT * FROM seg",
    "segment_counts": SEGMENTS + "SELECT doc_id, count(*) AS n_segments, count(*) FILTER (WHERE ok) AS n_propositions FROM prop GROUP BY doc_id",
    "dropped_segments": SEGMENTS + "SELECT CAST(doc_id AS VARCHAR) AS uri, count(*) AS n_segments, count(*) FILTER (WHERE NOT ok) AS n_dropped FROM prop GROUP BY doc_id",
    "compiled_evidence": COMPILED + "SELECT evidence_id AS id, source_id, start_offset, end_offset FROM ev",
    "compiled_claims": COMPILED + "SELECT claim_id AS id, CAST(doc_id AS VARCHAR) AS source_uri, ordinal FROM cl",
    "mined_claims": COMPILED + "SELECT id, text, shape, n_sources FROM mined",
    "derived_support": COMPILED + "SELECT id, count(*) AS n_support FROM mined JOIN cl USING (shape) GROUP BY id",
    "unmined_claims": COMPILED + "SELECT claim_id AS id FROM cl WHERE shape NOT IN (SELECT shape FROM mined)",
    "bm25_term_stats": _TOKENS + "SELECT term, df, tf FROM (SELECT term, count(*) AS df FROM terms GROUP BY term) JOIN (SELECT unnest(tokens) AS term, count(*) AS tf FROM tk GROUP BY 1) USING (term)",
    "bm25_search": _TOKENS + f"""SELECT doc_id, ordinal, start_offset, end_offset, text, round(score, 6) AS score FROM (
  SELECT doc_id, ordinal, start_offset, end_offset, text, sum(ln((nn - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl))) AS score
  FROM (SELECT tk.*, q.term, len(list_filter(tokens, lambda w: w = q.term)) AS tf FROM tk, (SELECT unnest(list_distinct(list_filter(regexp_extract_all(lower('{QUESTION}'), '[a-z0-9]+'), lambda w: NOT list_contains({_words(T.FUNCTION_WORDS)}, w)))) AS term) q)
  JOIN (SELECT term, count(*) AS df FROM terms GROUP BY term) USING (term), (SELECT count(*) AS nn, avg(len(tokens)) AS avgdl FROM tk) WHERE tf > 0 GROUP BY ALL) WHERE score > 0""",
}

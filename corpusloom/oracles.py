"""SQL for the registered queries, to be run on the same tables by another engine."""

from __future__ import annotations

from .functions.languages import BY_EXTENSION, DIAGRAMS, NAMES
from .functions.text import WORD
from .goldens import GOLDEN_IMPORTS, GOLDEN_PATHS, GOLDEN_UNITS, GOLDEN_URLS, PARSED, UNITS
from .operators.diagram import COLOURS
from .operators.embedding import DIMENSIONS, EMBED_CHARS
from .operators.ranking import B, BONUS, EPSILON, K1, PER_PATH, RRF_K
from .queries import CODE, EXTENSIONS, JS_MODULES
from .sources.repository import ADDRESS, KEPT_EXTENSIONS, KEPT_NAMES, LEAST_BYTES, MOST_BYTES, MOST_FILES, SKIPPED

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _s(value: str | None) -> str:
    """A string literal."""
    if value is None:
        return "NULL"
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in value.split("\n"))


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: _s(v) if v is None or isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


def _in(names) -> str:
    return "(" + ", ".join(map(_s, names)) + ")"


# ---------------------------------------------------------------- derived tables
_CH = "ch AS (SELECT doc_id AS chunk_id, source AS path, text FROM documents)"
_HASHED = f"""hw AS (SELECT chunk_id, list_transform(regexp_extract_all(lower(coalesce(substring(text, 1, {EMBED_CHARS}), '')), '{WORD}'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT) AS h FROM ch),
hv AS MATERIALIZED (SELECT chunk_id, list_transform(range({DIMENSIONS}), lambda k: coalesce(list_sum(list_transform(list_filter(h, lambda x: x % {DIMENSIONS} = k), lambda x: CASE WHEN (x >> 20) & 1 = 0 THEN 1 ELSE -1 END)), 0)::DOUBLE) AS v FROM hw),
he AS MATERIALIZED (SELECT chunk_id, list_transform(v, lambda x: (x / CASE WHEN n = 0 THEN 1 ELSE n END)::FLOAT) AS hashed FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM hv))"""
_HY = f"{_CH}, {_HASHED}, hy AS MATERIALIZED (SELECT ch.*, coalesce(e.embedding, hashed) AS embedding FROM ch JOIN he USING (chunk_id) LEFT JOIN embeddings e ON ch.chunk_id = e.vec_id)"
_Q = "q AS (SELECT item_id // 3 AS question_id, item_id AS query_id, text, embedding AS vec FROM benchmark JOIN embeddings ON vec_id = item_id)"
_CARDS = """cards AS (SELECT *, 'txt' AS file_type,
  CASE WHEN chunk_id % 2 = 0 THEN 'Part ' || (chunk_id % 7) END AS heading,
  CASE WHEN chunk_id % 5 = 0 THEN 'unit_' || (chunk_id % 11) END AS unit_name,
  CASE WHEN chunk_id % 5 = 0 THEN 'function' END AS unit_type FROM {0})"""
_LABEL = "path || coalesce(' :: ' || unit_name, ' › ' || heading, '')"
_FI = f"""fi AS (SELECT doc_id AS pos,
  CASE doc_id % 11 WHEN 0 THEN 'a/dist/' WHEN 1 THEN 'dist/' ELSE '' END || source || '/doc_' || doc_id || '.' || list_extract([{", ".join(map(_s, EXTENSIONS))}], doc_id % 8 + 1) AS path,
  list_extract([{", ".join(map(_s, EXTENSIONS))}], doc_id % 8 + 1) AS file_type,
  length(text) AS size, CASE WHEN doc_id % 3 = 0 THEN '# ' ELSE '' END || replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents)"""
_MODULE = "CASE doc_id % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib/' ELSE '' END || 'src' || (doc_id % 20) || '/doc_' || doc_id || '.py'"
_IM = f"""d AS (SELECT doc_id, {_MODULE} AS path, count(*) OVER () AS n FROM documents),
im AS (SELECT path AS src, unnest([(7 * doc_id + 3) % n, (13 * doc_id + 1) % n]) AS b FROM d),
cand AS (SELECT src, 'src' || (b % 20) || '.doc_' || b AS raw, unnest(['', 'src/', 'lib/']) AS root, b FROM im),
hit AS (SELECT src, raw, arg_min(d.path, CASE root WHEN '' THEN 0 WHEN 'src/' THEN 1 ELSE 2 END) AS dst
  FROM cand JOIN d ON d.path = root || 'src' || (b % 20) || '/doc_' || b || '.py' GROUP BY src, raw),
e AS (SELECT DISTINCT src, dst FROM hit WHERE src <> dst)"""
_TOK = f"""tok AS (SELECT chunk_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM @table),
len AS (SELECT chunk_id, len(w) AS dl FROM tok),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM tok) GROUP BY ALL),
tot AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM len),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post, tot GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN {EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM = f"""qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM q) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(times * idf * tf * ({K1} + 1)::DOUBLE / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * dl / avgdl))) AS bm25
  FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN len USING (chunk_id), tot GROUP BY query_id, chunk_id)"""
_COS = "cs AS (SELECT query_id, chunk_id, path, CASE WHEN list_sum(list_transform(embedding, lambda x: abs(x))) = 0 THEN 0 ELSE list_cosine_similarity(embedding::DOUBLE[], vec::DOUBLE[]) END AS cosine FROM hy, q)"
_RANKS = f"""{_HY}, {_Q}, {_TOK.replace('@table', 'hy')}, {_BM}, {_COS},
rk AS (SELECT query_id, chunk_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, chunk_id) AS vector_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(bm25, 0), 9) DESC, chunk_id) AS bm25_rank
  FROM cs LEFT JOIN bm USING (query_id, chunk_id)),
fu AS (SELECT *, 1::DOUBLE / ({RRF_K} + vector_rank) + 1::DOUBLE / ({RRF_K} + bm25_rank) AS score FROM rk)"""


def _top(source: str, by: str, k: int, name: str, more: str = "") -> str:
    order = f"ORDER BY round(score, 9) DESC, chunk_id"
    return f"""{name}_a AS (SELECT *, row_number() OVER (PARTITION BY {by}, path {order}) AS own FROM {source}),
{name}_b AS (SELECT * EXCLUDE (own), row_number() OVER (PARTITION BY {by} {order}) AS rank FROM {name}_a WHERE own <= {PER_PATH}),
{name} AS (SELECT * FROM {name}_b WHERE rank <= {k})"""


_MERGED = f"""{_RANKS}, {_top("fu", "query_id", 14, "pq")},
mg AS (SELECT question_id, chunk_id, path, count(*) AS hits, max(score) * (1 + {BONUS}::DOUBLE * (count(*) - 1)) AS score FROM pq JOIN q USING (query_id) GROUP BY question_id, chunk_id, path),
{_top("mg", "question_id", 10, "sem")}"""
_GRAPH = f"""{_MERGED},
src AS (SELECT DISTINCT source AS src, substr(source, 4)::BIGINT AS k FROM documents),
pe AS (SELECT src, 'src' || unnest([(7 * k + 3) % 20, (k + 1) % 20]) AS dst FROM src),
links AS (SELECT src AS path, dst AS other FROM pe WHERE src <> dst UNION SELECT dst, src FROM pe WHERE src <> dst),
asked AS (SELECT question_id, min(query_id) AS query_id FROM q GROUP BY question_id),
near AS (SELECT DISTINCT question_id, other AS path FROM sem JOIN links USING (path)),
far AS (SELECT * FROM near ANTI JOIN sem USING (question_id, path)),
{_top("fu", "query_id", 100, "pool")},
first AS (SELECT question_id, chunk_id, path, score, row_number() OVER (PARTITION BY question_id, path ORDER BY round(score, 9) DESC, chunk_id) AS own FROM pool JOIN asked USING (query_id) JOIN far USING (question_id, path)),
gr AS (SELECT question_id, chunk_id, path, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM first WHERE own = 1)"""
_SOURCES = f"""{_GRAPH}, {_CARDS.format("hy")},
both_ AS (SELECT question_id, chunk_id, score, rank AS place, false AS via_graph FROM sem UNION ALL
  SELECT question_id, chunk_id, score, rank + (SELECT count(*) FROM sem s WHERE s.question_id = gr.question_id), true FROM gr WHERE rank <= 4),
so AS (SELECT question_id, place, via_graph, chunk_id, score, trim(replace(substr(text, 1, 200), chr(10), ' '), {_WS}) || '…' AS preview, {_LABEL} AS label,
  CASE WHEN unit_type = 'function' THEN 'fn' ELSE 'TXT' END || CASE WHEN via_graph THEN ' · graph' ELSE '' END AS badge, floor(score * 100)::INT AS percent
  FROM both_ JOIN cards USING (chunk_id))"""
_NAME = "split_part(path, '/', -1)"


def _language(path: str = "path") -> str:
    name = f"split_part({path}, '/', -1)"
    names = " ".join(f"WHEN {name} = {_s(k)} THEN {_s(v)}" for k, v in NAMES.items())
    ends = " ".join(f"WHEN {_s(k)} THEN {_s(v)}" for k, v in BY_EXTENSION.items())
    return f"CASE {names} ELSE CASE lower(regexp_extract({name}, '^.+?([.][^.]+)$', 1)) {ends} ELSE 'generic' END END"


_PATHS = f"{_FI}, p AS (SELECT path FROM fi UNION ALL SELECT path FROM {_values([(x,) for x in GOLDEN_PATHS], 'path')})"
_TYPE = "lower(split_part(path, '.', -1))"
_WANTED = f"""size BETWEEN {LEAST_BYTES} AND {MOST_BYTES} AND NOT ({" OR ".join(f"contains(path, {_s(x)})" for x in SKIPPED)})
  AND (contains(path, '.') AND {_TYPE} IN {_in(KEPT_EXTENSIONS)} OR {_NAME} IN {_in(KEPT_NAMES)})"""
_BLOCKS = f"""pa AS (SELECT path, generate_subscripts(x, 1) AS i, unnest(x) AS p FROM (SELECT path, regexp_split_to_array(content, '\\n{{2,}}') AS x FROM fi)),
r AS (SELECT path, i, ltrim(p, {_WS}) AS now, 0::BIGINT AS line, NULL::VARCHAR AS done, NULL::BIGINT AS since FROM pa WHERE i = 1 UNION ALL
  SELECT r.path, r.i + 1, CASE WHEN f THEN p ELSE ltrim(now || chr(10) || chr(10) || p, {_WS}) END, CASE WHEN f THEN line + n + 2 ELSE line END, CASE WHEN f THEN now END, CASE WHEN f THEN line END
  FROM (SELECT r.*, pa.p, now <> '' AND length(now) + length(pa.p) > 2000 AS f, length(now) - length(replace(now, chr(10), '')) AS n FROM r JOIN pa ON pa.path = r.path AND pa.i = r.i + 1) r),
b AS (SELECT path, i - 1 AS i, done AS t, since FROM r WHERE done IS NOT NULL UNION ALL
  SELECT path, i, now, line FROM r JOIN (SELECT path, max(i) AS i FROM pa GROUP BY path) USING (path, i) WHERE trim(now, {_WS}) <> '')"""
_SECTIONS = """ln AS (SELECT path, generate_subscripts(x, 1) AS i, unnest(x) AS l FROM (SELECT path, string_split(content, chr(10)) AS x FROM fi)),
hd AS (SELECT *, regexp_matches(l, '^#{1,4}\\s+.+') AS h FROM ln),
sn AS (SELECT *, sum(CASE WHEN h AND i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS ord FROM hd),
se AS (SELECT path, ord::BIGINT AS ord, coalesce(max(CASE WHEN h THEN trim(regexp_extract(l, '^#{1,4}\\s+(.+)', 1), {ws}) END), '') AS heading, string_agg(l, chr(10) ORDER BY i) AS text FROM sn GROUP BY path, ord)""".replace("{ws}", _WS)
_PACKS = f"""lg AS (SELECT * FROM se WHERE length(text) > 2400),
pa AS (SELECT path, ord, generate_subscripts(x, 1) AS i, unnest(x) AS p FROM (SELECT path, ord, regexp_split_to_array(text, '\\n{{2,}}') AS x FROM lg)),
r AS (SELECT path, ord, i, p AS now, NULL::VARCHAR AS done FROM pa WHERE i = 1 UNION ALL
  SELECT path, ord, i + 1, CASE WHEN f THEN right(now, 300) || chr(10) || chr(10) || p WHEN now = '' THEN p ELSE ltrim(now || chr(10) || chr(10) || p, {_WS}) END, CASE WHEN f THEN now END
  FROM (SELECT r.*, pa.p, now <> '' AND length(now) + length(pa.p) + 2 > 2400 AS f FROM r JOIN pa ON pa.path = r.path AND pa.ord = r.ord AND pa.i = r.i + 1)),
pk AS (SELECT path, ord, i - 1 AS i, trim(done, {_WS}) AS t FROM r WHERE done IS NOT NULL UNION ALL
  SELECT path, ord, i, trim(now, {_WS}) FROM r JOIN (SELECT path, ord, max(i) AS i FROM pa GROUP BY path, ord) USING (path, ord, i) WHERE trim(now, {_WS}) <> ''),
al AS (SELECT path, ord, 0 AS i, heading, text FROM se WHERE length(text) <= 2400 UNION ALL
  SELECT path, ord, i, heading, t FROM pk JOIN se USING (path, ord)),
ok AS (SELECT path, ord, i, heading, trim(text, {_WS}) AS t FROM al WHERE length(trim(text, {_WS})) > 50),
fin AS (SELECT * FROM ok UNION ALL SELECT path, 0, 0, '', trim(content, {_WS}) FROM fi ANTI JOIN ok USING (path) WHERE file_type IN ('md', 'mdx', 'txt', 'rst'))"""
_DIAGRAM = " ".join(f"WHEN starts_with(k, '{a}') THEN '{b}'" for a, b in DIAGRAMS)
_UNITS = f"""d0 AS (SELECT doc_id, {_MODULE} AS path FROM documents), fu_ AS (SELECT path, ['load', 'Run'] AS units FROM d0)"""
_DEG = "dg AS (SELECT path, count(*) AS degree FROM (SELECT src AS path FROM e UNION ALL SELECT dst FROM e) GROUP BY path)"
_SHOWN = f"{_IM}, {_DEG}, al AS (SELECT path, coalesce(degree, 0) AS degree FROM d LEFT JOIN dg USING (path)), sh AS (SELECT * FROM al ORDER BY degree DESC, path LIMIT {{0}})"
_NODE = "regexp_replace({0}, '[^a-zA-Z0-9]', '_', 'g')"
_BOTH = "lk AS (SELECT src AS path, dst AS other FROM e UNION SELECT dst, src FROM e)"
_SUMMARY = f"""{_SHOWN.format(40)}, o AS (SELECT src AS path, string_agg(dst, ', ' ORDER BY dst) AS x FROM e GROUP BY src), n AS (SELECT dst AS path, string_agg(src, ', ' ORDER BY src) AS x FROM e GROUP BY dst)"""


def _suited(shown: str) -> str:
    """The summary that chunking.imports_summary gives of a list."""
    return f"array_to_string(list_slice({shown}, 1, 12), ', ') || CASE WHEN len({shown}) > 12 THEN ' (+' || (len({shown}) - 12) || ' more)' ELSE '' END"


def _code_text() -> str:
    rows = []
    for path, lang, name, kind, sign, doc, body, imports, about in GOLDEN_UNITS:
        shown = ", ".join(imports[:12]) + (f" (+{len(imports) - 12} more)" if len(imports) > 12 else "")
        head = [f"[{lang.title()} {kind.title()}] {path} :: {name}"]
        head += [f"{label}: {x}" for label, x in (("Signature", sign), ("Docstring", doc), ("File imports", shown), ("File description", about if kind == "module" else "")) if x]
        rows.append((path, name, "\n".join([*head, "─" * 40, body])))
    return f"SELECT * FROM {_values(rows, 'path, name, text')}"


def _resolved(lang: str) -> str:
    """The fixed imports, and those of the table ``rs`` that the caller defines."""
    return f"SELECT * FROM {_values([(a, b, d) for a, b, x, d in GOLDEN_IMPORTS if x == lang], 'src, raw, dst')} UNION ALL SELECT src, raw, dst FROM rs"


# a module's number is carried beside its import, so that no path is normalised here
_JS = f"""d AS (SELECT doc_id, count(*) OVER () AS n, 'web/s' || (doc_id % 20) || '/m_' || doc_id AS stem, {list(JS_MODULES)}[doc_id % {len(JS_MODULES)} + 1] AS ending FROM documents),
ps AS (SELECT stem || ending AS path FROM d UNION SELECT stem || '.tsx' FROM d WHERE doc_id % 5 = 0),
im AS (SELECT stem || ending AS src, CASE WHEN ending = '/index.js' THEN '../' ELSE '' END AS up, doc_id, (7 * doc_id + 3) % n AS far FROM d),
rw AS (SELECT src, up || '../s' || (far % 20) || '/m_' || far AS raw, far AS b FROM im UNION SELECT src, './' || up || 'm_' || (doc_id + 20), doc_id + 20 FROM im UNION SELECT src, 'react', NULL FROM im),
en AS (SELECT unnest(['.ts', '.tsx', '.js', '.jsx', '/index.js']) AS ending, unnest(range(5)) AS place),
ht AS (SELECT src, raw, arg_min(path, place) AS dst FROM rw CROSS JOIN en JOIN ps ON path = 'web/s' || (b % 20) || '/m_' || b || en.ending GROUP BY src, raw),
rs AS (SELECT rw.src, rw.raw, dst FROM rw LEFT JOIN ht ON ht.src = rw.src AND ht.raw = rw.raw)"""
_GO = """d AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'cmd/s' || (doc_id % 20) || '/d' || doc_id || '/' END || 'm_' || (doc_id % 97) || '.go' AS path FROM documents),
rs AS (SELECT DISTINCT path AS src, 'example.com/x/m_' || ((7 * doc_id + 3) % 120) AS raw, (SELECT min(f.path) FROM d f WHERE f.doc_id % 13 <> 0 AND f.doc_id % 97 = (7 * d.doc_id + 3) % 120) AS dst FROM d)"""


# units and imports of each document's code file, put together from their parts, so that nothing is parsed here
_NL = "chr(10)"
_UNIT = "SELECT path, '{0}' AS language, {1} AS name, '{2}' AS unit_type, {3} AS signature, {4} AS docstring, {5} AS body, {6}::BIGINT AS line_start, {7}::BIGINT AS line_end, {8} AS imports, {9} AS module_doc FROM cf WHERE {10}"
_PY_IMPORTS, _JS_IMPORTS, _GO_IMPORTS, _JAVA_IMPORTS, _RS_IMPORTS = "['os', 'src' || a || '.doc_' || d, '.']", "['./a_' || d, 'b' || a]", "['fmt', 'f \"x/y' || a]", "['a.b' || a || '.C']", "['std::io' || a]"
_PY, _GO_BODY = "kind = 0 AND d % 25 NOT IN (0, 5)", f"{_NL} || chr(9) || 'if a > 0 {{ fmt.Println(\"{{\") }}'"
_CODE_UNITS = (
    ("python", "'load_' || d", "function", "'def load_' || d || '(a: int, k) -> str'", "doc",
     f"""'def load_' || d || '(a: int, *, k=1) -> str:' || {_NL} || '    "' || doc || '"' || repeat({_NL} || '    v = 1', m)""", "5", "6 + m", _PY_IMPORTS, "doc", _PY),
    ("python", "'Run' || d", "class", "'class Run' || d || '(Base)'", "''", f"'class Run' || d || '(Base):' || {_NL} || '    def g(self): pass'", "8 + m", "9 + m", _PY_IMPORTS, "doc", _PY),
    ("python", "'block_1'", "module", "''", "''", f"'import os' || {_NL} || 'def f(:' || {_NL} || doc", "1", "3", "[]::VARCHAR[]", "''", "d % 25 = 0"),
    ("python", "'f_' || d", "module", "'# ' || path", "''", f"""'x = 1' || {_NL} || 'y = "' || doc || '"' || {_NL}""", "1", "2", "[]::VARCHAR[]", "''", "d % 25 = 5"),
    ("javascript", "'add_' || d", "function", "'export function add_' || d || '('", f"'adds' || {_NL} || doc",
     f"'export function add_' || d || '(x) {{' || repeat({_NL} || '  const s = ''}}'' + x', m) || {_NL} || '}}'", "7", "8 + m", _JS_IMPORTS, "doc", "kind = 1"),
    ("javascript", "'Box' || d", "class", "'class Box' || d || ' extends Base'", "''", f"'class Box' || d || ' extends Base {{' || {_NL} || '  put(v) {{ this.v = v }}' || {_NL} || '}}'", "9 + m", "11 + m", _JS_IMPORTS, "doc", "kind = 1"),
    ("go", "'Run' || d", "function", "'func (s *Server) Run' || d || '('", "'Run runs ' || doc || '.'", f"'func (s *Server) Run' || d || '(a int) {{' || repeat({_GO_BODY}, m) || {_NL} || '}}'", "9", "10 + m", _GO_IMPORTS, "''", "kind = 2"),
    ("go", "'Server' || d", "class", "'type Server' || d || ' struct {'", "''", f"'type Server' || d || ' struct {{' || {_NL} || chr(9) || 'n int' || {_NL} || '}}'", "12 + m", "14 + m", _GO_IMPORTS, "''", "kind = 2"),
    ("java", "'Box' || d", "class", "'public class Box' || d", "''",
     f"'public class Box' || d || ' {{' || {_NL} || '    public int get(int k) {{' || repeat({_NL} || '        return k;', m) || {_NL} || '    }}' || {_NL} || '}}'", "3", "6 + m", _JAVA_IMPORTS, "doc", "kind = 3"),
    ("rust", "'read_' || d", "function", "'pub fn read_' || d", "'Reads ' || doc", f"'pub fn read_' || d || '(n: u8) {{' || repeat({_NL} || '    go();', m) || {_NL} || '}}'", "5", "6 + m", _RS_IMPORTS, "''", "kind = 4"),
    ("rust", "'Reader' || d", "class", "'impl Reader' || d", "''", f"'impl Reader' || d || ' {{' || {_NL} || '    fn inner(&self) {{}}' || {_NL} || '}}'", "7 + m", "9 + m", _RS_IMPORTS, "''", "kind = 4"),
)
_CF = f"""cf AS (SELECT doc_id AS d, doc_id % 5 AS kind, doc_id % 7 AS a, doc_id % 4 + 1 AS m, 'code/s' || (doc_id % 20) || '/f_' || doc_id || '.' || {[x for x, _, _ in CODE]}[doc_id % 5 + 1] AS path,
  coalesce(nullif(trim(regexp_replace(substring(text, 1, 80), '[^A-Za-z]+', ' ', 'g')), ''), 'none') AS doc FROM documents),
un AS ({" UNION ALL ".join(_UNIT.format(*x) for x in _CODE_UNITS)}),
cu AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_start) - 1 AS ord, count(*) OVER (PARTITION BY path) AS total FROM un),
ct AS (SELECT *, concat_ws({_NL}, '[' || upper(language[1]) || language[2:] || ' ' || upper(unit_type[1]) || unit_type[2:] || '] ' || path || ' :: ' || name,
  'Signature: ' || nullif(signature, ''), 'Docstring: ' || nullif(docstring, ''), 'File imports: ' || nullif(array_to_string(imports, ', '), ''), repeat('─', 40), body) AS text FROM cu)"""

_URL = f"regexp_extract(rtrim(trim(url, {_WS}), '/'), '{ADDRESS}', {{0}})"
_URLS = f"u AS (SELECT url FROM pages UNION ALL SELECT 'https://github.com/' || source || '/doc_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.git' ELSE '/tree/dev/' || (doc_id % 5) END FROM documents UNION ALL SELECT url FROM {_values([(x,) for x in GOLDEN_URLS], 'url')}), a AS (SELECT url, nullif({_URL.format(1)}, '') AS owner, nullif({_URL.format(2)}, '') AS repo, nullif({_URL.format(3)}, '') AS branch FROM u)"

ORACLES: dict[str, str] = {
    "tokenize_counts": f"WITH {_CH}, {_TOK.replace('@table', 'ch')} SELECT chunk_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct FROM tok",
    "bm25_term_stats": f"WITH {_CH}, {_TOK.replace('@table', 'ch')} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_doc_len": f"WITH {_CH}, {_TOK.replace('@table', 'ch')} SELECT chunk_id, dl FROM len",
    "bm25_scores": f"WITH {_CH}, {_Q}, {_TOK.replace('@table', 'ch')}, {_BM} SELECT query_id, chunk_id, round(bm25, 6) AS bm25 FROM bm",
    "cosine_scores": f"WITH {_HY}, {_Q}, {_COS} SELECT query_id, chunk_id, path, round(cosine, 6) AS cosine FROM cs",
    "embed_documents": f"WITH {_CH}, {_HASHED} SELECT chunk_id, (unnest(range({DIMENSIONS})))::INTEGER AS place, round(unnest(hashed)::DOUBLE, 6) AS value FROM he",
    "vector_topk_capped": f"WITH {_HY}, {_Q}, {_COS}, c AS (SELECT query_id, chunk_id, path, cosine AS score FROM cs), {_top('c', 'query_id', 6, 't')} SELECT query_id, chunk_id, path, round(score, 6) AS score, rank FROM t",
    "rank_lists": f"WITH {_RANKS} SELECT query_id, chunk_id, vector_rank, bm25_rank FROM rk",
    "rrf_fusion": f"WITH {_RANKS} SELECT query_id, chunk_id, round(score, 6) AS score FROM fu",
    "hybrid_search": f"WITH {_RANKS}, {_top('fu', 'query_id', 6, 't')} SELECT query_id, chunk_id, path, round(score, 6) AS score, rank FROM t",
    "multi_query_merge": f"WITH {_MERGED} SELECT question_id, chunk_id, path, hits, round(score, 6) AS score, rank FROM sem",
    "graph_augmented_retrieve": f"WITH {_GRAPH} SELECT question_id, chunk_id, path, round(score, 6) AS score, rank FROM gr WHERE rank <= 4",
    "build_sources": f"WITH {_SOURCES} SELECT question_id, place, via_graph, chunk_id, round(score, 6) AS score, preview, label, badge, percent FROM so",
    "context_block": f"""WITH {_GRAPH}, {_CARDS.format("hy")},
f4 AS (SELECT question_id, chunk_id, rank, 0 AS part FROM sem WHERE rank <= 4 UNION ALL SELECT question_id, chunk_id, rank, 1 FROM gr WHERE rank = 1)
SELECT question_id, string_agg('[' || {_LABEL} || ']' || chr(10) || trim(substr(text, 1, 400), {_WS}) || CASE WHEN length(text) > 400 THEN chr(10) || '…' ELSE '' END, chr(10) || chr(10) ORDER BY part, rank) AS context
FROM f4 JOIN cards USING (chunk_id) GROUP BY question_id""",
    "chunks_for_file": f"WITH {_CH} SELECT * FROM ch WHERE path = 'src3'",
    "indexed_files": "SELECT source AS path, 'txt' AS file_type, count(*) AS n_chunks FROM documents GROUP BY source",
    "index_size": "SELECT count(*) AS n_chunks FROM documents",
    "file_counts": f"WITH {_FI} SELECT count(*) AS n_files, count(*) FILTER (WHERE file_type = 'mmd') AS n_diagrams, count(*) FILTER (WHERE file_type <> 'mmd') AS n_other FROM fi",
    "search_tool": f"""WITH {_RANKS}, {_top("fu", "query_id", 6, "t")}, {_CARDS.format("hy")}
SELECT query_id, string_agg('[' || cards.path || coalesce(' :: ' || unit_name || ' (' || unit_type || ')', ' › ' || heading, '') || ']' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS answer
FROM t JOIN cards USING (chunk_id) GROUP BY query_id""",
    "tool_fetch": f"""WITH {_CH}, {_CARDS.format("ch")}, refs AS (SELECT * FROM (VALUES ('src3'), ('PART 4'), ('rc1'), ('nowhere')) v(ref))
SELECT ref, chunk_id FROM refs, cards WHERE CASE WHEN ref IN (SELECT path FROM cards) THEN path = ref ELSE contains(lower(coalesce(heading, '')), lower(ref)) OR contains(lower(path), lower(ref)) END""",
    "tool_list_sections": f"""WITH {_CH}, {_CARDS.format("ch")}, s AS (SELECT coalesce(heading, unit_name, path) AS section, path, chunk_id FROM cards)
SELECT section, path, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY path, chunk_id) AS k FROM s) WHERE k = 1""",
    "tool_list_files": "SELECT DISTINCT source AS path FROM documents",
    "expand_queries_post": f"""WITH t AS (SELECT (u.conv_id + 1) * 1000000 + u.turn AS question_id, u.text AS q, a.text AS r FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
x AS (SELECT question_id, [q] || list_filter(list_transform(string_split(coalesce(r, ''), chr(10)), lambda l: trim(l, {_WS})), lambda l: l <> '' AND l <> q)[1:2] AS l FROM t)
SELECT question_id::BIGINT AS question_id, query_id::BIGINT AS query_id, text FROM {_values([(0, 0, 'q'), (0, 1, 'x'), (0, 2, 'y'), (1, 0, 'q'), (2, 0, 'how'), (3, 0, 'a b'), (3, 1, 'c'), (3, 2, 'c')], 'question_id, query_id, text')} UNION ALL
SELECT question_id::BIGINT, generate_subscripts(l, 1)::BIGINT - 1, unnest(l) FROM x""",
    "chat_history": f"""WITH {_SOURCES}, l AS (SELECT question_id, string_agg(label, ' ; ' ORDER BY place) AS sources FROM so GROUP BY question_id)
SELECT conv_id AS question_id, turn, role, sources FROM conversations LEFT JOIN l ON question_id = conv_id""",
    "parse_repo_url": f"WITH {_URLS} SELECT * FROM a",
    "repo_id": f"WITH {_URLS} SELECT url, owner || '__' || repo AS repo_id FROM a WHERE owner IS NOT NULL",
    "file_filter": f"WITH {_FI} SELECT path, size FROM fi WHERE {_WANTED}",
    "file_limit": f"WITH {_FI} SELECT path, pos FROM fi WHERE {_WANTED} ORDER BY pos LIMIT {MOST_FILES}",
    "file_types": f"WITH {_PATHS} SELECT path, {_TYPE} AS file_type FROM p",
    "detect_language": f"WITH {_PATHS} SELECT path, {_language()} AS language FROM p",
    "generic_blocks": f"""WITH RECURSIVE {_FI}, {_BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS ord FROM b)
SELECT path, ord, 'block_' || (ord + 1) AS name, trim(t, {_WS}) AS body, (since + 1)::BIGINT AS line_start, (since + 1 + length(t) - length(replace(t, chr(10), '')))::BIGINT AS line_end FROM o""",
    "file_comment": f"""WITH {_FI}, c AS (SELECT path, regexp_extract(content, '^\\s*(/\\*(?s:.*?)\\*/|(?:#[^\\n]*\\n)+|(?://[^\\n]*\\n)+)', 1) AS c FROM fi)
SELECT path, regexp_replace(c, '^[/*#\\s]+|[/*#\\s]+$', '', 'g') AS comment FROM c""",
    "truncate_units": f"WITH {_CH} SELECT chunk_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || chr(10) || '... [truncated — file too large]' ELSE text END AS body FROM ch",
    "dedup_units": """WITH u AS (SELECT DISTINCT l_orderkey::VARCHAR AS path, l_partkey AS ord, l_linenumber::BIGINT AS line_start, (l_linenumber + l_quantity % 9)::BIGINT AS line_end FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_start, line_end - line_start DESC, ord) AS k FROM u)
SELECT path, ord, line_start, line_end FROM o ANTI JOIN o p ON p.path = o.path AND p.k < o.k AND p.line_end >= o.line_end""",
    "chunk_router": f"WITH {_FI} SELECT path, CASE WHEN file_type = 'mmd' THEN 'mermaid' WHEN file_type IN ('md', 'mdx', 'txt', 'rst') THEN 'markdown' ELSE 'code' END AS route FROM fi",
    "mermaid_chunks": f"""WITH {_FI}, s AS (SELECT path, trim(content, {_WS}) AS c, list_filter(list_transform(regexp_split_to_array(content, '\\n{{2,}}'), lambda x: trim(x, {_WS})), lambda x: length(x) > 10) AS b FROM fi WHERE file_type = 'mmd'),
m AS (SELECT path, CASE WHEN len(b) > 0 THEN b ELSE [c] END AS b FROM s), x AS (SELECT path, len(b) AS n, generate_subscripts(b, 1) - 1 AS i, unnest(b) AS t FROM m),
k AS (SELECT *, translate(lower(split_part(t, chr(10), 1)), '- ', '') AS k FROM x), g AS (SELECT *, CASE {_DIAGRAM} ELSE 'Diagram' END AS g FROM k)
SELECT path || '::' || i AS chunk_id, '[Mermaid ' || g || '] File: ' || path || chr(10) || chr(10) || t AS text, g AS heading, i::BIGINT AS chunk_index, n::BIGINT AS total_chunks FROM g""",
    "markdown_sections": f"WITH {_FI}, {_SECTIONS} SELECT path, ord, heading, text FROM se",
    "markdown_chunks": f"""WITH RECURSIVE {_FI.replace("fi AS", "fi0 AS")}, fi AS (SELECT * FROM fi0 WHERE file_type IN ('md', 'mdx', 'txt', 'rst')), {_SECTIONS}, {_PACKS}
SELECT path || '::' || (row_number() OVER (PARTITION BY path ORDER BY ord, i) - 1) AS chunk_id,
  'File: ' || path || CASE WHEN heading <> '' THEN ' | Section: ' || heading ELSE '' END || chr(10) || chr(10) || t AS text, nullif(heading, '') AS heading, count(*) OVER (PARTITION BY path) AS total_chunks FROM fin""",
    "imports_summary": f"""WITH {_IM}, i AS (SELECT src, 'src' || (b % 20) || '.doc_' || b AS raw FROM im),
l AS (SELECT raw, list(src ORDER BY src) AS o FROM i GROUP BY raw UNION ALL SELECT split_part(src, '/', 1), list(raw ORDER BY raw) FROM i GROUP BY 1) SELECT raw, {_suited("o")} AS summary FROM l""",
    "code_chunk_text": f"WITH {_CF} SELECT path, name, text FROM ct UNION ALL {_code_text()}",
    "code_chunks": f"WITH {_CF} SELECT path || '::' || ord AS chunk_id, text, language, ord::BIGINT AS chunk_index, total::BIGINT AS total_chunks, name AS unit_name, unit_type, signature, array_to_string(imports, ' ') AS imports FROM ct",
    "code_units": f"WITH {_CF} SELECT path, ord::BIGINT AS ord, name, unit_type, signature, docstring, line_start, line_end FROM cu UNION ALL SELECT path, ord::BIGINT AS ord, name, unit_type, signature, docstring, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM {_values(UNITS, 'path, ord, name, unit_type, signature, docstring, line_start, line_end')}",
    "code_imports": f"WITH {_CF} SELECT path, language, array_to_string(imports, ' ') AS imports, module_doc FROM cu WHERE ord = 0 UNION ALL SELECT * FROM {_values(PARSED, 'path, language, imports, module_doc')}",
    "resolve_python": f"""WITH {_IM}, rw AS (SELECT DISTINCT src, 'src' || (b % 20) || '.doc_' || b AS raw FROM im), rs AS (SELECT rw.src, rw.raw, dst FROM rw LEFT JOIN hit ON hit.src = rw.src AND hit.raw = rw.raw) {_resolved("python")}""",
    "resolve_js": f"WITH {_JS} {_resolved('javascript')}",
    "resolve_go": f"WITH {_GO} {_resolved('go')}",
    "import_edges": f"WITH {_IM} SELECT * FROM e",
    "links_after_changes": f"""WITH {_IM}, al AS (SELECT path FROM d UNION SELECT regexp_replace(path, '^(src|lib)/src', 'src') FROM d WHERE doc_id % 4 = 0 AND doc_id % 20 <> 0)
SELECT src, raw, arg_min(al.path, CASE root WHEN '' THEN 0 WHEN 'src/' THEN 1 ELSE 2 END) AS dst FROM cand JOIN al ON al.path = root || 'src' || (b % 20) || '/doc_' || b || '.py' GROUP BY src, raw""",
    "newest_versions": """SELECT conv_id, role, sha256(text) AS digest FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text IS NULL) = 1 AND text IS NOT NULL""",
    "edge_count": f"WITH {_IM} SELECT count(*) AS n_edges FROM e",
    "degree": f"WITH {_IM}, {_DEG} SELECT * FROM dg",
    "neighbours_depth1": f"WITH {_IM}, {_BOTH} SELECT path AS start, other AS path, 1::BIGINT AS hops FROM lk",
    "neighbours_depth2": f"""WITH {_IM}, {_BOTH}, w AS (SELECT path AS start, other AS path, 1 AS hops FROM lk UNION ALL SELECT a.path, b.other, 2 FROM lk a JOIN lk b ON a.other = b.path)
SELECT start, path, min(hops)::BIGINT AS hops FROM w WHERE start <> path GROUP BY start, path""",
    "connection_summary": f"""WITH {_IM}, o AS (SELECT src AS path, 'imports: ' || string_agg(dst, ', ' ORDER BY dst) AS x FROM e GROUP BY src), n AS (SELECT dst AS path, 'imported by: ' || string_agg(src, ', ' ORDER BY src) AS y FROM e GROUP BY dst)
SELECT path, coalesce(x || ' | ' || y, x, y, 'no resolved dependencies') AS summary FROM d LEFT JOIN o USING (path) LEFT JOIN n USING (path)""",
    "diagram_nodes": f"""WITH {_SHOWN.format(60)} SELECT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS directory, {_NODE.format("path")} AS node,
'"' || split_part(path, '/', -1) || '\\n+ load\\n+ Run"' AS label, 'py' AS style FROM sh""",
    "diagram_edges": f"WITH {_SHOWN.format(60)} SELECT DISTINCT {_NODE.format('src')} AS src_node, {_NODE.format('dst')} AS dst_node FROM e WHERE src IN (SELECT path FROM sh) AND dst IN (SELECT path FROM sh)",
    "diagram_groups": f"WITH {_SHOWN.format(60)} SELECT split_part(path, '/', 1) AS directory, string_agg(path, ',' ORDER BY path) AS files FROM sh GROUP BY 1",
    "mermaid_lines": f"""WITH {_SHOWN.format(60)}, dr AS (SELECT DISTINCT split_part(path, '/', 1) AS dir FROM sh),
li AS (SELECT 0 AS part, '' AS dir, 0 AS step, '' AS k, '%%{{init: {{"theme": "neutral"}}}}%%' AS line UNION ALL SELECT 1, '', 0, '', 'graph LR' UNION ALL
  SELECT 2, dir, 0, '', '    subgraph ' || {_NODE.format("dir")} || '["' || dir || '/"]' FROM dr UNION ALL SELECT 2, dir, 2, '', '    end' FROM dr UNION ALL
  SELECT 2, split_part(path, '/', 1), 1, path, '        ' || {_NODE.format("path")} || '["' || split_part(path, '/', -1) || '\\n+ load\\n+ Run"]:::py' FROM sh UNION ALL
  SELECT DISTINCT 3, '', 0, {_NODE.format("src")} || ' ' || {_NODE.format("dst")}, '    ' || {_NODE.format("src")} || ' --> ' || {_NODE.format("dst")} FROM e WHERE src IN (SELECT path FROM sh) AND dst IN (SELECT path FROM sh) UNION ALL
  SELECT 4, '', place, '', '    classDef ' || name || '  fill:' || fill || ',stroke:' || stroke || ',color:' || ink FROM {_values([(k, n, *c) for k, (n, c) in enumerate(COLOURS.items())], 'place, name, fill, stroke, ink')})
SELECT row_number() OVER (ORDER BY part, dir, step, k) AS place, line FROM li""",
    "graph_summary_lines": f"""WITH {_SUMMARY}
SELECT 'Repository summary: ' || (SELECT count(*) FROM al) || ' files total, ' || (SELECT count(*) FROM e) || ' resolved import relationships.' || chr(10) AS line UNION ALL
SELECT 'File: ' || path || chr(10) || '  Defines: load, Run' || chr(10) || coalesce('  Imports: ' || o.x || chr(10), '') || coalesce('  Imported by: ' || n.x || chr(10), '') FROM sh LEFT JOIN o USING (path) LEFT JOIN n USING (path)""",
    "ui_caption": f"WITH {_IM} SELECT (SELECT count(*) FROM d) AS n_files, (SELECT count(*) FROM e) AS n_edges",
}

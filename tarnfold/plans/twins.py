"""DuckDB SQL for the registered queries, written apart from them: the same columns and rows."""

from __future__ import annotations

from tarnfold.functions.text import SCRIPT_WORDS
from tarnfold.operators.loops import RETRY
from tarnfold.plans.corpus import GO_FILE, GO_PIECES, SCRIPT_FILE, SCRIPT_PIECES

_WORDS = ", ".join(f"'{w}'" for w in SCRIPT_WORDS)
PROMPT = "Compare the small ring with the hot gear, then look at the blue bolt."

# What the code files of ``corpus`` hold, by hand: kind, name, body, references in order of the alphabet.
_GO = (
    ("Struct", "T@", "// T@ holds {\ntype T@ struct {\n\tName string // }\n}", ""),
    ("Type", "ID@", "type ID@ = string", ""),
    ("Interface", "Doer@", "type Doer@ interface{ Do() error }", ""),
    ("Method", "T@.Run", 'func (t *T@) Run(n int) string { return helper("}{", n) }', "helper"),
    ("Function", "Make@", "// Make@ makes one.\nfunc Make@() *T@ {\n\treturn &T@{Name: `{`}\n}", "T@"),
)
_BOX = SCRIPT_FILE[: SCRIPT_FILE.index("\n\nexport const")]
_BOTH = "export const one@ = () => 1, two@ = async (x) => x, three@ = 3;"
_SCRIPT = (
    ("Class", "Box@", _BOX, "Box@ Symbol constructor drop get holds it iterator name odd size value"),
    ("Method", "Box@.constructor", "constructor(v) { this.value = v; }", "constructor value"),
    ("Method", "Box@.get size", "get size() { return 1; }", "get size"),
    ("Method", "Box@.delete", "delete(k) { return drop(k); }", "drop"),
    ("Method", "Box@.get", 'get(k) { return "}"; }', "get"),
    ("Method", "Box@.odd name", "async 'odd name'() { }", "name odd"),
    ("Method", "Box@.[Symbol.iterator]", "[Symbol.iterator]() { return it(); }", "Symbol it iterator"),
    ("Function", "one@", _BOTH, "one@ three@ two@"),
    ("Function", "two@", _BOTH, "one@ three@ two@"),
    ("Function", "log@", "function log@(a) { return a; }", "log@"),
)

_SHELF = SCRIPT_PIECES[3].split("\n")
_TYPE, _WIDE = SCRIPT_PIECES[5].split("interface")
# What the pieces hold, by hand: piece, kind, name, body.
_PIECES = (
    (0, "Function", "first~", SCRIPT_PIECES[0].split("\n")[2]),
    (1, "Function", "print~", SCRIPT_PIECES[1]),
    (2, "Function", "indented~", SCRIPT_PIECES[2].split("\nvar")[0].strip()),
    (2, "Function", "second~", "function second~() {}"),
    (3, "Class", "Shelf~", SCRIPT_PIECES[3]),
    (3, "Method", "Shelf~.find", _SHELF[3].strip()),
    (3, "Method", "Shelf~.get size", _SHELF[4].strip()),
    (4, "Function", "View~", SCRIPT_PIECES[4].split("\n")[0]),
    (4, "Function", "after~", SCRIPT_PIECES[4].split("\n")[1]),
    (5, "Type", "Shape~", _TYPE.strip()),
    (5, "Interface", "Wide~", ("interface" + _WIDE).split("\nenum")[0]),
)

_KINDS = GO_PIECES[2].split("\n")
_GO_MIXED = (
    (0, "Struct", "Shelf~", GO_PIECES[0], "Mutex"),
    (1, "Method", "Shelf~.Put~", GO_PIECES[1][GO_PIECES[1].index("func") :], "Point add any"),
    (2, "Type", "Kind~", "type Kind~ = int", ""),
    (2, "Struct", "List~", "type " + _KINDS[3].strip(), ""),
    (2, "Interface", "Doer~", "type " + _KINDS[4].strip(), "Context"),
    (3, "Function", "Make~", GO_PIECES[3].split("\n")[2], "Shelf~ Sprint fmt"),
    (3, "Function", "Other~", GO_PIECES[3].split("\n")[3], "done"),
)


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _coded(path: str, rows: tuple[tuple[str, str, str, str], ...]) -> str:
    """The chunks that every part's file has, the part's key for each @."""
    listed = ", ".join(f"({k}, {_sql(kind)}, {_sql(name)}, {_sql(body)}, {_sql(refs)})" for k, (kind, name, body, refs) in enumerate(rows))
    put = "replace({0}, '@', CAST(p_partkey AS VARCHAR))".format
    return f"""coded AS (SELECT {put(_sql(path))} AS path, CAST(k AS INT) AS ordinal, kind, {put("name")} AS name, md5({put("body")}) AS body, {put("refs")} AS refs
FROM part, (VALUES {listed}) AS c(k, kind, name, body, refs))"""


_CONV = r"""
conv AS (
  SELECT conv_id, 'conv/' || conv_id || '.md' AS path,
    CASE WHEN conv_id % 2 = 0 THEN '---' || chr(10) || 'title: c' || conv_id || chr(10) || '...' || chr(10) ELSE '' END
    || CASE WHEN conv_id % 3 = 0 THEN '# Top' || chr(10) ELSE 'Intro of ' || conv_id || '.' || chr(10) END
    || string_agg(
      CASE WHEN turn % 2 = 0 THEN '## ' || role || ' turn ##' ELSE '### ' || role || ' turn' END || chr(10)
      || CASE WHEN role = 'assistant' THEN '```' || chr(10) || '## fake' || chr(10) || text || chr(10) || '~~~' || chr(10)
         ELSE text || ' [a](conv/' || turn || '.md) [[role]] [x](#top) [u](https://e.example/)' || chr(10) END, '' ORDER BY turn, role, text) AS content
  FROM conversations GROUP BY conv_id
)"""

_REFS = r"""list_filter(list_concat(
      regexp_extract_all({0}, '!?\[[^\]]+\]\(([^)\s]+)', 1),
      regexp_extract_all({0}, '(?:\{{\{{\s*(?:include|>)\s+|\[\[)([^\}}\]\s]+)', 1)),
    lambda r: r <> '' AND NOT regexp_matches(r, '^(https?://|mailto:|#)'))"""


def _unique(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


_DOCS = "docs AS (SELECT doc_id, 'doc/' || source || '/' || doc_id || '.md' AS path, text AS content FROM documents)"
_PAGES = r"""pages_md AS (SELECT 'page/' || page_id || '.md' AS path, regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[\2](\1)', 'g') AS content FROM pages)"""
_SNAP = f"""{_DOCS}, files AS (SELECT path, 1000 AS mtime, sha256(content) AS hash FROM docs),
later AS (
  SELECT CASE WHEN doc_id % 10 = 3 THEN 'moved/' || path ELSE path END AS path, CASE WHEN doc_id % 10 < 2 THEN 1001 ELSE 1000 END AS mtime,
    sha256(CASE WHEN doc_id % 10 = 0 THEN content || '!' ELSE content END) AS hash
  FROM docs WHERE doc_id % 10 <> 2
), changed AS (
  SELECT l.path, CASE WHEN l.mtime = f.mtime THEN 'SKIP_MTIME' WHEN l.hash = f.hash THEN 'SKIP_HASH' ELSE 'PARSE' END AS status
  FROM later l LEFT JOIN files f USING (path)
), gone AS (SELECT * FROM files WHERE path NOT IN (SELECT path FROM later))"""
_VERSIONS = """old AS (
  SELECT 'conv/' || conv_id AS path, turn AS ordinal, role AS name, 'conv/' || conv_id || ':' || turn AS id,
    row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS occ FROM conversations
), new AS (
  SELECT 'conv/' || conv_id AS path, turn AS ordinal, role AS name,
    row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS occ FROM conversations WHERE turn % 3 <> 1
)"""
_PARTS = """rows AS (
  SELECT p_partkey AS id, p_name AS name, CAST(floor(p_partkey / 50) AS INT) AS shard, p_type AS kind, p_brand AS path FROM part
), refs AS (
  SELECT DISTINCT a.p_partkey AS id, b.p_name AS ref FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 OR b.p_partkey = a.p_partkey + 7
)"""
_VOTES = """votes AS (
  SELECT user_id AS chunk_id, CASE event_type WHEN 'purchase' THEN 'FULL' WHEN 'click' THEN 'SKELETON' WHEN 'signup' THEN 'SKELETON' ELSE 'IGNORE' END AS mode,
    CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'signup' THEN 1 ELSE 0 END AS rank, event_type AS reason, event_id AS seq
  FROM events
), merged AS (
  SELECT chunk_id, mode, reason FROM votes QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY rank DESC, seq) = 1
), covered AS (
  SELECT * FROM merged UNION ALL SELECT c_custkey, 'IGNORE', 'no decision' FROM customer WHERE c_custkey NOT IN (SELECT chunk_id FROM merged)
)"""
_BLOCKS = """shown AS (
  SELECT 'c"' || conv_id AS path, turn, conv_id || '-' || turn AS id, role, '// x' || chr(10) || text AS body,
    CASE turn % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'SKELETON' ELSE 'IGNORE' END AS mode,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: ltrim(x, ' ' || chr(9))), lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '/*') AND NOT starts_with(x, '*')) AS code
  FROM conversations
), parts AS (
  SELECT *, CASE mode WHEN 'FULL' THEN body WHEN 'SKELETON' THEN coalesce(code[1], '// x') END AS what FROM shown
), blocks AS (
  SELECT path, count(*) AS chunks, count(*) FILTER (mode = 'FULL') AS "full", count(*) FILTER (mode = 'SKELETON') AS skeleton, count(*) FILTER (mode = 'IGNORE') AS ignored,
    string_agg(CASE WHEN mode = 'IGNORE' THEN '[chunk ' || id || ' IGNORED]' || chr(10)
      ELSE '[chunk ' || id || ' ' || mode || ': Section ' || role || ']' || chr(10) || what || CASE WHEN ends_with(what, chr(10)) THEN '' ELSE chr(10) END || '[/chunk ' || id || ']' || chr(10) END, '' ORDER BY turn, id) AS body
  FROM parts GROUP BY path
)"""
_RECORDS = """calls AS (
  SELECT user_id AS round, event_id AS seq, event_type AS tool, CASE event_type WHEN 'error' THEN 'conflict' WHEN 'view' THEN 'noop' ELSE 'applied' END AS outcome,
    json_extract_string(props, '$.k') AS message, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS call
  FROM events
), rolled AS (
  SELECT round, bool_and(outcome <> 'conflict') AS all_ok, bool_or(outcome = 'conflict') AS any_failure, count(*) FILTER (outcome = 'conflict') AS failed, count(*) AS calls,
    string_agg('[' || call || '] ' || CASE outcome WHEN 'conflict' THEN 'FAILED' ELSE 'OK' END || ' ' || tool || ': outcome=' || outcome || '; message=' || coalesce(message, '') || chr(10), '' ORDER BY call) AS summary
  FROM calls GROUP BY round
)"""
_CHECKS = """metrics AS (
  SELECT user_id AS task, CAST(event_id % 3 AS INT) AS round, event_id AS seq, 'm' || event_id AS name,
    CASE WHEN event_type = 'error' THEN 'FAIL' WHEN event_type = 'view' AND value > 40 THEN 'ERROR' ELSE 'PASS' END AS status,
    CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') END AS detail
  FROM events
), checks AS (
  SELECT c_custkey AS task, r AS round, c_acctbal > 0 AS passed, CASE WHEN r > 0 THEN ' ' || c_mktsegment || chr(10) END AS diag
  FROM customer, (SELECT unnest([0, 1, 2]) AS r)
), lines AS (
  SELECT task, round, string_agg('  - ' || name || ': ' || status || CASE WHEN coalesce(detail, '') <> '' THEN ' (' || detail || ')' ELSE '' END || chr(10), '' ORDER BY seq) AS lines
  FROM metrics GROUP BY ALL
), told AS (
  SELECT c.task, c.round, c.diag, '<round n="' || c.round || '">' || chr(10) || CASE WHEN lines IS NOT NULL THEN 'metrics:' || chr(10) || lines ELSE '' END
    || CASE WHEN coalesce(diag, '') <> '' THEN 'diag:' || chr(10) || trim(diag, ' ' || chr(10)) || chr(10) ELSE '' END || '</round>' AS block
  FROM checks c LEFT JOIN lines l USING (task, round)
)"""
_SESSIONS = """kept AS (
  SELECT 's' || user_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, props AS summary FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) DESC, props DESC) = 1
)"""
_TEXTS = """d AS (
  SELECT doc_id, substr(text, 1, 10) || repeat(chr(10), 3) || substr(text, 11, 20) || repeat(chr(10), 3) || text AS content, chr(10) || substr(text, 11, 20) || '  ' AS body FROM documents
)"""

SQL = {
    "corpus_scan_report": f"""WITH {_CONV}, {_DOCS}, {_PAGES},
every AS (SELECT path, content FROM conv UNION ALL SELECT path, content FROM docs UNION ALL SELECT path, content FROM pages_md)
SELECT string_split(path, '/')[1] AS folder, count(*) AS files,
  count(*) FILTER (regexp_matches(lower(path), '\\.(go|ts|tsx|js|jsx|md|markdown)$') AND NOT regexp_matches(path, '(^|/)(\\.[^/]*|node_modules|vendor|dist|build)/')) AS taken,
  CAST(sum(length(content)) AS BIGINT) AS chars FROM every GROUP BY 1""",
    "md_sections": rf"""WITH {_CONV},
l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM conv),
front AS (
  SELECT path, CASE WHEN bool_or(i = 1 AND trim(line) = '---') THEN coalesce(min(i) FILTER (i > 1 AND trim(line) IN ('---', '...')), 0) ELSE 0 END AS last FROM l GROUP BY path
), f AS (
  SELECT l.*, last, i > last AND regexp_matches(line, '^\s*(```|~~~)') AS fence FROM l JOIN front USING (path)
), p AS (
  SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY path ORDER BY i) % 2 AS inside, length(regexp_extract(rtrim(line, ' ' || chr(9)), '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 1)) AS level FROM f
), h AS (
  SELECT *, i > last AND NOT fence AND inside = 0 AND level BETWEEN 1 AND 2 AS cut FROM p
), s AS (
  SELECT *, CASE WHEN i <= last THEN -1 ELSE sum(CAST(cut AS INT)) OVER (PARTITION BY path ORDER BY i) END AS sec FROM h
), g AS (
  SELECT path, sec, string_agg(line, chr(10) ORDER BY i) AS body, min_by(line, i) AS head FROM s GROUP BY path, sec
), k AS (
  SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY sec) - 1 AS INT) AS ordinal,
    CASE sec WHEN -1 THEN 'Frontmatter' WHEN 0 THEN 'Preamble' ELSE 'Section' END AS kind,
    CASE sec WHEN -1 THEN 'frontmatter' WHEN 0 THEN 'preamble' ELSE regexp_extract(rtrim(head, ' ' || chr(9)), '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 2) END AS name,
    body, CASE WHEN sec = -1 THEN [] ELSE {_REFS.format("body")} END AS found
  FROM g WHERE sec <> 0 OR regexp_matches(body, '\S')
)
SELECT path, ordinal, kind, name, body, array_to_string({_unique("found")}, ' ') AS refs FROM k""",
    "md_refs": f"""WITH {_PAGES}, r AS (SELECT path, {_REFS.format("content")} AS found FROM pages_md), u AS (SELECT path, {_unique("found")} AS refs FROM r)
SELECT path, CAST(len(refs) AS INT) AS n_refs, array_to_string(refs, ' ') AS refs FROM u""",
    "script_refs": rf"""WITH {_PAGES}, r AS (SELECT path, list_filter(regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$]*'), lambda w: length(w) >= 2 AND w NOT IN
  ({_WORDS})) AS found FROM pages_md),
w AS (SELECT path, unnest(found) AS word, generate_subscripts(found, 1) AS i FROM r),
u AS (SELECT path, word, min(i) AS i FROM w GROUP BY ALL)
SELECT path, CAST(count(*) AS INT) AS n_refs, string_agg(word, ' ' ORDER BY i) AS refs FROM u GROUP BY path""",
    "chunk_signature": """WITH b AS (
  SELECT conv_id, turn, role, '  // ' || role || chr(10) || chr(10) || '* ' || role || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(9) || ' ' || text ELSE '' END AS body FROM conversations
), l AS (SELECT *, list_transform(string_split(body, chr(10)), lambda x: ltrim(x, ' ' || chr(9))) AS lines FROM b)
SELECT conv_id, turn, coalesce(
  list_filter(lines, lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '/*') AND NOT starts_with(x, '*'))[1], list_filter(lines, lambda x: x <> '')[1], '') AS signature,
  conv_id || '::' || role AS qualified FROM l""",
    "incremental_status": f"WITH {_SNAP} SELECT path, status FROM changed",
    "prune_deleted": f"WITH {_SNAP} SELECT path, hash FROM gone",
    "index_report": f"""WITH {_SNAP} SELECT count(*) AS scanned, count(*) FILTER (status <> 'PARSE') AS skipped, count(*) FILTER (status = 'PARSE') AS indexed, CAST(0 AS BIGINT) AS failed,
  (SELECT count(*) FROM gone) AS deleted, count(*) FILTER (status = 'PARSE') AS chunks FROM changed""",
    "stable_id_match": f"WITH {_VERSIONS} SELECT n.path, n.name, n.ordinal, n.occ, o.id AS old_id FROM new n LEFT JOIN old o USING (path, name, occ)",
    "evicted_ids": f"""WITH {_VERSIONS} SELECT o.path, o.name, o.ordinal, o.id FROM old o LEFT JOIN new n USING (path, name, occ)
WHERE n.path IS NULL AND o.path IN (SELECT path FROM new)""",
    "upserted_chunks": """SELECT 'conv/' || conv_id AS path, count(*) FILTER (conv_id % 2 = 1 OR turn % 3 <> 1 OR NOT has) AS n, count(*) FILTER (conv_id % 2 = 0 AND turn % 3 <> 1) AS n_new
FROM (SELECT *, bool_or(turn % 3 <> 1) OVER (PARTITION BY conv_id) AS has FROM conversations) GROUP BY conv_id""",
    "triage_shards": """SELECT shard, count(*) AS n, min(conv_id) AS first_conv, max(conv_id) AS last_conv FROM (
  SELECT conv_id, CAST((row_number() OVER (ORDER BY conv_id, turn, role) - 1) // 50 AS INT) AS shard FROM conversations) GROUP BY shard""",
    "rule_triage": f"""WITH {_PARTS}, f AS (SELECT *, contains(lower('{PROMPT}'), lower(name)) AS hit FROM rows),
wanted AS (SELECT DISTINCT shard, lower(ref) AS low FROM f JOIN refs USING (id) WHERE hit)
SELECT id AS chunk_id, CASE WHEN hit THEN 'FULL' WHEN low IS NOT NULL THEN 'SKELETON' ELSE 'IGNORE' END AS mode,
  CASE WHEN hit THEN 'named in the prompt' WHEN low IS NOT NULL THEN 'referenced by a full chunk' ELSE '' END AS reason
FROM f LEFT JOIN wanted w ON w.shard = f.shard AND w.low = lower(f.name)""",
    "shard_listing": f"WITH {_PARTS} SELECT shard, string_agg(id || ' | ' || kind || ' | ' || name || ' | ' || path || ' | ' || name, chr(10) ORDER BY path, id) AS lines FROM rows GROUP BY shard",
    "decision_merge": f"WITH {_VOTES} SELECT * FROM merged",
    "coverage_default": f"WITH {_VOTES} SELECT * FROM covered",
    "decision_histogram": f"WITH {_VOTES} SELECT mode, count(*) AS n FROM covered GROUP BY mode",
    "expand_upgrade": f"""WITH {_VOTES} SELECT chunk_id, CASE WHEN up THEN 'FULL' ELSE mode END AS mode, CASE WHEN up THEN 'expanded' ELSE reason END AS reason
FROM (SELECT v.*, coalesce(mode = 'SKELETON' AND c_acctbal > 0, false) AS up FROM covered v LEFT JOIN customer ON c_custkey = chunk_id)""",
    "context_file_blocks": f"""WITH {_BLOCKS} SELECT path, chunks, "full", skeleton, ignored,
  '<file path="' || replace(path, '"', chr(92) || '"') || '" chunks="' || chunks || '" full="' || "full" || '" skeleton="' || skeleton || '" ignored="' || ignored || '">' || chr(10) || body || '</file>' || chr(10) AS block FROM blocks""",
    "context_totals": f"""WITH {_BLOCKS} SELECT count(*) AS files, CAST(sum("full") AS BIGINT) AS "full", CAST(sum(skeleton) AS BIGINT) AS skeleton, CAST(sum(ignored) AS BIGINT) AS ignored FROM blocks""",
    "apply_outcomes": """SELECT CAST(doc_id AS INT) AS seq, CASE doc_id % 12 WHEN 0 THEN 'applied' WHEN 1 THEN 'conflict' WHEN 2 THEN 'location' WHEN 3 THEN 'applied' WHEN 4 THEN 'location' WHEN 5 THEN 'applied'
  WHEN 6 THEN 'conflict' WHEN 7 THEN 'applied' WHEN 8 THEN 'conflict' WHEN 9 THEN 'applied' WHEN 10 THEN 'noop' ELSE 'conflict' END AS outcome FROM documents""",
    "splice_modify": f"""WITH {_TEXTS}, f AS (SELECT *, trim(body, ' ' || chr(10)) AS bare, CAST(strpos(content, body) AS INT) AS exact FROM d),
g AS (SELECT *, CASE WHEN exact = 0 AND bare <> '' THEN CAST(strpos(content, bare) AS INT) ELSE exact END AS found, CASE WHEN exact = 0 AND bare <> '' THEN length(bare) ELSE length(body) END AS size FROM f)
SELECT doc_id, found, md5(CASE WHEN found > 0 THEN substr(content, 1, found - 1) || '<new>' || substr(content, found + size) ELSE content END) AS after FROM g""",
    "splice_delete": f"""WITH {_TEXTS}, c AS (SELECT doc_id, substr(content, 1, 13) AS a, substr(content, 14 + greatest(0, least(20, length(content) - 13))) AS b FROM d)
SELECT doc_id, md5(
  rtrim(a, chr(10)) || CASE WHEN ends_with(a, chr(10)) AND rtrim(a, chr(10)) <> '' THEN chr(10) ELSE '' END
  || CASE WHEN starts_with(b, chr(10)) AND ltrim(b, chr(10)) <> '' THEN chr(10) ELSE '' END || ltrim(b, chr(10))) AS after FROM c""",
    "append_chunk": """SELECT doc_id, md5(CASE WHEN body = '' THEN '' ELSE rtrim(body, chr(10)) || chr(10) || chr(10) END || '## Added' || chr(10)) AS after
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text || repeat(chr(10), CAST(doc_id % 4 AS INT)) END AS body FROM documents)""",
    "file_languages": """WITH p AS (
  SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'vendor/' WHEN 1 THEN '.hidden/' WHEN 2 THEN 'src/' ELSE '' END || replace(p_name, ' ', '_')
    || ['.go', '.TS', '.tsx', '.js', '.jsx', '.md', '.markdown', '.py'][p_partkey % 8 + 1] AS path, p_size FROM part)
SELECT p_partkey, path, CASE WHEN ends_with(path, '.go') THEN 'go' WHEN regexp_matches(lower(path), '\\.(ts|tsx|js|jsx)$') THEN 'script' WHEN regexp_matches(path, '\\.(md|markdown)$') THEN 'markdown' ELSE 'unknown' END AS language,
  NOT ends_with(path, '.py') AS supported, p_size % 4 >= 2 AS visible FROM p""",
    "round_rollup": f"WITH {_RECORDS} SELECT round, all_ok, any_failure, failed, calls, md5(summary) AS summary FROM rolled",
    "retry_prompts": f"""WITH {_RECORDS} SELECT round, md5('task' || chr(10) || chr(10) || '<previous_attempt round="' || round || '">' || chr(10)
  || '{RETRY}' || chr(10) || rtrim(summary, chr(10)) || chr(10) || '</previous_attempt>') AS prompt
FROM rolled WHERE any_failure""",
    "verify_verdict": f"""WITH {_CHECKS}, per AS (
  SELECT task, round, bool_and(status = 'PASS') AS ok, count(*) AS n, count(*) FILTER (status = 'PASS') AS p, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'ERROR') AS e FROM metrics GROUP BY ALL)
SELECT task, round, coalesce(ok, passed) AS passed, coalesce(n, 0) AS n_metrics, coalesce(p, 0) AS n_pass, coalesce(f, 0) AS n_fail, coalesce(e, 0) AS n_error FROM checks LEFT JOIN per USING (task, round)""",
    "history_blocks": f"WITH {_CHECKS} SELECT task, round, md5(block) AS block FROM told",
    "task_prompts": f"""WITH {_CHECKS} SELECT t.task, t.round, md5('Task ' || t.task || CASE WHEN t.round = 1
    THEN chr(10) || chr(10) || '<initial_verification>' || chr(10) || trim(t.diag, ' ' || chr(10)) || chr(10) || '</initial_verification>'
    ELSE chr(10) || chr(10) || '<previous_rounds>' || chr(10) || (SELECT string_agg(e.block || chr(10), '' ORDER BY e.round) FROM told e WHERE e.task = t.task AND e.round < t.round) || '</previous_rounds>' END) AS prompt
FROM told t WHERE t.round > 0""",
    "audit_metrics": """SELECT event_id, CAST(0 AS INT) AS seq, 's' || user_id AS name, ['PASS', 'FAIL', 'PARTIAL', 'INFRA', 'FAIL'][event_id % 5 + 1] AS status,
  'score=' || CAST(floor(value) AS BIGINT) || CASE WHEN event_type = 'error' THEN '; seen' ELSE '' END AS detail FROM events WHERE event_id % 7 <> 0""",
    "audit_causes": "SELECT event_id, CAST(0 AS INT) AS seq, 'i' || event_id AS issue, 't' AS target, 'f' AS file FROM events WHERE event_id % 7 <> 0",
    "audit_exit_codes": """SELECT event_id, CAST(event_id % 5 IN (1, 3, 4) OR (event_id % 5 = 2 AND user_id IN (SELECT c_custkey FROM customer)) AS INT) AS code FROM events WHERE event_id % 7 <> 0""",
    "unanswered_requests": "SELECT c_custkey AS path, 'no response' AS error FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "insight_filter": r"""WITH i AS (SELECT doc_id, ' ' || chr(10) || text || chr(9) || ' ' AS insight FROM documents UNION ALL SELECT doc_id, ' ' || chr(10) || chr(9) || ' ' FROM documents WHERE doc_id % 9 = 0),
t AS (SELECT doc_id, regexp_replace(insight, '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g') AS insight FROM i)
SELECT doc_id, md5(insight) AS insight FROM t WHERE insight <> ''""",
    "list_and_indent": r"""WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, CAST(len(parts) AS INT) AS n_parts, md5(array_to_string(parts, '|')) AS parts,
  md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN x ELSE '> ' || x END), chr(10))) AS quoted FROM d""",
    "session_topk": f"WITH {_SESSIONS} SELECT * FROM kept ORDER BY ts DESC, id LIMIT 5",
    "history_layer": f"""WITH {_SESSIONS}, top AS (SELECT * FROM kept ORDER BY ts DESC, id LIMIT 5)
SELECT '<session_history count="' || count(*) || '">' || chr(10) || string_agg('<session id="' || id || '" ts="' || ts || '">' || chr(10) || summary || chr(10) || '</session>' || chr(10), '' ORDER BY ts DESC, id) || '</session_history>' AS text FROM top""",
    "session_latest": f"WITH {_SESSIONS} SELECT * FROM kept",
    "scenario_expectation": """WITH v AS (SELECT user_id AS scenario, CASE WHEN max(value) FILTER (event_type = 'error') > 60 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM events GROUP BY 1)
SELECT c_custkey AS scenario, 'PASS' AS wanted, verdict, CASE WHEN verdict IS NULL THEN 'MISSING' WHEN verdict = 'PASS' THEN 'MATCH' ELSE 'MISMATCH' END AS state FROM customer LEFT JOIN v ON scenario = c_custkey""",
    "archive_json": """SELECT CASE WHEN event_id % 2 = 0 THEN 'fix' ELSE 'task' END || '-' || strftime(ts, '%Y%m%d-%H%M%S') AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
  '{"description":"' || event_type || '"' || CASE WHEN event_id % 3 > 0 THEN ',"metrics":{"m' || event_id || '":{' || coalesce('"detail":"' || (props ->> '$.k') || '",', '') || '"status":"' || CASE event_type WHEN 'error' THEN 'FAIL' ELSE 'PASS' END || '"}}' ELSE '' END
  || ',"outcome":"verify-passed","passed":' || CASE WHEN event_type <> 'error' THEN 'true' ELSE 'false' END || CASE WHEN event_id % 5 = 0 THEN ',"reflections":["saw ' || event_type || '","a \\"quote\\""]' ELSE '' END
  || ',"rounds":3' || CASE WHEN event_id % 2 = 0 THEN ',"tag":"fix"' ELSE '' END || '}' AS summary FROM events""",
    "go_chunks": f"WITH {_coded('go/p@.go', _GO)} SELECT * FROM coded",
    "tree_listing": """SELECT source || '/n' || doc_id % 7 || '/' || CASE doc_id % 4 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END || doc_id || CASE doc_id % 3 WHEN 1 THEN '.MD' ELSE '.md' END AS path, '.md' AS ext, md5(coalesce(text, '')) AS content
FROM documents WHERE doc_id % 10 > 1 AND doc_id % 3 > 0""",
    "note_files": """SELECT 'session' AS what, c_name AS name, c_custkey AS ts, c_mktsegment AS text FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT 'skill', n_name, NULL, 'Know ' || n_name || '.' || chr(10) FROM nation""",
    "engine_edits": f"""WITH k AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 <> 0), c(place, kind, name, body) AS (VALUES {", ".join(f"({k}, '{kind}', '{name}', {_sql(body)})" for k, (kind, name, body, _) in enumerate((*_GO[:4], ("Function", "Make@", "func Make@() {}", ""), ("Function", "Added@", "func Added@() {}", ""))))})
SELECT 'go/p' || k || '.go' AS path, CAST(place AS INT) AS ordinal, kind, replace(name, '@', CAST(k AS VARCHAR)) AS name, md5(replace(body, '@', CAST(k AS VARCHAR))) AS body, place < 5 AS same_id, TRUE AS applied FROM k, c""",
    "skill_texts": """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'nameless' ELSE array_to_string(list_transform(string_split(p_name, ' ')[:3], lambda w, i: (i - 1) || '="' || w || '"'), ', ') END || ' of ' || p_brand
  || CASE WHEN p_size > 30 THEN ' large' WHEN p_size > 10 THEN ' middle' ELSE ' small' END || ' ' || printf('%.2f|%04d|%-6s|', p_retailprice, p_size, 'to') || ' map[high:' || p_size + 1 || ' low:' || p_size - 1 || '] ' || p_size - 1 || ' <no value> ' || length(p_type) AS text,
  CAST(NULL AS VARCHAR) AS error FROM part""",
    "retry_runs": f"""WITH calls AS (SELECT user_id AS task, event_id % 3 + 1 AS round, event_id AS seq, event_type AS tool, CASE event_type WHEN 'error' THEN 'conflict' WHEN 'view' THEN 'noop' ELSE 'applied' END AS outcome, props ->> '$.k' AS message,
  user_id % 29 = 0 AND event_id % 3 = 1 AS broken FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY task, round ORDER BY seq) AS i FROM calls WHERE NOT broken),
per AS (SELECT task, round, bool_or(broken) AS broken, count(*) FILTER (WHERE NOT broken) AS n, coalesce(bool_and(outcome <> 'conflict') FILTER (WHERE NOT broken), TRUE) AS good FROM calls GROUP BY ALL),
told AS (SELECT task, round, string_agg('[' || i || '] ' || CASE WHEN outcome = 'conflict' THEN 'FAILED' ELSE 'OK' END || ' ' || tool || ': outcome=' || outcome || '; message=' || coalesce(message, ''), chr(10) ORDER BY seq) AS lines FROM numbered GROUP BY ALL),
whole AS (SELECT t.task, v.r, coalesce(p.good, TRUE) AND NOT coalesce(p.broken, FALSE) AS good, coalesce(p.broken, FALSE) AS broken, coalesce(p.n, 0) AS n, coalesce(told.lines, '') AS lines
  FROM (SELECT DISTINCT task FROM calls) t CROSS JOIN (VALUES (1), (2), (3)) AS v(r) LEFT JOIN per p ON p.task = t.task AND p.round = v.r LEFT JOIN told ON told.task = t.task AND told.round = v.r),
ends AS (SELECT task, coalesce(min(r) FILTER (WHERE good OR broken), 3) AS rounds FROM whole GROUP BY task)
SELECT e.task, CAST(e.rounds AS INT) AS rounds, bool_or(w.good) FILTER (WHERE w.r = e.rounds) AS success, CAST(sum(w.n) AS BIGINT) AS calls,
  md5('Task ' || e.task || coalesce(string_agg(chr(10) || chr(10) || '<previous_attempt round="' || w.r || '">' || chr(10) || {_sql(RETRY)} || chr(10) || w.lines || chr(10) || '</previous_attempt>', '' ORDER BY w.r) FILTER (WHERE w.r < e.rounds), '')) AS prompt
FROM ends e JOIN whole w ON w.task = e.task AND w.r <= e.rounds GROUP BY e.task, e.rounds""",
    "verify_runs": f"""WITH {_CHECKS}, per AS (SELECT task, round, bool_and(status = 'PASS') AS ok FROM metrics GROUP BY ALL),
v AS (SELECT task, round AS k, coalesce(ok, passed AND round = 2) AS good, task % 13 = 0 AND round = task % 2 AS bad, round = 1 + task % 2 AS turn FROM checks LEFT JOIN per USING (task, round)),
s AS (SELECT task, k, CASE WHEN k = 0 THEN CASE WHEN bad THEN 'initial-verify-error' WHEN good THEN 'noop-initial-passed' END WHEN turn AND task % 23 = 0 THEN 'ctx-cancelled' WHEN turn AND task % 17 = 0 THEN 'llm-error'
  WHEN turn AND task % 19 = 0 THEN 'hook-error' WHEN bad THEN 'verify-error' WHEN good THEN 'verify-passed' WHEN k = 2 THEN 'max-rounds-exhausted' END AS outcome FROM v),
e AS (SELECT task, min(k) AS k, arg_min(outcome, k) AS outcome FROM s WHERE outcome IS NOT NULL GROUP BY task),
b AS (SELECT e.task, md5(string_agg(block, chr(10) ORDER BY round)) AS told FROM e JOIN told ON told.task = e.task AND round > 0 AND (round < k OR round = k AND outcome IN ('verify-passed', 'max-rounds-exhausted')) GROUP BY e.task)
SELECT e.task, outcome, outcome IN ('noop-initial-passed', 'verify-passed') AS passed, CAST(CASE outcome WHEN 'ctx-cancelled' THEN k - 1 ELSE k END AS INT) AS rounds,
  CASE WHEN outcome IN ('initial-verify-error', 'verify-error') THEN 'unverifiable' WHEN outcome IN ('llm-error', 'hook-error') THEN 'down' END AS error, told FROM e LEFT JOIN b USING (task)""",
    "context_rows": f"""WITH {_BLOCKS}, whole AS (SELECT path, '<file path="' || replace(path, '"', chr(92) || '"') || '" chunks="' || chunks || '" full="' || "full" || '" skeleton="' || skeleton || '" ignored="' || ignored || '">' || chr(10) || body || '</file>' || chr(10) || chr(10) AS text FROM blocks)
SELECT CAST(0 AS BIGINT) AS number, md5('<context files="' || count(*) || '" full="' || sum("full") || '" skeleton="' || sum(skeleton) || '" ignored="' || sum(ignored) || '">' || chr(10)) AS text FROM blocks
UNION ALL SELECT row_number() OVER (ORDER BY path), md5(text) FROM whole UNION ALL SELECT count(*) + 1, md5('</context>' || chr(10)) FROM blocks""",
    "chunk_ids": "SELECT p_partkey, translate(to_base64(unhex(printf('%06X', CAST((p_partkey * 7919 % 16777216 * 10368889 + 335637) % 16777216 AS BIGINT)))), '+/', '-_') AS id FROM part",
    "skills_layer": """SELECT '<task_skills count="' || count(*) || '">' || chr(10) || string_agg('<skill name="' || c_mktsegment || ' ' || c_custkey || '">' || chr(10) || 'Ask for ' || c_name || '.' || chr(10) || '</skill>' || chr(10), '' ORDER BY c_mktsegment || ' ' || c_custkey) || '</task_skills>' AS text
FROM customer WHERE c_custkey % 50 = 0""",
    "catalog_delete": f"WITH {_VERSIONS} SELECT path, ordinal, id FROM old WHERE path NOT IN (SELECT path FROM old WHERE ordinal = 5)",
    "answered_requests": "SELECT c_custkey AS path, c_name AS asked, count(*) AS chunks FROM customer JOIN events ON user_id = c_custkey GROUP BY ALL",
    "chunk_views": f"""WITH {_BLOCKS} SELECT id, 'Section' AS kind, role AS name, path, md5(coalesce(code[1], '// x')) AS signature, role AS refs FROM shown""",
    "joined_sections": "SELECT conv_id, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (turn % 3 <> 1 AND text <> ''), '')) AS text FROM conversations GROUP BY conv_id",
    "error_positions": """SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN greatest(p_size - 1, 1) END AS line, CAST(CASE WHEN p_partkey % 4 > 0 THEN 7 END AS INT) AS col,
  CASE WHEN p_partkey % 4 > 0 THEN 'expected ' ELSE '' END || p_name AS message FROM part""",
    "go_mixed": f"""WITH pieces(place, piece, kind, name, body, refs) AS (VALUES {", ".join(f"({k}, {p}, '{kind}', '{name}', {_sql(body)}, '{refs}')" for k, (p, kind, name, body, refs) in enumerate(_GO_MIXED))})
SELECT 'go/m' || p_partkey || '.go' AS path, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY place) - 1 AS INT) AS ordinal, kind, replace(name, '~', CAST(p_partkey AS VARCHAR)) AS name,
  md5(replace(replace(body, '~', CAST(p_partkey AS VARCHAR)), '%', p_name)) AS body, replace(refs, '~', CAST(p_partkey AS VARCHAR)) AS refs
FROM part JOIN pieces ON ((p_partkey >> piece) & 1) = 0""",
    "script_mixed": f"""WITH pieces(place, piece, kind, name, body) AS (VALUES {", ".join(f"({k}, {p}, '{kind}', '{name}', {_sql(body)})" for k, (p, kind, name, body) in enumerate(_PIECES))})
SELECT 'script/m' || p_partkey || '.tsx' AS path, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY place) - 1 AS INT) AS ordinal, kind, replace(name, '~', CAST(p_partkey AS VARCHAR)) AS name,
  md5(replace(replace(body, '~', CAST(p_partkey AS VARCHAR)), '%', p_name)) AS body
FROM part JOIN pieces ON ((p_partkey >> piece) & 1) = 0""",
    "script_chunks": f"WITH {_coded('script/p@.ts', _SCRIPT)} SELECT * FROM coded",
    "code_edits": f"""WITH f AS (SELECT p_partkey AS k, replace({_sql(GO_FILE)}, '@', CAST(p_partkey AS VARCHAR)) AS content FROM part)
SELECT CAST(k AS INT) AS seq, 'go/p' || k || '.go' AS path, CASE k % 3 WHEN 0 THEN 'applied' ELSE 'validation' END AS outcome, CAST(CASE k % 3 WHEN 0 THEN 1 ELSE 0 END AS INT) AS n_affected,
  md5(CASE k % 3 WHEN 0 THEN replace(content, replace({_sql(_GO[-1][2])}, '@', CAST(k AS VARCHAR)), 'func Made() {{}}') ELSE content END) AS content FROM f""",
    "named_blocks": f"""WITH {_BLOCKS.replace("ORDER BY turn, id", "ORDER BY role, turn, id")} SELECT path, chunks,
  md5('<file path="' || replace(path, '"', chr(92) || '"') || '" chunks="' || chunks || '" full="' || "full" || '" skeleton="' || skeleton || '" ignored="' || ignored || '">' || chr(10) || body || '</file>' || chr(10)) AS block FROM blocks""",
    "metric_statuses": f"""WITH {_CHECKS}, per AS (SELECT task, round, status, count(*) AS n FROM metrics GROUP BY ALL)
SELECT task, round, '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' AS counts FROM per GROUP BY ALL""",
    "chunk_kinds": "SELECT CASE event_type WHEN 'click' THEN 'Class' WHEN 'view' THEN 'Preamble' ELSE 'Type' END AS kind, count(*) AS n FROM events GROUP BY 1",
}

"""SQL that gives the results of the core's queries on the same tables, for DuckDB."""

from __future__ import annotations

from loomdex.config import ABBREVIATIONS, INFERENCE_PHRASES, NOISE_PATTERNS, STOPWORDS, TERMS

_HASH = "regexp_replace(lower(trim(file_hash)), '^sha256:', '')"
_ONCE = """once AS (SELECT chunk_id, max(content) AS content, max(file_path) AS file_path, max(file_name) AS file_name, max(page_start) AS page_start,
    max(chunk_index) AS chunk_index, max(doc_id) AS doc_id, max(section_path) AS section_path, max(chunk_type) AS chunk_type, max(parent_chunk_id) AS parent_chunk_id
    FROM chunks WHERE NOT is_parent GROUP BY chunk_id)"""
_LAST = f"""last AS (SELECT file_path, CASE WHEN coalesce(lower(trim(status)) = 'done', false) THEN {_HASH} END AS done_hash FROM
    (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY coalesce(indexed_at, '-infinity'::DOUBLE) DESC) AS rn FROM manifest WHERE file_path IS NOT NULL) WHERE rn = 1)"""
_WS = "\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{b}"


def _tokens(x: str) -> str:
    c = f"length(regexp_replace({x}, '[^\\x{{4e00}}-\\x{{9fff}}]+', '', 'g'))"
    return f"CAST(floor({c} + (length({x}) - {c}) * 0.25) AS INTEGER)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _norm_key(x: str) -> str:
    return _strip(f"regexp_replace(regexp_replace(lower({x}), '\\p{{Nd}}+', '#', 'g'), '[ \\t]+', ' ', 'g')")


def _noise(x: str) -> str:
    q = lambda p: p.replace("'", "''")
    return f"(length({_strip(x)}) > 0 AND (" + " OR ".join(f"regexp_matches({_strip(x)}, '{q(p)}', 'i')" for p in NOISE_PATTERNS) + "))"


def _scrub(x: str) -> str:
    t = f"regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffd}}]', '', 'g')"
    t = f"regexp_replace(replace({t}, chr(160), ' '), '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g')"
    t = f"array_to_string(list_transform(string_split({t}, chr(10)), lambda y: {_strip("regexp_replace(y, '[ \\t]+', ' ', 'g')")}), chr(10))"
    return _strip(f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array(text, '\\n[{_WS}]*\\n'), lambda p: {_strip('p')}), lambda p: length(p) > 0)"
_WORDS = "regexp_extract_all(regexp_replace(lower({0}), '([\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+|[\\x{{3040}}-\\x{{30ff}}]')"
_ENGLISH = "list_transform(list_filter(regexp_extract_all(question, '[A-Za-z0-9][A-Za-z0-9_\\-.]*'), lambda t: length(t) >= 2), lambda t: lower(t))"
_FIRSTS = "SELECT query_id, token, min(n) AS n FROM (SELECT id AS query_id, unnest({0}) AS token, unnest(range(len({0}))) AS n FROM eval_cases) GROUP BY query_id, token"


def _bm25(name: str, column: str, k: int) -> str:
    """CTEs that end in ``name`` (query_id, id, score, rank): BM25 of a text column of eval_cases over children."""
    return f"""
    {name}_q AS (SELECT DISTINCT query_id, term FROM (SELECT id AS query_id, unnest({_WORDS.format(column)}) AS term FROM eval_cases)),
    {name}_p AS (SELECT id, len, term, count(*) AS tf FROM w SEMI JOIN {name}_q USING (term) GROUP BY id, len, term),
    {name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
    {name}_i AS (SELECT term, avg_len, CASE WHEN ln((n_all - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_all - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM {name}_d, st),
    {name}_s AS (SELECT query_id, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM {name}_p JOIN {name}_i USING (term) JOIN {name}_q USING (term) GROUP BY query_id, id),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


_INDEX = f"""{_ONCE},
    x AS (SELECT chunk_id AS id, {_WORDS.format('content')} AS ws FROM once WHERE content IS NOT NULL),
    w AS (SELECT id, len(ws) AS len, unnest(ws) AS term FROM x), st AS (SELECT count(*) AS n_all, avg(len(ws)) AS avg_len FROM x)"""
_USABLE = "v AS (SELECT vec_id AS id, lower(provider) AS provider, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM chunk_vectors WHERE embedding IS NOT NULL AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))"
def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _distinct(x: str) -> str:
    """The list without repeats, in order."""
    return f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"


_HAN = sorted((t for t in TERMS if all("一" <= c <= "鿿" for c in t)), key=lambda t: (-len(t), t))
_STOP = sorted((w for w in STOPWORDS if len(w) > 1), key=lambda t: (-len(t), t))
_CHINESE = f"list_filter(regexp_extract_all(question, '{'|'.join([*_HAN, *_STOP, '[\\x{4e00}-\\x{9fff}]{2}'])}'), lambda t: NOT list_contains({_list(STOPWORDS)}, t))"
_TERMS_OF = f"""pt AS (SELECT query_id, unnest({_distinct('l')}) AS phrase FROM (SELECT id AS query_id, list_concat({_distinct(_CHINESE)}, list_transform(regexp_extract_all(question, '[A-Za-z0-9_\\-.]{{2,}}'), lambda t: lower(t))) AS l FROM eval_cases))"""
_ASCII_AGAIN = "flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9_\\-.]{{2,}}'), lambda t: list_filter(regexp_split_to_array(t, '[_\\-.]+'), lambda w: w <> '')))"
_DOUBLED = f"""{_ONCE},
    x AS (SELECT chunk_id AS id, list_concat({_WORDS.format('content')}, {_ASCII_AGAIN.format('content')}) AS ws FROM once WHERE content IS NOT NULL),
    w AS (SELECT id, len(ws) AS len, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM x), st AS (SELECT count(*) AS n_all, avg(len(ws)) AS avg_len FROM x)"""


def _phrases(name: str, k: int) -> str:
    """CTEs that end in ``name`` (query_id, id, score, rank): BM25 of the questions' terms as phrases over children."""
    return f"""{_DOUBLED}, {_TERMS_OF},
    pw AS (SELECT query_id, {_WORDS.format('phrase')} AS ws FROM pt), ph AS (SELECT DISTINCT query_id, array_to_string(ws, ' ') AS phrase, ws FROM pw WHERE len(ws) > 0),
    pk AS (SELECT phrase, len(ws) AS n_words, unnest(ws) AS term, unnest(range(len(ws))) AS k FROM (SELECT DISTINCT phrase, ws FROM ph)),
    pf AS (SELECT phrase, id, len, count(*) AS tf FROM (SELECT phrase, n_words, id, len, pos - k AS start FROM w JOIN pk USING (term) GROUP BY ALL HAVING count(*) = n_words) GROUP BY phrase, id, len),
    pi AS (SELECT phrase, avg_len, CASE WHEN ln((n_all - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_all - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT phrase, count(*) AS df FROM pf GROUP BY phrase), st),
    ps AS (SELECT query_id, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM pf JOIN pi USING (phrase) JOIN (SELECT DISTINCT query_id, phrase FROM ph) USING (phrase) GROUP BY query_id, id),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM ps) WHERE rank <= {k})"""


_MOCK = f"""{_USABLE.replace('lower(provider) AS provider', 'lower(provider) AS provider, chunk_id')},
    mock AS (SELECT query_id, arg_min(vid, {{'a': md5(vid::VARCHAR), 'b': vid}}) AS vec_id FROM (SELECT e.id AS query_id, unnest(ground_truth_file) AS file_name FROM eval_cases e)
        JOIN (SELECT DISTINCT chunk_id, file_name FROM chunks WHERE NOT is_parent) USING (file_name) JOIN (SELECT id AS vid, chunk_id FROM v) USING (chunk_id) GROUP BY query_id)"""
_NEAR = f"""{_MOCK}, dq AS (SELECT query_id, v.v AS q FROM mock JOIN v ON v.id = vec_id),
    ds AS (SELECT query_id, v.id, chunk_id, list_dot_product(q, v.v) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(v.v, v.v)) AS score FROM dq, v),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM ds),
    near AS (SELECT query_id, chunk_id, max(score) AS score, min(rank) AS rank FROM dr WHERE rank <= 20 AND chunk_id IS NOT NULL GROUP BY query_id, chunk_id)"""
_LISTS = f"""WITH {_phrases('b', 20)}, {_NEAR},
    lists AS (SELECT l.*, o.doc_id FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank, 0 AS list_id, 'dense' AS path FROM near UNION ALL SELECT query_id, id, score, rank, 1, 'sparse' FROM b) l JOIN once o USING (chunk_id))"""
_DF = f"tok AS ({_FIRSTS.format(_ENGLISH)}), t AS (SELECT DISTINCT token FROM tok), df AS (SELECT token, (SELECT count(*) FROM once WHERE contains(lower(content), token)) AS df FROM t)"
_DENSE = "s AS (SELECT q.id AS query_id, v.id, list_dot_product(q.v, v.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(v.v, v.v)) AS score FROM v q, v WHERE q.id % 50 = 0 {0}), r AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)"
_HITS = f"""WITH {_INDEX}, {_bm25('a', 'question', 10)},
    hits AS (SELECT query_id, rank, id AS chunk_id, content, file_name, file_path, page_start AS page, section_path AS section FROM a JOIN once ON once.chunk_id = a.id)"""
_DIFF = f"""seen AS (SELECT file_path, max({_HASH}) AS h FROM file_scan GROUP BY file_path), {_LAST},
    diff AS (SELECT file_path, CASE WHEN h IS NULL THEN 'unreadable' WHEN last.file_path IS NULL THEN 'new' WHEN done_hash IS NULL THEN 'retry' WHEN done_hash <> h THEN 'changed' ELSE 'unchanged' END AS state
        FROM seen LEFT JOIN last USING (file_path))"""
_GONE = "SELECT DISTINCT file_path FROM manifest WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT file_path FROM file_scan WHERE file_path IS NOT NULL)"
_RE_SOURCE = "nullif(regexp_extract(file_path, '(?:^|[/\\\\])corpus[/\\\\]([^/\\\\]+)[/\\\\]', 1), '')"
_FLAGS = """flags AS (SELECT e.id, category, difficulty,
        CAST(coalesce(bool_or(rank <= 1 AND m), false) AS INTEGER) AS hit1, CAST(coalesce(bool_or(rank <= 3 AND m), false) AS INTEGER) AS hit3, CAST(coalesce(bool_or(rank <= 10 AND m), false) AS INTEGER) AS hit10, CAST(count(rank) AS INTEGER) AS n_retrieved
        FROM eval_cases e LEFT JOIN (SELECT h.*, coalesce(list_bool_or(list_transform(coalesce(c.ground_truth_file, []), lambda g: contains(h.file_name, g))), false) AS m FROM hits h JOIN eval_cases c ON c.id = h.query_id) x ON x.query_id = e.id
        GROUP BY e.id, category, difficulty)"""

_TABLE = "[" + ", ".join(f"{{'i': {i}, 'zh': '{zh}', 'en': '{en.replace(chr(39), chr(39) * 2)}'}}" for i, (zh, en) in enumerate(TERMS.items())) + "]"
_GATE_TOKENS = f"""tok AS (SELECT DISTINCT query_id, token, kind FROM (
        SELECT id AS query_id, unnest(list_transform({_ENGLISH}, lambda t: regexp_replace(t, '[.\\-]+$', ''))) AS token, 'en' AS kind FROM eval_cases UNION ALL SELECT id, unnest({_CHINESE}), 'zh' FROM eval_cases) WHERE kind = 'zh' OR length(token) >= 2),
    t AS (SELECT DISTINCT token FROM tok), df AS (SELECT token, (SELECT count(*) FROM once WHERE contains(lower(content), lower(token))) AS df FROM t)"""


def _sections() -> str:
    cols, names = [], []
    for n in range(1, 7):
        cols.append(f"last_value(CASE WHEN kind = 'heading' AND level = {n} THEN {{'n': seg_no, 't': title}} END IGNORE NULLS) OVER w AS a{n}, max(CASE WHEN kind = 'heading' AND level < {n} THEN seg_no END) OVER w AS c{n}")
        names.append(f"CASE WHEN c{n} IS NULL OR a{n}.n > c{n} THEN a{n}.t END")
    return f"""WITH r AS (SELECT doc, seg_no, max(kind) AS kind, max(level) AS level, max(text) AS text FROM segments GROUP BY doc, seg_no),
        h AS (SELECT *, CASE WHEN kind = 'heading' THEN substr(regexp_replace(trim(string_split(text, chr(10))[1]), '\\s+', ' ', 'g'), 1, 120) END AS title FROM r),
        o AS (SELECT doc, seg_no, {', '.join(cols)} FROM h WINDOW w AS (PARTITION BY doc ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT doc, seg_no, concat_ws(' > ', {', '.join(names)}) AS path FROM o"""


SQL: dict[str, str] = {
    "p14_sections": _sections(),
    "u03_query_terms": f"""WITH t AS (SELECT id AS query_id, list_concat({_distinct(_CHINESE)}, list_transform(regexp_extract_all(question, '[A-Za-z0-9_\\-.]{{2,}}'), lambda t: lower(t))) AS l FROM eval_cases),
        d AS (SELECT query_id, {_distinct('l')} AS l FROM t) SELECT query_id, CAST(unnest(range(len(l))) AS INTEGER) AS n, unnest(l) AS term FROM d""",
    "f10_evidence_gate": f"""WITH {_ONCE}, {_GATE_TOKENS}, n AS (SELECT greatest(1, floor(count(*) * 0.1)) AS most FROM once WHERE content IS NOT NULL),
        g AS (SELECT query_id, bool_or(kind = 'en' AND df = 0) AS absent, count(*) FILTER (kind = 'en' AND df <= most) AS rare, count(*) FILTER (kind = 'zh') AS zh,
            count(*) FILTER (kind = 'zh' AND (df > 0 OR list_contains({_list(TERMS)}, token))) AS known FROM tok JOIN df USING (token), n GROUP BY query_id),
        v AS (SELECT e.id AS query_id, coalesce(absent OR (rare = 0 AND zh > 0 AND known = 0), false) AS no FROM eval_cases e LEFT JOIN g ON g.query_id = e.id)
        SELECT query_id, NOT no AS passes, CASE WHEN no THEN 'no_subject_evidence' ELSE '' END AS reason FROM v""",
    "w01_variants": f"""WITH q AS (SELECT id AS query_id, question, regexp_extract_all(question, '[A-Za-z0-9][A-Za-z0-9_\\-.]*') AS own,
            list_sort(list_transform(list_filter({_TABLE}, lambda t: contains(question, t.zh)), lambda t: {{'at': instr(question, t.zh), 'i': t.i, 'en': t.en}}))[1:4] AS found FROM eval_cases),
        m AS (SELECT *, list_filter(flatten(list_transform(found, lambda t: string_split(t.en, ' '))), lambda w: NOT list_contains(list_transform(own, lambda o: lower(o)), lower(w))) AS ws FROM q),
        n AS (SELECT *, array_to_string({_distinct('ws')}, ' ') AS merged FROM m),
        c AS (SELECT *, list_filter(regexp_extract_all(question, '\\b[sS][vV][cC][_\\-][a-zA-Z_]+'), lambda x: starts_with(x, 'svc')) AS cmds,
            CASE WHEN length(question) > 20 AND regexp_matches(question, '[和、]') THEN list_filter(list_transform(regexp_split_to_array(question, '[和、]'), lambda p: regexp_replace(p, '^[ ?？，,。.]+|[ ?？，,。.]+$', '', 'g')), lambda p: length(p) >= 4) ELSE [] END AS parts FROM n),
        a AS (SELECT query_id, list_concat([question], list_filter(list_transform(list_concat(
            CASE WHEN regexp_matches(question, '[\\x{{4e00}}-\\x{{9fff}}]') AND len(found) > 0 THEN list_concat(CASE WHEN len(own) > 0 THEN [array_to_string(own, ' ') || ' ' || merged] ELSE [] END, [merged]) ELSE [] END,
            flatten(list_transform(cmds, lambda x: [substr(x, 5), replace(substr(x, 5), '_', ' ')])), parts), lambda v: trim(v)), lambda v: length(v) >= 2)) AS vs FROM c),
        d AS (SELECT query_id, {_distinct('vs')} AS vs FROM a) SELECT query_id, CAST(unnest(range(len(vs))) AS INTEGER) AS n, unnest(vs) AS variant FROM d""",
    "g10_citations": f"""{_HITS} SELECT query_id, CAST(rank AS INTEGER) AS rank, file_name, page, chunk_id,
        'file:///' || regexp_replace(replace(replace(url_encode(replace(file_path, '\\', '/')), '%2F', '/'), '%3A', ':'), '^/+', '') || CASE WHEN page IS NOT NULL AND page <> 0 THEN '#page=' || page ELSE '' END AS uri, substr(content, 1, 120) AS excerpt FROM hits WHERE rank <= 4""",
    "g04_validate": f"""{_HITS}, c AS (SELECT query_id, lower(string_agg(content, chr(10)) || chr(10) || string_agg(file_name, chr(10))) AS txt, count(*) AS n FROM hits WHERE rank <= 4 GROUP BY query_id),
        r AS (SELECT e.id AS query_id, reference_answer AS a, coalesce(txt, '') AS txt, coalesce(n, 0) AS n FROM eval_cases e LEFT JOIN c ON c.query_id = e.id),
        f AS (SELECT query_id, list_filter(regexp_extract_all(a, '\\[(?:片段)?\\s*(\\d+)\\]', 1), lambda x: x::BIGINT > n)[1] AS cite, list_filter({_list(INFERENCE_PHRASES)}, lambda p: contains(a, p))[1] AS phrase,
            list_filter(list_transform(regexp_extract_all(a, '[A-Za-z][A-Za-z0-9_\\-./]{{2,}}'), lambda t: regexp_replace(t, '\\.+$', '')), lambda t: length(t) >= 3 AND NOT list_contains({_list(ABBREVIATIONS)}, lower(t)) AND regexp_matches(t, '[_/\\-.]') AND NOT contains(txt, lower(t)))[1] AS name,
            list_filter(regexp_extract_all(a, '\\b\\d+\\.\\d+\\.\\d+(?:\\.\\d+)?\\b'), lambda v: NOT contains(txt, v))[1] AS version FROM r)
        SELECT query_id, coalesce('citation:' || cite, 'inference:' || phrase, 'identifier:' || name, 'version:' || version, '') AS reason FROM f""",
    "s12_lookup": """SELECT chunk_id, max(file_path) AS file_path, max(chunk_index) AS chunk_index FROM chunks WHERE is_parent AND chunk_id IN
        (SELECT parent_chunk_id FROM chunks WHERE NOT is_parent AND nullif(parent_chunk_id, '') IS NOT NULL) GROUP BY chunk_id""",
    "e01_embed": f"""WITH {_ONCE}, x AS (SELECT chunk_id, unnest({_WORDS.format('content')}) AS w FROM once WHERE content IS NOT NULL),
        h AS (SELECT chunk_id, CAST(('0x' || substr(md5(w), 1, 8))::UBIGINT % 64 AS INTEGER) AS column_no, CASE WHEN ('0x' || substr(md5(w), 9, 2))::INTEGER % 2 = 1 THEN 1 ELSE -1 END AS s FROM x),
        v AS (SELECT chunk_id, column_no FROM h GROUP BY chunk_id, column_no HAVING sum(s) <> 0) SELECT column_no, count(*) AS n FROM v GROUP BY column_no""",
    "p3_found": f"""
        WITH m AS (SELECT file_path, lower(trim(status)) AS st, {_HASH} AS h, row_number() OVER (PARTITION BY file_path ORDER BY indexed_at DESC) AS rn FROM manifest),
        s AS (SELECT DISTINCT file_path, {_HASH} AS h FROM file_scan WHERE file_hash IS NOT NULL)
        SELECT DISTINCT s.file_path FROM s LEFT JOIN m ON m.file_path = s.file_path AND m.rn = 1
        WHERE m.file_path IS NULL OR m.st IS NULL OR m.st <> 'done' OR m.h IS NULL OR m.h <> s.h""",
    "p3_vanished": _GONE,
    "i02_manifest_diff": f"WITH {_DIFF} SELECT file_path, state FROM diff",
    "a09_ingest_report": f"WITH {_DIFF} SELECT state, count(*) AS n FROM (SELECT state FROM diff UNION ALL SELECT 'removed' FROM ({_GONE})) GROUP BY state",
    "s13_manifest_latest": f"WITH {_LAST} SELECT file_path, done_hash FROM last",
    "s02_newest_per_source": f"""SELECT * FROM (SELECT source, file_path, mtime, CAST(row_number() OVER (PARTITION BY source ORDER BY mtime DESC, file_path) AS INTEGER) AS n FROM
        (SELECT {_RE_SOURCE} AS source, file_path, max(mtime) AS mtime FROM file_scan GROUP BY ALL)) WHERE n <= 500""",
    "a08_error_kinds": """SELECT CASE WHEN h = '' THEN 'unknown' ELSE h END AS kind, count(*) AS n FROM
        (SELECT substr(trim(split_part(coalesce(error_msg, ''), ':', 1)), 1, 60) AS h FROM manifest WHERE lower(trim(coalesce(status, ''))) <> 'done') GROUP BY 1""",
    "a12_status": """SELECT count(*) FILTER (lower(trim(status)) = 'done') AS n_done, count(*) FILTER (lower(trim(status)) = 'error') AS n_error,
        count(*) FILTER (status IS NULL) AS n_null, count(*) AS n, CAST(sum(chunk_count) AS BIGINT) AS n_chunks FROM manifest""",
    "e06_throughput": """WITH f AS (SELECT file_path, max(size) AS size FROM file_scan GROUP BY file_path), p AS (SELECT doc AS file_path, max(coalesce(page_end, page)) AS pages FROM segments GROUP BY doc)
        SELECT n_files, chunks, round(chunks / 0.4, 1) AS seconds FROM (SELECT count(*) AS n_files, CAST(sum(CASE WHEN coalesce(pages, 0) > 0 THEN 3 * pages ELSE greatest(1, coalesce(size, 0) // 700) END) AS BIGINT) AS chunks FROM f LEFT JOIN p USING (file_path))""",
    "w08_put": f"""SELECT query, arg_max(source, ts) AS doc, max(ts) AS ts FROM (SELECT regexp_replace(lower(regexp_replace({_strip('title')}, '[{_WS}]+', ' ', 'g')), '^[?？!！。，,、;；:：.·\\-_ ]+|[?？!！。，,、;；:：.·\\-_ ]+$', '', 'g') AS query, source, doc_id AS ts FROM documents WHERE title IS NOT NULL)
        GROUP BY query ORDER BY ts DESC, query DESC LIMIT 200""",
    "x16_smoke": f"""WITH {_NEAR} SELECT query_id, count(*) AS n, count(*) FILTER (score >= 0.6) AS n_over, round(max(score), 6) AS best FROM dr WHERE rank <= 20 GROUP BY query_id""",
    "a10_top1": f"""WITH {_NEAR}, hits AS (SELECT query_id, rank, file_name FROM near JOIN (SELECT DISTINCT chunk_id, file_name FROM chunks WHERE NOT is_parent) USING (chunk_id)), {_FLAGS},
        b AS (SELECT query_id AS id, max(score) AS top1 FROM near WHERE rank > 1 GROUP BY query_id)
        SELECT category, difficulty, CASE grouping(category, difficulty) WHEN 3 THEN 'overall' WHEN 1 THEN 'category' ELSE 'difficulty' END AS level, count(*) AS n,
          round_even(100 * avg(hit1), 1) AS hit1, round_even(100 * avg(hit3), 1) AS hit3, round_even(100 * avg(hit10), 1) AS hit10, round_even(avg(top1), 3) AS mean_top1 FROM flags LEFT JOIN b USING (id) GROUP BY GROUPING SETS ((), (category), (difficulty))""",
    "k01_upsert": """SELECT chunk_id, "at", file_path, chunk_type FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY "at" DESC NULLS LAST, chunk_type DESC NULLS LAST) AS rn FROM
        (SELECT chunk_id, substr(replace(replace(created_at, 'T', ' '), 'Z', ''), 1, 19) AS "at", file_path, chunk_type FROM chunks)) WHERE rn = 1""",
    "k03_delete_by_file": f"SELECT file_path, count(DISTINCT chunk_id) AS n FROM chunks WHERE file_path NOT IN ({_GONE}) GROUP BY file_path",
    "s03_content_hash_groups": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "c01_norm_keys": f"SELECT {_norm_key('l')} AS key, count(*) AS n, count(DISTINCT doc) AS n_docs FROM (SELECT doc, unnest(string_split(text, chr(10))) AS l FROM segments WHERE text IS NOT NULL) GROUP BY 1",
    "c02_noise_lines": f"""WITH s AS (SELECT DISTINCT doc || '#' || seg_no AS key, string_split(text, chr(10)) AS ls FROM segments WHERE text IS NOT NULL)
        SELECT key, CAST(line_no AS INTEGER) AS line_no, line FROM (SELECT key, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM s) WHERE {_noise('line')}""",
    "c03_learned_noise": f"""WITH z AS (SELECT doc, page, unnest([string_split(text, chr(10))[1], string_split(text, chr(10))[-1]]) AS line FROM segments WHERE page IS NOT NULL AND text IS NOT NULL),
        k AS (SELECT doc, page, {_norm_key('line')} AS key FROM z), n AS (SELECT doc, count(DISTINCT page) AS pages FROM z GROUP BY doc)
        SELECT doc, key, count(DISTINCT page) AS n_pages FROM k JOIN n USING (doc) WHERE key <> '' AND pages >= 3 GROUP BY doc, key, pages HAVING count(DISTINCT page) >= greatest(3, floor(pages * 0.3))""",
    "c05_clean_text": f"""WITH c AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT {_noise('l')}), chr(10)) AS t FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, {_scrub('t')} AS text FROM c""",
    "c06_scrub": f"SELECT doc_id, {_scrub('text')} AS text FROM documents WHERE text IS NOT NULL",
    "c07_dedup_paragraphs": f"""WITH p AS (SELECT doc_id, {_PARAGRAPHS} AS ps FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM p),
        k AS (SELECT *, {_norm_key('p')} AS key FROM u), l AS (SELECT *, lag(key) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k)
        SELECT d.doc_id, coalesce(string_agg(l.p, chr(10) || chr(10) ORDER BY l.i), '') AS text FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id AND (l.before IS NULL OR l.before <> l.key) WHERE d.text IS NOT NULL GROUP BY d.doc_id""",
    "c08_language": """SELECT doc_id, CASE WHEN length(regexp_replace(h, '[^\\x{4e00}-\\x{9fff}]+', '', 'g')) > 0.05 * length(h) THEN 'zh' ELSE 'en' END AS language
        FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 4000) AS h FROM documents)""",
    "t01_token_count": f"WITH {_ONCE} SELECT chunk_id, {_tokens('content')} AS tokens FROM once WHERE content IS NOT NULL",
    "t02_truncate": f"SELECT doc_id, CASE WHEN {_tokens('text')} <= 256 THEN text ELSE substr(text, 1, 921) END AS text FROM documents WHERE text IS NOT NULL",
    "t04_tier": """SELECT doc, pages, CASE WHEN pages <= 19 THEN 'short' WHEN pages <= 100 THEN 'medium' ELSE 'long' END AS name, CASE WHEN pages > 19 AND pages <= 100 THEN 768 ELSE 512 END AS size,
        CASE WHEN pages > 19 AND pages <= 100 THEN 96 ELSE 64 END AS overlap, CASE WHEN pages > 100 THEN 1536 ELSE 0 END AS parent FROM (SELECT doc, coalesce(max(coalesce(page_end, page)), 0) AS pages FROM segments GROUP BY doc)""",
    "t06_units": f"SELECT doc_id, CAST(unnest(range(len(ps))) AS INTEGER) AS unit_no, unnest(ps) AS unit FROM (SELECT doc_id, {_PARAGRAPHS} AS ps FROM documents WHERE text IS NOT NULL)",
    "t11_captions": f"WITH {_ONCE} SELECT chunk_id FROM once WHERE regexp_matches(content, '^\\s*(figure|fig\\.|table|图|表)\\s*[\\d\\.\\-]+[\\.:：]', 'i') AND {_tokens('content')} >= 40 AND {_tokens('content')} < 120",
    "t13_child_ids": f"WITH {_ONCE} SELECT chunk_id, substr(sha256(file_path || '|' || coalesce(CAST(page_start AS VARCHAR), 'None') || '|' || chunk_index), 1, 16) AS made FROM once",
    "t13_warnings": f"WITH {_ONCE} SELECT chunk_type, count(*) AS n FROM once WHERE regexp_matches(content, '(WARNING|CAUTION|高风险|警告|注意[:：]?)', 'i') GROUP BY chunk_type",
    "t14_parent_groups": f"""WITH RECURSIVE {_ONCE}, o AS (SELECT file_path, chunk_id, {_tokens('content')} AS n, row_number() OVER (PARTITION BY file_path ORDER BY chunk_index, chunk_id) AS i FROM once WHERE content IS NOT NULL),
        g AS (SELECT file_path, chunk_id, i, n AS used, 0 AS group_no FROM o WHERE i = 1 UNION ALL
          SELECT o.file_path, o.chunk_id, o.i, CASE WHEN g.used + o.n > 1536 THEN o.n ELSE g.used + o.n END, CASE WHEN g.used + o.n > 1536 THEN g.group_no + 1 ELSE g.group_no END FROM g JOIN o ON o.file_path = g.file_path AND o.i = g.i + 1)
        SELECT file_path, chunk_id, group_no FROM g""",
    "f05_query_tokens": f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS INTEGER) AS n, token FROM ({_FIRSTS.format(_ENGLISH)})",
    "f06_document_frequency": f"WITH {_ONCE}, {_DF} SELECT token AS term, df FROM df",
    "f07_discriminative": f"WITH {_ONCE}, {_DF} SELECT query_id, token, df FROM tok JOIN df USING (token) WHERE df <= greatest(1, floor((SELECT count(*) FROM once WHERE content IS NOT NULL) * 0.1))",
    "w04_parts": """WITH p AS (SELECT id AS query_id, list_filter(list_transform(regexp_split_to_array(question, '[和、]'), lambda p: regexp_replace(p, '^[ ?？，,。.]+|[ ?？，,。.]+$', '', 'g')), lambda p: length(p) >= 4) AS ps
        FROM eval_cases WHERE length(question) > 20 AND regexp_matches(question, '[和、]')) SELECT query_id, CAST(unnest(range(len(ps))) AS INTEGER) AS n, unnest(ps) AS part FROM p""",
    "w07_cache_key": f"""SELECT id AS query_id, regexp_replace(lower(regexp_replace({_strip('question')}, '[{_WS}]+', ' ', 'g')), '^[?？!！。，,、;；:：.·\\-_ ]+|[?？!！。，,、;；:：.·\\-_ ]+$', '', 'g') AS key FROM eval_cases""",
    "w08_lru": "SELECT user_id AS key, max(event_id) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, key DESC LIMIT 200",
    "w09_first_words": f"""SELECT doc_id, CASE WHEN len(ws) <= 45 THEN text ELSE array_to_string(ws[1:45], ' ') END AS text FROM
        (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[{_WS}]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL)""",
    "r01_dense_top_k": f"WITH {_USABLE}, {_DENSE.format('')} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20",
    "f01_filtered_dense": f"WITH {_USABLE}, {_DENSE.format("AND v.provider = 'cloud'")} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5",
    "f03_dense_threshold": f"WITH {_USABLE}, {_DENSE.format('')} SELECT query_id, id FROM r WHERE rank <= 20 AND score >= 0.6",
    "r02_bm25_top_k": f"WITH {_phrases('a', 20)} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM a",
    "k02_postings": f"WITH {_DOUBLED}, p AS (SELECT term, id, count(*) AS tf, max(pos) AS last FROM w GROUP BY term, id) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(last) AS last_place FROM p GROUP BY term",
    "x14_mock_vectors": f"WITH {_MOCK} SELECT query_id, vec_id FROM mock",
    "f12_dense_gate": f"""WITH {_ONCE}, {_NEAR}, {_DF}, n AS (SELECT greatest(1, floor(count(*) * 0.1)) AS most FROM once WHERE content IS NOT NULL),
        r AS (SELECT query_id, list(token) AS ts FROM tok JOIN df USING (token), n WHERE df <= most GROUP BY query_id)
        SELECT near.query_id, chunk_id FROM near JOIN once USING (chunk_id) LEFT JOIN r ON r.query_id = near.query_id WHERE score >= 0.5 AND (ts IS NULL OR list_bool_or(list_transform(ts, lambda x: contains(lower(content), x))))""",
    "f13_sparse_gate": f"""WITH {_phrases('b', 20)}, {_DF}, n AS (SELECT greatest(1, floor(count(*) * 0.1)) AS most FROM once WHERE content IS NOT NULL),
        r AS (SELECT query_id, list(token) AS ts FROM tok JOIN df USING (token), n WHERE df <= most GROUP BY query_id)
        SELECT b.query_id, b.id AS chunk_id FROM b JOIN once ON once.chunk_id = b.id JOIN r ON r.query_id = b.query_id WHERE score >= 8 AND list_bool_or(list_transform(ts, lambda x: contains(lower(content), x)))""",
    "r05_rank_fusion": f"{_LISTS} SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM lists GROUP BY query_id, chunk_id",
    "r06_vote_cap": f"""{_LISTS}, votes AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_id, doc_id ORDER BY rank) AS k FROM lists)
        SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM votes WHERE k <= 2 GROUP BY query_id, chunk_id""",
    "r07_fused_pool": f"""{_LISTS}, votes AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_id, doc_id ORDER BY rank) AS k FROM lists)
        SELECT query_id, chunk_id, round(coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (k <= 3), 0), 9) AS rrf, CASE WHEN count(DISTINCT path) = 2 THEN 'both' ELSE max(path) END AS matched_by FROM votes GROUP BY query_id, chunk_id""",
    "r09_fallback": f"{_LISTS} SELECT query_id, chunk_id FROM lists WHERE path = 'sparse' AND query_id NOT IN (SELECT query_id FROM lists WHERE path = 'dense' AND rank > 1 AND score >= 0.9)",
    "j04_child_parent": f"""WITH {_ONCE}, p AS (SELECT chunk_id AS pid, max(length(content)) AS parent_length FROM chunks WHERE is_parent GROUP BY chunk_id)
        SELECT chunk_id, nullif(parent_chunk_id, '') AS pid, CAST(parent_length AS INTEGER) AS parent_length FROM once LEFT JOIN p ON p.pid = nullif(parent_chunk_id, '')""",
    "j11_orphans": f"WITH {_ONCE} SELECT chunk_id, parent_chunk_id AS pid FROM once WHERE nullif(parent_chunk_id, '') IS NOT NULL AND parent_chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE is_parent)",
    "g01_context": f"""{_HITS},
        b AS (SELECT query_id, rank, '[片段' || rank || ' | 来源: ' || file_name || CASE WHEN page IS NOT NULL AND page <> 0 THEN ' | 第' || page || '页' ELSE '' END || CASE WHEN coalesce(section, '') <> '' THEN ' | 章节: ' || section ELSE '' END || ']' || chr(10) || content AS block FROM hits),
        t AS (SELECT *, {_tokens('block')} AS tk, sum({_tokens('block')}) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM b)
        SELECT query_id, CAST(count(*) FILTER (upto <= 1200) AS INTEGER) AS n_blocks, CAST(coalesce(sum(tk) FILTER (upto <= 1200), 0) AS BIGINT) AS n_tokens,
          md5('【官方检索上下文开始】' || chr(10) || coalesce(string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (upto <= 1200), '（空）') || chr(10) || '【官方检索上下文结束】') AS md5 FROM t GROUP BY query_id""",
    "a06_kinds": "SELECT chunk_type, is_parent, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY ALL",
    "a07_token_stats": f"""SELECT is_parent, chunk_type, count(*) AS n, min(t) AS least, max(t) AS most, round(avg(t), 6) AS mean, count(*) FILTER (t > 512) AS n_over, count(*) FILTER (t < 50) AS n_fragments
        FROM (SELECT is_parent, chunk_type, {_tokens('content')} AS t FROM chunks WHERE content IS NOT NULL) GROUP BY ALL""",
    "a11_hit_flags": f"{_HITS}, {_FLAGS} SELECT id, category, difficulty, hit1, hit3, hit10, n_retrieved FROM flags",
    "a10_hit_rates": f"""{_HITS}, {_FLAGS}
        SELECT category, difficulty, CASE grouping(category, difficulty) WHEN 3 THEN 'overall' WHEN 1 THEN 'category' ELSE 'difficulty' END AS level, count(*) AS n,
          round_even(100 * avg(hit1), 1) AS hit1, round_even(100 * avg(hit3), 1) AS hit3, round_even(100 * avg(hit10), 1) AS hit10 FROM flags GROUP BY GROUPING SETS ((), (category), (difficulty))""",
    "f15_quality": f"""WITH c AS (SELECT chunk_id, max(content) AS content, bool_or(is_parent) AS is_parent, max(chunk_type) AS chunk_type, max(doc_id) AS doc_id, max(doc_title) AS doc_title, max(page_start) AS page_start, max(parent_chunk_id) AS parent_chunk_id FROM chunks GROUP BY chunk_id),
        l AS (SELECT c.*, nullif(c.parent_chunk_id, '') AS link, p.chunk_id AS pid, p.content AS pc FROM c LEFT JOIN c p ON p.is_parent AND p.chunk_id = nullif(c.parent_chunk_id, '') WHERE NOT c.is_parent)
        SELECT 'child_over_limit' AS "check", 'fail' AS severity, count(*) FILTER (NOT is_parent AND {_tokens('content')} > 512) AS n FROM c
        UNION ALL SELECT 'parent_over_limit', 'fail', count(*) FILTER (is_parent AND {_tokens('content')} > 2048) FROM c
        UNION ALL SELECT 'unknown_type', 'fail', count(*) FILTER (NOT coalesce(chunk_type IN ('text', 'table', 'formula', 'figure_caption', 'code', 'heading'), false)) FROM c
        UNION ALL SELECT 'no_doc_id', 'fail', count(*) FILTER (coalesce(doc_id, '') = '') FROM c
        UNION ALL SELECT 'no_doc_title', 'fail', count(*) FILTER (coalesce(doc_title, '') = '') FROM c
        UNION ALL SELECT 'no_page', 'warn', count(*) FILTER (NOT is_parent AND page_start IS NULL) FROM c
        UNION ALL SELECT 'short_child', 'warn', count(*) FILTER (NOT is_parent AND {_tokens('content')} < 20) FROM c
        UNION ALL SELECT 'malformed_table', 'warn', count(*) FILTER (chunk_type = 'table' AND NOT coalesce(regexp_matches(content, '\\|\\s*-{{3}}'), false)) FROM c
        UNION ALL SELECT 'dangling_parent', 'fail', count(*) FILTER (link IS NOT NULL AND pid IS NULL) FROM l
        UNION ALL SELECT 'unlinked_child', 'warn', count(*) FILTER (link IS NULL) FROM l
        UNION ALL SELECT 'parent_lacks_child', 'fail', count(*) FILTER (pid IS NOT NULL AND NOT contains(pc, substr(content, 1, 80))) FROM l""",
    "x01_event_rates": """SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
}
SQL["k08_cache_stats"] = f"SELECT count(*) AS n, count(*) FILTER (coalesce(doc, '') = '') AS n_empty, min(ts) AS oldest, max(ts) AS newest FROM ({SQL['w08_put']})"

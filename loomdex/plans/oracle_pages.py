"""SQL that gives the results of plans/pages.py on the same tables, for DuckDB."""

from __future__ import annotations

from loomdex.config import SENTENCE_ABBREVIATIONS
from loomdex.operators.structure import FORMULA, MATH, TOC_DOTS, TOC_HEAD, TOC_NUMBER
from loomdex.plans.oracle import _PARAGRAPHS, _WS, _noise, _norm_key, _scrub, _strip, _tokens

_SEG = """seg AS (SELECT doc, seg_no, r.page AS page, r.text AS text, r.kind AS kind, r.level AS level FROM
        (SELECT doc, seg_no, max({'page': coalesce(page, 0), 'text': text, 'kind': kind, 'level': level}) AS r FROM segments GROUP BY doc, seg_no) WHERE r.text IS NOT NULL)"""
_BLK = f"""{_SEG}, ln AS (SELECT doc, page, seg_no, kind, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM seg),
    pl AS (SELECT *, CASE WHEN line_no % 3 = 2 THEN 1 ELSE 0 END AS rgt FROM ln),
    xy AS (SELECT *, 50.0::DOUBLE + 250.0::DOUBLE * rgt AS x0, 40.0::DOUBLE + 12.0::DOUBLE * line_no + 5.0::DOUBLE * (seg_no % 7) - 18.0::DOUBLE * rgt AS y0, 9.0::DOUBLE + 0.7::DOUBLE * (length(text) % 6) AS size FROM pl),
    blk AS (SELECT *, x0 + 200.0 AS x1, y0 + 10.0 AS y1 FROM xy)"""
_SCANS = f"{_SEG}, scans AS (SELECT doc, page, length(trim(max(text))) < 400 AND page % 2 = 0 AND count(*) = 1 AS scan FROM seg GROUP BY doc, page)"
_SIZES = f"""{_BLK}, cs AS (SELECT doc, round(size, 1) AS s, count(*) AS n, min(seg_no * 10000 + line_no) AS first FROM blk GROUP BY ALL),
    bd AS (SELECT doc, arg_max(s, {{'n': n, 'f': -first}}) AS body FROM cs GROUP BY doc),
    hs AS (SELECT doc, body, list_sort(coalesce(list(s) FILTER (s > 1.06 * body), []), 'DESC')[1:6] AS sizes FROM cs JOIN bd USING (doc) GROUP BY doc, body)"""
_q = lambda p: p.replace("'", "''")
_IS_FORMULA = "(" + " OR ".join(f"regexp_matches(text, '{_q(p)}')" for p in FORMULA) + f" OR (length(text) > 0 AND length(regexp_replace(text, '[^{MATH}]+', '', 'g')) > 0.04 * length(text)))"
_RUNNING = "'Manual of ' || string_split(replace(doc, '\\', '/'), '/')[-1]"
_MARK = "﷑"
_KNOWN = "|".join(a.replace(".", "\\.") for a in sorted(SENTENCE_ABBREVIATIONS, key=lambda a: (-len(a), a)))
_NO_END = f"'(^|[\\s\\x{{b}}{_MARK}])((?:{_KNOWN}|[a-z]|[0-9]+)\\.+){_MARK}', '\\1\\2 ', 'gi'"
_SENTENCES = f"""s1 AS (SELECT doc_id, regexp_replace(text, '([.!?。！？])[{_WS}]+([A-Za-z0-9一-鿿])', '\\1{_MARK}\\2', 'g') AS t FROM documents WHERE text IS NOT NULL),
    s2 AS (SELECT doc_id, regexp_replace(regexp_replace(t, {_NO_END}), {_NO_END}) AS t FROM s1),
    s3 AS (SELECT doc_id, list_filter(list_transform(string_split(t, '{_MARK}'), lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM s2),
    sen AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS n, unnest(l) AS sentence FROM s3)"""


def _quarters(x: str) -> str:
    """Tokens in quarters."""
    return f"(length({x}) + 3 * length(regexp_replace({x}, '[^\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')))"


def _pieces(kind: str, first: int, base_first: str, base_later: str, least: int, text: str) -> str:
    """Greedy pieces of lines over a limit of 128 tokens, 515 quarters at most."""
    return f"""WITH RECURSIVE c AS (SELECT chunk_id, max(content) AS content FROM chunks WHERE chunk_type = '{kind}' AND NOT is_parent AND content IS NOT NULL GROUP BY chunk_id),
        big AS (SELECT *, string_split(content, chr(10)) AS ls FROM c WHERE {_quarters('content')} > 515),
        l AS (SELECT chunk_id, unnest(ls[{first}:]) AS line, unnest(range({first}, len(ls) + 1)) AS i FROM big),
        cum AS (SELECT chunk_id, i, line, sum({_quarters('line')} + 1) OVER (PARTITION BY chunk_id ORDER BY i) AS upto, {_quarters('line')} + 1 AS q FROM l),
        e AS (SELECT a.chunk_id, a.i AS s, greatest(a.i, coalesce(max(b.i) FILTER (b.upto - a.upto + a.q + CASE WHEN a.i = {first} THEN {base_first} ELSE {base_later} END <= 515), 0)) AS e
            FROM cum a JOIN cum b ON a.chunk_id = b.chunk_id AND b.i >= a.i JOIN big ON big.chunk_id = a.chunk_id GROUP BY a.chunk_id, a.i),
        r AS (SELECT chunk_id, 0 AS n, s, e FROM e WHERE s = {first} UNION ALL SELECT r.chunk_id, r.n + 1, e.s, e.e FROM r JOIN e ON e.chunk_id = r.chunk_id AND e.s = r.e + 1)
        SELECT r.chunk_id, r.n, {text} AS piece FROM r JOIN big USING (chunk_id) UNION ALL SELECT chunk_id, 0, content FROM c WHERE {_quarters('content')} <= 515"""


SQL: dict[str, str] = {
    "lay01_scans": f"WITH {_SCANS} SELECT doc, page, scan FROM scans",
    "lay02_ocr_wanted": f"WITH {_SCANS} SELECT doc, page AS no, scan AND sum(scan::INTEGER) OVER (PARTITION BY doc) <= 2 AS ocr FROM scans",
    "lay03_ocr_lines": f"""WITH {_SEG}, ws AS (SELECT doc, seg_no, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS ws FROM seg),
        u AS (SELECT doc, seg_no, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM ws),
        k AS (SELECT doc, seg_no, i // 7 AS row_no, string_agg(w, ' ' ORDER BY i % 7, w) AS line FROM u WHERE i % 11 = 0 OR i % 10 >= 5 GROUP BY doc, seg_no, i // 7)
        SELECT doc, seg_no, CAST(row_number() OVER (PARTITION BY doc, seg_no ORDER BY row_no) - 1 AS INTEGER) AS n, line FROM k""",
    "lay06_outside_tables": f"""WITH {_BLK}, f AS (SELECT *, greatest(0.0, least(x1, 190.0) - greatest(x0, 40.0)) * greatest(0.0, least(y1, 130.0) - greatest(y0, 70.0)) / greatest(1.0, (x1 - x0) * (y1 - y0)) <= 0.5 AS kept FROM blk)
        SELECT doc, page, CAST(count(*) FILTER (kept) AS INTEGER) AS n, md5(coalesce(string_agg(text, '|' ORDER BY seg_no, line_no) FILTER (kept), '')) AS md5 FROM f GROUP BY doc, page""",
    "lay07_reading_order": f"""WITH RECURSIVE {_BLK}, o AS (SELECT doc, page, x0, y0, y1, row_number() OVER (PARTITION BY doc, page ORDER BY y0, x0) AS rn, count(*) OVER (PARTITION BY doc, page) AS of FROM blk),
        r AS (SELECT doc, page, rn, x0, y0, y1 AS bottom, 0 AS col, of FROM o WHERE rn = 1 UNION ALL
            SELECT o.doc, o.page, o.rn, o.x0, o.y0, CASE WHEN o.y0 < r.bottom - 2 THEN o.y1 ELSE greatest(r.bottom, o.y1) END, r.col + CASE WHEN o.y0 < r.bottom - 2 THEN 1 ELSE 0 END, o.of
            FROM r JOIN o ON o.doc = r.doc AND o.page = r.page AND o.rn = r.rn + 1),
        c AS (SELECT *, min(x0) OVER (PARTITION BY doc, page, col) AS l FROM r)
        SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY CASE WHEN of >= 6 THEN l END, CASE WHEN of >= 6 THEN col END, rn) - 1 AS INTEGER) AS n, x0, y0 FROM c""",
    "lay08_markdown": """SELECT n_regionkey, '| name | note of it |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' |  |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey""",
    "lay09_merged_tables": """WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day, o_orderkey, substr(o_orderpriority, 1, 1) < '4' AS a FROM orders),
        p AS (SELECT *, day // 30 AS page FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY day, o_orderkey) - 1 AS pos FROM p),
        b AS (SELECT *, lag(page) OVER w AS bp, lag(a) OVER w AS ba FROM k WINDOW w AS (PARTITION BY doc ORDER BY page, pos)),
        g AS (SELECT *, sum(CASE WHEN pos = 0 AND page = bp + 1 AND a = ba THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, pos) AS run FROM b)
        SELECT doc, CAST(min(page) AS INTEGER) AS page_start, CAST(max(page) AS INTEGER) AS page_end, CAST(count(*) + 1 AS INTEGER) AS n_rows FROM g GROUP BY doc, run""",
    "lay10_contents": f"""WITH {_BLK}, l AS (SELECT doc, page, trim(CASE WHEN length(text) % 3 = 0 THEN text || ' ........ ' || line_no ELSE text END) AS l FROM blk)
        SELECT doc, page, bool_or(l <> '' AND regexp_matches(l, '(?i){TOC_HEAD}')) OR (count(*) FILTER (l <> '') > 0 AND count(*) FILTER (regexp_matches(l, '{TOC_NUMBER}') OR regexp_matches(l, '{TOC_DOTS}')) >= 0.35 * count(*) FILTER (l <> '')) AS toc
        FROM l GROUP BY doc, page""",
    "lay11_formulas": f"WITH {_SEG} SELECT doc, seg_no FROM seg WHERE {_IS_FORMULA}",
    "lay12_heading_sizes": f"WITH {_SIZES} SELECT doc, body, array_to_string(list_transform(sizes, lambda x: CAST(round(x, 1) AS VARCHAR)), ' ') AS sizes FROM hs",
    "lay13_levels": f"""WITH {_SIZES} SELECT doc, CAST(level AS INTEGER) AS level, count(*) AS n FROM
        (SELECT blk.doc, coalesce(list_position(list_transform(sizes, lambda s: size >= s), true), 0) AS level FROM blk JOIN hs ON hs.doc = blk.doc) GROUP BY ALL""",
    "lay15_kinds": f"WITH {_SEG} SELECT doc, seg_no, CASE WHEN kind = 'heading' THEN 'heading' WHEN kind = 'code' THEN 'code' WHEN {_IS_FORMULA} THEN 'formula' ELSE 'text' END AS made FROM seg",
    "c04_clean_blocks": f"""WITH {_BLK}, pg AS (SELECT DISTINCT doc, page FROM blk),
        b AS (SELECT doc, page, 1 AS part, seg_no, line_no, text, y1 <= 800 * 0.12::DOUBLE OR y0 >= 800 * (1 - 0.12::DOUBLE) AS zone FROM blk
            UNION ALL SELECT doc, page, 0, 0, 0, {_RUNNING}, true FROM pg UNION ALL SELECT doc, page, 2, 0, 0, 'Copy ' || page, true FROM pg),
        z AS (SELECT doc, page, {_norm_key('text')} AS key FROM b WHERE zone), n AS (SELECT doc, count(DISTINCT page) AS pages FROM z GROUP BY doc),
        k AS (SELECT doc, key FROM z JOIN n USING (doc) WHERE key <> '' AND pages >= 3 GROUP BY doc, key, pages HAVING count(DISTINCT page) >= greatest(3, floor(pages * 0.3))),
        f AS (SELECT b.doc, page, part, seg_no, line_no, {_scrub("CASE WHEN " + _noise('text') + " THEN '' ELSE text END")} AS t, zone AND k.key IS NOT NULL AS gone FROM b LEFT JOIN k ON k.doc = b.doc AND k.key = {_norm_key('text')})
        SELECT doc, page, CAST(count(*) FILTER (NOT gone AND t <> '') AS INTEGER) AS n, md5(coalesce(string_agg(t, chr(10) ORDER BY part, seg_no, line_no) FILTER (NOT gone AND t <> ''), '')) AS md5 FROM f GROUP BY doc, page""",
    "c03_page_noise": f"""WITH {_SEG}, p AS (SELECT DISTINCT doc, page FROM seg), l AS (SELECT doc, page, unnest([{_RUNNING}, 'Copy ' || page, md5(doc || page)]) AS line FROM p),
        k AS (SELECT doc, page, {_norm_key('line')} AS key FROM l), n AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY doc)
        SELECT doc, key, count(DISTINCT page) AS n_pages FROM k JOIN n USING (doc) WHERE pages >= 3 GROUP BY doc, key, pages HAVING count(DISTINCT page) >= greatest(3, floor(pages * 0.3))""",
    "t05_sentences": f"WITH {_SENTENCES} SELECT doc_id, n, sentence FROM sen",
    "t07_windows": f"""WITH RECURSIVE d AS (SELECT doc_id, {_PARAGRAPHS} AS ps FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM d),
        c AS (SELECT doc_id, i, {_tokens('p')} AS n, sum({_tokens('p')}) OVER (PARTITION BY doc_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY doc_id) AS of FROM u),
        e AS (SELECT a.doc_id, a.i AS s, a.of, greatest(a.i, coalesce(max(b.i) FILTER (b.upto - a.upto + a.n <= 128), 0)) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i GROUP BY a.doc_id, a.i, a.of),
        r AS (SELECT doc_id, 0 AS window_no, s, e FROM e WHERE s = 0 UNION ALL
            SELECT r.doc_id, r.window_no + 1, e.s, e.e FROM r JOIN e ON e.doc_id = r.doc_id AND e.s = CASE WHEN r.e > r.s THEN r.e ELSE r.e + 1 END WHERE r.e + 1 < e.of)
        SELECT doc_id, window_no, CAST(s AS INTEGER) AS "first", CAST(e AS INTEGER) AS "last" FROM r""",
    "t08_oversize": f"WITH {_SENTENCES} SELECT doc_id, n, 0 AS n_over, md5(regexp_replace(sentence, '[{_WS}]+', '', 'g')) AS md5 FROM sen WHERE {_tokens('sentence')} > 24",
    "t09_tables": _pieces("table", 3, f"{_quarters('big.ls[1]')} + 1 + {_quarters('big.ls[2]')}", f"{_quarters('big.ls[1]')} + 1 + {_quarters('big.ls[2]')}", 3, "array_to_string(list_concat(ls[1:2], ls[s:e]), chr(10))").replace("GROUP BY a.chunk_id, a.i)", "GROUP BY a.chunk_id, a.i, big.ls)"),
    "t10_code": _pieces("code", 1, "-1", f"{_quarters(chr(39) + '# 续：' + chr(39) + ' || big.ls[1]')}", 1, "CASE WHEN r.n > 0 THEN '# 续：' || ls[1] || chr(10) ELSE '' END || array_to_string(ls[s:e], chr(10))").replace("GROUP BY a.chunk_id, a.i)", "GROUP BY a.chunk_id, a.i, big.ls)"),
    "f04_has_rare_token": """WITH w AS (SELECT id, reference_answer AS a, list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: length(w) >= 7)) AS ws FROM eval_cases WHERE question IS NOT NULL AND reference_answer IS NOT NULL)
        SELECT id AS case_id, CAST(len(ws) AS INTEGER) AS n, coalesce(list_bool_or(list_transform(ws, lambda x: contains(lower(a), x))), false) AS holds FROM w""",
}

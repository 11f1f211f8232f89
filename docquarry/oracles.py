"""DuckDB SQL of the folds: chunk packing, web pages to elements, layout to elements. Each is one query of common table
expressions, over a relation that is given as SQL."""

from __future__ import annotations

from docquarry.config import CHUNKING

WHITE = "E' \\t\\n\\r'"


def tokens(x: str) -> str:
    """The token estimate of a string."""
    return f"CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, floor(length({x}) / 3.8::DOUBLE)::INTEGER) END"


def joined(parts: str, by: str) -> str:
    return f"array_to_string({parts}, {by})"


SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({{}}, '([.!?])\\s+([A-Z0-9✓✗•-])', '\\1' || chr(31) || '\\2', 'g'), chr(31)), lambda s: trim(s, {WHITE})), lambda s: s <> '')"

_BODY = "STRUCT(kind VARCHAR, page INTEGER, section VARCHAR, body VARCHAR)"
_GAP, _LINE = "chr(10) || chr(10)", "chr(10)"


def chunk_tables(elements: str) -> str:
    """The table expressions up to chunks: doc_name, ordinal, number, part, parts, page_number, section_path, element_type,
    raw_content. A document's elements are folded step by step, all documents side by side; then the sentences of prose
    above the budget, and the rows of tables above it."""
    prose = lambda held, page, section: f"{{'kind': 'prose', 'page': {page}, 'section': {section}, 'body': {joined(held, _GAP)}}}"
    fits = f"len(list_filter(range(1, len(held) + 1), lambda n: list_sum(list_transform(held[len(held) - n + 1:], lambda h: {tokens('h')})) <= {CHUNKING.overlap}))"
    return f"""
    src AS ({elements}),
    els AS (SELECT doc_name, row_number() OVER (PARTITION BY doc_name ORDER BY ord, page_number, element_type, content, section) AS i, page_number AS page, element_type AS kind, coalesce(content, '') AS content, coalesce(section, '') AS sec FROM src
            UNION ALL SELECT doc_name, count(*) + 1, NULL, 'end', '', '' FROM src GROUP BY 1),
    fold AS (SELECT DISTINCT doc_name, 0::BIGINT AS i, []::VARCHAR[] AS held, 'Introduction' AS section, 1 AS page, []::{_BODY}[] AS outs FROM src
             UNION ALL
             SELECT doc_name, i, CASE WHEN kind = 'heading' THEN ['### ' || trim(ltrim(content, '#'), {WHITE})] WHEN ends THEN [] ELSE grown END, section, page,
                    early || CASE WHEN ends THEN [{prose('grown', 'page', 'section')}]::{_BODY}[] ELSE [] END || CASE WHEN kind IN ('table', 'code') THEN [{{'kind': kind, 'page': page, 'section': section, 'body': content}}]::{_BODY}[] ELSE [] END
             FROM (SELECT *, kind IN ('heading', 'table', 'code', 'end') OR (kind = 'paragraph' AND {tokens(joined('grown', _GAP))} >= {CHUNKING.target}) AS ends
                   FROM (SELECT e.doc_name, e.i, e.kind, e.content, CASE WHEN e.sec NOT IN ('', f.section) THEN e.sec ELSE f.section END AS section, coalesce(e.page, f.page) AS page,
                                CASE WHEN e.sec NOT IN ('', f.section) THEN [] ELSE f.held END || CASE WHEN e.kind = 'paragraph' THEN [e.content] ELSE [] END AS grown,
                                CASE WHEN e.sec NOT IN ('', f.section) THEN [{prose('f.held', 'f.page', 'f.section')}]::{_BODY}[] ELSE [] END AS early
                         FROM fold f JOIN els e ON e.doc_name = f.doc_name AND e.i = f.i + 1))),
    flushed AS (SELECT doc_name, i, unnest(outs) AS o, generate_subscripts(outs, 1) AS k FROM fold),
    bodies AS (SELECT *, {tokens('body')} AS n FROM (SELECT doc_name, row_number() OVER (PARTITION BY doc_name ORDER BY i, k) AS f, o.kind AS kind, o.page AS page, o.section AS section, CASE WHEN o.kind = 'prose' THEN trim(o.body, {WHITE}) ELSE o.body END AS body FROM flushed) WHERE kind <> 'prose' OR body <> ''),
    sentences AS (SELECT doc_name, f, {SENTENCES.format('body')} AS parts FROM bodies WHERE kind = 'prose' AND n > {CHUNKING.most}),
    windows AS (SELECT doc_name, f, 0 AS j, []::VARCHAR[] AS held, NULL::VARCHAR AS out FROM sentences
                UNION ALL
                SELECT doc_name, f, j + 1, CASE WHEN fills THEN held[len(held) - {fits} + 1:] ELSE held END || [s], CASE WHEN fills THEN {joined('held', "' '")} END
                FROM (SELECT w.*, s.parts[w.j + 1] AS s, len(w.held) > 0 AND {tokens(joined("w.held || [s.parts[w.j + 1]]", "' '"))} > {CHUNKING.target} AS fills
                      FROM windows w JOIN sentences s ON s.doc_name = w.doc_name AND s.f = w.f AND w.j < len(s.parts))),
    tables AS (SELECT doc_name, f, lines[1] || chr(10) || lines[2] AS head, lines[3:] AS rows FROM (SELECT doc_name, f, list_filter(list_transform(string_split(body, chr(10)), lambda s: trim(s, {WHITE})), lambda s: s <> '') AS lines FROM bodies WHERE kind = 'table' AND n > {CHUNKING.most}) WHERE len(lines) >= 3),
    cuts AS (SELECT doc_name, f, 0 AS j, 1 AS part, []::VARCHAR[] AS held, NULL::VARCHAR AS out FROM tables
             UNION ALL
             SELECT doc_name, f, j + 1, part + fills::INTEGER, CASE WHEN fills THEN [] ELSE held END || [r], CASE WHEN fills THEN {joined('[head] || held', _LINE)} END
             FROM (SELECT c.*, t.head, t.rows[c.j + 1] AS r, len(c.held) > 0 AND {tokens(joined('[t.head] || c.held || [t.rows[c.j + 1]]', _LINE))} > {CHUNKING.target} AS fills
                   FROM cuts c JOIN tables t ON t.doc_name = c.doc_name AND t.f = c.f AND c.j < len(t.rows))),
    pieces AS (SELECT doc_name, f, 0 AS w, NULL::INTEGER AS part, body AS raw_content FROM bodies b WHERE NOT EXISTS (SELECT 1 FROM sentences s WHERE s.doc_name = b.doc_name AND s.f = b.f) AND NOT EXISTS (SELECT 1 FROM tables t WHERE t.doc_name = b.doc_name AND t.f = b.f)
               UNION ALL SELECT doc_name, f, j, NULL, out FROM windows WHERE out IS NOT NULL
               UNION ALL SELECT w.doc_name, w.f, w.j + 1, NULL, {joined('w.held', "' '")} FROM windows w JOIN sentences s ON s.doc_name = w.doc_name AND s.f = w.f AND w.j = len(s.parts)
               UNION ALL SELECT doc_name, f, part - 1, part - 1, out FROM cuts WHERE out IS NOT NULL
               UNION ALL SELECT c.doc_name, c.f, c.part, c.part, {joined('[t.head] || c.held', _LINE)} FROM cuts c JOIN tables t ON t.doc_name = c.doc_name AND t.f = c.f AND c.j = len(t.rows)),
    chunks AS (SELECT p.doc_name, (row_number() OVER (PARTITION BY p.doc_name ORDER BY p.f, w) - 1)::INTEGER AS ordinal, dense_rank() OVER (PARTITION BY p.doc_name ORDER BY p.f, CASE WHEN part IS NULL THEN w ELSE 0 END) AS number,
                      part, max(part) OVER (PARTITION BY p.doc_name, p.f) AS parts, page AS page_number, section AS section_path, kind AS element_type, raw_content
               FROM pieces p JOIN bodies b ON b.doc_name = p.doc_name AND b.f = p.f)"""


_STEM = "regexp_replace(doc_name, '^(.+)\\.[^.]*$', '\\1')"
_TITLE = "array_to_string(list_transform(regexp_extract_all(replace(replace(doc_name, '.pdf', ''), '_', ' '), '\\p{L}+|[^\\p{L}]+'), lambda r: upper(r[1]) || lower(r[2:])), '')"
_CRUMB = f"'[Document: ' || {_TITLE} || ' | Section: ' || CASE WHEN section_path = '' THEN 'Overview' ELSE trim(section_path, {WHITE}) END || ' | Page: ' || page_number || ']'"


def chunks(elements: str) -> str:
    """The rows of operators.chunking.chunks()."""
    text = f"{_CRUMB} || chr(10) || raw_content"
    return f"""WITH RECURSIVE {chunk_tables(elements)}
    SELECT {_STEM} || '_c' || number || CASE WHEN parts > 1 THEN '_p' || part ELSE '' END AS chunk_id,
           {_STEM} || '_s_' || trim(regexp_replace(lower(section_path), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g')[1:40], '_') AS parent_id,
           doc_name, page_number, section_path, element_type, {text} AS text, raw_content, {tokens(text)} AS token_count, length(raw_content)::INTEGER AS char_count, ordinal,
           CASE WHEN part IS NOT NULL THEN parts > 1 END AS is_split_table, part
    FROM chunks"""


#: Elements of plain texts, as plans.ingest.paragraphs() makes them: each line that isn't blank.
PARAGRAPHS = "SELECT 'doc_' || doc_id || '.pdf' AS doc_name, generate_subscripts(lines, 1) AS ord, 1 AS page_number, 'paragraph' AS element_type, unnest(lines) AS content, lang AS section FROM (SELECT *, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS lines FROM documents)"

#: Each document as one paragraph.
WHOLE = "SELECT 'doc_' || doc_id || '.pdf' AS doc_name, 0 AS ord, 1 AS page_number, 'paragraph' AS element_type, coalesce(text, '') AS content, lang AS section FROM documents"

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _unescaped(c: str) -> str:
    for entity, char in _ENTITIES:
        c = f"replace({c}, '{entity}', '{char}')"
    return c


_OPENS = "regexp_matches(piece, '(?is)^<(h[1-6]|p|li|pre)(\\s[^>]*)?>$')"
#: Elements of web pages, as sources.html makes them: a page is cut into tags and text, and a block reaches from an opening
#: tag of its kind to the next tag that bounds one.
HTML = f"""SELECT doc_name, (row_number() OVER w)::INTEGER AS ord, 1 AS page_number, element_type, content, coalesce(last_value(CASE WHEN element_type = 'heading' THEN content END IGNORE NULLS) OVER w, 'Introduction') AS section
    FROM (SELECT doc_name, block, CASE WHEN tag = 'pre' THEN 'code' WHEN starts_with(tag, 'h') THEN 'heading' WHEN tag = 'li' THEN 'list_item' ELSE 'paragraph' END AS element_type, content
          FROM (SELECT doc_name, block, lower(regexp_extract(arg_min(piece, i), '^<([A-Za-z]+[0-9]?)', 1)) AS tag, trim(regexp_replace({_unescaped("string_agg(CASE WHEN starts_with(piece, '<') AND length(piece) > 1 THEN ' ' ELSE piece END, '' ORDER BY i)")}, '\\s+', ' ', 'g')) AS content, arg_min(opens, i) AS is_block
                FROM (SELECT *, {_OPENS} AS opens, sum(({_OPENS} OR regexp_matches(piece, '(?is)^</(h[1-6]|p|li|pre|article|nav|ul|ol|div)>$') OR regexp_matches(piece, '(?is)^<(ul|ol|article|footer|nav|div)(\\s[^>]*)?>$'))::INTEGER) OVER (PARTITION BY doc_name ORDER BY i) AS block
                      FROM (SELECT doc_name, unnest(found) AS piece, generate_subscripts(found, 1) AS i FROM (SELECT 'page_' || page_id || '.html' AS doc_name, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>|[^<]+|<') AS found FROM pages)))
                GROUP BY 1, 2) WHERE is_block AND content <> '') WINDOW w AS (PARTITION BY doc_name ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


#: The table of crc32, as a CTE of one row, and what is left of a list of bytes b by it.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
CRC = "xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"


def hashed_features(docs: str, dimension: int) -> str:
    """doc_id, place and weight of operators.embedding.hashed_features()."""
    white = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+"
    return f"""WITH {CRC_TABLE},
    counts AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '{white}')) AS word FROM {docs}) WHERE word <> '' GROUP BY 1, 2),
    parts AS (SELECT word, unnest([word] || list_transform(range(1, length(word) - 1), lambda i: word[i:i + 2])) AS part FROM (SELECT DISTINCT word FROM counts)),
    bytes AS (SELECT part, list_transform(range(octet_length(encode(part))), lambda i: ('0x' || hex(encode(part))[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM (SELECT DISTINCT part FROM parts)),
    hashed AS (SELECT part, {CRC} AS h FROM bytes, crc),
    sums AS (SELECT doc_id, (h % {dimension})::INTEGER AS place, sum(CASE WHEN h >= 2147483648 THEN n ELSE -n END) AS n FROM counts JOIN parts USING (word) JOIN hashed USING (part) GROUP BY 1, 2 HAVING sum(CASE WHEN h >= 2147483648 THEN n ELSE -n END) <> 0)
    SELECT doc_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6)::DOUBLE AS weight FROM sums"""

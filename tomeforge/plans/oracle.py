"""DuckDB SQL for the named queries, written from their definitions and not from their Spark plans."""

from __future__ import annotations

from tomeforge.sources.tables import NAMESPACES, REDIRECT_CHARS

_CASES = " ".join(f"WHEN '{source}' THEN '{name}'" for source, name in NAMESPACES.items())
WIKI = rf"""wiki AS (
  SELECT doc_id AS page_id,
    (CASE source {_CASES} ELSE '' END) || source || ' ' || doc_id AS title,
    coalesce(n_chars < {REDIRECT_CHARS}, false) AS is_redirect,
    CASE WHEN n_chars < {REDIRECT_CHARS} THEN source || ' ' || (doc_id + 1) END AS redirect_to,
    coalesce(regexp_replace(regexp_replace(regexp_replace(text, '([A-Z][a-z]+) ([a-z]+)', '[[\1#sec| \2 ]]', 'g'),
      ' ([a-z]+)[.]', ' [[\1]] [[:File:\1]] [[File:\1.jpg|thumb|see [[\1]]]].', 'g'),
      ', ([a-z]+) ([a-z]+)', ', [[\1<b]] [[\2|see User talk:\1]] [[Talk File talk:\2]] [[ :\1]] [[<\2]] ', 'g')
      || '==References== [[Category:' || lang || '|k]] [[Category:' || source || ']]', '') AS text
  FROM documents)"""
HTML = r"""wiki AS (
  SELECT page_id, url AS title, false AS is_redirect, NULL::VARCHAR AS redirect_to,
    coalesce(regexp_replace(html, '<a href="/([^"]*)">([^<]*)</a>', '[[\1|\2]]', 'g'), '') AS text
  FROM pages)"""
_HIDDEN = " OR ".join(f"starts_with(title, '{p}')" for p in ("File:", "Template:", "Wikipedia:", "User talk:", "File talk:"))
_MARK = "'==References=='"
_BEFORE = f"CASE WHEN contains(text, {_MARK}) THEN array_to_string(list_slice(string_split(text, {_MARK}), 1, -2), {_MARK}) ELSE text END"
_FROM = f"CASE WHEN contains(text, {_MARK}) THEN {_MARK} || string_split(text, {_MARK})[-1] ELSE text END"
RAW = "raw AS (SELECT * FROM wiki WHERE NOT is_redirect AND text IS NOT NULL)"
ARTICLES = f"articles AS (SELECT * FROM raw WHERE NOT ({_HIDDEN}))"


def utrim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g')"


def found(name: str, table: str, text: str = "text") -> str:
    """CTEs down to `name` (page_id, i, c): what stands between each [[ and the next ]]."""
    return f"""{name}_p AS (SELECT page_id, string_split({text}, '[[') AS p FROM {table}),
{name}_q AS (SELECT page_id, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS i FROM {name}_p),
{name}_j AS (SELECT page_id, i, min(CASE WHEN contains(x, ']]') THEN i END) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS j FROM {name}_q),
{name} AS (SELECT page_id, i, split_part(array_to_string(list_slice(p, i, j), '[['), ']]', 1) AS c FROM {name}_j JOIN {name}_p USING (page_id) WHERE i > 1 AND j IS NOT NULL)"""


def anchors(name: str, table: str, text: str = "text") -> str:
    """CTEs down to `name` (page_id, i, page, surface): parsed links."""
    trimmed, ahead, behind = utrim("c"), utrim("left(c, strpos(c, '|') - 1)"), utrim("substr(c, strpos(c, '|') + 1)")
    return found(f"{name}_c", table, text) + f""",
{name} AS (SELECT page_id, i, c,
  CASE WHEN strpos(c, '|') > 0 THEN split_part({ahead}, '#', 1)
       WHEN strpos(c, '#') > 0 THEN left({trimmed}, strpos(c, '#') - 1) ELSE {trimmed} END AS page,
  CASE WHEN strpos(c, '|') > 0 THEN nullif(regexp_replace({behind}, '^''+|''+$', '', 'g'), '') END AS surface
  FROM {name}_c WHERE NOT starts_with(c, '#') AND NOT regexp_matches(c, '^[A-Za-z]+:'))"""


def counted(name: str, table: str, where: str = "true") -> str:
    return f"{name} AS (SELECT {utrim('lower(coalesce(surface, page))')} AS surface, {utrim('page')} AS entity, count(*) AS n FROM {table} WHERE {where} GROUP BY ALL)"


_FLAT = "NOT starts_with(c, ':') AND NOT starts_with(c, '<') AND NOT contains(c, 'User talk:') AND NOT contains(c, 'File talk:')"
FLAT = f"{WIKI}, {RAW}, {anchors('a', 'raw')}, {counted('counts', 'a', _FLAT)}"
FLAT_HTML = f"{HTML}, {RAW}, {anchors('a', 'raw')}, {counted('counts', 'a', _FLAT)}"
EVERY = f"{WIKI}, {RAW}, {anchors('a', 'raw')}, {counted('counts', 'a')}"
BODY = f"{WIKI}, {RAW}, {ARTICLES}, {anchors('a', 'articles', _BEFORE)}"
PAGE = f"{BODY}, {counted('counts', 'a')}"
RECORDS = f"""{BODY}, {found('k', 'articles', _FROM)},
anchored AS (SELECT page_id, list(struct_pack(page := page, surface := surface) ORDER BY i) AS anchors FROM a GROUP BY page_id),
sorted AS (SELECT page_id, list(substr(split_part(c, '|', 1), 10) ORDER BY i) AS categories FROM k WHERE starts_with(c, 'Category:') GROUP BY page_id),
records AS (SELECT title, page_id::VARCHAR AS id, coalesce(anchors, []) AS anchors, coalesce(categories, []) AS categories
  FROM articles LEFT JOIN anchored USING (page_id) LEFT JOIN sorted USING (page_id))"""
_WORDS = r"list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: CASE WHEN strlen(w) >= 40 THEN chr(1) ELSE w END)"
INDEX = f"""{WIKI}, {RAW}, {ARTICLES}, {anchors('a', 'articles')},
outs AS (SELECT page_id, list(replace(page, ' ', '_') ORDER BY i) AS outlinks FROM a GROUP BY page_id),
ix AS (SELECT page_id AS id, title, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' AS content, coalesce(outlinks, []) AS outlinks
  FROM articles LEFT JOIN outs USING (page_id))"""
LINES = f"{WIKI}, lines AS (SELECT (length(text) // 64) || ':' || page_id || ':' || title AS value FROM wiki WHERE text IS NOT NULL)"
PARSED = f"{LINES}, ixl AS (SELECT split_part(value, ':', 1)::BIGINT AS \"offset\", split_part(value, ':', 2)::BIGINT AS page_id, array_to_string(list_slice(string_split(value, ':'), 3, -1), ':') AS title, value FROM lines)"
SHARE = "shares AS (SELECT surface, entity, n, n / sum(n) OVER (PARTITION BY surface) AS commonness FROM counts)"


def _q(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _flagged(prefixes: tuple[str, ...]) -> str:
    return " OR ".join(f"starts_with(page, '{p}')" for p in prefixes)


def _json_string(x: str) -> str:
    return f"to_json({x})::VARCHAR"


_NAMES = "array_to_string(list_transform(%s, lambda c: '\"' || replace(c, '\"', '\\\"') || '\"'), ',')"
_TARGETS = "list_transform(anchors, lambda a: a.page)"
_GROUPS = "(VALUES (0, 'The'), (0, 'the'), (1, 'of'), (1, 'and'), (1, 'the'), (2, 'nowhere to be found'))"
_PHRASES = "(VALUES ('of the'), ('the'), ('la de'), ('In THE'), ('not in any text at all'), ('...'))"

_DUMPED = "row_number() OVER (ORDER BY page_id) - 1"

SQL: dict[str, str] = {
    "dump_pages": _q(WIKI, "SELECT page_id, title, is_redirect, redirect_to, nullif(text, '') AS text FROM wiki"),
    "dump_templates": _q(WIKI, "SELECT title, text AS page FROM wiki WHERE starts_with(title, 'Template:') AND text <> ''"),
    "dump_streams": _q(WIKI, f"SELECT min(page_id) AS first_id, count(*) AS pages, count(*) AS lines FROM (SELECT page_id, ({_DUMPED}) // 100 AS stream FROM wiki) GROUP BY stream"),
    "dump_one_stream": _q(WIKI, f"SELECT title FROM (SELECT title, ({_DUMPED}) // 100 AS stream FROM wiki) WHERE stream = 1"),
    "page_indices_stored": _q(PARSED, "SELECT \"offset\", list(page_id ORDER BY page_id) AS page_ids FROM ixl GROUP BY ALL"),
    "template_indices_stored": _q(PARSED, "SELECT \"offset\", list(page_id ORDER BY page_id) AS page_ids FROM ixl WHERE contains(value, 'Template:') GROUP BY ALL"),
    "anchor_lines_file": _q(BODY, "SELECT coalesce(surface, page) AS surface, page AS entity, count(*) AS n FROM a GROUP BY ALL"),
    "counts_store": _q(FLAT, "SELECT * FROM counts"),
    "counts_store_lookup": _q(FLAT, "SELECT entity, n FROM counts WHERE surface = 'of'"),
    "index_store_phrase": _q(INDEX, "SELECT count(*) FILTER (WHERE contains(content, ' of the ')) AS n FROM ix"),
    "key_split": _q(FLAT, "SELECT * FROM counts"),
    "form_is_empty": _q(FLAT, "SELECT t.text, count(surface) = 0 AS is_empty, coalesce(sum(n), 0)::DOUBLE AS wiki_occurrences FROM (VALUES ('of'), ('no such form')) t(text) LEFT JOIN counts ON surface = t.text GROUP BY t.text"),
    "streamed_counts": _q(FLAT, "SELECT surface, entity, n::BIGINT AS n FROM counts"),
    "anchor_counts_flat": _q(FLAT, "SELECT * FROM counts"),
    "anchor_counts_flat_html": _q(FLAT_HTML, "SELECT * FROM counts"),
    "anchor_counts_nested": _q(EVERY, "SELECT surface, list(entity || '=' || n ORDER BY entity) AS entities FROM counts GROUP BY surface"),
    "anchor_counts_page": _q(PAGE, "SELECT * FROM counts"),
    "anchor_counts_lines": _q(BODY, "SELECT coalesce(surface, page) AS surface, page AS entity, count(*) AS n FROM a GROUP BY ALL"),
    "anchor_counts_min2": _q(PAGE, "SELECT surface || chr(9) || entity || chr(9) || n AS value FROM counts WHERE n > 1"),
    "merged_counts": _q(f"{FLAT}, {anchors('b', 'articles', _BEFORE)}, {counted('more', 'b')}".replace(f"{RAW}, ", f"{RAW}, {ARTICLES}, ", 1), "SELECT surface, entity, sum(n)::BIGINT AS n FROM (SELECT * FROM counts UNION ALL SELECT * FROM more) GROUP BY ALL"),
    "surface_occurrences": _q(FLAT, "SELECT surface, sum(n)::DOUBLE AS wiki_occurrences FROM counts GROUP BY surface"),
    "commonness": _q(f"{FLAT}, {SHARE}", "SELECT * FROM shares"),
    "commonness_html": _q(f"{FLAT_HTML}, {SHARE}", "SELECT * FROM shares"),
    "wiki_matches_threshold": _q(f"{FLAT}, {SHARE}", "SELECT * FROM shares WHERE commonness >= 0.4"),
    "mention_commonness": _q(f"{BODY}, {anchors('f', 'raw')}, {counted('counts', 'f', _FLAT)}, {SHARE}", f"SELECT m.page_id, m.i, m.surface, m.entity, coalesce(s.commonness, 0) AS commonness FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS i, {utrim('lower(coalesce(surface, page))')} AS surface, {utrim('page')} AS entity FROM a) m LEFT JOIN shares s USING (surface, entity)"),
    "surface_forms": _q(FLAT, "SELECT surface AS text, list(entity || '=' || n ORDER BY entity) AS anchors, sum(n)::DOUBLE AS wiki_occurrences FROM counts GROUP BY surface"),
    "surface_sources": _q(FLAT, "SELECT surface, entity, n, 'anchor' AS source FROM counts UNION ALL SELECT lower(title), title, 0, 'title' FROM wiki WHERE NOT is_redirect UNION ALL SELECT lower(title), redirect_to, 0, 'redirect' FROM wiki WHERE redirect_to IS NOT NULL AND NOT (starts_with(title, 'Wikipedia:') OR starts_with(title, 'Template:') OR starts_with(title, 'Portal:') OR starts_with(title, 'List of '))"),
    "key_counts": _q(FLAT, "SELECT surface || chr(9) || entity AS key, n FROM counts"),
    "entities_for_surface": _q(FLAT, "SELECT entity, n FROM counts WHERE surface = 'of'"),
    "fetch_one": _q(FLAT, "SELECT surface || chr(9) || entity AS key, n FROM counts WHERE surface = 'the'"),
    "prefix_lookup": _q(FLAT, "SELECT surface || chr(9) || entity AS key, entity, n FROM counts WHERE starts_with(surface || chr(9) || entity, 'th')"),
    "prefix_lookup_surface": _q(FLAT, "SELECT surface || chr(9) || entity AS key, entity, n FROM counts WHERE starts_with(surface || chr(9) || entity, 'the' || chr(9))"),
    "regex_lookup": _q(FLAT, "SELECT entity, arg_max(n, surface) AS n FROM counts WHERE regexp_matches(surface || chr(9) || entity, '(?s)^(?:th[ae].*' || chr(9) || '.*)$') GROUP BY entity"),
    "surface_form_of": _q(FLAT, "SELECT 'of' AS text, list(entity || '=' || n ORDER BY entity) AS anchors, sum(n)::DOUBLE AS wiki_occurrences FROM counts WHERE surface = 'of'"),
    "top_entities": _q(FLAT, "SELECT * FROM (SELECT surface, entity, n, row_number() OVER (PARTITION BY surface ORDER BY n DESC, entity) AS place FROM counts) WHERE place <= 3"),
    "raw_page_scan": _q(f"{WIKI}, {RAW}", "SELECT page_id, text FROM raw"),
    "article_scan": _q(f"{WIKI}, {RAW}, {ARTICLES}", "SELECT page_id, title, text FROM articles"),
    "filtered_titles": _q(WIKI, f"SELECT title, {_HIDDEN} AS hidden, NOT (starts_with(title, 'Wikipedia:') OR starts_with(title, 'Template:') OR starts_with(title, 'Portal:') OR starts_with(title, 'List of ')) AS valid_alias, starts_with(title, 'Template:') AS is_template, title AS stripped, regexp_replace(title, '(?s)[(,].*$', '') AS cut FROM wiki"),
    "link_candidates": _q(f"{WIKI}, {RAW}, {found('c', 'raw')}", "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, c AS link FROM c WHERE NOT starts_with(c, '#') AND NOT regexp_matches(c, '^[A-Za-z]+:')"),
    "page_anchors": _q(RECORDS, "SELECT page_id::VARCHAR AS id, title, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, page, surface FROM a JOIN articles USING (page_id)"),
    "page_categories": _q(RECORDS, "SELECT id, unnest(categories) AS category, 'Category:' || unnest(categories) AS qualified FROM records"),
    "anchor_kinds": _q(f"{WIKI}, {RAW}, {found('c', 'raw')}, t AS (SELECT split_part(c, '|', 1) AS page FROM c)", f"SELECT page, count(*) AS n, any_value(CASE WHEN {_flagged(('File:', 'Image:'))} THEN 'file' WHEN {_flagged(('wikt:', 'wiktionary:'))} THEN 'wiktionary' WHEN starts_with(page, 's:') THEN 'wikisource' WHEN starts_with(page, 'v:') THEN 'wikiversity' WHEN starts_with(page, 'hdl:') THEN 'handle' END) AS kind FROM t GROUP BY page"),
    "find_indices": "SELECT doc_id, list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 2) = 'nn') AS places FROM documents WHERE text IS NOT NULL",
    "pages_json": _q(RECORDS, f"SELECT '{{\"title\":' || {_json_string('title')} || ',\"id\":' || {_json_string('id')} || ',\"anchors\":[' || array_to_string(list_transform(anchors, lambda a: CASE WHEN a.surface IS NULL THEN '{{\"Direct\":' || {_json_string('a.page')} || '}}' ELSE '{{\"Label\":{{\"surface\":' || {_json_string('a.surface')} || ',\"page\":' || {_json_string('a.page')} || '}}}}' END), ',') || '],\"categories\":[' || array_to_string(list_transform(categories, lambda c: {_json_string('c')}), ',') || ']}}' AS value FROM records"),
    "categories_tsv": _q(RECORDS, f"SELECT id || chr(9) || title || chr(9) || {_NAMES % 'categories'} AS value FROM records"),
    "categories_jsonl": _q(RECORDS, "SELECT '{\"id\":' || to_json(id) || ',\"title\":' || to_json(title) || ',\"categories\":[' || array_to_string(list_transform(categories, lambda c: to_json(c)::VARCHAR), ',') || ']}' AS value FROM records"),
    "categories_jsonl_compat": _q(RECORDS, f"SELECT '{{\"id\":' || id || ',\"title\":\"' || title || '\",\"categories\":[' || {_NAMES % 'categories'} || ']}},' AS value FROM records"),
    "anchors_tsv": _q(RECORDS, "SELECT page_id || chr(9) || title || chr(9) || coalesce(surface, page) || chr(9) || page AS value FROM a JOIN articles USING (page_id)"),
    "anchors_jsonl": _q(RECORDS, f"SELECT '{{\"id\":' || to_json(id) || ',\"title\":' || to_json(title) || ',\"anchors\":[' || array_to_string(list_transform({_TARGETS}, lambda c: to_json(c)::VARCHAR), ',') || ']}}' AS value FROM records"),
    "anchors_jsonl_compat": _q(RECORDS, f"SELECT '{{\"id\":' || id || ',\"title\":\"' || title || '\",\"anchors\":[' || {_NAMES % _TARGETS} || ']}},' AS value FROM records"),
    "outlinks": _q(RECORDS, "SELECT id, array_to_string(list_transform(anchors, lambda a: replace(a.page, ' ', '_')), ' ') AS outlinks FROM records"),
    "redirects": _q(WIKI, "SELECT title AS \"from\", redirect_to AS \"to\" FROM wiki WHERE redirect_to IS NOT NULL AND NOT (starts_with(title, 'Wikipedia:') OR starts_with(title, 'Template:') OR starts_with(title, 'Portal:') OR starts_with(title, 'List of '))"),
    "redirects_tsv": _q(WIKI, "SELECT title || chr(9) || redirect_to AS value FROM wiki WHERE redirect_to IS NOT NULL AND NOT (starts_with(title, 'Wikipedia:') OR starts_with(title, 'Template:') OR starts_with(title, 'Portal:') OR starts_with(title, 'List of '))"),
    "templates": _q(WIKI, "SELECT title, text AS page FROM wiki WHERE starts_with(title, 'Template:') AND text IS NOT NULL"),
    "templates_text": _q(WIKI, "SELECT concat_ws(chr(10), '<page>', '   <title>' || title || '</title>', '   <ns>10</ns>', '   <text>' || text, '   </text>', '</page>') AS value FROM wiki WHERE starts_with(title, 'Template:') AND text IS NOT NULL"),
    "index_lines": _q(PARSED, "SELECT \"offset\", page_id, title, true AS is_valid FROM ixl"),
    "index_by_offset": _q(PARSED, "SELECT \"offset\", list(page_id ORDER BY page_id) AS page_ids FROM ixl GROUP BY ALL"),
    "template_index": _q(PARSED, "SELECT \"offset\", list(page_id ORDER BY page_id) AS page_ids FROM ixl WHERE contains(value, 'Template:') GROUP BY ALL"),
    "compact_index": _q(PARSED, "SELECT \"offset\" || ' ' || string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS value FROM ixl GROUP BY \"offset\""),
    "compact_index_read": _q(PARSED, "SELECT \"offset\", list(page_id ORDER BY page_id) AS page_ids FROM ixl GROUP BY ALL"),
    "title_ids_tsv": _q(PARSED, "SELECT page_id || chr(9) || title AS value FROM ixl"),
    "nth_offset": _q(PARSED, "SELECT \"offset\" FROM (SELECT DISTINCT \"offset\" FROM ixl) ORDER BY 1 LIMIT 1 OFFSET 5"),
    "search_index": _q(INDEX, "SELECT * FROM ix"),
    "index_size": _q(INDEX, "SELECT count(*) AS n FROM ix"),
    "phrase_df": _q(INDEX, "SELECT count(*) FILTER (WHERE contains(content, ' of the ')) AS n FROM ix"),
    "phrases_df": _q(INDEX, f"SELECT phrase, (SELECT count(*) FROM ix WHERE contains(content, ' ' || array_to_string(regexp_extract_all(lower(phrase), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), ' ') || ' ') AND regexp_matches(phrase, '[\\p{{L}}\\p{{M}}\\p{{N}}]')) AS n FROM {_PHRASES} t(phrase)"),
    "mutual_outlinks": _q(INDEX, "SELECT count(*) FILTER (WHERE list_has_all(outlinks, ['the', 'of'])) AS n FROM ix"),
    "mutual_outlinks_of": _q(INDEX, f"SELECT g AS \"group\", (SELECT count(*) FROM ix WHERE list_has_all(outlinks, w)) AS n FROM (SELECT g, list(replace(t, ' ', '_')) AS w FROM {_GROUPS} v(g, t) GROUP BY g)"),
    "link_probability": _q(f"{FLAT.replace(RAW, f'{RAW}, {ARTICLES}')}, ws AS (SELECT page_id, {_WORDS.format('text')} AS w FROM articles), ph AS (SELECT surface, regexp_extract_all(lower(surface), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS p, sum(n) AS uses FROM counts GROUP BY surface), grams AS (SELECT DISTINCT page_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT page_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, (SELECT DISTINCT len(p) AS k FROM ph WHERE len(p) > 0))), df AS (SELECT k, g, count(*) AS n FROM grams GROUP BY ALL)", "SELECT surface, CASE WHEN df.n > 0 THEN least(1.0, uses / df.n) ELSE 0.0 END::DOUBLE AS link_probability FROM ph LEFT JOIN df ON df.k = len(p) AND df.g = array_to_string(p, ' ')"),
    "relatedness": _q(f"{INDEX}, po AS (SELECT DISTINCT id, unnest(outlinks) AS title FROM ix), de AS (SELECT title, count(*) AS d FROM po GROUP BY title), pr AS (SELECT a, b FROM {_GROUPS} x(g, a), {_GROUPS} y(h, b) WHERE a < b AND NOT contains(a, ' ') AND NOT contains(b, ' ') GROUP BY ALL), bo AS (SELECT a, b, count(*) AS c FROM pr JOIN po p ON p.title = a JOIN po q ON q.title = b AND q.id = p.id GROUP BY ALL)", "SELECT pr.a, pr.b, coalesce(greatest(0.0, 1 - (ln(greatest(x.d, y.d)) - ln(c)) / (ln((SELECT count(*) FROM ix)) - ln(least(x.d, y.d)))), 0.0) AS relatedness FROM pr LEFT JOIN bo USING (a, b) LEFT JOIN de x ON x.title = pr.a LEFT JOIN de y ON y.title = pr.b"),
}

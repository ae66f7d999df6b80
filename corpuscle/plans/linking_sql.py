"""The SQL of the linking queries.

``fold`` states the normalization contract for the characters that occur in documents and delivered keys: letters and digits of
several scripts, full-width digits, combining marks, blanks and punctuation. It is no general form of the contract, which has no SQL.
"""


def fold(x: str) -> str:
    return f"replace(replace(strip_accents(lower(translate({x}, '０１２３４５６７８９', '0123456789'))), 'ß', 'ss'), 'ς', 'σ')"


def norm(x: str) -> str:
    return rf"nullif(trim(regexp_replace({fold(x)}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '')"


# Documents as normalized characters with their places: z (one row a character), k (one row a document).
CHARS = rf"""
WITH ch AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS pos FROM documents),
m AS (SELECT doc_id, pos, CASE WHEN regexp_full_match({fold("c")}, '[\p{{L}}\p{{N}}]*') THEN {fold("c")} ELSE ' ' END AS f FROM ch),
e AS (SELECT doc_id, pos, unnest(regexp_extract_all(f, '(?s).')) AS x, generate_subscripts(regexp_extract_all(f, '(?s).'), 1) AS sub FROM m),
w AS MATERIALIZED (SELECT *, lead(x) OVER o AS nx, count(*) FILTER (x <> ' ') OVER o AS seen FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY pos, sub)),
z AS MATERIALIZED (SELECT doc_id, x, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS i FROM w WHERE x <> ' ' OR (nx <> ' ' AND seen > 0)),
k AS MATERIALIZED (SELECT doc_id, string_agg(x, '' ORDER BY i) AS norm FROM z GROUP BY doc_id)"""

_EDGES = "SELECT surface_key, try_cast(substring(q, 2) AS BIGINT) AS qid FROM (SELECT surface_key, unnest(string_split(qids, '|')) AS q FROM surface_qids) WHERE regexp_full_match(q, 'Q[0-9]+')"
# The dictionary: dict(surface_id, shard_id, surface_key, qids).
DICT = f"""
edges AS ({_EDGES}),
keyed AS (SELECT {norm("surface_key")} AS surface_key, qid FROM edges),
surf AS (SELECT surface_key, list_sort(list(DISTINCT qid)) AS qids FROM keyed WHERE surface_key IS NOT NULL AND qid <= 4294967295 GROUP BY surface_key),
dict AS MATERIALIZED (SELECT row_number() OVER (ORDER BY surface_key) - 1 AS surface_id, CAST(floor((row_number() OVER (ORDER BY surface_key) - 1) / 1000) AS INT) AS shard_id, surface_key, qids FROM surf),
flagged AS MATERIALIZED (SELECT qid, bit_or(coalesce(flags, 0)) AS flags FROM (SELECT try_cast(substring(qid, 2) AS BIGINT) AS qid, flags FROM qid_flags WHERE regexp_full_match(qid, 'Q[0-9]+')) WHERE qid <= 4294967295 GROUP BY qid)"""
# found(doc_id, start, end, surface_id): places where the first three characters fit, then the whole key.
FOUND = (
    CHARS
    + ","
    + DICT
    + """,
g AS MATERIALIZED (SELECT doc_id, i, x || lead(x, 1, '') OVER o || lead(x, 2, '') OVER o AS seed FROM z WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hit AS MATERIALIZED (SELECT k.doc_id, norm, surface_key, surface_id, length(surface_key) AS n FROM k JOIN dict ON contains(norm, surface_key)),
spot AS MATERIALIZED (SELECT doc_id, surface_id, n, i FROM hit JOIN g USING (doc_id) WHERE g.seed[1:least(3, n)] = surface_key[1:3] AND substring(norm, g.i, n) = surface_key),
found AS MATERIALIZED (SELECT s.doc_id, CAST(a.pos - 1 AS INT) AS start, CAST(b.pos AS INT) AS "end", s.surface_id
  FROM spot s JOIN z a ON a.doc_id = s.doc_id AND a.i = s.i JOIN z b ON b.doc_id = s.doc_id AND b.i = s.i + s.n - 1),
cand AS MATERIALIZED (SELECT surface_id, shard_id, nth, qid, coalesce(flags, 0) & 1 = 1 AS dis FROM (SELECT surface_id, shard_id, unnest(qids) AS qid, generate_subscripts(qids, 1) AS nth FROM dict) LEFT JOIN flagged USING (qid))"""
)


def _matches(where: str = "true", most: int | None = None) -> str:
    kept = f"SELECT surface_id, shard_id, nth, qid, row_number() OVER (PARTITION BY surface_id ORDER BY nth) AS n FROM cand WHERE {where}"
    cap = "" if most is None else f" WHERE n <= {most}"
    return (
        FOUND
        + f""", lists AS (SELECT surface_id, any_value(shard_id) AS shard_id, string_agg('Q' || qid, '|' ORDER BY nth) AS qids FROM ({kept}){cap} GROUP BY surface_id)
SELECT f.doc_id, f.start, f."end", f.surface_id, shard_id, qids FROM found f JOIN lists USING (surface_id)"""
    )


def _apart(order: str) -> str:
    """Occurrences that don't overlap, one after the other: of those that begin after the last one the least by ``order``."""
    least = f"min({order})"
    return (
        FOUND.replace("WITH ch", "WITH RECURSIVE ch", 1)
        + f""", pick AS (SELECT doc_id, {least} AS m FROM found f GROUP BY doc_id
  UNION ALL SELECT f.doc_id, {least} FROM pick p JOIN found f ON f.doc_id = p.doc_id AND f.start >= p.m.e GROUP BY f.doc_id)
SELECT doc_id, m.s AS start, m.e AS "end", m.i AS surface_id FROM pick"""
    )


_ROWS = "SELECT wiki, page_id, title, qid, is_disambiguation FROM page WHERE wiki IS NOT NULL AND page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wiki, page_id ORDER BY dump_date DESC, loaded_at DESC, title DESC NULLS LAST, qid DESC NULLS LAST) = 1"
_PAGES = f"WITH p AS (SELECT wiki, page_id * 1000 + dense_rank() OVER (ORDER BY wiki) AS page_id, coalesce(title, '') AS title, qid, is_disambiguation FROM ({_ROWS})), "
_MAIN = _PAGES + "main AS (SELECT * FROM p)"
_ALL = 'SELECT doc_id, start, "end", surface_id FROM found'

_ENTITY = f"WITH {DICT}, raw AS (SELECT qid, surface_key FROM edges WHERE qid <= 4294967295), "
_ENTITY_KEYS = f"ek AS (SELECT DISTINCT {norm('surface_key')} AS surface_key, qid FROM raw WHERE {norm('surface_key')} IS NOT NULL)"
_JSON_LIST = """'[' || coalesce(string_agg('{"qid":"Q' || qid || '","qid_number":' || qid || ',"disambiguation":' || dis || '}', ',' ORDER BY nth), '') || ']'"""

ORACLES = {
    "normalize_documents": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "normalize_keys": f"SELECT surface_id, {norm('surface_key')} AS norm FROM surface_qids",
    "normalize_spans": CHARS + " SELECT doc_id, string_agg(x, '' ORDER BY i) AS norm, list(CAST(pos - 1 AS INT) ORDER BY i) AS starts, list(CAST(pos AS INT) ORDER BY i) AS ends FROM z GROUP BY doc_id",
    "utf16_lengths": "SELECT edge_id, CAST(length(surface_key) + length(regexp_replace(surface_key, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS INT) AS n_utf16 FROM surface_source",
    "tsv_escapes": r"SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS escaped, text AS back FROM documents",
    "tsv_roundtrip": f"WITH {DICT} SELECT surface_key, qids, CAST(len(qids) AS INT) AS qid_count FROM surf",
    "flags_roundtrip": f"WITH {DICT} SELECT qid, flags FROM flagged",
    "qid_parse": """SELECT qid, valid_from, number, 'Q' || number AS back, coalesce(flags & 1 = 1, false) AS disambiguation
  FROM (SELECT *, CASE WHEN regexp_full_match(qid, 'Q[0-9]+') AND try_cast(substring(qid, 2) AS BIGINT) <= 4294967295 THEN try_cast(substring(qid, 2) AS BIGINT) END AS number FROM qid_flags)""",
    "dump_targets": """
WITH s AS (SELECT DISTINCT wiki, dump_date FROM page WHERE wiki IS NOT NULL AND dump_date IS NOT NULL),
a AS (SELECT * FROM s UNION ALL SELECT DISTINCT wiki, 'latest' FROM s),
c AS (SELECT *, unnest(['page', 'redirect', 'page_props', 'wikidata_entities']) AS component FROM a WHERE regexp_full_match(dump_date, 'latest|[0-9]{8}')),
f AS (SELECT *, CASE WHEN component <> 'wikidata_entities' THEN wiki || '-' || dump_date || '-' || component || '.sql.gz'
  WHEN dump_date = 'latest' THEN 'latest-all.json.bz2' ELSE 'wikidata-' || dump_date || '-all.json.bz2' END AS file FROM c)
SELECT wiki, nullif(regexp_extract(wiki, '^(.+)wiki$', 1), '') AS lang, dump_date, component, file,
  'https://dumps.wikimedia.org/' || CASE WHEN component <> 'wikidata_entities' THEN wiki || '/' || dump_date || '/' WHEN dump_date = 'latest' THEN 'wikidatawiki/entities/'
  ELSE 'wikidatawiki/entities/' || dump_date || '/' END || file AS url FROM f""",
    "dump_pages": _MAIN + " SELECT page_id, title FROM main",
    "page_props_pivot": _MAIN + " SELECT page_id, title, qid, is_disambiguation FROM main",
    "redirect_targets": _MAIN
    + """, r AS (SELECT wiki, page_id, lead(title) OVER (PARTITION BY wiki ORDER BY page_id) AS target FROM p),
t AS (SELECT wiki, title, arg_min(coalesce(qid, -1), page_id) AS qid FROM main GROUP BY ALL)
SELECT s.page_id AS from_id, s.title, t.qid FROM r JOIN main s USING (page_id) JOIN t ON t.wiki = r.wiki AND t.title = r.target WHERE t.qid >= 0""",
    "stage_counts": _MAIN
    + rf""", r AS (SELECT wiki, page_id, lead(title) OVER (PARTITION BY wiki ORDER BY page_id) AS target FROM p),
t AS (SELECT wiki, title, arg_min(coalesce(qid, -1), page_id) AS qid FROM main GROUP BY ALL),
led AS (SELECT s.title FROM r JOIN main s USING (page_id) JOIN t ON t.wiki = r.wiki AND t.title = r.target WHERE t.qid >= 0),
titled AS (SELECT title FROM main WHERE qid IS NOT NULL UNION ALL SELECT title FROM led),
{DICT}, raw AS (SELECT qid, surface_key FROM edges WHERE qid <= 4294967295), {_ENTITY_KEYS}
SELECT 'pages' AS stage, count(*) AS n FROM main UNION ALL SELECT 'pages_with_qid', count(qid) FROM main
UNION ALL SELECT 'disambiguation_pages', count(*) FROM main WHERE is_disambiguation
UNION ALL SELECT 'redirect_surfaces', count(*) FROM titled WHERE regexp_matches(title, '[\p{{L}}\p{{N}}]')
UNION ALL SELECT 'entities', count(DISTINCT qid) FROM raw UNION ALL SELECT 'entity_surfaces', count(*) FROM ek""",
    "entity_surfaces": _ENTITY + _ENTITY_KEYS + " SELECT surface_key, qid FROM ek",
    "entity_flags": _ENTITY + "q AS (SELECT DISTINCT qid FROM raw) SELECT qid, CAST(coalesce(flags, 0) & 1 AS INT) AS flags FROM q LEFT JOIN flagged USING (qid)",
    "surface_dictionary": f"WITH {DICT} SELECT surface_key, qids, CAST(len(qids) AS INT) AS qid_count FROM surf",
    "merged_flags": _MAIN
    + f", {DICT}, f AS (SELECT qid, CASE WHEN is_disambiguation THEN 1 ELSE 0 END AS flags FROM main WHERE qid IS NOT NULL UNION ALL SELECT qid, flags FROM flagged) SELECT qid, CAST(bit_or(flags) AS INT) AS flags FROM f GROUP BY qid",
    "surface_ids": f"WITH {DICT} SELECT surface_id, shard_id, surface_key, qids, CAST(length(surface_key) AS INT) AS utf16_len FROM dict",
    "shard_stats": f"WITH {DICT} SELECT shard_id, min(surface_id) AS surface_start, count(*) AS surface_count, max(surface_id) + 1 AS surface_end, CAST(sum(strlen(surface_key)) AS BIGINT) AS pattern_bytes FROM dict GROUP BY shard_id",
    "referenced_qids": f"WITH {DICT}, u AS (SELECT DISTINCT unnest(qids) AS qid FROM surf) SELECT qid, CAST(coalesce(flags, 0) AS INT) AS flags FROM u LEFT JOIN flagged USING (qid)",
    "surface_offsets": f"WITH {DICT} SELECT surface_id, CAST(coalesce(sum(len(qids)) OVER (ORDER BY surface_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", CAST(len(qids) AS INT) AS length FROM dict",
    "candidates": FOUND + f" SELECT surface_id, {_JSON_LIST} AS candidates FROM cand GROUP BY surface_id",
    "char_codes": f"WITH {DICT}, c AS (SELECT unnest(regexp_extract_all(surface_key, '(?s).')) AS ch FROM surf), n AS (SELECT ch, count(*) AS freq FROM c GROUP BY ch) SELECT ch, freq, CAST(row_number() OVER (ORDER BY freq DESC, ch) - 1 AS INT) AS code FROM n",
    "dictionary_metadata": f"""WITH {DICT}, u AS (SELECT DISTINCT unnest(qids) AS qid FROM surf), r AS (SELECT qid, coalesce(flags, 0) AS flags FROM u LEFT JOIN flagged USING (qid))
SELECT (SELECT count(*) FROM dict) AS surface_count, (SELECT count(*) FROM r) AS qid_count, (SELECT CAST(sum(flags & 1) AS BIGINT) FROM r) AS disambiguation_count, (SELECT count(DISTINCT shard_id) FROM dict) AS shard_count""",
    "dictionary_doctor": """
WITH l AS (SELECT surface_id, surface_key, qid_count, [q for q in string_split(coalesce(qids, ''), '|') if q <> ''] AS qs FROM surface_qids),
v AS (SELECT surface_id, 'empty_key' AS problem FROM l WHERE coalesce(surface_key, '') = ''
 UNION SELECT surface_id, 'bad_qid' FROM (SELECT surface_id, unnest(qs) AS q FROM l) WHERE NOT regexp_full_match(q, 'Q[0-9]+') OR try_cast(substring(q, 2) AS BIGINT) > 4294967295
 UNION SELECT surface_id, 'wrong_count' FROM l WHERE len(qs) IS DISTINCT FROM qid_count
 UNION SELECT surface_id, 'repeated_id' FROM l GROUP BY surface_id HAVING count(*) > 1
 UNION SELECT min(surface_id), 'repeated_key' FROM l WHERE surface_key IS NOT NULL GROUP BY surface_key HAVING count(DISTINCT surface_id) > 1)
SELECT * FROM v""",
    "match_overlapping": f"{FOUND} {_ALL}",
    "match_by_join": f"{FOUND} {_ALL}",
    "match_sessions": f"{FOUND} {_ALL}",
    "stream_sessions": f"{FOUND} {_ALL}",
    "match_candidates": _matches(),
    "match_no_disambiguation": _matches("NOT dis"),
    "match_cap_1": _matches(most=1),
    "match_cap_0": _matches(most=1),
    "match_standard": _apart('{e: f."end", s: f.start, i: f.surface_id}'),
    "match_leftmost_longest": _apart('{s: f.start, n: -f."end", e: f."end", i: f.surface_id}'),
    "match_leftmost_first": _apart('{s: f.start, i: f.surface_id, e: f."end"}'),
    "match_counts": FOUND + " SELECT d.doc_id, count(f.start) AS matches FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id",
    "match_events": FOUND
    + f""", lists AS (SELECT surface_id, any_value(shard_id) AS shard_id, {_JSON_LIST} AS qids FROM cand GROUP BY surface_id),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", surface_id) - 1 AS seq,
  '{{"type":"match","match":{{"start":' || start || ',"end":' || "end" || ',"surface_id":' || surface_id || ',"shard_id":' || shard_id || ',"qids":' || qids || '}}}}' AS line FROM found JOIN lists USING (surface_id)),
done AS (SELECT d.doc_id, count(l.seq) AS seq FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN lines l USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CAST(seq AS INT) AS seq, line FROM lines UNION ALL SELECT doc_id, CAST(seq AS INT), '{{"type":"done","stats":{{"matches":' || seq || '}}}}' FROM done""",
    "match_first": FOUND + ' SELECT doc_id, start, "end", surface_id FROM found QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", surface_id) <= 2',
    "match_longest_per_end": FOUND + ' SELECT doc_id, start, "end", surface_id FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, "end" ORDER BY start, surface_id) = 1',
}

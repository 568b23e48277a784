"""The same queries in SQL for DuckDB, over views of the test tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def _uuid5(name: str) -> str:
    """SQL of a UUIDv5 in the URL namespace, as text."""
    digest = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    variant = f"substr('89ab', (('0x' || substr({digest}, 17, 1))::INT % 4) + 1, 1)"
    return (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || "
        f"{variant} || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"
    )


ORACLE["point_ids"] = f"""
SELECT DISTINCT doc_id, chunk_index,
       CASE WHEN doc_id IS NOT NULL AND chunk_index IS NOT NULL THEN {_uuid5("doc_id || ':' || chunk_index::VARCHAR")} END AS point_id
FROM chunks"""

ORACLE["page_ids"] = f"""
SELECT DISTINCT doc_id, page_number,
       CASE WHEN doc_id IS NOT NULL AND page_number IS NOT NULL THEN {_uuid5("doc_id || ':page:' || page_number::VARCHAR")} END AS point_id
FROM page_texts"""

_TYPES = """CASE lower(regexp_extract(n, '\\.([^.]*)$', 1))
    WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'html' THEN 'text/html'
    WHEN 'htm' THEN 'text/html' WHEN 'json' THEN 'application/json' WHEN 'csv' THEN 'text/csv'
    WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
    WHEN 'pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation'
    ELSE 'application/octet-stream' END"""

ORACLE["source_names"] = f"""
WITH j AS (SELECT DISTINCT job_id, lower(trim(request.source_type)) AS source_type, request.source_value AS v FROM ingest_jobs),
named AS (
  SELECT job_id, source_type, regexp_extract(regexp_replace(regexp_replace(v, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '([^/]*)$', 1) AS tail
  FROM j WHERE source_type <> 'inline'),
n AS (SELECT job_id, source_type, CASE WHEN tail = '' THEN 'download' ELSE tail END AS n FROM named)
SELECT job_id, source_type, n AS name, {_TYPES} AS content_type,
       contains(lower({_TYPES}), 'pdf') OR lower(n) LIKE '%.pdf' AS pdf
FROM n"""

ORACLE["inline_sizes"] = """
WITH j AS (SELECT DISTINCT job_id, request.source_value AS v FROM ingest_jobs WHERE lower(trim(request.source_type)) = 'inline'),
t AS (SELECT job_id, decode(from_base64(v)) AS t FROM j)
SELECT job_id, length(t) AS chars, md5(t) AS digest FROM t"""


def _norm(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '\\n{{3,}}', '\n\n', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


ORACLE["normalize_text"] = f"""
SELECT doc_id, page_number, md5(t) AS digest, length(t) AS chars FROM (SELECT doc_id, page_number, {_norm("text")} AS t FROM page_texts)"""

ORACLE["text_quality"] = f"""
SELECT doc_id, page_number, n AS char_count, CASE WHEN n < 50 THEN 0 WHEN n < 500 THEN 1 ELSE 2 END AS text_quality
FROM (SELECT doc_id, page_number, coalesce(length({_trim("text")}), 0) AS n FROM page_texts)"""

ORACLE["quality_disagreement"] = """
WITH q AS (SELECT text_quality, CASE WHEN char_count < 50 THEN 0 WHEN char_count < 500 THEN 1 WHEN char_count IS NOT NULL THEN 2 END AS expected FROM page_quality)
SELECT text_quality, expected, count(*) AS n FROM q WHERE text_quality IS DISTINCT FROM expected GROUP BY ALL"""

ORACLE["content_types"] = f"""
WITH c AS (SELECT coalesce(content_type, {_TYPES.replace("regexp_extract(n,", "regexp_extract(coalesce(filename, ''),")}) AS type, filename FROM chunks)
SELECT type, count(*) AS n, count(*) FILTER (WHERE contains(lower(type), 'pdf') OR coalesce(lower(filename) LIKE '%.pdf', false)) AS pdfs FROM c GROUP BY type"""

ORACLE["payload_ints"] = """
SELECT DISTINCT id, coalesce(try_cast(v AS INT), try_cast(trunc(try_cast(v AS DOUBLE)) AS INT), -1) AS chunk_index
FROM (SELECT id, payload['chunk_index'] AS v FROM points)"""

ORACLE["page_ranges"] = """
SELECT DISTINCT id, f AS page_first, greatest(coalesce(page_end, f), f) AS page_last
FROM (SELECT id, page_end, greatest(coalesce(page_start, 1), 1) AS f FROM chunks)"""

ORACLE["payload_build"] = """
WITH m AS (
  SELECT id, embed_model, filename, coalesce(content_type, metadata['content_type']) AS ct, metadata,
         (doc_id IS NOT NULL)::INT + (chunk_index IS NOT NULL)::INT + (page_start IS NOT NULL)::INT + (filename IS NOT NULL)::INT + (content_type IS NOT NULL)::INT AS fixed,
         list_filter(map_keys(coalesce(metadata, MAP {})), lambda k: metadata[k] IS NOT NULL AND k <> 'embed_model' AND NOT (
           (k = 'doc_id' AND doc_id IS NOT NULL) OR (k = 'chunk_index' AND chunk_index IS NOT NULL) OR (k = 'page_start' AND page_start IS NOT NULL)
           OR (k = 'filename' AND filename IS NOT NULL) OR (k = 'content_type' AND content_type IS NOT NULL))) AS free
  FROM chunks)
SELECT DISTINCT id, fixed + len(free) + 1 AS entries, ct AS content_type, metadata['dept'] AS dept, embed_model FROM m"""

ORACLE["score_labels"] = """
WITH s AS (SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value) / 50.0) AS share FROM events)
SELECT event_id, round(share, 6) AS share, CASE WHEN share > 0.7 THEN 'high' WHEN share > 0.4 THEN 'medium' WHEN share IS NOT NULL THEN 'low' END AS label,
       round(least(1.0, (event_id % 5) / 2.0), 6)::DOUBLE AS trust FROM s"""

ORACLE["blank_pages"] = f"""
SELECT kb_name, count(*) AS pages, count(DISTINCT doc_id) AS docs FROM page_texts WHERE text IS NOT NULL AND {_norm("text")} <> '' GROUP BY kb_name"""

_LATEST = """latest AS (
  SELECT doc_id, page_number, text FROM page_texts WHERE doc_id IS NOT NULL AND page_number IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY coalesce(extracted_at, TIMESTAMP '0001-01-01') DESC, text DESC NULLS LAST) = 1)"""

ORACLE["page_latest"] = f"WITH {_LATEST} SELECT doc_id, page_number, md5(text) AS digest FROM latest"

_OFFSETS = f"""{_LATEST},
clean AS (SELECT * FROM (SELECT doc_id, page_number, {_norm("text")} AS t FROM latest) WHERE t <> ''),
offsets AS (
  SELECT doc_id, page_number, t, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_from FROM clean)"""

ORACLE["page_offsets"] = f"WITH {_OFFSETS} SELECT doc_id, page_number, page_from, page_from + length(t) AS page_to FROM offsets"

ORACLE["text_limit"] = f"""
WITH d AS (SELECT doc_id, sum(coalesce(length(text), 0))::BIGINT AS chars, bool_or(text IS NOT NULL AND {_norm("text")} <> '') AS has_text FROM page_texts GROUP BY doc_id),
p AS (SELECT doc_id, chars, CASE WHEN chars > 20000 THEN 'too long' WHEN NOT has_text THEN 'no text' END AS problem FROM d)
SELECT * FROM p WHERE problem IS NOT NULL"""

ORACLE["page_quality_lookup"] = """
WITH q AS (SELECT doc_id, page_number, max(text_quality) AS text_quality FROM page_quality GROUP BY ALL)
SELECT e.doc_id, e.page_number, e.id, coalesce(q.text_quality, 0) AS text_quality
FROM page_embeddings e LEFT JOIN q ON e.doc_id = q.doc_id AND e.page_number = q.page_number"""


def _chunks(source: str) -> str:
    """Recursive cuts of source(doc_id, t). A window is looked at backwards to find the last break in its
    second half."""
    def last(mark: str, length: int) -> str:
        # position behind the last mark that lies fully in the second half; 0 if there is none
        half = "substr(w, 751)"
        return f"(CASE WHEN contains({half}, {mark}) THEN 1500 - instr(reverse({half}), reverse({mark})) + 1 ELSE 0 END)"

    marks = [("chr(10) || chr(10)", 2), ("'. '", 2), ("chr(10)", 1), ("' '", 1)]
    cut = "CASE " + " ".join(f"WHEN {last(m, n)} > 0 THEN {last(m, n)}" for m, n in marks) + " ELSE 1500 END"
    return f"""
d AS (SELECT doc_id, t, length(t) AS n FROM {source} WHERE t <> ''),
step AS (
  SELECT doc_id, 0 AS chunk_index, 0::BIGINT AS char_start,
         CASE WHEN n <= 1500 THEN n ELSE (SELECT {cut} FROM (SELECT substr(t, 1, 1500) AS w)) END::BIGINT AS char_end
  FROM d
  UNION ALL
  SELECT doc_id, chunk_index + 1, s, CASE WHEN n - s <= 1500 THEN n ELSE s + (SELECT {cut} FROM (SELECT substr(t, s + 1, 1500) AS w)) END::BIGINT
  FROM (SELECT step.*, d.t, d.n, CASE WHEN char_end - 200 > char_start THEN char_end - 200 ELSE char_end END AS s
        FROM step JOIN d USING (doc_id) WHERE char_end < n))"""


ORACLE["chunk_documents"] = f"""
WITH RECURSIVE src AS (SELECT doc_id, {_norm("text")} AS t FROM documents WHERE text IS NOT NULL), {_chunks("src")}
SELECT step.doc_id, chunk_index, char_start::INT AS char_start, char_end::INT AS char_end, md5(substr(t, char_start + 1, char_end - char_start)) AS digest
FROM step JOIN d USING (doc_id)"""

ORACLE["chunk_pages"] = f"""
WITH RECURSIVE {_OFFSETS},
src AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page_number) AS t FROM clean GROUP BY doc_id), {_chunks("src")}
SELECT s.doc_id, s.chunk_index, s.char_start::INT AS char_start, s.char_end::INT AS char_end,
       min(o.page_number) AS page_start, max(o.page_number) AS page_end, any_value(md5(substr(d.t, s.char_start + 1, s.char_end - s.char_start))) AS digest
FROM step s JOIN d USING (doc_id)
JOIN offsets o ON o.doc_id = s.doc_id AND o.page_from + length(o.t) > s.char_start AND o.page_from < s.char_end
GROUP BY s.doc_id, s.chunk_index, s.char_start, s.char_end"""

# --- vectors ---------------------------------------------------------------------------------------------------

_VEC = "list_transform(embedding, lambda x: x::DOUBLE)"
_KB = f"""
e AS (SELECT vec_id, label, {_VEC} AS v FROM embeddings),
c AS (SELECT vec_id AS id, (vec_id // 5)::VARCHAR AS doc_id, (vec_id % 5)::INT AS chunk_index, ((vec_id % 5) // 2 + 1)::INT AS page_start,
             ((vec_id % 5 + 1) // 2 + 1)::INT AS page_end, label, v, 'passage ' || vec_id AS text, 'vectors' AS source, 'doc-' || (vec_id // 5) || '.pdf' AS filename FROM e),
tok AS (SELECT vec_id // 5 AS id, list(v ORDER BY vec_id) AS o FROM e GROUP BY 1),
p AS (SELECT id, (id // 3)::VARCHAR AS doc_id, (id % 3 + 1)::INT AS page_number, (id % 3)::INT AS text_quality, 'doc-' || (id // 3) || '.pdf' AS filename,
             'vectors/' || (id // 3) || '/00000' || (id % 3 + 1) || '.png' AS page_image_key, o,
             [list_transform(list_zip(o[1], o[2]), lambda z: (z[1] + z[2]) / 2), list_transform(list_zip(o[3], o[4]), lambda z: (z[1] + z[2]) / 2), o[5]] AS pr,
             [list_transform(list_zip(o[1], o[3]), lambda z: (z[1] + z[2]) / 2), list_transform(list_zip(o[2], o[4]), lambda z: (z[1] + z[2]) / 2), o[5]] AS pc
      FROM tok),
tq AS (SELECT v AS q FROM e WHERE vec_id = 7),
pq AS (SELECT list(v ORDER BY vec_id) AS qs FROM e WHERE vec_id IN (3, 11, 42)),
cs AS (SELECT c.*, list_cosine_similarity(v, q) AS score FROM c, tq)"""


def _maxsim(field: str) -> str:
    return f"list_sum(list_transform(qs, lambda a: list_max(list_transform({field}, lambda b: list_dot_product(a, b)))))"


def _hits(text_k: int, page_k: int) -> str:
    return f"""{_KB},
th AS (SELECT id, text, source, filename, label::VARCHAR AS label, doc_id, chunk_index, page_start, page_end, score AS text_score, row_number() OVER (ORDER BY score DESC, doc_id, chunk_index) AS text_rank
       FROM (SELECT * FROM cs ORDER BY score DESC, id LIMIT {text_k})),
cand AS ((SELECT id FROM p, pq ORDER BY {_maxsim("pr")} DESC, id LIMIT {page_k * 10}) UNION (SELECT id FROM p, pq ORDER BY {_maxsim("pc")} DESC, id LIMIT {page_k * 10})),
ph AS (SELECT id, text_quality, filename, page_image_key, doc_id, page_number, page_score, row_number() OVER (ORDER BY page_score DESC, id) AS page_rank
       FROM (SELECT p.id, text_quality, filename, page_image_key, doc_id, page_number, {_maxsim("o")} AS page_score FROM p JOIN cand USING (id), pq ORDER BY page_score DESC, p.id LIMIT {page_k}))"""


ORACLE["cosine_topk"] = f"WITH {_KB} SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM (SELECT * FROM cs ORDER BY score DESC, id LIMIT 10)"
ORACLE["cosine_topk_filtered"] = f"WITH {_KB} SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM (SELECT * FROM cs WHERE label = 3 ORDER BY score DESC, id LIMIT 10)"
ORACLE["batch_topk"] = f"""
WITH e AS (SELECT vec_id, {_VEC} AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS near_id, list_cosine_similarity(q.v, e.v) AS score FROM e q, e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, near_id)::INT AS rank FROM s)
SELECT query_id, near_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""
ORACLE["point_topk"] = """
WITH d AS (SELECT id, any_value(list_transform(vector, lambda x: x::DOUBLE)) AS v FROM points
           WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY id),
q AS (SELECT v AS q FROM d ORDER BY id LIMIT 1)
SELECT id, round(s, 6) AS score FROM (SELECT id, list_cosine_similarity(v, q) AS s FROM d, q ORDER BY s DESC, id LIMIT 10)"""

for _name, _rows in (("pool_rows", True), ("pool_cols", False)):
    _at = "k * g + j" if _rows else "j * g + k"
    _stored = "pooled_rows" if _rows else "pooled_cols"
    ORACLE[_name] = f"""
WITH t AS (SELECT id, list_transform(original, lambda r: list_transform(r, lambda x: x::DOUBLE)) AS o, len({_stored}) AS stored_lines,
                  CASE WHEN len(original) < 16 THEN floor(sqrt(len(original) - 2))::INT ELSE 4 END AS g
           FROM page_embeddings WHERE original IS NOT NULL),
lines AS (SELECT id, stored_lines, g, o, unnest(range(g + least(2, len(o) - g * g)))::INT AS line FROM t),
m AS (SELECT id, line, stored_lines, len(o[1]) AS dim,
             CASE WHEN line < g THEN list_sum(list_transform(list_transform(range(g), lambda j: {_at.replace("k", "line")}), lambda a: list_sum(o[(a + 1)::INT]))) / g
                  ELSE list_sum(o[(g * g + line - g + 1)::INT]) END AS total FROM lines)
SELECT id, line, round(total, 6) AS total, dim::INT AS dim, stored_lines::INT AS stored_lines FROM m"""

ORACLE["vector_shapes"] = """
WITH s AS (SELECT CASE WHEN len(original) > 0 THEN len(original[1]) WHEN len(pooled_rows) > 0 THEN len(pooled_rows[1]) END AS dim, len(original) AS tokens,
                  len(list_filter(original, lambda r: len(r) <> len(original[1]))) = 0 AS regular FROM page_embeddings)
SELECT dim, tokens, regular, count(*) AS n FROM s GROUP BY ALL"""

ORACLE["maxsim_topk"] = f"WITH {_KB} SELECT id, round(s, 6) AS score FROM (SELECT id, {_maxsim('o')} AS s FROM p, pq ORDER BY s DESC, id LIMIT 10)"
ORACLE["two_stage_search"] = f"WITH {_hits(1, 3)} SELECT id, doc_id, page_number, round(page_score, 6) AS score FROM ph"
ORACLE["page_search"] = f"""
WITH w AS (SELECT id, list_transform(original, lambda r: list_transform(r, lambda x: x::DOUBLE)) AS o, list_transform(pooled_rows, lambda r: list_transform(r, lambda x: x::DOUBLE)) AS pr,
                  list_transform(pooled_cols, lambda r: list_transform(r, lambda x: x::DOUBLE)) AS pc FROM page_embeddings WHERE original IS NOT NULL),
pq AS (SELECT pr AS qs FROM w ORDER BY id LIMIT 1),
cand AS ((SELECT id FROM w, pq ORDER BY {_maxsim("pr")} DESC, id LIMIT 50) UNION (SELECT id FROM w, pq ORDER BY {_maxsim("pc")} DESC, id LIMIT 50))
SELECT id, round(s, 6) AS score FROM (SELECT w.id, {_maxsim("o")} AS s FROM w JOIN cand USING (id), pq ORDER BY s DESC, w.id LIMIT 5)"""

# --- fusion ----------------------------------------------------------------------------------------------------

_MATCH = """
m AS (SELECT text, source, th.filename, label, th.doc_id, chunk_index, page_start, page_end, text_score, text_rank, min(page_rank) AS page_rank, arg_min(page_score, page_rank) AS first_score, max(page_score) AS best_score
      FROM th LEFT JOIN ph ON th.doc_id = ph.doc_id AND page_number BETWEEN page_start AND page_end GROUP BY ALL),
orph AS (SELECT * FROM ph WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM th))"""

ORACLE["page_match"] = f"WITH {_hits(20, 10)}, {_MATCH} SELECT doc_id, chunk_index, text_rank::INT AS text_rank, page_rank::INT AS page_rank, round(first_score, 6) AS page_score FROM m"
ORACLE["orphan_pages"] = f"WITH {_hits(20, 10)}, {_MATCH} SELECT doc_id, page_number, page_rank::INT AS page_rank, round(page_score, 6) AS page_score FROM orph"
ORACLE["doc_agreement"] = f"WITH {_hits(20, 10)} SELECT doc_id, chunk_index, doc_id IN (SELECT doc_id FROM ph) AS agrees FROM th"


def _fused(matched: str, orphan: str, match_score: str) -> str:
    return f"""{_MATCH},
f AS (SELECT text, source, filename, label, NULL::INT AS text_quality, NULL::VARCHAR AS page_image_key, doc_id, chunk_index, page_start, page_end, text_score, {match_score} AS page_score, {matched} AS score, false AS orphan, text_rank AS pos FROM m
      UNION ALL SELECT NULL, NULL, filename, NULL, text_quality, page_image_key, doc_id, -1, page_number, page_number, NULL, page_score, {orphan}, true, page_rank FROM orph)"""


_RRF = _fused("1.0::DOUBLE / (60 + text_rank) + coalesce(1.0::DOUBLE / (60 + page_rank), 0)", "1.0::DOUBLE / (60 + page_rank)", "first_score")
_WEIGHTED = _fused(
    "0.5 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, text_score)) + 0.5 * coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, best_score) / 2.0), 0)",
    "0.5 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, page_score) / 2.0)",
    "best_score",
)
_FUSED_COLUMNS = "doc_id, chunk_index, page_start, page_end, round(text_score, 6) AS text_score, round(page_score, 6) AS page_score, round(score, 6) AS score"
ORACLE["rrf_fusion"] = f"WITH {_hits(20, 10)}, {_RRF} SELECT {_FUSED_COLUMNS} FROM (SELECT * FROM f ORDER BY score DESC, orphan, pos LIMIT 15)"
ORACLE["weighted_fusion"] = f"WITH {_hits(20, 10)}, {_WEIGHTED} SELECT {_FUSED_COLUMNS} FROM (SELECT * FROM f ORDER BY score DESC, orphan, pos LIMIT 15)"


def _labelled(source: str, agrees: str) -> str:
    return f"""
l AS (SELECT *, 0.4 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(text_score, score))) * coalesce(text_quality / 2.0, 1.0) + 0.4 * coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, page_score) / 50.0), 0)
             + 0.2 * (CASE WHEN {agrees} THEN 1.0 ELSE 0.5 END) AS raw FROM {source})"""


_LABEL_COLUMNS = f"{_FUSED_COLUMNS}, round(raw, 6) AS raw_confidence, CASE WHEN raw > 0.7 THEN 'high' WHEN raw > 0.4 THEN 'medium' ELSE 'low' END AS confidence, text, source, filename, page_image_key, label, text_quality::VARCHAR AS page_quality"
ORACLE["search_text_only"] = f"""
WITH {_hits(5, 1)}, s AS (SELECT *, text_score AS score, NULL::DOUBLE AS page_score, NULL::INT AS text_quality, NULL::VARCHAR AS page_image_key FROM th), {_labelled("s", "false")} SELECT {_LABEL_COLUMNS} FROM l"""
ORACLE["search_colpali_only"] = f"""
WITH {_hits(1, 5)}, s AS (SELECT NULL::VARCHAR AS text, NULL::VARCHAR AS source, NULL::VARCHAR AS label, filename, page_image_key, text_quality, doc_id, -1 AS chunk_index, page_number AS page_start, page_number AS page_end, NULL::DOUBLE AS text_score, page_score, page_score AS score FROM ph),
{_labelled("s", "false")} SELECT {_LABEL_COLUMNS} FROM l"""
_SEARCH = f"""{_hits(20, 10)}, {_RRF}, top AS (SELECT * FROM f ORDER BY score DESC, orphan, pos LIMIT 5),
{_labelled("top", "doc_id IN (SELECT doc_id FROM th) AND doc_id IN (SELECT doc_id FROM ph)")}"""
ORACLE["search_fusion"] = f"WITH {_SEARCH} SELECT {_LABEL_COLUMNS} FROM l"
ORACLE["response_confidence"] = f"WITH {_SEARCH} SELECT CASE WHEN max(raw) > 0.7 THEN 'high' WHEN max(raw) > 0.4 THEN 'medium' WHEN max(raw) IS NOT NULL THEN 'low' END AS confidence FROM l"

# --- catalog, modes, jobs --------------------------------------------------------------------------------------

ORACLE["mode_matrix"] = """
SELECT requested, visual,
       CASE WHEN requested = 'auto' THEN (CASE WHEN visual THEN 'fusion' ELSE 'text_only' END) WHEN requested = 'text_only' THEN 'text_only'
            WHEN requested = 'fusion' THEN (CASE WHEN visual THEN 'fusion' ELSE 'text_only_fallback' END) ELSE (CASE WHEN visual THEN 'colpali_only' ELSE 'error' END) END AS resolved,
       (requested = 'fusion' AND NOT visual)::INT AS warnings
FROM (VALUES ('auto'), ('text_only'), ('colpali_only'), ('fusion')) m(requested), (VALUES (true), (false)) v(visual)"""

ORACLE["mode_consistency"] = """
WITH b AS (SELECT DISTINCT trim(kb_name) AS kb FROM chunks WHERE kb_name IS NOT NULL),
j AS (SELECT kb, kb IN (SELECT trim(kb_name) FROM page_embeddings WHERE kb_name IS NOT NULL) AS has_pages, w AS wants_visual FROM b, (VALUES (true), (false)) x(w))
SELECT *, CASE WHEN has_pages AND NOT wants_visual THEN 'base has a visual index' WHEN NOT has_pages AND wants_visual THEN 'base is text-only' ELSE 'ok' END AS verdict FROM j"""

ORACLE["queue_routing"] = "SELECT doc_id, n AS pages, n >= 20 AS queued FROM (SELECT doc_id, count(DISTINCT page_number) AS n FROM page_texts GROUP BY doc_id)"

_JOBS = """s AS (SELECT job_id, upper(trim(status)) AS status, coalesce(retry_count, 0) AS retry_count, coalesce(updated_at, TIMESTAMP '0001-01-01') AS moment FROM ingest_jobs WHERE job_id IS NOT NULL),
o AS (SELECT *, CASE status WHEN 'QUEUED' THEN 0 WHEN 'IN_PROGRESS' THEN 1 WHEN 'COMPLETED' THEN 2 WHEN 'FAILED' THEN 2 ELSE -1 END AS step,
             count(*) OVER (PARTITION BY job_id) AS changes FROM s),
latest AS (SELECT job_id, status, retry_count, changes FROM o QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY moment DESC, step DESC, retry_count DESC, status DESC) = 1)"""
ORACLE["job_latest_status"] = f"WITH {_JOBS} SELECT job_id, status, retry_count, changes FROM latest"
ORACLE["job_recovery"] = f"""
WITH {_JOBS}, r AS (SELECT job_id, CASE WHEN status = 'IN_PROGRESS' AND retry_count >= 3 THEN 'FAILED' WHEN status = 'IN_PROGRESS' THEN 'QUEUED' ELSE status END AS status,
                           CASE WHEN status = 'IN_PROGRESS' AND retry_count < 3 THEN retry_count + 1 ELSE retry_count END AS retry_count FROM latest)
SELECT *, status = 'QUEUED' AS requeued FROM r"""
ORACLE["queue_counts"] = f"""
WITH {_JOBS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'QUEUED') AS pending, count(*) FILTER (WHERE status IN ('COMPLETED', 'FAILED')) AS ended FROM latest"""

ORACLE["upsert_idempotent"] = """
SELECT vec_id AS id, (vec_id // 5)::VARCHAR AS doc_id, (vec_id % 5 + CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END)::INT AS chunk_index FROM embeddings"""
ORACLE["list_kbs"] = """
WITH c AS (SELECT trim(kb_name) AS name, count(DISTINCT id) AS n FROM chunks WHERE kb_name IS NOT NULL GROUP BY 1),
p AS (SELECT trim(kb_name) AS name, count(DISTINCT id) AS n FROM page_embeddings GROUP BY 1)
SELECT c.name, c.n AS vectors, 64 AS dim, p.name IS NOT NULL AS visual_index, coalesce(p.n, 0) AS visual_pages FROM c LEFT JOIN p USING (name)"""

ORACLE["embed_text"] = "SELECT DISTINCT id, 32 AS dim, 1.0::DOUBLE AS self FROM chunks WHERE text IS NOT NULL"

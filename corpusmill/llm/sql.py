"""SQL for those pN_ queries that DuckDB can express over whole tables."""

_RUNS = """
runs AS (
  SELECT doc_id, token_ids FROM (
    SELECT doc_id, token_ids, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(tokenized_at, TIMESTAMP '1900-01-01') DESC, run_id DESC) AS k
    FROM token_runs WHERE len(token_ids) > 0) WHERE k = 1)"""

ORACLE: dict[str, str] = {
    # A whole run stands somewhere in the block, whatever is before it; written as text, it is found as a substring.
    "p2_found": f"""
WITH {_RUNS},
capacity AS (SELECT max(len(input_ids)) AS c FROM packed_blocks),
blocks AS (
  SELECT DISTINCT block_id, unnest(from_json(doc_ids_json, '["VARCHAR"]')) AS doc,
         ' ' || array_to_string(input_ids[1:original_length], ' ') || ' ' AS line
  FROM packed_blocks)
SELECT DISTINCT r.doc_id FROM blocks b JOIN runs r ON r.doc_id = CAST(b.doc AS BIGINT), capacity
WHERE len(r.token_ids) <= c AND NOT contains(line, ' ' || array_to_string(r.token_ids, ' ') || ' ')
""",
    "p6_run_cube": """
WITH r AS (
  SELECT doc_id, arg_max(coalesce(len(token_ids), 0), (coalesce(len(token_ids), 0) > 0, coalesce(tokenized_at, TIMESTAMP '1900-01-01'), run_id)) AS n,
         max(source_role) AS run_role, max(source_group) AS run_group
  FROM token_runs GROUP BY doc_id),
t AS (
  SELECT coalesce(source, 'unknown') AS source,
         coalesce(nullif(lower(regexp_extract(trim(lang), '^([A-Za-z]+)', 1)), ''), 'und') AS lang,
         coalesce(nullif(lower(trim(coalesce(source_role, run_role))), ''), 'unspecified') || '/' ||
         coalesce(nullif(lower(trim(coalesce(source_group, run_group))), ''), 'unspecified') AS domain, n
  FROM documents FULL JOIN r USING (doc_id))
SELECT CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang,
       CASE WHEN grouping(domain) = 1 THEN '*' ELSE domain END AS domain,
       count(*)::BIGINT AS docs, count(n)::BIGINT AS docs_with_run, coalesce(sum(n), 0)::BIGINT AS run_tokens
FROM t GROUP BY CUBE (source, lang, domain)
""",
}

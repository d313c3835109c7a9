"""The SQL that states the result of each query of the catalogue, for DuckDB on the same tables."""

from __future__ import annotations

# The text model as RE2 patterns.
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NWS = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_W = r"[\p{L}\p{N}_]+"


def low(x: str) -> str:
    """Lower case as Unicode has it for the dotted capital I, which DuckDB maps to a plain i."""
    return f"lower(replace({x}, 'İ', 'i̇'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def lines(x: str) -> str:
    s = f"string_split_regex({x}, '{_NL}')"
    return f"(CASE WHEN {s}[-1] = '' THEN {s}[:-2] ELSE {s} END)"


def key(x: str) -> str:
    return low(strip(f"regexp_replace({x}, '{_WS}+', ' ', 'g')"))


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def blank(x: str) -> str:
    return f"NOT coalesce(regexp_matches({x}, '{_NWS}'), false)"


def tokens(x: str) -> str:
    return f"regexp_extract_all({low(x)}, '{_W}')"


def windows(w: str, k: str) -> str:
    return f"list_transform(generate_series(1, greatest(len({w}) - {k} + 1, 1)), lambda i: array_to_string({w}[i:i + {k} - 1], ' '))"


_RATIO = f"CASE WHEN len(keys) <= 1 THEN 0.0 ELSE (len(keys) - len(list_distinct(keys))) / len(keys) END"
_EST = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, round_even(length(text) / 4.0, 0)::BIGINT) END"
_ALPHA = lambda x: f"coalesce({count(x, r'\p{L}')} / nullif({count(x, _NWS)}, 0), 0.0)"
_LATIN = lambda x: f"coalesce({count(x, r'\p{Latin}')} / nullif({count(x, r'\p{L}')}, 0), 0.0)"

# Cleaning with NFC, step by step.
CLEAN = f"""
f AS (SELECT doc_id, nfc_normalize(text) AS t FROM documents WHERE NOT ({blank('text')})),
k AS (SELECT doc_id, t, {lines('t')} AS ls, len({lines('t')}) AS line_count FROM f),
r AS (SELECT doc_id, t, line_count, list_filter(list_transform(ls, lambda x: {key('x')}), lambda x: x <> '') AS keys FROM k),
c AS (SELECT doc_id, line_count, {_RATIO} AS dup_ratio, len(regexp_extract_all(t, '\\p{{C}}')) - len(regexp_extract_all(t, '[\\n\\r\\t]')) AS controls_removed,
             regexp_replace(t, '([\\n\\r\\t])|\\p{{C}}', '\\1', 'g') AS t FROM r),
l AS (SELECT doc_id, line_count, dup_ratio, controls_removed, {lines('t')} AS ls FROM c),
m AS (SELECT *, list_transform(ls, lambda x: {key('x')}) AS ks FROM l),
n AS (SELECT doc_id, line_count, dup_ratio, controls_removed,
             array_to_string(list_filter(ls, lambda x, i: ks[i] = '' OR list_position(ks, ks[i]) = i), chr(10)) AS t FROM m),
p AS (SELECT * REPLACE (list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip(r"regexp_replace(x, '[ \t\f\x0b]+', ' ', 'g')")}), lambda x: x <> '') AS t) FROM n),
cleaned AS MATERIALIZED (SELECT doc_id, line_count, dup_ratio, controls_removed, {strip("array_to_string(t, chr(10))")} AS clean_text FROM p),
judged AS MATERIALIZED (SELECT *, list_filter([
    CASE WHEN length(clean_text) < 200 THEN 'too_short' END,
    CASE WHEN {_ALPHA('clean_text')} < 0.25 THEN 'low_alphabetic_ratio' END,
    CASE WHEN dup_ratio > 0.6 THEN 'high_duplicate_line_ratio' END,
    CASE WHEN regexp_matches({low('clean_text')}, 'enable javascript|cookie policy|all rights reserved') THEN 'boilerplate_phrase' END,
    CASE WHEN {_LATIN('clean_text')} < 0.8 THEN 'language_filter' END], lambda x: x IS NOT NULL) AS reasons FROM cleaned)"""

_DOCS = f"""
d AS (SELECT doc_id, sha256(source || chr(10) || source_uri)[1:24] AS stable_id, sha256(text) AS content_hash, octet_length(encode(text)) AS byte_length,
             length(text) AS char_count, {_EST} AS estimated_tokens, source, source_role, source_group, source_type, license
      FROM documents WHERE NOT ({blank('text')}))"""

ORACLE: dict[str, str] = {
    "q_ingest_documents": f"WITH {_DOCS} SELECT * FROM d",
    "q_ingest_counts": f"""WITH {_DOCS}, x AS (
SELECT 'total' AS kind, '*' AS value, byte_length, estimated_tokens FROM d UNION ALL
SELECT 'source_role', coalesce(source_role, 'unspecified'), byte_length, estimated_tokens FROM d UNION ALL
SELECT 'license', coalesce(license, 'unspecified'), byte_length, estimated_tokens FROM d UNION ALL
SELECT 'source_group', coalesce(source_group, 'unspecified'), byte_length, estimated_tokens FROM d)
SELECT kind, value, count(*) AS documents, sum(byte_length)::BIGINT AS bytes, sum(estimated_tokens)::BIGINT AS tokens FROM x GROUP BY kind, value""",
    "q_source_stats": f"""WITH {_DOCS}
SELECT m.source, count(d.doc_id) AS documents, coalesce(sum(byte_length), 0)::BIGINT AS bytes FROM (SELECT DISTINCT source FROM mix_targets) m LEFT JOIN d USING (source) GROUP BY m.source""",
    "q_line_stats": f"""WITH k AS (SELECT doc_id, len({lines('text')}) AS line_count, list_filter(list_transform({lines('text')}, lambda x: {key('x')}), lambda x: x <> '') AS keys
FROM documents WHERE NOT ({blank('text')})) SELECT doc_id, line_count, round({_RATIO}, 6) AS dup_ratio FROM k""",
    "q_char_ratios": f"SELECT doc_id, round({_ALPHA('text')}, 6) AS alphabetic_ratio, round({_LATIN('text')}, 6) AS latin_ratio FROM documents WHERE text IS NOT NULL",
    "q_normalize_text": f"WITH {CLEAN} SELECT doc_id, controls_removed, length(clean_text) AS chars, md5(clean_text) AS hash FROM cleaned",
    "q_quality_reasons": f"WITH {CLEAN} SELECT doc_id, array_to_string(reasons, ',') AS reasons FROM judged",
    "q_discard_counts": f"WITH {CLEAN} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY reason",
    "q_rejected_samples": f"WITH {CLEAN} SELECT doc_id, array_to_string(reasons, ',') AS reasons, clean_text[1:240] AS preview FROM judged WHERE len(reasons) > 0 ORDER BY doc_id LIMIT 20",
    "q_shingle_counts": f"""WITH w AS (SELECT doc_id, {tokens('text')} AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(w) AS words, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct({windows('w', '5')})) END AS shingles FROM w""",
}

# --- deduplication ---------------------------------------------------------------------------

_P = 2147483647
_SIGNED = f"""
sv AS (SELECT doc_id, text, {low(f"trim(regexp_replace(text, '{_WS}+', ' ', 'g'))")} AS norm, {tokens('text')} AS w FROM documents WHERE NOT ({blank('text')})),
ss AS (SELECT doc_id, sha256(text) AS text_hash, sha256(norm) AS norm_hash, CASE WHEN len(w) = 0 THEN [norm] ELSE list_distinct({windows('w', '5')}) END AS g FROM sv),
sh AS MATERIALIZED (SELECT doc_id, text_hash, norm_hash, list_transform(g, lambda x: ('0x' || md5(x)[1:7])::BIGINT) AS h FROM ss),
sp AS (SELECT i, (1103515245::HUGEINT * (i + 1) % {_P})::BIGINT AS a, (12345::HUGEINT * (i + 7) * 2654435 % {_P})::BIGINT AS b FROM range(64) t(i)),
se AS (SELECT doc_id, unnest(h) AS h FROM sh),
sz AS (SELECT doc_id, i, min((a * h + b) % {_P}) AS m FROM se, sp GROUP BY doc_id, i),
signed AS MATERIALIZED (SELECT doc_id, list(m ORDER BY i) AS sig FROM sz GROUP BY doc_id),
bands AS (SELECT doc_id, b, sig[b * 4 + 1:b * 4 + 4] AS k FROM signed, range(16) t(b)),
pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y ON x.b = y.b AND x.k = y.k AND x.doc_id < y.doc_id),
sims AS MATERIALIZED (SELECT a, b, len(list_filter(list_zip(x.sig, y.sig), lambda t: t[1] = t[2])) / 64 AS sim FROM pairs JOIN signed x ON x.doc_id = a JOIN signed y ON y.doc_id = b)"""
_DECIDED = f"""WITH RECURSIVE {_SIGNED},
edges AS (SELECT a, b FROM sims WHERE sim >= 0.6 UNION SELECT x.doc_id, y.doc_id FROM sh x JOIN sh y ON x.norm_hash = y.norm_hash AND x.doc_id < y.doc_id),
nodes AS (SELECT b, row_number() OVER (ORDER BY b) AS k, list(a) AS before FROM edges GROUP BY b),
walk(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT n.k, CASE WHEN len(list_filter(n.before, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, n.b) ELSE w.gone END
  FROM walk w JOIN nodes n ON n.k = w.k + 1),
removed AS (SELECT unnest(gone) AS doc_id FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)),
decided AS MATERIALIZED (SELECT sh.doc_id, CASE WHEN r.doc_id IS NULL THEN 'kept'
   WHEN EXISTS (SELECT 1 FROM sh o ANTI JOIN removed q USING (doc_id) WHERE o.text_hash = sh.text_hash AND o.doc_id < sh.doc_id) THEN 'exact_duplicate'
   WHEN EXISTS (SELECT 1 FROM sh o ANTI JOIN removed q USING (doc_id) WHERE o.norm_hash = sh.norm_hash AND o.doc_id < sh.doc_id) THEN 'normalized_duplicate'
   ELSE 'near_duplicate' END AS status FROM sh LEFT JOIN removed r USING (doc_id))"""
ORACLE |= {
    "q_minhash_signature": f"WITH {_SIGNED} SELECT doc_id, md5(array_to_string(sig, ',')) AS sig FROM signed",
    "q_lsh_candidates": f"WITH {_SIGNED} SELECT a, b, round(sim, 6) AS sim FROM sims",
    "q_near_dup_pairs": f"WITH {_SIGNED} SELECT a, b, round(sim, 6) AS sim FROM sims WHERE sim >= 0.6",
    "q_exact_dedup": f"""WITH v AS (SELECT doc_id, text, {low(f"trim(regexp_replace(text, '{_WS}+', ' ', 'g'))")} AS norm FROM documents WHERE NOT ({blank('text')})),
f AS (SELECT doc_id, text, first_value(doc_id) OVER n AS a, first_value(text) OVER n AS t FROM v WINDOW n AS (PARTITION BY norm ORDER BY doc_id))
SELECT doc_id, CASE WHEN doc_id = a THEN 'kept' WHEN text = t THEN 'exact_duplicate' ELSE 'normalized_duplicate' END AS status, CASE WHEN doc_id <> a THEN a END AS match_id FROM f""",
    "q_dedup_decisions": f"{_DECIDED} SELECT doc_id, status FROM decided",
    "q_dedup_report": f"{_DECIDED} SELECT status, count(*) AS n FROM decided GROUP BY status",
}

# --- contamination ---------------------------------------------------------------------------


def clean_of(source: str, id_: str) -> str:
    """The cleaning steps over another text; the names of the steps get the prefix x."""
    import re

    s = CLEAN[: CLEAN.index("judged AS")].rstrip().rstrip(",")
    s = s.replace(" AS MATERIALIZED (", " AS (").replace("doc_id", id_).replace("FROM documents", f"FROM {source}")
    names = ["f", "k", "r", "c", "l", "m", "n", "p", "cleaned"]
    for n in names:
        s = re.sub(rf"(?m)^{n} AS \(", f"x{n} AS (", s)
        s = re.sub(rf"FROM {n}\b", f"FROM x{n}", s)
    return s


_EX = f"""
ex AS (
  SELECT 'domain_surface:' || id AS example_id, 'domain_surface' AS task_id, 'surface' AS kind, NULL::VARCHAR AS prompt, NULL::VARCHAR AS answer, text FROM domain_surface UNION ALL
  SELECT 'domain_application:' || id, 'domain_application', 'application', nullif(question, ''), nullif(answer, ''), concat_ws(chr(10), question, answer) FROM domain_application UNION ALL
  SELECT 'domain_recall:' || id, 'domain_recall', 'recall', nullif(prompt, ''), nullif(answer, ''), concat_ws(chr(10), prompt, answer) FROM domain_recall),
{clean_of('ex', 'example_id')},
examples AS (SELECT ex.*, xcleaned.clean_text FROM ex JOIN xcleaned USING (example_id))"""


def _overlap(size: int) -> str:
    return f"""
xw AS (SELECT example_id, {tokens('clean_text')} AS w FROM examples),
xs AS (SELECT example_id, w, CASE WHEN len(w) >= {size} THEN {size} WHEN len(w) >= 3 THEN len(w) ELSE 0 END AS size FROM xw),
xg AS (SELECT example_id, size, list_distinct({windows('w', 'size')}) AS g FROM xs WHERE size > 0),
index AS (SELECT example_id, size, len(g) AS total, unnest(g) AS gram FROM xg),
dw AS (SELECT doc_id, {tokens('clean_text')} AS w FROM cleaned),
dg AS (SELECT doc_id, size, unnest(list_distinct({windows('w', 'size')})) AS gram FROM dw, (SELECT DISTINCT size FROM index) WHERE len(w) >= size),
hits AS (SELECT doc_id, example_id, size, count(*) AS hits, count(*) / any_value(total) AS score FROM dg JOIN index USING (size, gram) GROUP BY doc_id, example_id, size),
same AS (SELECT doc_id, example_id FROM cleaned c JOIN examples e ON e.clean_text = c.clean_text),
overlap AS (SELECT h.* FROM hits h ANTI JOIN same USING (doc_id, example_id) WHERE score >= 0.2),
flags AS (SELECT doc_id, example_id, 'exact' AS match_type, 1.0::DOUBLE AS score FROM same UNION ALL SELECT doc_id, example_id, 'ngram', score FROM overlap)"""


ORACLE |= {
    "q_eval_examples": f"WITH {_EX} SELECT example_id, task_id, kind, prompt, answer, sha256(text) AS raw_hash, sha256(clean_text) AS hash FROM examples",
    "q_eval_counts": f"WITH {_EX} SELECT task_id, kind, count(*) AS n, count(answer) AS with_answer FROM examples GROUP BY task_id, kind",
    "q_eval_coverage": f"WITH {_EX} SELECT kind, count(example_id) AS n, count(example_id) > 0 AS covered FROM (VALUES ('surface'), ('application'), ('recall'), ('general')) t(kind) LEFT JOIN examples USING (kind) GROUP BY kind",
    "q_contam_exact": f"""WITH {CLEAN}, {_EX}, d AS (SELECT 'doc:' || doc_id AS doc_id, clean_text FROM cleaned UNION ALL SELECT 'item:' || example_id, clean_text FROM examples)
SELECT d.doc_id, e.example_id FROM d JOIN examples e USING (clean_text)""",
    "q_contam_ordered": f"""WITH {CLEAN}, {_EX}, {_overlap(13)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY match_type, score DESC, example_id) AS place, example_id, match_type, round(score, 6) AS score
FROM flags QUALIFY place <= 5""",
    "q_contam_totals": f"""WITH {CLEAN}, {_EX}, {_overlap(13)}, fn AS (SELECT doc_id, count(*) AS k FROM flags GROUP BY doc_id),
byr AS (SELECT coalesce(source_role, 'unspecified') AS role, k FROM cleaned JOIN (SELECT doc_id, source_role FROM documents) USING (doc_id) LEFT JOIN fn USING (doc_id))
SELECT CASE WHEN grouping(role) = 1 THEN '*' ELSE role END AS source_role, count(*) AS documents, count(k) AS flagged, coalesce(sum(k), 0)::BIGINT AS matches FROM byr GROUP BY ROLLUP (role)""",
    "q_contam_ngram": f"WITH {CLEAN}, {_EX}, {_overlap(13)} SELECT doc_id, example_id, size, hits, round(score, 6) AS score FROM overlap",
    "q_contam_short": f"WITH {CLEAN}, {_EX}, {_overlap(20)} SELECT doc_id, example_id, size, hits, round(score, 6) AS score FROM overlap",
    "q_contam_status": f"""WITH {CLEAN}, {_EX}, {_overlap(13)}, fn AS (SELECT doc_id, count(*) AS n FROM flags GROUP BY doc_id)
SELECT doc_id, CASE WHEN n IS NULL THEN 'clean' ELSE 'contaminated_retained' END AS status, coalesce(n, 0) AS match_count FROM cleaned LEFT JOIN fn USING (doc_id)""",
    "q_contam_report": f"WITH {CLEAN}, {_EX}, {_overlap(13)} SELECT example_id, count(DISTINCT doc_id) AS docs, count(*) AS matches FROM flags GROUP BY example_id",
}

# --- tokens ----------------------------------------------------------------------------------

_RUNS = """
runs AS (SELECT doc_id, coalesce(lower(trim(source_role)), 'unspecified') AS source_role, coalesce(lower(trim(source_group)), 'unspecified') AS source_group,
                token_ids, len(token_ids) AS n FROM token_runs WHERE len(token_ids) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY run_id) = 1)"""
_PACKED = f"""{_RUNS},
placed AS (SELECT *, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS start FROM runs),
toks AS (SELECT doc_id, source_role, unnest(token_ids) AS t, start + generate_subscripts(token_ids, 1) - 1 AS pos FROM placed),
blocks AS (SELECT pos // 512 AS block, list(t ORDER BY pos) AS ids, count(*) AS n FROM toks GROUP BY 1),
roles AS (SELECT block, '{{' || string_agg('"' || source_role || '":' || c, ',' ORDER BY source_role) || '}}' AS j
          FROM (SELECT pos // 512 AS block, source_role, count(*) AS c FROM toks GROUP BY 1, 2) GROUP BY block),
ids AS (SELECT block, '[' || string_agg('"' || d || '"', ',' ORDER BY d) || ']' AS j FROM (SELECT DISTINCT pos // 512 AS block, doc_id::VARCHAR AS d FROM toks) GROUP BY block)"""
ORACLE |= {
    "q_byte_tokens": """SELECT doc_id, octet_length(encode(text)) + 1 AS n, (1 + coalesce(list_sum(list_transform(range(octet_length(encode(text))),
  lambda i: ('0x' || hex(encode(text))[2 * i + 1:2 * i + 2])::BIGINT + 2)), 0))::BIGINT AS total FROM documents WHERE text IS NOT NULL""",
    "q_tokens_by_role": f"""WITH {_RUNS} SELECT 'source_role' AS kind, source_role AS value, sum(n)::BIGINT AS tokens, count(*) AS runs FROM runs GROUP BY 2
UNION ALL SELECT 'source_group', source_group, sum(n)::BIGINT, count(*) FROM runs GROUP BY 2""",
    "q_replay_select": f"""WITH {_RUNS}, t AS (SELECT round_even(sum(n) * 0.2 / 0.8, 0)::BIGINT AS target FROM runs WHERE source_role = 'domain'),
r AS (SELECT doc_id, source_role, n, sum(n) OVER (ORDER BY doc_id) AS cum FROM runs WHERE source_role = 'replay_general')
SELECT doc_id, source_role, n FROM runs WHERE source_role = 'domain' UNION ALL
SELECT doc_id, source_role, n FROM r, t WHERE cum = n OR (cum <= target AND cum - n < target)""",
    "q_split_assign": f"""WITH {_RUNS}, t AS (SELECT greatest(1, least(sum(n) - 1, greatest(512, round_even(sum(n) * 0.05, 0)::BIGINT))) AS want, count(*) AS docs FROM runs),
h AS (SELECT doc_id, n, ('0x' || md5('13:' || doc_id)[1:13])::BIGINT AS h FROM runs),
c AS (SELECT doc_id, sum(n) OVER (ORDER BY h) - n AS before, row_number() OVER (ORDER BY h) AS rn FROM h)
SELECT doc_id, CASE WHEN before < want AND rn < docs THEN 'validation' ELSE 'train' END AS split FROM c, t""",
    "q_single_doc_split": f"""WITH {_RUNS}, w AS (SELECT doc_id, token_ids, n, greatest(1, least(n - 1, greatest(8, round_even(n * 0.25, 0)::BIGINT))) AS want FROM runs WHERE n > 1)
SELECT doc_id, n - want AS train, want AS validation, token_ids[n - want + 1] AS first FROM w""",
    "q_pack_blocks": f"""WITH {_PACKED}
SELECT format('train_{{:010d}}', block) AS block_id, md5(array_to_string(list_resize(ids, 512, 0), ',')) AS ids, n AS original_length, 512 - n AS padding_length, roles.j AS source_roles_json, ids.j AS doc_ids_json
FROM blocks JOIN roles USING (block) JOIN ids USING (block)""",
    "q_pack_stats": f"""WITH {_PACKED} SELECT 'train' AS split, count(*) AS blocks, sum(n)::BIGINT AS content, sum(512 - n)::BIGINT AS padding, count(*) * 512 AS capacity,
round(sum(512 - n) / (count(*) * 512), 6) AS padding_ratio FROM blocks""",
    "q_pack_scan": "SELECT md5(array_to_string(input_ids, ',')) AS ids, list_sum(attention_mask)::BIGINT AS content, len(list_filter(labels, lambda x: x = -100)) AS ignored FROM packed_blocks WHERE split = 'validation'",
}

# --- evaluation ------------------------------------------------------------------------------

_FIN = "value IS NOT NULL AND isfinite(value)"
_RES = f"res AS (SELECT *, task_id || '.' || metric_name AS metric FROM eval_results WHERE {_FIN})"
_KEY = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_TOK = lambda x: f"list_filter(string_split_regex({low(strip(x))}, '{_WS}+'), lambda t: t <> '')"
_PAIRS = r"""pairs AS (SELECT regexp_extract(a.id, '_(\d+)$', 1) AS n, coalesce(a.answer, '') AS prediction, coalesce(r.answer, '') AS answer
FROM domain_application a JOIN domain_recall r ON regexp_extract(a.id, '_(\d+)$', 1) = regexp_extract(r.id, '_(\d+)$', 1))"""
_REP = lambda w: f"CASE WHEN len({w}) < 4 THEN 0.0 ELSE 1 - len(list_distinct({windows(w, '4')})) / (len({w}) - 3) END"
_BOOT = f"""{_RES},
num AS (SELECT metric, value, count(*) OVER (PARTITION BY metric) AS n,
  row_number() OVER (PARTITION BY metric ORDER BY md5(example_id)[1:2], example_id, evaluated_at, value) - 1 AS i FROM res),
dr AS (SELECT metric, b, ('0x' || md5('9186:' || metric || ':' || b || ':' || i)[1:7])::BIGINT % n AS i FROM num, range(20) t(b)),
mn AS (SELECT metric, b, avg(value) AS m FROM dr JOIN num USING (metric, i) GROUP BY metric, b),
ag AS (SELECT metric, list(m ORDER BY m) AS m FROM mn GROUP BY metric),
pt AS (SELECT metric, count(*) AS n, avg(value) AS mean FROM num GROUP BY metric),
boot AS (SELECT metric, n, CASE WHEN n > 1 THEN m[1] ELSE mean END AS low, CASE WHEN n > 1 THEN m[19] ELSE mean END AS high FROM pt JOIN ag USING (metric)),
st AS (SELECT metric, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, min(value) AS least, max(value) AS most FROM res GROUP BY metric),
floors AS (SELECT metric, greatest(st.sd / sqrt(st.n), (high - low) / 2, CASE WHEN metric = 'domain_surface.nll' THEN 0.05 ELSE 0 END) AS floor,
  boot.n < 2 AND metric <> 'domain_surface.nll' AS degenerate FROM st FULL JOIN boot USING (metric)),
mean AS (SELECT split, metric, avg(value) AS mean FROM res GROUP BY split, metric),
deltas AS (SELECT metric, b.mean AS base, c.mean AS checkpoint, c.mean - b.mean AS delta FROM (SELECT * FROM mean WHERE split = 'validation') b
  FULL JOIN (SELECT * FROM mean WHERE split = 'eval') c USING (metric))"""
ORACLE |= {
    "q_byte_perplexity": """WITH b AS (SELECT doc_id, octet_length(encode(text)) AS n, unnest(list_transform(range(octet_length(encode(text))), lambda i: hex(encode(text))[2 * i + 1:2 * i + 2])) AS b FROM documents),
c AS (SELECT doc_id, n, b, count(*) / n AS p FROM b GROUP BY doc_id, n, b), e AS (SELECT doc_id, any_value(n) AS n, sum(-p * ln(p)) AS nll FROM c GROUP BY doc_id)
SELECT doc_id, round(coalesce(nll, 0.0), 6) AS nll, round(exp(coalesce(nll, 0.0)), 6) AS perplexity, coalesce(n, 0) AS token_count FROM documents LEFT JOIN e USING (doc_id) WHERE text IS NOT NULL""",
    "q_overall_perplexity": f"""SELECT coalesce(sum(token_count), 0)::BIGINT AS token_count, round(sum(value * token_count) / sum(token_count), 6) AS nll,
round(exp(sum(value * token_count) / sum(token_count)), 6) AS perplexity FROM eval_results WHERE metric_name = 'nll' AND {_FIN}""",
    "q_metric_means": f"SELECT suite, kind, metric_name, round(avg(value), 6) AS mean, count(*) AS n FROM eval_results WHERE {_FIN} GROUP BY ALL",
    "q_benchmark_pivot": "SELECT " + ", ".join(f"round(avg(value) FILTER (WHERE kind = '{k}' AND metric_name = '{m}'), 6) AS {k}_{m}" for k, m in (("surface", "perplexity"), ("surface", "nll"), ("recall", "exact_match"), ("recall", "token_f1"), ("application", "exact_match"), ("application", "token_f1"))) + f", round(avg(value) FILTER (WHERE suite = 'general' AND metric_name = 'perplexity'), 6) AS general_perplexity, count(DISTINCT example_id)::DOUBLE AS samples FROM eval_results WHERE {_FIN}",
    "q_exact_match": f"""SELECT id, CASE WHEN {_KEY("coalesce(answer, '')")} <> '' AND {_KEY("coalesce(answer, '')")} =
{_KEY(f"'simple_statistical_baseline: ' || array_to_string(list_filter(string_split_regex(coalesce(prompt, ''), '{_WS}+'), lambda x: x <> '')[1:16], ' ')")} THEN 1.0::DOUBLE ELSE 0.0 END AS proxy,
CASE WHEN {_KEY("coalesce(answer, '')")} <> '' THEN 1.0::DOUBLE ELSE 0.0 END AS own FROM domain_recall""",
    "q_token_f1": f"""WITH {_PAIRS}, p AS (SELECT n, t, count(*) AS p FROM (SELECT n, unnest(string_split({_KEY('prediction')}, ' ')) AS t FROM pairs) WHERE t <> '' GROUP BY n, t),
a AS (SELECT n, t, count(*) AS a FROM (SELECT n, unnest(string_split({_KEY('answer')}, ' ')) AS t FROM pairs) WHERE t <> '' GROUP BY n, t),
s AS (SELECT n, sum(least(coalesce(p, 0), coalesce(a, 0))) AS o, sum(coalesce(p, 0)) AS p, sum(coalesce(a, 0)) AS a FROM p FULL JOIN a USING (n, t) GROUP BY n)
SELECT pairs.n, round(CASE WHEN coalesce(o, 0) > 0 THEN 2 * o / (p + a) ELSE 0.0 END, 6) AS f1 FROM pairs LEFT JOIN s USING (n)""",
    "q_lexical_drift": f"""WITH {_PAIRS}, t AS (SELECT n, list_distinct({_TOK('prediction')}) AS x, list_distinct({_TOK('answer')}) AS y FROM pairs)
SELECT n, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 0.0 ELSE 1 - len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS drift FROM t""",
    "q_drift_summary": f"""WITH {_PAIRS}, t AS (SELECT {_TOK('prediction')} AS w, list_distinct({_TOK('prediction')}) AS x, list_distinct({_TOK('answer')}) AS y FROM pairs)
SELECT round(avg(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 0.0 ELSE 1 - len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END), 6) AS mean_drift, round(max({_REP('w')}), 6) AS max_repetition FROM t""",
    "q_repetition": f"WITH t AS (SELECT doc_id, {_TOK('text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, round({_REP('w')}, 6) AS repetition FROM t",
    "q_repeat_stats": f"WITH {_BOOT} SELECT metric, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se, round(least, 6) AS least, round(most, 6) AS most FROM st",
    "q_bootstrap_ci": f"WITH {_BOOT} SELECT metric, n, round(low, 6) AS low, round(high, 6) AS high, round((high - low) / 2, 6) AS half_width FROM boot",
    "q_noise_floors": f"WITH {_BOOT} SELECT metric, round(floor, 6) AS floor, degenerate FROM floors",
    "q_alert_policy": f"WITH {_BOOT}, m AS (SELECT count(*) AS c, max(n) AS n FROM st), s AS (SELECT CASE WHEN c = 0 THEN 'blocked' WHEN n < 2 THEN 'insufficient_calibration_data' ELSE 'calibrated' END AS status FROM m) SELECT status, status = 'calibrated' AS alerts_allowed FROM s",
    "q_checkpoint_deltas": f"WITH {_BOOT} SELECT metric, round(base, 6) AS base, round(checkpoint, 6) AS checkpoint, round(delta, 6) AS delta FROM deltas",
    "q_differential": f"WITH {_BOOT} SELECT metric, round(delta / 2, 6) AS differential, round(floor, 6) AS floor, abs(delta / 2) <= floor AS within_noise FROM deltas LEFT JOIN floors USING (metric)",
}

# --- metric facts ----------------------------------------------------------------------------

_SERIES = f"series AS (SELECT config_hash, stage, name, step, arg_max(value, id) AS value FROM metric_rows WHERE step IS NOT NULL AND {_FIN} GROUP BY ALL)"
_POINTS = """
wide AS (SELECT config_hash, step, max(value) FILTER (WHERE name = 'domain_surface_perplexity') AS d, max(value) FILTER (WHERE name = 'general_perplexity') AS g
  FROM series WHERE name IN ('domain_surface_perplexity', 'general_perplexity') GROUP BY ALL),
fr AS (SELECT *, first_value(d) OVER w AS d0, first_value(g) OVER w AS g0 FROM wide WINDOW w AS (PARTITION BY config_hash ORDER BY step)),
points AS (SELECT config_hash, step, d0 - d AS domain_gain, g - g0 AS general_loss, greatest(0, abs(g0) * 0.02) AS threshold, greatest(0, abs(g0) * 0.05) AS stop_threshold, g0 AS reference, step % 5 = 0 AS single FROM fr),
ov AS (SELECT *, CASE WHEN NOT single OR NOT coalesce(domain_gain > 0.02, false) THEN 0.0 WHEN step % 3 / 50.0::DOUBLE - 0.03 < -0.02 THEN 1.0
  WHEN abs(step % 3 / 50.0::DOUBLE - 0.03) <= 0.02 THEN 0.5 ELSE 0.0 END::DOUBLE AS over FROM points),
pt AS (SELECT *, greatest(0, coalesce(domain_gain, 0)) - greatest(0, coalesce(general_loss, 0)) - over * greatest(1, coalesce(domain_gain, 0)) AS score,
  CASE WHEN single THEN 'checkpoint_eval' ELSE 'train_eval_stream' END AS source FROM ov),
lv AS (SELECT pt.*, code, severity, CASE severity WHEN 'stop' THEN stop_threshold ELSE threshold END AS least FROM pt, (VALUES ('forgetting_warning', 'warning'), ('forgetting_stop', 'stop')) v(code, severity)),
mk AS (SELECT *, coalesce(general_loss > 0.02 AND general_loss >= least, false) AS c FROM lv),
il AS (SELECT *, sum((NOT c)::INT) OVER (PARTITION BY config_hash, code ORDER BY step) AS island FROM mk WHERE NOT single),
hd AS (SELECT *, row_number() OVER (PARTITION BY config_hash, code, island ORDER BY step) AS persistence FROM il WHERE c),
alerts AS (SELECT config_hash, code, 'forgetting' AS kind, severity, step, source, general_loss AS value, least AS threshold, persistence::INT AS persistence FROM hd WHERE persistence >= 2
  UNION ALL SELECT config_hash, code, 'forgetting', severity, step, source, general_loss, least, 1 FROM mk WHERE single AND c
  UNION ALL SELECT config_hash, 'domain_overfitting_warning', 'domain_overfitting', 'warning', step, source, over, 0.5, NULL FROM pt WHERE over >= 0.5)"""
_RUNTAB = f"""runtab AS (SELECT config_hash AS run, max(step) AS steps, arg_max(value, id) FILTER (WHERE name = 'domain_surface_perplexity') AS domain,
  arg_max(value, id) FILTER (WHERE name = 'general_perplexity') AS general, arg_max(value, id) FILTER (WHERE name = 'raw_token_count') AS tokens,
  arg_max(value, id) FILTER (WHERE name = 'learning_rate') AS lr FROM metric_rows WHERE {_FIN} GROUP BY 1)"""
_LAY = """nm AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings),
lay AS (SELECT 'L' || label AS label, vec_id % 7 AS step, norm * (vec_id % 11 + 1) AS movement, norm * (vec_id % 11 + 1) / 8 AS ratio, norm * (vec_id % 11 + 1) * 125 AS gradient FROM nm),
stp AS (SELECT label, step, max(movement) AS movement, max(ratio) AS ratio, max(gradient) AS gradient FROM lay GROUP BY ALL)"""
ORACLE |= {
    "q_metric_scan": """WITH j AS (SELECT id, stage, name, CASE WHEN json_valid(metadata_json) THEN metadata_json ELSE '{}' END AS m FROM metric_rows)
SELECT id, stage, name, m ->> 'device' AS device, len(json_keys(m)) AS keys FROM j""",
    "q_latest_metrics": "SELECT stage, name, round(value, 6) AS value, step, created_at, unit FROM metric_rows QUALIFY row_number() OVER (PARTITION BY stage, name ORDER BY id DESC) = 1",
    "q_step_series": f"WITH {_SERIES} SELECT config_hash, stage, name, step, round(value, 6) AS value FROM series",
    "q_stream_points": f"WITH {_SERIES}, {_POINTS} SELECT config_hash, step, round(domain_gain, 6) AS domain_gain, round(general_loss, 6) AS general_loss, round(threshold, 6) AS threshold FROM points",
    "q_alerts": f"WITH {_SERIES}, {_POINTS} SELECT config_hash, code, kind, severity, step, source, round(value, 6) AS value, round(threshold, 6) AS threshold, persistence FROM alerts",
    "q_early_stop": f"""WITH {_SERIES}, d AS (SELECT config_hash, step, value - first_value(value) OVER w > 0.05 AS up FROM series WHERE name = 'train_loss' WINDOW w AS (PARTITION BY config_hash ORDER BY step)),
i AS (SELECT *, sum((NOT up)::INT) OVER (PARTITION BY config_hash ORDER BY step) AS island FROM d), c AS (SELECT *, row_number() OVER (PARTITION BY config_hash, island ORDER BY step) AS n FROM i WHERE up)
SELECT config_hash, min(step) AS stop_step FROM c WHERE n >= 2 AND step >= 10 GROUP BY config_hash""",
    "q_recommend": f"""WITH {_SERIES}, {_POINTS}, cand AS (SELECT * FROM pt QUALIFY single OR NOT bool_or(single) OVER (PARTITION BY config_hash)),
best AS (SELECT config_hash, step, source, score FROM cand ANTI JOIN (SELECT config_hash, step FROM alerts WHERE severity = 'stop') s USING (config_hash, step)
  QUALIFY row_number() OVER (PARTITION BY config_hash ORDER BY score DESC, step) = 1)
SELECT config_hash, CASE WHEN step IS NULL THEN 'no_safe_checkpoint' ELSE 'recommended' END AS status, step, source, round(score, 6) AS score
FROM (SELECT DISTINCT config_hash FROM pt) LEFT JOIN best USING (config_hash)""",
    "q_train_stats": f"""WITH {_SERIES}, t AS (SELECT config_hash, step // 50 AS step, max(value) FILTER (WHERE name = 'train_loss') AS loss, floor(max(value) FILTER (WHERE name = 'tokens_per_second') * 2)::BIGINT AS tokens
  FROM series WHERE stage = 'train' AND name IN ('train_loss', 'tokens_per_second') GROUP BY ALL)
SELECT config_hash, count(*) AS steps, sum(tokens)::BIGINT AS tokens, round(arg_max(loss, step) FILTER (WHERE loss IS NOT NULL), 6) AS last_loss, round(avg(loss), 6) AS mean_loss,
round(sum(loss * tokens) FILTER (WHERE tokens > 0) / sum(tokens) FILTER (WHERE tokens > 0 AND loss IS NOT NULL), 6) AS token_loss, round(sum(tokens) / (2.0::DOUBLE * count(tokens)), 6) AS tokens_per_second FROM t GROUP BY config_hash""",
    "q_run_ranking": f"WITH {_RUNTAB} SELECT run, row_number() OVER (ORDER BY -domain DESC NULLS LAST, -general DESC NULLS LAST, tokens NULLS LAST, run) AS rank, round(-domain, 6) AS gain FROM runtab",
    "q_matched_budget": f"""WITH {_RUNTAB}, r AS (SELECT run, CASE WHEN ('0x' || run[1])::INT < 12 THEN 'a' ELSE 'b' END AS m, CASE WHEN ('0x' || run[2])::INT < 12 THEN 1024 END AS l, ceil(steps / 2000) AS ms,
  steps // 2000 AS sc, round(tokens / 200000) AS t, ('0x' || run[3])::INT % 2 AS b, CASE WHEN ('0x' || run[4])::INT < 8 THEN 'warn' END AS p, lr FROM runtab),
o AS (SELECT * FROM r ORDER BY run LIMIT 1),
x AS (SELECT r.run, r.m IS NOT DISTINCT FROM o.m AS model_id, true AS model_revision, r.l IS NOT DISTINCT FROM o.l AS sequence_length, r.ms IS NOT DISTINCT FROM o.ms AS max_steps,
  r.sc IS NOT DISTINCT FROM o.sc AS steps_completed, r.t IS NOT DISTINCT FROM o.t AS realized_train_tokens, r.b IS NOT DISTINCT FROM o.b AS train_batch_size, true AS gradient_accumulation_steps,
  true AS eval_task_paths, r.p IS NOT DISTINCT FROM o.p AS contamination_policy, r.lr IS NOT DISTINCT FROM o.lr AS same_learning_rate FROM r, o)
SELECT *, model_id AND sequence_length AND max_steps AND steps_completed AND realized_train_tokens AND train_batch_size AND contamination_policy AS all_matched FROM x""",
    "q_floor_lookup": f"""WITH {_BOOT}, f AS (SELECT * FROM (VALUES (1, 'domain_recall.token_f1'), (2, 'domain_application.token_f1')) v(k, metric) JOIN floors USING (metric) WHERE floor IS NOT NULL)
SELECT 'first' AS rule, round(coalesce((SELECT arg_min(floor, k) FROM f), 0), 6) AS floor UNION ALL SELECT 'largest', (SELECT round(max(floor), 6) FROM f)
UNION ALL SELECT 'first of none', 0 UNION ALL SELECT 'largest of none', NULL""",
    "q_sweep_expand": """WITH v AS (SELECT * FROM (VALUES (0, 2), (1, 4)) x(r, rank), (VALUES (0, 'Q_proj all', 'Q-proj-all'), (1, 'MLP/down', 'MLP-down')) y(a, targets, t), (VALUES (0, 0.001::DOUBLE, '0.001'), (1, 0.0005::DOUBLE, '0.0005')) z(l, lr, s))
SELECT rank, targets, lr, 'rank=' || rank || '__targets=' || t || '__lr=' || s AS variant, row_number() OVER (ORDER BY r, a, l) AS ordinal FROM v""",
    "q_memory_estimate": r"""WITH m AS (SELECT * FROM (VALUES ('Demo-0.6B', 'adapter', 'lora', 2, 4, 8, 128, 1, NULL), ('Demo-4B', 'adapter', 'qlora', 2, 7, 16, 1024, 2, 2.0::DOUBLE),
  ('demo-350M', 'full_finetune_small', 'none', 4, 0, 0, 512, 4, 5.0), ('unnamed', 'partial_unfreeze', 'none', 2, 0, 0, 256, 1, 1.0)) t(model_id, mode, adapter, w, targets, rank, length, batch, budget_gb)),
p AS (SELECT *, regexp_extract(model_id, '(\d+(?:\.\d+)?)\s*([bBmM])', 1) AS size, lower(regexp_extract(model_id, '(\d+(?:\.\d+)?)\s*([bBmM])', 2)) AS unit FROM m),
q AS (SELECT *, CASE WHEN size = '' THEN 600000000 ELSE trunc(size::DOUBLE * CASE unit WHEN 'b' THEN 1e9 ELSE 1e6 END)::BIGINT END AS parameters,
  CASE WHEN mode = 'full_finetune_small' THEN 1.0 WHEN mode = 'partial_unfreeze' THEN 0.05 WHEN adapter IN ('lora', 'qlora') THEN least(greatest(greatest(targets, 1) / 16 * (rank / 4096), 0.0005), 0.02) ELSE 0 END::DOUBLE AS part FROM p),
r AS (SELECT *, trunc(parameters * part)::BIGINT AS trainable FROM q),
b AS (SELECT model_id, mode, parameters, trainable, CASE WHEN adapter = 'qlora' THEN trunc(parameters * 0.5)::BIGINT ELSE parameters * w END AS weight_bytes, trainable * w AS gradient_bytes, trainable * 8 AS optimizer_bytes,
  (length * batch * 4096 * w * 4)::BIGINT AS activation_bytes, budget_gb FROM r)
SELECT *, weight_bytes + gradient_bytes + optimizer_bytes + activation_bytes AS total_bytes,
  coalesce(weight_bytes + gradient_bytes + optimizer_bytes + activation_bytes > budget_gb * 1073741824, false) AS over_budget FROM b""",
    "q_layer_norms": f"WITH {_LAY} SELECT vec_id, round(norm, 6) AS norm FROM nm",
    "q_layer_summary": f"WITH {_LAY} SELECT count(*) AS rows, count(DISTINCT label) AS labels, round(max(movement), 6) AS max_movement, round(sum(movement), 4) AS sum_movement FROM lay",
    "q_layer_compare": f"""WITH {_LAY}, c AS (SELECT label, count(*) AS steps, CASE WHEN count(*) > 1 THEN arg_min(movement, step) ELSE 0 END AS first, arg_max(movement, step) AS last FROM stp GROUP BY label)
SELECT label, steps, round(first, 4) AS first, round(last, 4) AS last, round(last - first, 4) + 0.0 AS change FROM c""",
    "q_layer_warnings": f"""WITH {_LAY}, b AS (SELECT step, count(*) AS n, sum(movement) AS total, max(movement) AS m, arg_max(label, (movement, label)) AS label FROM stp WHERE movement > 0 GROUP BY step)
SELECT 'dominant_update_module' AS code, step, label, round(m / total, 6) AS value FROM b WHERE n >= 3 AND m / total >= 0.1 UNION ALL
SELECT 'large_update_to_weight_ratio', step, label, round(ratio, 6) FROM stp WHERE ratio > 1 UNION ALL SELECT 'large_gradient_norm', step, label, round(gradient, 6) FROM stp WHERE gradient > 1000""",
    "q_heatmap": f"WITH {_LAY} SELECT label, " + ", ".join(f"round(max(movement) FILTER (WHERE step = {k}), 6) AS step_{k}" for k in range(7)) + " FROM stp GROUP BY label",
    "q_module_metadata": """WITH n AS (SELECT vec_id, label, vec_id % 4 AS k, 'model.layers.' || label || '.' || ['self_attn.q_proj.weight', 'mlp.down_proj.lora_A.default.weight', 'input_norm.weight', 'mlp.fc1.bias'][vec_id % 4 + 1] AS name FROM embeddings),
m AS (SELECT *, ['q_proj', 'down_proj', 'input_norm', 'fc1'][k + 1] AS module, ['attention', 'mlp', 'other', 'mlp'][k + 1] AS family FROM n)
SELECT vec_id, name, label AS layer_index, module, family, ['weight', 'lora_A', 'weight', 'bias'][k + 1] AS matrix_type,
       'L' || printf('%02d', label) || ' ' || family || ' ' || module AS label, label = 1 AS in_layer_1 FROM m""",
}

_DEDUPED = _DECIDED.replace("FROM documents WHERE NOT (" + blank("text") + ")", "FROM good").replace(
    "WITH RECURSIVE ", f"WITH RECURSIVE {CLEAN}, good AS MATERIALIZED (SELECT doc_id, clean_text AS text FROM judged WHERE len(reasons) = 0), "
)
_LEFT = "rest AS MATERIALIZED (SELECT doc_id, clean_text FROM cleaned SEMI JOIN (SELECT doc_id FROM decided WHERE status = 'kept') USING (doc_id))"
ORACLE["q_funnel"] = f"""{_DEDUPED}, {_LEFT}, {_EX}, {_overlap(13).replace('FROM cleaned', 'FROM rest')}, {_RUNS},
clear AS (SELECT doc_id FROM rest ANTI JOIN flags USING (doc_id))
SELECT '1 ingest' AS stage, count(*) AS documents FROM documents UNION ALL SELECT '2 text', count(*) FROM cleaned UNION ALL SELECT '3 clean', count(*) FROM good UNION ALL
SELECT '4 dedup', count(*) FROM rest UNION ALL SELECT '5 contamination', count(*) FROM clear UNION ALL SELECT '6 tokenize', count(*) FROM runs SEMI JOIN clear USING (doc_id)"""
ORACLE |= {
    "q_lora_delta_norm": """WITH c AS (SELECT vec_id // 2 AS p, vec_id % 2 AS side, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
z AS (SELECT a.p, b.k // 8 AS i, a.k % 8 AS j, sum(a.v * b.v) AS z FROM c a JOIN c b ON a.p = b.p AND a.side = 0 AND b.side = 1 AND a.k // 8 = b.k % 8 GROUP BY ALL)
SELECT 'layers.' || p || '.q_proj' AS prefix, round(2 * sqrt(sum(z * z)), 5) AS norm FROM z GROUP BY p""",
    "q_reference_rows": """WITH e AS (SELECT vec_id AS name, embedding::DOUBLE[] AS v, CASE vec_id % 5 WHEN 1 THEN list_concat(embedding[2:], embedding[1:1])::DOUBLE[] WHEN 2 THEN list_transform(embedding, lambda x: x * 0.5)::DOUBLE[]
  WHEN 3 THEN list_transform(embedding, lambda x: x * 0)::DOUBLE[] WHEN 4 THEN embedding::DOUBLE[] END AS f FROM embeddings),
n AS (SELECT name, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS w, sqrt(list_sum(list_transform(f, lambda x: x * x))) AS r, sqrt(list_sum(list_transform(list_zip(v, f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS u, f FROM e)
SELECT name, round(w, 4) AS weight_norm, round(r, 4) AS reference_norm, CASE WHEN f IS NOT NULL THEN round(u, 4) END AS update_norm, CASE WHEN r <> 0 THEN round(u / r, 4) END AS ratio FROM n""",
    "q_point_scores": f"""WITH {_SERIES}, {_POINTS}, p AS (SELECT config_hash, step, domain_gain AS g, general_loss AS l, reference AS r, step % 5 / 50.0::DOUBLE - 0.04 AS q FROM points),
o AS (SELECT *, CASE WHEN NOT coalesce(g > 0.02, false) THEN 0.0 WHEN q < -0.02 THEN 1.0 WHEN abs(q) <= 0.02 THEN 0.5 ELSE 0.0 END::DOUBLE AS o FROM p)
SELECT config_hash, step, CASE WHEN coalesce(l > 0.02, false) THEN 'forgetting_warning' WHEN o > 0 THEN 'domain_overfitting_watch' ELSE 'within_noise_or_improving' END AS interpretation,
round(CASE WHEN coalesce(l > 0, false) THEN greatest(0, l - 0.02) / CASE WHEN coalesce(r, 0) <> 0 THEN greatest(abs(r), 1e-9) ELSE 1 END ELSE 0 END, 4) AS forgetting_score, o AS overfitting_score,
round(greatest(0, coalesce(g, 0)) - greatest(0, coalesce(l, 0)) - o * greatest(1, coalesce(g, 0)), 4) AS recommendation_score FROM o""",
    "q_earliest_alert": f"WITH {_SERIES}, {_POINTS} SELECT config_hash, kind, min(step) AS step FROM alerts GROUP BY config_hash, kind",
    "q_qa_delta": f"""WITH {_BOOT} SELECT round((SELECT avg(delta) FROM deltas WHERE metric IN ('domain_recall.token_f1', 'domain_application.token_f1')), 6) AS delta,
round((SELECT greatest(coalesce(max(floor), 0), 0.02) FROM floors WHERE metric IN ('domain_recall.token_f1', 'domain_application.token_f1')), 6) AS floor""",
    "q_names": r"""WITH n AS (SELECT DISTINCT stage, name FROM metric_rows),
t AS (SELECT stage, name, unnest([stage || ' / ' || upper(name), '__Étage.' || stage || '-' || name || ' (mean)_', repeat(name, 3), ' !/ ']) AS text FROM n)
SELECT stage, name, text, coalesce(nullif(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '-')[:40], ''), 'run') AS slug, trim(regexp_replace(text, '[^a-zA-Z0-9_.-]+', '_', 'g'), '_') AS label FROM t""",
    "q_realized_tokens": f"WITH {_RUNTAB} SELECT run, steps * 8192 AS train_tokens, round(steps * 1.5 / 3600 * 2.0, 6) AS cost FROM runtab WHERE steps IS NOT NULL",
    "q_mini_eval": f"""SELECT suite, round(sum(value * token_count) / sum(token_count), 6) AS loss, round(exp(sum(value * token_count) / sum(token_count)), 6) AS perplexity
FROM eval_results WHERE metric_name = 'nll' AND token_count > 0 AND {_FIN} GROUP BY suite""",
    "q_surface_examples": f"WITH {_EX} SELECT example_id, sha256(clean_text) AS hash FROM examples WHERE kind = 'surface' ORDER BY example_id LIMIT 8",
}

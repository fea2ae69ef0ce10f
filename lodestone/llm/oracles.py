"""SQL for the licence and secret scans, for DuckDB."""

from __future__ import annotations

from .licences import TEMPLATES, THRESHOLD
from .secrets import SHARED_OWNERS

_NOTICES = ", ".join("('{}', {}, '{}')".format(licence, i, notice.replace("'", "''")) for licence, notices in sorted(TEMPLATES.items()) for i, notice in enumerate(notices))

ORACLE_OP5 = rf"""
WITH files AS (
  SELECT CASE WHEN length(coalesce(text, '')) < 400 AND doc_id % 2 = 0 THEN source || '/' || doc_id // 1000 || '/LICENSE-' || doc_id
    WHEN length(coalesce(text, '')) < 400 THEN source || '/' || doc_id // 1000 || '/' || doc_id // 50 || '/LICENSE-' || doc_id
    ELSE source || '/' || doc_id // 1000 || '/' || doc_id // 50 || '/' || doc_id || '.txt' END AS path, text FROM documents),
notices(licence, notice, said) AS (VALUES {_NOTICES}),
terms AS (SELECT licence, notice, unnest(regexp_extract_all(lower(said), '[a-z0-9]+')) AS term FROM notices),
total AS (SELECT count(*) AS n FROM files),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS term FROM files) WHERE term IN (SELECT term FROM terms) GROUP BY 1),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM terms) LEFT JOIN df USING (term), total),
weights AS (SELECT licence, notice, term, count(*) * any_value(idf) AS w FROM terms JOIN idf USING (term) GROUP BY 1, 2, 3),
template AS (SELECT licence, notice, term, w / sqrt(sum(w * w) OVER (PARTITION BY licence, notice)) AS t FROM weights),
passages AS (
  SELECT DISTINCT path, unnest(regexp_split_to_array(regexp_replace(text, '([.!?;])\s+', '\1' || chr(10), 'g'), '\n+')) AS passage FROM files WHERE text IS NOT NULL),
told AS (SELECT path, passage, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS term FROM passages WHERE regexp_matches(lower(passage), 'licen|licensed|gnu|mit|redistribution|permission|mozilla|bsd')),
weighed AS (SELECT path, passage, term, count(*) * coalesce(any_value(idf), (SELECT ln(1 + n) + 1 FROM total)) AS w FROM told LEFT JOIN idf USING (term) GROUP BY 1, 2, 3),
norms AS (SELECT path, passage, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY 1, 2),
scored AS (
  SELECT path, licence, round(sum(w * t) / any_value(norm), 6) AS similarity FROM weighed JOIN template USING (term) JOIN norms USING (path, passage) GROUP BY path, passage, licence, notice),
own AS (SELECT path, arg_min(licence, struct_pack(s := -similarity, l := licence)) AS licence, max(similarity) AS similarity FROM scored WHERE similarity >= {THRESHOLD} GROUP BY 1),
dirs AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, arg_min(licence, struct_pack(s := -similarity, l := licence)) AS licence FROM own WHERE regexp_matches(regexp_extract(path, '[^/]*$', 0), '(?i)^(licen[cs]e|copying|unlicense)([-._].*)?$') GROUP BY 1),
above AS (
  SELECT path, unnest(range(0, len(parts) + 1)) AS depth, parts FROM (SELECT path, string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') AS parts FROM files)),
near AS (
  SELECT path, arg_max(dir, depth) AS from_dir, arg_max(licence, depth) AS licence FROM (SELECT path, depth, array_to_string(list_slice(parts, 1, depth), '/') AS dir FROM above) JOIN dirs USING (dir) GROUP BY 1)
SELECT DISTINCT f.path, coalesce(o.licence, n.licence) AS licence, CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
  o.similarity, CASE WHEN o.licence IS NULL THEN n.from_dir END AS from_dir
FROM files f LEFT JOIN own o ON f.path = o.path LEFT JOIN near n ON f.path = n.path
"""

_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLE_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, concat_ws('/', source, lang) AS repo, sha256(coalesce(text, '')) AS digest FROM documents),
m AS (
  SELECT row, doc_id, source, repo, digest, 'assign' AS kind, 0 AS rank, regexp_extract_all(text, '{_ASSIGN}', 0) AS whole, regexp_extract_all(text, '{_ASSIGN}', 1) AS value, regexp_split_to_array(text, '{_ASSIGN}') AS rest FROM d
  UNION ALL SELECT row, doc_id, source, repo, digest, 'access', 1, regexp_extract_all(text, 'AKIA[A-Z0-9]{{12,}}'), regexp_extract_all(text, 'AKIA[A-Z0-9]{{12,}}'), regexp_split_to_array(text, 'AKIA[A-Z0-9]{{12,}}') FROM d
  UNION ALL SELECT row, doc_id, source, repo, digest, 'hex', 2, regexp_extract_all(text, '[0-9a-f]{{32,}}'), regexp_extract_all(text, '[0-9a-f]{{32,}}'), regexp_split_to_array(text, '[0-9a-f]{{32,}}') FROM d
  UNION ALL SELECT row, doc_id, source, repo, digest, 'bare', 3, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{24,}}'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{24,}}'), regexp_split_to_array(text, '[A-Za-z0-9+/_=-]{{24,}}') FROM d),
placed AS (
  SELECT * EXCLUDE (whole, rest, value, k), value[k] AS value,
    (list_sum(list_transform(rest[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start, length(whole[k]) AS size
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM m WHERE len(whole) > 0)),
chars AS (SELECT DISTINCT value FROM placed WHERE length(value) >= 8),
entropy AS (
  SELECT value, -sum(p * log2(p)) AS bits FROM (SELECT value, c, count(*) / any_value(length(value)) AS p FROM (SELECT value, unnest(string_split(value, '')) AS c FROM chars) GROUP BY 1, 2) GROUP BY 1),
base AS (SELECT * FROM placed WHERE rank IN (1, 2) OR rank = 0 AND length(value) >= 8),
bare AS (
  SELECT p.* FROM placed p JOIN entropy e ON p.value = e.value WHERE rank = 3 AND regexp_matches(p.value, '[0-9]') AND regexp_matches(p.value, '[a-z]') AND regexp_matches(p.value, '[A-Z]') AND bits >= 3.5
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = p.row AND b.start < p.start + p.size AND p.start < b.start + b.size)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
texts AS (SELECT value, count(DISTINCT digest) AS n_texts FROM found GROUP BY 1),
repos AS (SELECT value, source AS owner, count(DISTINCT repo) AS n FROM found GROUP BY 1, 2),
owners AS (SELECT value, count(*) AS n_owners, sum(n) AS n_repos, max(n) AS most, any_value(n_texts) AS n_texts FROM repos JOIN texts USING (value) GROUP BY 1),
judged AS (
  SELECT f.*, n_owners, n_repos, n_texts, n_owners >= {SHARED_OWNERS} AND 2 * most <= n_repos AS shared, length(f.value) >= 12 AND bits >= 2.5 AND NOT (n_owners >= {SHARED_OWNERS} AND 2 * most <= n_repos) AS live
  FROM found f JOIN owners o ON f.value = o.value JOIN entropy e ON f.value = e.value),
spans AS (
  SELECT row, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS c, count(*) FILTER (rank = 2) AS h,
    string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) FILTER (rank < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (shared AND rank < 3) AS n_shared,
    max(n_owners) FILTER (rank < 3 OR live) AS most_owners, max(n_repos) FILTER (rank < 3 OR live) AS most_repos, max(n_texts) FILTER (rank < 3 OR live) AS most_texts
  FROM judged GROUP BY 1)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_shared, 0)::BIGINT AS n_shared,
  coalesce(most_owners, 0)::BIGINT AS most_owners, coalesce(most_repos, 0)::BIGINT AS most_repos, coalesce(most_texts, 0)::BIGINT AS most_texts
FROM d LEFT JOIN spans USING (row)
"""

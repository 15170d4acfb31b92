"""DuckDB SQL that gives the rows of the queries that SQL can express."""

EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

#: Targets and thresholds from running sums over all rows in hash order; {docs} is the table that is mixed.
MIX_STEPS = r"""
told AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(md5(coalesce('=' || doc_id::VARCHAR, '')) || md5(coalesce('=' || source, '')) || md5(coalesce(text, ''))) AS key
  FROM {docs}),
sized AS (
  SELECT *, ('0x' || substr(md5('mix-2:' || key || ':' || row_number() OVER (PARTITION BY key)), 1, 15))::BIGINT AS hash
  FROM told),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
filling AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0) AS left_size,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS left_weight
  FROM totals
  WINDOW earlier AS (ORDER BY source_size * 6 // weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
limited AS (SELECT *, left_size * weight >= 3 * source_size * left_weight AS is_full FROM filling),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN (3 * source_size)::DOUBLE
              ELSE ((sum(source_size) OVER () - coalesce(sum(CASE WHEN is_full THEN 3 * source_size END) OVER (), 0)) * weight)::DOUBLE
                   / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target,
         CASE WHEN source_size = 0 THEN 0 WHEN is_full THEN 3
              ELSE (sum(source_size) OVER () - coalesce(sum(CASE WHEN is_full THEN 3 * source_size END) OVER (), 0)) * weight
                   // (sum(CASE WHEN NOT is_full THEN weight END) OVER () * source_size) END AS base
  FROM limited),
bases AS (SELECT source, source_size, target, base::BIGINT AS base FROM targets),
units AS (
  SELECT source, hash, sum(size) AS size FROM sized GROUP BY source, hash),
running AS (
  SELECT u.source, u.hash, u.size, sum(u.size) OVER (PARTITION BY u.source ORDER BY u.hash) AS upto, b.target - b.base * b.source_size AS rest
  FROM units u JOIN bases b ON u.source IS NOT DISTINCT FROM b.source),
ends AS (
  SELECT source, arg_min(CASE WHEN upto - rest < rest - (upto - size) THEN hash + 1 ELSE hash END, hash) AS threshold
  FROM running WHERE upto > rest GROUP BY source),
mixed AS (
  SELECT s.*, b.source_size, b.target, b.base + CASE WHEN b.base < 3 AND s.hash < coalesce(e.threshold, 1 << 60) THEN 1 ELSE 0 END AS times
  FROM sized s JOIN bases b ON s.source IS NOT DISTINCT FROM b.source
  LEFT JOIN ends e ON s.source IS NOT DISTINCT FROM e.source)
"""

MIX = (
    "WITH "
    + MIX_STEPS.format(docs="documents")
    + "SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken FROM mixed"
)

#: Trees of two levels over files of up to 256 records; the replica's records are hashed for themselves.
FIXITY = r"""
WITH p AS (
  SELECT page_id, page_id // 256 AS file, coalesce(url, '') AS url, coalesce(html, '') AS html,
         ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT AS turn
  FROM pages),
f AS (SELECT *, (turn % greatest(length(html), 1))::INTEGER AS pos, substr(html, pos + 1, 1) AS found FROM p),
w AS (
  SELECT page_id, file, html AS a,
         CASE WHEN turn % 50 = 0 THEN substr(html, 1, pos) || CASE WHEN found = '~' THEN '^' ELSE repeat('~', strlen(found)) END || substr(html, pos + 2)
              ELSE html END AS b,
         chr(13) || chr(10) AS nl, 'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Length: ' AS head
  FROM f),
h AS (SELECT page_id, file, head || strlen(a) || nl || nl || a || nl || nl AS ra, head || strlen(b) || nl || nl || b || nl || nl AS rb FROM w),
placed AS (
  SELECT page_id, file, row_number() OVER o - 1 AS place, (sum(strlen(ra)) OVER o)::BIGINT AS "end", strlen(ra) AS length, sha256(ra) AS sha256, sha256(rb) AS b_sha256
  FROM h WINDOW o AS (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING)),
one AS (
  SELECT file, place // 16 AS up, min("end" - length) AS start, max("end") AS "end",
         sha256(string_agg(("end" - length) || ' ' || "end" || ' ' || sha256, chr(10) ORDER BY place)) AS hash
  FROM placed GROUP BY file, up),
two AS (SELECT file, sha256(string_agg(start || ' ' || "end" || ' ' || hash, chr(10) ORDER BY up)) AS root FROM one GROUP BY file)
SELECT page_id, file, place, "end" - length AS start, "end", sha256, sha256 = b_sha256 AS intact,
       CASE WHEN sha256 <> b_sha256 THEN b_sha256 END AS replica_sha256, root
FROM placed JOIN two USING (file)
"""

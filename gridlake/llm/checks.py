"""DuckDB SQL for the text operators that SQL can express."""

DECONTAMINATE = r"""
WITH lowered AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
listed AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS window_words
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM listed WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
    SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS window_words
    FROM (SELECT doc_id, w, k, unnest(range(1, greatest(1, len(w) - k + 2))) AS i FROM lowered CROSS JOIN sizes)),
hits AS (
    SELECT doc_id, p.i, p.k, item_id FROM places p JOIN windows USING (k, window_words)),
hit_words AS (
    SELECT doc_id, count(DISTINCT spot) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + k)) AS spot FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

MIX = r"""
WITH RECURSIVE sizes AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
totals AS (SELECT source, sum(size) AS source_size FROM sizes GROUP BY source),
ranked AS (
    SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals),
leveled AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= cap::DOUBLE / weight AS clamped
    FROM ranked WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
targets AS (
    SELECT source, CAST(source_size AS BIGINT) AS source_size,
           CASE WHEN clamped THEN cap::DOUBLE
                ELSE (sum(source_size) OVER () - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ())::DOUBLE
                     / sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () * weight END AS target
    FROM leveled),
parts AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
           target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS part FROM targets),
grouped AS (
    SELECT doc_id, source, size, key, substr(key, 1, 3) AS bucket, size * count(*) AS total
    FROM sizes GROUP BY doc_id, source, size, key),
placed AS (
    SELECT g.*, source_size, target, whole, part,
           sum(total) OVER (PARTITION BY g.source ORDER BY bucket) AS bucket_upto,
           row_number() OVER (PARTITION BY g.source ORDER BY key, doc_id, size) AS place
    FROM grouped g JOIN parts p ON g.source IS NOT DISTINCT FROM p.source),
-- One document at a time and source: the next one in seeded order that still fits.
steps AS (
    SELECT source, part - coalesce(max(CASE WHEN bucket_upto <= part THEN bucket_upto END), 0) AS lack,
           coalesce(max(CASE WHEN bucket_upto <= part THEN place END), 0) AS place
    FROM placed WHERE part > 0 GROUP BY source, part
    UNION ALL
    SELECT t.source, arg_min(t.lack - p.total, p.place), min(p.place)
    FROM steps t JOIN placed p ON t.source IS NOT DISTINCT FROM p.source AND p.place > t.place AND p.total <= t.lack AND p.total > 0
    GROUP BY t.source),
starts AS (SELECT source, min(place) AS first_place, min(lack) AS lack FROM steps GROUP BY source),
taken AS (
    SELECT p.*, s.place IS NOT NULL OR p.place <= f.first_place AS fits, f.lack AS final_lack
    FROM placed p LEFT JOIN starts f ON p.source IS NOT DISTINCT FROM f.source
    LEFT JOIN steps s ON p.source IS NOT DISTINCT FROM s.source AND p.place = s.place),
nearest AS (
    SELECT source, doc_id, size FROM taken
    WHERE NOT coalesce(fits, false) AND abs(total - final_lack) < final_lack
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(total - final_lack), key, doc_id, size) = 1)
SELECT s.doc_id, s.size, t.source_size, t.target,
       CAST(s.size * (t.whole + CASE WHEN t.fits OR n.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sizes s
JOIN taken t ON s.doc_id IS NOT DISTINCT FROM t.doc_id AND s.source IS NOT DISTINCT FROM t.source AND s.size = t.size
LEFT JOIN nearest n ON s.doc_id = n.doc_id AND s.source IS NOT DISTINCT FROM n.source AND s.size = n.size
"""

EXACT_DEDUP = """
WITH hashed AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""

"""DuckDB SQL for those queries that SQL can express."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':5'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         row_number() OVER (ORDER BY source IS NULL, source) AS n, 2.0::DOUBLE * source_size AS most FROM sums),
leveled AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - coalesce(sum(most) OVER e, 0.0::DOUBLE))
            / (sum(w) OVER () - coalesce(sum(w) OVER e, 0.0::DOUBLE)) AS lvl
  FROM weighed WINDOW e AS (ORDER BY most / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least(most, coalesce(w * max(lvl) FILTER (lvl <= most / w) OVER (), most)) AS target FROM leveled),
drawn AS (
  SELECT d.doc_id, d.size, d.u, t.source, t.source_size, t.target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, floor(e) AS whole, e - floor(e) AS p,
         CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM drawn),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) - size / 2.0 AS upto FROM ranked)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN q IS NOT NULL AND upto <= p * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""

SQL = {"op5_mixing": MIXING}

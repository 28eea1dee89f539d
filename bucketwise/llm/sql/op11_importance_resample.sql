WITH RECURSIVE step AS (
  SELECT i, i::UINTEGER AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, true AS is_doc, text FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, false, text FROM benchmark
), words AS (
  SELECT r, doc_id, is_doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT r, is_doc, unnest(w) AS f FROM words
  UNION ALL
  SELECT r, is_doc, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1
), counted AS (SELECT r, is_doc, f, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UINTEGER,
              list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 1 + 2 * i, 2))::UINTEGER)),
              lambda c, b: xor(tab[1 + xor(c & 255::UINTEGER, b)], c >> 8)), 4294967295::UINTEGER) % 10000 AS bucket
  FROM hexed, crc
), by_bucket AS (SELECT r, is_doc, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
totals AS (
  SELECT coalesce(sum(n) FILTER (is_doc), 0)::DOUBLE AS all_s, coalesce(sum(n) FILTER (NOT is_doc), 0)::DOUBLE AS all_t FROM by_bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (is_doc), 0) AS s, coalesce(sum(n) FILTER (NOT is_doc), 0) AS t FROM by_bucket GROUP BY bucket), totals
), weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n)::DOUBLE)::BIGINT AS weight FROM by_bucket JOIN gains USING (bucket) WHERE is_doc GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UINTEGER + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE is_doc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
    count(*) OVER (PARTITION BY n_words >= 20) AS eligible FROM scored
) SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank FROM placed

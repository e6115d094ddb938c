"""DuckDB SQL for the training-data queries that SQL expresses on whole tables."""

_OP7 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size FROM t)
"""

#: The level of the targets is found here by trying each possible set of full sources.
_OP9 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * o.source_size) FROM s o WHERE o.source_size / o.weight < s.source_size / s.weight), 0))
            / ((SELECT sum(weight) FROM s) - coalesce((SELECT sum(o.weight) FROM s o WHERE o.source_size / o.weight < s.source_size / s.weight), 0)) AS level
  FROM s),
g AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least((3 * source_size)::DOUBLE, weight * (SELECT max(level) FROM l WHERE 3 * source_size >= level * weight)) END AS target FROM l),
r AS (
  SELECT d.*, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN least(3.0::DOUBLE, g.target / g.source_size) ELSE 0.0 END AS rate,
         ('0x' || substr(md5('17|' || CASE WHEN d.source IS NULL THEN 'true' ELSE 'false' END || '|' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift,
         row_number() OVER (PARTITION BY d.source ORDER BY (d.size >> greatest(0, length(bin(d.size)) - 8)) << greatest(0, length(bin(d.size)) - 8), md5('17:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id) AS k
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, size * least(3, floor(k * rate + shift) - floor((k - 1) * rate + shift))::BIGINT AS taken FROM r
"""

#: CRC-32 of each distinct word: SQL has none, so its table is made from the polynomial.
_OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS w FROM d),
bw AS (SELECT unnest(words) AS w FROM b),
steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
names AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
                            lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), steps),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN names USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN names USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
f AS (SELECT doc_id, sum(gain)::BIGINT AS total, count(*) AS n FROM dw JOIN names USING (w) JOIN g USING (bucket) GROUP BY doc_id),
w AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - (total % n + n) % n) // n END AS weight,
         ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20)
SELECT r.*, CASE WHEN rank <= 10 * (SELECT count(*) FROM o) // 100 THEN rank END AS rank FROM r LEFT JOIN o USING (doc_id)
"""

#: All pairs that share a shingle, by counting.
_OP12 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(words[i : i + 4], ' ')) AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
root AS (SELECT node, min(other) AS least FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root ON node = doc_id
"""

SQL = {"op7_exact_dedup": _OP7, "op9_source_mixing": _OP9, "op11_importance_resampling": _OP11, "op12_setsketch_dedup": _OP12}

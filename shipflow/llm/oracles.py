"""DuckDB SQL of the registered queries; tables are views."""

WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size
  FROM documents),
keyed AS (SELECT *, md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), digest)) AS key FROM docs),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sources),
weighed AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, CAST(source_size * 2 AS DOUBLE) AS cap
  FROM turns),
levels AS (
  SELECT *,
    (sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER before, 0e0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0e0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
placed AS (
  SELECT k.*, a.source_size, a.target, CAST(floor(a.target) AS BIGINT) AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
  FROM keyed k JOIN aims a ON k.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + greatest(0, least(size, budget - (budget // source_size) * source_size - begin_at)) END AS BIGINT) AS taken
FROM placed
"""

LINES = r"""
WITH cells AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n
  FROM cells WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
pairs AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS next_line FROM numbered),
later AS (
  SELECT doc_id, n, first_value(struct_pack(d := doc_id, n := n)) OVER same AS first_place, row_number() OVER same AS copy
  FROM pairs WHERE next_line IS NOT NULL
  WINDOW same AS (PARTITION BY line, next_line ORDER BY doc_id, n)),
copies AS (SELECT doc_id, n, first_place.d AS of_doc, first_place.n - n AS shift FROM later WHERE copy > 1),
islands AS (
  SELECT *, CASE WHEN lag(n) OVER w = n - 1 AND lag(of_doc) OVER w = of_doc AND lag(shift) OVER w = shift
    THEN 0 ELSE 1 END AS fresh
  FROM copies WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
runs AS (
  SELECT doc_id, run, min(n) AS n, count(*) + 1 AS lines
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM islands) GROUP BY doc_id, run),
run_figures AS (SELECT doc_id, count(*) AS n_runs, max(lines) AS longest_run FROM runs GROUP BY doc_id),
removed AS (SELECT DISTINCT doc_id, n FROM (SELECT doc_id, n FROM copies UNION ALL SELECT doc_id, n + 1 FROM copies)),
gone AS (SELECT r.doc_id, p.place FROM removed r JOIN numbered p USING (doc_id, n)),
kept AS (
  SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.place) AS text
  FROM cells c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.place = g.place WHERE g.place IS NULL GROUP BY c.doc_id),
line_counts AS (SELECT doc_id, count(*) AS n_lines FROM numbered GROUP BY doc_id),
removed_counts AS (SELECT doc_id, count(*) AS n_removed FROM removed GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(f.n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(f.longest_run, 0) AS BIGINT) AS longest_run,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN line_counts l USING (doc_id) LEFT JOIN removed_counts r USING (doc_id)
LEFT JOIN run_figures f USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

SUBSTRINGS = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS start FROM docs),
windows AS (
  SELECT s.doc_id, s.start, md5(array_to_string(list_slice(d.words, s.start, s.start + 34), ' ')) AS window_key
  FROM starts s JOIN docs d USING (doc_id)),
repeated AS (SELECT window_key FROM windows GROUP BY window_key HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 35)) AS n FROM windows JOIN repeated USING (window_key)),
cells AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS n FROM docs),
kept AS (
  SELECT c.doc_id, count(*) AS n_kept, string_agg(c.word, ' ' ORDER BY c.n) AS text
  FROM cells c LEFT JOIN covered v ON c.doc_id = v.doc_id AND c.n = v.n WHERE v.n IS NULL GROUP BY c.doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words,
  CAST(len(d.words) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

EXACT = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents),
placed AS (
  SELECT doc_id, sha256(text) AS text_sha256, first_value(doc_id) OVER same AS keep_id,
    count(*) OVER (PARTITION BY text) AS group_size, row_number() OVER same AS place
  FROM texts WINDOW same AS (PARTITION BY text ORDER BY doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM placed
"""

# The checksum of a word goes over its bytes by a table, which eight steps make for each byte value.
IMPORTANCE = r"""
WITH steps AS (
  SELECT byte, list_reduce(range(8), lambda value, bit:
    CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, byte) AS value
  FROM (SELECT unnest(range(256)) AS byte)),
crc_table AS (SELECT list(value ORDER BY byte) AS cells FROM steps),
sides AS (
  SELECT doc_id, text, FALSE AS aim FROM documents UNION ALL SELECT item_id, text, TRUE FROM benchmark),
words AS (
  SELECT doc_id, aim, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM sides),
cells AS (SELECT doc_id, aim, unnest(words) AS word FROM words),
codes AS (
  SELECT word, list_transform(range(strlen(word)), lambda i:
    CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT word FROM cells)),
buckets AS (
  SELECT word, xor(list_reduce(bytes, lambda crc, byte:
    xor(cells[(xor(crc, byte) & 255) + 1], crc >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM codes, crc_table),
counts AS (
  SELECT bucket, count(*) FILTER (NOT aim) AS s, count(*) FILTER (aim) AS t
  FROM cells JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000)
    / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM counts),
weights AS (
  SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM cells JOIN buckets USING (word) JOIN gains USING (bucket) WHERE NOT aim GROUP BY doc_id),
scored AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || w.doc_id), 1, 8) AS BIGINT) + 0.5e0)
      / 4294967296e0))) AS BIGINT) AS score
  FROM words w LEFT JOIN weights g ON w.doc_id = g.doc_id WHERE NOT aim),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible
  FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""

ORACLES: dict[str, str] = {
    "op12_exact_dedup": EXACT,
    "op13_resampling": IMPORTANCE,
    "op5_substrings": SUBSTRINGS,
    "op8_line_dedup": LINES,
    "op7_mixing": MIXING,
}

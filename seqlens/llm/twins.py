"""DuckDB SQL of those operators whose results SQL can express."""

from __future__ import annotations


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The twin of op11: every part measured against every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
  owned_{r} AS MATERIALIZED (
    SELECT p.row_id, p.part, p.c, min(list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries} + b.entry) AS best
    FROM parts p JOIN book_{r} b ON b.part = p.part GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
  moved_{r} AS (
    SELECT part, best % {entries} AS entry, place, sum(c[place]) AS total, count(*) AS n
    FROM owned_{r}, unnest(generate_series(1, len(c))) AS u(place) GROUP BY ALL),
  means_{r} AS (
    SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM moved_{r} GROUP BY ALL),
  book_{r + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book_{r} b LEFT JOIN means_{r} m ON m.part = b.part AND m.entry = b.entry)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row_id,
      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS MATERIALIZED (
    SELECT row_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS c
    FROM kept, generate_series(0, {parts - 1}) AS g(part)),
  book_0 AS MATERIALIZED (SELECT part, row_id - 1 AS entry, c FROM parts WHERE row_id <= {entries}),
  {",".join(steps)},
  coded AS (
    SELECT row_id, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
    FROM owned_{rounds} GROUP BY row_id),
  digest AS (
    SELECT sha256(string_agg(CAST(c[place] AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256
    FROM book_{rounds}, unnest(generate_series(1, len(c))) AS u(place))
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row_id), digest"""


def spelling(shortest: int = 7, least: int = 2, factor: int = 10, slip: int = 31) -> str:
    """The twin of op12: crc32 from its polynomial; near words by what is left without one code point."""
    return f"""
WITH RECURSIVE bits(n, k, c) AS (
    SELECT n, 0, n FROM generate_series(0::BIGINT, 255::BIGINT) AS g(n)
    UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
  crc AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
  runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents),
  each_run AS MATERIALIZED (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {shortest} GROUP BY ALL),
  coded AS (
    SELECT run, n, list_transform(string_split(id || ':' || run, ''), lambda ch: CAST(ord(ch) AS BIGINT)) AS points FROM each_run),
  hashed AS MATERIALIZED (
    SELECT run, n, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(points, lambda o: CASE WHEN o < 128 THEN [o] ELSE [192 + (o >> 6), 128 + (o & 63)] END))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
    FROM coded, crc),
  slipped AS (
    SELECT n, CASE WHEN h % {slip} = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed),
  words AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {least}),
  cuts AS MATERIALIZED (
    SELECT word, n, place, left(word, CAST(place AS INTEGER) - 1) || substr(word, CAST(place AS INTEGER) + 1) AS rest
    FROM words, unnest(generate_series(1, length(word))) AS u(place)),
  links AS (
    SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
    UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
    UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
  best AS MATERIALIZED (
    SELECT word, count(*) AS n_near, min(struct_pack(minus := -m, other := other)) AS b FROM links GROUP BY word),
  forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.minus >= {factor} * w.n THEN b.other END AS form, CASE WHEN -b.minus >= {factor} * w.n THEN -b.minus END AS form_n
    FROM words w LEFT JOIN best USING (word)),
  chain(word, root, k) AS (
    SELECT word, word, 0 FROM forms
    UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, f.n, f.n_near, f.form_n, c.root
FROM forms f JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) c USING (word)"""

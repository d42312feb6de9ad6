"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

OP1 = """
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS k,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), s AS (
  SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k
), w AS (
  SELECT *, (row_number() OVER (ORDER BY k) - 1)::BIGINT AS rank FROM s
), c AS (
  SELECT *, [3.0, 1.0, 2.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS cap FROM w
), f AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, k) AS fill,
         ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), o AS (
  SELECT min(fill) AS open_fill, arg_min(level, fill) AS open_level FROM f WHERE level * weight <= cap
), t AS (
  SELECT k, source_size, rank, CASE WHEN open_fill IS NULL OR fill < open_fill THEN cap ELSE open_level * weight END AS target
  FROM f LEFT JOIN o ON true
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.rank, t.target, floor(t.target + 0.5)::BIGINT AS owed,
         (sum(d.size) OVER (PARTITION BY d.k ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size AS begin_at
  FROM d JOIN t USING (k)
), q AS (
  SELECT *, greatest(least(size, owed - begin_at), 0)::BIGINT AS take0,
         greatest(least(size, owed - begin_at - source_size), 0)::BIGINT AS take1 FROM p
), u AS (
  SELECT *, (begin_at + take0 / 2.0::DOUBLE)::DOUBLE / target AS u FROM q
), g AS (  -- the segment of the schedule: demand before it, its start, weight there, half its slope
  SELECT *, CASE WHEN rank % 3 = 0 AND u < 0.625 THEN [0.0, 0.0, 1.5, -0.5]::DOUBLE[]
                 WHEN rank % 3 = 0 THEN [0.625, 0.5, 1.0, -0.5]::DOUBLE[]
                 WHEN rank % 3 = 1 AND u < {late_c} THEN [0.0, 0.0, {late_b0}, {late_a0}]::DOUBLE[]
                 WHEN rank % 3 = 1 THEN [{late_c}, 0.75, {late_b1}, {late_a1}]::DOUBLE[]
                 ELSE [0.0, 0.0, 1.0, 0.0]::DOUBLE[] END AS z FROM u
)
SELECT doc_id, size, source_size, target, (take0 + take1)::BIGINT AS taken,
       ((take0 > 0)::INT + (take1 > 0)::INT)::INT AS copies,
       CASE WHEN take0 > 0 THEN floor(least(z[2] + CASE WHEN u - z[1] <= 0 THEN 0.0::DOUBLE ELSE (u - z[1]) * 2.0::DOUBLE
         / (z[3] + sqrt(greatest(z[3] * z[3] + 4.0::DOUBLE * z[4] * (u - z[1]), 0.0::DOUBLE))) END, 1.0::DOUBLE) * 1000000)::BIGINT END AS position
FROM g
"""


def _op1() -> str:
    w0, w1, w2 = (x / ((0.75 - 0.0) * (0.25 + 1.0) / 2 + (1.0 - 0.75) * (1.0 + 2.0) / 2) for x in (0.25, 1.0, 2.0))
    return OP1.format(late_c=repr(0.75 * (w0 + w1) / 2), late_b0=repr(w0), late_a0=repr((w1 - w0) / (2 * 0.75)), late_b1=repr(w1), late_a1=repr((w2 - w1) / (2 * 0.25)))


OP10 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         CASE WHEN lang IS NULL THEN '~' ELSE '=' || lang END AS lk,
         CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS sk FROM documents
), a AS (
  SELECT r, doc_id, lk, sk, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM d
), win AS (
  SELECT r, i, list_slice(w, i, i + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM a WHERE len(w) >= 8)
), rep AS (
  SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), reps AS (
  SELECT r, sum(n)::BIGINT AS n_repeat_words FROM (
    SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM rep) GROUP BY r
), b AS (
  SELECT r, doc_id, lk, sk, len(w)::BIGINT AS n_words, word_chars, n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM a LEFT JOIN reps USING (r)
), f AS (
  SELECT *, (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AS base_failed FROM b
), m AS (
  SELECT r, lk, sk, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS metric,
         unnest([word_chars * 1000 // n_words, n_symbols * 1000 // n_words, n_dup_lines * 1000 // n_words, n_repeat_words * 1000 // n_words]) AS v
  FROM f WHERE NOT base_failed
), h AS (
  SELECT lk, sk, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bin, count(*) AS n FROM m GROUP BY ALL
), cum AS (
  SELECT *, sum(n) OVER (PARTITION BY lk, sk, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lk, sk, metric) AS total FROM h
), pick AS (
  SELECT lk, sk, metric, min(bin) FILTER (upto * 100 >= total * 25) AS q25, min(bin) FILTER (upto * 100 >= total * 75) AS q75,
         CASE metric WHEN 'word_length' THEN 500 WHEN 'symbols' THEN 20 WHEN 'dup_lines' THEN 10 ELSE 50 END AS least
  FROM cum GROUP BY ALL
), bad AS (
  SELECT r, count(*) AS failed FROM m JOIN pick USING (lk, sk, metric)
  WHERE v > q75 + 3 * greatest(q75 - q25, least) OR (metric = 'word_length' AND v < q25 - 3 * greatest(q75 - q25, least)) GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND coalesce(failed, 0) = 0) AS kept, coalesce(failed, 0)::INT AS failed_rules
FROM f LEFT JOIN bad USING (r)
"""

def _op12(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Rounds of exact assignment (dot products of integers are exact in doubles here) and means rounded down."""

    def nearest(book: str) -> str:
        return f"""(
  SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT s.r, s.part, b.entry, (list_dot_product(s.y, s.y) - 2 * list_dot_product(s.y, b.y) + list_dot_product(b.y, b.y))::BIGINT AS d
    FROM s JOIN {book} b USING (part)) GROUP BY r, part)"""

    steps = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT r, part, list_slice(x, part * (len(x) // {parts}) + 1, (part + 1) * (len(x) // {parts})) AS y
  FROM v, (SELECT unnest(range({parts})) AS part)
), b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, y FROM s WHERE r <= {entries})"""
    for i in range(rounds):
        steps += f""", n{i} AS MATERIALIZED {nearest(f"b{i}")}, m{i} AS MATERIALIZED (
  SELECT part, entry, list(floor_sum ORDER BY pos) AS y FROM (
    SELECT part, entry, pos, ((t - ((t % n) + n) % n) // n)::DOUBLE AS floor_sum FROM (
      SELECT part, entry, pos, sum(z)::BIGINT AS t, count(*)::BIGINT AS n FROM (
        SELECT n{i}.part, n{i}.entry, unnest(s.y)::BIGINT AS z, unnest(range(len(s.y))) AS pos FROM n{i} JOIN s USING (r, part)) GROUP BY part, entry, pos))
  GROUP BY part, entry
), b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{i}.y, b{i}.y) AS y FROM b{i} LEFT JOIN m{i} USING (part, entry))"""
    return f"""{steps}, f AS MATERIALIZED {nearest(f"b{rounds}")}, c AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY r
), h AS (
  SELECT sha256(string_agg(array_to_string(list_transform(y, lambda z: z::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (r), h
"""


OP13 = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS MATERIALIZED (
  SELECT r, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS MATERIALIZED (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), e AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM e
), q AS (
  SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM e GROUP BY lang, term)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM u QUALIFY part = 'pair' OR rank <= 50
"""

ORACLES = {"op1_mixing": _op1(), "op10_quality_rules": OP10, "op12_vector_codes": _op12(), "op13_source_divergence": OP13}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_scan import BASE_PHRASES, postings, templates

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"


def _licenses() -> str:
    """Statements are looked for at every place of every document, without an index; notices by joining all places of their rare words."""
    of = templates()
    found = postings(of)
    mass = {t: sum(p.weight for p in found if p.template == t) for t in range(len(of))}
    rows = ", ".join(f"('{t.name}', '{t.label}', {len(t.words)}, {mass[i]!r}::DOUBLE, {str(t.name in BASE_PHRASES).lower()})" for i, t in enumerate(of) if not t.tolerance)
    posts = ", ".join(f"('{p.word}', {p.template}, {p.rare}, {p.offset}, {p.weight!r}::DOUBLE)" for p in found if of[p.template].tolerance)
    notices = ", ".join(f"({i}, '{t.label}', {len(t.words)}, {t.need}, {t.tolerance}, [{', '.join(repr(k) for k in t.keys)}])" for i, t in enumerate(of) if t.tolerance)
    return f"""
WITH w AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS ws FROM documents),
p(phrase, label, k, mass, base) AS (VALUES {rows}),
hits AS (
  SELECT rn, label, mass, base, list_filter(range(len(ws) - k + 1), lambda i: array_to_string(ws[i + 1:i + k], ' ') = phrase) AS starts
  FROM (SELECT rn, ws, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM w) JOIN p ON contains(line, ' ' || phrase || ' ')
), posts(word, template, rare, off, weight) AS (VALUES {posts}),
notices(template, label, size, need, tolerance, keys) AS (VALUES {notices}),
votes AS (
  SELECT rn, template, rare, weight, tolerance, pos - off AS start
  FROM (SELECT rn, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w WHERE list_has_any(ws, (SELECT list(word) FROM posts))) JOIN posts USING (word) JOIN notices USING (template)
  WHERE pos - off >= -tolerance
), agreed AS (
  SELECT DISTINCT a.rn, a.template, a.start, b.rare, b.weight FROM votes a JOIN votes b ON a.rn = b.rn AND a.template = b.template AND b.start BETWEEN a.start AND a.start + a.tolerance
), noticed AS (
  SELECT rn, label, mass FROM (SELECT rn, template, start, count(*) AS n, sum(weight) AS mass FROM agreed GROUP BY ALL) JOIN notices USING (template) JOIN w USING (rn)
  WHERE n >= need AND len(list_filter(keys, lambda k: NOT contains(' ' || array_to_string(ws[greatest(start, 0) + 1:greatest(start, 0) + size + tolerance], ' ') || ' ', ' ' || k || ' '))) = 0
), seen AS (
  SELECT rn, label, mass, base, starts FROM hits UNION ALL SELECT rn, label, mass, false, [] FROM noticed
), found AS (
  SELECT rn, CAST(sum(len(starts)) FILTER (WHERE base) AS BIGINT) AS n_base, min(list_min(starts)) FILTER (WHERE base) AS first_word, max(list_max(starts)) FILTER (WHERE base) AS last_word,
         list_sort(list_distinct(list(label) FILTER (WHERE base))) AS base_labels, list_sort(list_distinct(list(label))) AS labels, round(1 - exp(-max(mass)), 6) AS score
  FROM seen GROUP BY rn
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
       coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN found USING (rn)
"""


_MIXING = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, source_size * 3.0::DOUBLE AS cap FROM s
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - (sum(cap) OVER r - cap)) / (sum(w) OVER () - (sum(w) OVER r - w)) AS level
  FROM ranked WINDOW r AS (ORDER BY cap / w, source NULLS LAST)
), goals AS (
  SELECT source, source_size, least(max(CASE WHEN level * w <= cap THEN level END) OVER () * w, cap) AS target FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS taken_full FROM goals
), run AS (
  SELECT d.doc_id, d.size, d.draw, p.source, p.source_size, p.target, p.taken_full, p.target - p.taken_full * p.source_size AS budget,
         sum(d.size) OVER (PARTITION BY p.source ORDER BY d.draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY p.source, d.draw) AS own
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), edge AS (
  SELECT source, min(draw) AS edge_draw FROM run WHERE upto > budget GROUP BY source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (taken_full + CASE WHEN budget > 0 AND (edge_draw IS NULL OR draw < edge_draw) THEN 1
                                      WHEN draw = edge_draw AND upto - budget < budget - (upto - own) THEN 1
                                      WHEN budget <= 0 AND edge_draw IS NOT NULL AND draw < edge_draw THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run LEFT JOIN edge ON run.source IS NOT DISTINCT FROM edge.source
"""

_DECONTAMINATE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM d)
), s AS (
  SELECT DISTINCT item_id, array_to_string(ws[k:k + 4], ' ') AS shingle FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM i)
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM ds JOIN s USING (shingle) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING 5 * count(*) >= 4 * n_shingles
UNION ALL
SELECT doc_id, item_id, 1, 1, 1.0::DOUBLE FROM d JOIN i ON len(i.ws) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(d.ws, ' ') || ' ', ' ' || array_to_string(i.ws, ' ') || ' ')
"""

_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), w AS (
  SELECT lang, unnest(ws) AS w1 FROM pieces
), f1 AS (
  SELECT lang, w1, count(*) AS f FROM w GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang
), f2 AS (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM pieces) GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM pieces) GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 p JOIN f1 x USING (lang, w1) JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = p.lang AND t.w1 = p.w1 AND t.w2 = p.w2 AND 100 * t.f >= 50 * p.f)
    AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = p.lang AND t.w2 = p.w1 AND t.w3 = p.w2 AND 100 * t.f >= 50 * p.f)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3
), scored AS (
  SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

_FILTER_AUDIT = r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), m AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)
), seen AS (
  SELECT part, filter_order, step, x, n, good, toxic, fails, contains(fails, x) AS fails_x, translate(fails, before, '') <> fails AS gone FROM m, steps
), counted AS (
  SELECT part, filter_order, step, x,
         CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_x), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE fails_x AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE fails_x AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails = x), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE fails_x AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE fails_x AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted
"""

SQL = {"op5_licenses": _licenses(), "op8_mixing": _MIXING, "op9_decontaminate": _DECONTAMINATE, "op12_collocations": _COLLOCATIONS, "op13_filter_audit": _FILTER_AUDIT}

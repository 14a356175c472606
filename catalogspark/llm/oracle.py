"""SQL counterparts (DuckDB) of the queries that SQL can express."""

_GAPS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, {_LOWER.format(f"trim(line, {_GAPS})")} AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id < r.last_doc AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(
    string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), shingled AS (
  SELECT doc_id, CASE
    WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
    END AS shingles
  FROM split
), sizes AS (
  SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM shingled
), single AS (
  SELECT doc_id, unnest(shingles) AS shingle FROM shingled
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM single a JOIN single b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id
  WHERE 100 * n >= 75 * (x.n_shingles + y.n_shingles - n)
), reached AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, s.n_shingles, min(r.other) AS component_id
FROM sizes s JOIN reached r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.n_shingles
"""

# The shipped factor finds all neighbours in small tables, so the counterpart is exact search.
NEAREST = """
WITH doubled AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), sized AS (
  SELECT vec_id, v, list_reduce(list_transform(v, lambda x: x * x), lambda x, y: x + y) AS len2 FROM doubled
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda x, y: x + y)
      / (sqrt(q.len2) * sqrt(c.len2)) AS score
  FROM sized q JOIN sized c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

DIVERGENCE = f"""
WITH filled AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    {_LOWER.format("coalesce(text, '')")} AS text FROM documents
), each AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM filled
), vocabulary AS (
  SELECT lang, term, count(*) AS n FROM each GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM filled
), counted AS (
  SELECT e.lang, e.source, e.term, count(*) AS n FROM each e JOIN vocabulary USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, w.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + l.v) AS p,
    1 + (1000000000::HUGEINT * (w.n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN vocabulary w ON w.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = w.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), valued AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM valued
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def _places(phrase: str, label: str) -> str:
    same = " AND ".join(f"words[i + {k}] IS NOT DISTINCT FROM '{w}'" for k, w in enumerate(phrase.split()))
    return f"list_transform(list_filter(range(1, len(words) + 1), lambda i: {same}), lambda i: {{'label': '{label}', 'at': i - 1}})"


_PLACES = " || ".join([
    _places("gnu general public license", "gpl"), _places("apache license", "apache"),
    _places("cc by", "cc-by"), _places("mit license", "mit"),
])

# Every block of every text against every notice.
LICENSE_SCAN = f"""
WITH texts(label, text) AS (VALUES
  ('agpl', 'gnu affero general public license'),
  ('all-rights-reserved', 'all rights reserved'),
  ('apache', 'licensed under the apache license version 2 0'),
  ('apache', 'you may not use this file except in compliance with the license you may obtain a copy of the license at'),
  ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  ('cc-by', 'this work is licensed under a creative commons attribution 4 0 international license'),
  ('cc-by-nc', 'licensed under cc by nc 4 0'),
  ('cc-by-sa', 'licensed under cc by sa 4 0'),
  ('cc0', 'to the extent possible under law the author has waived all copyright and related or neighboring rights to this work'),
  ('gpl', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation'),
  ('lgpl', 'gnu lesser general public license'),
  ('mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files'),
  ('mpl', 'this source code form is subject to the terms of the mozilla public license')
), notices AS (
  SELECT label, greatest(4, CAST(pow(2, ceil(log2(len(string_split(text, ' '))))) AS BIGINT)) AS width,
    list_distinct(string_split(text, ' ')) AS tokens FROM texts
), split AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), based AS (
  SELECT *, {_PLACES} AS places FROM split
), blocks AS (
  SELECT id, width, list_distinct(words[i * width + 1:i * width + 2 * width]) AS inside FROM (
    SELECT id, width, words, unnest(range(0, CAST(ceil(len(words) / width) AS BIGINT))) AS i
    FROM split, (SELECT DISTINCT width FROM notices))
), met AS (
  SELECT id, label, len(list_intersect(n.tokens, b.inside)) AS shared, len(n.tokens) AS size
  FROM blocks b JOIN notices n ON b.width = n.width
), found AS (
  SELECT id, list(DISTINCT label) AS labels, max(shared / size) AS best FROM met WHERE 100 * shared >= 90 * size GROUP BY id
), joined AS (
  SELECT b.*, list_transform(places, lambda p: p.label) AS base, coalesce(f.labels, []) AS more, f.best
  FROM based b LEFT JOIN found f ON b.id = f.id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(places, lambda p: p.at)) AS BIGINT) AS first_word,
  CAST(list_max(list_transform(places, lambda p: p.at)) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || more)), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM joined
"""

ORACLE = {
    "op6_near_duplicates": NEAR_DUPLICATES,
    "op7_nearest_vectors": NEAREST,
    "op9_line_dedup": LINE_DEDUP,
    "op11_source_divergence": DIVERGENCE,
    "op12_license_scan": LICENSE_SCAN,
}

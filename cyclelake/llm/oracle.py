"""DuckDB SQL for the operators that SQL can express: brute-force forms over the whole tables."""

from __future__ import annotations

from .quality import COST, CUTOFFS, ERROR, RISK

_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = r"'[^\x20\x09-\x0D]+'"

#: Components of ``links`` (a, b in both directions) over the ids of ``nodes``.
_COMPONENTS = """
, reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
, least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
, good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0)
, links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE CASE WHEN len(x.e) = len(y.e) THEN list_cosine_similarity(x.e, y.e) END >= 0.98)""" + _COMPONENTS + """
, counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
FROM v LEFT JOIN counts ON vec_id = counts.a LEFT JOIN least ON vec_id = least.a"""

DOCUMENTS = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS[0]}', '{_LETTERS[1]}'),
  {_WORD}) AS w FROM documents)
, t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d)
, five AS (SELECT doc_id, x || ' ' || {" || ' ' || ".join(f"lead(x, {k}) OVER p" for k in range(1, 5))} AS x FROM t
  WINDOW p AS (PARTITION BY doc_id ORDER BY i))
, distinct_items AS (SELECT DISTINCT doc_id, x FROM five WHERE x IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)
, items AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM distinct_items)
, sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id)
, links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM items p JOIN items q ON p.x = q.x AND p.doc_id <> q.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (min(p.n) + min(q.n) - count(*)))""" + _COMPONENTS + """
SELECT doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least.b, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(least.b, doc_id)) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON doc_id = least.a"""

_SHARES = {"symbols": "n_symbols / nullif(word_chars, 0)", "capitals": "n_capitals / nullif(word_chars, 0)",
           "dup_lines": "n_dup_lines / nullif(n_lines, 0)", "repeats": "n_repeat_words / nullif(n_words, 0)"}
_PLACES = {rule: " + ".join(f"CAST(s_{rule} <= {cut} AS INTEGER)" for cut in CUTOFFS) for rule in _SHARES}
_TESTS = "\nUNION ALL ".join(
    f"SELECT stratum, '{rule}' AS rule, p_{rule} AS place, scale, count(*) FILTER (WHERE NOT good) AS bad, "
    f"count(*) FILTER (WHERE good IS NULL) AS unknown FROM passing WHERE p_{rule} < {len(CUTOFFS)} GROUP BY ALL" for rule in _SHARES)
_PLANNED = ", ".join(f"(SELECT {x} FROM useful u WHERE rule = '{rule}' AND u.stratum IS NOT DISTINCT FROM p.stratum) AS {x}_{rule}"
                     for rule in _SHARES for x in ("first", "last"))
_STEP = ", ".join(f"CASE WHEN p_{rule} <= last_{rule} THEN first_{rule} + p_{rule} END" for rule in _SHARES)

QUALITY = f"""
WITH d AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w
  FROM documents)
, t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d)
, windows AS (SELECT doc_id, i, x || ' ' || lead(x) OVER p || ' ' || lead(x, 2) OVER p AS y FROM t
  WINDOW p AS (PARTITION BY doc_id ORDER BY i))
, marked AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, y) AS times FROM windows WHERE y IS NOT NULL)
, covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM marked, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id)
, lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
, full_lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM lines
  WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id)
, counts AS (SELECT d.doc_id, stratum, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, coalesce(f.dup, 0) AS n_dup_lines,
  coalesce(f.n, 0) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN full_lines f USING (doc_id) LEFT JOIN covered c USING (doc_id))
, scored AS (SELECT *, {", ".join(f"coalesce({e}, 0) AS s_{r}" for r, e in _SHARES.items())} FROM counts)
, placed AS (SELECT *, {", ".join(f"{e} AS p_{r}" for r, e in _PLACES.items())},
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM scored LEFT JOIN (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
  WHERE doc_id IS NOT NULL)
, sizes AS (SELECT stratum, count(*) FILTER (WHERE good) AS n, count(good) / nullif(count(*) FILTER (WHERE good IS NULL), 0) AS scale
  FROM placed GROUP BY stratum HAVING count(*) FILTER (WHERE good) > 0)
, passing AS (SELECT m.*, z.n, z.scale, (SELECT count(*) FROM sizes) AS strata FROM placed m JOIN sizes z
  ON m.stratum IS NOT DISTINCT FROM z.stratum WHERE NOT base_failed)
, tests AS ({_TESTS})
, summed AS (SELECT *, sum(bad) OVER p AS caught, sum(unknown) OVER p AS others FROM tests
  WINDOW p AS (PARTITION BY stratum, rule ORDER BY place))
, hopes AS (SELECT stratum, rule, place, caught,
  greatest(0, caught - {COST} * greatest(0, coalesce(others * scale - caught, 0))) AS hope FROM summed WHERE caught > 0)
, best AS (SELECT * FROM hopes QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY hope DESC, caught DESC, place) = 1)
, useful AS (SELECT stratum, rule, place AS last, {len(CUTOFFS)} * (row_number() OVER (PARTITION BY stratum
  ORDER BY hope DESC, caught DESC, place, rule) - 1) AS first FROM best)
, planned AS (SELECT p.*, {_PLANNED} FROM passing p)
, steps AS (SELECT stratum, n, strata, least({_STEP}) AS step, count(*) FILTER (WHERE good) AS good,
  count(*) FILTER (WHERE NOT good) AS bad FROM planned GROUP BY ALL HAVING step IS NOT NULL)
, so_far AS (SELECT stratum, n, strata, step, CAST(sum(good) OVER p AS BIGINT) AS lost, sum(bad) OVER p AS caught FROM steps
  WINDOW p AS (PARTITION BY stratum ORDER BY step))
, tried AS (SELECT *, lost < (n + 1) * {RISK} AND list_sum(list_transform(range(0, lost + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) <= {ERROR} / strata
    AS passed FROM so_far)
, certified AS (SELECT *, bool_and(passed) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM tried)
, taken AS (SELECT stratum, step FROM certified WHERE ok AND caught - {COST} * lost > 0
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY caught - {COST} * lost DESC, step) = 1)
, limits AS (SELECT u.stratum, rule, [{", ".join(map(str, CUTOFFS))}][least(step - first, last) + 1] AS cutoff
  FROM useful u JOIN taken t ON u.stratum IS NOT DISTINCT FROM t.stratum WHERE step >= first)
, judged AS (SELECT s.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  {" OR ".join(f"coalesce(s_{r} > (SELECT cutoff FROM limits l WHERE rule = '{r}' AND l.stratum IS NOT DISTINCT FROM s.stratum), false)"
               for r in _SHARES)} AS cut FROM scored s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT cut AS kept FROM judged"""

_TRIMMED = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '%s', '%s')" % _LETTERS

LINES = f"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
, t AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM d)
, k AS (SELECT *, {_TRIMMED} AS key FROM t)
, often AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
, marked AS (SELECT k.doc_id, i, line, keeper IS NOT NULL AND keeper <> k.doc_id AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

PHRASES = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), '{_LETTERS[0]}', '{_LETTERS[1]}'), '[.,;:!?\n-\r]')) AS piece FROM documents)
, numbered AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces)
, t AS (SELECT lang, p, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM numbered)
, grams AS (SELECT lang, x AS one, x || ' ' || lead(x) OVER o AS two, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS three
  FROM t WINDOW o AS (PARTITION BY p ORDER BY i))
, f AS (SELECT lang, one AS phrase, 1 AS size, count(*) AS n FROM grams GROUP BY lang, one
  UNION ALL SELECT lang, two, 2, count(*) FROM grams WHERE two IS NOT NULL GROUP BY lang, two
  UNION ALL SELECT lang, three, 3, count(*) FROM grams WHERE three IS NOT NULL GROUP BY lang, three)
, totals AS (SELECT lang, count(*) AS n FROM t GROUP BY lang)
, candidates AS (SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10)
, inner_pairs AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM candidates WHERE size = 3)
, over AS (SELECT lang, phrase, max(a) AS most FROM inner_pairs GROUP BY lang, phrase)
, alone AS (SELECT c.* FROM candidates c LEFT JOIN over USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
, cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM alone))
, scored AS (SELECT cuts.lang, cuts.phrase, a, k, h.n AS l, r.n AS r,
  (1000000::HUGEINT * a * a) // (h.n::HUGEINT * r.n) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail)
, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, totals.n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
, scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
  CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e))
, positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
, found AS (SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score
  AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10"""

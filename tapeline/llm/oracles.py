"""The contracts of some operators as SQL of another engine, over the same tables."""

from __future__ import annotations

from . import audit, divergence, lines, rtree, topk

_WORDS = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]"

OP2 = f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({topk.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(nth AS INTEGER) AS rank, CAST(vec_id AS BIGINT) AS vec_id, score FROM k WHERE nth <= {topk.K}"""

OP10 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{lines.UPPER}', '{lines.LOWER}') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {lines.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}),
j AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS gone FROM k LEFT JOIN shared s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id"""


def _quoted(text: str) -> str:
    return "'" + "' || chr(10) || '".join(text.replace("'", "''").split("\n")) + "'"


def _count(chars: str) -> str:
    """How many characters of a text are among ``chars``."""
    return f"(length(t) - length(translate(t, {_quoted(chars)}, '')))"


_CHARS = ", ".join(f"CAST({_count(c)} AS DOUBLE)" for c in divergence.CLASSES)
_SPACE = "(length(t) - length(regexp_replace(t, '" + _BLANK + "', '', 'g')))"


def _distances(kind: str) -> str:
    """Distance of each text's histogram (r, bin, n) in ``kind`` from each language's."""
    term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    return f"""
{kind}_p AS (SELECT r, bin, n / sum(n) OVER (PARTITION BY r) AS p FROM {kind} QUALIFY sum(n) OVER (PARTITION BY r) > 0),
{kind}_q AS (SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM {kind} JOIN d USING (r) WHERE lang IS NOT NULL GROUP BY lang, bin QUALIFY sum(sum(n)) OVER (PARTITION BY lang) > 0),
{kind}_d AS (SELECT r, min(js) AS far FROM (SELECT r, lang, sqrt(greatest(0, sum({term('p', 'q')} + {term('q', 'p')}) / 2)) AS js FROM {kind}_p JOIN {kind}_q USING (bin) GROUP BY r, lang) x GROUP BY r)"""


OP6 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
ws AS (SELECT r, regexp_extract_all(t, '{_WORDS}') AS a FROM d),
w AS (SELECT r, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM ws),
three AS (SELECT r, pos, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY pos)),
twice AS (SELECT r, pos FROM three WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
again AS (SELECT r, count(DISTINCT pos + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) s GROUP BY r),
ll AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ll WHERE regexp_matches(line, '{_WORDS}') GROUP BY r),
n AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
bare AS (SELECT r, rtrim(lower(word), '{divergence.MARKS}') AS word FROM w),
by_lang AS (SELECT lang, word, count(*) AS n FROM bare JOIN d USING (r) WHERE lang IS NOT NULL AND length(word) <= {divergence.LETTERS} GROUP BY lang, word),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS nth, sum(n) OVER (PARTITION BY lang) AS total FROM by_lang),
common AS (SELECT DISTINCT word FROM top WHERE nth <= {divergence.COMMON} AND n * {divergence.RARE} >= total AND word <> ''),
bins AS (SELECT word AS bin FROM common UNION ALL SELECT NULL),
hits AS (SELECT b.r, c.word AS bin, CAST(count(*) AS DOUBLE) AS n FROM bare b LEFT JOIN common c ON c.word = b.word GROUP BY b.r, c.word),
word_hist AS (SELECT g.r, coalesce('=' || g.bin, 'other') AS bin, coalesce(h.n, 0) AS n FROM (SELECT r, bin FROM n, bins) g LEFT JOIN hits h ON h.r = g.r AND h.bin IS NOT DISTINCT FROM g.bin),
cs AS (SELECT r, [{_CHARS}, CAST({_SPACE} AS DOUBLE), CAST(strlen(t) - length(t) AS DOUBLE)] AS h FROM d),
char_hist AS (SELECT r, unnest(h) AS n, generate_subscripts(h, 1) AS bin FROM cs),{_distances("word_hist")},{_distances("char_hist")},
base AS (SELECT d.r, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, {_count(divergence.CLASSES[-1])} AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
  list_sum(cs.h) AS chars, wd.far AS word_far, cd.far AS char_far
  FROM d JOIN cs USING (r) LEFT JOIN n USING (r) LEFT JOIN dl USING (r) LEFT JOIN again USING (r) LEFT JOIN word_hist_d wd USING (r) LEFT JOIN char_hist_d cd USING (r)),
judged AS (SELECT *, n_words < {divergence.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND (chars < {divergence.MIN_CHARS} OR coalesce(char_far, 0) <= {divergence.MAX_CHAR_DISTANCE}) AND coalesce(word_far, 0) <= {divergence.MAX_WORD_DISTANCE} + {divergence.WORD_NOISE} / sqrt(greatest(n_words, 1)) AS kept
FROM judged"""

OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, translate(coalesce(text, ''), '{lines.UPPER}', '{lines.LOWER}') AS t FROM documents),
k AS (SELECT *, row_number() OVER g AS nth, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d WINDOW g AS (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(t) AS text_sha256 FROM k"""

OP12 = f"""WITH e AS (SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
  list_transform(embedding, lambda x: CAST(floor({rtree.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.id AS anchor_id, c.r AS o, c.id, q.label = c.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON q.id % 100 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= {rtree.POSITIVES}),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.o ORDER BY s.score DESC, s.id) AS nth
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND {rtree.LOW} * p.score <= 100 * s.score AND 100 * s.score <= {rtree.HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE nth <= {rtree.NEGATIVES}"""

OP13 = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{lines.UPPER}', '{lines.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS a FROM documents),
w AS (SELECT r, lang, source, unnest(a) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {audit.MIN_DOCS}),
own AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang), t AS (SELECT lang, source, sum(c) AS n FROM own GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, CAST(1 + CAST({audit.UNIT} AS HUGEINT) * (coalesce(o.c, 0) + {audit.PRIOR}) // (coalesce(t.n, 0) + {audit.PRIOR} * v.v) AS BIGINT) AS p,
  CAST(1 + CAST({audit.UNIT} AS HUGEINT) * (k.c + {audit.PRIOR}) // (v.n + {audit.PRIOR} * v.v) AS BIGINT) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
both_parts AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS nth FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(nth AS INTEGER) AS rank FROM k WHERE part = 'pair' OR nth <= {audit.TOP}"""

ORACLE_SQL = {"op2_exact_top_k": OP2, "op6_divergence_rules": OP6, "op10_line_dedup": OP10, "op11_bloom_dedup": OP11, "op12_rtree_negatives": OP12, "op13_source_audit": OP13}

"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH grid(rule, i, cut) AS (
  SELECT 'symbols', i, unnest([3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]::DOUBLE[]) FROM (SELECT 0 AS i)
  UNION ALL SELECT 'repeats', 0, unnest([0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2]::DOUBLE[])
  UNION ALL SELECT 'long_words', 0, unnest([20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0]::DOUBLE[])
  UNION ALL SELECT 'dup_lines', 0, unnest([0.5, 0.4, 0.3, 0.2, 0.1]::DOUBLE[])),
d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS} AS w, row_number() OVER () AS rid FROM documents),
win AS (SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY rid),
m AS (SELECT doc_id, rid, len(w)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(lang, 'other') AS stratum
      FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
      LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (SELECT rid, stratum, doc_id, base_failed, unnest(['symbols', 'repeats', 'long_words', 'dup_lines']) AS rule,
        unnest([n_symbols, n_repeat_words, word_chars, n_dup_lines]) / greatest(n_words, 1)::DOUBLE AS x FROM b),
g AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
t AS (SELECT stratum, v.rule, cut, sum(good::INT) AS n, sum((good AND x >= cut)::INT) AS k, sum((NOT good AND x >= cut)::INT) AS bad
      FROM v JOIN g USING (doc_id) JOIN grid ON v.rule = grid.rule WHERE NOT base_failed GROUP BY ALL),
p AS (SELECT *, CASE WHEN k > n * 0.0125 THEN 1.0 ELSE list_sum(list_transform(range(0, k::BIGINT + 1), lambda j:
        exp((CASE WHEN j = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) END)
            + j * ln(0.0125) + (n - j) * ln(1 - 0.0125)))) END AS tail FROM t),
c AS (SELECT stratum, rule, cut FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - k DESC, cut DESC) AS r
      FROM p WHERE n > 0 AND bad > k AND tail <= 0.05 / ((SELECT count(DISTINCT stratum) FILTER (stratum <> 'other') + 1 FROM t) * 4)) WHERE r = 1),
r AS (SELECT DISTINCT rid FROM v JOIN c USING (stratum, rule) WHERE x >= cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM r) AS kept, stratum FROM b
"""


WORDS6 = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
SHINGLES6 = "list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"

OP6 = f"""
WITH bw AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, {WORDS6} AS w FROM benchmark) WHERE len(w) > 0),
b AS (SELECT item_id, k, {SHINGLES6} AS s FROM bw),
d AS (SELECT doc_id, k, {SHINGLES6} AS s FROM (SELECT doc_id, {WORDS6} AS w FROM documents), (SELECT DISTINCT k FROM b) WHERE len(w) >= k),
bs AS (SELECT item_id, k, len(s) AS item_shingles, unnest(s) AS g FROM b),
ds AS (SELECT doc_id, k, unnest(s) AS g FROM d)
SELECT doc_id, item_id, item_shingles::BIGINT AS item_shingles, count(*)::BIGINT AS shared, count(*) / item_shingles AS containment
FROM ds JOIN bs USING (k, g) GROUP BY doc_id, item_id, item_shingles HAVING 100 * count(*) >= 80 * item_shingles
"""


OP10 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


OP2 = """
WITH c AS (SELECT conv_id AS pair_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT pair_id, 'chosen' AS side, turn, role, replace(text, '<|', '< |') AS text FROM c
      UNION ALL SELECT pair_id, 'rejected', turn, role, replace(text, '<|', '< |') FROM c WHERE turn < pair_id % 5
      UNION ALL SELECT pair_id - 1, 'rejected', turn, role, replace(text, '<|', '< |') FROM c
                WHERE turn >= (pair_id - 1) % 5 AND pair_id - 1 IN (SELECT pair_id FROM c)),
p AS (SELECT pair_id, list(struct_pack(turn, role, text) ORDER BY turn NULLS FIRST, role, text) FILTER (side = 'chosen') AS c,
             list(struct_pack(turn, role, text) ORDER BY turn NULLS FIRST, role, text) FILTER (side = 'rejected') AS r FROM s GROUP BY pair_id),
k AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i:
             c[i].role IS DISTINCT FROM r[i].role OR c[i].text IS DISTINCT FROM r[i].text)) - 1, len(c))::INT AS n FROM p),
t AS (SELECT pair_id, n, side, unnest(list_transform(range(1, len(l) + 1), lambda i: struct_pack(i := i, role := l[i].role,
             text := '<|im_start|>' || l[i].role || chr(10) || l[i].text || '<|im_end|>' || chr(10)))) AS u
      FROM (SELECT pair_id, n, 'prompt' AS side, c[1:n] AS l FROM k UNION ALL SELECT pair_id, n, 'chosen', c[n + 1:] FROM k
            UNION ALL SELECT pair_id, n, 'rejected', r[n + 1:] FROM k)),
o AS (SELECT *, sum(length(u.text)) OVER (PARTITION BY pair_id, side ORDER BY u.i) AS e FROM t),
j AS (SELECT pair_id, side, string_agg(u.text, '' ORDER BY u.i) AS text,
        string_agg((e - length(u.text) + 13 + length(u.role))::BIGINT || '-' || (e - 1)::BIGINT, ',' ORDER BY u.i) FILTER (u.role = 'assistant') AS mask
      FROM o GROUP BY pair_id, side)
SELECT pair_id, n AS n_prompt_turns,
  coalesce((SELECT text FROM j WHERE j.pair_id = k.pair_id AND side = 'prompt'), '') AS prompt,
  coalesce((SELECT text FROM j WHERE j.pair_id = k.pair_id AND side = 'chosen'), '') AS chosen,
  coalesce((SELECT mask FROM j WHERE j.pair_id = k.pair_id AND side = 'chosen'), '') AS chosen_mask,
  coalesce((SELECT text FROM j WHERE j.pair_id = k.pair_id AND side = 'rejected'), '') AS rejected,
  coalesce((SELECT mask FROM j WHERE j.pair_id = k.pair_id AND side = 'rejected'), '') AS rejected_mask
FROM k
"""


OP12 = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.uid AS auid, a.vec_id AS anchor_id, a.label = b.label AS same, b.uid, b.vec_id,
             list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
      FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY auid ORDER BY score DESC, vec_id, uid) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.auid, p.uid ORDER BY s.score DESC, s.vec_id, s.uid)::INT AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.auid = p.auid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM g, (VALUES (1), (2), (3), (4), (5)) AS ks(k) WHERE i + k - 1 <= len(w))
      GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k >= 2 AND f >= 100),
o AS (SELECT lang, phrase, max(a) AS a FROM (
        SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, a FROM c, (VALUES (2), (3), (4)) AS ms(m), (VALUES (1), (2), (3), (4)) AS xs(i)
        WHERE m < k AND i + m - 1 <= k) GROUP BY ALL),
u AS (SELECT lang, phrase, ws, a, unnest(range(1, k)) AS cut FROM c),
x AS (SELECT u.lang, u.phrase, u.a, l.f AS l, r.f AS r, n.n,
             ((1000::HUGEINT * u.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM u JOIN n USING (lang) JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(ws[:cut], ' ')
        JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')
      QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, cut) = 1),
y AS (SELECT x.* FROM x LEFT JOIN o USING (lang, phrase) WHERE o.a IS NULL OR o.a < x.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM y QUALIFY rank <= 2000
"""


def oracles() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op2_chat_pairs": OP2, "op6_decontamination": OP6, "op10_warc_bundles": OP10,
            "op12_hard_negatives": OP12, "op13_collocations": OP13}

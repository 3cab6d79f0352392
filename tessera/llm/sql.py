"""The training-data queries that SQL can express, for DuckDB."""

#: Base counts, then distances to each language: character classes by regular expressions, words by joins with the 100 most frequent.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, lang, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
base AS (SELECT d.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, length(t) AS chars FROM d JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)),
cls AS (
  SELECT doc_id, lang, text, CAST(length(regexp_replace(t, '[^\p{Ll}\p{Lm}\p{Lo}\p{M}]', '', 'g')) AS DOUBLE) AS c0, CAST(length(regexp_replace(t, '[^\p{Lu}\p{Lt}]', '', 'g')) AS DOUBLE) AS c1,
    CAST(length(regexp_replace(t, '[^\p{N}]', '', 'g')) AS DOUBLE) AS c2, CAST(length(regexp_replace(t, '[^\p{Z}\x09-\x0D]', '', 'g')) AS DOUBLE) AS c3,
    CAST(length(regexp_replace(t, '[^.,;:!?''"()\-]', '', 'g')) AS DOUBLE) AS c4, CAST(length(regexp_replace(t, '[^#*$%&|<>@+=_~^`\\/{}\[\]]', '', 'g')) AS DOUBLE) AS c5, CAST(length(t) AS DOUBLE) AS total FROM d),
clh AS (SELECT doc_id, lang, text, unnest([c0, c1, c2, c3, c4, c5, total - c0 - c1 - c2 - c3 - c4 - c5]) AS c, generate_subscripts([0, 0, 0, 0, 0, 0, 0], 1) AS k, total FROM cls),
clq AS (SELECT lang, k, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM clh WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang, k),
xl AS (SELECT *, c / greatest(total, 1) AS p FROM clh),
cld AS (SELECT doc_id, r.lang, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS a FROM xl JOIN clq r USING (k) GROUP BY doc_id, r.lang),
dw AS (SELECT doc_id, lang, text, w, count(*) AS n FROM (SELECT doc_id, lang, text, unnest(ws) AS w FROM d) GROUP BY ALL),
wc AS (SELECT lang, w, sum(n) AS n FROM dw WHERE lang IS NOT NULL GROUP BY ALL),
wt AS (SELECT lang, sum(n) AS total FROM wc GROUP BY lang),
top AS (SELECT lang, w, n / total AS q FROM wc JOIN wt USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= 100),
rest AS (SELECT lang, 1 - sum(q) AS q FROM top GROUP BY lang),
big AS (SELECT doc_id, n_words FROM base WHERE n_words >= 50),
pw AS (SELECT b.doc_id, t.lang, t.q, coalesce(x.n, 0) / n_words AS p FROM big b CROSS JOIN top t LEFT JOIN dw x ON x.doc_id = b.doc_id AND x.w = t.w),
pr AS (SELECT doc_id, lang, 1 - sum(p) AS p FROM pw GROUP BY ALL),
pa AS (SELECT doc_id, lang, p, q FROM pw UNION ALL SELECT doc_id, lang, p, q FROM pr JOIN rest USING (lang)),
wd AS (SELECT doc_id, lang, sqrt(greatest(0, sum((CASE WHEN p > 1e-12 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 1e-12 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS b FROM pa GROUP BY ALL),
near AS (
  SELECT doc_id, lang, CASE WHEN chars >= 200 THEN a END AS a, b, greatest(CASE WHEN chars >= 200 THEN a ELSE 0 END / (0.20 + 1.0 / sqrt(chars)), coalesce(b, 0) / (0.30 + 2.0 / sqrt(greatest(n_words, 1)))) AS over
  FROM cld JOIN base USING (doc_id) LEFT JOIN wd USING (doc_id, lang) WHERE chars > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY over, lang) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(over <= 1, true) AS kept, lang AS nearest, round(a, 6) AS class_distance, round(b, 6) AS word_distance
FROM base LEFT JOIN near USING (doc_id)
"""

#: Every 100-byte window by its hash; removed runs, and the rest concatenated as hex.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(n - 99)) AS s FROM d WHERE n >= 100),
win AS (SELECT p.doc_id, s, md5(b[s + 1:s + 100]) AS h FROM p JOIN d USING (doc_id)),
rep AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
edge AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM rep),
span AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM edge) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM span UNION ALL SELECT d.doc_id, coalesce(max(z), 0), any_value(n) FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[lo + 1:hi]), '' ORDER BY lo) AS x FROM gaps JOIN d USING (doc_id) WHERE hi > lo GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce((SELECT sum(z - a) FROM span s WHERE s.doc_id = d.doc_id), 0) AS BIGINT) AS n_removed, (SELECT count(*) FROM span s WHERE s.doc_id = d.doc_id) AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: All pairs that share a shingle, links among them, components by recursion.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
least_of AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

#: All alignments of equal tokens, and the best window of each document and item.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, ts, len(ts) AS dn FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM documents WHERE text IS NOT NULL)),
i AS (SELECT item_id, ts, len(ts) AS m, least(20, len(ts)) AS w FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM benchmark WHERE text IS NOT NULL) WHERE len(ts) >= 6),
dt AS (SELECT doc_id, dn, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS p FROM d),
it AS (SELECT item_id, m, w, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS q FROM i),
hits AS (SELECT doc_id, item_id, p - q AS diag, q, dn, m, w FROM dt JOIN it USING (t)),
diags AS (SELECT doc_id, item_id, diag, any_value(dn) AS dn, any_value(m) AS m, any_value(w) AS w, list(q) AS qs FROM hits GROUP BY ALL HAVING count(*) >= 0.8 * any_value(w)),
wins AS (SELECT doc_id, item_id, diag, w, qs, unnest(range(greatest(0, -diag), least(m, dn - diag) - w + 1)) AS a FROM diags),
sums AS (SELECT doc_id, item_id, a + diag AS doc_start, a AS item_start, w, len(list_filter(qs, lambda q: q >= a AND q < a + w)) AS k FROM wins),
best AS (SELECT * FROM sums WHERE k >= 0.8 * w QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k DESC, doc_start, item_start) = 1)
SELECT doc_id, item_id, CAST(doc_start AS BIGINT) AS doc_start, CAST(item_start AS BIGINT) AS item_start, CAST(w AS BIGINT) AS n_window, CAST(k AS BIGINT) AS n_equal FROM best
"""

#: Turns as they should be read back, and the size of their escaped form.
OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\c') AS body,
    replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\c'), ':', '\o'), chr(10), '\n') AS head FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 15) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: What each layout's record says, by conversation: all turns, a pair, a triple, or nothing that is known.
LAYOUTS_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations),
firsts AS (SELECT conv_id, coalesce(max(text) FILTER (k = 1), '') AS a, coalesce(max(text) FILTER (k = 2), '') AS b, coalesce(max(text) FILTER (k = 3), '') AS c FROM t GROUP BY conv_id),
said AS (
  SELECT conv_id, k, role, text FROM t WHERE conv_id % 7 IN (0, 1, 2, 5)
  UNION ALL SELECT conv_id, 1, 'user', CASE WHEN conv_id % 7 = 4 AND b <> '' THEN a || chr(10) || chr(10) || b ELSE a END FROM firsts WHERE conv_id % 7 IN (3, 4)
  UNION ALL SELECT conv_id, 2, 'assistant', CASE WHEN conv_id % 7 = 4 THEN c ELSE b END FROM firsts WHERE conv_id % 7 IN (3, 4))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256 FROM said GROUP BY conv_id
UNION ALL SELECT DISTINCT conv_id, NULL, NULL FROM t WHERE conv_id % 7 = 6
"""

#: Scores of anchors with all rows, their first positives, and the first rows of other labels in each window.
OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS place
  FROM s JOIN p USING (anchor_id) WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 10
"""

#: As operator 6 at another level, and which documents stay.
OP12_SQL = "SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM (" + OP6_SQL.replace("90 * (x.n + y.n - k)", "85 * (x.n + y.n - k)") + ")"


def _clustering(rounds: int = 10) -> str:
    """Assignments to the nearest centroid, and floors of means, so many times."""
    nearest = "a{r} AS MATERIALIZED (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.vec_id, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r} c) GROUP BY vec_id)"
    means = """m{r} AS (SELECT k, i, (s - (s % n + n) % n) // n AS x FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{r} JOIN v USING (vec_id)) GROUP BY k, i)),
c{s} AS MATERIALIZED (SELECT c.k, coalesce(any_value(m.x), any_value(c.x)) AS x FROM c{r} c LEFT JOIN (SELECT k, list(CAST(x AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY k) m USING (k) GROUP BY c.k)"""
    steps = ",\n".join(f"{nearest.format(r=r)},\n{means.format(r=r, s=r + 1)}" for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8)),
{steps},
{nearest.format(r=rounds)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (k)
"""


OP13_SQL = _clustering()

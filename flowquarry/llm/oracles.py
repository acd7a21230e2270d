"""SQL twins of the queries that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS2 = "coalesce(regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_WORDS3 = "coalesce(regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+'), [])"

OP2 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS2.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS2.format('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
             FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
h AS (SELECT r, i, k, item_id FROM dw JOIN bw USING (k, s)),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS t
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS3.format('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""

OP5 = """
WITH l0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
l1 AS (SELECT doc_id, unnest(a) AS line, unnest(range(0, len(a))) AS pos, len(a) AS n FROM l0),
f AS (SELECT line, count(DISTINCT doc_id) AS df FROM l1 GROUP BY line HAVING min(doc_id) < max(doc_id)),
l2 AS (SELECT l1.*, coalesce(f.df, 0) AS df, CAST('0x' || substr(md5(l1.line), 1, 15) AS BIGINT) % 1048576 AS x,
              length(l1.line) - length(replace(l1.line, ' ', '')) + 1 AS words
       FROM l1 LEFT JOIN f ON f.line = l1.line),
l3 AS (SELECT *, CASE WHEN lag(df) OVER w = df AND lag(words) OVER w < 50 THEN lag(x) OVER w ELSE 0 END AS px, lead(df) OVER w AS ndf, lead(words) OVER w AS nwords
       FROM l2 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
l4 AS (SELECT *, pos = n - 1 OR df <> ndf OR words >= 50 OR nwords >= 50 OR (px * 31 + x) % 4 = 0 AS stop FROM l3),
l5 AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM l4),
c AS (SELECT doc_id, part, min(pos) AS start, count(*) AS n, sum(words) AS words, list(line ORDER BY pos) AS seq
      FROM l5 GROUP BY doc_id, part HAVING min(df) > 0),
f2 AS (SELECT seq, min(doc_id) AS least FROM c GROUP BY seq HAVING min(doc_id) < max(doc_id)),
again AS (SELECT c.* FROM c JOIN f2 USING (seq) WHERE doc_id > least),
i AS (SELECT *, start - coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY start
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM again),
cut AS (SELECT doc_id, part FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id, island) AS in_all FROM i)
        WHERE n > 1 OR in_all >= 50),
k AS (SELECT l5.doc_id, count(cut.part) AS n_removed, coalesce(string_agg(l5.line, chr(10) ORDER BY pos) FILTER (WHERE cut.part IS NULL), '') AS text
      FROM l5 LEFT JOIN cut ON cut.doc_id = l5.doc_id AND cut.part = l5.part GROUP BY l5.doc_id)
SELECT doc_id, n_removed, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM k"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
           (CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) // CAST(power(32, 3 - i % 4) AS BIGINT)) % 32 AS INT), 1)
           FOR i IN range(0, 32)], '')
           AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM m"""

# The checksum is worked out byte by byte with the table of its reflected polynomial; near words meet under what is left of
# them without a letter.
OP11 = f"""
WITH RECURSIVE k(i, c, s) AS (SELECT i, i, 0 FROM (SELECT unnest(range(0, 256)) AS i) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM k WHERE s < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM k WHERE s = 8),
r AS (SELECT DISTINCT doc_id, run, count(*) OVER (PARTITION BY doc_id, run) AS n FROM (
      SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
b AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
        lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END)) AS bytes FROM r WHERE length(run) > 5),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[xor(a, CAST(x AS BIGINT)) % 256 + 1]), 4294967295), 4294967295) AS h FROM b, t),
w0 AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w0 WHERE length(word) > 5 GROUP BY word HAVING sum(n) > 4),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word, y.word AS near FROM v x JOIN v y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
      UNION SELECT v.word, w.word FROM v JOIN w ON v.rest = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.rest = w.word),
q AS (SELECT p.word, near, w.n FROM p JOIN w ON w.word = p.near),
f AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS near, max(n) AS m FROM q GROUP BY word),
e AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN near END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
      FROM w LEFT JOIN f ON f.word = w.word),
g(word, place) AS (SELECT word, word FROM e UNION ALL SELECT g.word, e.form FROM g JOIN e ON e.word = g.place WHERE e.form IS NOT NULL)
SELECT e.word, e.form, g.place AS root, e.n, e.n_near, e.form_n FROM e JOIN g ON g.word = e.word JOIN e z ON z.word = g.place AND z.form IS NULL"""


def op12(rules) -> str:
    """Matches and the texts between them by rule; their lengths give the positions."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT r, {no} AS k, '{x.name}' AS kind, {x.least} AS least, string_split_regex(text, {quoted(x.pattern)}) AS gap, "
        f"regexp_extract_all(text, {quoted(x.pattern)}) AS hit, regexp_extract_all(text, {quoted(x.pattern)}, {x.group}) AS part FROM d"
        for no, x in enumerate(rules))
    counts = ", ".join(f"CAST(coalesce(n{no}, 0) AS BIGINT) AS n_{x.name}" for no, x in enumerate(rules) if no < 3)
    sums = ", ".join(f"count(*) FILTER (WHERE k = {no}) AS n{no}" for no in range(3))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({each}),
u AS (SELECT r, k, kind, least, unnest(range(1, len(hit) + 1)) AS i, gap, hit, part FROM m WHERE len(hit) > 0),
l AS (SELECT r, k, kind, i, length(hit[i]) AS n, length(part[i]) >= least AS ok, length(gap[i]) + length(hit[i]) AS step FROM u),
s AS (SELECT *, CAST(sum(step) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS stop FROM l),
f AS (SELECT r, k, stop - n AS start, kind || ':' || (stop - n) || ':' || stop AS span FROM s WHERE ok),
g AS (SELECT r, {sums}, string_agg(span, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM f GROUP BY r)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.r = d.r"""


OP13 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM (SELECT * FROM e WHERE vec_id % 100 = 0) a JOIN e b ON a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

"""DuckDB SQL for those queries of this subpackage that SQL can express."""

SPACE = r"[\x20\x09-\x0D]+"

OP1 = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

OP2 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM split),
t AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split_regex(line, '{SPACE}'), lambda x: x <> ''))) AS toks FROM l),
w AS (SELECT * FROM t WHERE len(toks) > 0),
c AS (SELECT row_number() OVER () AS id, toks, len(toks) AS n, min(struct_pack(d := doc_id, l := line_no)) AS first FROM w GROUP BY toks),
e AS (SELECT id, n, unnest(toks) AS tok FROM c),
f AS (SELECT tok, count(*) AS freq FROM e GROUP BY tok),
p AS (SELECT id, n, e.tok, row_number() OVER (PARTITION BY id ORDER BY freq, e.tok) AS place FROM e JOIN f ON e.tok = f.tok),
x AS (SELECT id, n, tok FROM p WHERE place <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.tok = b.tok AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
links AS (SELECT a, b FROM pairs JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE 9 * len(list_intersect(ca.toks, cb.toks)) >= 4 * (ca.n + cb.n)),
ends AS (SELECT a AS id, b AS other FROM links UNION ALL SELECT b, a FROM links),
m AS (SELECT ends.id, count(*) AS n_links, bool_or(o.first < s.first) AS matched FROM ends JOIN c s ON s.id = ends.id JOIN c o ON o.id = ends.other GROUP BY ends.id),
k AS (SELECT c.first.d AS doc_id, sum(coalesce(n_links, 0)) AS n_links, count(*) FILTER (NOT coalesce(matched, false)) AS n_kept,
 string_agg(CAST(c.first.l AS VARCHAR), ',' ORDER BY c.first.l) FILTER (NOT coalesce(matched, false)) AS kept_lines FROM c LEFT JOIN m ON m.id = c.id GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept, coalesce(n_lines, 0) - CAST(coalesce(n_kept, 0) AS BIGINT) AS n_removed,
 CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(kept_lines, '') AS kept_lines
FROM documents d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP10 = """
WITH a AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(regexp_extract(rest, '(?s)^[^/?#]*(.*)$', 1), '^[^?#]*') AS path FROM a),
c AS (SELECT *, '.' || host AS h, host || path AS u, CASE
 WHEN '.' || host LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
 WHEN '.' || host LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
 WHEN '.' || host LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
 WHEN '.' || host LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
 WHEN '.' || host LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE
 WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
 WHEN regexp_matches(u, '(?s)^[^/]*cheap-[^/]*/|^[^/]*free-bets[^/]*/|^[^/]*casino[^/]*/|^[^/]*-pills[^/]*/|^[^/]*xxx[^/]*/') THEN 'block'
 WHEN contains(u, '/login') OR contains(u, '/cart/') THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{TERM}') AS terms FROM documents),
g AS (SELECT count(*) FILTER (len(terms) > 0) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM d),
p AS (SELECT doc_id, any_value(len(terms)) AS n, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, big_n),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all({LOWER}, '{TERM}'))) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
 FROM i JOIN w USING (term) JOIN p USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

#: Bytes as hexadecimal digits, two a byte, so that parts of them can be taken.
OP12 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(len(h) // 2 - 399)) AS pos, h FROM d WHERE len(h) >= 800),
k AS (SELECT doc_id, pos, md5(substr(h, CAST(2 * pos + 1 AS BIGINT), 800)) AS k FROM p),
f AS (SELECT doc_id, pos FROM k QUALIFY count(*) OVER (PARTITION BY k) > 1),
b AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 400 THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b),
s AS (SELECT doc_id, run, min(pos) AS low, max(pos) + 400 AS high, lag(max(pos) + 400, 1, 0) OVER (PARTITION BY doc_id ORDER BY min(pos)) AS before FROM r GROUP BY doc_id, run),
c AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last, list(struct_pack(x := before, y := low) ORDER BY low) AS gaps FROM s GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(concat(list_aggregate(list_transform(coalesce(gaps, []), lambda g: substr(h, CAST(2 * g.x + 1 AS BIGINT), CAST(2 * (g.y - g.x) AS BIGINT))), 'string_agg', ''), substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT))))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

OP13 = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS words FROM t),
m AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
 [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * len(regexp_extract_all(x, '[A-Z]')) > 5 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY x), false)] AS fails
 FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS seq FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT list_aggregate(list_transform(seq, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') AS filter_order, step, seq[step] AS own, seq[:step - 1] AS before FROM o, (SELECT i AS step FROM f)),
e AS (SELECT part, good, toxic, n, filter_order, step, own, fails[own] AS out, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda y: y)) = 1 AS one FROM c, s),
a AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT out THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND out THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN gone AND out THEN n ELSE 0 END) AS redundant, sum(CASE WHEN out AND one THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN NOT gone AND out AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND out AND toxic THEN n ELSE 0 END) AS toxic_lost FROM e GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""

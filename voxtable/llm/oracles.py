"""What the text queries return, said in SQL."""

from __future__ import annotations

from voxtable.llm.quality_rules import BORROWED, LEAST_STEPS, METRICS, TWENTIETHS
from voxtable.llm.secret_scan import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _item_words(column: str) -> str:
    return rf"list_filter(string_split_regex(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_item_words("text")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_item_words("text")} AS w FROM benchmark),
bi AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM bi),
di AS (SELECT rid, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(w) >= s.n),
hits AS (SELECT rid, di.i, di.n, item FROM di JOIN bw ON di.n = bw.n AND array_to_string(list_slice(di.w, di.i, di.i + di.n - 1), ' ') = bw.win),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
"""


def _rule(kind: str, regex: str, least: int, group: int, rank: int) -> str:
    text = "'" + regex.replace("'", "''") + "'"
    return f"""SELECT rid, '{kind}' AS kind, {rank} AS rank, {least} AS least, unnest(regexp_extract_all(text, {text})) AS m, unnest(regexp_extract_all(text, {text}, {group})) AS g,
 unnest(list_slice(string_split_regex(text, {text}), 1, len(regexp_extract_all(text, {text})))) AS gap, generate_subscripts(regexp_extract_all(text, {text}), 1) AS k FROM d"""


OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_rule(r.kind, r.regex, r.least, r.group, k) for k, r in enumerate(RULES))}),
placed AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY k) AS BIGINT) AS e FROM m),
s AS (SELECT rid, kind, rank, e - length(m) AS b, e, kind || ':' || CAST(e - length(m) AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS told FROM placed WHERE length(g) >= least),
t AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(told, ',' ORDER BY b, rank) FILTER (rank < 3) AS base, string_agg(told, ',' ORDER BY b, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (rid)
"""


def _metric(name: str) -> str:
    above, below, units, *_ = METRICS[name]
    value = f"CAST(floor({units} * {above} / greatest({below}, 1)) AS BIGINT)"
    step = f"pow(2, greatest(length(bin({value})) - 6, 0))"
    return f"CAST(floor({value} / {step}) * {step} AS BIGINT)"


def _level(depth: int, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    quantiles = ", ".join(f"min(value) FILTER (up_to * 20 >= rows * {k}) AS q{k}" for k in TWENTIETHS)
    return f"""l{depth} AS (SELECT {by}metric, max(rows) AS rows, {quantiles} FROM
 (SELECT {by}metric, value, CAST(sum(n) OVER (PARTITION BY {by}metric ORDER BY value) AS BIGINT) AS up_to, CAST(sum(n) OVER (PARTITION BY {by}metric) AS BIGINT) AS rows FROM
 (SELECT {by}metric, value, count(*) AS n FROM e GROUP BY {by}metric, value)) GROUP BY {by}metric)"""


def _quantile(k: int) -> str:
    wide = f"((l1.rows * l1.q{k} + {BORROWED} * l2.q{k}) / (l1.rows + {BORROWED}))"
    return f"(l0.rows * l0.q{k} + {BORROWED} * {wide}) / (l0.rows + {BORROWED})"


def _by_metric(k: int) -> str:
    return f"CASE m.metric {' '.join(f"WHEN '{m}' THEN {v[k]}" for m, v in METRICS.items())} END"


OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 2), ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS x FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM p) WHERE c > 1) GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
 coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
m AS ({" UNION ALL ".join(f"SELECT rid, lang, source, base_failed, {k} AS rank, '{m}' AS metric, {_metric(m)} AS value FROM f" for k, m in enumerate(METRICS))}),
e AS (SELECT * FROM m WHERE NOT base_failed),
{_level(0, "lang, source")}, {_level(1, "lang")}, {_level(2, "")},
q AS (SELECT m.rid, m.rank, m.metric, m.value, {_quantile(TWENTIETHS[0])} AS low, {_quantile(TWENTIETHS[1])} AS middle, {_quantile(TWENTIETHS[2])} AS high,
 {_by_metric(3)} AS reach, {_by_metric(4)} AS least, {_by_metric(5)} AS most, m.metric = 'word_length' AS two
 FROM m JOIN l0 ON m.metric = l0.metric AND m.lang IS NOT DISTINCT FROM l0.lang AND m.source IS NOT DISTINCT FROM l0.source
 LEFT JOIN l1 ON m.metric = l1.metric AND m.lang IS NOT DISTINCT FROM l1.lang LEFT JOIN l2 ON m.metric = l2.metric),
v AS (SELECT *, greatest(reach * least(middle - low, high - middle), {LEAST_STEPS} * middle / 32) AS width FROM q),
x AS (SELECT rid, list(metric ORDER BY rank) AS failed FROM v WHERE value > least(greatest(middle + width, least), most) OR (two AND value < middle - width) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, coalesce(array_to_string(failed, ','), '') AS failed, NOT base_failed AND failed IS NULL AS kept
FROM f LEFT JOIN x USING (rid)
"""


OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT *, row_number() OVER (ORDER BY copy_of, k) AS id FROM (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, min(doc_id) AS copy_of, count(*) AS copies FROM d GROUP BY 1)),
s AS (SELECT DISTINCT id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.g = b.g AND a.id < b.id JOIN z x ON x.id = a.id JOIN z y ON y.id = b.id GROUP BY a.id, b.id, x.n, y.n HAVING count(*) * 180 >= 80 * (x.n + y.n)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT id AS node, id AS lab FROM t UNION SELECT e.b, c.lab FROM c JOIN e ON e.a = c.node WHERE c.lab < e.b),
r AS (SELECT node, min(lab) AS lab FROM c GROUP BY node),
m AS (SELECT lab, min(copy_of) AS class_id FROM r JOIN t ON t.id = r.node GROUP BY lab),
l AS (SELECT e.a AS id, sum(t.copies) AS links FROM e JOIN t ON t.id = e.b GROUP BY e.a)
SELECT d.doc_id, t.copy_of, m.class_id, CAST(CASE WHEN len(t.w) > 0 THEN coalesce(l.links, 0) + t.copies - 1 ELSE 0 END AS BIGINT) AS n_links
FROM d JOIN t ON array_to_string(d.w, ' ') = t.k JOIN r ON r.node = t.id JOIN m ON m.lab = r.lab LEFT JOIN l ON l.id = t.id
"""


#: The CRC-32 of bytes: eight shifts by the reversed polynomial for each byte.
_SHIFT = "list_reduce(list_prepend({0}, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))"
_BYTES = "list_transform(range(1, CAST(length(hex(encode(t))) / 2 AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(encode(t)), 2 * i - 1, 2) AS BIGINT))"

OP11 = rf"""
WITH RECURSIVE table_ AS (SELECT list({_SHIFT.format("b")} ORDER BY b) AS crc FROM range(256) r(b)),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
o AS (SELECT w, i || ':' || w AS t, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) AS h FROM o, table_),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS w, n FROM h)
 WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
x AS (SELECT w, n, k, substr(w, 1, k - 1) || substr(w, k + 1) AS less FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS k FROM v)),
p AS (SELECT a.w AS a, b.w AS b, b.n FROM x a JOIN x b ON a.k = b.k AND a.less = b.less AND a.w <> b.w
 UNION SELECT x.w, v.w, v.n FROM x JOIN v ON x.less = v.w UNION SELECT v.w, x.w, x.n FROM x JOIN v ON x.less = v.w),
f AS (SELECT v.w, v.n, count(p.b) AS n_near, first(p.b ORDER BY p.n DESC, encode(p.b)) AS b, max(p.n) AS b_n FROM v LEFT JOIN p ON p.a = v.w GROUP BY v.w, v.n),
g AS (SELECT w AS word, n, n_near, CASE WHEN b_n >= 10 * n THEN b END AS form, CASE WHEN b_n >= 10 * n THEN b_n END AS form_n FROM f),
l AS (SELECT word, word AS at_, form AS next_ FROM g UNION ALL SELECT l.word, g.word, g.form FROM l JOIN g ON g.word = l.next_)
SELECT g.word, g.form, l.at_ AS root, g.n, g.n_near, g.form_n FROM g JOIN l ON l.word = g.word AND l.next_ IS NULL
"""

OP12 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
 sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def _assigned(number: int) -> str:
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    return f"""a{number} AS MATERIALIZED (SELECT id, x, struct_extract(near, 'd') AS d, struct_extract(near, 'c') AS c FROM
 (SELECT v.id, v.x, min({{'d': CAST({distance} AS BIGINT), 'c': c.c}}) AS near FROM v CROSS JOIN c{number} c GROUP BY v.id, v.x))"""


def _moved(number: int) -> str:
    return f"""c{number + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{number} c LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS x FROM
 (SELECT c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{number}, range(1, 65) r(i) GROUP BY c, i) GROUP BY c) m USING (c))"""


OP13 = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS y FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(y, lambda z: CAST(floor(z * 1024) AS BIGINT)) AS x FROM e WHERE len(list_filter(y, lambda z: z IS NOT NULL AND isfinite(z))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INT) AS c, x FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 8)),
{", ".join(f"{_assigned(k)}, {_moved(k)}" for k in range(10))}, {_assigned(10)}
SELECT vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.x, ',')) AS centroid_sha256
FROM a10 a JOIN v USING (id) JOIN c10 z ON z.c = a.c
"""

"""DuckDB SQL of the subpackage's queries, where SQL can express them."""

from logvigil.llm.url_filter import ALPHA, MANY_BRANCHES, MANY_SHARE, MIN_PURITY, RULES, Z2

ORACLE: dict[str, str] = {}

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op5_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL),
pat AS (SELECT DISTINCT item, least(10, len(w)) AS m,
               array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
        FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT m FROM pat),
win AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS p
        FROM d, lens, unnest(range(1, len(w) - m + 2)) AS u(i)),
hits AS (SELECT r, i, win.m, item FROM win JOIN pat ON win.p = pat.p AND win.m = pat.m),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + m)) AS u(j) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items,
                 string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""".replace("{low}", _LOWER.format(t="text"))

ORACLE["op1_suffix_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS w
        FROM d, unnest(range(0, len(h) // 2 - 49)) AS u(i) WHERE len(h) >= 100),
low AS (SELECT w, min(doc_id) AS m FROM win GROUP BY w),
hit AS (SELECT r, i FROM win JOIN low USING (w) WHERE m < doc_id),
isle AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new
         FROM hit),
num AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM isle),
span AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM num GROUP BY r, g),
edge AS (SELECT r, a, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS from_ FROM span
         UNION ALL SELECT r, len(h) // 2, coalesce((SELECT max(b) FROM span s WHERE s.r = d.r), 0) FROM d),
kept AS (SELECT r, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS k
         FROM edge JOIN d USING (r) GROUP BY r),
cut AS (SELECT r, count(*) AS n, sum(b - a) AS gone FROM span GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN cut USING (r)
"""

ORACLE["op9_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
                            regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS s
       FROM d, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS u(i) WHERE len(w) > 0),
size AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r
         GROUP BY a.r, b.r),
link AS (SELECT x, y FROM pairs JOIN size p ON p.r = x JOIN size q ON q.r = y
         WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT r, r AS t FROM size UNION SELECT reach.r, edge.y FROM reach JOIN edge ON edge.x = reach.t),
comp AS (SELECT reach.r, min(d.doc_id) AS c FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
       CASE WHEN n IS NULL THEN doc_id ELSE c END AS component_id
FROM d LEFT JOIN size USING (r) LEFT JOIN comp USING (r)
""".replace("{low}", _LOWER.format(t="text"))


def _url_sql() -> str:
    """Level by level as deep as the paths go; the tree's counts are windows over
    the urls that have not ended."""
    fits = [(v, h, p) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    when = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN "
            for _, h, p in fits]
    rule = " ".join(w + f"'{h}{p}'" for w, (_, h, p) in zip(when, fits))
    verdict = " ".join(w + f"'{v}'" for w, (v, _, _) in zip(when, fits))
    low = _LOWER.format(t=r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")
    return f"""
WITH RECURSIVE lab AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
u AS (SELECT row_number() OVER () AS r, page_id, {low} AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
v AS (SELECT u.*, good, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x:
             CASE WHEN regexp_matches(x, '^[0-9]+(\\.[A-Za-z]+)?$') THEN '*' ELSE x END) AS segs
      FROM u LEFT JOIN lab ON doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.[A-Za-z]+)?/?$', 1)
                                               AS BIGINT)),
t AS (
  SELECT r, host, segs, good, 0 AS level, '' AS p, false AS done FROM v
  UNION ALL
  SELECT r, host, segs, good, level + 1, CASE WHEN s = '' THEN p ELSE p || '/' || CASE WHEN s = '*' OR (kids > 1
           AND (alike OR (kids >= {MANY_BRANCHES} AND kids > {MANY_SHARE} * an))) THEN '*' ELSE s END END, s = ''
  FROM (SELECT *, CASE WHEN lab = 0 OR al = lab OR ag = 0 OR ag = al THEN true ELSE
               power(gd::DOUBLE / lab - (ag - gd)::DOUBLE / (al - lab), 2) < {Z2} * ((ag::DOUBLE / al) *
               (1 - ag::DOUBLE / al) * (1::DOUBLE / lab + 1::DOUBLE / (al - lab))) END AS alike
        FROM (SELECT *, count(good) OVER ns AS lab, coalesce(sum(good) OVER ns, 0) AS gd, count(*) OVER np AS an,
                     count(good) OVER np AS al, coalesce(sum(good) OVER np, 0) AS ag, max(rank) OVER np AS kids
              FROM (SELECT *, dense_rank() OVER (PARTITION BY host, p ORDER BY s) AS rank
                    FROM (SELECT *, coalesce(segs[level + 1], '') AS s FROM t WHERE NOT done))
              WINDOW ns AS (PARTITION BY host, p, s), np AS (PARTITION BY host, p)))),
tpl AS (SELECT v.*, t.p AS template FROM t JOIN v USING (r) WHERE done),
pur AS (SELECT host, template, count(good) AS l, coalesce(sum(good), 0) AS g FROM tpl GROUP BY host, template),
pri AS (SELECT coalesce(sum(g)::DOUBLE / nullif(sum(l), 0), 1.0) AS q FROM pur)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN (g + {ALPHA} * q) / (l + {ALPHA}) < {MIN_PURITY} THEN 'block' ELSE 'allow' END
       AS verdict, template
FROM tpl JOIN pur USING (host, template), pri
"""


ORACLE["op6_url_filter"] = _url_sql()

# crc32 of the decimal key, bit by bit: a byte is taken in, then eight shifts (-1)
ORACLE["op11_periodic_runs"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT *, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
             string_split(CAST(doc_id AS VARCHAR), ''),
             lambda c: list_prepend(ascii(c)::BIGINT, list_transform(range(8), lambda i: -1::BIGINT))))),
             lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END),
             4294967295) AS crc FROM d),
p AS (SELECT *, CASE WHEN crc % 10 = 0 AND n > 0 THEN (crc // 10) % n END AS a,
             3 + (crc // 10) % 8 AS parts FROM h),
v AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n),
             lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) END AS w
      FROM p),
t AS (SELECT r, i, w[i + 1] AS word FROM v, unnest(range(n)) AS u(i)),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND x.i < y.i),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM same),
cand AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM isle GROUP BY r, q, g
         HAVING count(*) >= greatest(12 - q, q)),
runs AS (SELECT * FROM cand c WHERE NOT EXISTS (
         SELECT 1 FROM cand o WHERE o.r = c.r AND o.q < c.q AND c.q % o.q = 0 AND o.s <= c.s
                                    AND o.s + o.len >= c.s + c.len)),
agg AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS all_,
               first({'s': s, 'len': len, 'q': q} ORDER BY len DESC, s, q) AS b FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, j AS i FROM runs, unnest(range(s + q, s + len)) AS u(j)),
kept AS (SELECT t.r, string_agg(word, ' ' ORDER BY t.i) AS txt FROM t ANTI JOIN gone USING (r, i) GROUP BY t.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
       CAST(b.s AS BIGINT) AS "start", CAST(b.len AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
       CAST(1000 * b.len // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(all_, '')) AS runs_sha256,
       sha256(coalesce(txt, '')) AS collapsed_sha256
FROM v LEFT JOIN agg USING (r) LEFT JOIN kept USING (r)
"""

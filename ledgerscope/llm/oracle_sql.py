"""DuckDB SQL of the queries of this subpackage that SQL can express."""

URL_FILTER = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail
  FROM u),
p AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(regexp_extract(tail, '^[^?#]*'), '') AS path,
         coalesce(regexp_extract(tail, '^[^?#]*\?([^#]*)', 1), '') AS q
  FROM h),
k AS (
  SELECT page_id, host, path,
         list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT
                   regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=.*)?$'))) AS params
  FROM p),
c AS (
  SELECT page_id, host, path,
         CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '')
           || regexp_replace(path, '/+$', '')
           || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical
  FROM k),
listed AS (SELECT DISTINCT canonical FROM c WHERE list_contains(string_split(host, '.'), 'spam-farm')),
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (
  SELECT d.host, d.path, arg_max(r.rh || r.rp, length(r.rh) + length(r.rp)) AS rule,
         arg_max(r.verdict, length(r.rh) + length(r.rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM c) d JOIN rules r
    ON (d.host = r.rh OR ends_with(d.host, '.' || r.rh)) AND starts_with(d.path, r.rp)
  GROUP BY d.host, d.path)
SELECT c.page_id, c.host, c.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit ON c.host = fit.host AND c.path = fit.path
       LEFT JOIN listed l ON c.canonical = l.canonical
"""

#: (rule, cutoffs from lenient to strict): the ladders of the quality rules.
_LADDERS = """
  ('symbol_ratio', [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1]::DOUBLE[]),
  ('dup_line_ratio', [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]::DOUBLE[]),
  ('repeat_ratio', [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]::DOUBLE[]),
  ('long_words', [30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0]::DOUBLE[]),
  ('short_words', [-1.5, -2.0, -2.5, -3.0]::DOUBLE[])"""


def quality_sql(source: str = "documents") -> str:
    """Base counts, calibrated cutoffs and verdicts of ``source`` (a table like documents)."""
    return r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM """ + source + r"""),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
u AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n
      FROM (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM u)),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat
      FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n >= 2) GROUP BY rid),
m AS (SELECT d.doc_id, CASE WHEN d.lang IN ('de', 'en', 'es', 'fr') THEN d.lang ELSE 'other' END AS stratum,
        len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        n_symbols::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        row_number() OVER () AS row_no, greatest(n_words, 1)::DOUBLE AS nw FROM m),
v AS (SELECT row_no, doc_id, stratum, base_failed, unnest([
        {'rule': 'symbol_ratio', 'x': n_symbols / nw},
        {'rule': 'dup_line_ratio', 'x': n_dup_lines / greatest(n_lines, 1)::DOUBLE},
        {'rule': 'repeat_ratio', 'x': n_repeat_words / nw},
        {'rule': 'long_words', 'x': word_chars / nw},
        {'rule': 'short_words', 'x': -word_chars / nw}], recursive := true) FROM b),
ladder AS (SELECT rule, unnest(cuts) AS cutoff, unnest(range(len(cuts))) AS step
           FROM (VALUES """ + _LADDERS + r""") t(rule, cuts)),
good AS (SELECT doc_id, max(quality) >= 1 AS good FROM labels
         WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
cnt AS (SELECT v.stratum, v.rule, l.step, l.cutoff, count(*) FILTER (good) AS n,
          count(*) FILTER (good AND x > cutoff) AS k, count(*) FILTER (NOT good AND x > cutoff) AS bad
        FROM v JOIN good USING (doc_id) JOIN ladder l ON l.rule = v.rule
        WHERE NOT base_failed GROUP BY ALL),
pv AS (SELECT *, CASE WHEN k > n * 0.01 THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i:
          exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) END AS p
       FROM cnt),
ok AS (SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY step) <= 0.05 / 25 AS certified FROM pv),
chosen AS (SELECT stratum, rule, cutoff FROM ok WHERE certified AND bad - 4 * k > 0
           QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - 4 * k DESC, step) = 1),
broken AS (SELECT DISTINCT row_no FROM v JOIN chosen USING (stratum, rule) WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND broken.row_no IS NULL) AS kept
FROM b LEFT JOIN broken ON b.row_no = broken.row_no
"""


QUALITY = quality_sql()

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN l.last IS NULL OR p.page_id = l.last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN l.last IS NOT NULL AND p.page_id <> l.last THEN l.last END AS refers_to
FROM p LEFT JOIN l ON p.payload_digest = l.payload_digest AND p.payload_bytes >= 1000
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                   (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
f AS (SELECT *, '<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')
                || '<|im_end|>' || chr(10) AS piece FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, piece)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, piece) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

MERKLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)) AS nxt FROM d),
e AS (SELECT doc_id, text, nxt, length(text)::BIGINT AS n, substring(text, 1, length(text) - length(text) // 4)
             || substring(nxt, 1, length(text) // 4) AS edited FROM o),
t AS (SELECT doc_id, 0 AS v, text AS x FROM e UNION ALL SELECT doc_id, 1, edited FROM e UNION ALL SELECT doc_id, 2, nxt FROM e),
f AS (SELECT doc_id, v,
        list_transform(regexp_extract_all(x, '[^\n.!?]{1,96}[.!?\n\s]*|[.!?\n\s]+'), lambda p: sha256(p)[1:12]) AS ps,
        sha256(array_to_string(list_transform(regexp_split_to_array(x, '\n[ \t]*\n\s*'), lambda s:
          sha256(array_to_string(list_transform(string_split(s, chr(10)), lambda p: sha256(p)), ''))), '')
          || sha256(regexp_replace(x, '[^\s]+', '.', 'g'))) AS root FROM t),
g AS (SELECT doc_id, v, list_distinct(ps) AS s, root || ':' || array_to_string(ps, '') AS fp FROM f)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint,
  b.fp AS edited_fingerprint,
  CASE WHEN a.fp = b.fp THEN 1.0::DOUBLE WHEN len(a.s) + len(b.s) = 0 THEN 0.0::DOUBLE
       ELSE 2.0::DOUBLE * len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s)) END AS near_edited,
  CASE WHEN a.fp = c.fp THEN 1.0::DOUBLE WHEN len(a.s) + len(c.s) = 0 THEN 0.0::DOUBLE
       ELSE 2.0::DOUBLE * len(list_intersect(a.s, c.s)) / (len(a.s) + len(c.s)) END AS near_next
FROM e JOIN g a ON a.doc_id = e.doc_id AND a.v = 0 JOIN g b ON b.doc_id = e.doc_id AND b.v = 1
       JOIN g c ON c.doc_id = e.doc_id AND c.v = 2
"""

MIXING = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, source, src, text, count(*) AS copies, (length(text) + 1) * count(*) AS size
      FROM d GROUP BY doc_id, source, src, text),
r AS (SELECT *, sum(size) OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, text) - size AS begin_at FROM u),
tot AS (SELECT src, sum(size)::BIGINT AS total FROM u GROUP BY src),
per AS (SELECT greatest(1000, 4 * count(*))::BIGINT AS cycle, count(*) AS n_src FROM tot),
sh AS (SELECT src, round(pow(total::DOUBLE, 0.9) / sum(pow(total::DOUBLE, 0.9)) OVER () * (cycle - n_src), 6) AS share,
              cycle - n_src AS spare FROM tot, per),
quo AS (SELECT src, row_number() OVER (ORDER BY src) AS idx,
          (1 + floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, src)
             <= spare - sum(floor(share)) OVER () THEN 1 ELSE 0 END)::BIGINT AS q FROM sh),
qs AS (SELECT list(q ORDER BY idx) AS q, cycle, n_src FROM quo, per GROUP BY cycle, n_src),
edf(t, served, pick) AS (
  SELECT 0::BIGINT, list_transform(q, lambda x: 0::BIGINT), 0::BIGINT FROM qs
  UNION ALL
  SELECT t + 1, list_transform(served, lambda n, i: CASE WHEN i = c % 1000000 THEN n + 1 ELSE n END), c % 1000000
  FROM (SELECT t, served, list_min(list_filter(list_transform(range(1, n_src + 1), lambda i:
           CASE WHEN served[i] * cycle // q[i] <= t
             THEN ((served[i] + 1) * cycle + q[i] - 1) // q[i] * 1000000 + i END), lambda x: x IS NOT NULL)) AS c
        FROM edf, qs WHERE t < cycle)),
plan AS (SELECT src, q, row_number() OVER (PARTITION BY src ORDER BY t) AS j, t - 1 AS slot
         FROM edf JOIN quo ON quo.idx = edf.pick),
s AS (SELECT tot.src, q, ceil(total / 8192.0)::BIGINT AS nb FROM tot JOIN quo USING (src)),
fin AS (SELECT max((nb - 1) // s.q * cycle + slot) AS last
        FROM s JOIN plan ON plan.src = s.src AND plan.j = (nb - 1) % s.q + 1, per),
pl AS (SELECT r.*, s.q, nb, (begin_at // 8192)::BIGINT AS k FROM r JOIN s USING (src)),
e AS (SELECT *, unnest(range(1, 5)) AS epoch FROM pl),
b AS (SELECT *, k + (epoch - 1) * nb AS b FROM e),
o AS (SELECT b.*, b.b // b.q * cycle AS base, b.b % b.q + 1 AS j, cycle FROM b, per)
SELECT doc_id, source, unnest(range(1, copies + 1))::BIGINT AS copy, epoch::BIGINT AS epoch, o.b + 1 AS block,
       (base + (o.j - 1) * cycle // o.q)::BIGINT AS release,
       (base + (o.j * cycle + o.q - 1) // o.q)::BIGINT AS deadline, (base + plan.slot)::BIGINT AS slot
FROM o JOIN plan ON plan.src = o.src AND plan.j = o.j, fin
WHERE base + plan.slot <= last
"""

SUBSTRINGS = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
windows AS (SELECT doc_id, i, w, count(*) OVER f AS n, string_agg(w, ' ') OVER f AS t FROM words
    WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
counted AS (SELECT doc_id, i, w, n = 35 AND count(*) OVER (PARTITION BY n, t) > 1 AS again FROM windows),
covered AS (SELECT doc_id, i, w, bool_or(again) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM counted),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS t
    FROM covered GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256 FROM docs d LEFT JOIN kept USING (doc_id)
"""

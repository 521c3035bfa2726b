"""SQL for those training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

WARC = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), d AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1 + 5 * g, 5) AS BIGINT) >> (15 - 5 * k)) & 31 AS BIGINT) + 1, 1), '' ORDER BY g, k) FROM range(8) a(g), range(4) b(k)) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"

CONTAMINATION = f"""WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[s : s + 9], ' ') AS k FROM iw, range(1, 100000) t(s) WHERE len(w) > 0 AND s <= greatest(1, len(w) - 9)),
dw AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
grams AS (SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM dw, (SELECT DISTINCT m FROM windows))),
found AS (SELECT doc_id, s, g.m, item FROM grams g JOIN windows x ON g.k = x.k AND g.m = x.m),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS place FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS x FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)"""

PASSAGES = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT place) AS x FROM (SELECT doc_id, unnest(range(s, s + 20)) AS place FROM later) GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d), out AS (SELECT doc_id, unnest(x) AS place FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS t FROM each ANTI JOIN out USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(x), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)"""

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '{TERM}') AS w FROM documents),
each AS (SELECT lang, source, row, unnest(w) AS term FROM d), terms AS (SELECT lang, term, count(*) AS total FROM each GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
seen AS (SELECT lang, source, term, count(*) AS c FROM each JOIN terms USING (lang, term) GROUP BY ALL), groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM terms GROUP BY lang), n AS (SELECT lang, source, sum(c) AS n FROM seen GROUP BY ALL),
p AS (SELECT g.lang, g.source, terms.term, coalesce(c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 2) // (coalesce(n.n, 0) + 2 * v.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (total + 2) // (v.n + 2 * v.v) AS whole
  FROM groups g JOIN terms USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN seen ON seen.lang = g.lang AND seen.source = g.source AND seen.term = terms.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - whole) * (p - whole) // (p + whole) AS value FROM p WHERE c > 0 AND p > whole)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pair UNION ALL FROM term) QUALIFY part = 'pair' OR rank <= 10"""

ORACLES = {
    "op1_seekable_warc": WARC,
    "op4_prefix_filter_decontamination": CONTAMINATION,
    "op8_substring_dedup": PASSAGES,
    "op9_bbit_minhash": NEAR,
    "op11_source_divergence": DIVERGENCE,
}

"""The same queries in SQL for another engine, to hold results against."""

from __future__ import annotations

PAGES = "pages AS (SELECT source AS book, printf('image%05d.jpg', doc_id) AS fname, CAST(regexp_extract(printf('image%05d', doc_id), '(\\d+)\\D*$', 1) AS BIGINT) AS page_no, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes FROM documents)"
PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_no) AS ord, count(*) OVER (PARTITION BY book) AS n FROM pages)"
IMAGES = "images AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS page, l_partkey AS obj, l_linestatus = 'F' AS bilevel, l_returnflag <> 'R' AS decoded, CAST(l_quantity AS BIGINT) * 1000 AS raw, CAST(CAST(l_quantity AS BIGINT) * 1000 * (100 - CAST(round(l_discount * 100) AS BIGINT)) // 100 AS BIGINT) AS made FROM lineitem)"
ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, obj ORDER BY page, raw, made, bilevel, decoded) AS k FROM images) WHERE k = 1)"
RASTERS = "rasters AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + CAST(0.6 AS DOUBLE)) * CAST(200.0 AS DOUBLE)))) AS INT)) AS gray FROM embeddings)"
PIXELS = "pixels AS (SELECT vec_id, i, gray[3 * i % 64 + 1] AS r, gray[(3 * i + 1) % 64 + 1] AS g, gray[(3 * i + 2) % 64 + 1] AS b FROM rasters, range(22) t(i))"
HUES = """chan AS (SELECT vec_id, r, g, b, CAST(r AS DOUBLE) / 255.0::DOUBLE AS x, CAST(g AS DOUBLE) / 255.0::DOUBLE AS y, CAST(b AS DOUBLE) / 255.0::DOUBLE AS z FROM pixels),
ext AS (SELECT *, greatest(x, y, z) AS hi, least(x, y, z) AS lo FROM chan),
hls AS (SELECT *, (hi + lo) / 2.0::DOUBLE AS light,
  CASE WHEN hi = lo THEN 0.0::DOUBLE WHEN (hi + lo) / 2.0::DOUBLE <= 0.5::DOUBLE THEN (hi - lo) / (hi + lo) ELSE (hi - lo) / (2.0::DOUBLE - hi - lo) END AS sat,
  CASE WHEN hi = lo THEN 0.0::DOUBLE
       WHEN x = hi THEN (((hi - z) / (hi - lo)) - ((hi - y) / (hi - lo))) / 6.0::DOUBLE
       WHEN y = hi THEN (2.0::DOUBLE + ((hi - x) / (hi - lo)) - ((hi - z) / (hi - lo))) / 6.0::DOUBLE
       ELSE (4.0::DOUBLE + ((hi - y) / (hi - lo)) - ((hi - x) / (hi - lo))) / 6.0::DOUBLE END AS turn FROM ext),
hist AS (SELECT vec_id, CAST(floor((turn - floor(turn)) * 36) AS INT) % 36 AS bin, count(*) AS n, count(*) FILTER (WHERE light < 0.55::DOUBLE) AS core_n,
  CAST(sum(CASE WHEN light < 0.55::DOUBLE THEN r ELSE 0 END) AS BIGINT) AS sum_r, CAST(sum(CASE WHEN light < 0.55::DOUBLE THEN g ELSE 0 END) AS BIGINT) AS sum_g,
  CAST(sum(CASE WHEN light < 0.55::DOUBLE THEN b ELSE 0 END) AS BIGINT) AS sum_b FROM hls WHERE sat >= 0.15::DOUBLE GROUP BY 1, 2)"""
LINES = """lines AS (SELECT user_id AS job, event_id AS seq, CASE event_type
  WHEN 'view' THEN printf('@@P binarize %d 20', event_id % 20 + 1) WHEN 'click' THEN printf('@@P jbig2 %d 8', event_id % 8 + 1) WHEN 'signup' THEN '@@S jbig2'
  WHEN 'purchase' THEN printf('@@DONE %d %d /out/book %d.pdf', event_id * 100, event_id % 9 + 1, event_id) ELSE printf('note %d', event_id) END AS line FROM events)"""
CHUNKS = "greatest(1, least(8, n // 16))"

ORACLES: dict[str, str] = {
    "book_manifest": f"""WITH {PAGES}, kept AS (SELECT *, row_number() OVER w AS ord, count(*) OVER (PARTITION BY book) AS m FROM pages WINDOW w AS (PARTITION BY book ORDER BY page_no)),
marked AS (SELECT *, ord = 1 OR ord = m AS is_cover FROM kept), content AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_no) AS c, count(*) OVER (PARTITION BY book) AS n FROM marked WHERE NOT is_cover),
cut AS (SELECT book, page_no, bytes, (c - 1) // CAST(ceil(n / {CHUNKS}) AS BIGINT) AS chunk FROM content UNION ALL SELECT book, page_no, bytes, -1 FROM marked WHERE is_cover)
SELECT book, CAST(chunk AS BIGINT) AS chunk, count(*) AS pages, min(page_no) AS first_page, max(page_no) AS last_page, CAST(sum(bytes) AS BIGINT) AS bytes FROM cut GROUP BY 1, 2""",
    "numbering_mode": """WITH names AS (SELECT DISTINCT conv_id AS doc, role || '_' || CAST(CASE WHEN conv_id % 2 = 0 THEN turn // 2 ELSE turn END AS VARCHAR) || '.jpg' AS name FROM conversations),
found AS (SELECT *, TRY_CAST(nullif(regexp_extract(regexp_replace(name, '\\.[^.]*$', ''), '(\\d+)\\D*$', 1), '') AS BIGINT) AS k FROM names),
kinds AS (SELECT doc, count(k) = count(*) AND count(DISTINCT k) = count(*) AS numbered FROM found GROUP BY doc)
SELECT doc, name, numbered, CASE WHEN numbered THEN k ELSE row_number() OVER (PARTITION BY doc ORDER BY name) END AS page_no FROM found JOIN kinds USING (doc)""",
    "page_filter": f"""WITH {PAGES} SELECT book, page_no, bytes FROM pages WHERE page_no >= 3 AND page_no IN (SELECT doc_id FROM labels) AND page_no NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "parse_ranges": """WITH specs AS (SELECT DISTINCT unnest([printf('%d,7,%d-%d', r_regionkey, r_regionkey + 2, r_regionkey + 5), printf(' %d , ,4', r_regionkey), printf('10-%d', r_regionkey), printf('-%d,%d', r_regionkey + 1, r_regionkey), '']) AS spec FROM region),
pieces AS (SELECT spec, trim(unnest(string_split(spec, ','))) AS p FROM specs), ends AS (SELECT spec, CAST(regexp_extract(p, '^(-?\\d+)', 1) AS BIGINT) AS a, CASE WHEN regexp_matches(p, '^-?\\d+\\s*-') THEN CAST(regexp_extract(p, '-\\s*(-?\\d+)$', 1) AS BIGINT) ELSE CAST(regexp_extract(p, '^(-?\\d+)', 1) AS BIGINT) END AS b FROM pieces WHERE p <> ''),
numbers AS (SELECT DISTINCT spec, unnest(range(a, b + 1)) AS k FROM ends) SELECT spec, coalesce((SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM numbers WHERE numbers.spec = specs.spec), '') AS numbers FROM specs""",
    "cover_split": f"""WITH {PAGES}, kept AS (SELECT * FROM pages), marked AS (SELECT *, page_no = min(page_no) OVER (PARTITION BY book) OR page_no = max(page_no) OVER (PARTITION BY book) OR page_no % 100 = 50 AS is_cover FROM kept)
SELECT book, is_cover, count(*) AS pages, CAST(sum(bytes) AS BIGINT) AS bytes FROM marked GROUP BY 1, 2""",
    "chunk_plan": f"""WITH {PAGES}, {PLACED}, shaped AS (SELECT *, CAST({CHUNKS} AS BIGINT) AS k, CAST(ceil(n / {CHUNKS}) AS BIGINT) AS per FROM placed)
SELECT book, CAST((ord - 1) // per AS BIGINT) AS chunk, k, per, count(*) AS pages, min(ord) AS first_ord, max(ord) AS last_ord FROM shaped GROUP BY ALL""",
    "shuffled_chunks": f"""WITH {PAGES}, placed AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY CAST('0x' || md5(fname)[1:13] AS BIGINT), page_no) AS ord, count(*) OVER (PARTITION BY book) AS n FROM pages)
SELECT book, page_no, ord, n, CAST((ord - 1) // CAST(ceil(n / {CHUNKS}) AS BIGINT) AS BIGINT) AS chunk FROM placed""",
    "ordered_interleave": f"""WITH {PAGES}, {PLACED}, marked AS (SELECT *, ord = 1 OR ord = n AS is_cover FROM placed)
SELECT book, page_no, ord, CASE WHEN is_cover THEN 'cover' ELSE 'content' END AS doc, CASE WHEN is_cover THEN page_no ELSE CAST(sum(CASE WHEN is_cover THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY page_no) - 1 AS BIGINT) END AS idx FROM marked""",
    "missing_pages": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "state_merge": "SELECT doc_id, CAST(coalesce(l.quality + 10, n_chars % 2) AS INT) AS value FROM documents d FULL JOIN labels l USING (doc_id)",
    "replace_if_smaller": f"""WITH {IMAGES}, kept AS (SELECT *, CASE WHEN bilevel AND decoded AND made < raw THEN made ELSE raw END AS kept FROM images)
SELECT doc, CAST(sum(raw) AS BIGINT) AS before, CAST(sum(kept) AS BIGINT) AS after, count(*) FILTER (WHERE kept < raw) AS replaced FROM kept GROUP BY doc""",
    "layer_align": f"""WITH {RASTERS}, cells AS (SELECT vec_id, i // 16 AS slot, gray[i + 1] AS g FROM rasters, range(64) t(i)), ink AS (SELECT vec_id, slot, CAST(sum(g) AS BIGINT) AS ink FROM cells GROUP BY 1, 2)
SELECT vec_id, {", ".join(f"max(ink) FILTER (WHERE slot = {i}) AS ink_{i}, 'M{i}' AS name_{i}, '{c}' AS colour_{i}" for i, c in enumerate(("black", "red", "green", "black")))} FROM ink GROUP BY vec_id""",
    "probe_grid": f"""WITH {PAGES}, {PLACED}, sample AS (SELECT * FROM placed WHERE (ord - 1) % greatest(1, n // 8) = 0 AND (ord - 1) < greatest(1, n // 8) * 8),
cells AS (SELECT w AS width, q AS quality FROM (VALUES (1200), (1800), (2400)) a(w), (VALUES (45), (60)) b(q)), made AS (SELECT book, any_value(n) AS n, width, quality, count(*) AS sampled, CAST(sum(bytes * width * quality // 240000) AS BIGINT) AS made FROM sample, cells GROUP BY book, width, quality)
SELECT book, width, quality, sampled, made // sampled AS per_page, made * n // sampled AS whole_book FROM made""",
    "image_dedup": f"WITH {IMAGES}, {ONCE} SELECT doc, obj, page, raw, made FROM once",
    "single_image_pages": f"WITH {IMAGES} SELECT doc, page, obj, raw FROM (SELECT *, count(*) OVER (PARTITION BY doc, page) AS k FROM images) WHERE k = 1 AND page IN (1, 3)",
    "pdf_health": f"""WITH {IMAGES}, {ONCE}, first AS (SELECT doc, sum(made) / sum(raw) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, obj) AS r FROM once WHERE bilevel AND decoded) WHERE r <= 3 GROUP BY doc),
held AS (SELECT doc, count(*) FILTER (WHERE bilevel) AS n_bilevel, count(*) FILTER (WHERE NOT bilevel) AS n_colour, CAST(sum(CASE WHEN bilevel THEN raw ELSE 0 END) AS BIGINT) AS bilevel_bytes, CAST(sum(CASE WHEN bilevel THEN 0 ELSE raw END) AS BIGINT) AS colour_bytes, CAST(sum(raw) AS BIGINT) AS size FROM once GROUP BY doc),
e AS (SELECT *, CASE WHEN ratio IS NOT NULL THEN size - bilevel_bytes * (1 - ratio) ELSE size END AS est FROM held LEFT JOIN first USING (doc))
SELECT doc, n_bilevel, n_colour, bilevel_bytes, colour_bytes, size, CASE WHEN n_bilevel > 0 AND n_colour = 0 THEN '黑白' WHEN n_colour > 0 AND n_bilevel = 0 THEN '彩色/灰度' WHEN n_bilevel > 0 THEN '混合' ELSE '无图像' END AS kind, round(CAST(est AS DOUBLE), 4) AS estimate, CASE WHEN n_bilevel > 0 AND size > 0 AND est < size THEN round(1 - est / size, 8) END AS saving FROM e""",
    "health_report": f"""WITH {IMAGES}, t AS (SELECT doc % 40 AS shelf, CAST(sum(raw) AS BIGINT) AS now, CAST(sum(CASE WHEN bilevel AND decoded AND made < raw THEN made ELSE raw END) AS BIGINT) AS after FROM images GROUP BY ROLLUP (doc % 40))
SELECT shelf, now, after, CASE WHEN now > 0 THEN round((1 - after / now) * 100, 4) END AS saved_pct, {", ".join(f"CASE WHEN {c} >= 1048576 THEN printf('%.1f MB', {c} / 1048576.0::DOUBLE) ELSE printf('%.0f KB', {c} / 1024.0::DOUBLE) END AS {c}_text" for c in ("now", "after"))} FROM t""",
    "sampled_ratio": f"""WITH {IMAGES}, first AS (SELECT doc, sum(made) / sum(raw) AS ratio, count(*) AS sampled FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, obj, raw, made) AS r FROM images WHERE bilevel AND decoded) WHERE r <= 2 GROUP BY doc)
SELECT doc, round(CAST(ratio AS DOUBLE), 10) AS ratio, coalesce(sampled, 0) AS sampled FROM (SELECT DISTINCT doc FROM images) LEFT JOIN first USING (doc)""",
    "has_text_first30": f"WITH {PAGES}, {PLACED} SELECT book, bool_or(bytes > 9000) AS has_text, count(*) AS looked_at FROM placed WHERE ord <= 30 GROUP BY book",
    "format_histogram": """WITH p AS (SELECT row_number() OVER (ORDER BY page_id) AS ord, count(*) OVER () AS n, upper(left(hex(encode(coalesce(html, ''))), 8)) AS head FROM pages)
SELECT CASE WHEN head LIKE 'FFD8%' THEN 'jpeg' WHEN head = '89504E47' THEN 'png' WHEN head IN ('49492A00', '4D4D002A') THEN 'tiff' WHEN head = '25504446' THEN 'pdf' ELSE lower(head) END AS format, count(*) AS n FROM p WHERE (ord - 1) % greatest(1, n // 12) = 0 GROUP BY 1""",
    "hue_histogram": f"WITH {RASTERS}, {PIXELS}, {HUES} SELECT * FROM hist",
    "top3_hues": f"""WITH RECURSIVE {RASTERS}, {PIXELS}, {HUES},
dense AS (SELECT v.vec_id, {", ".join(f"list(coalesce({c}, 0) ORDER BY v.bin) AS {c}" for c in ("n", "core_n", "sum_r", "sum_g", "sum_b"))} FROM (SELECT vec_id, b.bin FROM (SELECT DISTINCT vec_id FROM hist), range(36) b(bin)) v LEFT JOIN hist h ON h.vec_id = v.vec_id AND h.bin = v.bin GROUP BY v.vec_id),
walk AS (SELECT vec_id, 0 AS step, n AS rest, CAST(list_sum(n) AS BIGINT) AS total, 0 AS taken, CAST(NULL AS BIGINT) AS peak, CAST(NULL AS BIGINT) AS mass, CAST([] AS BIGINT[]) AS bins, false AS hit FROM dense
UNION ALL SELECT vec_id, step + 1, list_transform(range(36), lambda i: CASE WHEN list_contains(now, i) THEN CAST(-1 AS BIGINT) ELSE rest[i + 1] END), total, taken + CASE WHEN m >= total * 0.08::DOUBLE THEN 1 ELSE 0 END, top, m, now, m >= total * 0.08::DOUBLE
FROM (SELECT *, CAST(list_sum(list_transform(now, lambda i: rest[i + 1])) AS BIGINT) AS m FROM (SELECT *, list_filter(list_transform(range(-4, 5), lambda d: (top + d + 36) % 36), lambda i: rest[i + 1] >= 0) AS now FROM (SELECT *, list_max(list_filter(range(36), lambda i: rest[i + 1] = list_max(rest))) AS top FROM walk WHERE taken < 3 AND list_max(rest) > 0)))),
hits AS (SELECT vec_id, CAST(taken - 1 AS INT) AS slot, CAST(peak AS INT) AS peak, mass AS n, bins FROM walk WHERE hit)
SELECT vec_id, slot, peak, hits.n AS n, {", ".join(f"round(list_sum(list_transform(bins, lambda i: d.sum_{c}[i + 1])) / CAST(greatest(1, list_sum(list_transform(bins, lambda i: d.core_n[i + 1]))) AS DOUBLE), 8) AS {c}" for c in "rgb")} FROM hits JOIN dense d USING (vec_id)""",
    "hue_runs": f"""WITH {RASTERS}, {PIXELS}, {HUES}, runs AS (SELECT *, bin - row_number() OVER (PARTITION BY vec_id ORDER BY bin) AS island FROM hist)
SELECT vec_id, min(bin) AS first, max(bin) AS last, CAST(sum(n) AS BIGINT) AS n, round(min(bin) * 100 / 36.0::DOUBLE, 8) AS lo, round((max(bin) + 1) * 100 / 36.0::DOUBLE, 8) AS hi FROM runs GROUP BY vec_id, island""",
    "op_islands": """WITH m AS (SELECT user_id AS page, event_id AS pos, event_type, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER w AS bt, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS et FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, bt IS NOT NULL AND (et IS NULL OR bt > et) AS inside, event_type IN ('click', 'view') AS shows FROM m)
SELECT page, count(*) FILTER (WHERE inside) AS inside_ops, count(*) FILTER (WHERE inside AND shows) AS shown, bool_or(inside AND shows) AS has_text, CAST(coalesce(sum(CASE WHEN inside THEN pos END), 0) AS BIGINT) AS pos_sum FROM s GROUP BY page""",
    "reading_order": """WITH b AS (SELECT vec_id, vec_id // 10 AS page, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), g AS (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY page ORDER BY y DESC, vec_id) - y > 0.02::DOUBLE THEN 1 ELSE 0 END AS gap FROM b),
r AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY page ORDER BY y DESC, vec_id) AS BIGINT) AS band FROM g) SELECT page, vec_id, band, row_number() OVER (PARTITION BY page ORDER BY band, x, vec_id) AS ord FROM r""",
    "sidecar_text": "SELECT conv_id AS doc, count(*) AS n_pages, md5(string_agg(coalesce(text, ''), chr(12) || chr(10) ORDER BY turn) || chr(10)) AS digest FROM conversations GROUP BY conv_id",
    "merge_offsets": "SELECT conv_id AS doc, turn AS page, CAST(coalesce(length(text), 0) AS BIGINT) AS pages, CAST(coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations",
    "bilevel_threshold": f"""WITH {RASTERS}, lev AS (SELECT vec_id, list_transform(gray, lambda g: CAST(least(255, greatest(0, floor((g - CAST({0.15 * 255.0!r} AS DOUBLE)) * 255.0::DOUBLE / CAST({(0.88 - 0.15) * 255.0!r} AS DOUBLE) + 0.5::DOUBLE))) AS INT)) AS g FROM rasters),
m AS (SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN i % 8 < 1 OR i % 8 >= 7 OR i // 8 < 1 OR i // 8 >= 7 THEN 255 WHEN g[i + 1] > CAST({0.55 * 255.0!r} AS DOUBLE) THEN 255 ELSE 0 END) AS mask FROM lev)
SELECT vec_id, CAST(len(list_filter(mask, lambda x: x = 0)) AS INT) AS black, array_to_string(mask, ',') AS mask FROM m""",
    "mask_algebra": f"""WITH {RASTERS}, c AS (SELECT vec_id, i + 1 AS k, gray[i + 1] AS a, gray[64 - i] AS b FROM rasters, range(64) t(i))
SELECT vec_id, CAST(sum(k * greatest(a, b)) AS BIGINT) AS lighten, CAST(sum(k * least(a, b)) AS BIGINT) AS darken, CAST(sum(k * ((a * b + 127) // 255)) AS BIGINT) AS multiply, CAST(sum(k * greatest(a - b, 0)) AS BIGINT) AS minus, CAST(sum(k * (255 - a)) AS BIGINT) AS negate, CAST(sum(k * CAST(floor(floor(a / 127.5::DOUBLE + 0.5::DOUBLE) * 127.5::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS posterize FROM c GROUP BY vec_id""",
    "box_downsample": f"""WITH {RASTERS}, h AS (SELECT vec_id, label, list_transform(range(16), lambda i: (gray[(i // 4) * 16 + (i % 4) * 2 + 1] + gray[(i // 4) * 16 + (i % 4) * 2 + 2] + gray[(i // 4) * 16 + (i % 4) * 2 + 9] + gray[(i // 4) * 16 + (i % 4) * 2 + 10]) // 4) AS half FROM rasters)
SELECT vec_id, array_to_string(half, ',') AS half, CAST(round_even((label + 8) * 4 / 8.0::DOUBLE, 0) AS BIGINT) AS height FROM h""",
    "morph_open": f"""WITH {RASTERS}, cells AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, gray[i + 1] AS g FROM rasters, range(64) t(i)), moves AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) m(dy, dx)),
low AS (SELECT c.vec_id, c.y, c.x, min(d.g) AS g FROM cells c, moves m, cells d WHERE d.vec_id = c.vec_id AND d.y = c.y + m.dy AND d.x = c.x + m.dx GROUP BY ALL), high AS (SELECT c.vec_id, c.y, c.x, max(d.g) AS g FROM low c, moves m, low d WHERE d.vec_id = c.vec_id AND d.y = c.y + m.dy AND d.x = c.x + m.dx GROUP BY ALL)
SELECT vec_id, string_agg(CAST(g AS VARCHAR), ',' ORDER BY y, x) AS opened FROM high GROUP BY vec_id""",
    "pixel_equality": f"WITH {RASTERS}, m AS (SELECT vec_id, md5(array_to_string(list_transform(gray, lambda g: CASE WHEN g > 128 THEN '1' ELSE '0' END), '')) AS digest FROM rasters) SELECT digest, count(*) AS n, min(vec_id) AS first FROM m GROUP BY digest",
    "a4_fit": """WITH p AS (SELECT p_partkey, p_size * 20.0::DOUBLE AS w, p_retailprice AS h FROM part), s AS (SELECT *, least(595.28::DOUBLE / w, 841.89::DOUBLE / h) AS s FROM p), o AS (SELECT *, (595.28::DOUBLE - w * s) / 2 AS x0, (841.89::DOUBLE - h * s) / 2 AS y0 FROM s)
SELECT p_partkey, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x0 + w * s, 6) AS x1, round(y0 + h * s, 6) AS y1, abs(w - 595.28::DOUBLE) < 1.5::DOUBLE AND abs(h - 841.89::DOUBLE) < 1.5::DOUBLE AS already, round(w / 8.27::DOUBLE, 6) AS dpi FROM o""",
    "text_geometry": """WITH b AS (SELECT conv_id AS doc, turn AS page, CAST(length(text) AS DOUBLE) AS n, greatest(1.0::DOUBLE, (turn + 1) / 40.0::DOUBLE * 841.89::DOUBLE) AS size FROM conversations WHERE length(text) > 0)
SELECT doc, page, round(size, 6) AS size, round(least(1000.0::DOUBLE, greatest(1.0::DOUBLE, 100.0::DOUBLE * 0.5::DOUBLE * 595.28::DOUBLE / (n * size))), 6) AS stretch FROM b""",
    "language_fallback": """WITH t AS (SELECT d.doc_id, ord, tl, quality, CASE WHEN lang = tl THEN 90 ELSE 40 + coalesce(quality, 0) END AS conf FROM documents d LEFT JOIN labels USING (doc_id), (VALUES (0, 'de'), (1, 'en'), (2, 'fr')) x(ord, tl)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, ord) AS k FROM t)
SELECT doc_id, max(CASE WHEN k = 1 THEN tl END) AS lang, max(CASE WHEN k = 1 THEN conf END) AS conf, round(coalesce(avg(CASE WHEN quality IS NOT NULL THEN conf END), 0), 6) AS mean FROM r GROUP BY doc_id""",
    "job_latest": f"""WITH {LINES}, d AS (SELECT *, CASE WHEN line LIKE '@@P %' THEN 'P' WHEN line LIKE '@@S %' THEN 'S' WHEN line LIKE '@@DONE %' THEN 'DONE' ELSE 'LOG' END AS kind, string_split(line, ' ') AS f FROM lines),
p AS (SELECT *, CASE WHEN kind IN ('P', 'S') THEN f[2] ELSE '' END AS stage, CASE WHEN kind = 'P' AND f[2] = 'jbig2' THEN 0.74::DOUBLE + 0.19::DOUBLE * (CAST(f[3] AS DOUBLE) / CAST(f[4] AS DOUBLE)) WHEN kind = 'P' THEN CAST(f[3] AS DOUBLE) / CAST(f[4] AS DOUBLE) * 0.72::DOUBLE WHEN kind = 'S' THEN 0.74::DOUBLE WHEN kind = 'DONE' THEN 1.0::DOUBLE END AS progress FROM d),
last AS (SELECT job, seq, progress, kind, stage FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS k FROM p WHERE progress IS NOT NULL) WHERE k = 1)
SELECT job, lines, finished, seq, round(progress, 9) AS progress, kind, coalesce(stage, '') AS stage FROM (SELECT job, count(*) AS lines, count(*) FILTER (WHERE kind = 'DONE') AS finished FROM p GROUP BY job) LEFT JOIN last USING (job)""",
    "job_admission": """WITH q AS (SELECT user_id AS job, min(event_id) AS asked FROM events GROUP BY user_id), going AS (SELECT count(*) AS n FROM q WHERE job % 6 = 0 AND job < 60), r AS (SELECT *, row_number() OVER (ORDER BY asked) AS k FROM q WHERE job % 3 <> 0)
SELECT job, asked, 'waiting' AS state FROM r WHERE k <= 22 - (SELECT n FROM going)""",
    "queue_counts": """WITH q AS (SELECT DISTINCT user_id AS job FROM events), s AS (SELECT job % 7 AS shelf, job % 5 = 0 AS done, job % 3 = 0 AS going FROM q)
SELECT shelf, count(*) FILTER (WHERE NOT done AND NOT going) AS waiting, count(*) FILTER (WHERE NOT done AND going) AS running, count(*) FILTER (WHERE NOT done) AS active FROM s GROUP BY shelf""",
    "line_framing": f"""WITH {LINES}, n AS (SELECT job, line, row_number() OVER (PARTITION BY job ORDER BY seq) AS line_no, count(*) OVER (PARTITION BY job) AS k FROM lines)
SELECT job, 0::BIGINT AS line_no, '' AS line, true AS whole FROM n WHERE line_no = 1 UNION ALL SELECT job, line_no, line, line_no < k AS whole FROM n""",
    "log_tail": f"""WITH RECURSIVE {LINES}, n AS (SELECT job, line, row_number() OVER (PARTITION BY job ORDER BY seq) AS k FROM lines),
w AS (SELECT job, 1::BIGINT AS k, right(line || chr(10), 30000) AS log FROM n WHERE k = 1 UNION ALL SELECT w.job, n.k, CASE WHEN length(w.log) + length(n.line) + 1 > 40000 THEN right(w.log || n.line || chr(10), 30000) ELSE w.log || n.line || chr(10) END FROM w JOIN n ON n.job = w.job AND n.k = w.k + 1)
SELECT job, arg_max(log, k) AS log FROM w GROUP BY job""",
    "affine_fold": """WITH RECURSIVE o AS (SELECT user_id AS page, event_id AS pos, CASE event_type WHEN 'signup' THEN 'q' WHEN 'error' THEN 'Q' WHEN 'click' THEN 'cm' WHEN 'purchase' THEN 'cm' ELSE CASE WHEN event_id % 5 <> 0 THEN 're' ELSE 'Do' END END AS op,
  [CAST(event_id % 7 % 2 + 1 AS DOUBLE), event_id % 7 % 3, 0, 1, event_id % 7, -(event_id % 7)] AS m FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS k FROM o),
w AS (SELECT page, 0::BIGINT AS k, [1.0::DOUBLE, 0, 0, 1, 0, 0] AS now, CAST([] AS DOUBLE[][]) AS saved, false AS hit FROM (SELECT DISTINCT page FROM n)
UNION ALL SELECT w.page, n.k, CASE WHEN op = 'Q' AND len(saved) > 0 THEN saved[len(saved)] WHEN op = 'cm' THEN [m[1] * now[1] + m[2] * now[3], m[1] * now[2] + m[2] * now[4], m[3] * now[1] + m[4] * now[3], m[3] * now[2] + m[4] * now[4], m[5] * now[1] + m[6] * now[3] + now[5], m[5] * now[2] + m[6] * now[4] + now[6]] ELSE now END,
  CASE WHEN op = 'q' THEN list_append(saved, now) WHEN op = 'Q' AND len(saved) > 0 THEN saved[1:len(saved) - 1] ELSE saved END, op = 'Do' FROM w JOIN n ON n.page = w.page AND n.k = w.k + 1 WHERE NOT w.hit)
SELECT page, now[1] AS m0, now[2] AS m1, now[3] AS m2, now[4] AS m3, now[5] AS m4, now[6] AS m5 FROM w WHERE hit""",
    "active_dedup": f"WITH {LINES}, a AS (SELECT seq, CAST(job AS VARCHAR) || ' ' || left(line, 6) AS args FROM lines) SELECT DISTINCT args FROM a WHERE args NOT IN (SELECT args FROM a WHERE seq % 10 = 0)",
    "progress_milestones": f"WITH {PAGES}, {PLACED} SELECT book, page_no, ord, n FROM placed WHERE ord % greatest(1, n // 20) = 0 OR ord = n",
    "free_name": f"WITH {PAGES}, used AS (SELECT DISTINCT book, page_no // 20 + 2 AS n FROM pages WHERE (page_no // 20 + 2) % 5 <> 4), tries AS (SELECT DISTINCT book, k FROM used, range(2, 12) t(k)) SELECT book, min(k) AS free FROM tries WHERE (book, k) NOT IN (SELECT (book, n) FROM used) GROUP BY book",
    "format_scalars": """WITH p AS (SELECT *, CAST(p_retailprice * 1000 AS BIGINT) * p_size + p_partkey AS size, p_partkey * 37 % 9000 AS sec FROM part)
SELECT p_partkey, CASE WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576.0::DOUBLE) ELSE printf('%.0f KB', size / 1024.0::DOUBLE) END AS human,
CASE WHEN sec < 60 THEN printf('%ds', sec) WHEN sec < 3600 AND sec % 60 = 0 THEN printf('%dm', sec // 60) WHEN sec < 3600 THEN printf('%dm %ds', sec // 60, sec % 60) ELSE printf('%dh %dm', sec // 3600, sec % 3600 // 60) END AS took,
left(trim(replace(p_name, ' ', '') || 'v2'), 120) AS safe, p_name || '_slim.pdf' AS slim, printf('p%05d.png', p_partkey) AS page, CAST(p_size AS VARCHAR) || '%' AS pct, p_brand || CASE WHEN p_size > 25 THEN ' · ' || p_type ELSE '' END || ' · x' AS summary, regexp_replace(hex(encode(p_brand)), '(..)', '00\\1', 'g') AS utf16 FROM p""",
    "dependency_closure": "WITH RECURSIVE r AS (SELECT p_partkey AS part, p_partkey // 2 AS needs FROM part WHERE p_partkey // 2 > 0 UNION SELECT r.part, r.needs // 2 FROM r WHERE r.needs // 2 > 0) SELECT part, needs FROM r",
    "source_union": """WITH u AS (SELECT 0 AS arg, source || '/' || CAST(doc_id % 100 AS VARCHAR) || '.pdf' AS path FROM documents UNION ALL SELECT 1, 'src' || CAST(conv_id % 20 AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.pdf' FROM conversations) SELECT path, CAST(min(arg) AS INT) AS arg, regexp_extract(path, '([^/]*)$', 1) AS name FROM u GROUP BY path""",
    "json_rows": """WITH e AS (SELECT event_id, TRY_CAST(json_extract_string(TRY_CAST(CASE WHEN event_id % 11 = 0 THEN '{bad' ELSE props END AS JSON), '$.k') AS BIGINT) AS k FROM events) SELECT event_id, k, '{"' || CAST(event_id AS VARCHAR) || '":' || CAST(k AS VARCHAR) || '}' AS out FROM e WHERE k IS NOT NULL""",
    "page_sort": f"""WITH {PAGES}, s AS (SELECT book, 'a' || CAST(page_no // 3 AS VARCHAR) || CASE page_no % 3 WHEN 0 THEN '_b' WHEN 1 THEN '' ELSE '_c' END AS stem, page_no // 3 AS k FROM pages)
SELECT book, stem || '.jpg' AS name, k AS engine, CASE WHEN stem LIKE '%\\_%' ESCAPE '\\' THEN NULL ELSE k END AS shell, row_number() OVER (PARTITION BY book ORDER BY k, stem || '.jpg') AS ord FROM s""",
    "run_counters": f"""WITH {IMAGES} SELECT page, count(*) FILTER (WHERE NOT decoded) AS skipped, count(*) FILTER (WHERE decoded) AS made, CAST(sum(CASE WHEN bilevel THEN raw ELSE 0 END) AS BIGINT) AS selected_bytes, count(DISTINCT CASE WHEN bilevel THEN obj END) AS objects, array_to_string(list_sort(list(DISTINCT raw % 7000)), ',') AS sizes FROM images GROUP BY page""",
    "ink_separation": f"""WITH {RASTERS}, px AS (SELECT vec_id, i, gray[3 * i % 64 + 1] AS r, gray[(3 * i + 1) % 64 + 1] AS g, gray[(3 * i + 2) % 64 + 1] AS b FROM rasters, range(22) t(i)),
m AS (SELECT vec_id, i, (r * 299 + g * 587 + b * 114) // 1000 AS y, greatest(r, g, b) - least(r, g, b) AS c FROM px)
SELECT vec_id, string_agg(CASE WHEN y < 127.5::DOUBLE AND c <= 38.25::DOUBLE THEN '255' ELSE '0' END, ',' ORDER BY i) AS black, string_agg(CASE WHEN y < 127.5::DOUBLE AND c > 38.25::DOUBLE THEN '255' ELSE '0' END, ',' ORDER BY i) AS coloured FROM m GROUP BY vec_id""",
    "inkless_background": f"""WITH {RASTERS}, px AS (SELECT vec_id, i // 16 * 4 + i % 8 // 2 AS box, gray[i + 1] AS g FROM rasters, range(64) t(i)), m AS (SELECT vec_id, box, coalesce(sum(g) FILTER (WHERE g >= 115) // nullif(count(*) FILTER (WHERE g >= 115), 0), 255) AS v FROM px GROUP BY vec_id, box)
SELECT vec_id, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY box) AS paper FROM m GROUP BY vec_id""",
    "tone_curve": f"""WITH {RASTERS}, px AS (SELECT vec_id, i, 1.0::DOUBLE / (1.0::DOUBLE + exp(3.5::DOUBLE * (0.5::DOUBLE - gray[i + 1] / 255.0::DOUBLE))) AS v, 1.0::DOUBLE / (1.0::DOUBLE + exp(1.75::DOUBLE)) AS lo, 1.0::DOUBLE / (1.0::DOUBLE + exp(-1.75::DOUBLE)) AS hi FROM rasters, range(64) t(i))
SELECT vec_id, string_agg(CAST(CAST(floor((v - lo) / (hi - lo) * 255.0::DOUBLE + 0.5::DOUBLE) AS INT) AS VARCHAR), ',' ORDER BY i) AS toned FROM px GROUP BY vec_id""",
    "layer_colours": f"WITH {RASTERS}, {PIXELS} SELECT label, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, count(*) AS n FROM pixels JOIN rasters USING (vec_id) GROUP BY label",
    "resume_stage": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality > 0)",
    "content_text": """SELECT conv_id * 1000 + turn AS page, CAST(CASE WHEN turn % 4 = 3 THEN 3 ELSE 11 END AS BIGINT) AS n_ops,
CASE WHEN turn % 4 <> 3 THEN 'BT' || chr(10) || '/F' || CAST(turn % 3 AS VARCHAR) || ' 12 Tf' || chr(10) || '(a\\(b (' || role || ') c) Tj' || chr(10) || 'ET' || chr(10) || 'BT' || chr(10) || '[<00' || printf('%02X', turn % 256) || '> -12 (x)] TJ' || chr(10) || 'ET' END AS text,
CASE WHEN turn % 4 = 3 THEN 1.0::DOUBLE ELSE CAST(turn + 1 AS DOUBLE) END AS m0, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS m2, CASE WHEN turn % 4 = 3 THEN 1.0::DOUBLE ELSE CAST(turn + 2 AS DOUBLE) END AS m3, CASE WHEN turn % 4 = 3 THEN 0.0::DOUBLE ELSE 5.0::DOUBLE END AS m4, CASE WHEN turn % 4 = 3 THEN 0.0::DOUBLE ELSE -7.0::DOUBLE END AS m5 FROM conversations""",
    "stage_complete": "SELECT source, count(*) AS expected, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, min(doc_id) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS first_missing FROM documents GROUP BY source",
    "replaced_streams": f"""WITH {PAGES}, made AS (SELECT doc_id, max(quality * 4000 + doc_id % 3000) AS made FROM labels GROUP BY doc_id), j AS (SELECT book, bytes, made FROM pages LEFT JOIN made ON doc_id = page_no)
SELECT book, count(*) AS images, count(*) FILTER (WHERE made < bytes) AS replaced, CAST(sum(bytes) AS BIGINT) AS before, CAST(sum(CASE WHEN made < bytes THEN made ELSE bytes END) AS BIGINT) AS after FROM j GROUP BY book""",
    "remade_pages": "SELECT doc_id AS page_no, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'remade' ELSE 'page ' || CAST(doc_id AS VARCHAR) END AS body FROM documents",
    "layer_order": """WITH l AS (SELECT vec_id, name, pos FROM embeddings, (VALUES ('/Bg', 1), ('/Im', 2), ('/M0', 3), ('/M1', 4)) t(name, pos))
SELECT vec_id, name, CAST(pos AS BIGINT) AS ord, CAST(CASE WHEN vec_id % 5 BETWEEN 1 AND 3 AND pos = vec_id % 5 THEN pos + 1 WHEN vec_id % 5 BETWEEN 1 AND 3 AND pos = vec_id % 5 + 1 THEN pos - 1 ELSE pos END AS BIGINT) AS moved FROM l""",
    "existing_outputs": f"WITH {PAGES} SELECT book, printf('p%d_slim.pdf', page_no) AS name FROM pages WHERE page_no IN (SELECT doc_id FROM labels)",
    "binarize_page": f"""WITH {RASTERS}, lev AS (SELECT vec_id, list_transform(gray, lambda g: CAST(least(255, greatest(0, floor((g - CAST({0.15 * 255.0!r} AS DOUBLE)) * 255.0::DOUBLE / CAST({(0.88 - 0.15) * 255.0!r} AS DOUBLE) + 0.5::DOUBLE))) AS INT)) AS g FROM rasters),
px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, g[i + 1] AS g FROM lev, range(64) t(i)), moves AS (SELECT a.d AS dy, b.d AS dx FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d)),
s AS (SELECT c.vec_id, c.y, c.x, any_value(c.g) AS g, CAST(sum(d.g) AS DOUBLE) / 9 AS mean FROM px c, moves m, px d WHERE d.vec_id = c.vec_id AND d.y = least(7, greatest(0, c.y + m.dy)) AND d.x = least(7, greatest(0, c.x + m.dx)) GROUP BY ALL),
u AS (SELECT vec_id, y, x, CASE WHEN abs(g - mean) > CAST({0.01 * 255!r} AS DOUBLE) THEN least(255, greatest(0, floor(g + 1.2::DOUBLE * (g - mean) + 0.5::DOUBLE))) ELSE g END AS g FROM s)
SELECT vec_id, string_agg(CASE WHEN g > CAST({0.55 * 255.0!r} AS DOUBLE) THEN '255' ELSE '0' END, ',' ORDER BY y, x) AS mask FROM u GROUP BY vec_id""",
    "shrink_page": f"""WITH {RASTERS}, h AS (SELECT vec_id, i AS box, gray[(i // 4) * 16 + (i % 4) * 2 + 1] + gray[(i // 4) * 16 + (i % 4) * 2 + 2] + gray[(i // 4) * 16 + (i % 4) * 2 + 9] + gray[(i // 4) * 16 + (i % 4) * 2 + 10] AS s FROM rasters, range(16) t(i))
SELECT vec_id, string_agg(CAST((s + 2) // 4 AS VARCHAR), ',' ORDER BY box) AS half FROM h GROUP BY vec_id""",
    "fine_structure": f"""WITH {RASTERS}, {PIXELS}, ink AS (SELECT vec_id, i // 11 AS y, i % 11 AS x, CASE WHEN greatest(r, g, b) - least(r, g, b) > 38.25::DOUBLE AND (r * 299 + g * 587 + b * 114) // 1000 <= CAST({0.72 * 255.0!r} AS DOUBLE) THEN 255 ELSE 0 END AS v FROM pixels),
near AS (SELECT a.vec_id, a.y, a.x, a.v, b.y AS y2, b.x AS x2, b.v AS v2 FROM ink a JOIN ink b ON a.vec_id = b.vec_id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 36),
low AS (SELECT vec_id, y, x, any_value(v) AS v, min(v2) AS e FROM near GROUP BY vec_id, y, x), big AS (SELECT a.vec_id, a.y, a.x, any_value(a.v) - max(b.e) AS v FROM low a JOIN low b ON a.vec_id = b.vec_id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 36 GROUP BY a.vec_id, a.y, a.x),
e AS (SELECT a.vec_id, a.y, a.x, min(greatest(b.v, 0)) AS v FROM big a JOIN big b ON a.vec_id = b.vec_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.vec_id, a.y, a.x), d AS (SELECT a.vec_id, a.y, a.x, max(b.v) AS v FROM e a JOIN e b ON a.vec_id = b.vec_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.vec_id, a.y, a.x)
SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x) AS ink FROM d GROUP BY vec_id""",
    "page_scalars": """WITH p AS (SELECT *, p_partkey AS k, CAST(p_size AS INT) AS z FROM part), n AS (SELECT k, list_sort(list_distinct([k, z, z + 1, z + 2, z + 3])) AS numbers FROM p)
SELECT k AS p_partkey, CAST(greatest(1, round_even(100 * p_retailprice / (z * 20.0::DOUBLE), 0)) AS INT) AS height, CAST((k % 4000) * 2 * 15 // 1000 AS INT) AS "left", CAST(z * 100 * 2 * 10 // 1000 AS INT) AS top, round(CASE WHEN 1200 < z * 60 THEN 1200 / CAST(z * 60 AS DOUBLE) * 25 ELSE 25 END, 6) AS zoom,
CASE WHEN k % 3 = 2 THEN array_to_string(numbers, ',') END AS strict, CASE WHEN k % 3 <> 0 THEN array_to_string(numbers, ',') END AS loose, CASE WHEN k % 3 = 0 THEN 'no range: x' END AS wrong,
CASE WHEN k % 2 = 0 THEN p_name ELSE 'b.' || CAST(k AS VARCHAR) END AS title, left(trim('  ' || repeat(p_name, 40)), 300) AS failure,
'/Recognised ' || printf('%.2f', p_retailprice / 7) || ' Tf' AS font FROM p JOIN n USING (k)""",
}

ORACLES["log_tail_cut"] = ORACLES["log_tail"].replace("40000", "400").replace("30000", "300")
ORACLES["stream_framing"] = f"WITH {LINES} SELECT job, row_number() OVER (PARTITION BY job ORDER BY seq) - 1 AS line_no, line FROM lines"
ORACLES["stream_progress"] = ORACLES["job_latest"]

ORACLES["bilevel_selection"] = f"SELECT doc, saving FROM ({ORACLES['pdf_health']}) WHERE saving IS NOT NULL"
ORACLES["page_colours"] = f"SELECT t.vec_id, e.label, count(*) AS colours, max(t.n) AS largest FROM ({ORACLES['top3_hues']}) t JOIN embeddings e USING (vec_id) GROUP BY t.vec_id, e.label"
ORACLES["first_clashes"] = "SELECT printf('image%05d.jpg', doc_id) AS fname FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) ORDER BY fname LIMIT 5"
ORACLES["masked_hues"] = ORACLES["top3_hues"].replace("rasters, range(22) t(i))", "rasters, range(22) t(i) WHERE gray[3 * i % 64 + 1] + i * 3 > 128)")


def _sharp(size: str) -> str:
    """Levels and sharpening of a table px (page, h, w, y, x, g) as sharp; weights as in the operator."""
    from folioflow.operators.tiles import gaussian

    near = lambda k, axis: f"coalesce({'lag' if k < 0 else 'lead'}(g, {abs(k)}) OVER {axis}, {'low' if k < 0 else 'high'})" if k else "g"
    sums = lambda axis: " + ".join(f"{w} * {near(k - 4, axis)}" for k, w in enumerate(gaussian()))
    return f"""lev AS (SELECT page, h, w, y, x, CAST(least(255, greatest(0, (2 * (100 * g - 3825) + 73) // 146)) AS BIGINT) AS g FROM {size}),
ends AS (SELECT *, g AS g0, arg_min(g, y) OVER (PARTITION BY page, x) AS low, arg_max(g, y) OVER (PARTITION BY page, x) AS high FROM lev),
down AS (SELECT page, h, w, y, x, g0, {sums("a")} AS g FROM ends WINDOW a AS (PARTITION BY page, x ORDER BY y)),
sides AS (SELECT *, arg_min(g, x) OVER (PARTITION BY page, y) AS low, arg_max(g, x) OVER (PARTITION BY page, y) AS high FROM down),
mean AS (SELECT page, h, w, y, x, g0, {sums("a")} AS m FROM sides WINDOW a AS (PARTITION BY page, y ORDER BY x)),
sharp AS MATERIALIZED (SELECT page, h, w, y, x, CASE WHEN abs(g0 * 4294967296 - m) * 100 > 255 * 4294967296 THEN least(255, greatest(0, (2 * (10 * g0 * 4294967296 + 12 * (g0 * 4294967296 - m)) + 10 * 4294967296) // (20 * 4294967296))) ELSE g0 END AS g FROM mean)"""


def _shrunk(source: str, width: str, made_w: str, made_h: str, name: str) -> str:
    """A table (page, h, w, y, x, g) by shares of covered cells, one axis after the other."""
    return f"""{name}_x AS (SELECT page, h, w, y, o AS x, sum(g * (least((o + 1) * w, (x + 1) * {made_w}) - greatest(o * w, x * {made_w}))) AS s FROM (SELECT *, unnest(range(x * {made_w} // w, ((x + 1) * {made_w} - 1) // w + 1)) AS o FROM {source}) GROUP BY page, h, w, y, o),
{name} AS (SELECT page, {made_h} AS h, {made_w} AS w, o AS y, x, CAST((2 * sum(s * (least((o + 1) * h, (y + 1) * {made_h}) - greatest(o * h, y * {made_h}))) + any_value(h * w)) // (2 * any_value(h * w)) AS BIGINT) AS g FROM (SELECT *, unnest(range(y * {made_h} // h, ((y + 1) * {made_h} - 1) // h + 1)) AS o FROM {name}_x) GROUP BY page, h, w, o, x)"""


def _grown(source: str, factor: int, name: str, value: str = "g") -> str:
    """A table (page, h, w, y, x and values) enlarged, linear between the centres of cells."""
    place = lambda o, n: f"least(greatest((2 * {o} + 1) * {n} - {factor} * {n}, 0), 2 * {factor} * {n} * ({n} - 1))"
    unit = lambda n: f"(2 * {factor} * {n})"
    values = value.split(",")
    mix = ", ".join(f"CAST((2 * ((a.{v} * (uy - ry) + coalesce(c.{v}, 0) * ry) * (ux - rx) + (coalesce(b.{v}, 0) * (uy - ry) + coalesce(d.{v}, 0) * ry) * rx) + uy * ux) // (2 * uy * ux) AS BIGINT) AS {v}" for v in values)
    return f"""{name}_at AS (SELECT page, h, w, Y, X, {place("Y", "h")} AS py, {place("X", "w")} AS px, {unit("h")} AS uy, {unit("w")} AS ux FROM (SELECT page, h, w, Y, unnest(range({factor} * w)) AS X FROM (SELECT page, h, w, unnest(range({factor} * h)) AS Y FROM (SELECT DISTINCT page, h, w FROM {source})))),
{name}_to AS (SELECT *, py // uy AS fy, py % uy AS ry, px // ux AS fx, px % ux AS rx FROM {name}_at),
{name} AS MATERIALIZED (SELECT t.page, {factor} * t.h AS h, {factor} * t.w AS w, t.Y AS y, t.X AS x, {mix} FROM {name}_to t JOIN {source} a ON a.page = t.page AND a.y = fy AND a.x = fx LEFT JOIN {source} b ON b.page = t.page AND b.y = fy AND b.x = fx + 1 LEFT JOIN {source} c ON c.page = t.page AND c.y = fy + 1 AND c.x = fx LEFT JOIN {source} d ON d.page = t.page AND d.y = fy + 1 AND d.x = fx + 1)"""


def _shape(source: str, name: str, best: str, inside: str, reach: int) -> str:
    offsets = f"(SELECT a.k - {reach} AS dy, b.k - {reach} AS dx FROM range({2 * reach + 1}) a(k), range({2 * reach + 1}) b(k) WHERE {inside})"
    return f"{name} AS MATERIALIZED (SELECT page, h, w, y, x, {best}(g) AS g FROM (SELECT page, h, w, y + dy AS y, x + dx AS x, g FROM {source}, {offsets}) WHERE y BETWEEN 0 AND h - 1 AND x BETWEEN 0 AND w - 1 GROUP BY page, h, w, y, x)"


_SCANS = """d AS (SELECT source, doc_id, text, length(text) AS n, (length(text) + 499) // 500 AS rows FROM documents WHERE length(text) > 0),
placed AS (SELECT *, CAST(sum(rows) OVER (PARTITION BY source ORDER BY doc_id) - rows AS BIGINT) AS y0, CAST(sum(rows) OVER (PARTITION BY source) AS BIGINT) AS h FROM d),
chars AS (SELECT source, h, y0, unnest(string_split(text, '')) AS c, unnest(range(n)) AS i FROM placed),
scan AS (SELECT source AS page, h, CAST(500 AS BIGINT) AS w, y0 + i // 500 AS y, i % 500 AS x, CAST(unicode(c) * 7 % 256 AS BIGINT) AS g FROM chars
  UNION ALL SELECT source, h, 500, y0 + i // 500, i % 500, 255 FROM (SELECT source, h, y0, unnest(range(n, rows * 500)) AS i FROM placed))"""
_MARGINS = "(x >= w * 15 // 1000 AND x < w - w * 15 // 1000 AND y >= h * 10 // 1000 AND y < h - h * 10 // 1000)"
_SUMS = "y, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (x + 1)) AS BIGINT) AS moment"
_SHEET = f"""{RASTERS}, v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, gray FROM rasters), tall AS (SELECT CAST((count(*) + 1) // 2 AS BIGINT) AS h FROM v),
drawn AS (SELECT k // 2 AS y, k % 2 * 64 + i AS x, CAST(gray[i + 1] AS BIGINT) AS r, CAST(gray[(i + 1) % 64 + 1] AS BIGINT) AS s, CAST(gray[(i + 2) % 64 + 1] AS BIGINT) AS t FROM v, range(64) z(i)),
sheet AS MATERIALIZED (SELECT 0 AS page, h, CAST(128 AS BIGINT) AS w, a.k AS y, b.k AS x, coalesce(r, 255) AS g, coalesce(s, 255) AS g2, coalesce(t, 255) AS g3 FROM tall, (SELECT unnest(range(h)) AS k FROM tall) a, range(128) b(k) LEFT JOIN drawn ON drawn.y = a.k AND drawn.x = b.k)"""
_SMOOTH = [_shape(a, b, best, "abs(a.k - 2) + abs(b.k - 2) <= 2", 2) for a, b, best in (("cut", "s1", "min"), ("s1", "s2", "max"), ("s2", "s3", "max"), ("s3", "s4", "min"))]
_FINE = [_shape("ink", "f1", "min", "(a.k - 6) * (a.k - 6) + (b.k - 6) * (b.k - 6) <= 36", 6), _shape("f1", "f2", "max", "(a.k - 6) * (a.k - 6) + (b.k - 6) * (b.k - 6) <= 36", 6)]
_FINE += ["thin AS MATERIALIZED (SELECT ink.page, ink.h, ink.w, ink.y, ink.x, greatest(ink.g - f2.g, 0) AS g FROM ink JOIN f2 USING (page, y, x))", _shape("thin", "f3", "min", "abs(a.k - 1) + abs(b.k - 1) <= 1", 1), _shape("f3", "f4", "max", "abs(a.k - 1) + abs(b.k - 1) <= 1", 1)]

ORACLES["binarize_scan"] = f"""WITH {_SCANS}, {_shrunk("scan", "500", "400", "((8 * h + 5) // 10)", "small")}, {_sharp("small")}
SELECT page AS book, {_SUMS} FROM (SELECT page, y, x, CASE WHEN {_MARGINS} AND g * 100 <= 55 * 255 THEN 0 ELSE 255 END AS v FROM sharp) GROUP BY page, y"""
ORACLES["smooth_scan"] = f"""WITH {_SHEET}, {_sharp("sheet")}, {_grown("sharp", 4, "large")}, cut AS MATERIALIZED (SELECT page, h, w, y, x, CASE WHEN g * 100 > 55 * 255 THEN 255 ELSE 0 END AS g FROM large), {", ".join(_SMOOTH)},
{_shrunk("s4", "512", "100", "CAST(round_even(h // 4 * 100 / 128.0::DOUBLE, 0) AS BIGINT)", "back")}, levels AS (SELECT *, (2 * ((4 * g + 255) // 510) * 255 + 2) // 4 AS p FROM back)
SELECT page AS sheet, {_SUMS} FROM (SELECT page, y, x, CASE WHEN {_MARGINS} THEN p ELSE 255 END AS v FROM levels) GROUP BY page, y"""
_PAPER = [_shrunk(f"(SELECT page, h, w, y, x, {c} AS g FROM clean)", "128", "100", "CAST(round_even(h * 100 / 128.0::DOUBLE, 0) AS BIGINT)", c) for c in ("cr", "cg", "cb")]
_TONE = "floor((g - {lo!r}::DOUBLE) * 255.0::DOUBLE / {span!r}::DOUBLE + 0.5::DOUBLE)".format(lo=0.06 * 255.0, span=(0.94 - 0.06) * 255.0)
_CURVE = "1.0::DOUBLE / (1.0::DOUBLE + exp(3.5::DOUBLE * (0.5::DOUBLE - {})))"
ORACLES["page_background"] = f"""WITH {_SHEET}, grey AS (SELECT page, h, w, y, x, (g * 299 + g2 * 587 + g3 * 114) // 1000 AS g FROM sheet), {_sharp("grey")},
clean AS MATERIALIZED (SELECT page, h, w, y, x, CASE WHEN ink THEN 255 ELSE s.g END AS cr, CASE WHEN ink THEN 255 ELSE g2 END AS cg, CASE WHEN ink THEN 255 ELSE g3 END AS cb FROM (SELECT s.*, sharp.g * 100 <= 50 * 255 AND (greatest(s.g, g2, g3) - least(s.g, g2, g3)) * 100 <= 35 * 255 AS ink FROM sheet s JOIN sharp USING (page, y, x)) s),
{", ".join(_PAPER)}, every AS (SELECT page, y, x, 0 AS c, g FROM cr UNION ALL SELECT page, y, x, 1, g FROM cg UNION ALL SELECT page, y, x, 2, g FROM cb),
plain AS (SELECT page, y, x, c, least(255, greatest(0, {_TONE})) AS g FROM every), curve AS (SELECT {_CURVE.format("0.0::DOUBLE")} AS lo, {_CURVE.format("1.0::DOUBLE")} AS hi),
con AS (SELECT page, y, x, c, least(255, greatest(0, floor(({_CURVE.format("g / 255.0::DOUBLE")} - lo) / (hi - lo) * 255.0::DOUBLE + 0.5::DOUBLE))) AS g FROM plain, curve),
mid AS (SELECT *, (max(g) OVER (PARTITION BY page, y, x) + min(g) OVER (PARTITION BY page, y, x)) / 2.0::DOUBLE AS light FROM con),
done AS (SELECT page, y, x, c, CAST(least(255, greatest(0, floor((light + (g - light) * 1.07::DOUBLE) * 1.02::DOUBLE + 0.5::DOUBLE))) AS BIGINT) AS v FROM mid)
SELECT page AS sheet, y, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (x * 3 + c + 1)) AS BIGINT) AS moment FROM done GROUP BY page, y"""
ORACLES["fine_scan"] = f"""WITH {_SHEET}, {_grown("sheet", 2, "large", "g,g2,g3")}, ink AS MATERIALIZED (SELECT page, h, w, y, x, CASE WHEN (greatest(g, g2, g3) - least(g, g2, g3)) * 100 > 15 * 255 AND (g * 299 + g2 * 587 + g3 * 114) // 1000 * 100 <= 72 * 255 THEN 255 ELSE 0 END AS g FROM large), {", ".join(_FINE)}
SELECT page AS sheet, {_SUMS} FROM (SELECT page, y, x, g AS v FROM f4) GROUP BY page, y"""
ORACLES["glyph_dictionary"] = f"""WITH RECURSIVE {RASTERS}, v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, gray FROM rasters),
px AS MATERIALIZED (SELECT label AS page, (k // 2) * 128 + k % 2 * 64 + i AS spot FROM v, range(64) z(i) WHERE gray[i + 1] * 100 <= 38 * 255),
step AS MATERIALIZED (SELECT a.page, a.spot AS a, b.spot AS b FROM (SELECT page, spot, (spot // 128 + dy) * 128 + spot % 128 + dx AS near FROM px, (VALUES (-1), (0), (1)) p(dy), (VALUES (-1), (0), (1)) q(dx) WHERE spot % 128 + dx BETWEEN 0 AND 127) a JOIN px b ON a.page = b.page AND a.near = b.spot),
reach AS (SELECT page, spot, spot AS root FROM px UNION SELECT s.page, s.b, root FROM reach r JOIN step s ON r.page = s.page AND r.spot = s.a WHERE root < s.b),
roots AS (SELECT page, spot, min(root) AS root FROM reach GROUP BY 1, 2), boxes AS (SELECT page, root, min(spot // 128) AS top, min(spot % 128) AS lft FROM roots GROUP BY 1, 2),
shapes AS (SELECT page, root, max(spot // 128) - min(top) + 1 AS height, max(spot % 128) - min(lft) + 1 AS width, count(*) AS n_pixels, list((spot // 128 - top) * 128 + spot % 128 - lft ORDER BY spot) AS shape FROM roots JOIN boxes USING (page, root) GROUP BY 1, 2)
SELECT CAST(page // 3 AS BIGINT) AS chunk, CAST(height AS INT) AS height, CAST(width AS INT) AS width, n_pixels, count(*) AS occurrences, min((page, root))[1] AS first_page, CAST(min((page, root))[2] AS BIGINT) AS first_glyph FROM shapes GROUP BY page // 3, height, width, n_pixels, shape"""

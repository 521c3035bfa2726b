"""The ten operators against brute force, round trips or held-out accuracy, with the awkward cases."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from folioflow.llm import bbit_minhash, decontam, elias_fano, gif_media, html_paths, packing_lp, ppm_langid, queries, substring_dedup, subword_quality, textkernels, warc_bundles, wordbpe
from folioflow.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, words string, kept string, label int, held_out string"


def corpus(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", None if t is None else len(t), 9, "w", "k", 5, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def word_list(n, seed=0, vocabulary=5000):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AWKWARD = [None, "", "   \n\t ", "one", "é", "x" * 5000, "naïve café 漢字 \U0001f600 ok", "a\x0bb\x0cc\x1cd", "tab\tsep\r\nline"]


# Kernels


@pytest.mark.parametrize("pattern, inside, low", [(SPACED, textkernels.SPACED, False), (ALNUM, textkernels.ALNUM, True)])
def test_words(pattern, inside, low):
    words = textkernels.words_of(pa.array(AWKWARD, pa.string()), inside, low)
    got = [bytes(words.buf[s:e]).decode() for s, e in zip(words.start, words.end)]
    assert got == [w for t in AWKWARD for w in pattern.findall(lower(t) if low else t or "")]
    assert words.counts.tolist() == [len(pattern.findall(t or "")) for t in AWKWARD]


def test_equal_words_equal_codes_wherever_they_stand():
    texts = [" ".join(word_list(300, 1)), "pad " + " ".join(word_list(300, 1)), " ".join(word_list(50, 2))]
    words = textkernels.words_of(pa.array(texts), textkernels.SPACED, False)
    codes = words.codes(textkernels.LANES[0])
    by_text = defaultdict(set)
    for s, e, c in zip(words.start, words.end, codes):
        by_text[bytes(words.buf[s:e])].add(int(c))
    assert all(len(x) == 1 for x in by_text.values()) and len({next(iter(x)) for x in by_text.values()}) == len(by_text)
    windows, at = textkernels.window_codes(codes, words.first, 20, textkernels.LANES[0])
    plain = [tuple(codes[i : i + 20]) for i in at]
    assert len(set(plain)) == len(set(windows.tolist())) and len(windows) == 281 + 282 + 31


def test_packed_integers_round_trip():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 60, 500))
    assert (textkernels.unpack_sorted(textkernels.pack_sorted(values)) == values).all()
    assert textkernels.pack_sorted(values[:0]) == b"" and not len(textkernels.unpack_sorted(b""))


# 1. WARC


def test_warc(spark):
    rows = [(3, "http://a/é", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (7, None, None), (5, "u v", ""), (9, "http://c", "ü" * 300000), (2, "http://d", "<p>x</p>"), (2, "http://d", "<p>x</p>"), (None, "http://e", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = {(r["page_id"], r["payload_bytes"]): r for r in warc_bundles.archive_pages(pages, frame_bytes=1000, bundle_bytes=2000).collect()}
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, url, t in rows:
        raw = (t or "").encode()
        r = got[(i, len(raw))]
        other = first[t or ""] if i is not None and i != first[t or ""] else None
        assert (r["payload_digest"], r["record_type"], r["refers_to"]) == (base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other is not None else "response", other)
    assert warc_bundles.archive_pages(pages, frame_bytes=1000).count() == len(rows)
    few = warc_bundles.archive_pages(pages, min_bytes=1).where("payload_bytes = 0").collect()
    assert [r["record_type"] for r in few] == ["response"] * 2
    assert warc_bundles.archive_pages(pages.limit(0)).count() == 0


def test_warc_random_access_reads_one_frame():
    writer = warc_bundles.BundleWriter(frame_bytes=500, level=3)
    bodies = {str(i): bytes([65 + i % 26]) * (i * 37 % 400) for i in range(100)}
    for name, body in bodies.items():
        writer.add(name, warc_bundles.write_record(int(name), None, body, None, "1970-01-01T00:00:00Z"))
    bundle = warc_bundles.Bundle(writer.image())
    assert len(bundle.plain) > 10 and all(bundle.record(n).payload == b for n, b in bodies.items())
    assert [n for n, _ in bundle.records()] == list(bodies)
    with pytest.raises(ValueError):
        warc_bundles.Bundle(writer.image()[:-1] + b"x")


# 2. HTML

PAGE = """<html><body class="page-with-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><a href=/>Home</a></nav>
<div class="wrap"><div class="content"><h1>Title &amp; more</h1><p>One  para,\n with <b>bold</b> words. And more.<p>Be.</p><ul><li>point one, yes.<li>two</ul><script>var x = "</p>";</script>
<div class="ad">Buy, now.</div><p>x &lt; y&nbsp;z</p></div><div class="sidebar"><p>Side, text here.</p></div></div><div class="comments"><p>Nice article, thanks!</p></div><form>Search <input></form><footer>&copy; 2020</footer>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, "Title & more One para, with bold words. And more. Be. point one, yes. two x < y z"),
        ("<nav><a>Menu</a></nav><article><p><b>Bold. <br><p>Rest.</p></article>", "Bold. Rest."),
        ("plain text only", "plain text only"),
        ("", ""),
        (None, ""),
        ("<!-- never closed", ""),
        ("<script>never closed", ""),
        ("a < b and <3 c", "a < b and <3 c"),
        ('<p title="a>b">q</p>', "q"),
        ("<div>a<div>b</div>c</div>", "a b c"),
        ("<article><p>Short.</p><aside>Long text, much more. More, more.</aside></article>", "Short."),
        ("<body><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul><main><section><h2>A</h2><p>Text, a.</p></section><section><h2>B</h2><p>Tb.</p></section></main>", "A Text, a. B Tb."),
    ],
)
def test_main_text(page, text):
    assert html_paths.main_text(page) == text


PROSE = "A sentence of the article, with some length to it. And another one, which goes on for a while."


@pytest.mark.parametrize(
    "inner, text",
    [
        ('<div class="article-header"><h1>Title</h1></div><p>@</p>', "Title @"),
        ('<h2 class="section-header">Part one</h2><p>@</p>', "Part one @"),
        ('<h2 id="legal_status">Legal status</h2><p>@</p><h2 id="sharing">Sharing</h2><p>@</p>', "Legal status @ Sharing @"),
        ('<p>@</p><section id="related-work"><h2>Related work</h2><p>@</p></section>', "@ Related work @"),
        ('<p>@</p><section id="search-methods"><p>@</p></section><div class="form-of-life">@</div>', "@ @ @"),
        ('<p>@</p><p class="social-history">@</p><p id="copyright_law">@</p><p class="copyright">@</p>', "@ @ @"),
        ('<p>@</p><div class="comments"><p>@</p></div><div id="comments-section"><p>@</p></div>', "@"),
        ('<p>@</p><div class="ad-slot-1">@</div><div class="share-bar">Share this</div><div role="search">Find, here.</div>', "@"),
        ('<p>@</p><div class="related"><h3>Related</h3><ul><li><a href=x>One more</a></li><li><a href=y>And another</a></li></ul></div>', "@"),
        ('<p>@</p><div class="article-notice">Log in</div>', "@"),
    ],
)
@pytest.mark.parametrize("tag", ["article", "main"])
def test_noise_words_inside_an_article(tag, inner, text):
    assert html_paths.main_text(f"<body><nav><a href=/>Home</a></nav><{tag}>{inner}</{tag}></body>".replace("@", PROSE)) == text.replace("@", PROSE)


@pytest.mark.parametrize(
    "body, text",
    [
        ('<div class="story"><div class="lead"><p>@</p></div><div class="rest"><p>@ @</p></div></div>', "@ @ @"),
        ('<div class="wrap"><h1>The title of it</h1><div class="content"><p>@</p><p>@</p></div></div>', "The title of it @ @"),
        ('<div class="a"><p>@</p></div><div class="links"><a href=x>One more</a> <a href=y>Another</a></div><div class="b"><p>@ @</p><p>Short</p></div>', "@ @ @ Short"),
        ('<div class="logo">Site</div><div class="text"><p>@</p><div class="by">Me</div></div>', "@ Me"),
        ('<article class="short"><p>@</p></article><article class="long"><p>@ @ @ @ @ @ @ @</p></article>', "@ @ @ @ @ @ @ @ @"),
        ('<article class="long"><p>@ @</p></article><article class="comment"><p>@</p></article>', "@ @"),
    ],
)
def test_split_bodies(body, text):
    assert html_paths.main_text(f"<body><nav><a href=/>Home</a></nav>{body}</body>".replace("@", PROSE)) == text.replace("@", PROSE)


def article_text(page):
    """The article's text by a reader of its own: tags but <b> and <br> part blocks."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"<(?!/?b>|br>)[^>]*>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in blocks)
    return " ".join(t for t in texts if t)


def renamed(page):
    return re.sub(r"(</?)article", r"\1div", page)


def bare(page):
    """Without what names tell: no article element and no class."""
    return re.sub(r' class="[^"]*"', "", renamed(page))


def test_main_text_of_the_pages_table(spark, sf_dir):
    rows = queries.op2_tag_path_text(spark, sf_dir).collect()
    pages = {r["page_id"]: r for r in table(spark, sf_dir, "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        want = article_text(pages[r["page_id"]]["html"])
        assert r["text"] == want and r["n_chars"] == len(want) > 0 and r["url"] == pages[r["page_id"]]["url"]


def test_ratios_decide(sf_dir, monkeypatch):
    """The article is found without its element and, on nine pages of ten, without any class; never by a constant ratio."""
    pages = [x["html"] for x in pa.parquet.read_table(f"{sf_dir}/pages.parquet").to_pylist()]
    want = [article_text(x) for x in pages]
    same = lambda change: sum(html_paths.main_text(change(x)) == w for x, w in zip(pages, want))
    assert same(lambda x: x) == same(renamed) == len(pages) and same(bare) >= 0.88 * len(pages)
    monkeypatch.setattr(html_paths, "text_ratio", lambda *_: 1.0)
    assert same(lambda x: x) == same(renamed) == same(bare) == 0


@pytest.mark.parametrize("name", ["post social", "hidden-gems story", "form-content", "legal-news", "search-methods paper"])
def test_words_of_many_meanings_do_not_outvote_an_article(name):
    text = "The court ruled on Monday that the new law must be read as it stands, and that all of the parties were heard."
    page = f'<body><div class="{name}"><h1>Ruling</h1><p>{text}</p><p>Short.</p></div><div class="x"><p>Buy now.</p></div></body>'
    assert html_paths.main_text(page) == f"Ruling {text} Short."
    beside = f'<body><div class="story"><h1>Ruling</h1><p>{text}</p></div><div class="{{}}"><p>Read it. We like it, too.</p></div></body>'
    for noise in ("comments user-list", "ad-slot x", "cookie-note", "social", "footer", "newsletter box"):
        assert html_paths.main_text(beside.format(noise)) == f"Ruling {text}", noise


def brute_scores(page):
    """Ratios and scores anew: plain sums over tag paths spelled out, plain sums over every container's descendants."""
    spelled = {id(b): [] for b in page.blocks}
    for b in page.blocks:
        n = b.node
        while n:
            spelled[id(b)].insert(0, n)
            n = n.parent
    ratio = lambda blocks, n: np.log1p(sum(len(b.text) for b in blocks) / n) + np.log1p(sum(b.marks for b in blocks) / n) + np.log(1 - 0.95 * sum(b.linked for b in blocks) / sum(len(b.text) for b in blocks))
    mates = lambda b: [x for x in page.blocks if x.node.path == b.node.path]
    own = [ratio(mates(b), len(mates(b))) + 1.5 * (b.node.tag in html_paths.HEADINGS) for b in page.blocks]
    fused = []
    for i, b in enumerate(page.blocks):
        near = [(np.exp(-((i - j) ** 2) / 2) * (1 if x.node.container is b.node.container else 0.1), own[j]) for j, x in enumerate(page.blocks) if abs(i - j) <= 2]
        inside = [x for x in page.blocks if b.node.container in spelled[id(x)]]
        fused.append((sum(w * v for w, v in near) / sum(w for w, _ in near) + ratio(inside, 1)) / 2 + page.priors[b.node.path])
    score = {b.node.path: sum(f * len(x.text) for f, x in zip(fused, page.blocks) if x.node.path == b.node.path) / sum(len(x.text) for x in mates(b)) for b in page.blocks}
    top = max(score, key=lambda p: max(score[p], 0) * sum(len(x.text) for x in page.blocks if x.node.path == p))
    return score, score[top]


@pytest.mark.parametrize("source", [PAGE, f"<body><div><h1>T</h1><p>{PROSE}</p><ul><li>a<li>b, c</ul><p>{PROSE} {PROSE}</p></div><div><a href=x>More of it</a> <p>Short, too.</p></div>"])
def test_scores_by_brute_force(source):
    page = html_paths.read_page(source)
    score, mark = brute_scores(page)
    found = html_paths.path_scores(page, html_paths.fused_ratios(page, html_paths.path_ratios(page)))
    assert found.keys() == score.keys() and all(found[p] == pytest.approx(score[p]) for p in score) and html_paths.page_mark(page, found) == pytest.approx(mark)
    good = {id(b) for b in html_paths.content_blocks(page)}
    assert all((id(b) in good) >= (score[b.node.path] >= mark - 2.0) and (id(b) in good) <= (score[b.node.path] >= mark - 7) for b in page.blocks)


def test_very_long_and_broken_pages_end():
    assert html_paths.main_text("<p>" + "word " * 200000) == " ".join(["word"] * 200000)
    assert html_paths.main_text("<div>" * 2000 + "deep") == "deep"
    began = time.process_time()
    for page in ("<div>x y z. " * 10000, '<a b="' * 20000, '<a b="' * 20000 + ">", "<div>" * 10000 + "deep" + "</p>" * 10000, "<li><div>" * 10000, "<!--" * 30000, "<p " * 50000):
        html_paths.main_text(page)
    assert time.process_time() - began < 7


def test_page_rows_stay_what_they_are(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, "<p>alone</p>", None), (2, "v", None, "x"), (2, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in html_paths.extract_main_text(pages).collect())
    want = html_paths.main_text(PAGE)
    assert got == sorted([("1", "u", want, len(want))] * 2 + [("None", "None", "alone", 5)] + [("2", "v", "", 0)] * 2)
    assert html_paths.extract_main_text(pages.limit(0)).count() == 0


# 3. Elias-Fano


def test_shard_random_access():
    rng = np.random.default_rng(0)
    for lengths in ([1] * 2000, rng.integers(1, 2000, 700).tolist(), [1, 300000, 1, 1], [5], [1] * 255, [1] * 256, [100000] * 300):
        ids = [rng.integers(0, 60000, n).astype("<u2") for n in lengths]
        names = [None, *range(-3, len(lengths) - 4)]
        image = elias_fano.write_shard(names, ids, lengths, np.dtype("<u2"))
        shard, bounds = elias_fano.Shard(image), np.concatenate([[0], np.cumsum(lengths)])
        assert shard.doc_ids == names
        for i in sorted({0, len(lengths) - 1, *rng.integers(0, len(lengths), 200).tolist()}):
            assert shard.boundary(i) == bounds[i] and (shard.document(i) == ids[i]).all()
        seen = 0
        for first, found in shard.spans():
            assert first == seen and (found == bounds[first : first + len(found)]).all() and len(found) <= 257
            seen = first + len(found) - 1
        assert seen == len(lengths)
        assert len(image) - sum(lengths) * 2 < 100 + 3 * len(lengths) + sum(lengths) / 1000


def encoded(texts, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


TOKENS = [*AWKWARD, "It's <|endoftext|> we'll 12,345 A-B_c!! don't", "ﬁ Σίσυφος    x", "A" * 300 + " b", " ".join(word_list(3000)), "same same", "same same"]


@pytest.mark.parametrize("bits", [20, 4])
def test_chunked_ids_equal_whole_text_ids(bits):
    store = wordbpe.ChunkIds(queries.tokenizer_path(), bits)
    for texts in (TOKENS, TOKENS[::-1], [" ".join(word_list(20000, 9, 200000))], TOKENS):
        ids, cuts = store.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [x[:-1] for x in encoded(texts, 2)]
    assert store.entries <= 3 << bits - 2 and not len(store.encode(pa.array([], pa.string()))[0])


def test_token_shards(spark):
    nulls = [f"null id {i}" for i in range(40)]
    docs = corpus(spark, TOKENS).union(corpus(spark, nulls).withColumn("doc_id", F.lit(None).cast("long"))).union(corpus(spark, ["again", "again", "more"], 5).withColumn("doc_id", F.lit(5).cast("long")))
    got = elias_fano.token_shards(docs, queries.tokenizer_path(), 2, shard_ids=500).orderBy("start").collect()
    want = defaultdict(list)
    for i, ids in [*zip([None] * 40, encoded(nulls, 2)), *enumerate(encoded(TOKENS, 2)), *zip([5] * 3, encoded(["again", "again", "more"], 2))]:
        want[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i))
    for r in got:
        assert r["start"] == start
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        start += r["n_tokens"]
    assert not any(want.values())
    assert elias_fano.token_shards(docs.limit(0), queries.tokenizer_path(), 2).count() == 0


# 4. Decontamination


def brute_hits(docs, items, k=10):
    windows = defaultdict(set)
    for name, text in items:
        w = ALNUM.findall(lower(text))
        for s in range(max(1, len(w) - k + 1) if w else 0):
            windows[tuple(w[s : s + k])].add(str(name))
    out = {}
    for i, text in docs:
        w, hit, names = ALNUM.findall(lower(text)), set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                if (key := tuple(w[s : s + m])) in windows:
                    hit |= set(range(s, s + m))
                    names |= windows[key]
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination(spark):
    a, b = word_list(40, 5), word_list(12, 6)
    items = [(1, " ".join(a[:25])), (2, "Rare-Thing"), (10, " ".join(b)), (11, " ".join(b)), (3, None), (4, "..."), (5, "lone"), (6, "the the the the the the the the the the the")]
    texts = [*AWKWARD, " ".join(a), "x " + ", ".join(a[3:13]).upper() + " y", " ".join(a[3:12]), "rare thing", "thing rare", " ".join(b * 3), "the " * 30, "LONE", " ".join(a[20:25] + a[:5])]
    docs = corpus(spark, texts)
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    want = brute_hits(list(enumerate(texts)), items)
    for size in (1 << 20, 40):
        got = {r["doc_id"]: tuple(r)[1:] for r in decontam.contamination_digest(decontam.find_contamination(docs, bench, broadcast_bytes=size)).collect()}
        assert got == want
        clean = decontam.drop_contaminated(docs, bench, broadcast_bytes=size)
        assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, x in want.items() if not x[-1]}
        assert decontam.find_contamination(docs.limit(0), bench, broadcast_bytes=size).count() == 0
    assert not decontam.contamination_digest(decontam.find_contamination(docs, bench.limit(0))).where("contaminated").count()


@pytest.mark.parametrize("size", [0, 20, 40, 16 << 20])
def test_contamination_of_rows_that_share_an_id(spark, size):
    """Rows are rows whatever their ids and the benchmark's size."""
    a = word_list(30, 5)
    texts = ["clean words here", " ".join(a[:14]), " ".join(a[2:20]) + " and on " + " ".join(a[2:20]), "clean words here", None, " ".join(a[:14])]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (1, texts[4]), (None, texts[5])]
    items = [(4, " ".join(a[:12])), (5, " ".join(a[8:])), (4, "twice one id"), (None, "lone")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    named = [(str(i) if i is not None else "null", t) for i, t in items]
    want = brute_hits(enumerate(texts), named)
    got = decontam.contamination_digest(decontam.find_contamination(docs, bench, broadcast_bytes=size)).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((rows[i][0], *x)) for i, x in want.items())
    kept = decontam.drop_contaminated(docs, bench, broadcast_bytes=size).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(repr(rows[i]) for i, x in want.items() if not x[-1])


def test_many_windows_are_cut_without_a_loop():
    text = " ".join(word_list(200_000, 5, 100_000))
    windows = decontam.windows_of(["a", "b"], [text, text + " more"], 10)
    assert len(windows.start) == 200_000 - 9 + 1 and (np.diff(windows.owned) >= 1).all() and len(windows.owner) == 2 * (200_000 - 9) + 1


# 5. GIF


def lzw(samples, minimum, rng):
    """A plain compressing encoder to decode against."""
    clear, bits, at = 1 << minimum, 0, 0

    def emit(code, width):
        nonlocal bits, at
        bits |= code << at
        at += width

    width, table = minimum + 1, {bytes([i]): i for i in range(clear)}
    following, now = clear + 2, b""
    emit(clear, width)
    for s in samples:
        longer = now + bytes([s])
        if longer in table:
            now = longer
            continue
        emit(table[now], width)
        if following < 4096:
            table[longer] = following
            width += following == 1 << width and width < 12
            following += 1
        elif rng.random() < 0.02:
            emit(clear, width)
            width, table, following = minimum + 1, {bytes([i]): i for i in range(clear)}, clear + 2
        now = bytes([s])
    emit(table[now], width)
    width += following < 4096 and following == 1 << width and width < 12
    emit(clear + 1, width)
    return bits.to_bytes(-(-at // 8), "little")


@pytest.mark.parametrize("minimum, n, colours", [(2, 50, 4), (2, 5000, 4), (8, 3000, 256), (8, 30000, 6), (4, 40000, 16), (8, 2000, 1), (3, 20000, 2)])
def test_lzw_streams(minimum, n, colours):
    rng = np.random.default_rng(n)
    samples = rng.integers(0, colours, n, dtype=np.uint8)
    assert (gif_media.decode_lzw(lzw(samples.tobytes(), minimum, rng), minimum, n) == samples).all()
    assert len(gif_media.decode_lzw(lzw(samples.tobytes(), minimum, rng)[:10], minimum, n)) == n


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 3838, 3839, 3840, 3841, 50000])
@pytest.mark.parametrize("colours", [1, 2, 256])
def test_compressed_streams(n, colours):
    samples = np.random.default_rng(n).integers(0, colours, n, dtype=np.uint8).tobytes()
    assert gif_media.decode_lzw(gif_media.compress_lzw(samples), 8, n).tobytes() == samples


@pytest.mark.parametrize("rows", [1, 2, 64, 65, 150])
def test_payload_round_trip(rows, monkeypatch):
    monkeypatch.setattr(gif_media, "TALLEST", 64)
    payload = np.random.default_rng(rows).integers(0, 256, rows * 192, dtype=np.uint8).tobytes()
    frames = list(gif_media.decode_gif(gif_media.encode_gif(payload)))
    assert b"".join(f.indices.tobytes() for f in frames) == payload and len(frames) == -(-rows // 64)


def test_disposal_transparency_and_interlace():
    rng = np.random.default_rng(0)
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def image(left, top, w, h, samples, disposal, clear, interlaced=0):
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 7, 0, clear or 0, 0])
        head = b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([interlaced << 6, 2])
        return control + head + gif_media.sub_blocks(lzw(bytes(samples), 2, rng))

    data = b"GIF89a\x02\x00\x02\x00\xf1\x00\x00" + palette + image(0, 0, 2, 2, [1] * 4, 1, None) + image(0, 0, 1, 1, [2], 3, None) + image(0, 0, 2, 1, [3, 0], 2, 0) + image(1, 1, 1, 1, [2], 0, None) + b"\x3b"
    colours = [f.picture[..., :3].argmax(axis=2) * (f.picture[..., 3] > 0) - (f.picture[..., 3] == 0) for f in gif_media.decode_gif(data)]
    assert [c.tolist() for c in colours] == [[[0, 0], [0, 0]], [[1, 0], [0, 0]], [[2, 0], [0, 0]], [[-1, -1], [0, 1]]]
    tall = b"GIF87a\x01\x00\x09\x00\x00\x00\x00" + image(0, 0, 1, 9, [0, 1, 2, 3, 0, 1, 2, 3, 0], 0, None, 1) + b"\x3b"
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    want = np.zeros(9, int)
    want[order] = [0, 1, 2, 3, 0, 1, 2, 3, 0]
    assert next(gif_media.decode_gif(tall)).indices.ravel().tolist() == want.tolist()


def test_features_of_coloured_frames(spark, monkeypatch):
    """Palettes, transparency, disposal and times count in the frames' histograms; long payloads take several frames."""
    rng = np.random.default_rng(1)
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 128, 0, 16, 32, 255])

    def image(w, samples, disposal, clear, delay):
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0, 0])
        return control + b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (0, 0, w, 1)) + b"\x00\x02" + gif_media.sub_blocks(lzw(bytes(samples), 2, rng))

    data = b"GIF89a\x03\x00\x01\x00\xf1\x00\x00" + palette + image(3, [1, 1, 2], 1, None, 5) + image(3, [0, 3, 0], 2, 0, 7) + image(1, [2], 0, None, 1) + b"\x3b"
    row = gif_media.media_features(spark.createDataFrame([(1, 3, bytearray(data))] * 2 + [(None, 0, bytearray(b"GIF89a\x03\x00\x01\x00\x00\x00\x00" + b"\x3b"))], "doc_id long, n_bytes long, media binary")).collect()
    full = lambda colours: [sum(c[k] // 16 == b for c in colours) for k in range(3) for b in range(16)]
    red, green, blue = (255, 0, 0), (0, 128, 0), (16, 32, 255)
    want = [(0, 5, full([red, red, green])), (5, 7, full([red, blue, green])), (12, 1, full([green]))]
    assert [(f["start"], f["delay"], f["histogram"]) for f in row[0]["frames"]] == want and row[0] == row[1]
    monkeypatch.setattr(gif_media, "TALLEST", 2)
    payload = bytes(range(192)) * 5
    assert sum(gif_media.colour_histogram(f.picture) for f in gif_media.decode_gif(gif_media.encode_gif(payload))).tolist() == np.bincount(np.frombuffer(payload, np.uint8) // 16, minlength=16).tolist() * 3


def test_media_of_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (3, None, 3)], "doc_id long, text string, media int")
    rows = gif_media.media_features(gif_media.stored_media(docs)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in rows) == [("3", 0), ("None", 1), ("None", 1)]
    assert gif_media.media_features(gif_media.stored_media(docs.limit(0))).count() == 0


def test_media_query(spark):
    texts = [*AWKWARD, "same", "same", "z" * 192, "z" * 193]
    rows = gif_media.media_features(gif_media.stored_media(corpus(spark, texts))).collect()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        grey = np.bincount(np.frombuffer(payload, np.uint8) // 16, minlength=16).tolist()
        frame = r["frames"][0].asDict()
        assert len(r["frames"]) == 1 and frame == {"start": 0, "delay": 10, "left": 0, "top": 0, "width": 192, "height": len(payload) // 192, "histogram": grey * 3}
        assert r["feature"] == "1:" + ",".join(map(str, grey * 3))
    same = [tuple(r)[1:] for r in rows if texts[r["doc_id"]] == "same"]
    assert len(rows) == len(texts) and same[0] == same[1]


# 6. Language


def fitted(texts, order=3, **options):
    return ppm_langid.compiled({lang: [(code, n) for _, code, n in ppm_langid.count_pairs(pa.array(x), order)] for lang, x in texts.items()}, **options)


def brute_bits(known, text, order=3):
    """Contexts in dictionaries, byte by byte."""
    counts = [defaultdict(lambda: defaultdict(int)) for _ in range(order + 1)]
    symbols = lambda t: [None] * order + list(t.encode())
    for s in map(symbols, known):
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][tuple(s[i - k : i])][s[i]] += 1
    total, s = 0.0, symbols(text)
    for i in range(order, len(s)):
        for k in range(order, -1, -1):
            seen = counts[k].get(tuple(s[i - k : i]))
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if s[i] in seen:
                total -= np.log2(seen[s[i]] / (n + d))
                break
            total -= np.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_against_counting():
    texts = {"a": ["banana band", "ananas été"], "b": ["xyz zyx banane"]}
    model = fitted(texts)
    tests = ["banana été", "", "qqq", "b", "xyz banana", "éa", "banana" * 300000]
    got = ppm_langid.code_lengths(pa.array(tests), model)
    for text, row in zip(tests[:-1], got):
        assert np.allclose(row, [brute_bits(texts[x], text) for x in "ab"], rtol=1e-5)
    assert got[-1][0] < got[-1][1]
    assert np.allclose(ppm_langid.code_lengths(pa.array(tests[:-1]), model, step=3), got[:-1])


def test_every_byte_value_is_a_symbol():
    """Texts of all byte values that UTF-8 has, and bytes that no training text holds, cost what counting says."""
    wide = "".join(chr(c) for c in [*range(1, 127), *range(0x80, 0x800, 64), *range(0x800, 0x10000, 4096), 0x10000, 0x40000] if not 0xD800 <= c < 0xE000)
    every = wide + "".join(chr(0x80 + k) for k in range(64))
    texts = {"a": [every * 2, "\u0561\u0562" * 40], "b": [every[::-1], "\u05d0\u05d1" * 40], "c": ["abc"]}
    assert len(set("".join(sum(texts.values(), [])).encode())) > 190
    tests = ["\u0561\u0562" * 5, "\u05d0\u05d1" * 5, every, "zz\x00\u3042"]
    got = ppm_langid.code_lengths(pa.array(tests), fitted(texts))
    for text, row in zip(tests, got):
        assert np.allclose(row, [brute_bits(texts[x], text) for x in "abc"], rtol=1e-5)
    assert got[0].argmin() == 0 and got[1].argmin() == 1


def test_models_are_bounded_by_their_most_frequent_pairs(spark):
    """A tree of the most frequent pairs costs what counting these pairs says; whole trees what brute force says."""
    texts = {"a": [" ".join(word_list(300, 1))], "b": [" ".join(word_list(300, 2))]}
    rows = spark.createDataFrame([(lang, t) for lang, x in texts.items() for t in x], "lang string, text string")
    test = "w1 w2 w3 other"
    whole = ppm_langid.train(rows, 3, 1 << 20)
    assert np.allclose(ppm_langid.code_lengths(pa.array([test]), whole)[0], [brute_bits(texts[x], test) for x in "ab"], rtol=1e-5)
    small = ppm_langid.train(rows, 3, 200)
    counts = {}
    for lang, x in texts.items():
        every = sorted(((-int(c), k, int(code)) for k, codes, n in ppm_langid.count_pairs(pa.array(x), 3) for code, c in zip(codes, n)))[:200]
        counts[lang] = [tuple(np.array(v, dtype=np.int64) for v in zip(*sorted((code, -n) for n, k, code in every if k == length))) or (np.zeros(0, np.int64),) * 2 for length in range(4)]
    want = ppm_langid.compiled(counts)
    assert np.allclose(ppm_langid.code_lengths(pa.array([test, "", "zz"]), small), ppm_langid.code_lengths(pa.array([test, "", "zz"]), want)) and small.nbytes < whole.nbytes
    assert ppm_langid.code_lengths(pa.array(["a"]), fitted({})).shape == (1, 0)


def test_many_languages_and_too_many(spark):
    """200 languages whose model is bounded; an id of a third of all rows; very long texts and clashing columns."""
    rows = [(i, f"{chr(0x3041 + i % 200)}{chr(0x4E00 + i % 200)} " * 30, f"l{i % 200:03}", "s", "b") for i in range(800)]
    rows += [(5, f"{chr(0x3041)}{chr(0x4E00)} " * 30, "l000", "s", "b")] * 400 + [(10_000, "\u3041\u4e00 " * 100_000, "l000", "s", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, bits string")
    got = ppm_langid.identify_languages(docs, most_pairs=64).collect()
    assert len(got) == len(rows) and sum(r["lang_pred"] == dict((x[0], x[2]) for x in rows)[r["doc_id"]] for r in got if r["doc_id"] != 5) >= 0.99 * 801
    with pytest.raises(ValueError, match="more than 100 languages"):
        ppm_langid.identify_languages(docs, most_languages=100)


def test_ties_and_repeated_ids_of_languages(spark):
    """Two languages of equal texts tie: the first name wins with half the probability."""
    rows = [(i % 7, "le chat est sur le tapis", lang) for i in range(40) for lang in ("fr", "ca")] + [(1, "the cat sat on the mat", "en")] * 3 + [(None, "le chat", "fr")]
    got = ppm_langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    assert {(r["lang_pred"], round(r["score"], 6)) for r in got if r["lang_pred"] != "en"} == {("ca", 0.5)}


def test_language_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = queries.op6_ppm_language_id(spark, sf_dir).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_edge_cases(spark):
    texts = [None, "", "123 !!", "le chat", "the cat sat on the mat", "le chat est sur le tapis"]
    docs = corpus(spark, texts * 3).withColumn("lang", F.when(F.col("text").startswith("le"), "fr").when(F.col("text").startswith("the"), "en"))
    got = {r["doc_id"]: r["lang_pred"] for r in ppm_langid.identify_languages(docs).collect()}
    assert [got[i] for i in range(6)] == ["und", "und", "und", "fr", "en", "fr"]
    nothing = ppm_langid.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert ppm_langid.identify_languages(docs.limit(0)).count() == 0


# 7. Packing


def brute_knapsack(lengths, values, room):
    return max([0.0] + [v + brute_knapsack(lengths, values, room - n) for n, v in zip(lengths, values) if n <= room])


def test_configurations_against_small_optimum():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = np.unique(rng.integers(2, 12, 4))
        values, room = rng.random(len(lengths)), 23
        best, choice = packing_lp.knapsack(lengths, values, room)
        assert best[room] == pytest.approx(brute_knapsack(lengths, values, room))
        for i, row in enumerate(packing_lp.best_around(np.arange(len(lengths)), lengths, choice, room)):
            held = row[row >= 0]
            assert held[0] == i and lengths[held].sum() <= room and values[held].sum() == pytest.approx(values[i] + best[room - lengths[i]])
    assert packing_lp.plan_bins({6: 4, 4: 4}, 10).size == 4
    assert packing_lp.plan_bins({}, 10).bins == []


def planted_triplets():
    rng, found = np.random.default_rng(0), []
    while len(found) < 2000:
        a, b = rng.integers(520, 1009, 2)
        if 520 <= 2048 - a - b <= 1008:
            found.append((a, b, 2048 - a - b))
    return np.array(found).ravel()


@pytest.mark.parametrize("lengths, optimum", [(planted_triplets(), 2000), (np.random.default_rng(1).integers(400, 1100, 6000), None)])
def test_the_program_is_what_packs(lengths, optimum):
    histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True))}
    plan = packing_lp.plan_bins(histogram, 2048)
    assert plan.bound <= (optimum or plan.size) and plan.size <= 1.01 * plan.bound
    assert packing_lp.plan_bins(histogram, 2048, shares=()).size > 1.04 * plan.size  # largest first alone
    # The solution itself is rounded: most bins are its configurations, and without it largest first is what remains.
    size, need = (np.array(x, dtype=np.int64) for x in zip(*sorted(histogram.items())))
    solution, left = packing_lp.solve_program(size, need, 2048, 30, 0.05), need.copy()
    made = packing_lp.rounded(solution, left, size, 2048, 1.0, 4)
    assert (left >= 0).all() and sum(n for *_, n in made) > 0.75 * plan.size
    assert sum(n for *_, n in made + packing_lp.largest_first(left, size, 2048)) < 0.97 * packing_lp.plan_bins(histogram, 2048, shares=()).size


def test_the_solution_saves_bins():
    lengths = np.random.default_rng(7).integers(500, 1500, 20000)
    histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True))}
    assert packing_lp.plan_bins(histogram, 2048).size < packing_lp.plan_bins(histogram, 2048, shares=(0.0,)).size


def test_no_program_where_largest_first_meets_a_bound(monkeypatch):
    monkeypatch.setattr(packing_lp, "solve_program", None)
    assert packing_lp.plan_bins({1400: 500, 1100: 500}, 2048).size == 1000
    assert packing_lp.plan_bins({1024: 40, 512: 3, 2048: 2}, 2048).size == 23


def test_the_bound_sees_more_than_volume():
    """Lengths over half of a bin need one bin each, though two thirds of the volume would do."""
    plan = packing_lp.plan_bins({1400: 500, 1100: 500}, 2048)
    assert plan.size == 1000 and plan.bound >= 990


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_plans_hold_every_length(n):
    lengths = np.random.default_rng(n).integers(1, 2049, n)
    histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True))}
    plan, held = packing_lp.plan_bins(histogram, 2048), defaultdict(int)
    for size, count, times in plan.bins:
        assert size @ count <= 2048
        for a, b in zip(size.tolist(), count.tolist()):
            held[a] += b * times
    assert held == histogram
    rooms = []
    for x in sorted(lengths.tolist(), reverse=True):  # best fit, decreasing
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((fit or 2048) - x)
    assert plan.bound <= plan.size <= 1.01 * len(rooms) + 1


def check_packing(rows, ids):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, got in ids.items():
        assert sorted(pieces[doc]) == [(i, a, len(got[a : a + 2048]), zlib.crc32(np.array(got[a : a + 2048], "<u4").tobytes())) for i, a in enumerate(range(0, len(got), 2048))]
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 2048
    return len(places)


def test_packing(spark):
    texts = [*TOKENS, " ".join(word_list(4000, 3)), *[" ".join(word_list(200, 4))] * 20]
    rows = packing_lp.pack_documents(corpus(spark, texts), queries.tokenizer_path()).collect()
    ids = dict(enumerate(encoded(texts, 0)))
    n = check_packing(rows, ids)
    assert n <= -(-sum(map(len, ids.values())) // 2048) + 2
    assert packing_lp.pack_documents(corpus(spark, texts).limit(0), queries.tokenizer_path()).count() == 0


def test_packing_of_rows_that_share_an_id(spark):
    texts = ["one text", "one text", "another", None, " ".join(word_list(4000, 3))] * 2
    docs = corpus(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 5, 7).cast("long"))
    rows = packing_lp.pack_documents(docs, queries.tokenizer_path()).collect()
    want = sorted((str(d), i, a, len(got[a : a + 2048])) for d, got in zip(["7"] * 5 + ["None"] * 5, encoded(texts, 0)) for i, a in enumerate(range(0, len(got), 2048)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in places.values():
        ends = np.cumsum([0] + [n for _, n in sorted(spots)])
        assert [o for o, _ in sorted(spots)] == ends[:-1].tolist() and ends[-1] <= 2048


# 8. Substring dedup


def brute_removed(docs, k=20):
    seen, out = {}, {}
    for i, text in docs:
        w = SPACED.findall(text or "")
        hit = [False] * len(w)
        for s in range(len(w) - k + 1):
            where = seen.setdefault(tuple(w[s : s + k]), (i, s))
            if where != (i, s):
                hit[s : s + k] = [True] * k
        out[i] = (len(w), sum(hit), " ".join(x for x, h in zip(w, hit) if not h))
    return out


def test_repeated_passages(spark):
    a, b = word_list(60, 8), word_list(19, 9)
    texts = [*AWKWARD, " ".join(a), "x " + " ".join(a[5:40]) + " y", "\n".join(a[:19]), " ".join(b * 4), "z " * 100, " ".join(a), " ".join(a[:20]), *[" ".join(word_list(30, 50)) + f" t{i}" for i in range(40)], " ".join(word_list(20000, 77, 50)) * 2]
    docs = corpus(spark, texts).repartition(3)
    want = brute_removed(enumerate(texts))
    for options in ({}, {"part_bytes": 2000}, {"depth": 1, "part_bytes": 500}):
        got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.drop_repeated_passages(docs, **options).collect()}
        assert got == want
    carried = substring_dedup.drop_repeated_passages(docs, carry=("lang", "part"), untouched_as_is=True).collect()
    for r in carried:
        assert r["carried"]["part"] == 9 and r["kept"] == (want[r["doc_id"]][2] if want[r["doc_id"]][1] else texts[r["doc_id"]])
    assert substring_dedup.drop_repeated_passages(docs.limit(0)).count() == 0


def test_sketches_never_underestimate():
    """Counters of merged parts against plain counts: least over the rows, never below a window's own count."""
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 400, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (300, 40, 1, 0, 500)]
    true = defaultdict(int)
    for x in np.concatenate(parts).tolist():
        true[x] += 1
    over = 0
    for bits in (6, 10, 16):
        repeated = []
        for row in range(2):
            sums, once, full = defaultdict(int), [], []
            for x in parts:
                cells, n = substring_dedup.cell_counts(x, row, bits)
                for c, k in zip(cells.tolist(), n.tolist()):
                    sums[c] += k
                once.append(cells[n < substring_dedup.FULL])
                full.append(cells[n >= substring_dedup.FULL])
            assert substring_dedup.full_cells(once, full).tolist() == sorted(c for c, n in sums.items() if n >= 2)
            repeated.append(sums)
        codes = np.array(sorted(true), np.uint64)
        least = np.min([[repeated[row][c] for c in substring_dedup.cells_of(codes, row, bits).tolist()] for row in range(2)], axis=0)
        counts = np.array([true[x] for x in codes.tolist()])
        assert (least >= np.minimum(counts, 2)).all()
        over += ((least >= 2) != (counts >= 2)).sum() if bits == 16 else 0
    assert over < 0.02 * len(counts)


def test_rows_without_an_id_are_spread(spark):
    """Null ids are one key, but their rows go to many parts."""
    texts = [" ".join(word_list(25, i)) for i in range(60)] * 2
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    rows = substring_dedup.drop_repeated_passages(docs, part_bytes=500)
    assert {(r["n_words"], r["n_removed"]) for r in rows.collect()} == {(25, 0)}
    seen = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(seen) > 8 and max(r["count"] for r in seen) < 40


def test_repeated_ids_lose_nothing_to_each_other(spark):
    text = " ".join(word_list(30, 1))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.drop_repeated_passages(docs).collect())
    assert got == [("1", 0), ("1", 0), ("2", 30), ("None", 30)]


# 9. MinHash


def brute_components(docs, percent=75):
    sets = {}
    for i, text in docs:
        w = SPACED.findall(lower(text))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[:k]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                p, q = sorted((root(x), root(y)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_texts():
    rng = np.random.default_rng(4)
    base, out = word_list(150, 11), []
    for i in range(150):  # heavily and lightly edited copies around the similarity that counts
        w = list(base)
        for j in rng.integers(0, 150, rng.integers(1, 9)):
            w[j] = f"edit{i}x{j}"
        out.append(" ".join(w))
    chain = word_list(120, 12)
    out += [" ".join(chain[i : i + 100]) for i in range(0, 20, 4)]
    return out + [*AWKWARD, "One two", "one TWO", "a b c d e", "a b c d e", "A b c d e f", out[0], out[0].upper()]


@pytest.mark.parametrize("options", [{}, {"block": 20, "broadcast_ids": 0}])
def test_near_duplicates(spark, options):
    texts = near_texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in bbit_minhash.near_duplicates(corpus(spark, texts), **options).collect()}
    assert got == brute_components(enumerate(texts))


@pytest.mark.parametrize("top", [0, 300])
def test_bucket_rows_stay_small(spark, top):
    """A hot bucket of unlinked members, with and without a large component, meets pair by pair in rows of bounded size."""
    labels = {i: i for i in range(400)} | {1000 + i: 1000 for i in range(top)}
    rows = [(key, rep, 9, b"", [7], label) for key, least in ((7, 0), (8, 990)) for rep, label in labels.items() if least <= rep < least + 1010]
    members = spark.createDataFrame(rows + [(9, 1, 9, b"", [7], 1), (9, 2, 9, b"", [7], 2)], "key long, rep long, n int, signature binary, bands array<long>, label long")
    met = defaultdict(int)
    for r in bbit_minhash.bucket_tasks(members, 40).collect():
        assert len(r["m"]) <= 80
        for k, x in enumerate(r["m"]):
            for y in r["m"][:k]:
                if x["label"] != y["label"] and (r["left"] == r["right"] or x["first"] != y["first"]):
                    met[r["key"], *sorted((x["rep"], y["rep"]))] += 1
    want = {(key, a[1], b[1]) for key in (7, 8) for a in rows for b in rows if a[0] == b[0] == key and a[1] < b[1] and a[5] != b[5]} | {(9, 1, 2)}
    assert set(met) == want and set(met.values()) == {1}


def test_unlinked_documents_of_one_template(spark):
    rng = np.random.default_rng(8)
    base, texts = word_list(120, 21), []
    for i in range(160):  # most pairs under the similarity, a few linked ones among them
        w = list(base)
        for j in rng.choice(120, 6, replace=False):
            w[j] = f"own{i // 2 if i % 5 == 0 else i}x{j}"
        texts.append(" ".join(w))
    texts += [t + " end" for t in texts[::9]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in bbit_minhash.near_duplicates(corpus(spark, texts), block=16).collect()}
    assert got == brute_components(enumerate(texts))


def test_near_duplicate_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (9, None), (9, ""), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    rows = bbit_minhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [("2", "2", True), ("2", "2", True), ("4", "2", False), ("9", "9", True), ("9", "9", True), ("None", "None", True)]
    assert bbit_minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = bbit_minhash.drop_near_duplicates(docs.withColumn("kept", F.lit("mine")))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "2", "9", "9", "None"] and kept.columns == ["doc_id", "text", "kept"]


def test_near_duplicates_of_very_long_texts(spark):
    """Two long texts that differ in few words are linked, one that shares half of them is not."""
    base = word_list(60_000, 31, 200_000)
    edited = [f"e{i}" if i % 200 == 0 else w for i, w in enumerate(base)]
    texts = [" ".join(base), " ".join(edited), " ".join(base[:30_000] + word_list(30_000, 32, 200_000)), " ".join(base)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in bbit_minhash.near_duplicates(corpus(spark, texts)).collect()}
    assert got == brute_components(enumerate(texts)) and [got[i][1] for i in range(4)] == [0, 0, 2, 0]


def test_estimates_are_unbiased():
    family, rng = bbit_minhash.Family(28, 4, 2), np.random.default_rng(0)
    errors = []
    for _ in range(60):
        codes = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.sort(codes[:350]), np.sort(codes[50:])
        minima = family.minima(np.concatenate([a, b]), np.array([0, 350]))
        words = family.pack(minima).view(np.uint32)
        errors.append(family.estimate(words[0], words[1]) - 0.75)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 1.5 * family.slack(0.75, 1)


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = {r["node"]: r["label"] for r in bbit_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


# 10. Quality


def test_quality_on_held_out_labels(spark, sf_dir):
    rows = queries.op10_subword_quality(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def brute_features(text, grams=(3, 4)):
    """Words, pairs and character n-grams as strings, kind by kind."""
    words = SPACED.findall(text or "")
    return [words, list(zip(words, words[1:])), [f" {w} "[i : i + n] for w in words for n in grams for i in range(len(w) + 3 - n)]]


FEW = ["good words here", "bad!! bad!! bad!!", None, "né à été 漢字漢", "", "a", "x" * 3000]


def test_features_are_of_characters():
    """Equal strings get equal buckets and the same counts; borders stand at the ends of words only."""
    shown, buckets = defaultdict(set), 1 << 30
    for text in FEW:
        got = [np.concatenate([b for k, _, b in subword_quality.features(pa.array([text], pa.string()), buckets, (3, 4)) if k == kind]) for kind in range(3)]
        for mine, want in zip(got, brute_features(text)):
            assert sorted(np.unique(mine, return_counts=True)[1]) == sorted(np.unique([str(x) for x in want], return_counts=True)[1])
            if len(set(want)) == len(want) == 1:
                shown[want[0]].add(int(mine[0]))
    assert all(len(x) == 1 for x in shown.values())


def test_features_of_a_batch_are_those_of_its_texts():
    alone = [[(k, b.tolist()) for k, _, b in subword_quality.features(pa.array([t], pa.string()), 1 << 20, (3, 4))] for t in FEW]
    for n, (kind, cuts, bucket) in enumerate(subword_quality.features(pa.array(FEW, pa.string()), 1 << 20, (3, 4))):
        assert [(kind, bucket[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])] == [x[n] for x in alone]


def test_folded_scores_equal_the_model():
    texts, size = pa.array(FEW, pa.string()), 1 << 12
    bags = [subword_quality.bag(texts.slice(i, 1), size, (3, 4)) for i in range(len(FEW))]
    assert all(share.sum() == pytest.approx(1) for _, share in bags)
    model = subword_quality.fit(bags * 20, np.array([1, 0, 1, 1, 1, 1, 1] * 20), size, 6, (3, 4), 3, 0.5)
    got = subword_quality.scores(texts, model.folded(), (3, 4))
    for (index, share), score in zip(bags, got):
        logit = (share[:, None] * model.rows[index]).sum(axis=0) @ model.softmax
        assert score == pytest.approx(1 / (1 + np.exp(logit[0] - logit[1])), rel=1e-4)
    assert got[1] < got[0]


def test_fit_by_brute_force():
    """The same steps written out with one matrix product a document and no sparse rows."""
    rng, size, dim = np.random.default_rng(2), 16, 4
    bags, labels = [], rng.integers(0, 2, 9)
    for _ in labels:
        index = np.unique(rng.integers(0, size, 5))
        bags.append((index.astype(np.int32), np.full(len(index), 1 / len(index), np.float32)))
    model = subword_quality.fit(bags, labels, size, dim, (3,), 4, 0.3, seed=3)
    order = np.random.default_rng(3)
    rows, softmax = order.uniform(-1 / dim, 1 / dim, (size + 1, dim)), np.zeros((dim, 2))
    for step, i in enumerate(np.concatenate([order.permutation(9) for _ in range(4)])):
        x = np.zeros(size + 1)
        x[bags[i][0]] = bags[i][1]
        p = np.exp(x @ rows @ softmax)
        error, now = p / p.sum() - np.eye(2)[labels[i]], 0.3 * (1 - step / 36)
        back = softmax @ error
        softmax = softmax - now * np.outer(x @ rows, error)
        rows = rows - now * np.outer(x / x.max(), back)
    rows[[k for k in range(size + 1) if not any(k in b for b, _ in bags)]] = 0
    assert np.allclose(model.rows, rows, atol=1e-5) and np.allclose(model.softmax, softmax, atol=1e-5)


def test_quality_of_repeated_ids_and_long_texts(spark):
    texts = ["fine text"] * 3 + ["junk ### junk"] * 3 + ["fine " * 300_000]
    docs = corpus(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 6, F.col("doc_id") % 2).cast("long"))
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 0)], "doc_id long, quality int")
    rows = subword_quality.score_quality(docs, labels).collect()
    assert len(rows) == 7 and len({r["score"] for r in rows}) == 3 and sum(r["doc_id"] is None for r in rows) == 1


def test_quality_of_many_rows_on_one_labelled_id(spark):
    """A third of 60,000 rows on one labelled id: one bag for it, however many rows it has."""
    i = F.col("id")
    docs = spark.range(60_000).select(F.when(i % 3 == 0, 7).otherwise(i).alias("doc_id"), F.concat(F.lit("words of row "), i).alias("text"))
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (11, 1)], "doc_id long, quality int")
    fits = []
    real = subword_quality.fit
    try:
        subword_quality.fit = lambda bags, *args, **kw: fits.append(len(bags)) or real(bags, *args, **kw)
        assert subword_quality.score_quality(docs, labels, least_steps=10).count() == 60_000
    finally:
        subword_quality.fit = real
    assert fits[0] <= 3


def test_quality_edge_cases(spark):
    docs = corpus(spark, [*AWKWARD, "fine text", "junk ### junk"])
    labels = spark.createDataFrame([(9, 1, 0), (10, 0, 0), (10, None, 0), (99, 1, 0), (None, 1, 0), (8, 7, 0)], "doc_id long, quality int, toxic int")
    rows = subword_quality.score_quality(docs, labels).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    empties = {r["score"] for r in rows if not (AWKWARD + ["x", "y"])[r["doc_id"]]}
    assert len(empties) == 1
    assert {r["score"] for r in subword_quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert subword_quality.score_quality(docs.limit(0), labels).count() == 0
    assert subword_quality.keep_good_documents(docs, labels).columns == docs.columns

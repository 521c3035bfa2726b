"""Main text of web pages by tag-path ratios.

A page is read once into a tree of block elements; inline elements do not count. Elements whose tags, class words and
noise marks are equal from the root down share a tag path, a number in a trie. Over the blocks of text of a path its
length, punctuation and linked characters are summed: the path's ratio is the logarithm of mean length times one plus
mean punctuation times the share that is not linked, discounted by what its tags and class words say (a menu element or a
class ``ad`` speaks against a path, an article element or a heading for it). Names are inputs of the ratio and nothing else.

Ratios are smoothed along the page by a Gaussian whose neighbours count less in another container, and fused with the
same ratio of all text in the container, so that a headline or a one-word paragraph gets its share of what it stands in. A
path's score is the mean of its blocks' fused ratios; the page's mark is the score of the path that holds the most
text, weighed by its ratio. Paths at most ``depth`` below the mark are content. Their containers are content too: what
stands in them, or on a path that names speak for, is kept down to the lower threshold ``fill`` below the mark. Every step
is linear in the page.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import pieces

#: Elements without text of their own to show; their content up to the end tag is passed over unread.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr blink".split())
#: Elements that hold one piece of running text; any other is a container.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote ul ol dl tbody thead tfoot figure figcaption center address summary caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of the same family.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table select".split())

#: What tags and names add to the logarithm of a path's ratio: strongly against, against, in doubt, hardly against, for.
AGAINST, WORD_AGAINST, DOUBT, MIXED, FOR, HEADING = -9.0, -8.0, -4.0, -2.5, 2.5, 1.5
NOISE_TAGS = frozenset("nav footer aside form menu dialog button select option head object canvas audio video applet fieldset datalist".split())
#: Words of class, id and role values of what stands beside an article.
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot footers masthead topbar header headers
    cookie cookies consent gdpr notice notices popup popups modal overlay newsletter subscribe subscription signup login signin register
    search form share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond
    pagination pager widget widgets toolbar copyright legal disclaimer complementary contentinfo dialog alert skip hidden tracking paywall""".split()
)
#: Inside an article only these words, alone or joined with plain parts as in ad-slot-1 or comments-section, count as much as
#: outside; any other noise word there is a doubt. In an id, which may be a heading's words, few count.
PLAIN_NOISE = frozenset("ad ads adv advert adverts advertisement adsense adsbygoogle comment comments commentlist disqus share sharing social newsletter subscribe signup breadcrumb breadcrumbs pagination sidebar cookie cookies popup modal paywall promo sponsored hidden tracking".split())
PLAIN_PARTS = frozenset("section list area wrapper wrap container box bar bars button buttons slot block unit item body form links icons thread widget top bottom inline visually".split())
NOISE_ROLES = frozenset("navigation search banner complementary contentinfo dialog alertdialog".split())
ID_NOISE = frozenset("ad ads advert advertisement comment comments commentlist disqus".split())
TEXT_NOISE = frozenset("comment comments reply ad ads advert advertisement sponsored promo notice cookie cookies copyright disclaimer newsletter".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/><]*)(?P<attrs>(?:[^>\"'<]|\"[^\"]*\"|'[^']*')*+)>|<[/a-z][^>]*>|<[!?][^>]*>",
    re.I | re.S,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden\b(?!\s*=)", re.I)
WORD = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")


def plainly_noise(names: list[tuple[str, str]], tag: str) -> bool:
    """Whether whole class, id or role values mark an element inside an article as something beside it."""
    for kind, value in names:
        known = NOISE_ROLES if kind == "role" else PLAIN_NOISE if kind == "class" else ID_NOISE
        if kind == "id" and tag in HEADINGS:
            continue
        for token in value.split():
            parts = {x for x in re.split(r"[-_\d]+", token) if x}
            if token in known or parts & known and parts <= known | PLAIN_PARTS or kind == "class" and tag in ("p", "h1") and token in TEXT_NOISE:
                return True
    return False


def opinion(tag: str, attrs: str, inside: bool) -> tuple[float, str]:
    """What an element's tag and names add to its paths' ratios, and its class words as part of the path."""
    names = [(k.lower(), (a or b or c).lower()) for k, a, b, c in NAMED.findall(attrs)] if attrs else []
    words = set(WORD.findall(" ".join(v for _, v in names)))
    label = "-".join(sorted(next((v for k, v in names if k == "class"), "").split()))
    if tag in NOISE_TAGS or attrs and HIDDEN.search(attrs):
        return AGAINST, label
    if tag in ("article", "main"):
        return (WORD_AGAINST if words & TEXT_NOISE else 0.0 if inside else FOR), label
    side = HEADING if tag in HEADINGS else 0.0
    if tag in ("html", "body"):
        return side, label
    if inside:
        if words & (NOISE_WORDS | NOISE_ROLES) and plainly_noise(names, tag):
            return WORD_AGAINST, label
        return side + (DOUBT if words & NOISE_WORDS and not words & NOISE_WORDS <= {"header", "headers"} and tag not in ("p", "h1") else 0.0), label
    if tag == "header" or words & (TEXT_NOISE if tag in ("p", "h1") else NOISE_WORDS):
        # A word of many meanings beside words of another kind (legal-news, post social) leaves it to the text.
        mixed = tag != "header" and not words & TEXT_NOISE and words - NOISE_WORDS - NOISE_ROLES - PLAIN_PARTS
        return side + MIXED if mixed else WORD_AGAINST, label
    return side, label


def never_closed(m: re.Match) -> bool:
    """Whether a comment or an unread element goes on to the end of the page."""
    if m["raw"]:
        return re.search(rf"</{m['raw']}\s*>$", m[0], re.I) is None
    return m[0].startswith("<!--") and not (m[0].endswith("-->") and len(m[0]) > 6)


class Node:
    """An open block element: its path, what speaks for that path, its container, and the text of its whole subtree."""

    __slots__ = ("parent", "tag", "path", "prior", "inside", "container", "depth", "blocks", "chars", "marks", "linked", "content")

    def __init__(self, parent: Node | None, tag: str, path: int, prior: float):
        self.parent, self.tag, self.path, self.prior = parent, tag, path, prior
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.container = self if parent is None or tag not in LEAVES else parent.container
        self.depth = 0 if parent is None else parent.depth + 1
        self.blocks = self.chars = self.marks = self.linked = 0
        self.content = False


@dataclass
class Block:
    node: Node
    text: str
    marks: int
    linked: int


@dataclass
class Page:
    """Blocks in page order, elements in the order of their start tags, and the prior of every path."""

    blocks: list[Block] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)
    priors: list[float] = field(default_factory=list)


def read_page(page: str) -> Page:
    """The page's text blocks, white space inside them made one space, and their elements."""
    found, trie = Page(), {}

    def opened(parent: Node | None, tag: str, label: str, own: float) -> Node:
        key = (parent.path if parent else -1, tag, label, own)
        path = trie.setdefault(key, len(trie))
        if path == len(found.priors):
            # Against weighs once however many elements say it; a heading's and a doubt's own part end with them.
            above = found.priors[parent.path] if parent else 0.0
            lasting = own if own in (FOR, AGAINST, WORD_AGAINST, DOUBT) else 0.0
            found.priors.append(min(above, lasting) if lasting < 0 and above < 0 else above + lasting)
        node = Node(parent, tag, path, found.priors[path])
        found.nodes.append(node)
        return node

    node = opened(None, "", "", 0.0)
    root, open_tags = node, {}
    parts: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.blocks.append(Block(node, text, len(PUNCTUATION.findall(text)), min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            open_tags[node.tag] -= 1
            node = node.parent

    at, end, open_ended = 0, page.rfind(">") + 1, page.rfind("<!--") > page.rfind(">")
    for m in TOKEN.finditer(page, 0, end):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            open_ended = at == end and never_closed(m)
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m["close"] else 1
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        if m["close"]:
            if open_tags.get(tag):  # end tags of nothing that is open are passed over
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
                in_link = 0
            continue
        if node.tag == "p" or node.tag in HEADINGS and tag in HEADINGS:
            leave(node.parent)
        family = SIBLINGS.get(tag, ())
        if any(open_tags.get(x) for x in family):
            up = node
            while up is not root and up.tag not in SCOPES and up.tag not in family:
                up = up.parent
            if up.tag in family:
                while up.parent.tag in family:
                    up = up.parent
                leave(up.parent)
        own, label = opinion(tag, m["attrs"], node.inside)
        node = opened(node, tag, label, own)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    # After the last > there are no tags; a comment or script that is never closed reaches to the end.
    if not open_ended:
        say(page[at:])
    flush()
    for b in found.blocks:
        n = b.node
        n.blocks, n.chars, n.marks, n.linked = n.blocks + 1, n.chars + len(b.text), n.marks + b.marks, n.linked + b.linked
    for n in reversed(found.nodes[1:]):
        up = n.parent
        up.blocks, up.chars, up.marks, up.linked = up.blocks + n.blocks, up.chars + n.chars, up.marks + n.marks, up.linked + n.linked
    return found


def text_ratio(n: int, chars: int, marks: int, linked: int, prior: float) -> float:
    """Mean length times one plus mean punctuation times the share without links, discounted by the prior, on a log scale."""
    return math.log1p(chars / n) + math.log1p(marks / n) + math.log(1 - 0.95 * linked / chars) + prior


def path_ratios(page: Page) -> list[float]:
    """Of every path with text its ratio and what speaks for it."""
    sums = [[0, 0, 0, 0] for _ in page.priors]
    headings = [False] * len(sums)
    for b in page.blocks:
        t = sums[b.node.path]
        for i, x in enumerate((1, len(b.text), b.marks, b.linked)):
            t[i] += x
        headings[b.node.path] = b.node.tag in HEADINGS
    return [text_ratio(*t, prior + HEADING * h) if t[0] else 0.0 for t, prior, h in zip(sums, page.priors, headings)]


def smooth(values: list[float], containers: list[int], radius: int = 2, apart: float = 0.1) -> list[float]:
    """Gaussian means along the page, in which neighbours from another container weigh ``apart`` as much."""
    weights = [math.exp(-(k * k) / 2) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - radius), min(len(values), i + radius + 1)):
            w = weights[j - i + radius] * (1.0 if containers[j] == containers[i] else apart)
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def fused_ratios(page: Page, ratios: list[float]) -> list[float]:
    """For every block the mean of its path's ratio smoothed along the page and of the ratio of all text in its container.

    Neighbours give their text's part alone; what names say of a block's own path is never smoothed away.
    """
    priors = page.priors
    smoothed = smooth([ratios[b.node.path] - priors[b.node.path] for b in page.blocks], [id(b.node.container) for b in page.blocks])
    out = []
    for b, s in zip(page.blocks, smoothed):
        c, prior = b.node.container, priors[b.node.path]
        out.append((s + prior + text_ratio(1, c.chars, c.marks, c.linked, prior)) / 2)
    return out


def path_scores(page: Page, fused: list[float]) -> dict[int, float]:
    """The mean of the fused ratios of every path's blocks, weighed by their length."""
    sums: dict[int, list[float]] = {}
    for b, f in zip(page.blocks, fused):
        t = sums.setdefault(b.node.path, [0.0, 0.0])
        t[0] += f * len(b.text)
        t[1] += len(b.text)
    return {p: a / n for p, (a, n) in sums.items()}


def page_mark(page: Page, scores: dict[int, float]) -> float:
    """The score of the path with the greatest product of text and score; of none that speaks for content, the best."""
    chars: dict[int, int] = {}
    for b in page.blocks:
        chars[b.node.path] = chars.get(b.node.path, 0) + len(b.text)
    top = max(scores, key=lambda p: (max(scores[p], 0.0) * chars[p], scores[p], -p))
    return scores[top]


def content_blocks(page: Page, depth: float = 2.0, fill: float = 7.0) -> list[Block]:
    """Blocks on paths that reach the threshold; in their containers, and on paths that names speak for, the lower one does."""
    if not page.blocks:
        return []
    ratios = path_ratios(page)
    scores = path_scores(page, fused_ratios(page, ratios))
    mark = page_mark(page, scores)
    for b in page.blocks:
        if scores[b.node.path] >= mark - depth:
            b.node.container.content = True
    for n in page.nodes[1:]:
        n.content = n.content or n.parent.content
    return [b for b in page.blocks if scores[b.node.path] >= mark - (fill if b.node.content or b.node.prior > 0 else depth)]


def main_text(page: str | None, depth: float = 2.0, fill: float = 7.0) -> str:
    """The page's content blocks joined by one space; an empty page has none."""
    return " ".join(b.text for b in content_blocks(read_page(page), depth, fill)) if page else ""


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: float = 2.0, fill: float = 7.0) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) for every page.

    The whole html is read. Null and empty html give an empty text. Character references are decoded, white space inside
    a block becomes one space, blocks are joined in page order by one space; repeated rows and rows without an id stay as
    many as they are. Broken markup is read as browsers would roughly do: open paragraphs end at the next block, an
    unclosed comment or script reaches to the end. Other columns are ignored; an empty table gives no rows.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, 4 << 20):
            texts = [main_text(page, depth, fill) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    named = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return named.mapInArrow(extract, f"page_id {named.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")

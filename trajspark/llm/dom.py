"""A page as a preorder list of block nodes and text runs, for extraction: a small tolerant reader of HTML."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

# Tag groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are never text of a page.
SKIPPED = frozenset("script style noscript template svg iframe object canvas select textarea button head title audio video".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody tfoot tr td th blockquote pre figure figcaption address details summary dialog center menu legend".split())
CLOSES_P = BLOCKS - frozenset("td th tr thead tbody tfoot li dt dd legend html body".split())
#: Opening one of these ends an open one of the same list, up to the list's bound.
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
GROUPS = ("article main", "section div center", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset label legend", "table thead tbody tfoot tr td th", "blockquote pre figure figcaption", "html body", "#text")
GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags.split()}
#: Attribute tokens by what they tell; a token counts if it begins with a stem, or equals a short one.
TOKENS = {
    "content": "content article post entry story main text body prose",
    "menu": "nav navbar navigation menu breadcrumb toc tabs pager pagination",
    "head": "header masthead topbar logo branding",
    "foot": "footer copyright legal colophon",
    "side": "sidebar side rail related widget recommend trending popular",
    "ad": "ad ads advert adsbygoogle banner sponsor promo dfp",
    "notice": "notice cookie consent gdpr alert popup modal overlay disclaimer message",
    "comment": "comment comments disqus reply replies respond discussion feedback",
    "form": "form search login signup subscribe newsletter input",
    "share": "share social follow like",
}
AD = 1 << list(TOKENS).index("ad")
STEMS = [(stem, k) for k, stems in enumerate(TOKENS.values()) for stem in stems.split()]
#: A tag ends at the first ">" outside quotes; where a quote is never closed, at the first ">" at all or the end of the page.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|data-y|data-n)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_known: dict[str, int] = {}


def attribute_bits(attributes: str) -> int:
    """Bit k: a token of class, id or role is of kind k of TOKENS; the bit after: hidden; the ones after that: training marks, main and not."""
    if attributes in _known:
        return _known[attributes]
    bits = 0
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            bits |= 1 << len(TOKENS)
        elif name.lower() == "data-y":
            bits |= 1 << len(TOKENS) + 1
        elif name.lower() == "data-n":
            bits |= 1 << len(TOKENS) + 2
        for token in map(str.lower, WORD.findall(value)):
            for stem, k in STEMS:
                if token == stem or len(stem) > 3 and token.startswith(stem):
                    bits |= 1 << k
    if len(_known) < 20_000:
        _known[attributes] = bits
    return bits


@dataclass
class Page:
    """Nodes in preorder; a text run is a node of the group "#text". end[i] is the first node after i's subtree."""

    group: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


def read(source: str) -> Page:
    """The page's blocks and text runs. Unclosed and misplaced tags, truncated pages and pages without a body all give a tree; never fails."""
    page = Page()
    group, parent, depth, bits, above, tags, links, texts = page.group, page.parent, page.depth, page.bits, page.above, page.tags, page.links, page.text
    stack: list[tuple[str, int]] = []  # open elements: tag, node (-1: inline)
    open_blocks: list[int] = []  # places of the blocks in the stack
    places: dict[str, list[int]] = {}  # places of each tag in the stack
    node, run, run_links, in_link, inline = -1, [], 0, 0, 0

    def add(g: int, b: int) -> int:
        group.append(g)
        parent.append(node)
        depth.append(depth[node] + 1 if node >= 0 else 0)
        bits.append(b)
        above.append((above[node] | bits[node] | 1 << 16 + group[node]) if node >= 0 else 0)
        tags.append(1)
        links.append(0)
        texts.append("")
        return len(group) - 1

    def flush() -> None:
        nonlocal run, run_links, inline
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                i = add(GROUP["#text"], 0)
                texts[i], links[i], tags[i] = text, run_links, inline
            run, run_links, inline = [], 0, 0

    def close(to: int) -> None:
        nonlocal node, in_link
        for tag, own in stack[to:]:
            if own >= 0:
                flush()
            elif tag == "a":
                in_link -= 1
            places[tag].pop()
        del stack[to:]
        while open_blocks and open_blocks[-1] >= to:
            open_blocks.pop()
        node = stack[open_blocks[-1]][1] if open_blocks else -1

    def last(tags_: Iterable[str]) -> int:
        """The place in the stack of the last open one of these tags; each tag's places are kept, so that nothing walks the stack."""
        return max((places[t][-1] for t in tags_ if places.get(t)), default=-1)

    def push(tag: str, own: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if own >= 0:
            open_blocks.append(len(stack))
        stack.append((tag, own))

    at, size = 0, len(source)
    while at < size:
        m = MARKUP.search(source, at)
        upto = m.start() if m else size
        if upto > at:
            piece = source[at:upto]
            run.append(piece)
            if in_link > 0:
                run_links += len(piece)
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        tag, attributes = name.lower(), m[3].removesuffix(">")
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in SKIPPED:
            if attributes.endswith("/") and tag not in RAW:
                continue
            if tag == "head":  # its children are all skipped or void
                continue
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = stop.end() if stop else size
            continue
        if tag in VOID:
            run.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS or tag == "ins" and attribute_bits(attributes) & AD:  # inserted text is inline, but adverts use the tag too
            flush()
            if tag in CLOSES_P and open_blocks and stack[open_blocks[-1]][0] == "p":
                close(open_blocks[-1])
            if tag in SIBLINGS:
                same, bound = SIBLINGS[tag]
                if (at_ := last(same.split())) > last(bound):
                    close(at_)
            node = add(GROUP.get(tag, 1), attribute_bits(attributes) if attributes else 0)
            push(tag, node)
        else:
            inline += 1
            if tag == "a":
                in_link += 1
            push(tag, -1)
    flush()
    ends = [i + 1 for i in range(len(group))]
    for i in range(len(group) - 1, 0, -1):
        if parent[i] >= 0 and ends[i] > ends[parent[i]]:
            ends[parent[i]] = ends[i]
    page.end = ends
    return page


def features(pages: list[Page]) -> np.ndarray:
    """One row for each node of the pages, in order."""
    sizes = [len(p.group) for p in pages]
    offset = np.concatenate([[0], np.cumsum(sizes)])
    n = int(offset[-1])
    page_of = np.repeat(np.arange(len(pages)), sizes)
    start = offset[:-1][page_of]

    def all_of(name: str) -> np.ndarray:
        return np.fromiter((x for p in pages for x in getattr(p, name)), dtype=np.int64, count=n)

    group, parent, depth, bits, above = (all_of(k) for k in ("group", "parent", "depth", "bits", "above"))
    end = all_of("end") + start
    texts = [t for p in pages for t in p.text]
    chars = np.fromiter(map(len, texts), dtype=float, count=n)
    words = np.fromiter((t.count(" ") + 1 if t else 0 for t in texts), dtype=float, count=n)
    stops = np.fromiter((t.count(". ") + t.count(", ") + t.endswith((".", "!", "?")) for t in texts), dtype=float, count=n)
    signs = np.fromiter(("©" in t or "|" in t for t in texts), dtype=float, count=n)
    index = np.arange(n)

    def subtree(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0.0], np.cumsum(x)])
        return c[end] - c[index]

    is_text = (group == GROUP["#text"]).astype(float)
    all_chars, all_words, all_stops, all_links = subtree(chars), subtree(words), subtree(stops), subtree(all_of("links").astype(float))
    all_tags, all_runs = subtree(all_of("tags").astype(float)), subtree(is_text)
    up = np.where(parent >= 0, parent + start, index)
    children = np.bincount(up[parent >= 0], minlength=n).astype(float)
    page_chars = np.bincount(page_of, weights=chars, minlength=len(pages))[page_of]
    before = np.concatenate([[0.0], np.cumsum(chars)])
    first = np.full(n, 0.0)
    inner = parent >= 0
    first[inner] = (before[index] - before[up])[inner]  # text of earlier siblings
    columns = [
        depth,
        np.log1p(all_chars),
        np.log1p(all_words / np.maximum(1, all_runs)),
        all_chars / np.maximum(1, all_tags),
        all_links / np.maximum(1, all_chars),
        all_stops / np.maximum(1, all_words),
        all_chars / np.maximum(1, page_chars),
        all_runs,
        subtree(signs) > 0,
        children,
        children[up],
        all_chars / np.maximum(1, all_chars[up]),
        first / np.maximum(1, all_chars[up]),
        np.log1p(all_chars[up]),
        all_links[up] / np.maximum(1, all_chars[up]),
        all_stops[up] / np.maximum(1, all_words[up]),
        all_chars[up] / np.maximum(1, all_tags[up]),
        (before[index] - before[start]) / np.maximum(1, page_chars),
        (index - start) / np.maximum(1, np.array(sizes)[page_of]),
        subtree((group == GROUP["h1"]).astype(float)) > 0,
        subtree((group == GROUP["p"]).astype(float)),
        group[up],
    ]
    columns += [group == k for k in range(len(GROUPS))]
    columns += [(bits >> k) & 1 for k in range(len(TOKENS) + 1)] + [(above >> k) & 1 for k in range(len(TOKENS) + 1)]
    columns += [(above >> 16 + k) & 1 for k in range(len(GROUPS))]
    return np.stack([np.asarray(c, dtype=np.float32) for c in columns], axis=1)


def marked(page: Page) -> list[bool]:
    """For training pages: whether a node holds or is text marked as main and not as foreign to it."""
    mark, off = 1 << len(TOKENS) + 1, 1 << len(TOKENS) + 2
    own = [g == GROUP["#text"] and bool(a & mark) and not a & off for g, a in zip(page.group, page.above, strict=True)]
    for i in range(len(own) - 1, 0, -1):
        if own[i] and page.parent[i] >= 0:
            own[page.parent[i]] = True
    return own

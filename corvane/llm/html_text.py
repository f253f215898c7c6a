"""Main text of web pages by wrapper induction.

Every page becomes a DOM tree; like siblings are folded into one node.  The pages of a host are aligned by simple tree
matching to one reference page of that host, so a node of the reference, with all nodes of all pages that match it, is
a slot.  Spark adds up each slot's texts over the whole host: how much text and link text it holds, and whether nearly all
pages share one text.  Pages with the same article count once, so an article that a host repeats is no template.  The wrapper of
a host is the reference with those figures.

A page is aligned to its host's wrapper again and read through it.  From the root, the wrapper goes down to the region that
holds most of the varying text that is no link; what it passes on the way is judged slot by slot: menus are slots of links,
site headers and footers slots of one text, adverts and the like bare text beside a region of paragraphs.  The page's own
marks (roles, classes, article and main elements) only break ties between varying slots.  Inside the region all text stays but
for elements that HTML itself sets apart (forms, asides, scripts), boxes that the host marks alike on most of its pages, and
a text that ends the region on nearly all of them.

Pages of a host are dealt into cohorts of bounded size; only figures and the wrapper, never pages, meet by host.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import id_column, read_table, restore_id, stage_table

#: Pages of a cohort, about.
COHORT = 64
#: Different articles of a host that must have a text in a slot, and the share of those with the slot, for it to be template.
LEAST_PAGES, AGREE = 4, 0.8
#: Share of links from which a slot is a menu, share of pages from which a marked box is a part of the host, and share of the main region's text from which a sibling is one too.
LINKS, STRUCTURAL, SIBLING = 0.5, 0.5, 0.15
#: Children of a folded node that keep their order; of more, like ones are folded wherever they stand.
WIDE = 64

# Names of HTML elements, words in roles, classes and ids that mark regions outside the article, words that mark a lead, and words that say nothing.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "noembed", "noframes", "xmp"}
_SKIP = _RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video", "map", "datalist"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "figcaption", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "html", "body", "article", "main", "section", "div", "nav", "footer", "aside"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "comment", "comments", "reply", "replies", "respond", "disqus",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "newsletter", "subscribe", "signup", "related", "share",
    "sharing", "social", "popup", "modal", "overlay", "widget", "pagination", "pager", "toolbar", "login", "search", "copyright", "disclaimer", "skip",
}
_LEADS = {"lead", "lede", "intro", "summary", "abstract", "subtitle", "standfirst", "dek", "content", "body", "text", "story", "article", "post", "entry"}
_FILLERS = {"box", "bar", "block", "button", "buttons", "link", "links", "list", "container", "wrapper", "wrap", "area", "section", "inner", "outer", "top", "bottom", "left", "right", "slot", "unit", "panel", "item", "items", "site", "page", "post", "entry", "article", "main", "global", "primary", "secondary", "google"}
_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "figure", "figcaption", "address", "details", "summary", "center", "hr"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*\Z", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}
_NAMES = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)")


class Node:
    __slots__ = ("children", "lead", "mark", "name", "outside", "parent", "region")

    def __init__(self, name: str, parent: Node | None, outside: bool = False, region: bool = False, mark: str = "", lead: bool = False):
        self.name, self.parent, self.outside, self.region, self.mark, self.lead = name, parent, outside, region, mark, lead
        self.children: list[Node | str] = []


def _outside(tag: str, attrs: str, inside_article: bool) -> bool:
    """Whether HTML itself sets an element apart from the article: by its name or role, or as hidden."""
    if tag in _SKIP or tag == "header" and not inside_article:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for name, value in _ATTR.findall(attrs):
        value, name = value.strip("\"'").lower(), name.lower()
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def _marks(tag: str, attrs: str) -> tuple[str, bool]:
    """(mark, lead): the class or id of a box that says nothing but that it is no article, if there is one, and whether one says that it is."""
    if not attrs or tag in _TEXT or tag in ("html", "body"):
        return "", False
    mark, lead = "", False
    for name, value in _ATTR.findall(attrs):
        if name.lower() in ("class", "id"):
            for token in value.strip("\"'").lower().split():
                words = {w for w in re.split(r"[^a-z]+", token) if w}
                if not _MARKS.isdisjoint(words) and words <= _MARKS | _FILLERS and (tag not in ("article", "main") or "comment" in token):
                    mark = mark or f"{tag} {token}"
                lead = lead or not _LEADS.isdisjoint(words)
    return mark, lead and not mark


def _mark_slot(mark: str) -> int:
    """The number under which a host counts its pages with a mark, wherever it stands: below those of slots."""
    return -1 - (zlib.crc32(mark.encode()) & 0x3FFFFFFF)


def parse(text: str) -> Node:
    """A tree of the page; end tags that HTML lets authors leave out are put in."""
    root = Node("#page", None)
    here, at, n, opened = root, 0, len(text), Counter()
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            here.children.append(text[at:])
            break
        if m.start() > at:
            here.children.append(text[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag]:  # of the open elements, those up to this one close
                while here.name != tag:
                    opened[here.name] -= 1
                    here = here.parent
                opened[tag] -= 1
                here = here.parent
            continue
        if tag in _RAW:
            if not m[3].endswith("/"):
                end = _RAW_END[tag].search(text, at)
                at = end.end() if end else n
            continue
        closes = {"p"} if tag in _ENDS_P else _ENDS.get(tag)
        if closes:
            up = here
            while up is not None and up.name not in closes and up.name not in _SCOPE:
                up = up.parent
            if up is not None and up.name in closes:
                last = up.parent if tag == "tr" and up.name in ("td", "th") and up.parent.name == "tr" else up
                while here is not last:
                    opened[here.name] -= 1
                    here = here.parent
                opened[last.name] -= 1
                here = last.parent
        node = Node(tag, here, here.outside or _outside(tag, m[3], here.region), here.region or tag in ("article", "main"), *_marks(tag, m[3]))
        here.children.append(node)
        if tag not in _VOID:
            here = node
            opened[tag] += 1
    return root


def _spaced(text: str) -> str:
    """text, trimmed, with one space for any white space inside."""
    return " ".join(text.split())


def blocks(node: Node, keep) -> Iterator[tuple[Node, str]]:
    """(element, text) of every block in page order; keep(element) tells whether its own text counts."""
    own: list[str] = []
    holder = [node]

    def flush() -> Iterator[tuple[Node, str]]:
        text = _spaced(entities.unescape("".join(own)))
        own.clear()
        if text:
            yield holder[0], text

    stack = [(node, iter(node.children))]
    while stack:
        element, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                if keep(element):
                    if not own:
                        holder[0] = element
                    own.append(child)
                continue
            if child.name == "br":
                own.append(" ")
                continue
            if child.name not in _INLINE:
                yield from flush()
            stack.append((child, iter(child.children)))
            break
        else:
            stack.pop()
            if element.name not in _INLINE:
                yield from flush()
    yield from flush()


# ---------------------------------------------------------------- alignment


class Folded:
    """A node of the folded tree: like siblings are one node with all their elements."""

    __slots__ = ("children", "elements", "key", "name")

    def __init__(self, key: str, elements: list[Node]):
        self.key, self.name, self.elements = key, elements[0].name, elements
        self.children: list[Folded] = []


def _key(e: Node) -> str:
    """What like siblings have in common: name, marks, and for a box whether it holds text elements, other boxes or bare text."""
    if e.name in _TEXT:
        return e.name + "!" * e.outside
    names = {c.name for c in e.children if not isinstance(c, str) and c.name not in _INLINE}
    return f"{e.name}{'!' * e.outside}{'?' * bool(e.mark)}:{'text' if names & _TEXT else 'boxes' if names else 'bare'}"


def _merged(nodes: list[Folded]) -> list[Folded]:
    found: dict[str, Folded] = {}
    for f in nodes:
        if f.key in found:
            found[f.key].elements += f.elements
        else:
            found[f.key] = f
    return list(found.values())


def fold(root: Node) -> Folded:
    """Text elements of a name are one node wherever they stand, boxes if three or more alike are in a row; a node has WIDE children or few more."""
    top = Folded(root.name, [root])
    stack = [top]
    while stack:
        out = stack.pop()
        texts: dict[str, Folded] = {}
        for e in out.elements:
            run: list[Folded] = []
            for c in e.children:
                if isinstance(c, str) or c.name in _INLINE:
                    continue
                key = _key(c)
                if c.name in _TEXT:
                    if key in texts:
                        texts[key].elements.append(c)
                        continue
                    texts[key] = Folded(key, [c])
                    out.children.append(texts[key])
                elif run and run[0].key == key:
                    if len(run) == 2:  # the third of a row: records
                        run[0].elements += run.pop().elements
                        out.children.pop()
                        run[0].elements.append(c)
                        run = [run[0]]
                    elif len(run[0].elements) > 1:
                        run[0].elements.append(c)
                    else:
                        run.append(Folded(key, [c]))
                        out.children.append(run[1])
                    continue
                else:
                    run = [Folded(key, [c])]
                    out.children.append(run[0])
                    continue
                run = []
        if len(out.elements) > 1 or len(out.children) > WIDE:
            out.children = _merged(out.children)
        stack += out.children
    return top


def match(a: Folded, b: Folded) -> dict:
    """Simple tree matching: the tables of the largest order-keeping matches of the pairs of nodes that can meet.

    table[i][j] counts the nodes matched between the first i children of the one and the first j of the other.
    """
    tables: dict[tuple[int, int], list[list[int]]] = {}
    stack = [(a, b, False)] if a.key == b.key else []
    while stack:
        x, y, ready = stack.pop()
        if (id(x), id(y)) in tables:
            continue
        if not ready:
            stack.append((x, y, True))
            stack += [(c, d, False) for c in x.children for d in y.children if c.key == d.key]
            continue
        table = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
        for i, c in enumerate(x.children, 1):
            for j, d in enumerate(y.children, 1):
                found = tables[id(c), id(d)][-1][-1] + 1 if c.key == d.key else 0
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + found)
        tables[id(x), id(y)] = table
    return tables


def align(a: Folded, b: Folded) -> Iterator[tuple[Folded, Folded]]:
    """The node pairs of the largest match."""
    tables = match(a, b)
    stack = [(a, b)] if tables else []
    while stack:
        x, y = stack.pop()
        yield x, y
        table = tables[id(x), id(y)]
        i, j = len(x.children), len(y.children)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                stack.append((x.children[i - 1], y.children[j - 1]))
                i, j = i - 1, j - 1


def _own_text(e: Node) -> tuple[str, int]:
    """(text, characters of it in links) of an element without that of its blocks."""
    parts, links, stack = [], 0, [(iter(e.children), e.name == "a")]
    while stack:
        rest, linked = stack[-1]
        for c in rest:
            if isinstance(c, str):
                parts.append(c)
                links += linked and len(_spaced(entities.unescape(c)))
            elif c.name in _INLINE and c.name != "br":
                stack.append((iter(c.children), linked or c.name == "a"))
                break
            else:
                parts.append(" ")
        else:
            stack.pop()
    return _spaced(entities.unescape("".join(parts))), links


def slots(reference: Folded) -> dict[int, int]:
    """Numbers of the reference's nodes, in page order."""
    out, stack = {}, [reference]
    while stack:
        f = stack.pop()
        out[id(f)] = len(out)
        stack += reversed(f.children)
    return out


class Seen(NamedTuple):
    """What a page has in a slot: its nodes, the digest of their text (empty if there is none), characters, and those in links."""

    slot: int
    node: Folded
    digest: bytes
    mass: int
    link: int


def slot_texts(reference: Folded, tree: Folded) -> list[Seen]:
    """The nodes of a page that match the reference."""
    number, out = slots(reference), []
    for x, y in align(reference, tree):
        texts = [_own_text(e) for e in y.elements]
        text = "\n".join(t for t, _ in texts if t)
        out.append(Seen(number[id(x)], y, _digest(text) if text else b"", len(text), sum(n for _, n in texts)))
    return out


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()


class Slot(NamedTuple):
    """A slot over its host: pages with it, the one text of nearly all different articles if there is one, characters, and those in links."""

    pages: int
    template: bytes
    mass: int
    link: int


def induced(pages: list[str], reference: Folded) -> Counter:
    """Sums of (pages, mass, link) by (slot, digest, article), as Counter of those and a fourth field; an article is known by its heaviest texts that are no links, over half of those together."""
    out: Counter = Counter()
    for p in pages:
        root = parse(p)
        seen = slot_texts(reference, fold(root))
        texts = sorted(((x.mass - x.link, x.digest) for x in seen if x.digest and x.link <= LINKS * x.mass and not x.node.elements[0].outside), reverse=True)
        held, article, half = 0, b"", sum(n for n, _ in texts) / 2
        for n, digest in texts:
            if held <= half:
                held, article = held + n, article + digest
        article = hashlib.blake2b(article, digest_size=16).digest()
        for x in seen:
            for k, v in enumerate((1, x.mass, x.link)):
                out[x.slot, x.digest, article, k] += v
        for mark in {_mark_slot(e.mark) for e in _elements(root) if e.mark}:
            out[mark, b"", article, 0] += 1
    return out


def decide(sums: Counter) -> dict[int, Slot]:
    """The slots of a host from its sums."""
    articles, totals = {}, Counter()
    for (slot, digest, article, k), v in sums.items():
        totals[slot, k] += v
        if k == 0:
            articles.setdefault(slot, Counter())[digest] += 1
    out = {}
    for slot, own in articles.items():
        n, digest = max(((n, d) for d, n in own.items() if d), default=(0, b""))
        out[slot] = Slot(totals[slot, 0], digest if n >= max(LEAST_PAGES, AGREE * sum(own.values())) else b"", totals[slot, 1], totals[slot, 2])
    return out


# ---------------------------------------------------------------- the wrapper


PATH, REGION, TEXT, OUT = "path", "region", "text", "out"


def _after(top: Folded) -> list[Folded]:
    """All nodes, children before parents."""
    out, stack = [], [top]
    while stack:
        f = stack.pop()
        out.append(f)
        stack += f.children
    return out[::-1]


def choose(reference: Folded, seen: dict[int, Slot]) -> dict[int, str]:
    """Of the slots above and beside the main region what becomes of them; those inside it have no entry.

    PATH leads to the region and keeps its own bare text if that varies, REGION stays whole, TEXT is a text element beside it
    that stays, OUT goes.
    """
    number, nothing = slots(reference), Slot(0, b"", 0, 0)
    own, whole, marked = {}, {}, {}
    for f in _after(reference):
        x = seen.get(number[id(f)], nothing)
        idle = bool(x.template) or f.elements[0].outside or x.link > LINKS * x.mass
        own[id(f)] = 0 if idle else x.mass - x.link
        whole[id(f)] = 0 if f.elements[0].outside else own[id(f)] + sum(whole[id(c)] for c in f.children)
        marked[id(f)] = f.name in ("article", "main") and not f.elements[0].outside and not f.elements[0].mark or any(marked[id(c)] for c in f.children)
    prose = lambda f: not f.key.endswith(":bare")
    value = lambda f: whole[id(f)] * (2 if marked[id(f)] else 1) * (0.25 if f.elements[0].mark else 1) * (1 if prose(f) else 0.1)
    out, node = {}, reference
    while True:
        texts, boxes = [c for c in node.children if c.name in _TEXT], [c for c in node.children if c.name not in _TEXT]
        able = [c for c in boxes if whole[id(c)] > 0]
        best = max(able, key=value, default=None)
        if best is None or own[id(node)] + sum(whole[id(c)] for c in texts) >= value(best) and not marked[id(best)]:
            out[number[id(node)]] = REGION
            return out
        out[number[id(node)]] = PATH
        for c in texts:
            out[number[id(c)]] = TEXT if whole[id(c)] > 0 and not marked[id(best)] else OUT
        for c in boxes:
            if c is not best:
                second = c.elements[0]
                if marked[id(best)]:
                    stays = marked[id(c)]
                elif not prose(c) and prose(best):
                    stays = second.lead
                else:
                    stays = whole[id(c)] >= SIBLING * whole[id(best)] or prose(c)
                out[number[id(c)]] = REGION if stays and whole[id(c)] > 0 and not second.mark and not second.outside else OUT
        node = best


def _elements(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        e = stack.pop()
        yield e
        stack += [c for c in reversed(e.children) if not isinstance(c, str)]


def read(page: str, reference: Folded, seen: dict[int, Slot], chosen: dict[int, str] | None = None) -> tuple[str, int]:
    """(main text, slots that its blocks came from) of a page, read through a wrapper."""
    chosen, root = choose(reference, seen) if chosen is None else chosen, parse(page)
    hosted = seen[0].pages if 0 in seen else 0
    number, inside = slots(reference), {}  # the slot of each aligned element
    for x, y in align(reference, fold(root)):
        for e in y.elements:
            inside[id(e)] = number[id(x)]
    region = any(e.region and not e.outside and not e.mark for e in _elements(root))
    state: dict[int, str] = {}
    for e in _elements(root):
        up, x = state[id(e.parent)] if e.parent is not None else PATH, inside.get(id(e))
        if e.outside or up == OUT:
            now = OUT
        elif up in (REGION, TEXT):
            # a marked box is no article if the host has it on most pages; with few pages the mark has to do
            now = OUT if e.mark and (hosted < LEAST_PAGES or _mark_slot(e.mark) in seen and seen[_mark_slot(e.mark)].pages >= STRUCTURAL * hosted) else up
        elif e.name in _INLINE:
            now = up
        elif x in chosen:
            now = chosen[x]
        elif e.name in _TEXT or e.name in ("html", "body"):  # on the way to the region, and on no other page of the host
            now = PATH if e.name in ("html", "body") else OUT if region and not e.region else TEXT
        else:
            holds = _key(e)
            now = PATH if holds.endswith(":boxes") else REGION if not e.mark and (e.region if region else holds.endswith(":text") or e.lead) else OUT
        state[id(e)] = now
    bare = {s for s, label in chosen.items() if label == PATH and s in seen and not seen[s].template and seen[s].link <= LINKS * seen[s].mass}

    def keeps(e: Node) -> bool:
        now = state[id(e)]
        while now == PATH and e.name in _INLINE and e.parent is not None:
            e = e.parent
        return now in (REGION, TEXT) or now == PATH and not region and (id(e) not in inside or inside[id(e)] in bare)

    def holder(e: Node) -> int | None:
        while e is not None and id(e) not in inside:  # inline elements and nodes that match nothing belong to what holds them
            e = e.parent
        return inside.get(id(e)) if e is not None else None

    found = [(holder(e), t) for e, t in blocks(root, keeps)]
    while len(found) > 1 and found[-1][0] in seen and seen[found[-1][0]].template == _digest(found[-1][1]):
        found.pop()  # what ends nearly all articles of the host
    return "\n".join(t for _, t in found), len({x for x, _ in found if x is not None})


def extract(pages: list[str]) -> list[str]:
    """Main texts of the pages of one host, on one machine."""
    if not pages:
        return []
    reference = fold(parse(max(pages, key=lambda p: (len({t.lower() for t in _NAMES.findall(p)}), -len(p)))))
    seen = decide(induced(list(dict.fromkeys(pages)), reference))
    return [read(p, reference, seen)[0] for p in pages]


_FIGURES = ["n", "mass", "link"]


def _induce(key: tuple, pages: pd.DataFrame, wrapper: pd.DataFrame) -> pd.DataFrame:
    rows: dict[tuple, list[int]] = {}
    if not pages.empty:
        for (slot, digest, article, k), v in induced(list(pages["html"].unique()), fold(parse(wrapper["reference"].iloc[0]))).items():
            rows.setdefault((slot, digest, article), [0, 0, 0])[k] = v
    return pd.DataFrame([(key[0], *k, *v) for k, v in rows.items()], columns=["_host", "slot", "digest", "article", *_FIGURES])


def _read(pages: pd.DataFrame, wrapper: pd.DataFrame) -> pd.DataFrame:
    if pages.empty:
        return pages[["_id", "url"]].assign(text=pages["url"], n_chars=pages["_id"], n_slots=pages["_id"])  # a cohort of no pages
    reference, found = fold(parse(wrapper["reference"].iloc[0])), wrapper["slots"].iloc[0]
    seen = {x["slot"]: Slot(x["pages"], bytes(x["template"]), x["mass"], x["link"]) for x in found} if found is not None else {}
    chosen = choose(reference, seen)
    done = {p: read(p, reference, seen, chosen) for p in pages["html"].unique()}
    texts = [done[p] for p in pages["html"]]
    return pd.DataFrame({"_id": pages["_id"].to_numpy(), "url": pages["url"].to_numpy(), "text": [t for t, _ in texts], "n_chars": [len(t) for t, _ in texts], "n_slots": [n for _, n in texts]})


def page_texts(pages: DataFrame, cohort: int = COHORT) -> DataFrame:
    """(page_id, url, text, n_chars, n_slots) of every row; n_slots counts the wrapper's slots that the text came from.

    A null or empty html has an empty text; a null page_id or url stays null, and pages with no host are those of an
    empty host.  Repeated rows repeat; equal pages of a cohort are induced from once.  Extra columns are ignored; an
    empty table gives no rows.  A host with very many pages has very many cohorts, so no task holds more than a cohort and
    the host's wrapper, which is as large as one page.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    own = pages.select(id_column("page_id").alias("_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("_host"))
    # the reference of a host is the page with most different elements, the shortest of those
    names = F.size(F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit(_NAMES.pattern), 1)))
    sizes = stage_table(own.groupBy("_host").agg(F.ceil(F.count(F.lit(1)) / cohort).cast("int").alias("_of")), "sizes")
    hosts = stage_table(own.groupBy("_host").agg(F.max(F.struct(names.alias("k"), (-F.length("html")).alias("n"), "html")).alias("r")).select("_host", F.col("r.html").alias("reference")).join(sizes, "_host"), "hosts")
    dealt = own.join(sizes, "_host").select("_id", "url", "html", "_host", F.pmod(F.xxhash64("_id", "url"), F.col("_of")).cast("int").alias("_cohort"))
    each = hosts.select("_host", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_cohort"), "reference")
    by = ["_host", "_cohort"]
    sums = dealt.groupBy(*by).cogroup(each.groupBy(*by)).applyInPandas(_induce, "_host string, slot int, digest binary, article binary, n long, mass long, link long")
    # an article counts once for a text, however many of its pages and cohorts have it
    articles = sums.groupBy("_host", "slot", "digest", "article").agg(*[F.sum(c).alias(c) for c in _FIGURES])
    texts = articles.groupBy("_host", "slot", "digest").agg(F.count(F.lit(1)).alias("articles"), *[F.sum(c).alias(c) for c in _FIGURES])
    most = F.max(F.when(F.col("digest") != F.lit(b""), F.struct("articles", "digest")))
    found = texts.groupBy("_host", "slot").agg(F.sum("articles").alias("articles"), most.alias("m"), *[F.sum(c).alias(c) for c in _FIGURES])
    shared = F.coalesce(F.when(F.col("m.articles") >= F.greatest(F.lit(LEAST_PAGES), AGREE * F.col("articles")), F.col("m.digest")), F.lit(b""))
    # in one plan with what follows, so that the pages are dealt to their cohorts once for both passes
    slots_ = found.groupBy("_host").agg(F.collect_list(F.struct("slot", F.col("n").alias("pages"), shared.alias("template"), "mass", "link")).alias("slots"))
    wrappers = each.join(slots_, "_host", "left")
    out = dealt.groupBy(*by).cogroup(wrappers.groupBy(*by)).applyInPandas(_read, "_id long, url string, text string, n_chars long, n_slots long")
    return out.select(restore_id("_id").alias("page_id"), "url", "text", "n_chars", "n_slots")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars, n_slots) of every page, as page_texts gives them: a null or empty html has an empty text."""
    return page_texts(read_table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}

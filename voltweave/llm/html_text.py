"""Main text of web pages by a minimum cut (operator 5).

A page becomes text blocks (the stretches between block-level tags) under their
containers; each block is a node.  A linear classifier gives it log-odds z of being
content from its words, closing punctuation, share of linked text and tag, and,
within bounds, from what its containers are and whether the page's article lies
elsewhere.  The costs of the two labels, log(1 + exp(-z)) and log(1 + exp(z)), are
the capacities to the terminals.  Blocks that follow each other are joined by an
edge that weakens with their distance in the DOM tree and with the difference of
their containers' scores, and so is each block with the one before it in its
container.  The maximum flow separates content from the rest: a short heading or a
linked sentence goes with the paragraphs around it, a list of links does not.

Defined cases: null or empty html gives an empty text; so does a page without
content.  Tags, comments, quoted and unquoted attributes are read as browsers do, in
one pass whatever the length: a tag that never ends takes the rest of the page, as
does a script or the like that is never closed.  White space is what Python's
str.split takes it for, after character references were decoded.  Blocks of equal
cost for both labels are left out.  A null page_id or url stays null; repeated rows
stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows

# Element names of HTML by their role here.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption summary tr tbody thead tfoot ul ol dl table address center hgroup".split())
#: Their content is text that no markup ends but their own closing tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Their content is not shown, or only where the element itself can't be.
MUTED = frozenset("template svg object canvas audio video datalist annotation annotation-xml".split())

# Weights of the classifier, in log-odds, set by hand on the marked pages of the tests.
#: What containers say.
TAGS = {"article": 1.0, "main": 0.8, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -5.5, "header": -5.0, "button": -6.0, "select": -6.0, "option": -6.0, "menu": -6.0, "dialog": -6.0, "label": -5.0, "fieldset": -4.0, "legend": -4.0, "search": -6.0, "head": -8.0}
ROLES = {"navigation": -6.0, "banner": -6.0, "contentinfo": -6.0, "complementary": -6.0, "search": -6.0, "form": -5.5, "alert": -6.0, "dialog": -6.0, "alertdialog": -6.0, "menu": -6.0, "menubar": -6.0, "toolbar": -6.0, "main": 0.8, "article": 1.0}
NAMED_FOR, NAMED_AGAINST, HIDDEN = 0.6, -6.0, -8.0
MOST_FOR, MOST_AGAINST = 2.0, -8.0
#: For a block outside of the article or main part that holds most of the page's words.
OUTSIDE = -2.0
#: Text: a constant, a doubling of the words (up to so much), a sentence (up to so many), links, and tags.
TEXT, DOUBLING, LONGEST, SENTENCE, SENTENCES, LINKED, TITLE, HEADING, ITEM = -2.4, 0.65, 4.5, 0.5, 3, -3.6, 2.5, 0.7, -0.5
#: Edges: between blocks that follow each other, and in one container; how they weaken with distance and contrast.
NEXT, SAME, FAR, CONTRAST = 1.6, 0.8, 3.0, 2.5

# What class names speak against an element, or for it.
AGAINST = re.compile(
    r"^(ad|ads|adv|advert\w*|adbox\w*|adslot\w*|adunit\w*|adwrap\w*|adcontainer|adbanner|adblock|adspace|adtext|adsby\w*|adsense|aside|banner\w*|promo\w*|sponsor\w*|menu\w*|nav\w*|side|sidebar\w*|rail|foot|footer\w*|masthead|topbar|breadcrumb\w*|crumbs?|cookie\w*|consent|gdpr|privacy|notice\w*|notification\w*|alert\w*|warning|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|login|register|search\w*|share\w*|sharing|social\w*|related\w*|recommend\w*|comment\w*|replies|reply|respond|discussion|disqus|feedback|widget\w*|toolbar\w*|tags?|pagination|pager|copyright|legal|disclaimer|skip|toc|hidden|print|jump|paywall|teaser\w*|outbrain|taboola)$"
)
#: Against a container unless it is inside an article, whose own head holds its title.
HEAD = re.compile(r"^(head|header\w*)$")
FOR = re.compile(r"^(article\w*|content|contents|post|entry|main|story|body|articlebody|prose|text)$")

#: What a class name speaks of is its last word that is none of these ...
TAILS = frozenset("area articles bar block bottom box btn button buttons container content desktop element form group head holder icon icons inner item items layer left line link links list main mobile module outer panel placeholder posts primary region right row secondary section slot stories text title top unit wrap wrapper".split())
#: ... or its first word, where that is firm and no state follows.
FIRM = re.compile(r"^(ads?|adv|advert\w*|sponsor\w*|promo\w*|sidebar\w*|footer\w*|breadcrumb\w*|cookie\w*|gdpr|newsletter\w*|popup\w*|modal\w*|related|recommend\w*|comments?|disqus|outbrain|taboola|social|share)$")
STATES = frozenset("active closed collapsed disabled enabled expanded fixed hidden loaded off on open opened ready shown sticky visible".split())
#: Names with these words say what is there or not, or where; those that begin with these are a post's terms.
STATING = frozenset("has no not with without is".split())
TERMS = frozenset("category tag term tax taxonomy type format status hidden visible".split())
#: Their own class names don't speak against these.
WHOLE = frozenset("html body main article".split())

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|(</?[a-zA-Z])|[^<]+|<", re.S)
#: A tag: quotes count in values only, as in browsers.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+)>")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
END_OF_SENTENCE = re.compile(r"[.!?…。][\"”»)]?(?=\s|$)")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def subjects(name: str) -> list[str]:
    """What a class name or id may say of its element: the whole name, its head word, a firm first word."""
    words = [w.lower() for w in NAME.findall(name.split("--")[0])]
    if len(words) < 2:
        return words
    if STATING.intersection(words):
        return []
    if words[0] in TERMS and words[1] not in TAILS | {"cloud"}:
        return []
    head = len(words)
    while head > 1 and words[head - 1] in TAILS:
        head -= 1
    return ["".join(words), words[head - 1], *(words[:1] if FIRM.match(words[0]) and words[-1] not in STATES else [])]


class Box:
    """An open block-level element."""

    __slots__ = ("tag", "up", "depth", "pro", "contra", "loose", "inside", "part", "named")

    def __init__(self, tag: str, up: Box | None, attributes: str):
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        self.inside = bool(up and (up.inside or up.tag in ("article", "main")))
        signs = [0.0 if tag == "header" and self.inside else TAGS.get(tag, 0.0)]  # an article's own header holds its title
        against = form = 0.0  # by class names, by a form around it
        if tag in ("form", "fieldset"):
            form = signs.pop()
        self.named = False
        for m in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                signs.append(ROLES.get(value.lower(), 0.0))
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                signs.append(HIDDEN)
            elif name in ("class", "id", "itemprop"):
                words = [w.lower() for w in NAME.findall(value)]
                self.named |= bool(words)
                of = [w for n in value.split() for w in subjects(n)]
                if any(AGAINST.match(w) or (HEAD.match(w) and not self.inside) for w in of):
                    against += NAMED_AGAINST
                elif any(FOR.match(w) for w in words):
                    signs.append(NAMED_FOR)
        pro, contra = sum(s for s in signs if s > 0), sum(s for s in signs if s < 0)
        # Both are bounded, so that one sign against a part of an article outweighs what speaks for the whole.
        self.pro = min(MOST_FOR, (up.pro if up else 0.0) + pro)
        self.contra = (up.contra if up else 0.0) + contra
        # A page's article starts anew in what names and forms around it say, but not a comment or teaser by its own name.
        anew = tag == "main" or (tag == "article" and not self.inside and not against)
        self.loose = (0.0 if anew or not up else up.loose) + form + (0.0 if tag in WHOLE else against)
        #: The outermost article or main part around it.
        self.part = up.part if up and up.part else self if anew else None

    @property
    def score(self) -> float:
        return self.pro + max(MOST_AGAINST, self.contra + self.loose)


class Block:
    """Text between block-level tags: its container, tag, and share of linked text."""

    __slots__ = ("box", "tag", "text", "linked", "words")

    def __init__(self, box: Box, tag: str, text: str, linked: float):
        self.box, self.tag, self.text, self.linked = box, tag, text, linked
        self.words = text.count(" ") + 1


def blocks(page: str) -> list[Block]:
    """The blocks of a page in their order."""
    out: list[Block] = []
    box, text, linked, in_link = Box("html", None, ""), [], 0, False
    mute: list[str] = []  # open elements whose content is not shown ...
    within: dict[str, int] = {}  # ... and elements that were opened in them
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked, in_link
        if text:
            own = " ".join(_html.unescape("".join(text)).split())
            if own:
                whole = box
                while whole.tag in LEAVES and not whole.named and whole.up and whole.score == whole.up.score:
                    whole = whole.up
                out.append(Block(whole, box.tag, own, min(1.0, linked / len(own))))
            text.clear()
        linked, in_link = 0, False

    while at < size:
        m = TOKEN.match(page, at)
        part = m[0]
        if part[0] != "<" or part == "<":
            at = m.end()
            if not mute:
                text.append(part)
                if in_link:
                    linked += len(part)
            continue
        if not m[1]:  # a comment
            at = m.end()
            continue
        m = TAG.match(page, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if mute:
                if tag in mute:
                    while mute.pop() != tag:
                        pass
                    continue
                if within.get(tag):
                    within[tag] -= 1
                    continue
                if tag not in BLOCKS:
                    continue
                mute.clear()  # the end of an element around it
            if tag == "a":
                in_link = False
            elif tag in BLOCKS:
                flush()
                seek = box
                while seek and seek.tag != tag:
                    seek = seek.up
                if seek and seek.up:
                    box = seek.up
            continue
        if tag in RAW:
            end = CLOSING[tag].search(page, at)
            at = end.end() if end else size
        elif tag in MUTED:
            if not m[3].endswith("/"):
                if not mute:
                    within.clear()
                mute.append(tag)
        elif mute:
            within[tag] = within.get(tag, 0) + 1
        elif tag == "a":
            in_link = True
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag == "hr":
                continue
            if box.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and box.up:
                box = box.up  # these end where a block begins
            elif tag == box.tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option") and box.up:
                box = box.up
            elif tag in ("dt", "dd") and box.tag in ("dt", "dd") and box.up:
                box = box.up
            box = Box(tag, box, m[3])
    flush()
    return out


def log_odds(block: Block, container: float) -> float:
    sentences = min(SENTENCES, len(END_OF_SENTENCE.findall(block.text)))
    z = container + TEXT + min(LONGEST, DOUBLING * math.log2(1 + block.words)) + SENTENCE * sentences + LINKED * block.linked
    if block.tag == "h1":
        z += TITLE
    elif block.tag in ("h2", "h3", "h4", "h5", "h6"):
        z += HEADING
    elif block.tag in ("li", "td"):
        z += ITEM
    return z


def distance(a: Box, b: Box) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def min_cut(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source.  ``costs``: of leaving the source, of leaving the sink, for each node.

    Dinic's algorithm; every augmenting path is found along a level graph.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(forth)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, (a, b) in enumerate(costs):
        both = min(a, b)  # flows straight through
        link(source, i, a - both, 0.0)
        link(i, sink, b - both, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in at[x]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                x = to[path[k] ^ 1]
                del path[k:]
                continue
            while tried[x] < len(at[x]):
                e = at[x][tried[x]]
                if room[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                tried[x] += 1
            else:
                if x == source:
                    break
                e = path.pop()
                x = to[e ^ 1]
                tried[x] += 1
                continue
            path.append(e)
            x = to[e]


def graph(found: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log-odds of each block, and the edges (i, j, weight) between blocks."""
    words: dict[int, int] = {}
    for b in found:
        words[id(b.box.part)] = words.get(id(b.box.part), 0) + b.words
    main = 2 * (sum(words.values()) - words.get(id(None), 0)) >= sum(words.values()) > 0
    of = {id(b.box): b.box.score + (OUTSIDE if main and b.box.part is None else 0.0) for b in found}
    scores = [of[id(b.box)] for b in found]

    def edge(i: int, j: int, weight: float) -> tuple[int, int, float]:
        return i, j, weight * math.exp(-(((scores[i] - scores[j]) / CONTRAST) ** 2))

    edges, last = [], {}
    for j, b in enumerate(found):
        if j:
            edges.append(edge(j - 1, j, NEXT * math.exp(-distance(found[j - 1].box, b.box) / FAR)))
        if (i := last.get(id(b.box), j - 1)) < j - 1:
            edges.append(edge(i, j, SAME))
        last[id(b.box)] = j
    return [log_odds(b, c) for b, c in zip(found, scores)], edges


def cut_costs(z: list[float]) -> list[tuple[float, float]]:
    return [(math.log1p(math.exp(x)), math.log1p(math.exp(-x))) for x in z]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    z, edges = graph(found)
    if all(x > 0 for x in z) or all(x <= 0 for x in z):
        keep = [x > 0 for x in z]  # no edge is cut
    else:
        keep = min_cut(cut_costs(z), edges)
    return "\n".join(b.text for b, ok in zip(found, keep) if ok)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, pages_ in rows(batches, 2):
            texts = [main_text(p) for p in pages_]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""HTML main-text extraction by minimum-cut labelling (operator 1).

A page becomes a row of text blocks with their place in the DOM. A linear classifier gives each block a cost for being called content or
boilerplate: the capacities of its edges to the two terminals. What it goes by is soft: the text's own features, and hints of the elements around it
(tags, roles, whole names in class and id count much; names beside other words little; states such as with-sidebar nothing). Smoothness edges run
between neighbouring blocks and between consecutive ones of one element or one parent; they are as strong as the classifier's own costs and
weaken with the blocks' distance in the DOM and across elements that hint at another kind of text. The minimum cut (maximum flow by Dinic's method;
blocks whose side is plain go first) separates content from boilerplate, so headings, short lines and cells go with what stands around them.
Content blocks joined in page order are the text.

Defined cases: null or empty html gives the empty text; a cut-off page counts as far as it goes, an unfinished tag is dropped; form controls (select,
textarea, button) are part of forms, wherever they stand; a null page_id or url is passed through; repeated rows are each extracted; other columns
play no part.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What lies in these is never text of the page.
SKIPPED = frozenset("head script style noscript template svg iframe canvas audio video select textarea button datalist title annotation annotation-xml".split())
#: What may be in a head whose end isn't marked, and what of it has content that isn't the page's.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
IN_HEAD_PAIRED = frozenset("noframes noscript script style template title".split())
RAW = frozenset("script style textarea title".split())
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising promo promotion sponsor sponsored banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus reply replies respond discussion share sharing social related recommended recommendations subscribe subscription newsletter signup login register widget toolbar pagination pager copyright legal skip search form poll rating".split())
#: The same in other languages that sites are written in.
BOILER_WORDS |= frozenset(
    "anzeige anzeigen brotkrumen einwilligung empfehlungen fusszeile fussbereich hinweis hinweise impressum kommentar kommentare kopfzeile menue randspalte seitenleiste suche suchen teilen umfrage werbung "
    "annonce annonces avis commentaire commentaires connexion entete lateral laterale navigateur partage partager pied piedpage publicite pub recherche recommandations sondage "
    "anuncio anuncios aviso avisos barra buscar busqueda cabecera comentario comentarios compartir encuesta pie publicidad recomendados "
    "commenti condividi intestazione pubblicita ricerca rodape cabecalho pesquisa publicidade".split()
)
CONTENT_WORDS = frozenset("article content main post entry story body text".split())
#: Words that say where or how a thing is put, not what it is; and such as make a name a state of the page.
PLACE_WORDS = frozenset("area articles author avatar bar block bottom box btn button buttons card cards container content contents date entries entry field fixed global group holder icon icons inner item items layout left link links list lists main message meta module note notes outer page panel posts primary right row secondary section site slot space stories sticky tab tabs text thread title top unit wrap wrapper zone".split())
#: A header of one of these may hold the article's title.
OWN_HEADER = frozenset("article content entry post story".split())
STATE_FIRST = frozenset("with has no is not without js hide hides show shows enable can".split())
STATE_LAST = frozenset("active closed collapsed disabled enabled expanded hidden off on open opened shown visible".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: An open one of these ends at the start of the others.
CLOSED_BY = {"p": BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?![\w-])""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: The slash that ends an empty element; one that ends an unquoted value is part of it.
EMPTY = re.compile(r"""(?:^|[\s"'])/$""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: The classifier's weights, in hundredths; content is positive. Calibrated by hand: any one hint can be outweighed by the text and its neighbours,
#: but for a plain hint at boilerplate against one paragraph.
TAG_WEIGHTS = {"nav": -520, "footer": -480, "aside": -420, "form": -420, "menu": -450, "dialog": -450, "article": 150, "main": 150}
#: A notice of rights by its sign or its word, and the heading of readers' comments, with their number.
RIGHTS = re.compile(r"\W*(?:©|\(c\)|copyright\b)", re.I)
COMMENTS = re.compile(r"[\W\d]*(?:(?:reader|user|leser)\W?)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?|commenti|reacties|kommentarer)\b[\W\d]*$", re.I)
BOILER_NAME, WEAK_NAME, CONTENT_NAME, HIDDEN_WEIGHT = -450, -40, 150, -500
HINTS_LEAST, HINTS_MOST, PLAIN_HINT, PAGE_HEADER = -650, 250, -250, -450
WEIGHTS = {"bias": -50, "link": -400, "sentence": 150, "long": 120, "short": -40, "paragraph": 60, "heading": -110, "header": -350, "rights": -600}
#: A form, or a box of a boilerplate name, that holds this share of the page's prose is but a wrapper; the box, if next to nothing else could be the article.
WRAPPER_SHARE, ELSEWHERE_SHARE = 0.5, 0.1
#: Longest notice of rights.
RIGHTS_CHARS = 200
#: Capacity by the number of steps between two blocks' elements in the DOM; of edges that skip blocks; and the divisor across a boundary.
NEAR_EDGE = (200, 200, 200, 190, 150, 100, 50)
SIBLING_EDGE, BOUNDARY, DIVISOR = 60, 150, 8
#: A heading belongs to what follows it.
HEADINGS, HEADING_EDGE = ("h1", "h2", "h3", "h4", "h5", "h6"), 400


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    element: int  # number of the innermost block-level element
    parent: int  # number of the block-level element around that, -1 outside of any
    depth: int
    link_chars: int


@dataclass(slots=True)
class Page:
    """Blocks, and of each block-level element (0 is the page itself) its parent, tag, depth, own hint, and how much of that is by its names."""

    blocks: list[Block]
    parents: list[int]
    tags: list[str]
    depths: list[int]
    hints: list[int]
    named: list[int]


@functools.lru_cache(8192)
def name_hint(name: str) -> int:
    """What one name in class or id says of the element."""
    words = [w.lower() for w in WORD.findall(name) if not w.isdigit()]
    if not words or words[0] in STATE_FIRST or (len(words) > 1 and words[-1] in STATE_LAST):
        return 0
    boiler = [w in BOILER_WORDS for w in words]
    if words[-1] == "header" and words[0] in OWN_HEADER:
        return 0
    if any(boiler):
        named = boiler[-1] or (boiler[0] and all(x or w in PLACE_WORDS or w in CONTENT_WORDS for w, x in zip(words, boiler, strict=True)))
        return BOILER_NAME if named else WEAK_NAME
    return CONTENT_NAME if all(w in CONTENT_WORDS or w in PLACE_WORDS for w in words) and any(w in CONTENT_WORDS for w in words) else 0


def attribute_hints(attributes: str) -> tuple[int, bool]:
    """(hint, hidden) by an element's attributes: its plainest name at either side."""
    names, hidden = [0], False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            hidden |= bool(HIDDEN.search(value))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "role":
            names.append(BOILER_NAME if value.lower() in BOILER_ROLES else CONTENT_NAME if value.lower() in ("main", "article") else 0)
        else:
            names += map(name_hint, value.split())
    return min(names) + max(names), hidden


def head_end(html: str, at: int) -> int:
    """Where a head that no tag ends does end: at the first text or element that can't be in it."""
    size = len(html)
    while at < size:
        found = TOKEN.search(html, at)
        if html[at : found.start() if found else size].strip() or (found and found[0].startswith("<![CDATA[")):
            return at
        if not found:
            break
        tag, at = (found[2] or found[5] or "").lower(), found.end()
        if not tag or found[1] or found[4]:
            continue
        if tag not in IN_HEAD:
            return found.start()
        if tag in IN_HEAD_PAIRED:
            later = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
            at = later.end() if later else size
    return size


def parse(html: str) -> Page:
    page = Page([], [-1], [""], [0], [0], [0])
    # Open elements: tag, number of the block-level element, is it one itself, is it a hidden inline one.
    stack: list[tuple[str, int, bool, bool]] = [("", 0, True, False)]
    levels = [0]  # places of the block-level ones in the stack
    opened: Counter[str] = Counter()
    text: list[str] = []
    links = link_chars = unseen = 0
    at, size = 0, len(html)

    def close_block() -> None:
        nonlocal link_chars
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            number = stack[levels[-1]][1]
            page.blocks.append(Block(joined, page.tags[number], number, page.parents[number], page.depths[number], link_chars))
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if unseen:
            return
        raw = unescape(raw) if "&" in raw else raw
        text.append(raw)
        if links:
            link_chars += len(raw)

    def leave(k: int) -> None:
        """Closes the open elements from place k on."""
        nonlocal links, unseen
        for tag, _, block, hidden in stack[k:]:
            opened[tag] -= 1
            links -= tag == "a"
            unseen -= hidden
            if block:
                levels.pop()
        del stack[k:]

    lower = None
    while at < size:
        found = TOKEN.search(html, at)
        if found is None:
            add(html[at:])
            break
        if found.start() > at:
            add(html[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                add(found[0][9:].removesuffix("]]>"))
            continue
        if not found[0].endswith(">"):
            continue  # cut off
        tag, ends, attributes = tag.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
        if not ends and tag in SKIPPED:
            if tag == "head":
                close_block()
                later = re.compile(r"</head\s*>|<body[\s>]", re.I).search(html, at)
                at = (later.end() if later[0][1] == "/" else later.start()) if later else head_end(html, at)
                continue
            if EMPTY.search(attributes) and tag not in RAW:
                continue
            lower = html.lower() if lower is None else lower
            later = lower.find(f"</{tag}", at)
            at = size if later < 0 else (lower.find(">", later) + 1 or size)
            continue
        if tag == "br":
            add(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            close_block()
        if ends:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                leave(k)
            continue
        if tag in VOID:
            continue
        for k in range(len(levels) - 1, 0, -1):
            other = stack[levels[k]][0]
            if tag in CLOSED_BY.get(other, ()):
                leave(levels[k])
                break
            if other != "p":
                break
        if EMPTY.search(attributes) and not block:
            continue
        hint, hidden = attribute_hints(attributes) if attributes and tag not in ("html", "body") else (0, False)
        number = stack[-1][1]
        if block:
            page.parents.append(number)
            page.tags.append(tag)
            page.depths.append(page.depths[number] + 1)
            page.hints.append(hint + TAG_WEIGHTS.get(tag, 0) + HIDDEN_WEIGHT * hidden)
            page.named.append(0 if hidden else hint)
            number = len(page.tags) - 1
            levels.append(len(stack))
        links += tag == "a"
        unseen += hidden and not block
        opened[tag] += 1
        stack.append((tag, number, block, hidden and not block))
    close_block()
    return page


def blocks_of(html: str) -> list[Block]:
    return parse(html).blocks


def text_score(b: Block) -> int:
    """What the text itself, its tag and its links say."""
    w, n = WEIGHTS, len(b.text)
    s = w["bias"] + w["link"] * min(b.link_chars, n) // n
    if n > 40 and b.text[-1] in ".!?…。！？\"'”»":
        s += w["sentence"]
    if n <= RIGHTS_CHARS and RIGHTS.match(b.text):
        s += w["rights"]
    if b.tag in HEADINGS:
        return s + w["heading"]
    if b.tag in ("p", "blockquote", "pre"):
        s += w["paragraph"]
    return s + (w["long"] if n > 100 else w["short"] if n < 25 else 0)


def wrappers(page: Page, prose: list[int], inside: list[bool]) -> set[int]:
    """The elements whose boilerplate names are those of a wrapper: they hold most of the page's prose, outside of them and of what is hinted to be
    boilerplate there is next to none, and no article or main is there that could be meant instead."""
    large = [k for k in range(1, len(prose)) if page.named[k] <= PLAIN_HINT and prose[k] >= WRAPPER_SHARE * max(prose[0], 1) and not inside[page.parents[k]]]
    if not large or not prose[0]:
        return set()
    texts, articles, hinted, boxed = [0] * len(prose), [0] * len(prose), [False] * len(prose), 0
    for b in page.blocks:
        texts[b.element] += len(b.text)
    for k in range(1, len(prose)):
        around = hinted[page.parents[k]]
        hinted[k] = around or page.hints[k] <= PLAIN_HINT or page.tags[k] == "header"
        boxed += prose[k] if hinted[k] and not around else 0
    for k in range(len(prose) - 1, 0, -1):
        articles[k] = texts[k] if page.tags[k] in ("article", "main") else articles[k]
        texts[page.parents[k]] += texts[k]
        articles[page.parents[k]] += articles[k]
    return {k for k in large if articles[0] == articles[k] and prose[0] - boxed < ELSEWHERE_SHARE * prose[k]}


def element_hints(page: Page, own: list[int], inside: list[bool]) -> list[int]:
    """For each element the sum of its hints and those of the elements around it, within bounds. A form around half of the page's prose is no hint, and
    what lies around an element that is plainly boilerplate doesn't speak for it. An element that begins with a heading of comments holds comments."""
    prose = [0] * len(page.tags)
    commented, begun = set(), set()
    for b, s in zip(page.blocks, own, strict=True):
        prose[b.element] += len(b.text) if s > 0 else 0
        if b.parent > 0 and b.parent not in begun and b.tag in HEADINGS[1:] and page.tags[b.parent] in ("section", "div", "article", "aside") and COMMENTS.match(b.text):
            commented.add(b.parent)
        begun |= {b.element, b.parent}
    for k in range(len(prose) - 1, 0, -1):
        prose[page.parents[k]] += prose[k]
    excused = wrappers(page, prose, inside)
    sums = [0] * len(prose)
    for k in range(1, len(sums)):
        hint = page.hints[k] - (page.named[k] if k in excused else 0)
        if page.tags[k] == "form" and prose[k] >= WRAPPER_SHARE * max(prose[0], 1):
            hint = 0
        if page.tags[k] == "header" and not inside[k]:
            hint += PAGE_HEADER
        if k in commented:
            hint += BOILER_NAME
        around = sums[page.parents[k]]
        sums[k] = (min(around, 0) if hint <= PLAIN_HINT else around) + hint
    return [max(HINTS_LEAST, min(HINTS_MOST, x)) for x in sums]


def scores(page: Page) -> tuple[list[int], list[int]]:
    """(the classifier's verdict on each block, content above 0; the hints of its elements)."""
    own = [text_score(b) for b in page.blocks]
    header, inside = [False] * len(page.tags), [False] * len(page.tags)
    for k in range(1, len(page.tags)):
        header[k] = header[page.parents[k]] or page.tags[k] == "header"
        inside[k] = inside[page.parents[k]] or page.tags[k] in ("article", "main")
    hints = element_hints(page, own, inside)
    out, about = [], []
    for b, s in zip(page.blocks, own, strict=True):
        hint = hints[b.element]
        if header[b.element] and inside[b.element]:  # of an article's header the title stays
            if b.tag in ("h1", "h2"):
                s -= WEIGHTS["heading"]
            else:
                s, hint = s + WEIGHTS["header"], hint + WEIGHTS["header"]
        out.append(s + hints[b.element])
        about.append(hint)
    return out, about


def steps_between(page: Page, a: int, b: int, most: int = len(NEAR_EDGE) - 1) -> int:
    """Steps from element a to element b in the DOM, as far as it matters."""
    n = 0
    while a != b and n < most:
        if page.depths[a] >= page.depths[b]:
            a = page.parents[a]
        else:
            b = page.parents[b]
        n += 1
    return n


def edges_of(page: Page, hints: list[int]) -> list[tuple[int, int, int]]:
    """(i, j, capacity) between neighbours by DOM proximity, next neighbours, and consecutive blocks of one element or parent."""
    blocks, out = page.blocks, []
    last: dict[tuple[str, int], int] = {}
    across = lambda i, j, c: c // DIVISOR if abs(hints[i] - hints[j]) >= BOUNDARY else c
    for j, b in enumerate(blocks):
        if j:
            a = blocks[j - 1]
            near = NEAR_EDGE[steps_between(page, a.element, b.element)]
            out.append((j - 1, j, across(j - 1, j, max(near, HEADING_EDGE) if a.tag in HEADINGS and b.tag not in HEADINGS else near)))
        if j > 1 and blocks[j - 2].depth == b.depth:
            out.append((j - 2, j, across(j - 2, j, SIBLING_EDGE)))
        for i in sorted({last.get(key, j) for key in (("element", b.element), ("parent", b.parent)) if key[1] >= 0}):
            if j - i > 2 or (j - i == 2 and blocks[i].depth != b.depth):
                out.append((i, j, across(i, j, SIBLING_EDGE)))
        last["element", b.element] = last["parent", b.parent] = j
    return out


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's (content) side of a minimum cut.

    A node whose terminal capacity is above that of all its other edges together keeps its side in every minimum cut;
    such nodes go first, and give their edges to their neighbours' terminals. Maximum flow settles the rest. Ties go to boilerplate.
    """
    n = len(scores)
    weight, near = list(scores), [[] for _ in range(n)]
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
    free = [sum(c for _, c in x) for x in near]
    side: list[bool | None] = [None] * n
    queue = deque(i for i in range(n) if abs(weight[i]) > free[i])
    while queue:
        i = queue.popleft()
        if side[i] is not None:
            continue
        side[i] = weight[i] > 0
        for j, c in near[i]:
            if side[j] is None:
                weight[j] += c if side[i] else -c
                free[j] -= c
                if abs(weight[j]) > free[j]:
                    queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        where = {i: k for k, i in enumerate(rest)}
        flow = MaxFlow(len(rest) + 2)
        s, t = len(rest), len(rest) + 1
        for i in rest:
            if weight[i] > 0:
                flow.add(s, where[i], weight[i], 0)
            elif weight[i] < 0:
                flow.add(where[i], t, -weight[i], 0)
        for i, j, c in edges:
            if i in where and j in where:
                flow.add(where[i], where[j], c, c)
        for k, reached in enumerate(flow.source_side(s, t)[: len(rest)]):
            side[rest[k]] = reached
    return [bool(x) for x in side]


class MaxFlow:
    """Dinic's method, without recursion."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[int] = []

    def add(self, u: int, v: int, there: int, back: int) -> None:
        for a, b, c in ((u, v, there), (v, u, back)):
            self.edges[a].append(len(self.to))
            self.to.append(b)
            self.left.append(c)

    def _levels(self, s: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in self.edges[u]:
                v = self.to[e]
                if self.left[e] and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        while True:
            level = self._levels(s)
            if level[t] < 0:
                return [x >= 0 for x in level]
            upto = [0] * len(self.edges)
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    pushed = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= pushed
                        self.left[e ^ 1] += pushed
                    path, u = [], s
                    continue
                while upto[u] < len(self.edges[u]):
                    e = self.edges[u][upto[u]]
                    if self.left[e] and level[self.to[e]] == level[u] + 1:
                        break
                    upto[u] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    u = self.to[e ^ 1]
                    upto[u] += 1
                    continue
                path.append(e)
                u = self.to[e]


def label(html: str) -> tuple[Page, list[int], list[bool]]:
    """(page, the classifier's verdicts, is each block content by the cut)."""
    page = parse(html)
    verdicts, hints = scores(page)
    return page, verdicts, minimum_cut(verdicts, edges_of(page, hints))


def main_text(html: str | None) -> tuple[str, int]:
    """(text, number of content blocks)"""
    page, _, content = label(html or "")
    kept = [b.text for b, x in zip(page.blocks, content, strict=True) if x]
    return " ".join(kept), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks), one row per page. No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(x.as_py()) for x in batch.column(2)]
            texts = [x for x, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array([n for _, n in got], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long, n_blocks long")

"""Main text of web pages: blocks labelled by a minimum cut.

A page is read tag by tag into blocks of text (what stands between two block-level tags) and the
tree of containers that hold them. A linear classifier gives each block a cost for being called
content or boilerplate. The graph of a page has these costs as terminal capacities; blocks that
follow each other are joined by smoothness edges, wider ones if they share a container, and each block and container
is joined to the container around it, so that blocks near each other in the tree pull together. The
maximum flow from content to boilerplate is the minimum cut, which labels all blocks at once; a block
that either label suits equally stays. Work on a page is proportional to its length, but for the flow
on its blocks; pages are read where they lie and never shuffled, only the text comes back.

The classifier's weights and word lists are fixed parameters (``WEIGHTS``, ``SOFT``, ``STICKY``), as no page
is labelled. They are chosen so that markup decides where it speaks (article and main, nav, aside, footer, header, class, id and role), and
length, links and position where it does not. Without any sign of boilerplate a block is content.

Defined cases: null and empty html give '' and 0 characters, and so does a page without content. A very long page is
one row and is read in one task. Broken markup is read as browsers do in the main: an unclosed tag at
the end is dropped, unclosed comments and scripts run to the end, p, li, dt, dd, tr, td and options close by what
follows, end tags that close nothing are ignored, '<' before anything but a letter is text. Character
references are decoded once; white space is Unicode's. Repeated rows give one result each. Columns named like the results are
replaced, others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagshift.llm.base import query

_WORDS = str.split
#: elements whose content is never text of the page; raw ones hold no tags
RAW = frozenset(_WORDS("script style title textarea xmp iframe noembed noframes noscript"))
UNSEEN = frozenset(_WORDS("head template object audio video canvas svg select datalist button"))
VOID = frozenset(_WORDS("area base br col embed hr img input link meta param source track wbr"))
BLOCK = frozenset(_WORDS(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption"
))
HEADING = frozenset(_WORDS("h1 h2 h3 h4 h5 h6"))
#: start tag -> open elements that it closes, and those beyond which it does not look
CLOSES = {
    "li": (frozenset(["li"]), frozenset(_WORDS("ul ol menu dir"))),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
}
#: elements and roles that hold no article; sticky ones also where an article element stands inside
STICKY_TAGS = frozenset(_WORDS("nav aside footer dialog menu search"))
STICKY_ROLES = frozenset(_WORDS("navigation contentinfo complementary search alert alertdialog dialog status menu menubar toolbar tablist"))
#: words of class and id
STICKY = frozenset(_WORDS("comment comments commentlist commentbox commentform commentsection replies reply respond disqus discussion"))
SOFT = frozenset(_WORDS(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adbox adslot adunit sponsor sponsored sponsors promo promos promotion banner "
    "nav navbar navigation sidenav topnav subnav mainnav menu menus menubar submenu breadcrumb breadcrumbs toc sidebar sidebars aside footer header masthead topbar toolbar "
    "cookie cookies cookiebar cookiebanner consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup "
    "login register search searchbox searchform share sharing social related recommended recommendations popular trending widget widgets pagination pager form copyright"
))
INLINE_SOFT = frozenset(_WORDS("ad ads advert advertisement adsbygoogle adslot sponsored promo"))
WEAK = frozenset(_WORDS("article articlebody post entry story content maincontent main body text prose"))
#: a word after one of these says how the page is laid out, not what the element is
LAYOUT = frozenset(_WORDS("has with no without is not hide show enable enabled disable disabled toggle"))

#: hundredths of the classifier's cost; above 0 speaks for content
WEIGHTS = {
    "base": 100, "article": 400, "weak": 150, "boilerplate": -700, "in_header": -400, "links": -500, "prose": 50, "heading": 30, "item": -30,
    "word": 5, "most_words": 40, "short": -50, "few_words": 4, "rights": -300,
    "next": 100, "next_apart": 50, "container": 50,
}
_RIGHTS = re.compile(r"\s*(©|copyright\b|\(c\)\s*\d)|\ball rights reserved\b", re.I)
_ENDS_SENTENCE = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")
_OPENS = re.compile(r"<(?:(!--)|([!?]|/(?![a-zA-Z]))|(/?)([a-zA-Z][^\s/>]*+))")
_ENDS_COMMENT = re.compile(r"--!?>")
# quotes count only behind an equals sign; nothing is read twice, but for at most one quote of each kind that never ends
_ATTRIBUTES = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)>""")
_SIGNS = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# what an element says of the blocks in it
NONE, WEAKLY, ARTICLE, HEADER, SOFTLY, STICKILY = range(6)


def _enter(name: str, attributes: str, state: int, block: bool) -> int:
    """The state inside an element, from the state around it."""
    if state == STICKILY or name in ("html", "body"):
        return state
    words: list[str] = []
    role = itemprop = ""
    hidden = False
    if attributes:
        for key, *values in _SIGNS.findall(attributes):
            key, value = key.lower(), values[0] or values[1] or values[2]
            if key in ("class", "id"):
                for one in value.split():
                    before = ""
                    for part in _NAME_PART.findall(one):
                        part = part.lower()
                        if before not in LAYOUT:
                            words.append(part)
                        before = part
                    words.append(one.lower())
            elif key == "role":
                role = value.strip().lower()
            elif key == "itemprop":
                itemprop = value.strip().lower()
            else:
                hidden |= key == "hidden" or (key == "style" and bool(_HIDES.search(value))) or (key == "aria-hidden" and value.strip().lower() == "true")
    if not block:
        return SOFTLY if hidden or not INLINE_SOFT.isdisjoint(words) else state
    if name in STICKY_TAGS or role in STICKY_ROLES or not STICKY.isdisjoint(words):
        return STICKILY
    if name in ("article", "main") or role in ("article", "main") or itemprop == "articlebody":
        return SOFTLY if hidden else ARTICLE
    in_header = name == "header" or role == "banner" or "header" in words
    if in_header and state in (ARTICLE, HEADER):
        return HEADER
    if state == SOFTLY or hidden or in_header or name == "form" or role == "form" or not SOFT.isdisjoint(words):
        return SOFTLY
    if state == NONE and not WEAK.isdisjoint(words):
        return WEAKLY
    return state


class Page:
    """Blocks of a page in order, with costs and containers."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.costs: list[int] = []
        self.holders: list[int] = []
        #: container -> the one around it
        self.around: list[int] = []


def cost(text: str, linked: float, tag: str, state: int) -> int:
    """Hundredths by which a block is content rather than boilerplate."""
    w = WEIGHTS
    words = len(text.split())
    out = w["base"] + w["word"] * min(words, w["most_words"]) + round(w["links"] * linked)
    if state == ARTICLE or (state == HEADER and tag in HEADING):
        out += w["article"]
    elif state == HEADER:
        out += w["in_header"]
    elif state == WEAKLY:
        out += w["weak"]
    elif state != NONE:
        out += w["boilerplate"]
    out += w["prose"] if tag in ("p", "blockquote", "pre") else w["heading"] if tag in HEADING else w["item"] if tag == "li" else 0
    if words < w["few_words"] and not _ENDS_SENTENCE.search(text):
        out += w["short"]
    if state not in (ARTICLE, HEADER) and _RIGHTS.search(text):
        out += w["rights"]
    return out


def read(html: str) -> Page:
    page = Page()
    # an open element: [name, is a block, state, inside a link, inside what is not shown, container number or -1]
    stack: list[list] = [["", True, NONE, False, False, -1]]
    held: list[str] = []
    linked, length, begun_in = 0, 0, NONE

    def container(at: int) -> int:
        """Number of the block element at ``at`` in the stack, given with all around it when first asked for."""
        chain = []
        while at >= 0:
            if stack[at][1]:
                if stack[at][5] >= 0:
                    break
                chain.append(stack[at])
            at -= 1
        up = stack[at][5] if at >= 0 else -1
        for element in reversed(chain):
            element[5] = len(page.around)
            page.around.append(up)
            up = element[5]
        return up

    def flush() -> None:
        nonlocal linked, length
        text = " ".join("".join(held).split())
        if text:
            at = len(stack) - 1
            while not stack[at][1]:
                at -= 1
            page.texts.append(text)
            page.costs.append(cost(text, linked / max(length, 1), stack[at][0], begun_in))
            page.holders.append(container(at))
        held.clear()
        linked = length = 0

    def add(text: str) -> None:
        nonlocal linked, length, begun_in
        top = stack[-1]
        if top[4] or not text:
            return
        if not length:
            begun_in = top[2]
        if "&" in text:
            text = unescape(text)
        held.append(text)
        solid = len(text) - text.count(" ")
        length += solid
        if top[3]:
            linked += solid

    def close(at: int) -> None:
        """Ends the element at ``at`` and all in it."""
        around = stack[at - 1][2]
        if held:
            for e in stack[at:]:
                if e[1] or e[2] != around:
                    flush()
                    break
        while len(stack) > at:
            count[stack.pop()[0]] -= 1

    count: dict[str, int] = {}
    pos, end = 0, len(html)
    while pos < end:
        lt = html.find("<", pos)
        if lt < 0:
            add(html[pos:])
            break
        m = _OPENS.match(html, lt)
        if not m:
            add(html[pos : lt + 1])
            pos = lt + 1
            continue
        if lt > pos:
            add(html[pos:lt])
        comment, bogus, slash, name = m.groups()
        if comment:
            done = m.end() + 1 if html.startswith(">", m.end()) else m.end() + 2 if html.startswith("->", m.end()) else 0
            found = None if done else _ENDS_COMMENT.search(html, m.end())
            pos = done or (found.end() if found else end)
            continue
        if bogus:
            gt = html.find(">", m.end())
            pos = gt + 1 if gt >= 0 else end
            continue
        rest = _ATTRIBUTES.match(html, m.end())
        if not rest:
            break
        pos, name = rest.end(), name.lower()
        block = name in BLOCK
        if slash:
            if not count.get(name):
                if block and held:
                    flush()
                continue
            at = len(stack) - 1
            while stack[at][0] != name and (block or not stack[at][1]):
                at -= 1
            if stack[at][0] == name:
                close(at)
            continue
        if name == "br":
            add("\n")
        if name in RAW:
            found = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, pos)
            pos = found.start() if found else end
            # the end tag that follows closes nothing and is passed over
            continue
        if name in VOID:
            if block and held:
                flush()
            continue
        if block:
            if held:
                flush()
            at = len(stack) - 1
            while not stack[at][1]:
                at -= 1
            if stack[at][0] == "p":
                close(at)
            if name in CLOSES:
                ended, beyond = CLOSES[name]
                at = len(stack) - 1
                while at > 0 and stack[at][0] not in ended and stack[at][0] not in beyond:
                    at -= 1
                if at > 0 and stack[at][0] in ended:
                    close(at)
        top = stack[-1]
        state = _enter(name, rest.group(1), top[2], block)
        if held and state != top[2]:
            flush()
        stack.append([name, block, state, top[3] or name == "a", top[4] or name in UNSEEN, -1])
        count[name] = count.get(name, 0) + 1
    if held:
        flush()
    return page


def edges(page: Page) -> list[tuple[int, int, int]]:
    """Smoothness edges (node, node, capacity): blocks first, then containers."""
    n, w = len(page.texts), WEIGHTS
    near = [(i, i + 1, w["next"] if page.holders[i] == page.holders[i + 1] else w["next_apart"]) for i in range(n - 1)]
    near += [(i, n + h, w["container"]) for i, h in enumerate(page.holders)]
    return near + [(n + c, n + up, w["container"]) for c, up in enumerate(page.around) if up >= 0]


def minimum_cut(costs: list[int], joined: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of the minimum cut; of several cuts the one with the largest side.

    ``costs`` above 0 are capacities from the source, below 0 to the sink. Flow is augmented along
    shortest paths, all of one length in a phase.
    """
    n = len(costs)
    s, t = n, n + 1
    first: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    free: list[int] = []

    ends = [(s, i, c, 0) if c > 0 else (i, t, -c, 0) for i, c in enumerate(costs) if c]
    for a, b, there, back in ends + [(a, b, c, c) for a, b, c in joined]:
        first[a].append(len(to))
        to.append(b)
        free.append(there)
        first[b].append(len(to))
        to.append(a)
        free.append(back)
    while True:
        # distance to the sink along edges with room
        level = [-1] * (n + 2)
        level[t] = 0
        row = [t]
        for v in row:
            for e in first[v]:
                if free[e ^ 1] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    row.append(to[e])
        if level[s] < 0:
            return [x < 0 for x in level[:n]]
        at, path, v = [0] * (n + 2), [], s
        while True:
            if v == t:
                room = min(free[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    free[e] -= room
                    free[e ^ 1] += room
                for k, e in enumerate(path):
                    if not free[e]:
                        cut = k
                        break
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            arcs = first[v]
            while at[v] < len(arcs):
                e = arcs[at[v]]
                if free[e] and level[to[e]] == level[v] - 1:
                    break
                at[v] += 1
            else:
                if v == s:
                    break
                level[v] = -1
                v = to[path.pop() ^ 1]
                at[v] += 1
                continue
            path.append(e)
            v = to[e]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = read(html)
    content = minimum_cut(page.costs + [0] * len(page.around), edges(page))
    return " ".join(t for t, c in zip(page.texts, content) if c)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages``, or its columns ``keep``, with ``text`` and ``n_chars``."""
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{html}`").cast("string").alias("html"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return rows.mapInArrow(run, schema).select("row.*", "text", F.length("text").cast("long").alias("n_chars"))


@query("op12_html_text")
def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])

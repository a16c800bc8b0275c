"""Main text of web pages by tree scoring.

A page is cut into tags and text in one pass; the tree keeps block elements
only. Text runs between block borders are blocks. Each block passes points
(1, its commas, its length) to its ancestors, fewer the further up; a
container's points are discounted by its link density. The best container
and those siblings that score like content are kept, without the parts that
markup or names mark as menus, headers, footers, sidebars, notices, adverts,
forms or reader comments. Names count on containers only, never on headings,
paragraphs or list items, and not where an id merely spells its section's
heading. Names that are topics as well ("search", "related", "social") count
inside the article only on parts that are mostly links or hold no more than a
phrase. A list of links goes unless it stands in the flow of the prose: under
a heading, after a colon, or with prose before and after it. Time is linear in
the length of the page, however badly it is nested.

Defined results: null or empty html, or html without visible text, gives an
empty text of length 0; unclosed and stray tags are tolerated; a null url or
id is kept; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame

from .common import map_rows, pick

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"""
                 r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+[^>]*)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

CLASS = re.compile(r"""\bclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME_BREAK = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")

# ---- fixed values: element and name lists ----
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search
section select summary table tbody td textarea tfoot th thead title tr ul""".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Left out with their content; without an end tag of its own only the tag goes.
UNSEEN = frozenset("svg canvas noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes these open elements first (up to the nearest scope).
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
          "option": ("option",), "body": ("head",)}
SCOPES = frozenset("ul ol dl table select html body article section div td".split())
JUNK_TAGS = frozenset("""head nav header footer aside form button select option textarea title menu dialog fieldset legend
search""".split())
JUNK_ROLES = frozenset("""navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form
toolbar""".split())
JUNK_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo
promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup
signin login register sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot
header masthead topbar toolbar skip comment comments commentlist disqus reply replies respond discussion share sharing
social related recommended recommendations widget widgets search form hidden""".split())
#: Starts and ends of run-together names ("navmenu", "sitefooter").
JUNK_STEM = re.compile(r"^(advert|banner|breadcrumb|comment|cookie|disqus|footer|header|masthead|menu|nav|newsletter|pager|pagination|popup|"
                       r"promo|share|sidebar|social|sponsor|subscrib|toolbar|widget)|"
                       r"(adbox|adblock|footer|header|navbar|nav|menu|sidebar|comments?|banner|popup)$")
#: Names that page wrappers bear as well.
LAYOUT_NAMES = frozenset("widget widgets side sidebar header social share search related modal overlay login form hidden top".split())
#: Names that an article's parts bear as topics.
TOPIC_NAMES = frozenset("""alert alerts discussion form forms header hidden login menu menus modal notice notices overlay promotion recommended
recommendations register related reply respond search share sharing side skip social top widget widgets""".split())
#: Elements whose names count.
NAMED = frozenset("""address article center dd details dialog dir div dl fieldset figure form main menu ol section summary table tbody td
th tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENT_NAMES = frozenset("comment comments reply replies".split())
ARTICLE = frozenset(("article", "main"))
# -----------------------------------------------

LEVELS = 5
SENTENCE_END = ".!?…"
#: A part with a topic's name is content above so many characters and below such a share of links.
PHRASE, LINKED = 60, 0.3


class Page:
    """Block elements as parallel lists; text blocks in page order."""

    def __init__(self, source: str):
        self.tag, self.up, self.kind = ["#"], [-1], [0]  # kind: 1 junk by markup, 2 and 3 junk by name
        self.style = [""]  # class names as written
        self.soft = [False]  # junk names that are topics as well
        self.spelled = [""]  # the id's words, where the id alone names junk
        self.texts: list[tuple[int, str, int]] = []  # (element, text, characters in links)
        self._build(source)

    def _build(self, source: str) -> None:
        stack, links, run, at, end = [0], 0, [], 0, len(source)
        linked: list[tuple[bool, str]] = run
        ends: dict[str, dict[int, int]] = {}
        opened: dict[str, int] = {}            # open elements by name, in all and since the last scope
        inner: list[dict[str, int]] = [{}]

        def push(name: str) -> None:
            stack.append(len(self.tag) - 1)
            opened[name] = opened.get(name, 0) + 1
            inner[-1][name] = inner[-1].get(name, 0) + 1
            if name in SCOPES:
                inner.append({})

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                name = self.tag[stack.pop()]
                if name in SCOPES:
                    inner.pop()
                opened[name] -= 1
                inner[-1][name] -= 1

        def close_implied(name: str) -> None:
            """Implied end tags: a paragraph ends at any block; list items and cells at their next."""
            top = self.tag[stack[-1]]
            if top == "p" or top in HEADINGS and name in HEADINGS:
                pop_to(len(stack) - 1)
            targets = CLOSES.get(name, ())
            # a scope itself may be what closes (a cell by the next cell)
            while len(stack) > 1:
                if any(inner[-1].get(t) for t in targets):
                    depth = len(stack) - 1
                    while self.tag[stack[depth]] not in targets:
                        depth -= 1
                    pop_to(depth)
                elif len(inner) > 1 and inner[-1] is not inner[0] and self.tag[scope()] in targets:
                    pop_to(len(stack) - 1 - sum(inner[-1].values()))
                return

        def scope() -> int:
            return stack[len(stack) - 1 - sum(inner[-1].values())]

        def flush() -> None:
            if run:
                text = " ".join("".join([t for _, t in run]).split())
                if text:
                    inside = sum(len("".join(t.split())) for in_link, t in run if in_link)
                    self.texts.append((stack[-1], text, inside))
                run.clear()

        def add(piece: str) -> None:
            linked.append((links > 0, entities.unescape(piece) if "&" in piece else piece))

        while at < end:
            m = TAG.search(source, at)
            if m is None:
                add(source[at:])
                break
            if m.start() > at:
                add(source[at:m.start()])
            at = m.end()
            name = m[2].lower() if m[2] else ""
            if not name:
                if m[0].startswith("<![CDATA["):
                    add(m[0][9:-3])
                continue
            if not m[1]:
                if name in RAW and not m[3].rstrip().endswith("/"):
                    shut = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
                    at = shut.end() if shut else end
                    continue
                if name in UNSEEN and not m[3].rstrip().endswith("/"):
                    if name not in ends:
                        ends[name] = self._ends(source, name)
                    at = ends[name].get(m.start(), at)
                    continue
                if name == "br":
                    run.append((links > 0, " "))
                elif name == "a":
                    links = 1
                if name in BLOCKS:
                    flush()
                    close_implied(name)
                    links = 0
                    if name not in VOID:
                        self.tag.append(name)
                        self.up.append(stack[-1])
                        kind, soft, spelled = self._kind(name, m[3])
                        self.kind.append(kind)
                        self.soft.append(soft)
                        self.spelled.append(spelled)
                        style = CLASS.search(m[3])
                        self.style.append(style[1] if style else "")
                        push(name)
            elif name == "a":
                links = 0
            elif opened.get(name):
                flush()
                depth = len(stack) - 1
                while self.tag[stack[depth]] != name:
                    depth -= 1
                pop_to(depth)
                links = 0
        flush()

    @staticmethod
    def _ends(source: str, name: str) -> dict[int, int]:
        """Where the elements of a name end, by where they start; an end tag closes
        the last one open, and those never closed are left out."""
        found, opened = {}, []
        for m in re.finditer(f"<(/?){name}(?=[\\s/>])([^>]*)>?", source, re.I):
            if not m[1]:
                if not m[2].rstrip().endswith("/"):
                    opened.append(m.start())
            elif opened:
                found[opened.pop()] = m.end()
        return found

    @staticmethod
    def _kind(name: str, attrs: str) -> tuple[int, bool, str]:
        """(kind, soft, spelled id): see ``__init__``."""
        if name in JUNK_TAGS:
            return 1, False, ""
        if not attrs or name in ("html", "body"):
            return 0, False, ""
        by: dict[str, list[str]] = {}
        spelled_id = ""
        for key, value in ATTR.findall(attrs):
            key, spelled = key.lower(), value.strip("\"'")
            value = spelled.lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return 1, False, ""
            if key == "role" and value in JUNK_ROLES or key == "style" and re.search(r"display\s*:\s*none", value):
                return 1, False, ""
            if key in ("class", "id") and name in NAMED:
                names = NAME_BREAK.sub(" ", spelled).lower().split()
                if name in ARTICLE:  # an article is junk only as a reader's comment
                    if not COMMENT_NAMES.isdisjoint(names):
                        return 1, False, ""
                elif hits := [x for x in names if x in JUNK_NAMES or JUNK_STEM.search(x)]:
                    by[key] = hits
                    if key == "id" and len(hits) < len(names):
                        spelled_id = " ".join(names)
        hits = [h for hs in by.values() for h in hs]
        if not hits:
            return 0, False, ""
        return 2 if LAYOUT_NAMES.issuperset(hits) else 3, TOPIC_NAMES.issuperset(hits), spelled_id if "class" not in by else ""

    def main_text(self) -> str:
        texts, up, tag = self.texts, self.up, self.tag
        n = len(tag)
        # text of each element, below junk by markup not counted (parents come before children)
        cut = [k == 1 for k in self.kind]
        for i in range(1, n):
            cut[i] = cut[i] or cut[up[i]]
        size = self._sums([(e, len(t)) for e, t, _ in texts if not cut[e]])
        linked = self._sums([(e, l) for e, _, l in texts if not cut[e]])
        # an id that spells its section's heading names no junk
        heads: dict[int, str] = {}
        for e, t, _ in texts:
            if tag[e] in HEADINGS and self.spelled[up[e]]:
                heads.setdefault(up[e], " ".join(re.sub(r"[^a-z0-9]+", " ", t.lower()).split()))
        titled = [bool(s) and heads.get(i, "") == s for i, s in enumerate(self.spelled)]
        # a name marks junk, unless the element holds the article or, where no tag names one, most of the page
        articles = self._sums([(i, 1) for i in range(1, n) if tag[i] in ARTICLE and not cut[i]])
        blocks = self._sums([(e, 1) for e, _, _ in texts if not cut[e]])
        markup, whole = cut, size

        def named(home: int) -> list[bool]:
            """Junk by markup or name; ``home``: where topics' names need more than the name."""
            cut, at_home = list(markup), [i == home for i in range(n)]
            for i in range(1, n):
                at_home[i] = at_home[i] or at_home[up[i]] or tag[i] in ARTICLE
                most = not articles[0] and blocks[i] >= 3 and whole[i] > (0.6 if self.kind[i] == 2 else 0.9) * whole[0]
                topic = at_home[up[i]] and self.soft[i] and whole[i] > PHRASE and linked[i] <= LINKED * whole[i]
                cut[i] = cut[i] or cut[up[i]] or self.kind[i] > 1 and not articles[i] and not most and not topic and not titled[i]
            return cut

        cut = named(-1)
        live = [(e, t, l) for e, t, l in texts if not cut[e]]
        if not live:
            return ""
        size = self._sums([(e, len(t)) for e, t, _ in live])
        in_links = self._sums([(e, l) for e, _, l in live])
        points = [0.0] * n
        for e, t, l in live:
            worth = (1 + t.count(",") + t.count("、") + t.count("，") + min(len(t) / 100, 3)) * (1 - min(1.0, l / len(t)))
            node = e if tag[e] not in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "blockquote") else up[e]
            for level in range(LEVELS):
                if node < 0:
                    break
                points[node] += worth / (1, 2, 6, 9, 12)[level]
                node = up[node]
        score = [p * (1 - in_links[i] / size[i]) if size[i] else 0.0 for i, p in enumerate(points)]
        best = max(range(n), key=lambda i: (score[i], -i))
        node = best
        while node > 0 and tag[node] not in ARTICLE:
            node = up[node]
        if node > 0:
            best = node  # the article that holds the best container
        elif best > 0:
            cut = named(best)
            live = [(e, t, l) for e, t, l in texts if not cut[e]]
            size = self._sums([(e, len(t)) for e, t, _ in live])
            in_links = self._sums([(e, l) for e, _, l in live])
        keep = {best}
        last = {e: t[-1] for e, t, _ in live}
        if best > 0:
            least = max(3.0, 0.2 * score[best])
            for i in range(1, n):
                if up[i] == up[best] and not cut[i] and size[i] and in_links[i] <= 0.25 * size[i]:
                    alike = tag[i] == tag[best] and self.style[i] and self.style[i] == self.style[best]
                    prose = tag[i] == "p" and (size[i] > 80 or last.get(i, ' ') in SENTENCE_END) or tag[i] in ("h1", "h2", "h3")
                    if tag[i] in ARTICLE or tag[best] not in ARTICLE and (score[i] >= least or alike or prose):
                        keep.add(i)
        inside, lists = [False] * n, [0] * n  # lists: the topmost list of links that holds the element
        for i in range(n):
            of_links = tag[i] in ("ul", "ol", "dl", "table", "div", "section") and size[i] and in_links[i] > 0.6 * size[i]
            inside[i] = i in keep or i > 0 and inside[up[i]]
            if i > 0 and i not in keep and inside[i]:
                lists[i] = lists[up[i]] or (i if of_links else 0)
        shown = [(e, t) for e, t, _ in live if inside[e]]
        return "\n".join(t for (e, t), stays in zip(shown, self._in_flow(shown, lists)) if stays)

    def _in_flow(self, shown: list[tuple[int, str]], lists: list[int]) -> list[bool]:
        """Whether each block stays: lists of links only under a heading, after a
        colon, or with prose before and after them."""
        flow = [not lists[e] and self.tag[e] not in HEADINGS for e, _ in shown]
        first, last = (flow.index(True), len(flow) - 1 - flow[::-1].index(True)) if any(flow) else (0, -1)
        stays, kept = [], {}
        for k, (e, _) in enumerate(shown):
            if lists[e] and lists[e] not in kept:
                before = shown[k - 1] if k else None
                led = before is not None and not lists[before[0]] and (self.tag[before[0]] in HEADINGS or before[1].endswith(":"))
                kept[lists[e]] = led or first < k < last
            stays.append(not lists[e] or kept[lists[e]])
        return stays

    def _sums(self, parts: list[tuple[int, int]]) -> list[int]:
        """Totals over whole subtrees."""
        total = [0] * len(self.tag)
        for e, v in parts:
            total[e] += v
        for i in range(len(self.tag) - 1, 0, -1):
            total[self.up[i]] += total[i]
        return total


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; see the module text."""

    def run(cols: dict) -> dict:
        texts = [main_text(h) for h in cols["text"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "main": texts, "n_chars": [len(t) for t in texts]}

    src = pick(df, page_id=id_col, url=url_col, text=html_col)
    kinds = [src.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    out = map_rows(src, run, f"page_id {kinds[0]}, url {kinds[1]}, main string, n_chars long")
    return out.withColumnRenamed("main", "text")

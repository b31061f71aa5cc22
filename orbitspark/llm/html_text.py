"""Main text of web pages by tree scoring.

A page is read once into elements and blocks of text (runs between block-level tags). Each block
passes points for its length and commas to its ancestors, all to the nearest container, half as many
to each one above. A container's worth is its points and what its element counts for, discounted
by the share of its text that is links. The best container is kept, with those of its siblings that
have points of their own or read like prose and what lies between them; an article that holds it is kept whole,
and so are further articles beside it.

Tags and roles of surroundings drop what they hold. Class names, ids and forms only lower the score of an
element: it goes if its text is short, made of links or beside the text, and stays if it holds most of the page.
Readers' comments go whatever their length; they are only taken for the text of a page that has no other prose.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag without quotes; with quoted attributes; and, once a quote was found that nothing closes, one that ends before the next "<".
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>\"']*+)>")
QUOTED = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
NEAR = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
#: Character references of more digits than any character has.
LONG_REFERENCE = re.compile(r"&#(?:0*([0-9]+)|[xX]0*([0-9a-fA-F]+));?")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl".split())
#: Elements that hold no main text.
DROPPED = frozenset("annotation annotation-xml aside audio canvas dialog embed footer head iframe input map menu nav noscript optgroup option select svg search template textarea video".split()) | RAW
#: Elements that are text within a paragraph, and one that is within an article; elsewhere they hold none.
WITHIN_PROSE, WITHIN_ARTICLE = frozenset({"button", "object"}), frozenset({"fieldset", "object"})
CONTAINERS = frozenset("article blockquote body center dd div figure html main pre section table td th".split())
#: What an element counts for before its text does.
WORTH = {"article": 30.0, "main": 15.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "body": -5.0, "html": -10.0, "dd": -3.0, "th": -5.0, "figure": -3.0}
#: Elements that a new one of the same group ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|aria-modal)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Words of classes and ids of what surrounds an article.
AROUND = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert[a-z]*|adbox|adsense|adslot|sponsor[a-z]*|promo[a-z]*|banner|sidebar|side|rail|menu|nav|navbar|navigation|breadcrumbs?|crumbs|comments?|commentlist|respond|repl(?:y|ies)"
    r"|disqus|discussion|cookies?|cookiebar|consent|gdpr|notices?|notification|alert|pop-?up|modal|overlay|newsletter|subscri[a-z]*|sign-?up|paywall|shar(?:e|ing)|social|related|recommend[a-z]*|more-?links"
    r"|footer|footnav|foot|header|masthead|topbar|pagination|pager|toolbar|widgets?|skip|legal|copyright|login|search|tags|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
#: Those of them that hardly ever name a part of an article.
FIRM = re.compile(
    r"(?:ads?|adverts?|advert[a-z]*|adbox|adsense|adslot|sponsor[a-z]*|promo[a-z]*|sidebar|nav|navbar|breadcrumbs?|crumbs|comments?|commentlist|disqus|respond|cookies?|cookiebar|consent|gdpr|pop-?up|modal|overlay"
    r"|newsletter|subscri[a-z]*|sign-?up|paywall|footer|footnav|masthead|topbar|pagination|pager|toolbar|widgets?|outbrain|taboola)",
    re.I,
)
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?=$|[\s_-])", re.I)
#: Names of a layout that has a sidebar, not of the sidebar.
LAYOUT = re.compile(r"(?:has|with|no|without)[_-]|sidebar[_-](?:left|right|none|off|on)\b|\w+[_-](?:enabled|open|closed)\b", re.I)
#: Words that name what readers have written, alone or at an end of a class or id.
READER_NAMES = re.compile(r"(?:comments?|comment-?list|commenters?|disqus|respond|replies)", re.I)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: What an element may be by its tag and attributes: text, text of a lower score in three grades, surroundings, or readers' comments.
TEXT, WEAK, FORM, LOW, OUT, READERS = range(6)
#: The share of its points that text of a lower score passes on, and that counts when it is weighed against the rest of the page.
PASSES = {WEAK: 0.5, FORM: 0.0, LOW: 0.0, READERS: 0.0}
WEIGHS = {WEAK: 1.0, FORM: 1.0, LOW: 0.25, READERS: 0.25}
#: Characters under which text of a lower score is short, and from which a block without links is prose.
SHORT, LINE = 140, 25
#: Surroundings that may hold the text of a page that has none elsewhere.
LENIENT = frozenset("aside dialog footer header".split())
#: What an end tag of a few elements doesn't reach beyond.
WALLS = ("table", "td", "article", "main", "body")


def reader_name(token: str) -> bool:
    """Whether a class or id names readers' comments, and not a layout that has them."""
    parts = re.split("[_-]+", token.strip("_-"))
    return not LAYOUT.match(token) and any(READER_NAMES.fullmatch(x) for x in ("-".join(parts), parts[0], parts[-1]))


def surrounds(tag: str, attrs: str, in_article: bool, in_prose: bool, lenient: bool = False) -> int:
    """Whether an element and all it holds is taken for surroundings, or how it is graded; if lenient, some only get a grade."""
    out = FORM if lenient else OUT
    if tag in WITHIN_PROSE | WITHIN_ARTICLE and not (in_prose and tag in WITHIN_PROSE) and not (in_article and tag in WITHIN_ARTICLE):
        return OUT
    if tag in DROPPED or (tag == "header" and not in_article):
        return out if tag in LENIENT else OUT
    plain = FORM if tag == "form" else TEXT
    if not attrs:
        return plain
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN_STYLE.search(found.get("style", "")):
        return out if tag not in ("html", "body") else TEXT
    role = found.get("role", "").lower()
    if role in ROLES:
        return out if role not in ("menu", "menubar", "navigation") else OUT
    if role == "form":
        plain = FORM
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    if not names or tag in ("html", "body", "main"):
        return plain
    if tag == "article":
        return READERS if any(READER_NAMES.fullmatch(token) for token in names.split()) else plain
    if tag in HEADINGS or tag == "header":
        return plain
    boxes, own = TEXT, False
    for token in names.split():
        if tag in BLOCK and tag != "p" and reader_name(token):
            return READERS
        around = AROUND.search(token)
        if around and around[0].strip("_-") == token:
            return LOW if FIRM.fullmatch(token) and tag in BLOCK and tag != "p" else max(WEAK, plain)
        if around and not LAYOUT.match(token):
            parts = re.split("[_-]+", token.strip("_-"))
            firm = tag in BLOCK and tag not in ("p", "section") and (FIRM.fullmatch(parts[0]) or FIRM.fullmatch(parts[-1]))
            boxes = max(boxes, LOW if firm else WEAK)
        elif ARTICLE_NAMES.search(token):
            own = True
    return max(plain, TEXT if own else boxes)


def plain(text: str) -> str:
    """Text with its character references decoded and white space runs as one space."""
    if "&#" in text:
        text = LONG_REFERENCE.sub(lambda m: m[0] if len(m[0]) < 12 else f"&#{m[1]};" if m[1] and len(m[1]) < 8 else f"&#x{m[2]};" if m[2] and len(m[2]) < 7 else "\ufffd", text)
    return SPACE.sub(" ", unescape(text)).strip()


class Page:
    """Elements in page order with their parents, and the blocks of text that are not surroundings.

    A page is read in one pass whose time is proportional to its length, however deep or broken it is: no
    tag is looked for where none ends, an unclosed quote is looked for once, and open elements are found by name.
    """

    def __init__(self, html: str, lenient: bool = False):
        self.tags, self.parents = ["html"], [-1]
        self.grades: dict[int, int] = {}  # of elements of a lower score
        self.runs: list[list] = []  # element, text, characters in links
        self.lenient = lenient
        self.stack, self.blocks, self.places = [0], [0], {}  # open elements, where the blocks are among them, and each name
        self.dropped: set[int] = set()
        self.links = self.articles = 0
        self.pieces: list[tuple[str, bool]] = []
        self.read(html)

    def nearest(self, *names: str) -> int:
        """Where in the stack the innermost open element of these names is; 0 for none."""
        return max((p[-1] for name in names if (p := self.places.get(name))), default=0)

    def flush(self) -> None:
        if self.pieces:
            text = plain("".join(p for p, _ in self.pieces))
            if text:
                self.runs.append([self.stack[self.blocks[-1]], text, sum(len(plain(p)) for p, link in self.pieces if link)])
            self.pieces = []

    def push(self, tag: str, attrs: str) -> None:
        i, depth = len(self.tags), len(self.stack)
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.stack.append(i)
        self.places.setdefault(tag, []).append(depth)
        if tag in BLOCK:
            self.blocks.append(depth)
        grade = TEXT if self.dropped else surrounds(tag, attrs, self.articles > 0, self.nearest("p") > 0, self.lenient)
        if grade == OUT:
            self.dropped.add(i)
        elif grade:
            self.grades[i] = grade
        self.links += tag == "a"
        self.articles += tag in ("article", "main")

    def pop_to(self, depth: int) -> None:
        """Ends the open elements from this place of the stack on."""
        while len(self.stack) > depth:
            i = self.stack.pop()
            tag = self.tags[i]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            self.dropped.discard(i)
            self.links -= tag == "a"
            self.articles -= tag in ("article", "main")

    def close(self, tag: str, block: bool) -> None:
        k = self.nearest(tag)
        if not k or (not block and self.blocks[-1] > k):  # an inline end tag reaches no further than its block
            return
        if tag in ("p", "li", "a", "span") and self.nearest(*WALLS) > k:
            return
        self.pop_to(k)

    def open(self, tag: str, attrs: str, block: bool) -> None:
        if block:  # a block ends an open paragraph
            k = self.blocks[-1]
            name = self.tags[self.stack[k]]
            if k and (name == "p" or (name in HEADINGS and tag in HEADINGS)):
                self.pop_to(k)
        if tag in ENDS:
            k = self.nearest(*ENDS[tag])
            if k > self.nearest(*SCOPE[tag]):
                self.pop_to(k)
        self.push(tag, attrs)

    def read(self, html: str) -> None:
        at = start = 0
        last, broken, data = html.rfind(">"), False, True
        while (lt := html.find("<", start)) >= 0:
            start = lt + 1
            first = html[start : start + 1]
            if first == "!" and html.startswith("<!--", lt):
                self.put(html[at:lt])
                end = lt + 1 if html.startswith("<!-->", lt) else html.find("-->", lt + 4)
                if end < 0:
                    at = len(html)
                    break
                at = start = end + (4 if end == lt + 1 else 3)
                continue
            if lt > last:  # no tag ends from here on, but a comment may begin
                if (comment := html.find("<!--", lt)) < 0:
                    break
                start = comment
                continue
            if first in ("!", "?") and first:
                self.put(html[at:lt])
                end = html.find("]]>", lt) if data and html.startswith("<![CDATA[", lt) else -1
                if end >= 0:
                    self.put(html[lt + 9 : end].replace("&", "&amp;"))
                    at = start = end + 3
                else:
                    data = data and not html.startswith("<![CDATA[", lt)
                    at = start = html.find(">", lt) + 1
                continue
            m = TAG.match(html, lt) or (NEAR if broken else QUOTED).match(html, lt)
            if m:
                closes, tag, attrs = m.groups()
                end = m.end()
            else:
                m = NAME.match(html, lt)
                if not m:
                    continue
                broken = True
                end = html.find(">", m.end()) + 1
                closes, tag, attrs = m[1], m[2], html[m.end() : end - 1]
            self.put(html[at:lt])
            at = start = end
            tag = tag.lower()
            block = tag in BLOCK
            if block:
                self.flush()
            if closes:
                self.close(tag, block)
            elif tag == "br":
                self.put(" ")
            elif tag not in VOID:
                self.open(tag, attrs, block)
                if tag in RAW:
                    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                    at = start = found.start() if found else len(html)
                elif attrs.rstrip().endswith("/") and not block and tag not in ("a", "span", "b", "i", "em", "strong"):
                    self.pop_to(len(self.stack) - 1)
        self.put(html[at:])
        self.flush()

    def put(self, text: str) -> None:
        if text and not self.dropped:
            self.pieces.append((text, self.links > 0))


def chosen_text(page: Page, least: int = 0) -> str:
    """The blocks of a page that belong to its main text. Sums go up and marks go down the elements, each in one pass."""
    tags, parents, n = page.tags, page.parents, len(page.tags)
    length, linked, own, gains = [0] * n, [0] * n, [0.0] * n, []
    for i, text, in_links in page.runs:
        size = len(text)
        gains.append(0.0 if tags[i] in HEADINGS else (1 + text.count(",") + text.count("，") + text.count("、") + min(size / 100, 3.0)) * min(1.0, size / 25))
        length[i] += size
        linked[i] += in_links
        own[i] += gains[-1]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        length[p] += length[i]
        linked[p] += linked[i]
        own[p] += own[i]

    def density(k: int) -> float:
        return min(1.0, linked[k] / length[k])

    # Readers' comments are never the text, however long they are, while other prose stands.
    read, low = [False] * n, [False] * n
    for i in range(1, n):
        p, grade = parents[i], page.grades.get(i, TEXT)
        read[i] = read[p] or grade == READERS
        low[i] = low[p] or grade in (FORM, LOW)
    prose = any(not read[i] and not low[i] and tags[i] not in HEADINGS and len(text) - in_links >= LINE for i, text, in_links in page.runs)
    # An element that holds most of the page, comments left out, is not taken for surroundings, whatever its name.
    counted = [0.0] * n
    for (i, _, _), gain in zip(page.runs, gains):
        counted[i] += 0.0 if prose and read[i] else gain
    for i in range(n - 1, 0, -1):
        counted[parents[i]] += counted[i]
    total = counted[0]
    grades = {}
    for k, grade in page.grades.items():
        if prose and grade == READERS:
            grades[k] = grade
            continue
        rest = total - counted[k]
        alone = rest <= 1e-9 and grade not in (LOW, READERS) and length[k] >= least
        if length[k] and not (alone or (length[k] >= SHORT and counted[k] * WEIGHS[grade] * (1 - density(k)) > rest)):
            grades[k] = grade

    share, graded, barred, nearest = [1.0] * n, [False] * n, [False] * n, [0] * n
    for i in range(1, n):
        p, grade = parents[i], grades.get(i, TEXT)
        share[i] = share[p] * PASSES.get(grade, 1.0)
        graded[i] = graded[p] or grade != TEXT
        barred[i] = barred[p] or grade in (FORM, LOW, READERS)
        nearest[i] = i if tags[i] in CONTAINERS else nearest[p]
    gained, holds = [0.0] * n, [False] * n
    for (i, _, _), gain in zip(page.runs, gains):
        gained[nearest[i]] += gain * share[i]
        holds[nearest[i]] = True
    for i in range(n - 1, 0, -1):
        if holds[i]:
            up = nearest[parents[i]]
            gained[up] += gained[i] / 2
            holds[up] = True
    # What holds nothing but surroundings can't be the text.
    points = {k: gained[k] for k in range(n) if holds[k] and not barred[k]}
    if not points:
        return ""

    def worth(k: int) -> float:
        bonus = WORTH.get(tags[k], 0.0)
        score = points[k] + (min(bonus, 0.0) if graded[k] else bonus)
        return score * (1 - density(k)) if score > 0 else score

    best = k = max(points, key=lambda k: (worth(k), -k))
    while k >= 0:
        if tags[k] == "article" and k in points:
            best = k
        k = parents[k]
    top, parent = worth(best), parents[best]
    page_wide = tags[best] in ("body", "html")

    def spare(k: int) -> bool:
        """Whether an element of a lower score within the text is kept: neither short nor made of links."""
        enough = 0.0 if grades[k] == WEAK and not page_wide else 0.1 * total
        return grades[k] not in (LOW, READERS) and length[k] >= SHORT and density(k) <= 0.33 and own[k] >= enough

    def keep_sibling(s: int) -> bool:
        """Whether an element beside the best container belongs to the text."""
        if tags[s] in HEADINGS:
            return density(s) == 0 and s < best
        if tags[s] == "p":
            return (length[s] > 80 and density(s) < 0.25) or (density(s) == 0 and length[s] > 20)
        points_of = points.get(s, 0.0) / (PASSES[grades[s]] if grades.get(s) == WEAK and tags[s] == "section" else 1.0)
        return points_of * (1 - density(s)) >= max(10.0, 0.2 * top)

    keeps = {best}
    several = tags[best] == "article" and any(tags[s] == "article" and parents[s] == parent and s != best for s in range(max(parent, 0), n))
    if parent >= 0 and (several or tags[best] not in ("article", "main", "body")):
        # Those that belong to the text by themselves, then what lies between them, and lists next to them with their headings.
        row = [i for i in range(parent + 1, n) if parents[i] == parent and length[i]]
        held = [j for j, s in enumerate(row) if s == best or ((not several or tags[s] == "article") and keep_sibling(s) and (s not in grades or spare(s)))]
        keeps.update(row[j] for j in held)
        keeps.update(s for s in row[held[0] : held[-1]] if s not in grades and (tags[s] in LISTS or density(s) <= 0.6))
        for step, edge in ((1, held[-1]), (-1, held[0])) if not several else ():
            waiting = []
            j = edge + step
            while 0 <= j < len(row) and row[j] not in grades and density(row[j]) <= 0.6 and (tags[row[j]] in LISTS or tags[row[j]] in HEADINGS):
                waiting.append(row[j])
                if tags[row[j]] in LISTS:
                    keeps.update(waiting)
                    waiting = []
                j += step

    # Where the text is the whole page, boxes of links above its first heading or prose are menus.
    first = next((i for i, text, in_links in page.runs if not in_links and (tags[i] in HEADINGS or len(text) >= 25)), n) if page_wide else 0
    wanted, menu = [i in keeps for i in range(n)], [False] * n
    for i in range(1, n):
        p = parents[i]
        wanted[i] = wanted[i] or (wanted[p] and (i not in grades or spare(i)))
        menu[i] = menu[p] or (tags[i] in ("ul", "ol", "div", "section", "table") and length[i] > 0 and density(i) > 0.6)
    return "\n".join(text for i, text, _ in page.runs if wanted[i] and not (i < first and menu[i]))


def main_text(html: str | None) -> str:
    """The main text of a page: blocks joined by line ends; empty if there is none. Null counts as empty.

    A page without text outside what counts as surroundings is read again: then asides, headers, footers and hidden
    elements may hold it, if they are long and not made of links. Long, deep and broken pages take time in proportion.
    """
    return chosen_text(Page(html or "")) or chosen_text(Page(html or "", lenient=True), SHORT)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per page: the columns of ``keep``, text and n_chars.

    Null html counts as empty and gives an empty text. Repeated rows give repeated rows; an empty table
    gives none; other columns are ignored. Pages of any length are read whole, in time and memory in proportion to it.
    """
    n = len(keep)

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f"k{i}" for i in range(n)), "text", "n_chars"])

    kinds = ", ".join(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_col).alias("html")).mapInArrow(run, f"{kinds}, text string, n_chars long")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")

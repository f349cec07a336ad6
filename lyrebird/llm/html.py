"""Main text of web pages by equivalence-class template deduction over the pages of a host.

Tokens. A page is cut into tags and runs of text. A tag's token is its path of open elements with their
classes; a run's token is its path and its words. Elements that HTML closes by itself (a paragraph at the
next block, list items, table cells) are closed, unknown end tags are ignored.

Classes. Tags with the same vector of occurrences over the distinct pages form an equivalence class. A class
is valid if it occurs on ``SUPPORT`` pages or more, equally often on all pages that have it. From the classes on
most pages down, a valid class joins the nest if its tags come in the same order on all its pages, each in the
same gap of the classes that are on all those pages; a slot is a gap, named by the tags of the nest to either side.

Template text. A block's text (with the links and emphasis in it) is template if ``NEARLY`` all pages of the host
have it at the same path; inside an article only on ``FIRM`` pages or more, as the element speaks for it. Text that fewer pages share stays: shared passages and copies of
an article look the same as an optional notice. Pages that would lose more than ``COPIES`` words for each word
left are copies of each other and lose none.

Slots. The nearest element with a role (article and main against menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts and styles, by element, class, id and role) decides first: pages with an article
or main element give its runs, others the runs without a role. Where no page of the host has an article or main
element, slots that over all pages are mostly links, or short and mostly repeated, go too, and the slots that hold
``MAJOR`` of what is left on the host say where the article is: a page's text is that of the innermost element with nearly
all of its words in those slots, and of headings right before it. Hosts with fewer than ``SUPPORT`` pages have no
template: their runs are judged by roles alone.

Scale. Hosts are dealt into chunks of about ``CHUNK`` pages, and about ``CHUNK_BYTES`` at most, by a hash of the row, so
that a host with a third of all pages is many groups; a chunk is all that a task holds at a time.

Defined cases: a null or empty page, or one without main text, gives an empty text; a null url is a host of
its own; repeated pages count as one in deduction and give a row each; pages of any length are read whole;
empty tables give empty results. Only the id, url and html columns are read.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import conf_int, settle, ship
from .urls import host_of

SUPPORT, CHUNK, CHUNK_BYTES = 3, 256, 16 << 20
#: Bytes of pages for each task, about, up to so many tasks.
TASK_BYTES, MOST_TASKS = 8 << 20, 100_000
#: Share of the pages that have a template's text; words of template to a word of a page's own, at most.
NEARLY, COPIES = 0.9, 2
#: Share of a host's words that makes a slot one of the article.
MAJOR = 0.1
#: Distinct pages that it takes to call text template against an article element that holds it.
FIRM = 10
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>""",
    re.S,
)
ATTR = re.compile(r"""\b(class|id|role|aria-label|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "label", "nobr", "center-inline",
}
#: What an opening tag closes, if it is open and nothing of the second set stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
OUT = {
    "nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "option", "textarea", "dialog", "menu", "head",
    "title", "object", "canvas", "audio", "video", "map", "fieldset", "input", "noembed", "noframes", "xmp", "math-hidden",
}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HINTS = {
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "sidebars", "aside", "complementary", "contentinfo",
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "sponsor", "sponsored", "promo", "promos", "promotion", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "disclaimer", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "comment",
    "comments", "commentlist", "respond", "replies", "reply", "disqus", "share", "sharing", "social", "related", "recommended", "widget", "widgets", "toolbar", "pagination", "pager",
    "copyright", "skip", "alert",
}
#: In an article these need more than a word of a class of several (``related-work``): the element must be mostly links.
WEAK = {
    "header", "masthead", "aside", "complementary", "contentinfo", "banner", "notice", "notices", "disclaimer", "overlay", "search", "form", "related", "recommended", "widget", "widgets",
    "copyright", "skip", "alert",
}
#: With one of these beside them, the first of the weak ones are enough (``related-posts``).
LISTS = {
    "posts", "post", "articles", "article", "stories", "links", "items", "topics", "products", "news", "pages",
    "reading",
}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Run:
    """A run of text: its path, its role (1 main, -1 out, 0 none), the block it is in, whether it is in a link, the number of
    the element that holds it."""

    __slots__ = ("block", "element", "link", "path", "role", "text")

    def __init__(self, text: str, path: str, role: int, block: int, link: bool, element: int):
        self.text, self.path, self.role, self.block, self.link, self.element = text, path, role, block, link, element


def _weak(names: str) -> bool:
    """Whether the hints in an element's classes are weak ones, each only a word among others."""
    for token in names.split():
        found = {w.lower() for w in WORD.findall(token)}
        if found & HINTS and (
            len(found) == 1 or found & HINTS - WEAK or found & {"related", "recommended"} and found & LISTS
        ):
            return False
    return True


def _role(name: str, attrs: str, inside: bool = False) -> tuple[int | None, str]:
    """What an element says about the text in it, and its classes for the path; inside says that it is in an article. None
    stands for a weak hint: its share of links is to decide."""
    if not attrs.strip():
        return (1 if name in MAIN else -1 if name in OUT else 0), ""
    words: set[str] = set()
    shown, hidden, classes = "", False, ""
    for key, *values in ATTR.findall(attrs):
        value = "".join(values)
        key = key.lower()
        if key == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        elif key == "hidden":
            hidden = True
        else:
            found = [w.lower() for w in WORD.findall(value)]
            if key == "class":
                classes = value
            elif key == "role":
                classes += f" {value}"
            # In an article ids and labels are made from the words of headings.
            if not (inside and key in ("id", "aria-label") and (len(found) > 1 or name in HEADINGS)):
                words.update(found)
            if key != "id" and key != "aria-label":
                shown += "." + value.strip()
    if hidden:
        return -1, shown
    if name in ("html", "body"):
        return 0, shown
    if name in MAIN:
        return (-1 if words & {"comment", "comments", "reply", "ad", "advert", "sponsored"} else 1), shown
    if name in OUT:
        return -1, shown
    if (name not in INLINE or name in ("span", "a")) and words & HINTS:
        return (
            None if inside and _weak(classes) and words & HINTS <= {w.lower() for w in WORD.findall(classes)} else -1
        ), shown
    return (1 if "main" in words and "role" in attrs else 0), shown


#: Elements that are parts of a text, not what holds it.
PARTS = {"p", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figcaption", "caption", *HEADINGS}
#: Tags with their places, runs, and for each element that holds text the one it is in.
Page = tuple[list[tuple[str, int]], list["Run"], list[int]]


def parse(page: str) -> Page:
    """Tags as (token, place among the runs) and runs, in page order; for each element that holds text the one it is in, -1 for none."""
    stack: list[tuple[str, int, str, int, int]] = []  # name, role in force, path, own role, place among the weak
    weak: list[list[int]] = []  # first run, run after the last
    parents: list[int] = []
    holders = [-1]  # of the page, and of the stack's elements
    tags: list[tuple[str, int]] = []
    runs: list[Run] = []
    block, at, links = 0, 0, 0
    path, role = "", 0

    def text(part: str) -> None:
        if part:
            runs.append(Run(" " if part.isspace() else part, path, role, block, links > 0, holders[-1]))

    def pop(k: int) -> None:
        nonlocal path, role, links
        links -= sum(x[0] == "a" for x in stack[k:])
        for x in stack[k:]:
            if x[4] >= 0:
                weak[x[4]][1] = len(runs)
        del stack[k:]
        del holders[k + 1 :]
        path, role = (stack[-1][2], stack[-1][1]) if stack else ("", 0)

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        if name not in INLINE:
            block += 1
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            tags.append((f"/{path}>{name}", len(runs)))
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["attrs2"] or ""
        closing, walls = CLOSES.get(name, (set(), set()))
        if name not in INLINE and name not in VOID and not closing:
            closing, walls = {"p"}, {"table", "td", "th", "button", "object"}
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in walls:
                break
            if stack[k][0] in closing:
                pop(k)
                break
        own, shown = _role(name, attrs, role == 1)
        here = f"{path}>{name}{shown}"
        tags.append((here, len(runs)))
        if name == "br":
            text(" ")
        if name in VOID or attrs.rstrip().endswith("/") and name not in RAW and name not in (
            "p", "div", "span", "a", "li", "article", "main", "section", "b", "i", "em", "strong",
        ):
            continue
        if name in RAW:
            # The content is not markup; it ends at the element's own end tag.
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if own is None:
            weak.append([len(runs), -1])
        elif name in HEADINGS and not own and role == -1:
            # The title of an article may stand in a header of its own.
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][3]), 0)
            own = int(stack[k][0] == "header" and k > 0 and stack[k - 1][1] == 1)
        stack.append((name, own or role, here, own or 0, len(weak) - 1 if own is None else -1))
        if name not in INLINE and name not in PARTS:
            parents.append(holders[-1])
            holders.append(len(parents) - 1)
        else:
            holders.append(holders[-1])
        path, role = here, own or role
        links += name == "a"
    for a, b in weak:
        inside = [r for r in runs[a : b if b >= 0 else len(runs)] if r.role == 1]
        if 2 * sum(len(r.text.split()) for r in inside if r.link) >= sum(len(r.text.split()) for r in inside):
            for r in inside:
                r.role = -1
    return tags, runs, parents


def _within(runs: list[Run], parents: list[int], kept: set[int], major: set[int]) -> set[int]:
    """Of the kept runs those in the innermost element with nearly all words of the major ones, and headings right before it."""
    words: dict[int, int] = defaultdict(int)
    for i in major:
        n, e = len(runs[i].text.split()), runs[i].element
        while e >= 0:
            words[e] += n
            e = parents[e]
    most = sum(len(runs[i].text.split()) for i in major)
    # Elements are numbered as they open, so of those that hold enough the last is the innermost.
    holder = max((e for e, n in words.items() if n >= NEARLY * most), default=-1)

    def inside(e: int) -> bool:
        while e > holder:
            e = parents[e]
        return e == holder

    mine = {i for i in kept if holder < 0 or inside(runs[i].element)}
    before = min((i for i in mine if runs[i].text != " "), default=0) - 1
    while before >= 0 and (runs[before].text == " " or before in kept and re.search(r">h[1-6]\b", runs[before].path)):
        mine.add(before)
        before -= 1
    return mine


def _blocks(runs: list[Run]) -> list[tuple[str, list[int]]]:
    """(token, places of its runs) of each block with text: the path of its first run and all its words."""
    at: dict[int, list[int]] = defaultdict(list)
    for i, r in enumerate(runs):
        if r.text != " ":
            at[r.block].append(i)
    return [
        (
            f"{runs[places[0]].path}|{' '.join(' '.join(runs[i].text for i in places).split())}", places,
        ) for places in at.values()
    ]


def _template(
    pages: list[Page], blocks: list[list[tuple[str, list[int]]]],
) -> tuple[list[dict[int, str]], set[str], set[str]]:
    """For each page the names of the tags in the nest by their index; the tokens of text that is template; those on ``SUPPORT`` pages."""
    counts = [Counter(t for t, _ in tags) for tags, *_ in pages]
    vectors: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for n, c in enumerate(counts):
        for token, k in c.items():
            vectors[token].append((n, k))
    classes: dict[tuple[tuple[int, int], ...], set[str]] = defaultdict(set)
    for token, v in vectors.items():
        if len(v) >= SUPPORT and len({k for _, k in v}) == 1:
            classes[tuple(v)].add(token)
    nest: list[dict[int, str]] = [{} for _ in pages]
    broader: list[tuple[set[int], set[str]]] = []
    # A class joins the nest if each of its tags lies in one gap of the classes on all its pages or more.
    for k, (vector, tokens) in enumerate(sorted(classes.items(), key=lambda x: (-len(x[0]), x[0][0][1], -len(x[1])))):
        inside = {n for n, _ in vector}
        above = set().union(*(names for on, names in broader if inside <= on))
        shape, here = None, {}
        for n in inside:
            gap, order, mine = "", [], {}
            for i, (t, _) in enumerate(pages[n][0]):
                if t in tokens:
                    order.append((gap, t))
                    mine[i] = f"{k}.{len(order)}"
                elif nest[n].get(i) in above:
                    gap = nest[n][i]
            shape = shape or order
            if order != shape:
                break
            here[n] = mine
        else:
            for n, mine in here.items():
                nest[n].update(mine)
            broader.append((inside, set().union(*(m.values() for m in here.values()))))
    held: Counter[str] = Counter(t for page in blocks for t in {t for t, _ in page})
    often = {t for t, c in held.items() if c >= SUPPORT}
    return nest, {t for t in often if held[t] >= NEARLY * len(pages)}, often


def _slots(page: Page, nest: dict[int, str]) -> list[tuple[str, str]]:
    """The slot of each run: the tags of the nest to either side."""
    tags, runs, _ = page
    marks = [(tags[i][1], name) for i, name in sorted(nest.items())]
    out, k = [], 0
    for i in range(len(runs)):
        while k < len(marks) and marks[k][0] <= i:
            k += 1
        out.append((marks[k - 1][1] if k else "", marks[k][1] if k < len(marks) else ""))
    return out


def extract(pages: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    parsed: dict[str, Page] = {}
    for p in pages:
        if p and p not in parsed:
            parsed[p] = parse(p)
    distinct = list(parsed.values())
    blocks = [_blocks(runs) for _, runs, _ in distinct]
    known = len(distinct) >= SUPPORT
    nest, template, often = _template(distinct, blocks) if known else ([{}] * len(distinct), set(), set())
    slots = [_slots(x, names) for x, names in zip(distinct, nest)]
    # Evidence on each slot over all pages: words, runs, words in links and words of repeated blocks.
    seen: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    any_main = any(r.role == 1 and r.text != " " for _, runs, _ in distinct for r in runs)
    for (_, runs, _), places, mine in zip(distinct, blocks, slots):
        for token, at in places:
            for i in at:
                words = len(runs[i].text.split())
                s = seen[mine[i]]
                s[0] += words
                s[1] += 1
                s[2] += words * runs[i].link
                s[3] += words * (token in often)
    poor = {
        s for s, (
            words, count, linked, repeated,
        ) in seen.items() if 2 * linked >= words or words < 5 * count and 2 * repeated >= words
    }
    left: Counter[tuple[str, str]] = Counter()
    for (_, runs, _), mine in zip(distinct, slots):
        for r, s in zip(runs, mine):
            if not r.role and s not in poor:
                left[s] += len(r.text.split())
    major = {s for s, n in left.items() if n and n >= MAJOR * left.total()}
    texts = {}
    for p, (_, runs, parents), places, mine in zip(parsed, distinct, blocks, slots):
        has_main = any(r.role == 1 and r.text != " " for r in runs)
        kept = {i for i, r in enumerate(runs) if r.role == has_main}
        if known and not has_main and not any_main:
            # Slots that are short and repeated or all links on the whole host hold no article.
            kept = {
                i for i in kept if runs[i].text == " " or mine[i] not in poor or re.search(r">h[1-6]\b", runs[i].path)
            }
            kept = _within(runs, parents, kept, {i for i in kept if mine[i] in major and runs[i].text != " "})
        repeated, own = [], 0
        for token, at in places:
            at = [i for i in at if i in kept]
            if token in template and (not has_main or len(distinct) >= FIRM):
                repeated += at
            else:
                own += sum(len(runs[i].text.split()) for i in at)
        # Where little else would be left, the pages are copies of each other, and what they share is their text.
        if sum(len(runs[i].text.split()) for i in repeated) <= COPIES * own:
            kept.difference_update(repeated)
        out: dict[int, list[str]] = {}
        for i in sorted(kept):
            r = runs[i]
            out.setdefault(r.block, []).append(_html.unescape(r.text) if "&" in r.text else r.text)
        joined = (" ".join("".join(b).split()) for b in out.values())
        texts[p] = "\n\n".join(t for t in joined if t)
    return [texts[p] if p else "" for p in pages]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for every page."""
    ship(pages.sparkSession)
    given = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
    ).withColumn("host", host_of(F.col("url")))
    # A row for each host.
    size = F.coalesce(F.sum(F.octet_length("html").cast("long")), F.lit(0))
    parts = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(size / CHUNK_BYTES)).cast("int")
    chunks = settle(given.groupBy("host").agg(parts.alias("chunks"), size.alias("size")))
    # As many tasks as the pages have bytes for, so that the largest does not grow with them.
    whole = chunks.agg(F.sum("size")).first()[0] or 0
    tasks = min(MOST_TASKS, max(conf_int(pages.sparkSession, "spark.sql.shuffle.partitions", 200), -(-whole // TASK_BYTES)))
    dealt = given.join(chunks.drop("size"), "host")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id", "url", "html"), F.col("chunks"))).repartition(tasks, "host", "chunk")
    kind = given.schema["id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        texts = extract([x if isinstance(x, str) else None for x in group["html"]])
        return pd.DataFrame({"id": group["id"], "url": group["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = dealt.groupBy("host", "chunk").applyInPandas(run, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")

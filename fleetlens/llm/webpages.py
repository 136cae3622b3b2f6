"""Main text of web pages by removal of site templates."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stage

#: A subtree is a template of its host if it stands beside so many different main contents, and
#: beside so large a share of all that the host has: outside of articles, and inside of them, where
#: paragraphs may recur for reasons of their own.
TEMPLATE_PAGES = 5
TEMPLATE_SHARE, INNER_SHARE = 0.01, 0.2
#: From so many recurring parts on, an article of which they hold over three quarters is a near
#: copy of other articles, not a template filled in, and stays whole.
COPY_PARTS = 3

#: Elements that hold no article text, by the HTML standard's meaning of their names.
_NEVER = frozenset("head script style noscript template nav footer aside button select "
                   "textarea iframe object svg canvas menu dialog audio video".split())
#: Words in class, id or role that name such a part.
_NAMED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner "
                   "nav navbar navigation menu breadcrumb breadcrumbs sidebar complementary header "
                   "masthead footer contentinfo cookie cookies consent notice notices popup modal "
                   "newsletter subscribe signup login search share sharing social related comment "
                   "comments disqus".split())
#: Of these, words for parts that hold articles of others; the rest may as well name a layout.
_OTHERS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo related "
                    "comment comments disqus".split())
#: Words that turn the name behind them round ("has-sidebar", "no-ads"): layout, not a side part.
_DENY = frozenset("has no not with without".split())
#: "related" names a list of links, but not in names such as "related-work".
_WORK = frozenset("work works research literature studies methods concepts".split())
#: Inside an article these name its own head, as the header element does.
_HEADS = frozenset("header masthead".split())
#: A name or form hint does not hold for an element with this share of the page's main text.
_NEARLY_ALL = 0.9
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark "
                    "q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Inside an article these go with the table, list or box they belong to, not alone: equal cells,
#: items and headings recur in real articles.
_PIECES = frozenset("td th tr tbody thead tfoot caption li dt dd h1 h2 h3 h4 h5 h6".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: An element that begins ends these, up to the border named last.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
         "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure "
                      "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section "
                      "table ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""\shidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(eq=False)
class Element:
    """A node: its children and texts in page order."""

    tag: str
    parts: list = field(default_factory=list)
    drop: bool = False
    hint: bool = False
    others: bool = False
    digest: int = 0

    @property
    def main(self) -> bool:
        return self.tag in ("article", "main")


def _hidden(attributes: str, tag: str) -> bool:
    return tag not in ("html", "body", "main", "article") and bool(_HIDDEN.search(attributes))


def _side_names(attributes: str, tag: str, inside: bool) -> set[str]:
    """Words in class, id or role that name a side part; ``inside`` an article its own head is none."""
    named: set[str] = set()
    if tag in ("html", "body", "main", "article") or not attributes:
        return named
    for value in _HINT.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w.lower() for w in _WORDS.findall(name)]
            for at, word in enumerate(words):
                if (word in _NAMED and not _DENY.intersection(words[:at]) and not (inside and word in _HEADS)
                        and not (word == "related" and _WORK.intersection(words[at + 1:]))):
                    named.add(word)
    return named


def _own_text(element: Element) -> int:
    return sum(len(p.strip()) for p in element.parts if isinstance(p, str))


def _settle_hints(root: Element) -> None:
    """Drops the elements with a name or form hint, but none that holds a main element with text
    (unless it names articles of others) or nearly all of the text in main elements (of the page,
    if they have none); where only hinted elements hold that text, none that holds any goes."""
    if not any(e.hint for e, _ in _walk(root)):
        return
    held: dict[int, list[int]] = {}
    wraps: dict[int, bool] = {}
    hinted: list[Element] = []
    open_elements: list[list[int]] = []
    free, inside, dropped, under = [0, 0], 0, 0, 0
    for element, opens in _walk(root):
        step = 1 if opens else -1
        inside += step * element.main
        dropped += step * element.drop
        under += step * element.hint
        if not opens:
            done = open_elements.pop()
            if element.hint:
                hinted.append(element)
                held[id(element)] = done
                wraps[id(element)] = not inside and not element.others and done[0] > 0
            if open_elements:
                for k in (0, 1):
                    open_elements[-1][k] += done[k]
            else:
                total = done
            continue
        own = 0 if dropped else _own_text(element)
        found = [own if inside else 0, own]
        open_elements.append(found)
        if not under:
            free = [x + y for x, y in zip(free, found)]
    kind = 0 if total[0] else 1
    for element in hinted:
        size = held[id(element)][kind]
        element.drop |= not (wraps[id(element)] or size and size >= _NEARLY_ALL * total[kind])
    if not free[kind]:
        left, dropped, inside = 0, 0, 0
        for element, opens in _walk(root):
            step = 1 if opens else -1
            dropped += step * element.drop
            inside += step * element.main
            if opens and not dropped and (kind or inside):
                left += _own_text(element)
        for element in hinted if not left else ():
            if held[id(element)][kind]:
                element.drop = False


def parse(page: str, parts: bool = True) -> Element:
    """The page's element tree; unclosed and misplaced tags never lose text. Without ``parts`` it
    is not told which elements are side parts."""
    root = Element("html")
    stack, at = [root], 0

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(entities.unescape(piece) if "&" in piece else piece)

    while True:
        found = _TOKEN.search(page, at)
        text(page[at:found.start() if found else len(page)])
        if not found:
            if parts:
                _settle_hints(root)
            return root
        at = found.end()
        if found[1]:
            stack[-1].parts.append(found[1])
        if not found[3]:
            continue
        tag, attributes = found[3].lower(), found[4]
        if found[2]:
            if tag == "br" or tag == "p" and not any(e.tag == "p" for e in stack):
                stack[-1].parts.append(Element(tag))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        ends, border = _ENDS.get(tag, ((), ()))
        if tag in _CLOSES_P:
            ends, border = {*ends, "p"}, {*border, "article", "main", "section", "div", "td", "li",
                                          "body", "blockquote", "nav", "aside", "footer", "header"}
        for depth in range(len(stack) - 1, 0, -1) if ends else ():
            if stack[depth].tag in border:
                break
            if stack[depth].tag in ends:
                del stack[depth:]
                break
        if tag == "html":
            continue
        element = Element(tag, drop=tag in _NEVER or parts and _hidden(attributes, tag))
        if parts and not element.drop and (attributes or tag in ("form", "header")):
            inside = any(e.main for e in stack)
            names = _side_names(attributes, tag, inside)
            element.hint = tag == "form" or tag == "header" and not inside or bool(names)
            element.others = bool(names & _OTHERS)
        stack[-1].parts.append(element)
        if tag in _VOID or attributes.endswith("/") and tag not in _RAW and tag in ("path", "rect", "use"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag in ("title", "textarea"):
                element.parts.append(entities.unescape(page[at:stop]))
            at = page.find(">", stop) + 1 or len(page) if end else len(page)
            continue
        stack.append(element)


def _walk(root: Element) -> Iterator[tuple[Element, bool]]:
    """Every element twice, before (True) and behind its content; no recursion, pages may be deep."""
    todo = [(root, True)]
    while todo:
        element, opens = todo.pop()
        yield element, opens
        if opens:
            todo.append((element, False))
            todo.extend((p, True) for p in reversed(element.parts) if isinstance(p, Element))


def hash_subtrees(root: Element) -> None:
    """``digest`` of every element: its tag and, in order, its words and its children's digests."""
    for element, opens in _walk(root):
        if not opens:
            parts = [f"<{p.digest}>" if isinstance(p, Element) else " ".join(p.split())
                     for p in element.parts]
            content = "\0".join(p for p in parts if p and p != "<0>")
            element.digest = xxhash.xxh64_intdigest(f"{element.tag}\0{content}") if content else 0


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def _counted(root: Element) -> list[tuple[Element, bool]]:
    """Elements of the body with text that hold no main element, and whether they lie in one."""
    holds: set[int] = set()
    open_elements: list[Element] = []
    for element, opens in _walk(root):
        if opens:
            open_elements.append(element)
            if element.main:
                holds.update(id(e) for e in open_elements)
        else:
            open_elements.pop()
    found, inside, skipped = [], 0, 0
    for element, opens in _walk(root):
        if element.main:
            inside += 1 if opens else -1
        if element.tag == "head":
            skipped += 1 if opens else -1
        if (opens and not skipped and id(element) not in holds and element.digest
                and element.tag not in _INLINE and element.tag not in ("html", "body")
                and not (inside and element.tag in _PIECES)):
            found.append((element, bool(inside)))
    return found


def _inner_dead(root: Element, marked: set[int]) -> set[int]:
    """Those of the recurring elements inside main elements that go: all, unless the article
    would be left without text or is a near copy of others."""
    total = gone = parts = inside = dropped = dead = 0
    for element, opens in _walk(root):
        step = 1 if opens else -1
        inside += step * element.main
        dropped += step * element.drop
        counts = inside and not dropped
        if opens and counts and not dead and id(element) in marked:
            parts += 1
        dead += step * (id(element) in marked)
        if opens and counts:
            own = _own_text(element)
            total, gone = total + own, gone + (own if dead else 0)
    copy = parts >= COPY_PARTS and 4 * gone > 3 * total
    return set() if gone >= total or copy else marked


def _content(root: Element) -> int:
    """Hash of the main elements, or of the whole page where there is none."""
    mains = [e.digest for e, opens in _walk(root) if opens and e.main]
    return xxhash.xxh64_intdigest(repr(mains)) if any(mains) else root.digest


def _place(element: Element, inside: bool) -> int:
    """The subtree's hash as it is counted: the same part inside of an article is another one."""
    return _signed((element.digest + 0x9E3779B97F4A7C15 * inside) % (1 << 64))


def main_text(root: Element, templates: set[int]) -> str:
    """Text of what is no template and no side part; of the main elements only if any has text."""
    dead: set[int] = set()
    if templates:
        marked = [(id(e), inside) for e, inside in _counted(root) if _place(e, inside) in templates]
        dead = {i for i, inside in marked if not inside}
        dead |= _inner_dead(root, {i for i, inside in marked if inside})
    every: list[str] = []
    inside: list[str] = []
    depth = 0
    todo: list = [root]
    while todo:
        part = todo.pop()
        if part is None:
            depth -= 1
        elif isinstance(part, str):
            every.append(part)
            if depth:
                inside.append(part)
        elif not part.drop and id(part) not in dead:
            gap = [] if part.tag in _INLINE else [" "]
            depth += part.main
            todo.extend([*gap, *([None] if part.main else []), *reversed(part.parts), *gap])
    chosen = " ".join("".join(inside).split())
    return chosen or " ".join("".join(every).split())


def _subtree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per page and subtree, and one of the page itself (digest 0, ``inside`` NULL)."""
    for batch in batches:
        rows: list[list] = [[], [], [], [], [], []]
        for page_id, sig, host, page in zip(*(c.to_pylist() for c in batch.columns)):
            root = parse(page, parts=False)
            hash_subtrees(root)
            content = _signed(_content(root))
            for digest, inside in {(0, None), *((_place(e, inside), inside) for e, inside in _counted(root))}:
                for column, value in zip(rows, (page_id, sig, host, digest, content, inside)):
                    column.append(value)
        yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
                               pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64()),
                               pa.array(rows[4], pa.int64()), pa.array(rows[5], pa.bool_())],
                              names=["page_id", "sig", "host", "digest", "content", "inside"])


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, found in zip(batch.column("html").to_pylist(), batch.column("found").to_pylist()):
            root = parse(page)
            if found:
                hash_subtrees(root)
            texts.append(main_text(root, set(found or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"),
                                          pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    """The lower-case host of an address, NULL where there is none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(found != "", F.lower(found))


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url",
                 html: str = "html") -> DataFrame:
    """(page_id, url, text): the article text of every page, "" if there is none.

    Every element subtree outside and inside the article is hashed (tag, words, children); hashes
    are counted per host over different article contents, so copies of a page count once;
    subtrees that recur beside five or more, and beside a share of all contents of the host (a
    hundredth, inside an article a fifth), are the site's template and go. Inside an article
    cells, items and headings go with their table, list or box only, and an article that would
    lose all its text, or is a near copy of others, stays whole. Of the rest go elements that
    the standard or their class, id or role name as menus, headers, footers, sidebars, notices,
    adverts, forms and comments, scripts and styles, but by a name or as a form none that holds
    a main element or nearly all of the main text; if an article or main element is left, its text is the page's. References are decoded, block borders and line breaks are white
    space, runs of it become one space. NULL pages give "". Pages without a host have no
    templates. Counts are pre-aggregated, so one large host is no hot group.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sig", F.xxhash64("url", "html"))
    subtrees = (rows.select("page_id", "sig", host_of(F.col("url")).alias("host"), "html")
                .filter("host is not null and html <> ''").mapInArrow(
                    _subtree_rows, "page_id long, sig long, host string, digest long, content long, inside boolean"))
    counts = stage(subtrees.select("host", "digest", "inside", "content").distinct().groupBy("host", "digest", "inside")
                   .count().filter((F.col("count") >= TEMPLATE_PAGES) | F.col("inside").isNull()), "counts")
    contents = counts.filter("inside is null").select("host", F.col("count").alias("contents"))
    share = F.when(F.col("inside"), INNER_SHARE).otherwise(TEMPLATE_SHARE)
    templates = stage(counts.filter("inside is not null").join(contents, "host").filter(
        F.col("count") >= share * F.col("contents")).select("host", "digest"), "templates")
    found = (subtrees.select("page_id", "sig", "host", "digest").join(templates, ["host", "digest"])
             .groupBy("page_id", "sig").agg(F.collect_set("digest").alias("found"))
             .select(F.col("page_id").alias("id"), F.col("sig").alias("of"), "found"))
    same = rows["page_id"].eqNullSafe(found["id"]) & (rows["sig"] == found["of"])
    return rows.join(found, same, "left").select("page_id", "url", "html", "found").mapInArrow(
        _text_rows, "page_id long, url string, text string")

"""Main text of pages: element subtrees that recur on a site are its template and go; so do marked-up side parts."""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine.llm.common import map_texts, small_text_batches, stage, table

#: A subtree on this many different pages of a host, and on this share of them, belongs to the template.
TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.01
#: Up to this many template subtrees go to the workers as one array of longs (1.6 MB); more are joined.
BROADCAST_SUBTREES = 200_000

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ARTICLE = frozenset(["article", "main"])
#: Elements whose content is no text of the page.
SILENT = frozenset("script style title head noscript template button select textarea iframe object svg canvas audio video noembed noframes xmp datalist map".split())
#: Elements beside the main text, unless the main article is in them.
ASIDE = frozenset("nav aside footer form dialog menu search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words that, as a class or id on their own or with words of place and form only, mark a part beside the main text.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments disqus replies "
    "share sharing social related recommended pagination pager login signup".split()
)
#: Those that also mark a paragraph.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: Words that mark an article which only points to another page.
TEASER_WORDS = frozenset("teaser teasers card cards preview excerpt related recommended promo".split())
#: Words of place and form, which leave the sense of the word beside them; so do words with digits.
PLAIN_WORDS = frozenset(
    "left right top bottom upper lower middle center first second last primary secondary main global site page mobile desktop "
    "box bar block area section container wrapper wrap holder inner outer list item items link links slot unit zone column col panel "
    "widget widgets button buttons icon icons header post posts article articles us small large big wide sticky fixed float google wp".split()
)
#: Elements whose subtrees are counted, outside articles and where they hold none; in articles only containers of links.
CONTAINERS = frozenset("nav ul ol dl div section aside footer header form table figure menu".split())
TEXTUAL = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 address center".split())
#: What an opening element closes, up to the nearest of the given fences.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[a-z0-9]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_INLINE_FENCES = BLOCK - {"p"}


#: Text outside articles counts as the main text where it has this many characters and so many times those in the articles.
OTHER_CHARS, OTHER_TIMES = 500, 10


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    inside: bool  # in an article, itself included
    silent: bool  # no text of the page
    beside: bool  # by its tag, role or style, or as an article of comments
    named: bool  # a side part by its class or id
    teaser: bool = False  # an article that only points to another page
    link: bool = False  # in a link, itself included
    parts: list = field(default_factory=list)
    key: int = 0
    counted: bool = False
    holds: bool = False  # an article, as an ancestor
    article: Element | None = None  # the outermost it stands in, itself included
    chars: int = 0
    linked: int = 0  # of chars, those in links


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, without port; empty if it has none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _names(value: str, marks: frozenset[str]) -> bool:
    """Whether a class, or the id, is made of ``marks`` and PLAIN_WORDS, with one of the former at least."""
    for name in value.split():
        words = {w for w in _WORDS.findall(name) if w.isalpha()}
        if not marks.isdisjoint(words) and words <= marks | PLAIN_WORDS:
            return True
    return False


def _marked(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """What the attributes say: (beside the main text by role or style, a side part by its class or id, an article that is a teaser)."""
    if not attributes.strip() or tag in ("html", "body"):
        return False, False, False
    beside = named = teaser = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if tag in ARTICLE:
                teaser = teaser or _names(value, TEASER_WORDS)
            else:
                named = named or _names(value, ADVERT_WORDS if tag in TEXTUAL else ASIDE_WORDS)
        elif tag in ARTICLE:
            continue
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ASIDE_ROLES):
            beside = True
        elif name == "style" and _INVISIBLE.search(value):
            beside = True
    return beside, named, teaser


def _is_comment(attributes: str) -> bool:
    return any(name.lower() in ("class", "id") and not {"comment", "comments"}.isdisjoint(_WORDS.findall(value.lower())) for name, value in _ATTRIBUTE.findall(attributes))


class Page:
    """Elements of a page with subtree keys, and its text in blocks, each with the element it stands in."""

    def __init__(self, source: str, host: str):
        self.host = host.encode("utf-8", "surrogatepass")
        self.root = Element("", None, False, False, False, False)
        self.elements: list[Element] = []
        self.blocks: list[list[tuple[Element, str]]] = [[]]
        self.stack = [self.root]
        self.depths: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are
        self.fences: list[int] = []  # and all that hold back the end of an inline element
        self.articles: list[Element] = []
        self._read(source)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            token = _TOKEN.search(source, at)
            self._text(source[at : token.start() if token else size])
            if not token:
                break
            at = token.end()
            tag = (token["tag"] or token["tag2"] or "").lower()
            if not tag:
                continue
            if token["end"] or token["end2"]:
                self._close(tag)
                continue
            attributes = token["attrs"] if token["tag"] else token["attrs2"]
            self._open(tag, attributes or "")
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>|\Z", re.I).search(source, at)
                self._text(source[at : stop.start()])
                self._close(tag)
                at = stop.end()
        while len(self.stack) > 1:
            self._pop()
        for e in self.elements:
            if e.counted and e.inside:  # a list of links beside the article's text
                e.counted = e.linked == e.chars and 2 * e.chars <= e.article.chars

    def _text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            owner = self.stack[-1]
            part = " ".join(text.split())
            owner.parts.append(part.encode("utf-8", "surrogatepass"))
            owner.chars += len(part)
            self.blocks[-1].append((owner, text))

    def _break(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._break()
            if self.depths.get("p"):
                self._end(("p",), self._last(("button", "table", "td", "th", *ARTICLE)))
            if tag in CLOSES:
                tags, fences = CLOSES[tag]
                self._end(tags, self._last(fences))
        if tag == "br":
            self.blocks[-1].append((self.stack[-1], " "))
            return
        if tag in VOID:
            return
        parent = self.stack[-1]
        comment = tag in ARTICLE and _is_comment(attributes)
        inside = parent.inside or (tag in ARTICLE and not comment)
        beside, named, teaser = _marked(tag, attributes)
        beside = beside or comment or tag in ASIDE or (tag == "header" and not parent.inside)
        element = Element(tag, parent, inside, tag in SILENT, beside, named, teaser, parent.link or tag == "a")
        element.counted = tag in CONTAINERS or (tag in TEXTUAL and not inside)
        element.article = parent.article or (element if inside else None)
        if element.article is element:
            self.articles.append(element)
        if tag in ARTICLE and not comment:
            while not parent.holds:
                parent.holds = True
                if parent is self.root:
                    break
                parent = parent.parent
        self.depths.setdefault(tag, []).append(len(self.stack))
        if tag in _INLINE_FENCES:
            self.fences.append(len(self.stack))
        self.elements.append(element)
        self.stack.append(element)

    def _last(self, tags) -> int:
        """Where in the stack the last open element of ``tags`` is; 0 without one."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def _end(self, tags, fence: int) -> None:
        """Closes the outermost open element of ``tags`` above the fence, and all in it."""
        depth = len(self.stack)
        for tag in tags:
            depths = self.depths.get(tag)
            if depths:
                at = bisect.bisect_right(depths, fence)
                if at < len(depths):
                    depth = min(depth, depths[at])
        self._cut(depth)

    def _cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._pop()

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._break()
        depths = self.depths.get(tag)
        if tag in VOID or not depths:
            return
        # the innermost; an inline element only up to the element of text around it
        if tag in BLOCK or not self.fences or depths[-1] > self.fences[-1]:
            self._cut(depths[-1])

    def _pop(self) -> None:
        element = self.stack.pop()
        self.depths[element.tag].pop()
        if element.tag in _INLINE_FENCES:
            self.fences.pop()
        if element.tag in BLOCK:
            self._break()
        digest = xxhash.xxh64(element.tag.encode())
        for part in element.parts:
            digest.update(b"\0" + part)
        element.parts = []
        element.parent.parts.append(digest.digest())
        if not element.silent:
            element.parent.chars += element.chars
            element.parent.linked += element.chars if element.tag == "a" else element.linked
        element.counted = element.counted and not element.holds
        if element.counted:
            digest.update(b"\1" + self.host)
            element.key = digest.intdigest() - (1 << 63)

    def subtree_keys(self) -> set[int]:
        return {e.key for e in self.elements if e.counted}

    def _main_article(self, marks: dict[int, tuple[bool, bool]]) -> Element | None:
        """The article with the most text out of links: of those in no side part, if one has a quarter of what the others have."""
        best: list[Element | None] = [None, None, None]
        for article in self.articles:
            beside, named = marks[id(article)]
            level = 2 if named or article.teaser else 1 if beside else 0
            if best[level] is None or self._own(article) > self._own(best[level]):
                best[level] = article
        plain, beside, named = best
        if plain and beside and 4 * self._own(plain) < self._own(beside):
            plain = beside
        return plain or beside or named

    @staticmethod
    def _own(article: Element) -> int:
        return article.chars - article.linked

    def main_text(self, template: Callable[[int], bool]) -> str:
        """The text blocks left, joined by line ends: of the articles, if there are any with text, else of the page."""
        marks: dict[int, tuple[bool, bool]] = {id(self.root): (False, False)}
        for e in self.elements:  # parents come first
            beside, named = marks[id(e.parent)]
            marks[id(e)] = (beside or e.beside, named or e.named)
        main = self._main_article(marks)
        named = main is not None and (marks[id(main)][1] or main.teaser)
        text = self._left(template, None if named else main)
        # an article in a part with a side name is only the main text where there is no other
        return text if text or not named else self._left(template, main)

    def _left(self, template: Callable[[int], bool], main: Element | None) -> str:
        around: set[int] = set()
        at = main
        while at is not None:
            around.add(id(at))
            at = at.parent
        gone: set[int] = set()
        for e in self.elements:
            teaser = e.teaser and e.article is e
            if e.silent or id(e.parent) in gone or ((e.beside or e.named or teaser) and id(e) not in around) or (e.counted and template(e.key)):
                gone.add(id(e))
        every, articles, inside, other = [], [], 0, 0
        for block in self.blocks:
            kept = [(owner, text) for owner, text in block if id(owner) not in gone]
            text = " ".join("".join(text for _, text in kept).split())
            if text:
                every.append(text)
                if kept[0][0].inside:
                    articles.append(text)
                    inside += len(text)
                elif not kept[0][0].link:
                    other += len(text)
        if articles and not (other >= OTHER_CHARS and other >= OTHER_TIMES * inside):
            return "\n".join(articles)
        return "\n".join(every)


def _page_number(host: str, source: str | None) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{source}".encode("utf-8", "surrogatepass")) - (1 << 63)


def subtrees(pages: DataFrame) -> DataFrame:
    """(page long, host long, key long): the different counted subtrees of each page, and its host's number as one more key.

    The key also depends on the host.
    """
    small_text_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, keys = [], [], []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host = host_of(url)
                number = xxhash.xxh64_intdigest(b"\2" + host.encode("utf-8", "surrogatepass")) - (1 << 63)
                found = Page(source or "", host).subtree_keys() | {number}
                ids += [_page_number(host, source)] * len(found)
                hosts += [number] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, hosts, keys)], names=["page", "host", "key"])

    return pages.select("url", "html").mapInArrow(run, "page long, host long, key long")


def template_keys(pages: DataFrame, least_pages: int = TEMPLATE_PAGES, least_share: float = TEMPLATE_SHARE) -> DataFrame:
    """(key): subtrees on ``least_pages`` or more different pages of one host and on ``least_share`` of them; equal pages count once."""
    once = subtrees(pages).distinct()
    counts = once.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("host").alias("host")).where(F.col("n") >= least_pages)
    counts = stage(counts, "subtree-counts")
    found = counts.where("key != host")
    # only hosts where the share asks for more than least_pages
    large = counts.where((F.col("key") == F.col("host")) & (F.col("n") * least_share > least_pages)).select("host", F.col("n").alias("pages"))
    large = F.broadcast(large) if large.count() <= BROADCAST_SUBTREES else large
    enough = F.col("pages").isNull() | (F.col("n") >= F.col("pages") * least_share)
    return found.join(large, "host", "left").where(enough).select("key")


def extract(pages: DataFrame, least_pages: int = TEMPLATE_PAGES, least_share: float = TEMPLATE_SHARE) -> DataFrame:
    """(page_id, url, text) per row of ``pages`` (page_id, url, html; other columns are ignored).

    Every element subtree is hashed, by tags and texts; those on ``least_pages`` or more different pages of a host, and on
    ``least_share`` of its different pages, are its template and are deleted. What holds an article, and text in one, is never a
    template, since articles may share passages and pages may share an article; only containers of nothing but links, of at most
    half the article's text, are.
    Elements that mark themselves as menu, header, footer, sidebar, notice, advert, form, script, style or
    reader comments go wherever they stand; by a class or id only where a whole name says so and no article is inside. Of what is left, the articles are the main text, or the whole page if it has none.
    References are decoded, white space within a block (a line break element too) becomes one blank, blocks are joined by a line end.

    NULL or empty html gives an empty text; a NULL url is the host without a name. Unclosed and misplaced tags are
    closed where their parent ends. Rows repeat as in ``pages``; no table size changes a result: template keys go to the
    workers as an array while they are few, and are joined to the pages that have them otherwise.
    """
    keys = stage(template_keys(pages, least_pages, least_share), "template-subtrees")
    if keys.count() <= BROADCAST_SUBTREES:
        known = np.sort(keys.toPandas()["key"].to_numpy(np.int64))
        given = pages.select("page_id", "url", F.struct("url", "html").alias("__page"))
    else:
        known = None
        own = stage(subtrees(pages).select("page", "key").distinct(), "page-subtrees").join(keys, "key")
        own = stage(own.groupBy("page").agg(F.collect_set("key").alias("keys")), "page-templates")
        identified = map_texts(pages.select("page_id", "url", "html", F.struct("url", "html").alias("__page")), "__page", _page_identity, "page long")
        joined = identified.join(own, "page", "left")
        given = joined.select("page_id", "url", F.struct("url", "html", "keys").alias("__page"))

    def make():
        everywhere = frozenset(known.tolist()) if known is not None else None

        def work(rows: list) -> list[pa.Array]:
            texts = []
            for row in rows:
                template = everywhere if everywhere is not None else frozenset(row["keys"] or ())
                texts.append(Page(row["html"] or "", host_of(row["url"])).main_text(template.__contains__))
            return [pa.array(texts, pa.string())]

        return work

    return map_texts(given, "__page", make, "text string")


def _page_identity() -> Callable[[list], list[pa.Array]]:
    def work(rows: list) -> list[pa.Array]:
        return [pa.array([_page_number(host_of(r["url"]), r["html"]) for r in rows], pa.int64())]

    return work


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))

"""Main text of web pages by site template removal.

Pages are parsed into element trees. Every element subtree gets a hash of its tags and text; Spark counts, per host,
the different pages in which each hash occurs, and subtrees that recur across many pages of the host are deleted as
template. Outside the article (a page's article or main element) three pages are enough, since nothing there is main
text that pages would share by chance; inside it, or on a page that marks no article, most pages of the host must agree,
because near copies of an article share paragraphs too. Elements that are no article by their kind (navigation, header,
footer, aside, form, script, style, advert, notice, comments) go whether they recur or not. What is left is the text,
block by block.

Scale: a page emits the distinct hashes of its subtrees, counted per (host, hash) map-side first, so a host with a
third of all pages is no hot key. Recurring hashes are joined back to the pages: broadcast if they number at most
``broadcast_rows``, which is checked, else by host and salt, the salt spreading a large host over many tasks. Parsing
takes time in proportion to the page, however broken, and some 20 times its size in memory; a page is one task's.

A null html gives an empty text. A page with no host counts as a host of its own name (empty). Repeated rows, and pages
equal in html, count as one page and get equal texts; ties cannot arise. An empty table gives an empty result. Only
page_id, url and html are read.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Raw elements that reach to the end of the page if never closed; elements whose content is no text, if they are closed.
_CODE, _SEALED = frozenset("script style".split()), frozenset("svg object template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
NOT_TEXT = frozenset("head script style noscript template svg object annotation annotation-xml form button input select textarea nav header footer aside menu dialog search title".split())
#: Roles and words of class or id that mark an element as something other than the article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside header masthead footer foot cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus "
    "respond reply replies share sharing social related recommended widget widgets skip pagination pager copyright disclaimer "
    "guestbook shoutbox outbrain taboola adsense doubleclick dfp".split()
)
#: Words that mark a block of readers' talk when they stand in the class of a container; a chapter of an article may have them as its id.
TALK = frozenset("discussion discussions feedback talkback".split())
_CONTAINERS = frozenset("div section ul ol dl aside details table".split())
#: Words that a mark may stand with in one name (site-header, ad-slot, comments-list) and still mean what it means.
FRAME = frozenset(
    "site page main top bottom left right global primary secondary section list box bar area block container wrapper wrap inner outer "
    "item items link links slot unit row col column content group panel buttons button icons form policy posts articles stories the js is "
    "post entry wp blog home web mobile desktop sticky fixed small large text body title thread "
    "reader readers user users visitor visitors guest guests member members community sub side leaderboard skyscraper rectangle zone".split()
)
#: An open element of a key is closed by a start tag of its value.
_P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section table ul".split()
)
_SAME = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}
_SCOPE = frozenset("ul ol dl table select article section div body html td th main aside nav".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR_NAME = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)?")
_ATTR_VALUE = re.compile(r"\s*=\s*([\"']|[^\s>\"'][^\s>]*)?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SIZE = re.compile(r"\d+x\d+|\d+")
_GAP = re.compile(r"\s+")


@dataclass(frozen=True)
class Rules:
    """A subtree is template if it occurs in at least this many different pages of its host, and this share of them."""

    outside_pages: int = 3
    outside_share: float = 0.0
    #: On pages that mark no article, and inside articles.
    unmarked_pages: int = 5
    unmarked_share: float = 0.5
    inside_pages: int = 10
    inside_share: float = 0.6
    broadcast_rows: int = 200_000

    def least(self) -> int:
        return min(self.outside_pages, self.unmarked_pages, self.inside_pages)


@dataclass
class Node:
    tag: str
    plain: bool  # not excluded by its kind
    parts: list = field(default_factory=list)  # texts and nodes, in order
    digest: int = 0
    chars: int = 0
    main: bool = False  # it is, or holds, an article or main element


@lru_cache(maxsize=1 << 14)
def _parted(word: str) -> tuple[str, ...]:
    """A word written together of marks and frame words (topnav), in its parts; any other word as it is.

    Parts have three letters or more, but for an advert's beginning: a table's thead is no advert.
    """
    if word in MARKS or word in FRAME or word in TALK:
        return (word,)
    for k in range(2, len(word) - 2):
        head = word[:k]
        if (k > 2 or head == "ad") and (head in MARKS or head in FRAME):
            rest = _parted(word[k:])
            if all(r in MARKS or r in FRAME for r in rest):
                return (head, *rest)
    return (word,)


@lru_cache(maxsize=1 << 14)
def _names_frame(token: str, talk: bool) -> bool:
    """Whether a name means something other than the article: every word of it must be a mark or a frame word."""
    if token.lower() in MARKS:
        return True
    words = [p for w in _WORDS.findall(_SIZE.sub(" ", token)) for p in _parted(w.lower())]
    marks = [w in MARKS or (talk and w in TALK) for w in words]
    return any(marks) and all(m or w in FRAME for m, w in zip(marks, words))


def _marked(tag: str, attrs: dict[str, str]) -> bool:
    """Whether role, class or id name something other than the article."""
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    if attrs.get("role", "").strip().lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true":
        return True
    # social-history is no social widget
    classes, ids = attrs.get("class", "").split(), attrs.get("id", "").split()
    return any(_names_frame(t, tag in _CONTAINERS) for t in classes) or any(_names_frame(t, False) or _names_talk(t, tag) for t in ids)


def _names_talk(token: str, tag: str) -> bool:
    """Whether an id names readers' talk by more than one word, such as user-feedback."""
    words = [w.lower() for w in _WORDS.findall(token)]
    return tag in _CONTAINERS and len(words) > 1 and _names_frame(token, True)


class _Reader:
    """Reads tags of a page. Attribute values end at their quote; a quote that never closes, or closes beyond a > into a word, ends at the next >."""

    def __init__(self, source: str):
        self.source = source
        self.last = {q: source.rfind(q) for q in "\"'"}

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """Attributes of the tag whose name ends at ``at``, whether it closes itself, and where the page goes on."""
        source, out = self.source, {}
        while True:
            m = _ATTR_NAME.match(source, at)
            at = m.end()
            if m.group(1) is None:
                end = at + 1 if at < len(source) else at
                return out, source.endswith("/", m.start(), at), end
            name = m.group(1).lower()
            v = _ATTR_VALUE.match(source, at)
            if v is None:
                out.setdefault(name, "")
                continue
            value, at = v.group(1) or "", v.end()
            if value in ('"', "'"):
                close = source.find(value, at) if at <= self.last[value] else -1
                if close >= 0 and (close + 1 >= len(source) or source[close + 1] in " \t\n\r\f/>" or source.find(">", at, close) < 0):
                    value, at = source[at:close], close + 1
                else:
                    close = source.find(">", at)
                    close = len(source) if close < 0 else close
                    value, at = source[at:close], close
            out.setdefault(name, htmllib.unescape(value) if "&" in value else value)


def _close(node: Node) -> None:
    """Digest and length of a finished subtree."""
    h, chars = [node.tag], 0
    for p in node.parts:
        if isinstance(p, str):
            h.append(_GAP.sub(" ", p).strip())
            chars += len(h[-1])
        else:
            h.append(f"<{p.digest}>")
            chars += p.chars
            node.main |= p.main
    node.digest = xxhash.xxh3_64_intdigest("\x1f".join(h).encode("utf-8", "surrogatepass"))
    node.chars = chars
    node.main |= node.tag in ("article", "main")
    if node.main and node.tag not in NOT_TEXT:
        node.plain = True  # a frame around the article, such as one with a sidebar by name


def parse(source: str) -> Node:
    """The element tree of a page; unclosed and stray tags are taken as browsers roughly do."""
    root = Node("", True)
    stack, at, text = [root], 0, 0
    n, read = len(source), _Reader(source)
    open_of: dict[str, int] = {}  # open elements by tag
    ends: dict[str, list[int]] = {}  # where the end tags of a tag are
    closed: dict[str, set[int]] = {}
    gone = {"-->": False, ">": False}  # whether no such mark is left

    def shut(k: int) -> None:
        """Closes the open elements from the k-th on."""
        for node in reversed(stack[k:]):
            _close(node)
            open_of[node.tag] -= 1
        del stack[k:]

    def ends_after(tag: str, place: int) -> int:
        """Number of the tag's end tags from place on."""
        if tag not in ends:
            ends[tag] = [m.start() for m in re.finditer(rf"</{re.escape(tag)}(?![^\s/>])", source, re.I)]
        return len(ends[tag]) - bisect_left(ends[tag], place)

    def sealed(tag: str) -> set[int]:
        """Where the start tags lie that have an end tag of their own, each end tag going to the nearest before it."""
        if tag not in closed:
            waiting, closed[tag] = [], set()
            for m in re.finditer(rf"<(/?){tag}(?![^\s/>])([^>]*)", source, re.I):
                if not m.group(1):
                    if not (tag == "svg" and m.group(2).endswith("/")):
                        waiting.append(m.start())
                elif waiting:
                    closed[tag].add(waiting.pop())
        return closed[tag]

    def past(mark: str, place: int) -> int:
        found = -1 if gone[mark] else source.find(mark, place)
        gone[mark] = found < 0
        return n if found < 0 else found + len(mark)

    while True:
        at = source.find("<", at)
        if at < 0:
            stack[-1].parts.append(source[text:])
            break
        begin = at
        closing = source.startswith("/", at + 1)
        m = _NAME.match(source, at + 1 + closing)
        if m is None:
            if source.startswith("<!--", at):
                at = past("-->", at + 2)
            elif source.startswith(("<!", "<?", "</"), at):
                at = past(">", at)
            else:
                at += 1
                continue
            stack[-1].parts.append(source[text:begin])
            text = at
            continue
        tag = m.group().lower()
        attrs, alone, at = read.attributes(m.end())
        if begin > text:
            stack[-1].parts.append(source[text:begin])
        text = at
        if closing:
            if not open_of.get(tag):
                if tag in ("br", "p"):
                    stack[-1].parts.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    shut(k)
                    break
                if tag not in BLOCK and tag not in _SEALED and stack[k].tag in BLOCK:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if tag in VOID:
            if tag == "br":
                stack[-1].parts.append(" ")
            elif tag == "hr":
                stack[-1].parts.append(Node("hr", True))
            continue
        if tag in RAW:
            left = ends_after(tag, at)
            if left:
                at = text = past(">", ends[tag][-left])
            elif tag in _CODE:
                at = text = n
            continue
        if tag in _SEALED and begin not in sealed(tag):
            continue  # it has no end tag of its own, so it holds nothing
        if tag in _P_CLOSERS and open_of.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    shut(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in _SAME or tag in ("tbody", "tfoot", "optgroup"):
            for k in range(len(stack) - 1, 0, -1):
                if tag in _SAME.get(stack[k].tag, ()):
                    shut(k)
                    break
                if stack[k].tag in _SCOPE:
                    break
        node = Node(tag, not (tag in NOT_TEXT or _marked(tag, attrs)))
        stack[-1].parts.append(node)
        if alone and tag not in BLOCK:
            _close(node)
        else:
            stack.append(node)
            open_of[tag] = open_of.get(tag, 0) + 1
    for node in reversed(stack):
        _close(node)
    return root


def subtrees(root: Node) -> Iterator[tuple[Node, bool]]:
    """Elements with text, and whether they lie in an article; the page's own frame and what is around the article are left out.

    What an element excluded by its kind holds goes with it and is not counted again.
    """
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        for p in node.parts:
            if isinstance(p, Node) and p.chars:
                frame = p.tag in ("html", "head", "body") or (p.main and not inside)
                if not frame:
                    yield p, inside
                if p.plain:
                    todo.append((p, inside or p.tag in ("article", "main")))


def text_of(root: Node, template: frozenset[int] | set[int]) -> str:
    blocks: list[str] = []
    current: list[str] = []

    def flush() -> None:
        if current:
            block = _GAP.sub(" ", htmllib.unescape("".join(current))).strip()
            if block:
                blocks.append(block)
            current.clear()

    # the walk keeps its own stack, so deep nesting is no recursion
    todo: list = [root]
    while todo:
        p = todo.pop()
        if p is None:
            flush()
        elif isinstance(p, str):
            current.append(p)
        elif p.plain and p.digest not in template:
            if p.tag in BLOCK:
                flush()
                todo.append(None)
            elif p.tag == "hr":
                flush()
            todo.extend(reversed(p.parts))
        elif p.tag in BLOCK:
            flush()
    flush()
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(host, digest) of the subtrees that recur on their host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests, insides, unmarked, own = [], [], [], [], []
            for host, source, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("page").to_pylist()):
                root = parse(source or "")
                seen: dict[int, bool] = {}
                for x, inside in subtrees(root):
                    seen[x.digest] = seen.get(x.digest, False) or inside
                hosts += [host] * len(seen)
                digests += [d - (1 << 64) if d >= 1 << 63 else d for d in seen]
                insides += seen.values()
                unmarked += [not root.main] * len(seen)
                own += [page] * len(seen)
            columns = [pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(insides, pa.bool_()), pa.array(unmarked, pa.bool_()), pa.array(own, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "digest", "inside", "unmarked", "page"])

    # equal pages are one page, told by a hash of its html
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"), F.xxhash64(F.col("html").cast("string")).alias("page"))
    n_pages = rows.groupBy("host").agg(F.count_distinct("page").alias("n_pages")).where(F.col("n_pages") >= rules.least())
    seen = rows.mapInArrow(run, "host string, digest long, inside boolean, unmarked boolean, page long")
    seen = seen.groupBy("host", "digest").agg(F.count_distinct("page").alias("n"), F.max("inside").alias("any_inside"), F.max("unmarked").alias("any_unmarked")).where(F.col("n") >= rules.least())
    n, of = F.col("n"), F.col("n_pages")
    enough = lambda pages, share: (n >= pages) & (n >= share * of)
    rule = F.when(F.col("any_inside"), enough(rules.inside_pages, rules.inside_share)).when(F.col("any_unmarked"), enough(rules.unmarked_pages, rules.unmarked_share)).otherwise(enough(rules.outside_pages, rules.outside_share))
    return seen.join(n_pages, "host").where(rule).select("host", "digest")


def extract(pages: DataFrame, rules: Rules = Rules(), salts: int = 64) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    found = templates(pages, rules)
    found = found.groupBy("host").agg(F.sort_array(F.collect_list("digest")).alias("template")).withColumnRenamed("host", "t_host")
    found = written(found, "templates")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    if found.agg(F.coalesce(F.sum(F.size("template")), F.lit(0)) + F.count(F.lit(1))).first()[0] <= rules.broadcast_rows:
        rows = rows.join(F.broadcast(found), F.col("host") == F.col("t_host"), "left")
    else:
        salted = found.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        rows = rows.join(salted, (F.col("host") == F.col("t_host")) & (F.col("salt") == F.col("t_salt")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, set[int]] = {}
            texts = []
            for host, source, template in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("template")):
                if host not in known:
                    known[host] = {d % (1 << 64) for d in template.as_py() or ()}
                texts.append(text_of(parse(source or ""), known[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "host", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")

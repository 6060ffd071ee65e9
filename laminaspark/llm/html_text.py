"""HTML extraction by site template removal."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark.llm.common import LOWER, UPPER, over_batches, read, slices, staged

#: A subtree is the site's template if it stands beside at least so many different main texts of a host, and beside at
#: least this share of them. A subtree that recurs word for word also is if it stands beside so many whatever their share.
LEAST_PAGES, LEAST_SHARE, MANY_PAGES = 5, 0.3, 1000
#: A subtree whose words stand in links to this share at least is a menu rather than text.
LINKED = 0.5
#: Siblings of one shape up to which they may be slots of the site; more of them are the page's own list of parts.
SLOTS = 2
#: Templates up to which they are sent to all tasks (at most 0.4 MB); more meet the pages' subtrees in a join.
FEW_TEMPLATES = 20_000

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("body caption html legend optgroup option summary tbody td tfoot th thead tr".split())
DROPPED = set("nav footer aside form script style noscript template head title menu button select textarea iframe svg math object canvas audio video dialog datalist map".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th caption figcaption".split())
CONTAINERS = BLOCK - PARAGRAPHS - set("body html head hr legend option optgroup summary tbody thead tfoot tr".split())
UNSEEN = DROPPED - set("nav footer aside form menu dialog".split())
# Words of class, id and role by which pages mark what isn't their article.
MARKS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice notices alert popup modal newsletter subscribe signup share sharing social related recommended comment comments disqus footer masthead topbar toolbar widget contentinfo complementary search login pagination pager skip".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN, _NO_DISPLAY, _QUOTED = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I), re.compile(r"display\s*:\s*none", re.I), re.compile(r"\"[^\"]*\"|'[^']*'")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []


_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select", "datalist"}, "optgroup": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"optgroup", "option"}, "thead": {"tbody", "thead", "tfoot"}, "tbody": {"tbody", "thead", "tfoot"}, "tfoot": {"tbody", "thead", "tfoot"}}
_STOP = BLOCK - {"p"}


def parse(page: str) -> Element:
    """A tolerant tree: implied ends of p, li, dt, dd, cells and options; unclosed inline elements end with their block;
    stray end tags are passed over; text keeps its character references decoded."""
    root = Element("#root")
    stack = [root]
    at, end = 0, len(page)

    def shut(k: int) -> None:
        del stack[k:]

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])  # the latter where a quote has no partner
        if name is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if closing:
            if tag == "br" or tag in VOID:
                if tag == "br":
                    stack[-1].children.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    shut(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end doesn't leave its block
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    shut(k)
                    break
                if stack[k].tag in _STOP:
                    break
        if tag in _ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SCOPE[tag]:
                    break
                if stack[k].tag in _ENDS[tag]:
                    shut(k)
                    break
        element = Element(tag, attributes or "")
        stack[-1].children.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            element.children.append(page[at : stop.start() if stop else end])
            at = stop.start() if stop else end
            if stop:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else end
            continue
        if not (attributes or "").endswith("/") or tag in BLOCK:
            stack.append(element)
    return root


def marked(element: Element) -> bool:
    """An element that isn't part of any article, by its name or its class, id and role."""
    if element.tag in DROPPED:
        return True
    if not element.attributes or element.tag in ("html", "body", "main"):
        return False
    values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(element.attributes)}
    named = " ".join(values.get(k, "") for k in ("class", "id", "role")).lower()
    if MARKS.intersection(_SPLIT.split(named)):
        return True
    return bool(_HIDDEN.search(_QUOTED.sub("", element.attributes)) or _NO_DISPLAY.search(values.get("style", "")))


def _visit(root: Element) -> tuple[dict[int, tuple[int, int]], dict[int, tuple[int, int, bool]], list[tuple[Element, int, bool]]]:
    """Iteratively (trees may be deep): each element's hashes, (words, words in links, whether a heading is inside), and the
    elements in page order with the hash of their path. The first hash is of the subtree as it is. The other one masks texts
    and the values of attributes but class, id and role: it tells the shape and the path alone, and repeating items of a menu
    count once."""
    shapes: dict[int, int] = {}
    hashes: dict[int, tuple[int, int]] = {}
    words: dict[int, tuple[int, int, bool]] = {}
    order: list[tuple[Element, int, bool]] = []
    stack: list[tuple[Element, int, bool]] = [(root, 0, False)]
    while stack:
        element, path, inside = stack.pop()
        linked = inside or element.tag == "a"
        path = xxhash.xxh64_intdigest(element.tag, path)
        order.append((element, path, linked))
        stack.extend((c, path, linked) for c in reversed(element.children) if isinstance(c, Element))
    for element, path, linked in reversed(order):
        h = xxhash.xxh64(element.tag)
        h.update(_SPACE.sub(" ", element.attributes).strip())
        n = links = 0
        heading, parts = element.tag == "h1", []
        for c in element.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                h.update(b"\x01" + text.encode(errors="replace"))
                n += (k := text.count(" ") + bool(text))
                links += k * linked
                if text:
                    parts.append(1)
            else:
                h.update(hashes[id(c)][0].to_bytes(8, "little"))
                a, b, inner = words[id(c)]
                n, links, heading = n + a, links + b, heading or inner
                parts.append(shapes[id(c)])
        if links >= LINKED * n:
            parts = [x for k, x in enumerate(parts) if not k or x != parts[k - 1]]
        named = sorted((k.lower(), (a or b or c) if k.lower() in ("class", "id", "role") else "") for k, a, b, c in _ATTRIBUTE.findall(element.attributes)) if element.attributes else []
        shape = xxhash.xxh64_intdigest(f"{element.tag}{named}{parts}".encode(errors="replace"))
        shapes[id(element)] = shape
        hashes[id(element)], words[id(element)] = (h.intdigest(), xxhash.xxh64_intdigest(shape.to_bytes(8, "little"), path)), (n, links, heading)
    return hashes, words, order


def _landmarks(order: list[tuple[Element, int, bool]]) -> list[Element]:
    """The outermost article elements that aren't marked (not reader comments), else main, else by role."""
    for wanted in ("article", "main"):
        found, inner = [], set()
        for element, _, _ in order:
            if id(element) in inner:
                inner.update(id(c) for c in element.children if isinstance(c, Element))
                continue
            if marked(element) or (element.tag == wanted):
                inner.update(id(c) for c in element.children if isinstance(c, Element))
            if element.tag == wanted and not marked(element):
                found.append(element)
        if found:
            return found
    return []


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


#: What is known of an element: it holds other blocks; it is a menu; its name isn't an article's; it is the declared article or
#: main; it holds one; it stands inside one; it holds the heading.
CONTAINER, MENU, NAMED, LANDMARK, HOLDS, INSIDE, HEADING = (1 << k for k in range(7))


class Parts:
    """A page before its site is known: its block elements that have words, in page order (parent, exact hash or 0, shape hash
    or 0, flags, words outside links), its blocks of text (text, element), and a hash of its main text as far as the page
    itself tells: of its landmark, else of its paragraphs, else of all."""

    __slots__ = ("at", "exact", "flags", "main", "parent", "shape", "texts", "words")

    def __init__(self, page: str):
        root = parse(page)
        hashes, words, order = _visit(root)
        marks = {id(e) for e in _landmarks(order)}
        holds: set[int] = set()
        for e, _, _ in reversed(order) if marks else ():
            if any(isinstance(c, Element) and (id(c) in marks or id(c) in holds) for c in e.children):
                holds.add(id(e))
        self.parent, self.exact, self.shape, self.flags, self.words = [], [], [], [], []
        self.texts, self.at = [], []
        buffer: list[str] = []
        mains: list[str] = []
        paragraphs: list[str] = []

        def flush(node: int, tag: str) -> None:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                self.texts.append(text)
                self.at.append(node)
                flags = self.flags[node] if node >= 0 else 0
                if flags & (INSIDE | LANDMARK) and not flags & NAMED:
                    mains.append(text)
                if tag in PARAGRAPHS and not flags & (MENU | NAMED):
                    paragraphs.append(text)

        # Elements are entered, then left (with the element around them); strings are text.
        todo: list[tuple] = [(root, -1, "", False, False)]
        while todo:
            e, node, tag, inside, leaves = todo.pop()
            if isinstance(e, str):
                buffer.append(e)
                continue
            if leaves:
                flush(node, e.tag)
                continue
            if e.tag in UNSEEN or (e.tag not in BLOCK and marked(e)) or _hidden(e):
                continue
            if e.tag in ("br", "hr", "img"):
                buffer.append(" ")
            here, landmark = node, id(e) in marks
            if e.tag in BLOCK:
                flush(node, tag)
                n, links, heading = words[id(e)]
                if n and e.tag not in ("html", "body"):
                    here = len(self.parent)
                    container, menu = e.tag in CONTAINERS, links >= LINKED * n
                    named = not landmark and (marked(e) or (e.tag == "header" and not marks))
                    flags = CONTAINER * container | MENU * menu | NAMED * (named or bool(node >= 0 and self.flags[node] & NAMED)) | LANDMARK * landmark | HOLDS * (id(e) in holds) | INSIDE * inside | HEADING * heading
                    free = not landmark and id(e) not in holds
                    self.parent.append(node)
                    self.exact.append(_signed(hashes[id(e)][0]) if free and (container or not inside) else 0)
                    self.shape.append(_signed(hashes[id(e)][1]) if free and container else 0)
                    self.flags.append(flags)
                    self.words.append(n - links)
                todo.append((e, here, tag, inside, True))
            todo.extend((c, here, e.tag if e.tag in BLOCK else tag, inside or landmark, False) for c in reversed(e.children))
        flush(-1, "")
        said = mains or paragraphs or self.texts
        self.main = _signed(xxhash.xxh64_intdigest("\n\n".join(said).encode(errors="replace")))


def _hidden(e: Element) -> bool:
    return bool(e.attributes) and bool(_HIDDEN.search(_QUOTED.sub("", e.attributes)) or ("display" in e.attributes.lower() and _NO_DISPLAY.search(e.attributes)))


def template(parent: Sequence[int], exact: Sequence[int], shape: Sequence[int], flags: Sequence[int], words: Sequence[int], exacts: set[int], shapes: set[int]) -> list[bool]:
    """Which elements of a page the counts delete, given the hashes that recur on its host.

    What recurs word for word goes. What recurs in shape alone goes if it is a menu, or if it stands beside the page's own text:
    siblings that don't recur in shape, of which one holds the heading or all together have no fewer words. Up to SLOTS
    siblings of a shape are slots of the site; more are the page's own parts. Where all siblings recur in shape, the one with
    the heading, else with the most words outside links, is the page's own. Inside a declared article (or main), shapes tell
    menus alone, and paragraphs never go: pages may share passages."""
    gone = [False] * len(parent)
    children: dict[int, list[int]] = {}
    for k, up in enumerate(parent):
        children.setdefault(up, []).append(k)
        if exact[k] and exact[k] in exacts:
            gone[k] = True
    for up, kids in children.items():  # in page order: an element comes before those inside it
        if up >= 0 and gone[up]:
            for k in kids:
                gone[k] = True
            continue
        again = [k for k in kids if not gone[k] and shape[k] and shape[k] in shapes]
        if not again:
            continue
        own = [k for k in kids if not gone[k] and k not in again and not flags[k] & MENU]
        inside = bool(flags[kids[0]] & INSIDE)
        if not own and not inside:
            texts = [k for k in again if not flags[k] & MENU]
            own = [max(texts, key=lambda k: (bool(flags[k] & HEADING), words[k], -k))] if texts else []
        rest = sum(words[k] for k in own)
        sure = any(flags[k] & CONTAINER and flags[k] & (HEADING | LANDMARK | HOLDS) for k in own)
        alike = Counter(shape[k] for k in again)
        for k in again:
            if flags[k] & MENU:
                gone[k] = bool(own) or inside
            elif k not in own and not inside and own and alike[shape[k]] <= SLOTS:
                gone[k] = sure or words[k] <= rest
    return gone


def main_text(texts: Sequence[str], at: Sequence[int], gone: Sequence[bool], flags: Sequence[int], named: bool = True) -> tuple[list[str], int, int]:
    """The blocks that stay, how many the counts deleted, and how many of the others names and landmarks rule out: those inside
    an element that the standard or its class, id or role marks as no article, and on a page that declares its article (or
    main) those outside. Names thus decide where the counts are silent."""
    declared = named and any(f & LANDMARK for f in flags)
    kept, by_counts, by_names = [], 0, 0
    for text, k in zip(texts, at, strict=True):
        f = flags[k] if k >= 0 else 0
        if k >= 0 and gone[k]:
            by_counts += 1
        elif named and (f & NAMED or (declared and not f & (INSIDE | LANDMARK))):
            by_names += 1
        else:
            kept.append(text)
    return kept, by_counts, by_names


def blocks(page: str) -> tuple[list[tuple[str, int]], Parts]:
    """What a page says by names and landmarks alone, each block with its element; and the page's parts."""
    p = Parts(page)
    kept = [(t, k) for t, k in zip(p.texts, p.at, strict=True) if main_text([t], [k], [False] * len(p.flags), p.flags)[0]]
    return kept, p


_ROWS = "page_id long, url string, row long, main long, parent array<int>, exact array<long>, shape array<long>, flags array<int>, words array<int>, texts array<string>, at array<int>"
_TYPES = {"parent": pa.list_(pa.int32()), "exact": pa.list_(pa.int64()), "shape": pa.list_(pa.int64()), "flags": pa.list_(pa.int32()), "words": pa.list_(pa.int32()), "texts": pa.list_(pa.string()), "at": pa.list_(pa.int32())}
#: Parts that a host's hot subtree is dealt over when it meets the templates.
SALT = 32


def host_of(url):
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def parsed(pages: DataFrame) -> DataFrame:
    """Every page's parts (see Parts) with its host."""

    def start():
        def f(batch: pa.RecordBatch) -> pa.Table:
            out = []
            for part in slices(batch, "html"):
                made = [Parts(h or "") for h in part.column("html").to_pylist()]
                out.append(pa.table({"page_id": part.column("page_id"), "url": part.column("url"), "row": part.column("row"), "main": pa.array([p.main for p in made], pa.int64())} | {c: pa.array([getattr(p, c) for p in made], t) for c, t in _TYPES.items()}))
            return pa.concat_tables(out)

        return f

    source = pages.select(F.col("page_id").cast("long"), "url", F.monotonically_increasing_id().alias("row"), "html")
    return over_batches(source, start, _ROWS).withColumn("host", host_of(F.coalesce("url", F.lit(""))))


def templates(parts: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(host, kind, subtree): hashes that recur across many pages of a host, kind 0 word for word, 1 in shape. A subtree's pages
    count by their main texts, so that copies of one page are no evidence."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.array_distinct(F.filter(c, lambda h: h != 0)).alias("subtrees")) for k, c in enumerate(("exact", "shape"))))
    seen = parts.select("host", "main", F.explode(kinds).alias("of")).select("host", "main", "of.kind", F.explode("of.subtrees").alias("subtree"))
    per_host = parts.select("host", "main").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = seen.distinct().groupBy("host", "kind", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    share = F.col("pages") * least_share
    return counted.join(per_host, "host").where(F.col("n") >= F.when(F.col("kind") == 0, F.least(share, F.lit(many_pages))).otherwise(share)).select("host", "kind", "subtree")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, many_pages: int = MANY_PAGES, named: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars, n_template, n_named) for every row: the page's blocks joined by two line feeds, without
    subtrees that recur across many pages of the page's host, word for word or in shape (n_template blocks), and, where the
    counts are silent, without what names and landmarks rule out (n_named blocks; none if `named` is off).

    Every page is parsed once. A host of a single text loses nothing to the counts. Nulls and pages without text give an
    empty text; a null url has the host of no name; repeated rows repeat; other columns aren't read; an empty table gives
    no rows. Texts stay where they were parsed unless there are more than FEW_TEMPLATES templates; then each page's text
    moves once, to meet the list of its subtrees that are templates."""
    parts = staged(parsed(pages))
    found = staged(templates(parts, least_pages, least_share, many_pages))
    if found.count() <= FEW_TEMPLATES:
        of = found.groupBy("host").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("subtree"))).alias(c) for k, c in enumerate(("exacts", "shapes"))))
        joined = parts.join(F.broadcast(of), "host", "left")
        sets = [F.coalesce(F.array_intersect(mine, its), F.array().cast("array<long>")).alias(its) for mine, its in (("exact", "exacts"), ("shape", "shapes"))]
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        around = parts.select("row", "host", F.posexplode(F.array("exact", "shape")).alias("kind", "subtrees")).select("row", "host", "kind", F.explode(F.array_distinct("subtrees")).alias("subtree"))
        met = around.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(salted, ["host", "kind", "subtree", "salt"])
        of = met.groupBy("row").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("subtree"))).alias(c) for k, c in enumerate(("exacts", "shapes"))))
        joined = parts.join(of, "row", "left")
        sets = [F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("exacts", "shapes")]

    def start():
        def f(batch: pa.RecordBatch) -> pa.Table:
            columns = {c: batch.column(c).to_pylist() for c in (*_TYPES, "exacts", "shapes")}
            out: list[tuple] = []
            for parent, exact, shape, flags, words, texts, at, exacts, shapes in zip(*columns.values(), strict=True):
                kept, by_counts, by_names = main_text(texts, at, template(parent, exact, shape, flags, words, set(exacts), set(shapes)), flags, named)
                text = "\n\n".join(kept)
                out.append((text, len(text), by_counts, by_names))
            text, n, counts, names = zip(*out, strict=True)
            return pa.table({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array(n, pa.int64()), "n_template": pa.array(counts, pa.int32()), "n_named": pa.array(names, pa.int32())})

        return f

    return over_batches(joined.select("page_id", "url", *_TYPES, *sets), start, "page_id long, url string, text string, n_chars long, n_template int, n_named int")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))

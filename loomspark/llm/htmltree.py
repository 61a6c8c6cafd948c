"""HTML extraction by a site style tree.

Pages of a host are merged node by node: a style node is the path of tags, classes and ids from the root. For each node the
tree holds on how many pages it occurs, with which presentations (the row of child blocks) and with which items (the own text of each
element at the path, so a list's entries are items each). An item that k of a node's m pages show has the importance 1 - log k / log m: 0 on
all pages, 1 on one. A node's importance is the mean of the distinct items at it and below it, at any depth, by their characters; where it
has child blocks, the entropy of its presentations is blended in by 1 - ``GAMMA``. So links that menus choose from a store weigh their branch down, whatever
each page's choice. A branch goes where its importance is below ``LOW`` times that of all its host's text, wherever it stands, also inside an article.
As each item counts once, a large group of copies among other pages doesn't make its article a template; what all pages of
a host show, be it an article, is one. Pages of the same whole text count once, with all that any of them shows. ``style_tree`` returns the nodes of each host; ``extract`` drops the branches from each page.

Small hosts, and noise drawn from a store about as large as the host, tell no template. So branches
whose element, role or name says that they are no article text go as well. Of what is left, article and main elements are the page's text if
they hold at least ``MAIN_SHARE`` of it; else all of it is.

What a page shows is merged by page and path before it is shuffled, and written once. A node carries its nearest ``REACH`` ancestors, whatever its depth; sums of
deeper branches are put together from sums of ``REACH`` levels, twice as many levels a round. The noise of all hosts is broadcast where its measured size is at most ``SMALL``
hashes, so that no html is moved; beyond that, salts spread each host's list over a join.

Defined results: null or empty html gives an empty text; a page that ends inside a tag loses that tag; a url without a host counts to the
host ''. Repeated rows are extracted one by one. Pages of any length and depth are read whole, in time proportional to
their length. Columns other than those named are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import map_columns, materialize

GAMMA, LOW, LEAST_PAGES, REACH, SALTS, MAIN_SHARE, SMALL = 0.9, 0.75, 4, 8, 16, 1 / 3, 1_000_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option select".split())
#: Elements that are no article text wherever they stand.
NOISE_TAGS = frozenset("head title script style noscript template nav footer aside form iframe svg button select option textarea object canvas audio video dialog menu header".split())
#: Elements of raw text that is never article text.
UNSEEN = RAW & NOISE_TAGS
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_NAME = re.compile(r"(?:ad|ads|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|notice\w*|alert\w*|popup\w*|modal\w*|newsletter\w*|subscri\w*|share|sharing|social\w*|sidebar\w*|widget\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|paginat\w*|pager|footer|header|masthead|comments?|comment[-_]\w+|disqus\w*|respond|replies|related\w*|recommend\w*|toolbar|login|signup|skip-link)", re.I)
#: The same of one part of a compound name; such an element goes only if it holds no heading of the first rank, article or main.
NOISE_PART = re.compile(r"(?:ads?|advert|advertisement|advertising|sponsor(?:s|ed)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|newsletter|subscribe|share|sharing|social|sidebars?|widgets?|nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|footer|masthead|comments?|disqus|replies|related|recommended|recommendations|toolbar|login|signup)", re.I)
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
COMMENT_NAME = re.compile(r"comments?|repl(?:y|ies)", re.I)
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_ATTR = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^\s>]*+)|(.)))?+)", re.S)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
#: A start tag ends an open element of the second kind, unless one of the third is in between.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_NO_P = (("p",), ("table", "td", "th", "button", "object"))
_PRIME = (1 << 61) - 1


class Node:
    __slots__ = ("children", "drop", "holds", "name", "parent", "part", "tag")

    def __init__(self, tag: str, name: str, drop: bool, part: bool = False, parent: Node | None = None) -> None:
        self.tag, self.name, self.drop, self.part, self.parent = tag, name, drop, part, parent
        self.children: list[Node | str] = []
        self.holds = False  # an h1, article or main that isn't noise


class Opened:
    """The open elements, with the places of each tag and of the blocks, so that none is searched for."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: tuple[str, ...]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, at: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()


def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a start tag from ``at``, and the place after it, or -1 if the page ends first. As in browsers, a slash at the end means nothing."""
    found: dict[str, str] = {}
    while m := _ATTR.match(page, at):
        if m[6]:  # a quote that is never closed
            break
        if m[1]:
            return found, m.end()
        found.setdefault(m[2].lower(), m[3] or m[4] or m[5] or "")
        at = m.end()
    return found, -1


def judged(tag: str, attrs: dict[str, str], names: list[str], inside: bool) -> tuple[bool, bool]:
    """Whether an element is noise by its tag, role or name, and whether by a part of its name alone."""
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
    if tag in NOISE_TAGS or hidden or attrs.get("role", "") in NOISE_ROLES:
        return True, False
    if tag in ("html", "body", "main"):
        return False, False
    # an outermost article is noise only as a reader's comment
    if tag == "article" and not inside:
        return any(COMMENT_NAME.fullmatch(x) for x in names), False
    return any(NOISE_NAME.fullmatch(x) for x in names), any(NOISE_PART.fullmatch(x) for n in names for x in _PARTS.split(n))


def parse(page: str) -> tuple[Node, list[Node]]:
    """A tree of elements and decoded texts, and its elements in order; end tags that were left out are filled in, and lone ones ignored."""
    root = Node("", "", False)
    made, open_, at = [root], Opened(root), 0
    while at < len(page):
        m = _OPEN.search(page, at)
        start = m.start() if m else len(page)
        if start > at:
            open_.stack[-1].children.append(entities.unescape(page[at:start]))
        if not m:
            break
        if not m[2]:
            end = page.find("-->", m.end()) if m[0] == "<!--" else page.find(">", m.end())
            if end < 0:
                break
            at = end + (3 if m[0] == "<!--" else 1)
            continue
        tag = m[2].lower()
        if m[1]:
            end = page.find(">", m.end())
            if end < 0:
                break
            at, i = end + 1, open_.last((tag,))
            if i and (tag in BLOCK or i > open_.blocks[-1]):
                open_.cut(i)
            continue
        attrs, at = attributes(page, m.end())
        if at < 0:
            break
        for ends, stop in ([_NO_P] if tag in BLOCK else []) + ([CLOSES[tag]] if tag in CLOSES else []):
            i = open_.last(ends)
            if i and i > open_.last(stop):
                open_.cut(i)
        names = [*attrs.get("class", "").split(), *attrs.get("id", "").split()]
        drop, part = judged(tag, attrs, names, bool(open_.last(("article", "main"))))
        node = Node(tag, ".".join([tag, *sorted(names)]), drop, part, open_.stack[-1])
        open_.stack[-1].children.append(node)
        made.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            text = page[at : end.start() if end else len(page)]
            node.children.append(entities.unescape(text) if tag in ("title", "textarea") else text)
            at = end.end() if end else len(page)
        else:
            open_.push(node)
    for node in reversed(made):
        holds = node.holds or (node.tag in ("h1", "article", "main") and not node.drop)
        node.drop = node.drop or (node.part and not holds)
        if holds and not node.drop and node.parent is not None:
            node.parent.holds = True
    return root, made


def step(path: int, name: str) -> int:
    """The hash of a path from that of its parent and the element's name."""
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), path) >> 1


class Style:
    """What one page shows at a path: its presentations, its items (hash: characters) and the paths above, nearest first."""

    __slots__ = ("above", "items", "look")

    def __init__(self, above: tuple[int, ...]) -> None:
        self.look: int | None = None
        self.items: dict[int, int] = {}
        self.above = above


def nodes(page: str | None) -> tuple[int, dict[int, Style]]:
    """The hash of the page's text, and what it shows at each path of block elements."""
    root, _ = parse(page or "")
    whole, found = xxhash.xxh64(), {}
    # an element's own text and its row of blocks, those in inline elements too, are gathered between its start and its end
    todo: list[tuple[Node | str, int, list[str], list[str], tuple[int, ...], bool]] = [(root, 0, [], [], (), False)]
    while todo:
        node, path, own, row, above, ended = todo.pop()
        if isinstance(node, str):
            own.append(node)
            whole.update(node.encode("utf-8", "surrogatepass"))
        elif ended:
            if text := " ".join("".join(own).split()):
                found[path].items[xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1] = len(text)
            if row:
                style = found[path]
                style.look = ((style.look or 0) * 31 + (xxhash.xxh64_intdigest(" ".join(row)) >> 1)) % _PRIME
        elif node.tag not in UNSEEN:
            if node.tag in BLOCK:
                row.append(node.tag)
                path, own, row = step(path, node.name), [], []
                found.setdefault(path, Style(above))
                todo.append((node, path, own, row, above, True))
                above = (path, *above)[:REACH]
            elif node.tag == "br":
                own.append(" ")
            todo += [(c, path, own, row, above, False) for c in reversed(node.children)]
    return whole.intdigest() >> 1, found


def host(url):
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")), F.lit(""))


def style_tree(pages: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(host, path, pages, importance, usual) of every style node; ``usual`` is the importance of all text of the host."""
    rows = pages.select(host(F.col("url")).alias("host"), "html")
    kinds = {"host": pa.string(), "path": pa.int64(), "page": pa.int64(), "look": pa.int64(), "items": pa.list_(pa.int64()), "chars": pa.list_(pa.int64()), "above": pa.list_(pa.int64())}

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple, None] = {}
            for name, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                whole, found = nodes(page)
                out.update(dict.fromkeys((name, path, whole, x.look, (*x.items,), (*x.items.values(),), x.above) for path, x in found.items()))
            made = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds.values())], names=list(kinds))

    shown = rows.mapInArrow(merged, "host string, path long, page long, look long, items array<long>, chars array<long>, above array<long>")
    node = ["host", "path"]
    # pages of one text may show it in several ways
    shown = shown.groupBy(*node, "page").agg(F.collect_set(F.struct("look", "items", "chars")).alias("ways"), F.first("above").alias("above"))
    shown = materialize(shown.select(*node, F.array_distinct("ways.look").alias("looks"), F.array_distinct(F.flatten(F.transform("ways", lambda x: F.arrays_zip(x["items"].alias("item"), x["chars"].alias("chars"))))).alias("items"), "above"))
    # sums of chars and of chars * log k tell the items' importance once m is known
    items = shown.select(*node, F.inline("items")).toDF(*node, "item", "chars").groupBy(*node, "item").agg(F.count("*").alias("k"), F.max("chars").alias("chars"))
    items = items.groupBy(*node).agg(F.sum("chars").alias("chars"), F.sum(F.col("chars") * F.log("k")).alias("common"))
    looks = shown.select(*node, "above", F.posexplode("looks").alias("i", "look")).groupBy(*node, "look").agg(F.count("*").alias("n"), F.count_if(F.col("i") == 0).alias("m"), F.first("above").alias("above"))
    told = F.when(F.col("look").isNotNull(), F.col("n"))
    looks = looks.groupBy(*node).agg(F.sum("m").alias("m"), F.sum(told).alias("rows"), F.sum(told * F.log("n")).alias("nlogn"), F.first("above").alias("above"))
    single = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("common") / F.log("m") / F.col("chars"))).otherwise(1.0)
    # -sum p log p with p = n / rows, to the base of rows
    look = F.when(F.col("rows") > 1, F.greatest(F.lit(0.0), 1 - F.col("nlogn") / (F.col("rows") * F.log("rows")))).otherwise(1.0)
    both = looks.join(items, node, "left").select(*node, F.col("m").alias("pages"), F.when(F.col("rows").isNotNull(), look).alias("look"), "above", "chars", (F.col("chars") * single).alias("worth"))
    both = materialize(both)
    texts = both.where("chars > 0")
    below = _below(both).select(*node, (F.col("worth") / F.col("chars")).alias("below"))
    usual = texts.groupBy("host").agg(F.round(F.sum("worth") / F.sum("chars"), 9).alias("usual"))
    blended = F.when(F.col("look").isNull(), F.col("below")).otherwise((1 - gamma) * F.col("look") + gamma * F.col("below"))
    return both.select(*node, "pages", "look").join(below, node).join(usual, "host").select(*node, "pages", F.round(blended, 9).alias("importance"), "usual")


def _below(nodes_: DataFrame) -> DataFrame:
    """(host, path, chars, worth) of nodes (host, path, above, chars, worth): sums at each node and below it, at any depth.

    Sums of a node and ``REACH`` - 1 levels below it are taken at once. Then each node hands its sum to the node ``REACH`` levels above, the next round to the
    one twice as far, until none is so deep: every node below is in one sum.
    """
    node, total = ["host", "path"], [F.sum("chars").alias("chars"), F.sum("worth").alias("worth")]
    texts = nodes_.where("chars > 0")
    sums = texts.select("host", F.explode(F.concat(F.array("path"), F.slice("above", 1, REACH - 1))).alias("path"), "chars", "worth").groupBy(*node).agg(*total)
    far = nodes_.where(F.size("above") >= REACH).select(*node, F.get("above", F.lit(REACH - 1)).alias("far"))
    if not far.head(1):
        return sums
    sums, far = materialize(sums), materialize(far)
    while far.head(1):
        more = far.join(sums, node).select("host", F.col("far").alias("path"), "chars", "worth")
        sums = materialize(sums.unionByName(more).groupBy(*node).agg(*total))
        far = materialize(far.join(far.select("host", F.col("path").alias("far"), F.col("far").alias("next")), ["host", "far"]).select(*node, F.col("next").alias("far")))
    return sums


def main_text(page: str | None, noise: frozenset[int]) -> str:
    """Blocks of the page without the dropped branches, one a line."""
    root, made = parse(page or "")
    tops = any(n.tag in ("article", "main") for n in made)
    blocks: list[tuple[str, bool]] = []
    open_: list[str] = []
    inside = False  # whether the text in ``open_`` is in an article or main

    def close() -> None:
        text = " ".join("".join(open_).split())
        open_.clear()
        if text:
            blocks.append((text, inside))

    todo: list[tuple[Node | str | None, int, bool]] = [(root, 0, False)]
    while todo:
        node, path, kept = todo.pop()
        if node is None:
            close()
            inside = kept
            continue
        if isinstance(node, str):
            open_.append(node)
            continue
        # the header of an article stays if it holds the title
        title = node.tag == "header" and kept and any(isinstance(c, Node) and c.tag == "h1" for c in node.children)
        block = node.tag in BLOCK
        here = step(path, node.name) if block else path
        if block:
            close()  # a block that is dropped parts what stands around it, too
        if (node.drop and not title) or (block and here in noise):
            continue
        if block:
            todo.append((None, 0, kept))
        elif node.tag == "br":
            open_.append(" ")
        kept = kept or node.tag in ("article", "main")
        if block:
            inside = kept
        todo += [(c, here, kept) for c in reversed(node.children)]
    close()
    if tops:
        own = [t for t, within in blocks if within]
        if own and sum(map(len, own)) >= MAIN_SHARE * sum(len(t) for t, _ in blocks):
            return "\n".join(own)
    return "\n".join(t for t, _ in blocks)


def extract(pages: DataFrame, tree: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    noise = materialize(tree.where((F.col("pages") >= least_pages) & (F.col("importance") < low * F.col("usual"))).groupBy("host").agg(F.collect_set("path").alias("noise")))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    size = noise.agg(F.coalesce(F.sum(F.size("noise") + 4), F.lit(0)).alias("n")).first().n
    if size <= SMALL:
        joined = rows.join(F.broadcast(noise), "host", "left")
    else:
        noise = noise.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(noise, ["host", "salt"], "left")

    def run(html: list, noise: list) -> list[list]:
        texts = [main_text(p, frozenset(n or ())) for p, n in zip(html, noise, strict=True)]
        return [texts, [len(t) for t in texts]]

    return map_columns(joined, ["page_id", "url"], ["html", "noise"], {"text": "string", "n_chars": "long"}, run)


def html_main_text(pages: DataFrame) -> DataFrame:
    return extract(pages, style_tree(pages))

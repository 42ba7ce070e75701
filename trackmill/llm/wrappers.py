"""Operator 5: main text of web pages by wrappers that are union-free regular expressions."""

from __future__ import annotations

import html as references
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle
from .url_filters import host_of

#: Wrappers merged by one call.
FAN_IN = 64
#: Wrapper tables up to so many bytes are broadcast.
BROADCAST_BYTES = 16 << 20

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|math|title|select|object|audio|video|canvas"
BLOCKS = set(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes these open elements, up to the next element in SCOPES.
CLOSES = {t: {"p"} for t in BLOCKS - {"br", "html", "body"}} | {
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "option": {"option"},
}
SCOPES = set("article aside blockquote body div dl footer form header html main nav ol section table td th ul".split())
#: Elements that never hold main text.
DROPPED = set("head nav footer aside form script style noscript template button input label menu dialog iframe".split())
#: Roles, and class names and ids or their first parts, that mark what is not main text.
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
DROPPED_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner promo promoted promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe "
    "subscription signup sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing "
    "social related recommended recommendations comment comments commentlist disqus respond reply replies footer "
    "masthead toolbar login search widget widgets skip".split()
)
#: Names of what readers add, which may be longer than the main text.
COMMENT_NAMES = set("comment comments commentlist disqus respond reply replies".split())
#: Leading parts of a class name that say where its element stands.
PLACES = set("site page main post entry article primary secondary global left right top bottom".split())
#: Names that mark main text where a host uses neither article nor main.
MAIN_NAMES = set("content article post entry story main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<empty>svg|math)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    r"|</(?P<close>[a-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_PARTS = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("kids", "linked", "menu", "names", "path", "plain", "role", "symbol", "tag")

    def __init__(self, tag: str, rest: str = ""):
        self.tag, self.kids, self.role, self.names = tag, [], "", ()
        self.symbol = tag
        if rest and "=" in rest:
            found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(rest)}
            self.role = found.get("role", "").strip()
            tokens = {_NAME_PARTS.sub("-", t).strip("-") for k in ("class", "id") for t in found.get(k, "").split()}
            self.names = tuple(sorted(tokens - {""}))
            self.symbol = ".".join([tag, *self.names]) + (f"@{self.role}" if self.role else "")


def parse(page: str) -> Node:
    """The element tree; texts are str children. Tags left open are closed as browsers do for the common cases."""
    root = Node("html")
    stack = [root]
    open_tags: Counter[str] = Counter()

    def leave(i: int) -> None:
        open_tags.subtract(n.tag for n in stack[i:])
        del stack[i:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m["raw"] or m["empty"]:
            stack[-1].kids.append(Node((m["raw"] or m["empty"]).lower()))
        elif m["close"]:
            tag = m["close"].lower()
            for i in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[i].tag == tag:
                    leave(i)
                    break
                if stack[i].tag in SCOPES and tag not in SCOPES:
                    break
        elif m["open"]:
            tag = m["open"].lower()
            ends = CLOSES.get(tag)
            if ends and any(open_tags[t] for t in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        leave(i)
                        break
                    if stack[i].tag in SCOPES:
                        break
            if tag in ("html", "body") and tag == "html":
                continue
            node = Node(tag, m["rest"])
            stack[-1].kids.append(node)
            if tag not in VOID and not m["rest"].endswith("/"):
                stack.append(node)
                open_tags[tag] += 1
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return root


# A wrapper is [symbol, flags, kids]: "?" optional, "+" repeated, "T" has a text slot, "a" has texts in links, "x" has texts
# outside of links. A page can be as deep as it likes, so nothing here recurses.


def preorder(root: Node) -> list[tuple[Node, Node | None, bool]]:
    """Every element, its parent and whether it is in a link."""
    out: list = []
    stack: list = [(root, None, False)]
    while stack:
        node, parent, linked = stack.pop()
        linked = linked or node.tag == "a"
        out.append((node, parent, linked))
        stack.extend((k, node, linked) for k in reversed(node.kids) if not isinstance(k, str))
    return out


def weigh(order: list) -> None:
    """Text characters in and outside of links at and below every element."""
    for node, _, linked in order:
        own = sum(len("".join(k.split())) for k in node.kids if isinstance(k, str))
        node.linked, node.plain = (own, 0) if linked else (0, own)
    for node, parent, _ in reversed(order):
        if parent is not None:
            parent.linked += node.linked
            parent.plain += node.plain


def shape(root: Node) -> list:
    """The wrapper of one page: repeated siblings folded, texts as slots."""
    order = preorder(root)
    weigh(order)
    kids: dict[int, list] = {}
    whole: list = []
    for node, parent, _ in reversed(order):
        text = any(isinstance(k, str) and not k.isspace() for k in node.kids)
        flags = ("T" if text else "") + ("a" if node.linked else "") + ("x" if node.plain else "")
        whole = [node.symbol, flags, fold(kids.pop(id(node), [])[::-1])]
        kids.setdefault(id(parent), []).append(whole)
    return whole


def fold(kids: list) -> list:
    """Equal symbols in a row become one repeated group."""
    out: list = []
    for k in kids:
        if out and out[-1][0] == k[0]:
            out[-1] = merge(out[-1], k)
            out[-1][1] = _flags(out[-1][1] + "+")
        else:
            out.append(k)
    return out


def _flags(flags: str) -> str:
    return "".join(f for f in "?+Tax" if f in flags)


def pair(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of two symbol rows aligned by a longest common subsequence; -1 stands for no partner."""
    if x == y:
        return [(i, i) for i in range(len(x))]
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if x[i] == y[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and table[i + 1][j] >= table[i][j + 1]):
            out.append((i, -1))
            i += 1
        else:
            out.append((-1, j))
            j += 1
    return out


def merge(a: list, b: list) -> list:
    """Align two wrappers of one symbol: common kids are merged, a mismatch becomes optional."""
    whole = [a[0], _flags(a[1] + b[1]), []]
    work = [(a[2], b[2], whole[2])]
    while work:
        x, y, kids = work.pop()
        for i, j in pair([k[0] for k in x], [k[0] for k in y]):
            if i >= 0 and j >= 0:
                kids.append([x[i][0], _flags(x[i][1] + y[j][1]), []])
                work.append((x[i][2], y[j][2], kids[-1][2]))
            else:
                one = x[i] if i >= 0 else y[j]
                kids.append([one[0], _flags(one[1] + "?"), one[2]])
    return whole


def dumps(wrapper: list) -> str:
    """JSON of depth, symbol and flags of every element in order, flat at any depth."""
    rows, stack = [], [(0, wrapper)]
    while stack:
        depth, (symbol, flags, kids) = stack.pop()
        rows.append([depth, symbol, flags])
        stack.extend((depth + 1, k) for k in reversed(kids))
    return json.dumps(rows, separators=(",", ":"))


def loads(text: str) -> list:
    """The wrapper that ``dumps`` wrote."""
    above: list = []
    for depth, symbol, flags in json.loads(text):
        del above[depth:]
        node = [symbol, flags, []]
        if above:
            above[-1][2].append(node)
        above.append(node)
    return above[0]


def expression(wrapper: list) -> str:
    """The wrapper as a readable regular expression without unions."""
    out: list[str] = []
    stack: list = [(wrapper, "")]
    while stack:
        node, blank = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        symbol, flags, kids = node
        mark = ("+" if "+" in flags else "") + ("?" if "?" in flags else "")
        out.append(blank + ("(" if mark else "") + f"<{symbol}>" + ("#text" if "T" in flags else ""))
        stack.append(("</>" + (f"){mark}" if mark else ""), ""))
        stack.extend((kids[i], " " if i or "T" in flags else "") for i in range(len(kids) - 1, -1, -1))
    return "".join(out)


@lru_cache(1 << 14)
def unwanted(symbol: str) -> bool:
    """Whether an element's tag or role says that it is not main text."""
    tag, _, rest = symbol.partition(".")
    tag, _, role = tag.partition("@")
    return tag in DROPPED or (role or rest.partition("@")[2]) in DROPPED_ROLES


def listed_name(token: str) -> str | None:
    """The name in DROPPED_NAMES that a class name or id is or begins with, after words of place: sidebar, sidebar-left, left-sidebar."""
    parts = token.split("-")
    while len(parts) > 1 and parts[0] in PLACES:
        parts = parts[1:]
    return parts[0] if parts[0] in DROPPED_NAMES else None


@lru_cache(1 << 14)
def listed(symbol: str) -> str | None:
    """Such a name of an element, of comments if there is one. Elements that are main text by their tag or role have none."""
    if symbol.split("@")[0].split(".")[0] in ("html", "body", "main", "article") or symbol.endswith("@main"):
        return None
    found = [n for n in map(listed_name, symbol.partition("@")[0].split(".")[1:]) if n]
    return next((n for n in found if n in COMMENT_NAMES), found[0] if found else None)


@lru_cache(1 << 14)
def kind_of(symbol: str) -> str | None:
    """How an element marks main text."""
    tag = re.split(r"[.@]", symbol)[0]
    if tag == "article":
        return "article"
    if tag == "main" or symbol.endswith("@main"):
        return "main"
    tokens = [t for t in symbol.partition("@")[0].split(".")[1:] if not listed_name(t)]
    return "named" if any(MAIN_NAMES & set(t.split("-")) for t in tokens) else None


def decide(wrapper: list) -> dict:
    """What holds the main text of a host. ``tree``: its wrapper, menus flagged "M". Symbol paths are numbered by
    ``paths`` from the parent's number and the symbol; ``main``, ``dropped`` and ``spared`` hold such numbers.

    A menu is one group at its place in the wrapper, never all elements with its path. Elements with a
    name in DROPPED_NAMES are spared if all of the host's main parts are in such elements.
    """
    paths: dict[tuple[int, str], int] = {}
    dropped: set[int] = set()
    mains: dict[str, set[int]] = {"article": set(), "main": set(), "named": set()}
    doubtful: dict[str, list] = {"article": [], "main": [], "named": []}
    order: list = []
    stack: list = [(wrapper, None)]
    while stack:
        node, parent = stack.pop()
        order.append((node, parent))
        stack.extend((k, node) for k in reversed(node[2]))
    holds: set[int] = set()
    for node, parent in reversed(order):
        if id(node) in holds or kind_of(node[0]) in ("article", "main"):
            holds |= {id(node), id(parent)}

    top = paths[-1, wrapper[0]] = 0
    stack = [(wrapper, top, False, None)]
    while stack:
        node, path, inside, names = stack.pop()
        symbol, flags, kids = node
        tag, kind = re.split(r"[.@]", symbol)[0], kind_of(symbol)
        if unwanted(symbol) or (tag == "header" and not inside):
            dropped.add(path)
            continue
        links = "+" in flags and "a" in flags and "x" not in flags and tag in ("a", "li", "div", "span", "p", "td")
        if links and not inside and not kind and id(node) not in holds:
            node[1] = flags + "M"
            continue
        if listed(symbol):
            names = (path, names)
        if kind and names:
            doubtful[kind].append((path, names))
        elif kind:
            mains[kind].add(path)
        inside = inside or kind in ("article", "main")
        stack.extend((k, paths.setdefault((path, k[0]), len(paths)), inside, names) for k in reversed(kids))
    best, spared = next((m for m in mains.values() if m), set()), set()
    for path, names in [] if best else next((d for d in doubtful.values() if d), []):
        best.add(path)
        while names and names[0] not in spared:
            spared.add(names[0])
            names = names[1]
    return {"tree": wrapper, "paths": paths, "main": best or {top}, "dropped": dropped, "spared": spared}


def place(root: Node, decided: dict) -> None:
    """Align a page with its host's wrapper: path and menu of every element.

    A group of siblings is a menu if the wrapper's group at its place is one and its own texts
    are all links too, so a doubtful alignment never drops other text.
    """
    paths = decided["paths"]
    root.path, root.menu = 0, False
    stack = [(root, decided["tree"])]
    while stack:
        node, known = stack.pop()
        groups: list[list[Node]] = []
        for k in node.kids:
            if not isinstance(k, str):
                k.path, k.menu = paths.get((node.path, k.symbol), -1), False
                if groups and groups[-1][0].symbol == k.symbol:
                    groups[-1].append(k)
                else:
                    groups.append([k])
        partners: list = [None] * len(groups)
        if known and groups:
            for i, j in pair([g[0].symbol for g in groups], [k[0] for k in known[2]]):
                if i >= 0 and j >= 0:
                    partners[i] = known[2][j]
        for group, partner in zip(groups, partners, strict=True):
            menu = bool(partner) and "M" in partner[1] and not any(k.plain for k in group)
            for k in group:
                k.menu = menu
                stack.append((k, partner))


def text_of(page: str, decided: dict) -> str:
    """Blocks of the main text of a page. Without its host's main part, the page less what is dropped; if nothing is left, names drop nothing."""
    mains, dropped, spared = decided["main"], decided["dropped"], decided["spared"]
    root = parse(page)
    order = preorder(root)
    weigh(order)
    place(root, decided)

    def by_name(node: Node) -> bool:
        name = listed(node.symbol)
        return bool(name) and node.path not in spared and (name in COMMENT_NAMES or 2 * node.plain <= root.plain)

    def collect(everything: bool, names: bool = True) -> list[str]:
        blocks, current = [], []

        def end() -> None:
            text = " ".join(references.unescape("".join(current)).split())
            current.clear()
            if text:
                blocks.append(text)

        stack: list = [(root, everything)]
        while stack:
            node, inside = stack.pop()
            if node is None:
                end()
            elif isinstance(node, str):
                current.append(node)
            elif not (node.menu or node.path in dropped or unwanted(node.symbol) or (names and by_name(node))):
                inside = inside or node.path in mains
                if node.tag in BLOCKS:
                    end()
                    stack.append((None, False))
                stack.extend((k, inside) for k in reversed(node.kids) if inside or not isinstance(k, str))
        end()
        return blocks

    return " ".join(collect(False) or collect(True) or collect(False, False) or collect(True, False))


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of every host, from all its pages.

    Each page becomes the wrapper of itself; equal ones of a host are counted together
    before the shuffle. Then groups of about FAN_IN wrappers are aligned into one, again
    and again until each host has one, so no task sees more of a hot host than that.
    """

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if p is None else dumps(shape(parse(p))) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())], ["host", "wrapper"])

    def align(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in sorted(group["wrapper"]):
            one = loads(text)
            whole = one if whole is None else merge(whole, one)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [dumps(whole)]})

    rows = pages.select("host", "html").mapInArrow(shapes, "host string, wrapper string")
    rows = settle(rows.filter("wrapper is not null").distinct())
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        most = -(-most // FAN_IN)
        part = F.pmod(F.xxhash64("wrapper"), F.lit(most)).alias("part")
        rows = settle(rows.groupBy("host", part).applyInPandas(align, "host string, wrapper string"))
    return rows


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    The wrapper of a page's host says which elements hold main text: articles, else main,
    else elements named like content, else the whole body, always less menus, site
    headers, footers, sidebars, notices, adverts, forms and comments. A repeated group outside of the main
    part whose texts are all links, one at least, counts as a menu at its place in the wrapper. Class names
    and ids drop no html, body, main or article, nothing that holds all of the host's main parts and, comments
    apart, nothing with most of the page's text outside of links. Null and empty pages have an empty text; pages
    without a host share the empty host. Repeated rows are extracted each; a column named host is not needed.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    known = wrappers(rows)
    size = known.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decided: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if page is None or wrapper is None:
                    texts.append("")
                    continue
                if wrapper not in decided:
                    if len(decided) > 1000:
                        decided.clear()
                    decided[wrapper] = decide(loads(wrapper))
                texts.append(text_of(page, decided[wrapper]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def pages_to_texts(pages: DataFrame) -> DataFrame:
    """The contract of query op5."""
    return extract(pages)

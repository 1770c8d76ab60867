"""Main text of web pages by wrappers inferred per host.

A page is read as a balanced stream of block tags with text slots. Its *wrapper* is a union-free regular expression over
that stream, kept as a tree: an element with a sequence of parts, each one once, optional, repeated or both. Neighbouring
parts with one name are folded into a repeated part; two wrappers are aligned part by part, and what only one of them has
becomes optional. So every page of a host is aligned with all others, first inside tasks, then across them, and the result
does not grow with their number but with the host's variety of structure.

Slots count their pages, text and link text and remember, by 128 bits, the blocks of text that every page has. With these the wrapper tells where the
article is: a named container, else the smallest part that holds most of the changing text. Pages are then read along it.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .urls import host_of

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr"}
#: Elements whose content is not text of the page.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title", "head", "select", "canvas"}
#: Elements and names that are never part of an article.
ASIDE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar"}
NAMES = re.compile(r"(?:^|[-_\s])(?:ad|ads|adv|advert\w*|banner|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|"
                   r"subscri\w*|signup|sidebar|side|rail|menu|nav|navbar|navigation|breadcrumb\w*|pagination|pager|footer|foot|header|masthead|topbar|toolbar|"
                   r"share|sharing|social|comment|comments|commentlist|discussion|disqus|respond|reply|replies|related|recommend\w*|widget|search|login|"
                   r"tags|skip|copyright|legal|disclaimer)(?:$|[-_\s])", re.I)
NAMED = re.compile(r"(?:article|main)(?:\..*)?|.*\.main")
ARTICLE = re.compile(r"(?:^|[-_\s])(?:article|main|content|post|entry|story|body)(?:$|[-_\s])", re.I)


class Node:
    """An element of a page: its name in the wrapper, whether it is outside any article, its parts (nodes and texts)."""

    __slots__ = ("tag", "name", "out", "parts")

    def __init__(self, tag: str, name: str, out: bool):
        self.tag, self.name, self.out, self.parts = tag, name, out, []


def describe(tag: str, attributes: str) -> Node:
    label, out = "", tag in ASIDE
    if attributes and not attributes.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        words = f"{found.get('class', '')} {found.get('id', '')}".strip()
        out = (out or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
               or bool(words and tag not in ("body", "html", "article", "main") and NAMES.search(words)))
        if words and ARTICLE.search(words) or found.get("role", "").lower() in ("main", "article"):
            label = ".main"
    return Node(tag, tag + (".out" if out else label), out)


def parse(page: str) -> Node:
    """The page's block elements with their texts; inline markup is part of the text, missing ends are put in."""
    root = Node("html", "html", False)
    stack, at, skip, links = [root], 0, None, 0

    def text(piece: str) -> None:
        if piece and skip is None:
            stack[-1].parts.append((piece, links > 0))

    for m in TAG.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        end = bool(m[1])
        if skip is not None:
            if end and tag == skip:
                skip = None
            continue
        if tag in RAW and not end:
            if not m[3].rstrip().endswith("/"):
                skip = tag
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if end else links + 1
            if tag in ("br", "td", "th"):
                text(" ")
            continue
        if tag in VOID:
            stack[-1].parts.append(Node(tag, tag, False))
            continue
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    links = 0
                    break
            continue
        if tag in ("html", "body") and len(stack) == 1:
            continue
        # A block ends an open paragraph, an item ends the item before it.
        if stack[-1].tag == "p" or tag == stack[-1].tag and tag in ("li", "dt", "dd", "tr", "option", "h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()
        node = describe(tag, m[3])
        stack[-1].parts.append(node)
        stack.append(node)
        links = 0
    text(page[at:])
    return root


def walked(steps: Generator):
    """What a generator returns that yields the generators whose results it needs: recursion with a stack of its own."""
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def block(text: str) -> str:
    return " ".join(html.unescape(text).split())


def mark(text: str) -> str:
    """128 bits of a whole block."""
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).hexdigest()


def slot(pieces: list[tuple[str, bool]]) -> list[dict]:
    """A block of text as a part, as ``read`` takes it; none for white space. ``same``: characters outside links by block."""
    clean = block("".join(t for t, _ in pieces))
    if not clean:
        return []
    links = min(len(clean), sum(len(block(t)) for t, link in pieces if link))
    return [{"n": "#", "lo": 1, "hi": 1, "pages": 1, "chars": len(clean), "links": links, "same": {mark(clean): len(clean) - links}, "parts": []}]


def wrapper(node: Node) -> dict:
    """The page's own expression: ``n`` name, ``lo`` 0 if optional, ``hi`` 2 if repeated, and what its slots hold."""
    return walked(_wrapper(node))


def _wrapper(node: Node) -> Generator:
    parts: list[dict] = []
    pieces: list[tuple[str, bool]] = []
    for p in [*node.parts, None]:
        if isinstance(p, tuple):
            pieces.append(p)
            continue
        fresh = slot(pieces)
        pieces = []
        if p is not None:
            fresh.append((yield _wrapper(p)))
        for new in fresh:
            if parts and parts[-1]["n"] == new["n"]:
                parts[-1] = yield _joined(parts[-1], new, False)
                parts[-1]["hi"] = 2
            else:
                parts.append(new)
    return {"n": node.name, "lo": 1, "hi": 1, "pages": 1, "chars": sum(p["chars"] for p in parts), "links": sum(p["links"] for p in parts), "same": {}, "parts": parts}


def joined(a: dict, b: dict, page: bool = True) -> dict:
    """One part that fits what either of two parts of one name fits; ``a`` is used up. ``page``: they are of different
    pages, so that blocks of both stay the same; else those of either do."""
    return walked(_joined(a, b, page))


def _joined(a: dict, b: dict, page: bool) -> Generator:
    same, other = a["same"], b["same"]
    if page:
        same = {k: n + other[k] for k, n in same.items() if k in other}
    else:
        for k, n in other.items():
            same[k] = same.get(k, 0) + n
    return {"n": a["n"], "lo": min(a["lo"], b["lo"]), "hi": max(a["hi"], b["hi"]), "pages": a["pages"] + b["pages"] if page else max(a["pages"], b["pages"]),
            "chars": a["chars"] + b["chars"], "links": a["links"] + b["links"], "same": same, "parts": (yield _align(a["parts"], b["parts"], page))}


def _align(a: list[dict], b: list[dict], page: bool) -> Generator:
    """Sequences aligned by a longest common subsequence of names; what has no partner becomes optional, and neighbours
    of one name become a repeated part: those of either side first, as they are of the same pages."""
    out: list[dict] = []
    if [p["n"] for p in a] == [p["n"] for p in b]:
        for x, y in zip(a, b, strict=True):
            out.append((yield _joined(x, y, page)))
        return out
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["n"] == b[j]["n"] else max(best[i + 1][j], best[i][j + 1])
    #: Name, parts of a, parts of b, least number, how often it was put.
    groups: list[list] = []
    i = j = 0

    def put(x: list[dict], y: list[dict]) -> None:
        name, low = (x or y)[0]["n"], min(p["lo"] for p in x + y) if x and y else 0
        if groups and groups[-1][0] == name:
            g = groups[-1]
            g[1], g[2], g[3], g[4] = g[1] + x, g[2] + y, max(g[3], low), g[4] + 1
        else:
            groups.append([name, x, y, low, 1])

    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i]["n"] == b[j]["n"] and best[i][j] == best[i + 1][j + 1] + 1:
            put([a[i]], [b[j]])
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            put([a[i]], [])
            i += 1
        else:
            put([], [b[j]])
            j += 1
    for _, x, y, low, times in groups:
        sides = []
        for side in (x, y):
            for k, p in enumerate(side):
                sides.append(p) if not k else sides.append((yield _joined(sides.pop(), p, False)))
        part = {**sides[0]} if len(sides) == 1 else (yield _joined(*sides, page))
        part["lo"], part["hi"] = low, 2 if times > 1 else part["hi"]
        out.append(part)
    return out


COLUMNS = ("n", "lo", "hi", "pages", "chars", "links", "same")


def dumped(w: dict) -> str:
    """A wrapper as JSON without nesting: rows of depth and columns, in page order."""
    rows, todo = [], [(w, 0)]
    while todo:
        p, depth = todo.pop()
        rows.append([depth, *[p[c] for c in COLUMNS]])
        todo += [(c, depth + 1) for c in reversed(p["parts"])]
    return json.dumps(rows)


def loaded(text: str) -> dict:
    above: list[dict] = []
    for depth, *values in json.loads(text):
        part = dict(zip(COLUMNS, values, strict=True)) | {"parts": []}
        del above[depth:]
        if above:
            above[-1]["parts"].append(part)
        above.append(part)
    return above[0]


#: Items of a list or table: what never changes in them counts only if the others do not change either.
ITEM = re.compile(r"(?:li|dt|dd|tr)(?:\..*)?")


def constant(p: dict, item: bool) -> dict[str, int]:
    """The blocks of a slot that are the same on each of more than two pages."""
    return p["same"] if p["pages"] > 2 and (not item or sum(p["same"].values()) == p["chars"] - p["links"]) else {}


def article_path(w: dict) -> list[str]:
    """Names from the root to the part that holds the article: the named container with the most text, else the smallest
    part with three quarters of the text that is neither link nor the same on every page."""

    order: list[tuple[dict, bool]] = []
    todo: list[tuple[dict, dict | None, bool]] = [(w, None, False)]
    above: dict[int, dict | None] = {}
    while todo:
        p, parent, item = todo.pop()
        above[id(p)] = parent
        order.append((p, item))
        todo += [(c, p, item or bool(ITEM.fullmatch(p["n"]))) for c in reversed(p["parts"])]
    held: dict[int, int] = {}
    for p, item in reversed(order):
        if p["n"].endswith(".out") or p["n"] == "header":
            held[id(p)] = 0
        elif p["n"] == "#":
            held[id(p)] = p["chars"] - p["links"] - sum(constant(p, item).values())
        else:
            held[id(p)] = sum(held[id(c)] for c in p["parts"])

    def own(p: dict) -> int:
        return held[id(p)]

    named: list[tuple[int, int, dict]] = []
    seek = [(w, 0)]
    while seek:
        p, depth = seek.pop()
        if p["n"].endswith(".out"):
            continue
        if p["n"].split(".")[0] in ("article", "main") or p["n"].endswith(".main"):
            named.append((own(p), depth, p))
            if p["n"].split(".")[0] == "article":
                continue
        seek += [(c, depth + 1) for c in reversed(p["parts"]) if c["n"] != "#"]
    total = own(w)
    most = max((x[0] for x in named), default=0)
    good = [x for x in named if 2 * x[0] >= max(1, most)]
    if good and 4 * most >= total:
        # The innermost that holds most of what the fullest holds.
        part, names = max(good, key=lambda x: (x[1], x[0]))[2], []
        while above[id(part)] is not None:
            names.append(part["n"])
            part = above[id(part)]
        return names[::-1]
    path: list[str] = []
    part = w
    while True:
        inner = max((c for c in part["parts"] if c["n"] != "#"), key=own, default=None)
        if inner is None or inner["hi"] > 1 or 4 * own(inner) < 3 * max(1, own(part)) or inner["n"].split(".")[0] in ("p", "ul", "ol", "table"):
            return path
        path.append(inner["n"])
        part = inner


def fixed_texts(w: dict) -> set[str]:
    """Marks of blocks that are on each of more than two pages, without the article's headings."""
    out: set[str] = set()
    todo = [(w, False)]
    while todo:
        p, item = todo.pop()
        if p["n"] == "#":
            out.update(constant(p, item))
        todo += [(c, item or bool(ITEM.fullmatch(p["n"]))) for c in p["parts"] if not re.fullmatch(r"h[1-6](\..*)?", c["n"])]
    return out


def read(root: Node, path: list[str], fixed: set[str]) -> str:
    """Blocks of the parts of a page that lie under ``path``, in page order."""
    places = [root]
    for name in path:
        places = [p for n in places for p in n.parts if isinstance(p, Node) and p.name == name]
    blocks: list[str] = []

    def flush(pieces: list[str]) -> None:
        clean = block("".join(pieces))
        if clean and not (fixed and mark(clean) in fixed):
            blocks.append(clean)
        pieces.clear()

    def walk(node: Node) -> Generator:
        pieces: list[str] = []
        for p in node.parts:
            if isinstance(p, Node):
                flush(pieces)
                if p.out:
                    continue
                if p.tag == "header":
                    # Of an article's own header the headings are text.
                    for h in p.parts:
                        if isinstance(h, Node) and re.fullmatch(r"h[1-6]", h.tag) and not h.out:
                            yield walk(h)
                    continue
                yield walk(p)
            else:
                pieces.append(p[0])
        flush(pieces)

    for p in places:
        walked(walk(p))
    return "\n\n".join(blocks)


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON) over all pages; tasks fold their own pages first, then a few rows per host are folded in two
    steps, so that a host with a third of all pages is no single long task."""
    schema = "host string, part int, wrapper string"

    def fold(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
        have: dict[str, dict] = {}
        part = 0
        for batch in batches:
            for host, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = make(value)
                have[host] = joined(have[host], new) if host in have else new
                part = part or zlib.crc32((value or "")[:4000].encode(errors="replace")) % 64
            if len(have) > 2000:
                yield rows(have, part)
                have = {}
        if have:
            yield rows(have, part)

    def rows(have: dict[str, dict], part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(have)), pa.array([part] * len(have), pa.int32()), pa.array([dumped(w) for w in have.values()])],
                                          names=["host", "part", "wrapper"])

    own = pages.select("host", "html").mapInArrow(lambda b: fold(b, lambda h: wrapper(parse(h or ""))), schema)
    some = own.repartition("host", "part").select("host", "wrapper").mapInArrow(lambda b: fold(b, loaded), schema)
    return cut(some.repartition("host").select("host", "wrapper").mapInArrow(lambda b: fold(b, loaded), schema).select("host", "wrapper"))


def extract(pages: DataFrame, held_hosts: int = 20_000) -> DataFrame:
    """``page_id, url, text, n_chars, wrapper_path`` of every row of ``page_id, url, html``.

    Character references are decoded, white space inside a block is one space, blocks are joined by two line ends. Null or
    empty html has an empty text. Pages with a null url share the host ''. Pages that do not have what their host's wrapper
    calls the article are read along their own. Repeated rows are pages of their own; an empty table gives no rows; other
    columns are ignored. Wrappers are sent to all tasks up to ``held_hosts`` hosts, beyond that joined.
    """
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    named = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    found = wrappers(named)
    # An argument of the plan's size only: both ways give the same rows.
    found = F.broadcast(found) if found.count() <= held_hosts else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[str], set[str]]] = {}
        for batch in batches:
            texts, paths = [], []
            for page, host, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    w = loaded(text)
                    path = article_path(w)
                    # Inside a named article what stays the same is still the article's.
                    known[host] = path, set() if path and NAMED.fullmatch(path[-1]) else fixed_texts(w)
                path, fixed = known[host]
                root = parse(page or "")
                body = read(root, path, fixed)
                if not body:
                    path = article_path(wrapper(root))
                    body = read(root, path, set())
                texts.append(body)
                paths.append("/".join(path))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())],
                                             names=["page_id", "url", "text", "n_chars", "wrapper_path"])

    return named.join(found, "host").select("page_id", "url", "html", "host", "wrapper").mapInArrow(
        run, f"page_id {id_type}, url {url_type}, text string, n_chars bigint, wrapper_path string")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_html_extraction": query}
ORACLES: dict[str, str] = {}

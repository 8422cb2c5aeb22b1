"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: nodes with the same tags and classes from the root on are one node. For
every node that holds text the tree counts the pages that have it, and how often the pages agree in its presentation (the
number of blocks it shows) and in its content (their text). Importance is the entropy of these choices, to the base of the
number of pages: 0 if all pages show the same, 1 if no two do; ``presentation_share`` weighs the two. Nodes of low importance
are removed with what is below them; a branch whose text is all of low importance goes that way. Tags and classes that name a role as a whole decide first (a class
only where no ``article`` or ``main`` is inside): menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments have none. Inside an ``article`` or ``main`` the tree judges what is below it, never the article itself. Pages on
which the rest of the text is the same (or nearly: the smallest hashes of its shingles) count once for a node, so that copies
of an article on one host stay. Outside the article of a page only nodes that the tree has found important count.

Text: character references decoded, white space in a block turned into one space and trimmed, blocks joined by an empty
line. Null or empty pages have an empty text. Null addresses share the empty host. A tag that is not closed ends with its parent.
Repeated rows are extracted one by one; an empty table gives no rows; only id, address and page are read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import chunks, mix
from .neardup import shingles
from .urlvocab import host_and_path

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_NUMBER = re.compile(r"[0-9]+")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp noframes".split())
_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_CONTENT = frozenset("nav header footer aside form script style head title noscript template svg iframe object button select textarea menu dialog".split())
ROLES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside complementary ad ads advert adverts "
    "advertisement sponsor sponsored promo cookie cookies consent notice notices alert popup modal newsletter subscribe "
    "comment comments disqus form search".split()
)
# words that may stand beside a role in a name: site-header, ad-slot-3, comment-list; not has-sidebar or search-results
BESIDE = frozenset("site main top bottom left right primary secondary global mobile box bar list item link links widget slot unit section area".split())
CONTENT = frozenset(["article", "main"])


@dataclass(frozen=True)
class TreeSettings:
    min_pages: int = 8  # pages a node must be on to be judged by entropy
    threshold: float = 0.2
    presentation_share: float = 0.1


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed=seed & 0xFFFFFFFFFFFFFFFF)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def names_role(marks: str) -> bool:
    """Whether one of the names, as a whole, is that of a role."""
    for name in marks.split():
        parts = [p for p in _SPLIT.split(name) if p and not p.isdigit()]
        if not ROLES.isdisjoint(parts) and all(p in ROLES or p in BESIDE for p in parts):
            return True
    return False


def gone(removed: tuple) -> bool:
    """Whether a role removes an element: for good by a tag, or by a class until an article is found inside."""
    return removed[0] or removed[1] is not None and removed[1][0]


def walk(page: str) -> Iterator[tuple[str, tuple]]:
    """Blocks of a page in order: text and the open element. Ask ``gone`` after the last block only.

    A path is given as the chain of node numbers, shared between blocks, so deep pages stay linear.
    """
    # an open element: tag, node number, removed by role, in an article, chain of nodes above and itself; a removal by
    # class is a list of whether it holds and the one around it, which never holds where this one does not
    stack: list[tuple] = [("", 0, (False, None), False, None)]
    text: list[str] = []
    at, n = 0, len(page)

    def block():
        joined = " ".join(references.unescape("".join(text)).split())
        text.clear()
        return joined

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (nxt.isascii() and nxt.isalpha() or nxt == "/"):
            text.append("<")
            at = lt + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            end = page.find(">", lt) if nxt == "/" else -1
            if end < 0:
                break  # a tag that never ends
            at = end + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if any(e[0] == name for e in reversed(stack)):
                joined = block() if name in BLOCKS else None
                if joined:
                    yield joined, stack[-1]
                while stack[-1][0] != name:
                    stack.pop()
                if joined is None and len(stack) > 1 and stack[-1][2] is not stack[-2][2]:
                    text.clear()  # an inline element without content
                stack.pop()
            continue
        marks = ""
        if m[3]:
            marks = " ".join(a or b or c for a, b, c in _MARK.findall(m[3])).lower()
        role = name in NO_CONTENT or bool(marks) and name not in CONTENT and names_role(marks)
        if name in BLOCKS or role and name not in VOID:
            joined = block()
            if joined:
                yield joined, stack[-1]
            if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th", "hr"):
                _close(stack, name)
        elif name == "br":
            text.append("\n")
        if name in RAW:
            end = _END[name].search(page, at)
            if not end:
                break
            stop = page.find(">", end.end())
            at = n if stop < 0 else stop + 1
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        if name in BLOCKS or role:
            _, path, removed, inside, chain = stack[-1]
            number = _hash(name + "." + _NUMBER.sub("0", marks), path)
            if name in NO_CONTENT:
                removed = (True, removed[1])
            elif role and name not in ("body", "html"):
                removed = (removed[0], [True, removed[1]])
            if name in CONTENT and not removed[0]:
                around = removed[1]
                while around and around[0]:
                    around[0], around = False, around[1]
            if name in CONTENT and not gone(removed):
                stack.append((name, number, removed, True, None))  # its own root and what is around it are not judged
                continue
            stack.append((name, number, removed, inside, (number, chain)))
    joined = block()
    if joined:
        yield joined, stack[-1]


_INSIDE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}}


def _close(stack: list[tuple], name: str) -> None:
    """Ends the element that cannot hold this one: a paragraph, or an open item of the same list."""
    if name in ("p", "hr"):
        if stack[-1][0] == "p":
            stack.pop()
        return
    same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
    for i in range(len(stack) - 1, max(0, len(stack) - 8), -1):
        if stack[i][0] in same:
            del stack[i:]
            return
        if stack[i][0] in _INSIDE.get(name, ()):
            return


def page_nodes(page: str) -> dict[int, tuple[int, int, int]]:
    """For every node of a page that holds text itself: the blocks it shows, a hash of their text, and one of the page's other text.

    The last is made of the two smallest hashes, by two functions, of the shingles of the other nodes that stay; most near copies share it.
    """
    found: dict[int, list[str]] = {}
    stays: dict[int, bool] = {}  # and whether in an article
    for text, (_, path, removed, inside, _) in list(walk(page)):
        found.setdefault(path, []).append(text)
        if not gone(removed):
            stays[path] = stays.get(path, False) or inside
    if any(stays.values()):
        stays = {p: x for p, x in stays.items() if x}
    value, start = shingles(["\n".join(found[p]) for p in stays], 3)
    rests = dict.fromkeys(found, 0)
    for hashes in (value, mix(value)):
        least = {p: int(hashes[i:j].min()) for p, i, j in zip(stays, start[:-1].tolist(), start[1:].tolist()) if i < j}
        first, second = (sorted(least.values()) + [0, 0])[:2]
        for p in found:
            rests[p] = (rests[p] * 31 + (second if least.get(p) == first else first)) & 0xFFFFFFFFFFFFFFFF
    return {p: (len(x), _signed(_hash("\n".join(x), 2)), _signed(rests[p])) for p, x in found.items()}


def main_text(page: str, low: set[int], high: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """The blocks that stay; ``low`` and ``high`` are the numbers of the nodes judged, by importance, on the page's host."""
    blocks, article = [], False
    for text, (_, path, removed, inside, chain) in list(walk(page)):
        if gone(removed):
            continue
        c = chain if low else None
        while c and c[0] not in low:
            c = c[1]
        article = article or inside
        if not c:
            blocks.append((text, inside or path in high))
    return [t for t, counts in blocks if counts or not article]


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html", settings: TreeSettings = TreeSettings()) -> DataFrame:
    """host, node, pages that have it, its importance."""
    s = settings
    given = pages.select(F.col(f"`{url_col}`").cast("string").alias("_url"), F.col(f"`{html_col}`").cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_html"):
                out: list[tuple] = []
                for url, page in zip(part.column("_url").to_pylist(), part.column("_html").to_pylist()):
                    host = host_and_path(url)[0]
                    out += [(host, _signed(p), *x) for p, x in page_nodes(page or "").items()]
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], type=t) for i, t in enumerate(types)], names=["host", "node", "look", "content", "rest"]
                )

    shown = given.mapInArrow(run, "host string, node long, look long, content long, rest long").distinct()
    # one pass for both choices: a row for each, counted by value, then their entropy
    choices = shown.select(
        "host", "node", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("look").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("c")
    )
    counted = choices.groupBy("host", "node", "c.kind", "c.value").agg(F.count(F.lit(1)).alias("c"))
    m = F.sum("c")
    # -sum(p log p) / log m with p = c / m
    entropy = F.when(m > 1, F.round(1 - F.sum(F.col("c") * F.log("c")) / (m * F.log(m)), 9)).otherwise(F.lit(1.0))
    each = counted.groupBy("host", "node", "kind").agg(m.alias("pages"), entropy.alias("entropy"))
    share = F.when(F.col("kind") == 0, s.presentation_share).otherwise(1 - s.presentation_share)
    return each.groupBy("host", "node").agg(F.max("pages").alias("pages"), F.sum(share * F.col("entropy")).alias("importance"))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", settings: TreeSettings = TreeSettings()
) -> DataFrame:
    """Per page its main text, the length of that, and the number of its blocks."""
    s = settings
    tree = style_tree(pages, url_col, html_col, s)
    unimportant = F.col("importance") < s.threshold
    # the nodes judged, by host; the written size decides how it is joined
    judged = tree.where(F.col("pages") >= s.min_pages).groupBy("host").agg(
        F.collect_list(F.when(unimportant, F.col("node"))).alias("_low"), F.collect_list(F.when(~unimportant, F.col("node"))).alias("_high")
    )
    judged = written(judged, "judged-nodes")
    given = pages.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"),
        F.col(f"`{html_col}`").cast("string").alias("_html"),
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(F.coalesce("_url", F.lit("")), "://([^/?#]*)", 1), upper, lower)
    joined = given.withColumn("host", host).join(judged, "host", "left").select("_id", "_url", "_html", "_low", "_high")
    id_type = given.schema["_id"].dataType.simpleString()
    names = [id_col, "url", "text", "n_chars", "n_blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_html"):
                found = [
                    main_text(page or "", *({x & 0xFFFFFFFFFFFFFFFF for x in nodes or ()} for nodes in judged))
                    for page, *judged in zip(*(part.column(c).to_pylist() for c in ("_html", "_low", "_high")))
                ]
                texts = ["\n\n".join(b) for b in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"), part.column("_url"), pa.array(texts, type=pa.string()),
                        pa.array([len(t) for t in texts], type=pa.int64()), pa.array([len(b) for b in found], type=pa.int64()),
                    ],
                    names=names,
                )

    return joined.mapInArrow(run, f"`{id_col}` {id_type}, url string, text string, n_chars long, n_blocks long")
